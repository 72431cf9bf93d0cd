"""Language identification by compression.

Method: for each language a zstandard raw-content dictionary is made from a
bounded sample of labelled texts; a text is compressed, block by block and
whole, with each dictionary, and the smallest total wins. A narrow margin to
the second smallest rejects the text.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, documents, table

#: The bounds of the labelled sample: bytes of a language's dictionary, and of one text in it.
DICTIONARY_BYTES = 96 * 1024
SAMPLE_BYTES = 2048
#: A language's dictionary is made from twice as many distinct texts at most; the rest of the labelled rows is not collected.
SAMPLE_ROWS = 120
#: All dictionaries together; where there are more than some 680 languages, each gets less, and fewer texts are collected for it.
ALL_BYTES = 64 << 20
#: Prepared dictionaries that a task keeps, each of about 0.6 MB; others are prepared again for each group of texts.
PREPARED = 200
#: Bytes of letters that are compressed with a dictionary before the next one's turn.
GROUP_BYTES = 4 << 20
#: A text is compressed in blocks of this size, so that far repeats within it don't hide the language.
BLOCK_BYTES = 4096
#: Short matches and one step of lookahead: words of a few letters tell languages apart.
SETTINGS = {"window_log": 17, "chain_log": 16, "hash_log": 16, "search_log": 3, "min_match": 4, "target_length": 16}
#: Relative margin below which a prediction is rejected, and the bytes from which sizes are fine enough to tell;
#: below them a tie goes to the language with more labelled documents.
MARGIN = 0.002
MARGIN_BYTES = 200
UNDETERMINED = "und"

PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())])


#: ASCII punctuation and digits say nothing of the language and are left out; ASCII white space and controls become spaces.
NOT_LETTERS = bytes(b for b in range(33, 127) if not chr(b).isalpha())
SPACES = bytes(32 if b < 33 or b == 127 else b for b in range(256))


def letters(text: str) -> bytes:
    """A text's lower-case letters and spaces in UTF-8, as they are compressed."""
    return text.lower().encode().translate(SPACES, NOT_LETTERS)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept out of learning: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """Raw-content dictionaries by language from labelled documents that aren't held out.

    Languages come in descending order of their labelled documents.
    The sample is bounded: the 2 * ``rows`` distinct texts of a language with
    the lowest hashes (which are alike over any partitioning), SAMPLE_BYTES of
    each and DICTIONARY_BYTES in all. Copies leave before they are collected: a
    share of hashes with twice as many texts is expected to hold the lowest.
    Every label with a text is learned; ALL_BYTES is shared where they are many.
    """
    spark = docs.sparkSession
    usable = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    usable = usable.select("lang", "text", F.xxhash64("text").alias("at")).withColumn("place", F.pmod("at", F.lit(1_000_000)))
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("at").alias("d")).orderBy(F.desc("n"), "lang").collect()
    counts = {r["lang"]: r["n"] for r in sizes}
    most = min(DICTIONARY_BYTES, ALL_BYTES // max(1, len(sizes)))
    rows = max(1, math.ceil(rows * most / DICTIONARY_BYTES))
    shares = [(r["lang"], max(1, math.ceil(1_000_000 * min(1.0, 4 * rows / r["d"])))) for r in sizes]
    below = F.broadcast(spark.createDataFrame(shares, "lang string, below long"))
    drawn = usable.join(below, "lang").filter(F.col("place") < F.col("below")).select("lang", "at", "place", F.substring("text", 1, SAMPLE_BYTES).alias("text")).distinct()
    lowest = F.row_number().over(Window.partitionBy("lang").orderBy("place", "at", "text"))
    sample = drawn.withColumn("k", lowest).filter(F.col("k") <= 2 * rows).collect()
    made: dict[str, bytearray] = {}
    seen: set[bytes] = set()
    for r in sorted(sample, key=lambda r: (r["lang"], r["at"] & (2**64 - 1), r["text"])):
        raw = letters(r["text"])[: min(SAMPLE_BYTES, most)]
        whole = made.setdefault(r["lang"], bytearray())
        if raw not in seen and len(whole) + len(raw) <= most:
            seen.add(raw)
            whole += raw
    return {k: bytes(made[k]) for k in sorted(made, key=lambda k: (-counts[k], k))}


@functools.lru_cache(PREPARED)
def _compressor(raw: bytes):
    import zstandard

    how = zstandard.ZstdCompressionParameters(**SETTINGS, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_dict_id=False)
    known = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    known.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=known)


_LETTER = regex.compile(r"\p{L}")


def _groups(texts: list[str | None]) -> Iterator[list[bytes | None]]:
    """Letters of the texts, None where there is none, in groups of about GROUP_BYTES."""
    group, size = [], 0
    for text in texts:
        group.append(letters(text) if text and _LETTER.search(text) else None)
        size += len(group[-1] or b"")
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def judge(raw: bytes, sizes: list[int], dictionaries: dict[str, bytes], least_margin: float = MARGIN) -> tuple[str, float, float, bool]:
    """(language, score, margin, rejected) of one text from its compressed sizes.

    The margin is the second smallest size over the smallest, less one; the
    score is the winner's share of exp(-60 * relative excess) over languages.
    Equal sizes go to the language with more labelled documents.
    """
    best = min(range(len(sizes)), key=lambda k: (sizes[k], k))
    least = sizes[best]
    margin = min((s for k, s in enumerate(sizes) if k != best), default=2 * least) / least - 1.0
    weights = sum(math.exp(-60.0 * (s - least) / least) for s in sizes)
    return list(dictionaries)[best], 1.0 / weights, margin, len(raw) >= MARGIN_BYTES and margin < least_margin


def classify(texts: list[str | None], dictionaries: dict[str, bytes], least_margin: float = MARGIN) -> list[tuple[str, float, float, bool]]:
    """(language, score, margin, rejected) of each text; one dictionary is asked for a group of texts before the next."""
    out = []
    for group in _groups(texts):
        sizes: list[list[int]] = [[] for _ in group]
        for known in dictionaries.values():
            c = _compressor(known)
            for raw, own in zip(group, sizes):
                if raw is not None:
                    own.append(sum(len(c.compress(raw[at : at + BLOCK_BYTES])) for at in range(0, len(raw), BLOCK_BYTES)))
        out += [judge(raw, own, dictionaries, least_margin) if own else (UNDETERMINED, 0.0, 0.0, True) for raw, own in zip(group, sizes)]
    return out


def predict(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """Predict from the whole text only: doc_id, lang_pred, score, margin, rejected.

    A text that is null or has no letter is ``und`` with score 0 and rejected;
    with a single learned language every other text gets that one.
    """
    packed = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = classify(batch.column("text").to_pylist(), packed.value, margin)
            yield table(PREDICTED, [batch.column("doc_id"), *(zip(*rows) if rows else [[]] * 4)])

    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def known(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """The documents' rows whose language can be told, learned from themselves; each row is judged where it is, without a shuffle."""
    packed = docs.sparkSession.sparkContext.broadcast(learn(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not r[3] for r in classify(batch.column(at).to_pylist(), packed.value, margin)], pa.bool_()))

    arrow_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that aren't held out, predict all: doc_id, held_out, lang_pred, score, margin, rejected."""
    found = predict(docs, learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
