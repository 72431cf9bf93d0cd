"""SimHash near-duplicates.

Method: meet-in-the-middle ball hashing. Two fingerprints that differ in at most
``radius`` bits share a variant within half that radius of both, so every
distinct fingerprint emits its ball of variants and only variants that several
fingerprints reach are looked at again. A variant's fingerprints are all within
the radius of each other, at most one ball of them, so linking each to the
smallest loses no connection; links are verified by counting differing bits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, components, documents, save, table, texts

WORDS = 3
SEED = 42
RADIUS = 2
#: Fingerprints whose variants one task emits.
SPREAD = 100_000
#: Hashes whose bits are counted at once.
BLOCK = 65_536



def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of the ASCII-lower-cased text, repeats included; fewer words make one shingle, none makes none."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - words + 1].tolist()
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: a bit is 1 if it is set in over half the hashes; zero for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype("<u8")
        counts += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    set_bits = np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little")
    return int(set_bits.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, more: tuple[str, ...] = ()) -> DataFrame:
    """Fingerprint of each whole text (doc_id, text; null: no words): doc_id, print (long), and long columns ``more`` as they are."""
    names = ("doc_id", *more, "print")
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield table(schema, [*(batch.column(c) for c in names[:-1]), [fingerprint(shingle_hashes(x, words, seed)) for x in texts(batch)]])

    arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def ball(radius: int) -> list[int]:
    """Masks of at most ``radius`` bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in itertools.combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column print) that connect all within an even radius."""
    if radius % 2 or radius < 2:
        raise ValueError("the radius must be even: a ball of half the radius is hashed")
    masks = F.array(*(F.lit(m) for m in ball(radius // 2)))
    spread = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), prints.count() // SPREAD)
    prints = prints.select("print").repartition(spread, "print")
    reached = prints.select("print", F.explode(masks).alias("mask")).select(F.col("print").bitwiseXOR(F.col("mask")).alias("variant"), "print")
    shared = reached.groupBy("variant").agg(F.min("print").alias("b"), F.max("print").alias("top")).filter(F.col("b") < F.col("top"))
    back = shared.select("b", F.explode(masks).alias("mask"), "variant").select(F.col("variant").bitwiseXOR(F.col("mask")).alias("print"), "b")
    return (
        back.filter(F.col("print") != F.col("b")).distinct().join(prints.select("print"), "print", "left_semi")
        .filter(F.bit_count(F.col("print").bitwiseXOR(F.col("b"))) <= radius).select(F.col("print").alias("a"), "b")
    )


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """Distinct fingerprints (column print, and a smallest value ``first`` of each) with the one that their component has (component)."""
    nodes = save(prints)
    grouped = components(links(nodes.select("print"), radius)).withColumnRenamed("node", "print")
    return save(nodes.join(grouped, "print", "left").withColumn("component", F.coalesce("component", "print")))


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """Group documents whose fingerprints link: doc_id, fingerprint, component_id, kept.

    component_id is the smallest doc_id that links reach. Texts without words
    have fingerprint zero and link like any other; rows with equal doc_id stay
    apart unless their fingerprints link, and a null doc_id is never a
    component_id unless all ids of the group are null. ``kept`` holds for every
    row of that doc_id; :func:`surplus` tells such rows apart.
    """
    prints = save(fingerprints(docs, words, seed))
    named = _classes(prints.groupBy("print").agg(F.min("doc_id").alias("first")), radius)
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = save(named.join(smallest, "component").select("print", "component_id"))
    return prints.join(classes, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def surplus(docs: DataFrame, words: int = WORDS, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """What has to go for one document of each group to stay: doc_id, text_hash (xxhash64 of the text), one.

    The document with the smallest doc_id stays (ids before nulls), among its
    texts that with the smallest hash. Where several rows are that document, its
    key is listed with ``one`` true: all its rows but one have to go.
    """
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    prints = fingerprints(hashed, words, seed, ("text_hash",)).groupBy("print", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    prints = save(prints)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    named = _classes(prints.groupBy("print").agg(F.min(key).alias("first")), radius)
    best = named.groupBy("component").agg(F.min("first").alias("best"))
    classes = named.join(best, "component").select("print", "best")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    return save(prints.join(classes, "print").filter(~stays | (F.col("n") > 1)).select("doc_id", "text_hash", stays.alias("one")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents' rows with one document of each group of near-duplicates; see :func:`surplus`.

    The keys of rows that go are joined back on id and text hash; Spark
    broadcasts them where their table is small.
    """
    gone = surplus(docs)
    key = lambda t: F.col("r.doc_id").cast("long").eqNullSafe(t["doc_id"]) & (F.xxhash64("r.text") == t["text_hash"])
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("r"))
    kept = rows.join(gone, key(gone), "left_anti").select("r.*")
    several = gone.filter("one")
    if several.isEmpty():
        return kept
    once = rows.join(several, key(several), "left_semi").select("r", F.col("r.doc_id").alias("i"), F.xxhash64("r.text").alias("h")).dropDuplicates(["i", "h"])
    return kept.unionByName(once.select("r.*"))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
