"""Document fingerprints by locally consistent parsing.

Method: deterministic coin tossing. Runs of equal symbols, of any length
from two on, are one symbol; each
symbol's label is the place and value of the lowest bit in which it differs
from the one before it, taken again until labels are below six; phrases begin
at local maxima of the labels and get names by hashing what they hold. Names are the next
level's symbols. Whether a phrase begins somewhere depends on a few symbols
around it only, so equal substrings get equal names inside, at any offset. A
fingerprint keeps the smallest hashes of three levels' names, slot by slot.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, documents, save, table

#: Slots of a fingerprint by level; a level's phrases are about three times as long as those below.
SLOTS = {2: 16, 3: 24, 4: 24}
#: Bytes of text in a range of neighbouring documents, and the most ranges, each a task (beyond 400 GB of text ranges grow, 1 GB each at 100 TB; their sort spills).
RANGE_BYTES = 4 << 20
MOST_RANGES = 100_000
#: Keys drawn for each range to find the bounds, in proportion to their bytes, and what a row counts beside its text.
SAMPLE_KEYS = 50
#: Keys drawn in all, on average, at most.
MOST_KEYS = 1_000_000
ROW_BYTES = 200
#: Rows of one doc_id and text that stay rows of a range; beyond, or beyond a 20,000th of all rows, they are taken once.
EQUAL_ROWS = 64
#: Rows of equal documents that one task hands out.
HANDED = 20_000
#: Bytes parsed at once, and rows in a batch.
BLOCK_BYTES = 4_000_000

_TOTAL = sum(SLOTS.values())
_BITS = np.uint64(0x03F79D71B4CB0A89)
_PLACE = np.zeros(64, np.uint8)
for _k in range(64):
    _PLACE[((1 << _k) * int(_BITS) & (1 << 64) - 1) >> 58] = _k
_POWER = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(255, 0x9E3779B97F4A7C15, np.uint64)]))


def _toss_table(size: int) -> np.ndarray:
    """Labels for every pair (before, now) of symbols below ``size``."""
    before, now = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    differ = before ^ now
    low = differ & -differ
    place = np.where(low > 0, np.log2(np.maximum(low, 1)).astype(int), 0)
    return (2 * place + ((now & low) > 0)).astype(np.uint8).ravel()


_T256, _T128, _T16, _T8 = (_toss_table(n) for n in (256, 128, 16, 8))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _toss(labels: np.ndarray, starts: np.ndarray, known: np.ndarray, shift: int) -> np.ndarray:
    before = np.concatenate([labels[:1], labels[:-1]]).astype(np.uint16)
    out = known[(before << shift) | labels]
    out[starts] = 0
    return out


def _labels(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    if symbols.dtype == np.uint8:
        return _toss(_toss(_toss(symbols, starts, _T256, 8), starts, _T16, 4), starts, _T8, 3)
    differ = symbols[1:] ^ symbols[:-1]
    low = differ & (~differ + np.uint64(1))
    first = np.zeros(len(symbols), np.uint8)
    first[1:] = 2 * _PLACE[(low * _BITS) >> np.uint64(58)] + ((symbols[1:] & low) > 0)
    first[starts] = 0
    return _toss(_toss(_toss(first, starts, _T128, 7), starts, _T16, 4), starts, _T8, 3)


def _level(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of several texts laid end to end, and where each text's names start."""
    new = np.concatenate([[True], symbols[1:] != symbols[:-1]])
    new[starts] = True
    if not new.all():
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, len(symbols)))
        starts = np.searchsorted(at, starts)
        kept = symbols[at]
        labels = _labels(kept, starts)
        values = np.where(length > 1, _mix(kept.astype(np.uint64) + _POWER[3]), kept.astype(np.uint64))
    else:
        labels, values = _labels(symbols, starts), symbols.astype(np.uint64)
    top = np.zeros(len(labels), bool)
    top[1:-1] = (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    top[starts[1:] - 1] = False
    top[starts] = True
    at = np.flatnonzero(top)
    length = np.diff(np.append(at, len(values)))
    place = np.arange(len(values)) - np.repeat(at, length)
    names = _mix(np.add.reduceat(values * _POWER[place & 255], at) + length.astype(np.uint64))
    return names, np.searchsorted(at, starts)


def _block(texts: list[bytes]) -> np.ndarray:
    """Fingerprints (one row of slots each) of texts that hold at least a byte."""
    symbols = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in texts])[:-1]]).astype(np.int64)
    out, column = np.zeros((len(texts), _TOTAL), np.uint16), 0
    for level in range(1, max(SLOTS) + 1):
        symbols, starts = _level(symbols, starts)
        if level in SLOTS:
            slots = SLOTS[level]
            of = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(symbols))))
            drawn = _mix(symbols ^ np.uint64(level))
            key = (of * slots).astype(np.uint64) + drawn % np.uint64(slots)
            order = np.sort((key << np.uint64(40)) | (drawn >> np.uint64(24)))
            cell = order >> np.uint64(40)
            least = order[np.concatenate([[True], cell[1:] != cell[:-1]])]
            cell = (least >> np.uint64(40)).astype(np.int64)
            out[cell // slots, column + cell % slots] = 1 + (least & np.uint64(0xFFFFFFFFFF)) % np.uint64(65535)
            column += slots
    return out


def fingerprints(texts: list[str]) -> np.ndarray:
    """Slots of each text's fingerprint; those of the empty text are all zero."""
    raw = [x.encode() for x in texts]
    out = np.zeros((len(raw), _TOTAL), np.uint16)
    full = [k for k, x in enumerate(raw) if x]
    at = 0
    while at < len(full):
        end, size = at, 0
        while end < len(full) and (end == at or size + len(raw[full[end]]) <= BLOCK_BYTES):
            size += len(raw[full[end]])
            end += 1
        out[full[at:end]] = _block([raw[k] for k in full[at:end]])
        at = end
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of common phrases of fingerprints, row by row: the mean over levels of 2J / (1 + J), J their Jaccard index; two empty texts are alike."""
    parts, at = [], 0
    for slots in SLOTS.values():
        x, y = a[:, at : at + slots], b[:, at : at + slots]
        used = ((x > 0) | (y > 0)).sum(axis=1)
        j = np.where(used > 0, ((x == y) & (x > 0)).sum(axis=1) / np.maximum(used, 1), 1.0)
        parts.append(2 * j / (1 + j))
        at += slots
    return np.mean(parts, axis=0)


def hexed(slots: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in slots]


def edited(text: str, following: str) -> str:
    """The text with its last floor(n / 2) characters replaced by the following text's first as many, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("times", pa.int64()),
])


def _ordered(ids: pa.Array, hashes: pa.Array) -> np.ndarray:
    """Fixed-width bytes that sort as (doc_id, hash) do, null doc_ids first."""
    n = len(ids)
    out = np.zeros((n, 17), np.uint8)
    out[:, 0] = 1 - ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
    for at, column in ((1, ids.fill_null(0)), (9, hashes)):
        signed = column.cast(pa.int64()).to_numpy(zero_copy_only=False)
        out[:, at : at + 8] = (signed.view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(n, 8)
    return out.view("S17").ravel()


def _ranges(keys: DataFrame, rows: int, size: int) -> np.ndarray:
    """First possible keys of the ranges, of about equal bytes, from a bounded sample of the distinct keys."""
    spark = keys.sparkSession
    wanted = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_BYTES)))
    mean = max(1.0, (size + ROW_BYTES * rows) / max(rows, 1))
    chance = F.lit(min(SAMPLE_KEYS * wanted, MOST_KEYS) / max(rows, 1)) * (F.coalesce("size", F.lit(0)) + ROW_BYTES * F.col("n")) / F.lit(mean)
    drawn = keys.withColumn("chance", chance).filter(F.pmod(F.xxhash64("_hash", "doc_id"), F.lit(1_000_000_000)) < F.col("chance") * 1e9)
    drawn = drawn.select("doc_id", "_hash", F.greatest("chance", F.lit(1.0)).alias("weight")).toArrow().combine_chunks()
    if not drawn.num_rows:
        return np.array([b""], "S17")
    at = _ordered(drawn.column("doc_id").combine_chunks(), drawn.column("_hash").combine_chunks())
    order = np.argsort(at)
    weight = np.cumsum(drawn.column("weight").to_numpy()[order])
    cuts = np.searchsorted(weight, np.arange(1, wanted) * weight[-1] / wanted, side="left") + 1
    return np.concatenate([[b""], np.unique(at[order][cuts[cuts < len(at)]])]).astype("S17")


def neighbours(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Documents in ranges of (doc_id, text hash), null ids first, each range followed by the next one's first document.

    Returns the rows (_range, _copy, _times, doc_id, text), one partition a
    range and sorted within, and the keys (doc_id, _hash, n) of documents that
    so many rows repeat that they are taken once (None: none). ``_copy`` marks
    the document after the range; the last range is followed by the first
    document of all. Bounds come from a narrow table of keys, so texts move
    once, at every size; rows of one doc_id, or without any, are spread by
    their hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_hash", F.xxhash64("text"))
    keys = save(rows.groupBy("doc_id", "_hash").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size")))
    total, size, most = keys.agg(F.sum("n"), F.sum("size"), F.max("n")).first()
    heavy, single = None, rows.withColumn("_times", F.lit(1).cast("long"))
    limit = max(EQUAL_ROWS, (total or 0) // 20_000)
    if (most or 0) > limit:
        heavy = keys.filter(F.col("n") > limit).select("doc_id", "_hash", "n")
        known = F.broadcast(heavy.select(F.col("doc_id").alias("_d"), F.col("_hash").alias("_h"), F.col("n").alias("_n")))
        same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h"))
        once = rows.join(known, same).groupBy("doc_id", "_hash").agg(F.min("text").alias("text"), F.max("_n").alias("_times")).select(*rows.columns, "_times")
        single = single.join(known, same, "left_anti").unionByName(once)
        keys = keys.withColumns({"size": F.when(F.col("n") > limit, F.col("size") / F.col("n")).otherwise(F.col("size")), "n": F.when(F.col("n") > limit, F.lit(1)).otherwise(F.col("n"))})
    bounds = _ranges(keys, total or 0, size or 0)
    packed = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf("int")
    def range_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(packed.value, _ordered(ids, hashes), side="right") - 1, pa.int32())

    at = range_of("doc_id", "_hash")
    firsts = keys.select(at.alias("_range"), "doc_id", "_hash").groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "_hash")).alias("k")).collect()
    firsts.sort(key=lambda r: r["_range"])
    before = [(firsts[k - 1]["_range"], r["k"]["doc_id"], r["k"]["_hash"]) for k, r in enumerate(firsts)]
    known = F.broadcast(spark.createDataFrame(before, "_to int, _d long, _h long"))
    placed = single.withColumn("_range", at)
    copies = F.array(F.struct(F.col("_range"), F.lit(False).alias("_copy")), F.struct(F.col("_to").alias("_range"), F.lit(True).alias("_copy")))
    both = placed.join(known, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")), "left").withColumn(
        "_at", F.explode(F.when(F.col("_to").isNull(), F.slice(copies, 1, 1)).otherwise(copies))
    )
    moved = both.select("_at._range", "_at._copy", "_times", "doc_id", "_hash", "text").repartitionById(len(bounds), F.col("_range"))
    return moved.sortWithinPartitions("_range", "_copy", F.col("doc_id").asc_nulls_first(), "_hash").drop("_hash"), heavy


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprint each whole text (doc_id, text; null: empty) and its edited text, and their likeness.

    The next document follows by doc_id (null first; rows of one doc_id by a
    hash of their text); after the last comes the first, and a lone document is
    its own next one. Equal rows follow each other; where very many rows are
    equal, all but one of them are their own next one by one computed row,
    which is handed out in portions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(batch.column("_copy").to_pylist(), batch.column("doc_id").to_pylist(), (x or "" for x in batch.column("text").to_pylist()), batch.column("_times").to_pylist())
            if len(held) > 1:
                yield _described(held)
                held = held[-1:]

    arrow_batches(docs.sparkSession)
    chain, heavy = neighbours(docs)
    found = chain.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, times long")
    if heavy is None:
        return found.drop("times")
    found = save(found)
    portions = found.filter("times > 0").withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / HANDED))))
    portions = portions.repartition(F.xxhash64("doc_id", "edited_sha256", "_p")).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(HANDED), F.col("times") - F.col("_p") * HANDED))))
    return found.filter("times = 0").drop("times").unionByName(portions.drop("times", "_p", "_k"))


def _described(held: list[tuple]) -> pa.RecordBatch:
    """Rows for all but the last held document; copies get none.

    A document that stands for many rows gets a second row, with the number of
    rows (``times``) that are followed by an equal one.
    """
    at = [k for k in range(len(held) - 1) if not held[k][0]]
    pairs = [(k, k + 1, 0) for k in at] + [(k, k, held[k][3] - 1) for k in at if held[k][3] > 1]
    here, there = [k for k, *_ in pairs], [n for _, n, _ in pairs]
    changed = [edited(held[k][2], held[n][2]) for k, n, _ in pairs]
    slots = fingerprints([h[2] for h in held])
    other = fingerprints(changed)
    return table(RESULT, [
        [held[k][1] for k in here], [len(held[k][2]) for k in here], [hashlib.sha256(x.encode()).hexdigest() for x in changed], hexed(slots[here]), hexed(other),
        pa.array(likeness(slots[here], other)), pa.array(likeness(slots[here], slots[there])), [t for *_, t in pairs],
    ])


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))
