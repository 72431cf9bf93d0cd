"""Best-fit packing of documents into fixed-length sequences.

Method: length-histogram planning. Documents are cut into pieces of at most
``limit`` tokens; the driver sees only the histogram of piece lengths (at most
``limit`` numbers, whatever the corpus size), plans best-fit decreasing over
counts, and gets a plan of ranges "ranks r0..r1 of length L go to sequences
s0.. at offset o". Pieces then take their slots by joining on the rank within
their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import arrow_batches, documents, save, table, texts

LIMIT = 2048
#: Pieces that one rank group holds on average; ranks within a length are counted per group.
GROUP_ROWS = 20_000

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def cut(ids: np.ndarray, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but for the first, which takes the rest."""
    n = len(ids)
    first = n % limit or limit
    if n <= limit:
        return [(0, n)]
    return [(0, first), *((at, limit) for at in range(first, n, limit))]


def pieces(docs: DataFrame, limit: int = LIMIT, end_id: int = 0, tokenizer: str = tokens.DEFAULT) -> DataFrame:
    """Pieces of the documents (doc_id, text): doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.quick(tokenizer).encode_to_numpy
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                ids = np.append(encode(text, allowed_special="all"), np.uint32(end_id)).astype("<u4")
                for k, (at, n) in enumerate(cut(ids, limit)):
                    out.append((doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            yield table(PIECES, list(zip(*out)) or [[]] * 5)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, rank_from, rank_to, sequence, per_sequence, offset).

    Ranks rank_from <= r < rank_to of a length go, ``per_sequence`` to each, to
    the sequences from ``sequence`` on, the first of each at ``offset``. Open
    sequences are kept as ranges with equal room; a length takes the tightest
    room that holds it, so the work depends on the number of distinct lengths
    and ranges, never on the number of documents.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    new = 0

    def put(left: int, first: int, count: int) -> None:
        if left and count:
            if left not in room:
                room[left] = []
                bisect.insort(rooms, left)
            room[left].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, rest = 0, histogram[length]
        while rest:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, count = room[left].pop()
                if not room[left]:
                    del room[left]
                    rooms.pop(at)
            else:
                left, first = limit, new
                count = -(-rest // (limit // length))
                new += count
            each = left // length
            full = min(count, rest // each)
            if full:
                slots.append((length, rank, rank + full * each, first, each, limit - left))
                put(left - each * length, first, full)
                rank, rest = rank + full * each, rest - full * each
            if full < count and rest and rest < each:
                slots.append((length, rank, rank + rest, first + full, rest, limit - left))
                put(left - rest * length, first + full, 1)
                put(left, first + full + 1, count - full - 1)
                rank, rest = rank + rest, 0
            else:
                put(left, first + full, count - full)
    return slots


def pack(cut_pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add sequence_id and offset to pieces (columns doc_id, piece, length and any others).

    Ranks within a length are counted in groups of doc_id hashes, whose number
    follows the number of rows, so a length that a third of all pieces share is
    spread over many tasks. An empty input gives an empty result; equal rows
    get different slots. Other columns may have any names; sequence_id and
    offset are replaced.
    """
    spark = cut_pieces.sparkSession
    counted = cut_pieces.groupBy("length").count().collect()
    histogram = {r["length"]: r["count"] for r in counted}
    groups = max(8, sum(histogram.values()) // GROUP_ROWS)
    slots = spark.createDataFrame(plan(histogram, limit) or [(0, 0, 0, 0, 1, 0)], "size long, rank_from long, rank_to long, first long, each long, base long")
    order = [F.col(f"r.{c}").asc_nulls_first() for c in ("doc_id", "piece", "ids_crc32") if c in cut_pieces.columns]
    rows = cut_pieces.select(F.struct(*(F.col(f"`{c}`") for c in cut_pieces.columns)).alias("r"), F.col("length").alias("size"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).alias("part"))
    before = (
        rows.groupBy("size", "part").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("part")) - F.col("n")).drop("n")
    )
    ranked = (
        rows.withColumn("rank", F.row_number().over(Window.partitionBy("size", "part").orderBy(*order)) - 1)
        .join(before, ["size", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    )
    at = F.col("rank") - F.col("rank_from")
    return (
        ranked.join(F.broadcast(slots), "size").filter((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
        .select(*(F.col(f"r.`{c}`") for c in cut_pieces.columns if c not in ("sequence_id", "offset")),
                (F.col("first") + F.floor(at / F.col("each"))).alias("sequence_id"), (F.col("base") + (at % F.col("each")) * F.col("size")).alias("offset"))
    )


def pack_documents(docs: DataFrame, limit: int = LIMIT, end_id: int = 0, tokenizer: str = tokens.DEFAULT) -> DataFrame:
    """Pack documents (doc_id, text; null text: empty) into sequences of at most ``limit`` tokens."""
    arrow_batches(docs.sparkSession)
    return pack(save(pieces(docs, limit, end_id, tokenizer)), limit)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
