"""Resharding by minimum-cost flow.

Method: old shards supply their bytes, new shards demand their capacities, and
moving a byte costs 1 unless it stays in the shard of its number. Successive
shortest paths solve the transfers, so the fewest bytes move. The flow runs on
a table of shards (its size is the number of shards, not of rows); rows follow
it by their place in an order: each old shard's bytes are cut into the blocks
that stay and those that go to each new shard. Rows that are large beside a
shard, of which there can only be a bounded number, are placed one by one
first, and the flow fills the shards around them, so sizes differ from each
other by a few small rows.

A null text has no bytes. Null and repeated ids, equal rows and ties are placed
row by row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, drop, numbered, save, stored

SHARDS = 24
#: Shards of the layout that the query starts from: texts by hash, equal ones together.
OLD_SHARDS = 16
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
#: A row is large from this part of a shard's capacity on; there are at most LARGE_PART of them to a shard.
LARGE_PART = 256


def transfers(have: Iterable[int], want: Iterable[int], cost: np.ndarray | None = None) -> np.ndarray:
    """Bytes from each old shard (row) to each new one (column) at the least cost; sums of ``have`` and ``want`` must be equal.

    ``cost`` (a byte; not negative) is 0 for shards of the same number and 1
    else if it isn't given. Augments along shortest paths in the residual graph.
    """
    supply, demand = np.array(list(have), np.int64), np.array(list(want), np.int64)
    if supply.sum() != demand.sum():
        raise ValueError("supply and demand differ")
    if cost is None:
        cost = 1.0 - np.eye(len(supply), len(demand))
    flow = np.zeros((len(supply), len(demand)), np.int64)
    while supply.any():
        here, there = np.where(supply > 0, 0.0, np.inf), np.full(len(demand), np.inf)
        into, back = np.full(len(demand), -1), np.full(len(supply), -1)
        while True:
            out = here[:, None] + cost
            best = out.argmin(axis=0)
            better = out[best, np.arange(len(demand))] < there - 1e-12
            if not better.any():
                break
            there, into = np.where(better, out[best, np.arange(len(demand))], there), np.where(better, best, into)
            undo = np.where(flow > 0, there[None, :] - cost, np.inf)
            best = undo.argmin(axis=1)
            better = undo[np.arange(len(supply)), best] < here - 1e-12
            here, back = np.where(better, undo[np.arange(len(supply)), best], here), np.where(better, best, back)
        end = int(np.where(demand > 0, there, np.inf).argmin())
        path, t = [], end
        while True:
            s = int(into[t])
            path.append((s, t, 1))
            if back[s] < 0:
                break
            t = int(back[s])
            path.append((s, t, -1))
        most = min([int(supply[s]), int(demand[end]), *(int(flow[a, b]) for a, b, sign in path if sign < 0)])
        for a, b, sign in path:
            flow[a, b] += sign * most
        supply[s] -= most
        demand[end] -= most
    return flow


def _level(loads: np.ndarray, rest: int) -> np.ndarray:
    """What each shard takes so that ``rest`` bytes bring all to the same size, whole bytes, none below its load."""
    order = np.sort(loads)
    for k in range(len(order), 0, -1):
        top = (rest + int(order[:k].sum())) // k
        if top >= order[k - 1]:
            break
    take = np.maximum(0, top - loads)
    spare = rest - int(take.sum())
    low = np.flatnonzero(loads <= top)
    take[low[:spare]] += 1
    return take


def plan(large: list[tuple[int, int, int]], small: dict[int, int], shards: int, cost: np.ndarray | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """Shards of the large rows as (key, shard), and the cuts of each old shard's other bytes as (old, low, high, shard).

    ``large`` has (key, old shard, bytes) and ``small`` the bytes of the other
    rows of each old shard. Large rows stay while their shard has room, the
    largest first; then the others go to the shards with least.
    """
    total = sum(s for *_, s in large) + sum(small.values())
    loads, homeless, placed = np.zeros(shards, np.int64), [], []
    for key, old, size in sorted(large, key=lambda x: (-x[2], x[0])):
        if 0 <= old < shards and loads[old] + size <= -(-total // shards):
            loads[old] += size
            placed.append((key, old))
        else:
            homeless.append((key, size))
    for key, size in homeless:
        to = int(loads.argmin())
        loads[to] += size
        placed.append((key, to))
    olds = list(range(max([shards, *(s + 1 for s in small)])))
    flow = transfers([small.get(s, 0) for s in olds], _level(loads, sum(small.values())), cost)
    cuts = []
    for s in olds:
        at = 0
        for t in sorted(np.flatnonzero(flow[s]).tolist(), key=lambda t: (t != s, t)):
            cuts.append((s, at, at + int(flow[s, t]), t))
            at += int(flow[s, t])
    return placed, cuts


def reshard(rows: DataFrame, shards: int = SHARDS, order: tuple[str, ...] = (), cost: np.ndarray | None = None) -> DataFrame:
    """``rows`` (narrow: old_shard int, size long and others) with ``shard`` and ``slot`` (gapless from 0 in each shard).

    Within an old shard rows keep the order of the columns ``order``; what stays
    comes first. Sizes are at least 1.
    """
    spark = rows.sparkSession
    if len({*rows.columns} & {"shard", "slot"}):
        raise ValueError("rows have a column shard or slot already")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    limit = max(1, total // shards // LARGE_PART)
    sized = rows.withColumn("_small", F.when(F.col("size") < limit, F.col("size")).otherwise(0))
    placed = save(numbered(sized, "old_shard", *order, size="_small"))
    olds = {r[0]: (r[1], r[2]) for r in placed.groupBy("old_shard").agg(F.sum("_small"), F.min("_before")).collect()}
    large = placed.filter("_small = 0").select("_at", "old_shard", "size").collect()
    alone, cuts = plan([tuple(x) for x in large], {s: int(n) for s, (n, _) in olds.items()}, shards, cost)
    starts = {s: b for s, (_, b) in olds.items()}
    one = spark.createDataFrame(alone, "_at long, _alone int")
    cut = spark.createDataFrame([(s, starts[s] + a, starts[s] + b, t) for s, a, b, t in cuts if s in starts], "_old int, _low long, _high long, _block int")
    inside = (F.col("old_shard") == F.col("_old")) & (F.col("_small") > 0) & (F.col("_before") >= F.col("_low")) & (F.col("_before") < F.col("_high"))
    put = placed.join(F.broadcast(one), "_at", "left").join(F.broadcast(cut), inside, "left").withColumn("shard", F.coalesce("_alone", "_block"))
    put = save(put.select(*rows.columns, "_part", "_at", "shard"))
    before = Window.partitionBy("shard").orderBy("_part")
    counts = put.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_first", F.sum("_n").over(before) - F.col("_n")).drop("_n")
    slot = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_at")) - 1
    return put.withColumn("_row", slot).join(counts, ["shard", "_part"]).select(*rows.columns, "shard", (F.col("_row") + F.col("_first")).alias("slot"))


def size_of(text: str = "text"):
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def rewrite(spark: SparkSession, folder: str, shards: int) -> DataFrame:
    """Reshard a table of Parquet folders ``shard=<k>`` in place to ``shards`` of near equal bytes; returns the moves (old_shard, shard, rows, bytes).

    Rows keep the order of their files, so what leaves a shard is the end of
    it: files from which no row goes stay as they are. The others' rows and
    those that arrive are written as new files beside the old ones, and only
    then are the replaced files deleted; readers must wait until it is done.
    """
    found = spark.read.parquet(folder)
    names = [c for c in found.columns if c != "shard"]
    named = found.withColumns({"_path": F.col("_metadata.file_path"), "_line": F.col("_metadata.row_index")})
    narrow = named.select(F.col("shard").cast("int").alias("old_shard"), size_of().alias("size"), "_path", "_line")
    put = save(reshard(narrow, shards, order=("_path", "_line")))
    touched = save(put.groupBy("_path").agg(F.max((F.col("shard") != F.col("old_shard")).cast("int")).alias("_moves")).filter("_moves = 1").select("_path"))
    where = put.join(touched, "_path", "left_semi").select("_path", "_line", F.col("shard").alias("_to"))
    moved = stored(named.join(where, ["_path", "_line"]).select(*names, F.col("_to").alias("shard")))
    paths = [r[0] for r in touched.collect()]  # of files, a bounded list of names
    moved.repartition("shard", F.pmod(F.xxhash64(*[c for c in names if c in ("doc_id", "text")] or names), F.lit(8))).write.mode("append").partitionBy("shard").parquet(folder)
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, False)
    drop(moved)
    spark.catalog.refreshByPath(folder)
    return put.groupBy("old_shard", "shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))


def op11_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From OLD_SHARDS shards of texts by hash, equal ones beside each other, to SHARDS of near equal bytes."""
    text = F.coalesce("text", F.lit(""))
    narrow = documents(spark, sf_dir).select("doc_id", size_of().alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_hash"))
    old = narrow.withColumn("old_shard", F.pmod("_hash", F.lit(OLD_SHARDS)).cast("int"))
    out = reshard(old, SHARDS, order=("_hash", "doc_id"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
