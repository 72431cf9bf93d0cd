"""Embedding near-duplicates within a label.

Method: Euclidean p-stable hashing. Normalised vectors are projected on random
directions, shifted and quantised; several quantised projections make a bucket
key, several keys make tables. Vectors of one bucket are compared exactly, in
blocks, and a pair counts in the first table that its vectors share. The number
of projections follows the size of the largest label, so buckets stay small as
the table grows, and the number of tables follows from the chance wanted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, components, save, table

COSINE = 0.98
#: Width of a quantisation step for unit vectors.
WIDTH = 0.2
#: Chance of missing a pair that is just at the threshold.
MISS = 1e-4
#: Chance neighbours of a vector in a table that keys are chosen for; few, since each costs a copy of the vector.
LOAD = 0.1
#: Vectors of a bucket that are compared with each other at once, and the largest group whose pairs are listed.
BLOCK = 512
SMALL = 8
#: Rows gathered before groups are compared, and pairs compared at once.
GATHERED = 8192
PAIRS = 65_536
SEED = 20_240


def _normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def same_step(distance: float, width: float = WIDTH) -> float:
    """Chance that two points at a distance fall into one step of a random projection (Datar et al. 2004)."""
    r = width / distance
    return 1 - 2 * _normal_cdf(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def design(rows: int, dim: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(projections a key, tables) for the size of the largest label.

    Directions are unit vectors, so a projection shrinks a distance by sqrt(dim).
    """
    shrink = math.sqrt(dim)
    near = same_step(math.sqrt(2 - 2 * cosine) / shrink) if cosine < 1 else 1.0
    far = same_step(math.sqrt(2) / shrink)
    keys = max(1, math.ceil(math.log(max(rows, 2) / LOAD) / -math.log(far)))
    hit = near**keys
    return keys, 1 if hit >= 1 - miss else math.ceil(math.log(miss) / math.log1p(-hit))


def directions(dim: int, keys: int, tables: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    a = rng.standard_normal((tables * keys, dim))
    return a / np.linalg.norm(a, axis=1, keepdims=True), rng.uniform(0, WIDTH, tables * keys)


def _keys(x: np.ndarray, keys: int, tables: int) -> np.ndarray:
    """One 32-bit key a vector and table; equal keys are one bucket, so a chance collision only makes a bucket larger."""
    a, shift = directions(x.shape[1], keys, tables)
    steps = np.floor((x @ a.T + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), tables, keys)
    odd = np.random.default_rng(SEED).integers(1, 1 << 63, keys, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = (steps * odd).sum(axis=2, dtype=np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _rows_of(column: pa.Array, at: np.ndarray, dim: int) -> np.ndarray:
    """Rows ``at`` of a list column as a matrix; all have ``dim`` values."""
    column = column.take(pa.array(at))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(x.ravel(), kind))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest of n nodes that edges (a, b) reach, for each node."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


LINKED = pa.schema([("class", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
PLACED = ("group", "class", "weight", "label", "v", "table", "half", "split")


def _near(group: np.ndarray, unit: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (a < b) at the cosine or more within runs of equal group: small runs many at a time, a large run by blocks of rows."""
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(start, len(group)))
    for n in range(2, SMALL + 1):
        left, right = np.triu_indices(n, 1)
        at, step = start[size == n], max(1, PAIRS // len(left))
        for k in range(0, len(at), step):
            a, b = (at[k : k + step, None] + left).ravel(), (at[k : k + step, None] + right).ravel()
            near = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
            yield a[near], b[near]
    for s, n in zip(start[size > SMALL], size[size > SMALL]):
        step = max(1, 16 * PAIRS // n)
        for k in range(s, s + n, step):
            a, b = np.nonzero(unit[k : min(k + step, s + n)] @ unit[s : s + n].T >= cosine)
            a, b = a + k, b + s
            yield a[a < b], b[a < b]


def _compare(rows: pa.RecordBatch, cosine: float, shape: dict[int, tuple[int, int]]) -> pa.RecordBatch | None:
    """Links (class, links, root) of whole groups, each pair in the first table that brings it together, within one label and dimension only.

    Keys are computed again for the vectors of near pairs, which costs less than moving them with every copy.
    """
    column = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in ("group", "class", "weight", "table", "half", "split")}
    label = rows.column("label").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    dims = rows.column("v").value_lengths().to_numpy(zero_copy_only=False)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        unit = _unit(_rows_of(rows.column("v"), at, int(dim)))
        near = list(_near(column["group"][at], unit, cosine))
        paired = np.zeros(len(at), bool)
        for ends in near:
            for end in ends:
                paired[end] = True
        if not paired.any():
            continue
        sig = np.zeros((len(at), shape[int(dim)][1]), np.int32)
        sig[paired] = _keys(unit[paired], *shape[int(dim)])
        for a, b in near:
            for k in range(0, len(a), PAIRS):
                x, y = a[k : k + PAIRS], b[k : k + PAIRS]
                i, j = at[x], at[y]
                ok = (label[i] == label[j]) & ~(column["split"][i] & (column["half"][i] == column["half"][j])) & (column["class"][i] != column["class"][j])
                ok &= (sig[x] == sig[y]).argmax(axis=1) == column["table"][i]
                found.append((i[ok], j[ok]))
    if not sum(len(a) for a, _ in found):
        return None
    a, b = (np.concatenate(x) for x in zip(*found))
    ids, inner = np.unique(column["class"], return_inverse=True)
    links = np.bincount(inner[a], column["weight"][b], len(ids)) + np.bincount(inner[b], column["weight"][a], len(ids))
    root = ids[_roots(inner[a], inner[b], len(ids))]
    hit = np.flatnonzero(links)
    return table(LINKED, [pa.array(ids[hit]), pa.array(links[hit].astype(np.int64)), pa.array(root[hit])])


def _grouped(batches: Iterator[pa.RecordBatch], cosine: float, shape: dict[int, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Compare runs of rows with one group key, many groups at once; a run may go on in the next batch."""
    held: list[pa.RecordBatch] = []

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(x.num_rows for x in held) >= GATHERED:
            rows = whole()
            group = rows.column("group").to_numpy()
            last = len(group) - int(np.argmax(group[::-1] != group[-1])) if group[0] != group[-1] else 0
            held = [rows.slice(last)]
            if last and (out := _compare(rows.slice(0, last), cosine, shape)):
                yield out
    if held and (out := _compare(whole(), cosine, shape)):
        yield out


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Link vectors (vec_id, embedding, label) of equal labels and dimension: vec_id, n_links, component_id, kept.

    Vectors that are null, zero, empty or hold null or non-finite components,
    and those without a label, link with nothing. Identical vectors are one
    class from the start, whose members link among themselves, so a vector that
    a third of all rows share costs as much as any other. Rows of equal vec_id
    count as different vectors. Bucket keys are counted in narrow rows first, so
    vectors, in the type they came in, travel only to buckets that hold several.
    """
    spark = vectors.sparkSession
    arrow_batches(spark)
    wide = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.col("label").cast("string").alias("label"))
    kind = wide.schema["v"].dataType.elementType.simpleString()
    if kind not in ("float", "double"):
        kind, wide = "double", wide.withColumn("v", F.col("v").cast("array<double>"))
    usable = (
        F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    key = [F.when(F.coalesce(usable, F.lit(False)), F.xxhash64(F.lit(k), F.size("v"), "label", F.transform("v", lambda x: x + F.lit(0.0).cast(kind)))).alias(f"k{k}") for k in (1, 2)]
    keyed = save(wide.select("vec_id", "label", "v", *key))
    classes = save(
        keyed.filter(F.col("k1").isNotNull()).groupBy("k1", "k2", "label", F.size("v").alias("dim"))
        .agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("first"), F.first("v").alias("v"))
        .withColumn("class", F.xxhash64("k1", "k2"))
    )
    sizes = classes.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("n")).collect()
    shape = {r["dim"]: design(r["n"], r["dim"], cosine) for r in sizes}
    hashed_schema = pa.schema([("class", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("sig", pa.list_(pa.int32()))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                take, unit = pa.array(at), _unit(_rows_of(batch.column("v"), at, int(dim)))
                yield table(hashed_schema, [*(batch.column(c).take(take) for c in ("class", "label")), np.full(len(at), dim, np.int32), _lists(_keys(unit, *shape[int(dim)]), pa.int32())])

    signed = save(classes.select("class", "label", "v").mapInArrow(hashed, "class long, label string, dim int, sig array<int>"))
    bucketed = signed.select("class", "dim", "label", F.posexplode("sig").alias("table", "key")).select("class", "table", F.xxhash64("label", "dim", "table", "key").alias("bucket"))
    filled = save(bucketed.groupBy("bucket").count().filter("count > 1").select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))
    placed = (
        bucketed.join(filled, "bucket").withColumn("block", F.pmod(F.xxhash64("class", "table"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("class", "table", (F.col("block") > F.col("other")).alias("half"), (F.col("block") != F.col("other")).alias("split"),
                F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other"))).alias("group"))
    )
    found = save(
        placed.join(classes.select("class", "weight", "label", "v"), "class").select(*PLACED).repartition("group").sortWithinPartitions("group")
        .mapInArrow(lambda batches: _grouped(batches, cosine, shape), "class long, links long, root long")
    )
    counted = found.groupBy("class").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "class")
    named = save(
        classes.select("k1", "k2", "class", "weight", "first").join(counted, "class", "left").join(joined, "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
    )
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    final = save(named.join(smallest, "component").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"))
    component = F.coalesce("component_id", "vec_id")
    return keyed.select("vec_id", "k1", "k2").join(final, ["k1", "k2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_OP5 = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a AS node, a AS reach FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.component_id, v.vec_id)::BIGINT AS component_id, v.vec_id = coalesce(c.component_id, v.vec_id) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.node = v.vec_id
"""
