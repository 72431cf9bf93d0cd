"""Shared pieces of the training-data operators: tables in shared storage, Arrow batches, components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Rows in an Arrow batch: bounds a Python worker's memory where texts are long.
BATCH_ROWS = 400


#: Applications whose workers have the package.
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's sources to the application's Python workers, once, whatever their working folder."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parents[1]
        packed = Path(tempfile.mkdtemp(prefix="spark-")) / f"{top.name}.zip"
        with zipfile.ZipFile(packed, "w") as file:
            for source in sorted(top.rglob("*.py")):
                file.write(source, source.relative_to(top.parent))
        sc.addPyFile(str(packed))
        _SHIPPED.add(sc.applicationId)


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Prepare a session for Arrow batches of whole texts: workers that know the package, and at most ``rows`` rows a batch.

    The session's own bound is only ever lowered, to the same value by every
    operator, since plans are lazy and take the bound that holds when they run.
    """
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= rows:
        spark.conf.set(key, str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where it is unset and all runs on one machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


#: Tables by path with what deletes them: those of the application, then those of the open scopes.
_SCOPES: list[dict] = [{}]


def _deleter(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    return lambda: at.getFileSystem(conf).delete(at, True)


@contextlib.contextmanager
def temporary() -> Iterator[None]:
    """A scope whose saved tables are deleted at its end; what reads them must be written by then."""
    made: dict = {}
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for remove in made.values():
            remove()


@atexit.register
def _clear() -> None:
    """Delete the tables of results that were never written, when the driver ends; a gateway that is gone keeps its own."""
    for remove in _SCOPES[0].values():
        with contextlib.suppress(Exception):
            remove()


def stored(df: DataFrame, name: str = "table", codec: str | None = None, outer: bool = False) -> DataFrame:
    """Write ``df`` to shared storage and read it back: cuts lineage and survives lost executors.

    The table is deleted with the innermost scope (``outer``: the one around
    it), or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    _SCOPES[-2 if outer else -1][path] = _deleter(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def save(df: DataFrame) -> DataFrame:
    """A table between steps."""
    return stored(df, codec="zstd")


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` that nothing will read again; other tables stay."""
    names = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
    for scope in _SCOPES:
        for path in [p for p in scope if p.rsplit("/", 1)[1] in names]:
            scope.pop(path)()


def numbered(df: DataFrame, *order: str, size: str | None = None) -> DataFrame:
    """Rows in a total order: ``_at`` (place from 0), ``_before`` (sum of ``size`` over all rows before) and ``_part`` (range of the order).

    The table is written first, so that file and row number settle ties: rows
    are dealt to ranges of a key that no two share, whatever repeats. Each range
    counts its own rows and one offset a range is added, so no task holds a
    group. Null keys come first, a null size counts as zero.
    """
    spark = df.sparkSession
    ship_package(spark)
    first = save(df)
    keys = [*order, "_file", "_row"]
    named = first.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    ranged = named.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_file", "_row")

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, before = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.num_rows
            sizes = np.array(batch.column(size).fill_null(0), np.int64) if size else np.zeros(n, np.int64)
            sums = before + np.cumsum(sizes)
            more = [np.full(n, part), np.arange(at, at + n), sums - sizes]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in more)], names=[*batch.schema.names, "_part", "_at", "_before"])
            at, before = at + n, int(sums[-1]) if n else before

    schema = StructType([*df.schema.fields, *(StructField(c, LongType()) for c in ("_part", "_at", "_before"))])
    counted = save(ranged.mapInArrow(running, schema))
    drop(first)
    last = F.max(F.col("_before") + (F.coalesce(size, F.lit(0)) if size else F.lit(0)))
    offsets, at, before = [], 0, 0
    for part, n, total in sorted(map(tuple, counted.groupBy("_part").agg(F.count(F.lit(1)), last).collect())):
        offsets.append((part, at, before))
        at, before = at + n, before + total
    table_of = F.broadcast(spark.createDataFrame(offsets, "_part long, _rows long, _sizes long"))
    return counted.join(table_of, "_part").select(*df.columns, "_part", (F.col("_at") + F.col("_rows")).alias("_at"), (F.col("_before") + F.col("_sizes")).alias("_before"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A batch's texts, null as the empty text."""
    return [x or "" for x in batch.column(name).to_pylist()]


def table(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def whole_batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """Connected components of an undirected graph: (node, component), component the smallest node.

    Only nodes with an edge to another node are returned; self edges, repeated
    edges and nulls are ignored and an empty input gives an empty result.
    Alternates two star contractions (each node hands its larger, then its
    smaller neighbours to its smallest one), which needs about log(n) rounds.
    Minima are partially aggregated before the shuffle, and they are written
    before each join so that both join sides are plain exchanges, whose large
    partitions adaptive execution can split.
    """
    state = save(
        edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .filter(F.col("u") > F.col("v")).distinct()
    )

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    def handed(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        least = save(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        return pairs.join(least, "u"), least

    def kept_edges(df: DataFrame, *old: DataFrame) -> DataFrame:
        kept = save(df.filter(F.col("u") > F.col("v")).distinct())
        for x in old:
            drop(x)
        return kept

    before = mark(state)
    for _ in range(most if before[0] else 0):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        met, least = handed(both)
        state = kept_edges(met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")), state, least)
        met, least = handed(state)
        state = kept_edges(met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))), state, least)
        after = mark(state)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components: no fixed point after {most} rounds")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
