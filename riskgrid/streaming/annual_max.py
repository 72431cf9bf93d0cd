"""Incremental yearly maxima over a file stream: the streaming form of the gust reduction.

The table at the sink is a base and deltas: every trigger writes only the keys
that it changed, and a reader takes the maximum over all. A maximum can be taken
again, so a delta that is read beside the base that already holds it does no
harm, and neither do late, repeated or half-deleted files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deltas after which they are folded into a new base.
DELTAS = 16


def annual_max(stream: DataFrame, cell: tuple[str, ...] = ("cell",)) -> DataFrame:
    """Largest value of each cell and year; works on a streaming or a batch table.

    A maximum is mergeable, so late or repeated files leave the result right.
    """
    return stream.groupBy(*cell, "year").agg(F.max("value").alias("top"))


def _names(spark: SparkSession, sink: str, kind: str) -> dict[int, str]:
    """Finished tables of a kind below the sink by number."""
    top = spark._jvm.org.apache.hadoop.fs.Path(sink)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(top):
        return {}
    paths = [x.getPath() for x in files.listStatus(top)]
    done = lambda p: files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return {int(p.getName().split("-")[1]): p.toString() for p in paths if p.getName().startswith(f"{kind}-") and done(p)}


def read(spark: SparkSession, sink: str, cell: tuple[str, ...] = ("cell",)) -> DataFrame:
    """The maxima: the newest base and all deltas, merged by maximum."""
    bases, deltas = _names(spark, sink, "base"), _names(spark, sink, "delta")
    found = [bases[max(bases)]] if bases else []
    return spark.read.parquet(*found, *deltas.values()).groupBy(*cell, "year").agg(F.max("top").alias("top"))


def compact(spark: SparkSession, sink: str, cell: tuple[str, ...] = ("cell",)) -> None:
    """Fold base and deltas into a new base, then delete what it replaces."""
    old, deltas = _names(spark, sink, "base"), _names(spark, sink, "delta")
    if not deltas:
        return
    number = max(deltas)
    read(spark, sink, cell).write.mode("overwrite").parquet(f"{sink}/base-{number:09d}")
    for path in (*deltas.values(), *(p for n, p in old.items() if n != number)):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def fold(spark: SparkSession, folder: str, schema: str, sink: str, checkpoint: str, cell: tuple[str, ...] = ("cell",), deltas: int = DELTAS, files: int | None = None) -> DataFrame:
    """Fold all parquet files that are new in ``folder`` (``files`` a trigger; all at once if None) into the table at ``sink`` and return it.

    The running maxima are keyed state, and a trigger writes only the keys that
    its files touch. A trigger that runs again overwrites its own delta. After
    ``deltas`` of them the table is compacted.
    """
    source = spark.readStream.schema(schema)
    stream = (source.option("maxFilesPerTrigger", files) if files else source).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/delta-{number:09d}")
        if len(_names(spark, sink, "delta")) >= deltas:
            compact(spark, sink, cell)

    run = annual_max(stream, cell).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return read(spark, sink, cell)
