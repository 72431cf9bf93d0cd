"""Table sinks and sources in shared storage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names; a temporary one only where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return f"{sc.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


#: What deletes the tables that were made between steps.
_MADE: list = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clear() -> None:
    """Delete tables between steps when the driver ends; a session that is gone keeps its own."""
    for spark, path in _MADE:
        with contextlib.suppress(Exception):
            _delete(spark, path)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to shared storage and read back: computed once, the same for all that read it, and safe from lost executors. Deleted when the driver ends."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    _MADE.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


#: Folders that a layer's tiles share, whatever its size.
TILE_FOLDERS = 64


def tile_folder() -> Column:
    """The folder (0 to TILE_FOLDERS - 1) of a tile, from its row and column."""
    return F.pmod(F.hash("tile_row", "tile_col"), F.lit(TILE_FOLDERS))


def write_tiled(cells: DataFrame, path: str, tile: int = 256, by: tuple[str, ...] = ("term", "scenario", "model")) -> str:
    """Layers (row, col and ``by``) in folders a layer and group of tiles, in the order of their tiles, so that a sample reads only the folders it needs.

    A layer has at most TILE_FOLDERS folders: files grow with the layer, their number doesn't.
    """
    tiled = cells.withColumns({"tile_row": F.floor(F.col("row") / tile).cast("int"), "tile_col": F.floor(F.col("col") / tile).cast("int")}).withColumn("tile_folder", tile_folder())
    keys = [*by, "tile_folder"]
    tiled.repartition(*keys).sortWithinPartitions(*keys, "tile_row", "tile_col", "row", "col").write.partitionBy(*keys).parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header and quotes doubled; nulls are empty fields."""
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)


def write_json(df: DataFrame, path: str) -> str:
    """One JSON object a row; nested results stay structs."""
    df.write.json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_partitioned(df: DataFrame, path: str, *by: str) -> str:
    """Parquet in a folder a value of ``by``, so filters on these columns prune files."""
    df.write.partitionBy(*by).parquet(path)
    return path
