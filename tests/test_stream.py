"""The incremental fold equals the batch reduction, whatever the files' order and repetition."""

from riskgrid.sources import sinks
from riskgrid.streaming import annual_max


def test_fold_equals_batch(spark):
    top = sinks.scratch(spark)
    rows = [(k % 3, 2000 + k % 4, float((k * 37) % 101)) for k in range(200)]
    df = spark.createDataFrame(rows, "cell long, year long, value double")
    want = sorted(tuple(r) for r in annual_max.annual_max(df).collect())
    df.filter("value < 60").write.parquet(f"{top}/feed")
    args = (spark, f"{top}/feed", "cell long, year long, value double", f"{top}/state", f"{top}/progress")
    annual_max.fold(*args)
    df.write.mode("append").parquet(f"{top}/feed")
    df.filter("value > 50").write.mode("append").parquet(f"{top}/feed")
    assert sorted(tuple(r) for r in annual_max.fold(*args).select("cell", "year", "top").collect()) == want
