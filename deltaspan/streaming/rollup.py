"""An extension: the paired roll-up over a stream of scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORES = "system string, category string, item long, clean double, noisy double, at timestamp"


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCORES).parquet(path)


def windowed_rollup(scores: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and means of each system and category by window; late rows beyond the watermark are left out."""
    w = scores.withWatermark("at", late).groupBy(F.window("at", width), "system", "category")
    out = w.agg(F.count("*").alias("n"), F.avg("noisy").alias("mean_noisy"), F.avg("clean").alias("mean_clean"), F.avg(F.col("clean") - F.col("noisy")).alias("mean_delta"))
    return out.select(F.col("window.start").alias("start"), "system", "category", "n", "mean_noisy", "mean_clean", "mean_delta")
