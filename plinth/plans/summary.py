"""Summaries of measured runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summarise(runs: DataFrame, base: str) -> DataFrame:
    """runs: (scenario, seconds). Mean, median, least and most, and how many times as fast as ``base``."""
    own = runs.groupBy("scenario").agg(F.avg("seconds").alias("mean"), F.median("seconds").alias("median"), F.min("seconds").alias("min"), F.max("seconds").alias("max"))
    whole = runs.where(F.col("scenario") == base).agg(F.avg("seconds").alias("base"))  # one row
    out = own.crossJoin(F.broadcast(whole))
    return out.select("scenario", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "min", "max", F.round(F.col("base") / F.col("mean"), 6).alias("speed_up"))
