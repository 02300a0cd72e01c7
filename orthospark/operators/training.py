"""Comparing training runs from their logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_average(runs: DataFrame) -> DataFrame:
    """The mean of both areas; null unless both are there."""
    return runs.withColumn("average", (F.col("auroc_1") + F.col("auroc_2")) / 2)


def best_epoch(runs: DataFrame, value: str, *by: str) -> DataFrame:
    """The first epoch with the largest value."""
    best = F.max_by("epoch", F.struct(value, -F.col("epoch")))
    return runs.where(F.col(value).isNotNull()).groupBy(*by).agg(best.alias("epoch"), F.max(value).alias(value))


def run_limits(runs: DataFrame, columns: list[str], *by: str, pad: float = 0.05) -> DataFrame:
    """Least and largest of each column, 5 % of the range further out, within 0 and 1."""
    limits = []
    for c in columns:
        lo, hi = F.min(c), F.max(c)
        limits += [F.greatest(F.lit(0.0), lo - pad * (hi - lo)).alias(f"{c}_min"), F.least(F.lit(1.0), hi + pad * (hi - lo)).alias(f"{c}_max")]
    return runs.groupBy(*by).agg(*limits)


def weighted_mean(df: DataFrame, value: str, weight: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"))
