"""Verdicts on a stream of scores, counted by time and site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthospark.operators.evaluate import apply_thresholds


def verdict_counts(scores: DataFrame, thresholds: DataFrame, at: str, every: str, late: str, by: str = "clsname") -> DataFrame:
    """Counts of verdicts in each window of ``every`` and for each site, of a stream of scores under static thresholds; scores that
    come more than ``late`` behind the newest aren't waited for, so what is held doesn't grow with the stream."""
    judged = apply_thresholds(scores.withWatermark(at, late), thresholds)
    counts = judged.groupBy(F.window(at, every), by).agg(*[F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}") for v in ("below", "Normal", "above")])
    return counts.select(F.col("window.start").alias("since"), by, "n_below", "n_normal", "n_above")
