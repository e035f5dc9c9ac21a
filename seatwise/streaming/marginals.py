"""Incremental counts and moments of a stream of candidates; rankings stay in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counts(stream: DataFrame, col: str) -> DataFrame:
    """Counts by category, null included; for output modes update and complete."""
    return stream.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def running_moments(stream: DataFrame, col: str, by: str) -> DataFrame:
    """Count, mean and sample deviation by group."""
    return stream.groupBy(by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"))
