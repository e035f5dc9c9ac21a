"""Composite scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import row_mean, weighted
from .cascade import SCORES

#: Weights of the five scores (sciences, humanities, languages, mathematics, essay) by scheme.
SCHEMES: dict[str, tuple[float, ...]] = {
    "engineering": (0.15, 0.10, 0.15, 0.35, 0.25),
    "medicine": (0.35, 0.10, 0.20, 0.15, 0.20),
    "law": (0.10, 0.20, 0.25, 0.15, 0.30),
    "objective_only": (0.25, 0.25, 0.25, 0.25, 0.0),
}


def raw_equal() -> Column:
    return F.round(row_mean([F.col(s) for s in SCORES]), 6)


def weighted_scheme(name: str) -> Column:
    return F.round(weighted([F.col(s) for s in SCORES], SCHEMES[name]), 6)


def standardised(df: DataFrame, out: str = "composite_std") -> DataFrame:
    """The mean of the scores' z-scores over the whole population, by its sample deviations."""
    stats = df.agg(*[f(s).alias(f"_{n}_{s}") for s in SCORES for n, f in (("m", F.avg), ("d", F.stddev_samp))])
    z = [(F.col(s) - F.col(f"_m_{s}")) / F.col(f"_d_{s}") for s in SCORES]
    total = z[0]
    for x in z[1:]:
        total = total + x
    return df.crossJoin(F.broadcast(stats)).withColumn(out, F.round(total / 5, 6)).drop(*[c for c in stats.columns])
