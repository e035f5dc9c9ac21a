"""Mergeable descriptives: each is one partial and final aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import STUDY, Contrast
from ..functions.columns import all_of, ratio
from .cascade import PRESENCE, SCORES


def completion_rates(df: DataFrame) -> DataFrame:
    """Of each group after the first two steps: how many were present throughout."""
    done = all_of([F.col(p) == 1 for p in PRESENCE])
    out = df.groupBy("grp").agg(F.count(F.lit(1)).alias("n_denominator"), F.count_if(done).alias("n_numerator"))
    return out.withColumn("value", F.round(100 * ratio(F.col("n_numerator"), F.col("n_denominator")), 6))


def subject_gaps(df: DataFrame, cols: Sequence[str] = SCORES, contrast: Contrast = STUDY.contrast) -> DataFrame:
    """Mean gap of the contrast in each column, also in units of the overall sample deviation."""
    long = df.select("grp", F.inline(F.array(*[F.struct(F.lit(c).alias("subject"), F.col(c).alias("v")) for c in cols])))
    a, b = F.col("grp").isin(*contrast.a), F.col("grp").isin(*contrast.b)
    out = long.groupBy("subject").agg(F.avg(F.when(a, F.col("v"))).alias("a"), F.avg(F.when(b, F.col("v"))).alias("b"), F.stddev_samp("v").alias("sd"))
    return out.select("subject", F.round(F.col("a") - F.col("b"), 6).alias("gap"), F.round(ratio(F.col("a") - F.col("b"), F.col("sd")), 6).alias("gap_sd"))


def by_group(df: DataFrame, col: str) -> DataFrame:
    out = df.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(col), 6).alias("mean"), F.round(F.stddev_samp(col), 6).alias("sd"))
    return out


def pool_shares(df: DataFrame, selected: str = "selected") -> DataFrame:
    """Each group's share of the eligible pool and of the selected."""
    w = Window.partitionBy()  # one row a group
    out = df.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(selected).alias("n_selected"))
    return out.withColumn("eligible_pool_share_pct", F.round(100 * F.col("n") / F.sum("n").over(w), 6)).withColumn("selected_share_pct", F.round(100 * ratio(F.col("n_selected"), F.sum("n_selected").over(w)), 6))


def marginals(df: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Shares of every category of several columns in one pass; null is a category."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("category")) for c in categorical])))
    out = long.groupBy("variable", "category").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("variable")), 6))


def compare_marginals(full: DataFrame, sample: DataFrame, categorical: Sequence[str]) -> DataFrame:
    """Shares of a full table and of a sample side by side; a category of one side alone has 0 on the other."""
    a = marginals(full, categorical).select("variable", "category", F.col("pct").alias("full_value"))
    b = marginals(sample, categorical).select(F.col("variable").alias("_v"), F.col("category").alias("_c"), F.col("pct").alias("sample_value"))
    both = a.join(b, F.col("variable").eqNullSafe(F.col("_v")) & F.col("category").eqNullSafe(F.col("_c")), "full_outer")
    x, y = F.coalesce("full_value", F.lit(0.0)), F.coalesce("sample_value", F.lit(0.0))
    return both.select(F.coalesce("variable", "_v").alias("variable"), F.coalesce("category", "_c").alias("category"), x.alias("full_value"), y.alias("sample_value"), F.round(F.abs(x - y), 6).alias("abs_diff"))


def compare_moments(full: DataFrame, sample: DataFrame, continuous: Sequence[str]) -> DataFrame:
    """Mean and sample deviation of several columns of a full table and of a sample side by side, nulls left out."""

    def moments(df: DataFrame, out: str) -> DataFrame:
        aggs = [f(c).alias(f"{n}_{c}") for c in continuous for n, f in (("mean", F.avg), ("sd", F.stddev_samp))]
        cells = [F.struct(F.lit(c).alias("variable"), F.lit(n).alias("category"), F.round(f"{n}_{c}", 6).alias(out)) for c in continuous for n in ("mean", "sd")]
        return df.agg(*aggs).select(F.inline(F.array(*cells)))

    both = moments(full, "full_value").join(moments(sample, "sample_value"), ["variable", "category"])
    return both.withColumn("abs_diff", F.round(F.abs(F.col("full_value") - F.col("sample_value")), 6))


def sentinel_share(col: Column, code: str | int) -> Column:
    """The share equal to a sentinel, in percent of all rows."""
    return F.round(100 * F.avg(F.coalesce(col == code, F.lit(False)).cast("double")), 6)


def small_groups(df: DataFrame, key: str, floor: int) -> DataFrame:
    """Number of groups, of groups below a floor, and the least size."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n") < floor).alias("n_below"), F.min("n").alias("least"))
