"""Metrics of a selection against a benchmark, as aggregates over a ledger of decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import STUDY, Contrast
from ..functions.columns import percent, quota, ratio
from .selection import RANGES


def selection_table(df: DataFrame, by: Sequence[str], selected: str = "selected", contrast: Contrast = STUDY.contrast) -> DataFrame:
    """Rates in percent of both sides of a contrast, gap and ratio."""
    a, b = F.col("grp").isin(*contrast.a), F.col("grp").isin(*contrast.b)
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(selected).alias("n_selected"), percent(F.col(selected), a).alias("rate_a_pct"), percent(F.col(selected), b).alias("rate_b_pct"))
    return out.withColumn("gap_pp", F.col("rate_a_pct") - F.col("rate_b_pct")).withColumn("ratio", ratio(F.col("rate_a_pct"), F.col("rate_b_pct")))


def selection_at(ranked: DataFrame, rank: Column, n: Column, capacities: Sequence[float], contrast: Contrast = STUDY.contrast) -> DataFrame:
    """``selection_table`` at several capacities from one ranking, in one aggregate; a row a capacity."""
    a, b = F.col("grp").isin(*contrast.a), F.col("grp").isin(*contrast.b)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, k in enumerate(capacities):
        chosen = rank <= quota(k, n)
        aggs += [F.count_if(chosen).alias(f"_c{i}"), percent(chosen, a).alias(f"_a{i}"), percent(chosen, b).alias(f"_b{i}")]
    cells = F.array(*[F.struct(F.lit(float(k)).alias("k"), F.col(f"_c{i}").alias("n_selected"), F.col(f"_a{i}").alias("rate_a_pct"), F.col(f"_b{i}").alias("rate_b_pct")) for i, k in enumerate(capacities)])
    out = ranked.agg(*aggs).select("n", F.inline(cells))
    return out.select("k", "n", "n_selected", "rate_a_pct", "rate_b_pct", (F.col("rate_a_pct") - F.col("rate_b_pct")).alias("gap_pp"), ratio(F.col("rate_a_pct"), F.col("rate_b_pct")).alias("ratio"))


def group_metrics(ledger: DataFrame, by: Sequence[str], side: Column | None = None, contrast: Contrast = STUDY.contrast) -> DataFrame:
    """The fourteen measures of a contrast for model and benchmark, one row a cell."""
    side = side if side is not None else F.when(F.col("grp").isin(*contrast.a), "A").when(F.col("grp").isin(*contrast.b), "B")
    df = ledger.withColumn("_side", side)
    a, b, m, s = F.col("_side") == "A", F.col("_side") == "B", F.col("model_selected"), F.col("bench_selected")
    out = df.groupBy(*by).agg(
        F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"),
        percent(m, a).alias("rate_a_pct"), percent(m, b).alias("rate_b_pct"), percent(s, a).alias("bench_rate_a_pct"), percent(s, b).alias("bench_rate_b_pct"),
        F.count_if(a & m).alias("n_model_positive_a"), F.count_if(b & m).alias("n_model_positive_b"), F.count_if(a & s).alias("n_bench_positive_a"), F.count_if(b & s).alias("n_bench_positive_b"),
    )
    out = out.withColumn("gap_pp", F.col("rate_a_pct") - F.col("rate_b_pct")).withColumn("ratio", ratio(F.col("rate_a_pct"), F.col("rate_b_pct")))
    return out.withColumn("bench_gap_pp", F.col("bench_rate_a_pct") - F.col("bench_rate_b_pct")).withColumn("d_pp", F.col("gap_pp") - F.col("bench_gap_pp"))


def agreement(ledger: DataFrame, by: Sequence[str], seats: Column | None = None) -> DataFrame:
    """Overlap at the quota (``seats``, by default the benchmark's) and Jaccard index."""
    m, s = F.col("model_selected"), F.col("bench_selected")
    quota = F.count_if(s) if seats is None else F.max(seats)
    return ledger.groupBy(*by).agg(F.count_if(m).alias("n_selected"), ratio(F.count_if(m & s), quota).alias("overlap_at_k"), ratio(F.count_if(m & s), F.count_if(m | s)).alias("jaccard"))


def side_errors(ledger: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of both sides of ``ledger (side, …)`` the rates of selection, reallocation and errors, and the gap of true positives."""
    m, s = F.col("model_selected"), F.col("bench_selected")
    aggs = []
    for x in "ab":
        on = F.col("side") == x.upper()
        aggs += [F.avg(F.when(on, s.cast("double"))).alias(f"p_{x}"), F.avg(F.when(on, m.cast("double"))).alias(f"q_{x}")]
        aggs += [ratio(F.count_if(on & m & ~s), F.count_if(on & ~s)).alias(f"fpr_{x}"), ratio(F.count_if(on & ~m & s), F.count_if(on & s)).alias(f"fnr_{x}")]
    out = ledger.groupBy(*by).agg(*aggs)
    for x in "ab":
        out = out.withColumn(f"net_realloc_{x}", F.col(f"q_{x}") - F.col(f"p_{x}")).withColumn(f"tpr_{x}", 1 - F.col(f"fnr_{x}"))
    return out.withColumn("tpr_gap", F.col("tpr_a") - F.col("tpr_b"))


def greatest_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], col: str = "score") -> float:
    """The greatest absolute difference of a column between rows of equal keys; a row without a partner is an error."""
    other = b.select(*keys, F.col(col).alias("_other"))
    both = a.select(*keys, col).join(other, list(keys), "full_outer")
    r = both.agg(F.count_if(F.col(col).isNull() | F.col("_other").isNull()).alias("alone"), F.max(F.abs(F.col(col) - F.col("_other"))).alias("most")).first()
    if r.alone:
        raise ValueError(f"{r.alone} rows have no partner of the same {', '.join(keys)}")
    return r.most or 0.0


def confusion(ledger: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rates of errors, of selection and of net reallocation of each group."""
    m, s = F.col("model_selected"), F.col("bench_selected")
    out = ledger.groupBy(*by, "grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(m & ~s).alias("fp"), F.count_if(~m & s).alias("fn"), F.count_if(s).alias("pos"), F.count_if(~s).alias("neg"), F.avg(s.cast("double")).alias("p_g"), F.avg(m.cast("double")).alias("q_g"))
    return out.withColumn("fpr", ratio(F.col("fp"), F.col("neg"))).withColumn("fnr", ratio(F.col("fn"), F.col("pos"))).withColumn("tpr", 1 - F.col("fnr")).withColumn("net_realloc", F.col("q_g") - F.col("p_g"))


def zero_sum(ledger: DataFrame, by: Sequence[str]) -> DataFrame:
    """The sum of n_g (q_g - p_g), which is 0 when both rules have the same quota."""
    parts = ledger.groupBy(*by, "grp").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("model_selected").cast("double")).alias("q"), F.avg(F.col("bench_selected").cast("double")).alias("p"))
    return parts.groupBy(*by).agg(F.sum(F.col("n") * (F.col("q") - F.col("p"))).alias("zero_sum_value")).withColumn("balanced", F.abs("zero_sum_value") < 0.5)


def _by_score(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    return scored.groupBy(*by, "score").agg(F.count_if("label").alias("pos"), F.count_if(~F.col("label")).alias("neg"))


def average_precision(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """The step-wise area: recall gained at each distinct score times the precision there."""
    steps = _cumulated(_by_score(scored, by), by)
    return steps.groupBy(*by).agg(F.sum(ratio(F.col("pos"), F.col("_p")) * ratio(F.col("_tp"), F.col("_tp") + F.col("_fp"))).alias("pr_auc"))


def roc_auc(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """The share of pairs in order, ties counting half; null with one class."""
    steps = _cumulated(_by_score(scored, by), by)
    return steps.groupBy(*by).agg(ratio(F.sum(F.col("pos") * (F.col("_m") - F.col("_fp") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def _cumulated(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """``steps (by, score, pos, neg)`` with ``_tp, _fp``, both summed over scores at least as good, and ``_p, _m``, over all.

    Scores are summed within ranges of their distinct values, and the ranges' sums, some
    hundred a cell, are summed apart.
    """
    cuts = steps.groupBy(*by).agg(F.percentile_approx("score", [i / RANGES for i in range(1, RANGES)], 10_000).alias("_cuts"))
    ranged = steps.join(F.broadcast(cuts), list(by)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c > F.col("score")))).drop("_cuts")
    own = Window.partitionBy(*by)
    sums = ranged.groupBy(*by, "_range").agg(F.sum("pos").alias("_rp"), F.sum("neg").alias("_rn"))
    line = own.orderBy("_range")
    sums = sums.select(*by, "_range", *[(F.sum(c).over(line) - F.col(c)).alias(f"_b{c}") for c in ("_rp", "_rn")], F.sum("_rp").over(own).alias("_p"), F.sum("_rn").over(own).alias("_m"))
    down = Window.partitionBy(*by, "_range").orderBy(F.col("score").desc())
    inside = ranged.withColumn("_ip", F.sum("pos").over(down)).withColumn("_in", F.sum("neg").over(down))
    both = inside.join(F.broadcast(sums), [*by, "_range"])
    return both.withColumn("_tp", F.col("_b_rp") + F.col("_ip")).withColumn("_fp", F.col("_b_rn") + F.col("_in")).drop("_b_rp", "_b_rn", "_ip", "_in", "_range")
