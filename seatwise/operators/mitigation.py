"""Reweighing and capacity-preserving equal-opportunity thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import ratio
from ..sources.tables import cut
from .selection import rank_within

LEVELS = 11
#: Ranks of one part of a side.
RANK_PART = 4096


def reweighing(df: DataFrame, group: str = "grp", label: str = "label") -> DataFrame:
    """``df`` with ``weight`` = P(g) P(y) / P(g, y); the weights average to 1."""
    cells = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("_gy"))
    w = Window.partitionBy
    cells = cells.withColumn("weight", F.sum("_gy").over(w(group)) * F.sum("_gy").over(w(label)) / (F.sum("_gy").over(w()) * F.col("_gy")))
    small = cells.select(F.col(group).alias("_g"), F.col(label).alias("_y"), "weight")  # one row a group and label
    return df.join(F.broadcast(small), F.col(group).eqNullSafe(F.col("_g")) & F.col(label).eqNullSafe(F.col("_y"))).drop("_g", "_y")


def cumulative_tpr(df: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """``rk, tpr, boundary`` of each side: the rate of true positives if its ``rk`` best are selected.

    Hits are summed within ranges of ranks, and the ranges' sums apart, so no task holds a side.
    """
    keys = [*by, "side"]
    ranked = rank_within(df.where(F.col("side").isNotNull()), score, keys).withColumn("_hit", F.col("bench_selected").cast("int")).withColumn("_part", F.expr(f"rk div {RANK_PART}"))
    own = Window.partitionBy(*keys)
    sums = ranked.groupBy(*keys, "_part").agg(F.sum("_hit").alias("_hits"))
    sums = sums.select(*keys, "_part", (F.sum("_hits").over(own.orderBy("_part")) - F.col("_hits")).alias("_before"), F.sum("_hits").over(own).alias("_all"))
    line = Window.partitionBy(*keys, "_part").orderBy("rk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranked.withColumn("_inside", F.sum("_hit").over(line))
    both = inside.join(sums, [*keys, "_part"])
    return both.select(*keys, F.col("rk").cast("int").alias("rk"), F.round(ratio(F.col("_before") + F.col("_inside"), F.col("_all")), 9).alias("tpr"), F.col(score).alias("boundary"))


def search_split(df: DataFrame, by: Sequence[str], seats: Column, targets: DataFrame, part: int = RANK_PART) -> DataFrame:
    """For each target the split whose gap, A's rate less B's, is nearest; of equals the one with fewest seats for A.

    ``df`` has a column for ``seats`` per cell, ``targets`` the cell columns, ``level`` and ``target``:
    LEVELS rows a cell at most. No seat on a side has the rate 0 and an infinite threshold, a whole
    side that of minus infinity.

    Both sides' ranks are cut into parts of ``part`` (2 or more), whose rates at both ends bound the
    gap of all splits between. Ranks are looked at only where a split can be nearest, in some parts a
    target, however large the sides are.
    """
    keys = [*by, "side"]
    rows = rank_within(df.where(F.col("side").isNotNull()), "score", keys)
    ranked = rows.select(*keys, F.col("rk").cast("long").alias("rk"), F.col("bench_selected").cast("int").alias("_hit"), F.expr(f"rk div {part}").alias("_part"), F.col("score").alias("boundary"))
    opened = cut(_near_targets(_rate_ends(ranked, keys), df.groupBy(*by).agg(F.max(seats).cast("long").alias("seats")), targets, by, part))
    wanted = [opened.select(*by, F.lit(x.upper()).alias("side"), F.col(f"_part_{x}").alias("_part"), *[F.col(f"{c}_{x}").alias(c) for c in _ENDS[:3]]) for x in "ab"]
    wanted = wanted[0].unionByName(wanted[1]).distinct()
    line = Window.partitionBy(*keys, "_part").orderBy("rk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rates = ranked.join(F.broadcast(wanted), [*keys, "_part"]).withColumn("_inside", F.sum("_hit").over(line))
    last = F.when(F.col("rk") == F.col("_size"), F.lit(float("-inf"))).otherwise(F.col("boundary"))
    rates = rates.select(*keys, "_part", "rk", F.round(ratio(F.col("_before") + F.coalesce("_inside", F.lit(0)), F.col("_all")), 9).alias("tpr"), last.alias("boundary"))
    rates = rates.unionByName(wanted.where("_part = 0").select(*keys, "_part", F.lit(0).cast("long").alias("rk"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("boundary")))
    a = rates.where("side = 'A'").select(*by, F.col("_part").alias("_part_a"), F.col("rk").alias("n_a"), F.col("tpr").alias("tpr_a"), F.col("boundary").alias("tau_a"))
    b = rates.where("side = 'B'").select(*by, F.col("_part").alias("_part_b"), F.col("rk").alias("n_b"), F.col("tpr").alias("tpr_b"), F.col("boundary").alias("tau_b"))
    ranges = opened.select(*by, "level", "target", "seats", "_part_a", "_part_b", "_first", "_last")
    options = a.join(F.broadcast(ranges), [*by, "_part_a"]).where("n_a BETWEEN _first AND _last").withColumn("n_b", F.col("seats") - F.col("n_a")).join(b, [*by, "_part_b", "n_b"])
    miss = F.round(F.abs(F.col("tpr_a") - F.col("tpr_b") - F.col("target")), 9)
    options = options.where("tpr_a IS NOT NULL AND tpr_b IS NOT NULL")
    best = options.groupBy(*by, "level", "target", "seats").agg(F.min(F.struct(miss.alias("miss"), "n_a", "n_b", "tpr_a", "tpr_b", "tau_a", "tau_b")).alias("x"))
    return best.select(*by, "level", "target", "seats", "x.n_a", "x.n_b", "x.tpr_a", "x.tpr_b", "x.tau_a", "x.tau_b")


#: Of a part of a side's ranks: hits before it, all hits, the side's size, ranks that have a rate, least and greatest rate.
_ENDS = ("_before", "_all", "_size", "_to", "_least", "_most")


def _rate_ends(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``_part`` and the columns of ``_ENDS`` of each side: a row for each part of ranks."""
    own = Window.partitionBy(*keys)
    parts = ranked.groupBy(*keys, "_part").agg(F.coalesce(F.sum("_hit"), F.lit(0)).alias("_hits"), F.count(F.lit(1)).alias("_rows"))
    parts = parts.withColumns({"_before": F.sum("_hits").over(own.orderBy("_part")) - F.col("_hits"), "_all": F.sum("_hits").over(own), "_size": F.sum("_rows").over(own)})
    ends = {c: F.round(F.coalesce(ratio(x, F.col("_all")), F.lit(0.0)), 9) for c, x in (("_least", F.col("_before")), ("_most", F.col("_before") + F.col("_hits")))}
    return parts.withColumns({"_to": F.when(F.col("_all") > 0, F.col("_size")).otherwise(0), **ends}).select(*keys, "_part", *_ENDS)


def _near_targets(ends: DataFrame, caps: DataFrame, targets: DataFrame, by: Sequence[str], part: int) -> DataFrame:
    """Pairs of parts, with A's ranks from ``_first`` to ``_last``, that can hold the split nearest to a target.

    A pair is left out if another's farthest split is nearer than its nearest one, or if the gap is
    the same all over it and it is not the first such pair.
    """
    a, b = (ends.where(F.col("side") == x.upper()).select(*by, *[F.col(c).alias(f"{c}_{x}") for c in ("_part", *_ENDS)]) for x in "ab")
    low = F.col("_part_a") * part
    reach = F.sequence(*[F.expr(f"(seats - _part_a * {part} - {n}) div {part}") for n in (part - 1, 0)])
    pairs = a.join(F.broadcast(caps), list(by)).withColumn("_part_b", F.explode(reach)).join(b, [*by, "_part_b"])
    other = F.col("_part_b") * part
    first = F.greatest(low, F.col("seats") - other - (part - 1), F.col("seats") - F.col("_to_b"))
    last = F.least(low + (part - 1), F.col("seats") - other, F.col("_to_a"))
    pairs = pairs.withColumns({"_first": first, "_last": last, "_down": F.col("_least_a") - F.col("_most_b"), "_up": F.col("_most_a") - F.col("_least_b")}).where("_first <= _last")
    near = F.round(F.greatest(F.lit(0.0), F.col("_down") - F.col("target"), F.col("target") - F.col("_up")), 9)
    far = F.round(F.greatest(F.abs(F.col("_down") - F.col("target")), F.abs(F.col("_up") - F.col("target"))), 9)
    cell = Window.partitionBy(*by, "level")
    options = pairs.join(F.broadcast(targets), list(by)).withColumns({"_best": F.min(far).over(cell), "_lead": F.min("_first").over(Window.partitionBy(*by, "level", "_down", "_up"))})
    return options.where((near <= F.col("_best")) & ((F.col("_down") < F.col("_up")) | (F.col("_first") == F.col("_lead")))).drop("_best", "_lead", "_down", "_up")


def target_gaps(led: DataFrame, by: Sequence[str]) -> DataFrame:
    """``level, target, gap0`` by cell: even steps from the gap of true positives of the decisions to none."""
    m, s = F.col("model_selected").cast("double"), F.col("bench_selected")
    gap = F.avg(F.when((F.col("side") == "A") & s, m)) - F.avg(F.when((F.col("side") == "B") & s, m))
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))
    out = led.groupBy(*by).agg(gap.alias("gap0")).select(*by, levels.alias("level"), "gap0")
    return out.withColumn("target", F.round(F.col("gap0") * (1 - F.col("level") / (LEVELS - 1)), 9))


def unmitigated(led: DataFrame, by: Sequence[str]) -> DataFrame:
    """The seats and rates of both sides as the decisions have them: level 0 of a sweep."""
    m, s = F.col("model_selected"), F.col("bench_selected")
    aggs = []
    for x in "ab":
        on = F.col("side") == x.upper()
        aggs += [F.count_if(on & m).alias(f"n_{x}"), F.round(ratio(F.count_if(on & m & s), F.count_if(on & s)), 9).alias(f"tpr_{x}")]
    return led.groupBy(*by).agg(*aggs)


def require_capacity(led: DataFrame, by: Sequence[str], seats: Column) -> DataFrame:
    """``led`` if every cell selects as many rows as ``seats`` says; anything else is an error."""
    wrong = led.groupBy(*by).agg(F.count_if("model_selected").alias("n"), F.max(seats).alias("seats")).where("n <> seats").collect()  # a row a cell
    if wrong:
        raise ValueError(f"cells select another number of rows than they have seats: {wrong}")
    return led


def transfer(found: DataFrame, val: DataFrame, test: DataFrame, by: Sequence[str]) -> DataFrame:
    """Seats on test at the validation rates: A's rounded half to even, B the rest, what does not fit back to A.

    ``val`` and ``test`` have the cell columns, ``size_a``, ``size_b``; ``test`` also ``seats``.
    """
    v = val.select(*by, F.col("size_a").alias("va"))
    t = test.select(*by, F.col("size_a").alias("ta"), F.col("size_b").alias("tb"), F.col("seats").alias("seats_test"))
    j = found.join(F.broadcast(v), list(by)).join(F.broadcast(t), list(by))
    want = F.greatest(F.lit(0), F.least(F.bround(F.col("n_a") / F.col("va") * F.col("ta")), F.col("ta"), F.col("seats_test"))).cast("long")
    j = j.withColumn("_a", want).withColumn("n_b_test", F.greatest(F.lit(0), F.least(F.col("seats_test") - F.col("_a"), F.col("tb"))).cast("long"))
    j = j.withColumn("n_a_test", F.least(F.col("ta"), F.col("seats_test") - F.col("n_b_test")).cast("long"))
    return j.drop("va", "ta", "tb", "_a")
