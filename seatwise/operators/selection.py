"""Exact-quota selections with seeded ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_key, quota
from ..sources.tables import cut

#: Ranges into which a group's distinct scores are cut to sum them.
RANGES = 200


def order_by_score(score: str, key: str = "id", tag: str = "tie") -> list[Column]:
    """Best first, ties by seeded hash, then by key."""
    return [F.col(score).desc_nulls_last(), hash_key(tag, key), F.col(key)]


def ranks(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str = "rk", total: str | None = None) -> DataFrame:
    """Ranks from 1 in ``order`` within the groups ``by`` (all rows without any), and with ``total`` the group's size.

    Rows move once, dealt by ranges of group and order, so that no task holds a whole group, and
    are saved with their place. A task's rows of a group then lack only the number of the group's
    rows in the tasks before, which comes from counts: a row a group and task, which is broadcast.
    Keys of ``by`` may be null.
    """
    line = [*(F.col(c) for c in by), *order]
    placed = df.repartitionByRange(*line).sortWithinPartitions(*line)
    saved = cut(placed.select("*", F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_place")))
    own = Window.partitionBy(*by)  # tasks of a group
    sizes = saved.groupBy(*by, "_task").agg(F.count(F.lit(1)).alias("_size"), F.min("_place").alias("_first"))
    start = F.col("_first") - (F.sum("_size").over(own.orderBy("_task")) - F.col("_size")) - 1
    names = {c: f"_by_{c}" for c in by}
    before = sizes.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("_task").alias("_of"), start.alias("_start"), *([F.sum("_size").over(own).alias(total)] if total else []))
    on = [F.col("_task") == F.col("_of"), *(F.col(c).eqNullSafe(F.col(n)) for c, n in names.items())]
    return saved.join(F.broadcast(before), on).withColumn(out, F.col("_place") - F.col("_start")).drop("_task", "_place", "_of", "_start", *names.values())


def rank_within(df: DataFrame, score: str, by: Sequence[str], out: str = "rk", total: str | None = None, seeded: bool = True) -> DataFrame:
    """Ranks by score, best first; ties by seeded hash, or by id if not ``seeded``."""
    return ranks(df, by, order_by_score(score) if seeded else [F.col(score).desc_nulls_last(), F.col("id")], out, total)


def top_within(df: DataFrame, score: str, capacity: float, by: Sequence[str], out: str = "selected") -> DataFrame:
    """The flag of the floor(capacity * n) best rows of each group."""
    ranked = rank_within(df, score, by, "_rk", "_n")
    return ranked.withColumn(out, F.col("_rk") <= quota(capacity, F.col("_n"))).drop("_rk", "_n")


def global_rank(df: DataFrame, score: str, out: str = "rk") -> DataFrame:
    """Ranks from 1 over all rows."""
    return rank_within(df, score, [], out)


def top_quota(df: DataFrame, score: str, capacity: float, out: str = "selected") -> DataFrame:
    """The flag of the floor(capacity * n) best of all rows."""
    return top_within(df, score, capacity, [], out)


def top_seats(df: DataFrame, score: str, seats: Column, by: Sequence[str], out: str = "selected", seeded: bool = True) -> DataFrame:
    """The flag of a given number of seats in each group, cut to 0 and the group's size; ties as in ``rank_within``."""
    ranked = rank_within(df, score, by, "_rk", "_n", seeded)
    return ranked.withColumn(out, F.col("_rk") <= F.greatest(F.lit(0), F.least(seats, F.col("_n")))).drop("_rk", "_n")


def tie_inclusive(df: DataFrame, score: str, capacity: float, by: Sequence[str], out: str = "selected") -> DataFrame:
    """The flag of every row that scores as well as the last seat; seats may exceed the quota."""
    info = tie_info(df, score, capacity, by).select(*by, F.col("boundary").alias("_boundary")).withColumnsRenamed({c: f"_by_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    both = df.join(F.broadcast(info), on, "left") if by else df.crossJoin(F.broadcast(info))
    return both.withColumn(out, F.coalesce(F.col(score) >= F.col("_boundary"), F.lit(False))).drop("_boundary", *[f"_by_{c}" for c in by])


def tie_info(df: DataFrame, score: str, capacity: float, by: Sequence[str] = ()) -> DataFrame:
    """The boundary of a selection: quota, value, rows above, tied, drawn among them, and seats of the tie-inclusive rule.

    Only counts by score are ordered. Without a seat the boundary is null and no row counts.
    """
    counts = df.groupBy(*by, F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = with_better(counts, by)
    n = F.sum("_c")
    known = F.col("_s").isNotNull()
    k = quota(capacity, F.col("n"))
    out = ranked.withColumn("_k", quota(capacity, F.col("_n")))
    last = known & (F.col("_better") < F.col("_k")) & (F.col("_better") + F.col("_c") >= F.col("_k"))
    out = out.groupBy(*by).agg(n.alias("n"), F.max(F.when(last, F.struct("_s", "_better", "_c"))).alias("_at"))
    out = out.withColumn("k", k).withColumn("boundary", F.col("_at._s")).withColumn("n_above", F.coalesce("_at._better", F.lit(0))).withColumn("n_tied", F.coalesce("_at._c", F.lit(0)))
    drawn = F.when(F.col("_at").isNotNull(), F.col("k") - F.col("n_above")).otherwise(0)
    return out.withColumn("n_drawn", drawn).withColumn("n_inclusive", F.col("n_above") + F.col("n_tied")).drop("_at")


def with_better(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``counts (by, _s, _c)`` with ``_better``, the rows of greater ``_s``, and ``_n``, those of the group; nulls come last.

    Distinct values are cut into ranges at approximate quantiles, so no task holds a whole group's.
    """
    names = {c: f"_by_{c}" for c in by}
    on = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]

    def meet(left: DataFrame, small: DataFrame, *more: Column) -> DataFrame:
        conditions = [*on, *more]
        small = F.broadcast(small.withColumnsRenamed(names))
        return left.join(small, conditions).drop(*names.values()) if conditions else left.crossJoin(small)

    probs = ", ".join(f"{i / RANGES}D" for i in range(1, RANGES))
    cuts = counts.groupBy(*by).agg(F.expr(f"percentile_approx(cast(_s AS double), array({probs}), 10000)").alias("_cuts"))
    cuts = cuts.withColumn("_cuts", F.array_distinct(F.coalesce("_cuts", F.array().cast("array<double>"))))
    value = F.col("_s").cast("double")
    place = F.when(value.isNull(), F.lit(1 << 30)).otherwise(F.size(F.filter("_cuts", lambda c: c > value)))
    ranged = meet(counts, cuts).withColumn("_range", place).drop("_cuts")
    own = Window.partitionBy(*by)
    sizes = ranged.groupBy(*by, "_range").agg(F.sum("_c").alias("_size"))
    before = sizes.select(*by, F.col("_range").alias("_r"), (F.sum("_size").over(own.orderBy("_range")) - F.col("_size")).alias("_before"), F.sum("_size").over(own).alias("_n"))
    inside = F.sum("_c").over(Window.partitionBy(*by, "_range").orderBy(F.col("_s").desc_nulls_last())) - F.col("_c")
    both = meet(ranged.withColumn("_inside", inside), before, F.col("_range") == F.col("_r"))
    return both.withColumn("_better", F.col("_before") + F.col("_inside")).drop("_range", "_r", "_before", "_inside")


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], out: str = "_edges") -> DataFrame:
    """One row with the array of the interpolated quantiles of a column, nulls left out; null without values.

    Values are counted and their counts summed in ranges, so no task holds all distinct values.
    """
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    ranked = with_better(counts, []).selectExpr("_s", "_n", "_n - _better AS _upto", "_n - _better - _c AS _start")
    aggs = []
    for i, p in enumerate(probs):
        place = f"(_n - 1) * {float(p)!r}D"
        aggs += [f"max(CASE WHEN _start <= {f}({place}) AND {f}({place}) < _upto THEN _s END) AS _{f}{i}" for f in ("floor", "ceil")]
        aggs.append(f"max({place} - floor({place})) AS _part{i}")
    found = ranked.agg(*[F.expr(x) for x in aggs])
    edges = [f"CASE WHEN _floor{i} = _ceil{i} THEN _floor{i} ELSE (1 - _part{i}) * _floor{i} + _part{i} * _ceil{i} END" for i in range(len(probs))]
    return found.selectExpr(f"array({', '.join(edges)}) AS {out}")
