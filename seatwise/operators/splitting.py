"""Quantile bins, stratified splits and samples."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_key
from ..sources.tables import cut
from .selection import exact_quantiles


#: Leading hex digits of a hash by which a stratum's rows are counted.
DIGITS = 4


def quantile_bins(df: DataFrame, col: str, bins: int, out: str) -> DataFrame:
    """Right-closed bins at interpolated quantiles, equal edges merged; values never straddle a bin, nulls are in the first."""
    probs = [i / bins for i in range(1, bins)]
    found = exact_quantiles(df, col, probs).select(F.array_distinct(F.transform("_edges", lambda e: F.round(e, 6)))).first()[0]  # bins - 1 numbers at most
    edges = F.array(*[F.lit(e) for e in found or [] if e is not None]).cast("array<double>")
    return df.withColumn(out, F.size(F.filter(edges, lambda e: F.col(col) > e)))


def last_drawn(df: DataFrame, by: Sequence[str], take: Callable[[DataFrame], DataFrame], tag: str) -> DataFrame:
    """The last row drawn in each group, as ``_by_<key>, _hash, _id``; a group without a draw has no row.

    ``take`` turns ``by, _m``, a row a group with its size, into ``by, _take``. Rows are counted by
    group and leading digits of their hash; only those with the digits at which the draw ends are
    ordered, so no task holds a group, and rows don't move. Ids are distinct.
    """
    digits = F.substring(hash_key(tag, "id"), 1, DIGITS)
    counts = df.groupBy(*by, digits.alias("_digits")).agg(F.count(F.lit(1)).alias("_c"))
    names = {c: f"_by_{c}" for c in by}
    wanted = take(counts.groupBy(*by).agg(F.sum("_c").alias("_m"))).select(*[F.col(c).alias(n) for c, n in names.items()], "_take")
    upto = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*by).orderBy("_digits")))
    ends = upto.join(F.broadcast(wanted), _same(names)).where("_upto - _c < _take AND _take <= _upto")
    ends = ends.select(*names.values(), F.col("_digits").alias("_end"), (F.col("_take") - F.col("_upto") + F.col("_c")).alias("_left"))
    near = df.select(*by, F.col("id").alias("_id"), hash_key(tag, "id").alias("_hash")).join(F.broadcast(ends), [*_same(names), F.substring("_hash", 1, DIGITS) == F.col("_end")])
    turn = F.row_number().over(Window.partitionBy(*names.values()).orderBy("_hash", "_id"))
    return cut(near.select(*names.values(), "_hash", "_id", "_left", turn.alias("_turn")).where("_turn = _left").drop("_left", "_turn"))


def _same(names: dict[str, str]) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()] or [F.lit(True)]


def drawn(df: DataFrame, by: Sequence[str], last: DataFrame, tag: str, out: str) -> DataFrame:
    """The flag of the rows up to the last one of ``last_drawn`` in their group: a broadcast of one row a group."""
    names = {c: f"_by_{c}" for c in by}
    within = F.struct(hash_key(tag, "id").alias("h"), F.col("id").alias("i")) <= F.struct(F.col("_hash").alias("h"), F.col("_id").alias("i"))
    both = df.join(F.broadcast(last), _same(names), "left")
    return both.withColumn(out, F.col("_hash").isNotNull() & within).drop("_hash", "_id", *names.values())


def _shares(stratum: str, share: float) -> Callable[[DataFrame], DataFrame]:
    """ceil(share * n) rows by largest remainders over strata; ties go by stratum."""

    def take(sizes: DataFrame) -> DataFrame:
        line = Window.partitionBy()  # one row a stratum
        goal = F.ceil(F.lit(share) * F.col("_n"))
        sizes = sizes.withColumn("_n", F.sum("_m").over(line)).withColumn("_exact", goal * F.col("_m") / F.col("_n")).withColumn("_whole", F.floor("_exact"))
        short = goal - F.sum("_whole").over(line)
        turn = F.row_number().over(Window.orderBy(F.round(F.col("_exact") - F.col("_whole"), 9).desc(), F.col(stratum)))
        return sizes.withColumn("_take", F.col("_whole") + (turn <= short).cast("int"))

    return take


def stratified_split(df: DataFrame, stratum: Column, out: str = "split") -> DataFrame:
    """train 60 %, val 20 %, test 20 %: two draws of ceil(.4 n) and then half of these, stratified.

    ``df`` is read five times, three times for its strata and ids alone.
    """
    by, keyed = ["_stratum"], df.withColumn("_stratum", stratum)
    slim = keyed.select("id", *by)
    first = last_drawn(slim, by, _shares("_stratum", 0.4), "temp")
    second = last_drawn(drawn(slim, by, first, "temp", "_temp").where("_temp"), by, _shares("_stratum", 0.5), "test")
    both = drawn(drawn(keyed, by, first, "temp", "_temp"), by, second, "test", "_test")
    part = F.when(~F.col("_temp"), "train").when(F.col("_test"), "test").otherwise("val")
    return both.withColumn(out, part).drop("_temp", "_test", *by)


def extend_split(df: DataFrame, split: DataFrame, stratum: Column) -> DataFrame:
    """Labels of ``split (id, split)`` stay; rows without one get theirs by a split among themselves."""
    known = cut(df.join(split.select("id", "split"), "id", "left"))
    old = known.where(F.col("split").isNotNull())
    fresh = stratified_split(known.where(F.col("split").isNull()).drop("split"), stratum)
    return old.unionByName(fresh)


def sample_fraction(df: DataFrame, fraction: float, by: Sequence[str], tag: str = "sample") -> DataFrame:
    """An exact share of each chunk ``by``, rounded half to even, without replacement."""
    last = last_drawn(df, by, lambda sizes: sizes.withColumn("_take", F.bround(F.lit(fraction) * F.col("_m"))), tag)
    return drawn(df, by, last, tag, "_in").where("_in").drop("_in")
