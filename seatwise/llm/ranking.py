"""Exact ranks of rows without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one window of ``group_ranks`` sorts, about.
SUB_ROWS = 1024


def group_ranks(df: DataFrame, keys: list[str], tie: list[str], counts: DataFrame | None = None, across: bool = False, sub: Column | None = None) -> DataFrame:
    """``df`` with ``_rank`` (from 0) within ``keys``, and ``_total``, the rows of the group.

    Keys must not be null, and callers bound the number of groups: ``counts`` (``keys`` and
    ``count``; counted here where it is not given) is broadcast. With ``across``, ranks run on
    over all groups in the order of ``keys``, and ``_total`` is the number of all rows. A group
    is dealt by a hash of ``tie`` into sub-groups of about SUB_ROWS rows, or by ``sub``; the
    order within a group is by sub-group, then ``tie``. Rows move once, to their sub-group. Only
    the counts of a group's sub-groups, one row each, and the counts of groups meet in a window.
    """
    counts = df.groupBy(*keys).count() if counts is None else counts
    if sub is None:
        subs = counts.select(*keys, F.ceil(F.col("count") / SUB_ROWS).cast("int").alias("_subs"))
        dealt = df.join(F.broadcast(subs), keys)
        dealt = dealt.withColumn("_sub", F.pmod(F.xxhash64(*tie), F.col("_subs")).cast("int")).drop("_subs")
    else:
        dealt = df.withColumn("_sub", sub)
    subbed = [*keys, "_sub"]
    sizes = dealt.groupBy(*subbed).agg(F.count("*").alias("_n"))
    own = Window.partitionBy(*keys)
    offsets = sizes.select(*subbed, (F.sum("_n").over(own.orderBy("_sub")) - F.col("_n")).alias("_before"), F.sum("_n").over(own).alias("_total"))
    if across:
        line, whole = Window.orderBy(*keys), Window.partitionBy()  # a row a group
        groups = counts.select(*keys, (F.sum("count").over(line) - F.col("count")).alias("_ahead"), F.sum("count").over(whole).alias("_all"))
        offsets = offsets.join(F.broadcast(groups), keys).select(*subbed, (F.col("_before") + F.col("_ahead")).alias("_before"), F.col("_all").alias("_total"))
    ranked = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy(*subbed).orderBy(*tie)))
    return ranked.join(offsets, subbed).withColumn("_rank", F.col("_before") + F.col("_nth") - 1).drop("_before", "_nth", "_sub")
