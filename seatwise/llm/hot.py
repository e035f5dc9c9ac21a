"""Joins whose left side may hold a key very often."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one task takes, about; keys that are split, at most; parts of a key, at most.
ROWS, KEYS, PARTS = 256, 1024, 4096


def join_hot(left: DataFrame, right: DataFrame, key: str, counts: DataFrame | None = None, how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, which has each value of ``key`` once; null keys meet nothing.

    The KEYS most frequent keys of ``left`` are split into parts of about ROWS rows, and the
    right row is sent to each part. A key beyond these has less than a KEYS-th of all rows, so
    the broadcast list of split keys is bounded and no task gets a hot key whole. ``counts``
    (``key, count``) saves a pass over ``left``.
    """
    counts = left.where(F.col(key).isNotNull()).groupBy(key).count() if counts is None else counts
    parts = F.least(F.ceil(F.col("count") / ROWS), F.lit(PARTS)).cast("int")
    hot = counts.where(F.col("count") > ROWS).orderBy(F.desc("count"), key).limit(KEYS).select(F.col(key).alias("_hot"), parts.alias("_parts"))
    dealt = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    dealt = dealt.withColumn("_part", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_parts")).cast("int"), F.lit(0))).drop("_hot", "_parts")
    sent = right.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    sent = sent.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_hot", "_parts")
    return dealt.join(sent, [key, "_part"], how).drop("_part")
