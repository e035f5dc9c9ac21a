"""The ordered restriction cascade."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import STUDY
from ..functions.columns import all_of

SCORES = [f"s{i}" for i in range(1, 6)]
PRESENCE = [f"p{i}" for i in range(1, 5)]


def steps() -> list[tuple[str, Column]]:
    """Named predicates in order; a missing group is kept, as only the code for undeclared goes."""
    return [
        ("no_practice", F.col("practice") == 0),
        ("status", F.col("status").isin(1, 2)),
        ("present", all_of([F.col(p) == 1 for p in PRESENCE])),
        ("scored", all_of([F.col(s).isNotNull() for s in SCORES])),
        ("declared", ~F.col("grp").eqNullSafe(STUDY.undeclared)),
    ]


def apply_cascade(df: DataFrame, which: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    chosen = steps()
    return df.where(all_of([chosen[i - 1][1] for i in which]))


def cascade_counts(df: DataFrame) -> DataFrame:
    """``step, n`` after each prefix of the cascade, in one scan."""
    preds = [p for _, p in steps()]
    names = ["all", *[name for name, _ in steps()]]
    counts = df.agg(F.count("*").alias("n0"), *[F.count_if(all_of(preds[:i])).alias(f"n{i}") for i in range(1, 6)])
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.col(f"n{i}").alias("n")) for i, name in enumerate(names)])
    return counts.select(F.inline(rows))


def assert_counts(df: DataFrame, expected: Sequence[int]) -> DataFrame:
    """``df`` unless its cascade counts differ from the expected ones."""
    found = [r.n for r in cascade_counts(df).orderBy("step").collect()]
    if found != list(expected):
        raise ValueError(f"cascade counts {found}, expected {list(expected)}")
    return df
