"""Column expressions with the same value in Spark and in SQL engines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import STUDY


def hash_key(tag: str, key: Column | str, seed: int = STUDY.seed) -> Column:
    """A reproducible random order: independent of the physical order of rows."""
    return F.md5(F.concat(F.lit(f"{seed}:{tag}:"), F.col(key) if isinstance(key, str) else key).cast("string"))


def hash_uniform(tag: str, key: Column | str, seed: int = STUDY.seed) -> Column:
    """Uniform on [0, 1) from the first 52 bits of the hash."""
    return F.conv(F.substring(hash_key(tag, key, seed), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def quota(capacity: float, n: Column) -> Column:
    """Seats: the floor of a product of doubles."""
    return F.floor(F.lit(float(capacity)) * n.cast("double")).cast("long")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(flag: Column, where: Column | None = None) -> Column:
    """Rate of a flag in percent over the rows of a mask; nulls of the flag don't count."""
    value = flag.cast("double")
    return 100 * F.avg(value if where is None else F.when(where, value))


def letter_ordinal(col: Column) -> Column:
    """A = 1 to Z = 26; anything else is null."""
    return F.when(col.rlike("^[A-Z]$"), F.ascii(col) - 64)


def all_of(parts: Sequence[Column]) -> Column:
    return reduce(and_, parts)


def row_mean(cols: Sequence[Column]) -> Column:
    """Mean of the values that are not null."""
    n = reduce(add, [c.isNotNull().cast("int") for c in cols])
    return ratio(reduce(add, [F.coalesce(c, F.lit(0.0)) for c in cols]), n)


def weighted(cols: Sequence[Column], weights: Sequence[float]) -> Column:
    """Weighted sum; null if any value is."""
    return reduce(add, [c * F.lit(float(w)) for c, w in zip(cols, weights, strict=True)])


def region(value: Column, epsilon: float) -> Column:
    return F.when(value > epsilon, "amplification").when(value < -epsilon, "attenuation").when(value.isNotNull(), "practical_reproduction")


def verdict(point: Column, low: Column, high: Column, epsilon: float = STUDY.epsilon_pp) -> Column:
    """The region of the point, unless the interval's ends lie in different ones."""
    return F.when(region(low, epsilon) == region(high, epsilon), region(point, epsilon)).otherwise("inconclusive")


def sign_reversal(model: Column, bench: Column) -> Column:
    return (F.signum(model) != F.signum(bench)) & (bench != 0)


def capacity_label(capacity: Column | float) -> Column:
    """``K05`` for 0.05: whole percents, two digits at least."""
    value = capacity if isinstance(capacity, Column) else F.lit(float(capacity))
    return F.concat(F.lit("K"), F.lpad(F.floor(value * 100 + 1e-9).cast("string"), 2, "0"))


def any_cell(wanted: dict[str, Sequence[str] | None], key: str = "task", variant: str = "variant") -> Column:
    """Rows of the named cells; None stands for all variants."""
    out = F.lit(False)
    for name, kinds in wanted.items():
        out = out | ((F.col(key) == name) & (F.lit(True) if kinds is None else F.col(variant).isin(*kinds)))
    return out
