"""Bootstrap intervals from sufficient counts.

A resample of a group of fixed size changes a statistic only through its counts of (model,
benchmark) patterns, and these are multinomial. A cell's resamples thus need a few counts
rather than its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import STUDY
from ..functions.columns import hash_uniform, percent, sign_reversal, verdict

_PATTERNS = ("n00", "n01", "n10", "n11")  # model, benchmark


def pattern_counts(ledger: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row a cell and side with its four counts; sides of fewer than two rows drop their cell."""
    m, s = F.col("model_selected"), F.col("bench_selected")
    flags = [~m & ~s, ~m & s, m & ~s, m & s]
    out = ledger.where(F.col("side").isNotNull()).groupBy(*by, "side").agg(*[F.count_if(f).alias(n) for f, n in zip(flags, _PATTERNS, strict=True)])
    size = F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11")
    w = Window.partitionBy(*by)
    return out.withColumn("_ok", F.sum((size >= 2).cast("int")).over(w)).where("_ok = 2").drop("_ok")


def _interval(x: np.ndarray) -> tuple[float | None, float | None]:
    if np.isnan(x).any():
        return None, None
    low, high = np.percentile(x, [2.5, 97.5])
    return float(low), float(high)


def bootstrap(ledger: DataFrame, by: Sequence[str], replicates: int = STUDY.replicates, seed: int = STUDY.seed) -> DataFrame:
    """Point, interval and verdict of D, and of the ratio, one row a cell; every cell restarts the seed."""
    counts = pattern_counts(ledger, by)
    kinds = dict(counts.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", n_a long, n_b long, d_point double, d_lo double, d_hi double, ratio_point double, ratio_lo double, ratio_hi double, gap_pp double, bench_gap_pp double"

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        rates, points, n = {}, {}, {}
        for side in ("A", "B"):
            own = pdf.loc[pdf["side"] == side, list(_PATTERNS)].to_numpy()[0].astype(float)
            n[side] = int(own.sum())
            draws = rng.multinomial(n[side], own / own.sum(), replicates)
            for x, store in ((draws, rates), (own[None], points)):
                store[side] = ((x[:, 2] + x[:, 3]) / n[side] * 100, (x[:, 1] + x[:, 3]) / n[side] * 100)

        def gaps(r: dict) -> tuple[np.ndarray, ...]:
            model, bench = r["A"][0] - r["B"][0], r["A"][1] - r["B"][1]
            ratio = np.divide(r["A"][0], r["B"][0], out=np.full(len(model), np.nan), where=r["B"][0] > 0)
            return model - bench, ratio, model, bench

        d, q, _, _ = gaps(rates)
        point, q0, model, bench = (float(x[0]) for x in gaps(points))
        row = [pdf[c].iloc[0] for c in by] + [n["A"], n["B"], point, *_interval(d), None if np.isnan(q0) else q0, *_interval(q), model, bench]
        return pd.DataFrame([row], columns=[*by, "n_a", "n_b", "d_point", "d_lo", "d_hi", "ratio_point", "ratio_lo", "ratio_hi", "gap_pp", "bench_gap_pp"])

    out = counts.groupBy(*by).applyInPandas(cell, schema)  # two rows a cell
    return out.withColumn("verdict", verdict(F.col("d_point"), F.col("d_lo"), F.col("d_hi"))).withColumn("sign_reversal", sign_reversal(F.col("gap_pp"), F.col("bench_gap_pp")))


def bootstrap_fidelity(ledger: DataFrame, by: Sequence[str], replicates: int = STUDY.replicates, seed: int = STUDY.seed) -> DataFrame:
    """Point and interval of the fidelity cost: mitigated less unmitigated precision within both sides."""
    b, m, u = (F.col(c).cast("int") for c in ("bench_selected", "model_selected", "unmitigated_selected"))
    counts = ledger.where(F.col("side").isNotNull()).groupBy(*by, "side", (b * 4 + m * 2 + u).alias("pattern")).count()
    kinds = dict(counts.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", cost_point double, cost_lo double, cost_hi double"

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        total, point = np.zeros((replicates, 8)), np.zeros((1, 8))
        for side in ("A", "B"):
            own = np.zeros(8)
            part = pdf[pdf["side"] == side]
            own[part["pattern"].to_numpy()] = part["count"].to_numpy()
            if own.sum():
                total += rng.multinomial(int(own.sum()), own / own.sum(), replicates)
                point += own

        def cost(x: np.ndarray) -> np.ndarray:
            i = np.arange(8)

            def precision(bit: int) -> np.ndarray:
                chosen = x[:, (i & bit) > 0].sum(1)
                hit = x[:, ((i & bit) > 0) & ((i & 4) > 0)].sum(1)
                return np.divide(hit, chosen, out=np.full(len(x), np.nan), where=chosen > 0)

            return precision(2) - precision(1)

        p = cost(point)[0]
        row = [pdf[c].iloc[0] for c in by] + [None if np.isnan(p) else float(p), *_interval(cost(total))]
        return pd.DataFrame([row], columns=[*by, "cost_point", "cost_lo", "cost_hi"])

    return counts.groupBy(*by).applyInPandas(cell, schema)  # sixteen rows a cell


def bootstrap_increment(ledger: DataFrame, by: Sequence[str], first: str, second: str, replicates: int = STUDY.replicates, seed: int = STUDY.seed) -> DataFrame:
    """Point and interval of the gap of selection ``second`` less that of ``first`` within a cell, from four counts a side."""
    x, y = F.col(first), F.col(second)
    flags = [~x & ~y, ~x & y, x & ~y, x & y]
    counts = ledger.where(F.col("side").isNotNull()).groupBy(*by, "side").agg(*[F.count_if(f).alias(n) for f, n in zip(flags, _PATTERNS, strict=True)])
    kinds = dict(counts.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", increment_point double, increment_lo double, increment_hi double"

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        total, point = np.zeros(replicates), 0.0
        for side, sign in (("A", 1), ("B", -1)):
            own = pdf.loc[pdf["side"] == side, list(_PATTERNS)].to_numpy().astype(float)
            if not len(own) or not own.sum():
                return pd.DataFrame([[pdf[c].iloc[0] for c in by] + [None] * 3], columns=[*by, "increment_point", "increment_lo", "increment_hi"])
            n = own.sum()
            draws = rng.multinomial(int(n), own[0] / n, replicates)
            total += sign * 100 * (draws[:, 1] - draws[:, 2]) / n
            point += sign * 100 * (own[0, 1] - own[0, 2]) / n
        return pd.DataFrame([[pdf[c].iloc[0] for c in by] + [float(point), *_interval(total)]], columns=[*by, "increment_point", "increment_lo", "increment_hi"])

    return counts.groupBy(*by).applyInPandas(cell, schema)  # two rows a cell


def bootstrap_by_hash(ledger: DataFrame, by: Sequence[str], replicates: int) -> DataFrame:
    """The same interval by explicit seeded draws of row numbers, in SQL operations: a check of ``bootstrap`` for small tables."""
    w = Window.partitionBy(*by, "side")
    rows = ledger.where(F.col("side").isNotNull()).withColumn("_i", F.row_number().over(w.orderBy("id"))).withColumn("_n", F.count(F.lit(1)).over(w))
    draws = rows.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    key = F.concat_ws(":", F.col("side"), F.col("_b").cast("string"), F.col("_i").cast("string"))
    draws = draws.select(*by, "side", "_b", (F.floor(hash_uniform("boot", key) * F.col("_n")) + 1).alias("_i"))
    drawn = draws.join(rows.select(*by, "side", "_i", "model_selected", "bench_selected"), [*by, "side", "_i"])
    m, s, a, b = F.col("model_selected"), F.col("bench_selected"), F.col("side") == "A", F.col("side") == "B"
    d = (percent(m, a) - percent(m, b)) - (percent(s, a) - percent(s, b))
    reps = drawn.groupBy(*by, "_b").agg(F.round(d, 9).alias("d"))
    ends = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))
    return reps.groupBy(*by).agg(F.round(ends[0], 6).alias("d_lo"), F.round(ends[1], 6).alias("d_hi"), F.count(F.lit(1)).alias("n_boot"))
