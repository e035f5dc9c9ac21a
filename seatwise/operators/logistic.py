"""Logistic regressions with a squared penalty, many at once: one pass over the rows a Newton step.

A pass is one Spark job for all fits that have not converged: tasks sum loss, gradient and second
derivatives by fit, the sums meet by fit, and the driver solves systems as wide as the features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut, dropped
from .boosting import BLOCK, Bins, coded, codes_of, quick_session

#: Steps of a fit, the mean gradient's norm at which it has converged, and that which it must reach.
STEPS, CONVERGED, REQUIRED = 100, 1e-9, 1e-6


class Penalised(NamedTuple):
    """Columns, and the weight ``c`` of the loss against half the squared norm."""

    columns: tuple[str, ...]
    c: float


class Linear(NamedTuple):
    """A fit: coefficients of all features (0 for columns it has not), intercept, and the norm of the mean gradient."""

    coefficients: np.ndarray
    intercept: float
    gradient: float


class Features(NamedTuple):
    """The features of binned columns: one a level of a name, numbers as they are; and their deviations over the training rows."""

    bins: Bins
    deviation: np.ndarray

    def of(self, columns: Sequence[str]) -> np.ndarray:
        return np.concatenate([np.arange(a, b) for c, (a, b) in zip(self.bins.columns, spans(self.bins), strict=True) if c in columns])


def spans(bins: Bins) -> list[tuple[int, int]]:
    """Where the features of each column are."""
    out, at = [], 0
    for c in bins.columns:
        size = len(bins.edges[c]) if c in bins.named else 1
        out.append((at, at + size))
        at += size
    return out


def _matrix(bins: Bins, batch: pa.RecordBatch) -> np.ndarray:
    """Features of a batch; unknown levels are all 0, and so is a null number."""
    codes, where = codes_of(bins, batch), spans(bins)
    out, rows = np.zeros((batch.num_rows, where[-1][1])), np.arange(batch.num_rows)
    for i, (c, (a, b)) in enumerate(zip(bins.columns, where, strict=True)):
        if c in bins.named:
            known = codes[:, i] < b - a
            out[rows[known], a + codes[known, i]] = 1.0
        else:
            out[:, a] = np.nan_to_num(batch.column(f"_code_{i}").to_numpy(zero_copy_only=False).astype(float))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def _moments(bins: Bins) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows, and the mean and squared distance from it of each feature, of a task."""
        n, mean, square = 0, 0.0, 0.0
        for batch in _blocks(batches):
            x = _matrix(bins, batch)
            m, k = x.mean(axis=0), len(x)
            square = square + ((x - m) ** 2).sum(axis=0) + (m - mean) ** 2 * n * k / (n + k)
            mean, n = mean + (m - mean) * k / (n + k), n + k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([list(mean)]), pa.array([list(square)])], ["n", "mean", "square"])

    return run


def fit_features(train: DataFrame, bins: Bins) -> Features:
    """Population deviations of the features; a constant has 1."""
    parts = train.select(*coded(bins)).mapInArrow(_moments(bins), "n long, mean array<double>, square array<double>")
    each = parts.select("n", F.posexplode(F.arrays_zip("mean", "square")).alias("at", "x"))
    sums = each.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x.mean")).alias("m"), F.sum(F.col("x.square") + F.col("n") * F.col("x.mean") * F.col("x.mean")).alias("q"))
    found = {r["at"]: r.q / r.n - (r.m / r.n) ** 2 for r in sums.collect()}  # a row a feature
    deviation = np.sqrt(np.maximum([found.get(i, 0.0) for i in range(spans(bins)[-1][1])], 0))
    return Features(bins, np.where(deviation > 1e-9, deviation, 1.0))


def _sums(shared: Broadcast, features: Features, parts: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Loss, gradient and second derivatives of each fit of a part at its coefficients, the last of which is the intercept."""
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            groups = batch.column("_part").to_numpy()
            for part in np.unique(groups):
                rows = batch.filter(pa.array(groups == part))
                x = np.column_stack([_matrix(features.bins, rows) / features.deviation, np.ones(rows.num_rows)])
                y, w = (rows.column(c).to_numpy().astype(float) for c in ("_y", "_w"))
                for fit, (own, beta) in shared.value.items():
                    if fit % parts != part:
                        continue
                    z = x[:, own]
                    margin = z @ beta
                    rate = 1 / (1 + np.exp(-margin))
                    loss = (w * np.logaddexp(0, np.where(y > 0, -margin, margin))).sum()
                    second = z.T @ (z * (w * rate * (1 - rate))[:, None])
                    found = np.concatenate([[loss], z.T @ (w * (rate - y)), second.ravel()])
                    total[fit] = total[fit] + found if fit in total else found
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["fit", "sums"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for fit, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total[fit] = total[fit] + np.frombuffer(raw) if fit in total else np.frombuffer(raw)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["fit", "sums"])


def fit_path(train: DataFrame, features: Features, fits: Sequence[Penalised], label: str = "y", weight: str | None = None) -> list[Linear]:
    """The minimum of half the squared norm plus ``c`` times the sum of losses, for each of ``fits``.

    Features are in units of their deviation; as the intercept is free, centring them would change
    no probability. A step that raises the objective is halved. A fit whose mean gradient
    does not fall to REQUIRED is an error.
    """
    spark = train.sparkSession
    one = F.col(weight).cast("double") if weight else F.lit(1.0)
    parts = min(len(fits), spark.sparkContext.defaultParallelism)
    codes = [f"_code_{i}" for i in range(len(features.bins.columns))]
    rows = train.select(*coded(features.bins), F.col(label).cast("double").alias("_y"), one.alias("_w"))
    rows = rows.groupBy(*codes, "_y").agg(F.sum("_w").alias("_w")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))  # equal rows are one of their weight
    total = train.agg(F.sum(one * F.col(label)).alias("ones"), F.sum(one).alias("all")).first()
    weights = float(total["all"] or 0)
    width = len(features.deviation)
    if not weights or not 0 < total.ones < weights:  # one class only
        share = min(max((total.ones or 0) / (weights or 1), 1e-9), 1 - 1e-9)
        return [Linear(np.zeros(width), float(np.log(share / (1 - share))), 0.0) for _ in fits]
    state = cut(rows.repartition("_part", F.xxhash64(*codes) % 64), quick_session(spark))
    own = [np.append(features.of(f.columns), width) for f in fits]
    beta, step, best, norm = [np.zeros(len(o)) for o in own], [np.zeros(len(o)) for o in own], [np.inf] * len(fits), [np.inf] * len(fits)
    done = [b.copy() for b in beta]
    live = set(range(len(fits)))
    for _ in range(STEPS):
        shared = spark.sparkContext.broadcast({i: (own[i], beta[i]) for i in live})
        found = state.mapInArrow(_sums(shared, features, parts), "fit int, sums binary").repartition(min(parts, len(live)), "fit").mapInArrow(_added, "fit int, sums binary").toArrow()  # a row a fit
        shared.destroy()
        for i, raw in zip(*(c.to_pylist() for c in found.columns), strict=True):
            x, k = np.frombuffer(raw), len(own[i])
            ridge = np.append(np.ones(k - 1), 0.0)
            objective = fits[i].c * x[0] + 0.5 * (ridge * beta[i] ** 2).sum()
            if objective > best[i] * (1 + 1e-12):
                step[i] = step[i] / 2
                beta[i] = done[i] + step[i]
                if np.abs(step[i]).max() < 1e-14:
                    live.discard(i)
                continue
            gradient = fits[i].c * x[1 : k + 1] + ridge * beta[i]
            best[i], done[i], norm[i] = objective, beta[i], float(np.linalg.norm(gradient) / (fits[i].c * weights))
            if norm[i] <= CONVERGED:
                live.discard(i)
                continue
            second = fits[i].c * x[k + 1 :].reshape(k, k) + np.diag(ridge)
            step[i] = -np.linalg.solve(second + 1e-12 * np.trace(second) / k * np.eye(k), gradient)
            beta[i] = done[i] + step[i]
        if not live:
            break
    dropped(state)
    worst = max(norm)
    if worst > REQUIRED:
        raise ArithmeticError(f"a regression has not converged: the norm of its mean gradient is {worst}")
    out = []
    for o, b, g in zip(own, done, norm, strict=True):
        coefficients = np.zeros(width)
        coefficients[o[:-1]] = b[:-1] / features.deviation[o[:-1]]
        out.append(Linear(coefficients, float(b[-1]), g))
    return out


def score_path(df: DataFrame, features: Features, fits: Sequence[Linear], keep: Sequence[str], out: str = "scores") -> DataFrame:
    """``keep`` and an array of the probabilities of each fit, rounded to nine digits."""
    names, weights, start = list(keep), np.stack([f.coefficients for f in fits], axis=1), np.array([f.intercept for f in fits])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            scores = np.round(1 / (1 + np.exp(-(_matrix(features.bins, part) @ weights + start))), 9)
            width = np.arange(0, scores.size + 1, len(fits), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.ListArray.from_arrays(pa.array(width), pa.array(scores.ravel()))], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)
    return df.select(*names, *coded(features.bins)).mapInArrow(run, f"{schema}, {out} array<double>")
