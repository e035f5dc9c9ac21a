"""Classifiers that predict the benchmark, tuned by overlap on the validation rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from operator import add, and_
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import STUDY, BlockSpec
from ..functions.columns import hash_uniform, quota, ratio
from ..sources.tables import cut
from . import boosting, logistic
from .encoding import block_columns
from .metrics import agreement
from .selection import top_seats, top_within, with_better

C_GRID = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0)
#: The grid for boosting: 4 depths (None: no limit), 3 rates, 3 numbers of trees, 3 sizes of leaves.
GBT_GRID = tuple({"depth": d, "rate": r, "trees": n, "leaf": m} for d in (3, 5, 8, None) for r in (0.03, 0.1, 0.3) for n in (100, 300, 600) for m in (20, 50, 200))
#: A grid for trials, if ``seatwise.grid`` is ``small`` in the session.
SMALL_GRID = tuple({"depth": d, "rate": 0.1, "trees": 40, "leaf": m} for d in (3, None) for m in (20, 50))
MODELS = ("logistic", "boosting")
#: Share of the training rows that is held back to end boosting early.
HELD = 0.1


def boosting_grid(spark: SparkSession) -> tuple[dict, ...]:
    return SMALL_GRID if spark.conf.get("seatwise.grid", "full") == "small" else GBT_GRID


class Design(NamedTuple):
    """What fits of several blocks share: binned columns, and the features of regressions."""

    bins: boosting.Bins
    features: logistic.Features


def held_back() -> Column:
    return hash_uniform("early", "id") < HELD


def prepare(train: DataFrame, specs: Sequence[BlockSpec]) -> Design:
    columns = [block_columns(s) for s in specs]
    named, numbers = (list(dict.fromkeys(c for x in columns for c in x[i])) for i in (0, 1))
    bins = boosting.fit_bins(train, named, numbers)
    return Design(bins, logistic.fit_features(train, bins))


def _all_columns(spec: BlockSpec) -> tuple[str, ...]:
    named, numbers = block_columns(spec)
    return (*named, *numbers)


def _config(spec: BlockSpec, p: Mapping) -> boosting.Config:
    return boosting.Config(_all_columns(spec), p["depth"], p["rate"], p["trees"], p["leaf"])


def _exploded(scored: DataFrame, keys: Sequence[Sequence], names: Sequence[str]) -> DataFrame:
    """A row for each score, with the key of its place."""
    each = scored.select(*[c for c in scored.columns if c != "scores"], F.posexplode("scores").alias("_at", "score"))
    values = [F.get(F.array(*[F.lit(k[i]) for k in keys]), F.col("_at")).alias(n) for i, n in enumerate(names)]
    return each.select("*", *values).drop("_at")


def fit_cells(rows: DataFrame, specs: Sequence[BlockSpec], params: Mapping[tuple[str, str], Mapping], weight: str | None = None) -> DataFrame:
    """``rows`` with ``block, model, score`` of every split, for each block both models with the given parameters.

    ``rows`` have ``split`` and the label ``y``. All blocks are fitted side by side.
    """
    train = rows.where(F.col("split") == "train")
    design = prepare(train, specs)
    fits = [logistic.Penalised(_all_columns(s), params[s.name, "logistic"]["C"]) for s in specs]
    linear = logistic.score_path(rows, design.features, logistic.fit_path(train, design.features, fits, weight=weight), rows.columns)
    configs = [_config(s, params[s.name, "boosting"]) for s in specs]
    trees = boosting.fit_many(train, design.bins, configs, weight=weight, held=held_back())
    boosted = boosting.score_many(rows, design.bins, [(m, m.config.trees) for m in trees], rows.columns)
    return cut(_exploded(linear, [(s.name, "logistic") for s in specs], ["block", "model"]).unionByName(_exploded(boosted, [(s.name, "boosting") for s in specs], ["block", "model"])))


def overlaps(scored: DataFrame, by: Sequence[str], capacity: float) -> DataFrame:
    """``by, overlap_at_k`` of the best scores with the rows labelled, ties by hash."""
    rows = scored.select("id", *by, "score", F.col("label").alias("bench_selected"))
    return agreement(top_within(rows, "score", capacity, by, "model_selected"), by).select(*by, "overlap_at_k")


#: Equal ranges of a score in which the last seat is sought before single scores are ordered.
PARTS = 256


def _singles(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all scores of a batch: row, point, score and range."""
    lists = batch.column("scores")
    lengths, score = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), lengths)
    place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return row, batch.column("first").to_numpy()[row] + place, score, np.clip((score * PARTS).astype(int), 0, PARTS - 1)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and ones of a task by point and range."""
    total = np.zeros((2, 0))
    for batch in batches:
        row, point, _, part = _singles(batch)
        size = max(total.shape[1], (int(point.max(initial=-1)) + 1) * PARTS)
        total = np.pad(total, ((0, 0), (0, size - total.shape[1])))
        for i, c in enumerate(("n", "ones")):
            total[i] += np.bincount(point * PARTS + part, batch.column(c).to_numpy()[row], size)
    at = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(at // PARTS, pa.int32()), pa.array(at % PARTS, pa.int32()), *(pa.array(x[at].astype(np.int64)) for x in total)], ["point", "part", "n", "ones"])


def _near(ends: Mapping[int, int]) -> Callable:
    last = np.full(max(ends, default=0) + 2, -1)
    last[list(ends)] = list(ends.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The scores in the range of their point's last seat."""
        for batch in batches:
            row, point, score, part = _singles(batch)
            at = np.flatnonzero(last[np.minimum(point, len(last) - 1)] == part)
            own = row[at]
            yield pa.RecordBatch.from_arrays([pa.array(point[at], pa.int32()), pa.array(score[at]), *(pa.array(batch.column(c).to_numpy()[own]) for c in ("cell", "n", "ones"))], ["point", "score", "cell", "n", "ones"])

    return run


def grid_overlaps(scored: DataFrame, rows: DataFrame, capacity: float) -> DataFrame:
    """``point, overlap_at_k`` as ``overlaps`` has them, from scores of cells: ``scored (first, cell, n, ones, scores)``.

    ``scores`` are those of the points from ``first`` on, between 0 and 1, and ``rows (cell, id, label)`` those of
    the cells. Rows of a cell have one score, so cells are ordered by their counts: first by ranges of the
    score, and only in the range of the last seat by single scores. Only rows that share the last
    seat's score are drawn by hash.
    """
    scored = cut(scored.select(F.col("first").cast("int").alias("first"), F.col("cell").cast("long").alias("cell"), F.col("n").cast("long").alias("n"), F.col("ones").cast("long").alias("ones"), "scores"))
    own = Window.partitionBy("point")  # ranges of a point
    ranges = scored.mapInArrow(_ranges, "point int, part int, n long, ones long").groupBy("point", "part").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    ranges = ranges.withColumns({"_upto": F.sum("n").over(own.orderBy(F.desc("part"))), "_seats": quota(capacity, F.sum("n").over(own))})
    ranges = cut(ranges.withColumn("_last", (F.col("_upto") - F.col("n") < F.col("_seats")) & (F.col("_seats") < F.col("_upto"))))
    ends = {r.point: r.part for r in ranges.where("_last").select("point", "part").collect()}  # a row a point
    near = cut(scored.mapInArrow(_near(ends), "point int, score double, cell long, n long, ones long"))
    counts = near.groupBy("point", F.col("score").alias("_s")).agg(F.sum("n").alias("_c"), F.sum("ones").alias("_ones"))
    left = ranges.where("_last").select(F.col("point").alias("_of"), (F.col("_seats") - F.col("_upto") + F.col("n")).alias("_left"))
    ranked = with_better(counts, ["point"]).join(F.broadcast(left), F.col("point") == F.col("_of"))
    ranked = cut(ranked.select("point", "_s", "_c", "_ones", (F.col("_left") - F.col("_better")).alias("_seats")))
    whole = ranges.groupBy("point").agg(F.sum(F.when(F.col("_upto") <= F.col("_seats"), F.col("ones")).otherwise(0)).alias("_whole"), F.sum("ones").alias("_all"))
    within = ranked.groupBy("point").agg(F.sum(F.when(F.col("_c") <= F.col("_seats"), F.col("_ones")).otherwise(0)).alias("_within"))
    tied = ranked.where("_seats > 0 AND _seats < _c AND _ones > 0").select("point", F.col("_s").alias("score"), "_seats")
    tied = near.join(F.broadcast(tied), ["point", "score"]).select("point", "cell", "score", "_seats")  # a score a point
    drawn = top_seats(rows.join(tied, "cell"), "score", F.col("_seats"), ["point"], "_drawn").where("_drawn").groupBy("point").agg(F.count_if("label").alias("_more"))
    found = [F.col("_whole"), *(F.coalesce(c, F.lit(0)) for c in ("_within", "_more"))]
    return whole.join(within, "point", "left").join(drawn, "point", "left").select("point", ratio(reduce(add, found), F.col("_all")).alias("overlap_at_k"))


def cell_overlaps(scored: DataFrame, rows: DataFrame, capacity: float) -> DataFrame:
    """``grid_overlaps`` of scores in rows of their own: ``scored (point, cell, score, n, ones)``."""
    return grid_overlaps(scored.select(F.col("point").alias("first"), "cell", "n", "ones", F.array("score").alias("scores")), rows, capacity)


class Tuned(NamedTuple):
    """Parameters of the first grid point of the greatest overlap of each block and model, this overlap, each block's features, and the scores of these cells."""

    params: dict[tuple[str, str], dict]
    overlap: dict[tuple[str, str], float]
    width: dict[str, int]
    scores: DataFrame


def tune(rows: DataFrame, specs: Sequence[BlockSpec], grid: Sequence[Mapping], c_grid: Sequence[float], capacity: float = STUDY.capacity) -> Tuned:
    """Tune both models of all blocks by their overlap on the validation rows.

    All regressions are one path of Newton steps, and all boosted models grow together: grid points
    that differ in their number of trees only are one fit. Only validation rows are scored before
    the choice, each vector of a block's values once.
    """
    train, val = rows.where(F.col("split") == "train"), rows.where(F.col("split") == "val")
    design = prepare(train, specs)
    linear = logistic.fit_path(train, design.features, [logistic.Penalised(_all_columns(s), c) for s in specs for c in c_grid])
    grown: dict[tuple, int] = {}
    configs: list[boosting.Config] = []
    for s in specs:
        for p in sorted(grid, key=lambda p: -p["trees"]):
            if (key := (s.name, p["depth"], p["rate"], p["leaf"])) not in grown:
                grown[key] = len(configs)
                configs.append(_config(s, p))
    models = boosting.fit_many(train, design.bins, configs, held=held_back())

    def fit_of(s: BlockSpec, p: Mapping) -> tuple[int, int]:
        """The model of a grid point and how many of its trees the point has."""
        i = grown[s.name, p["depth"], p["rate"], p["leaf"]]
        return i, min(p["trees"], len(models[i].trees))

    every, members, names, keep, cores = [], [], [], ["cell", "n", "ones"], val.sparkSession.sparkContext.defaultParallelism
    for k, s in enumerate(specs):
        own = list(_all_columns(s))
        counted = val.groupBy(*own).agg(F.count(F.lit(1)).alias("n"), F.count_if("label").alias("ones"))
        cells = cut(counted.withColumn("cell", F.monotonically_increasing_id() * len(specs) + k))
        on = [F.col(f"_v_{c}").eqNullSafe(F.col(f"_r_{c}")) for c in own]
        left, right = cells.select("cell", *[F.col(c).alias(f"_v_{c}") for c in own]), val.select("id", "label", *[F.col(c).alias(f"_r_{c}") for c in own])
        members.append(right.join(left, reduce(and_, on)).select("cell", "id", "label"))
        # what a block does not have is null, and its models do not look at it
        n = cells.count()
        spread = max(-(-n // boosting.SCORED), min(-(-cores // len(specs)), -(-n // boosting.BLOCK)), 1)  # each task makes the tables of all trees
        full = cells.repartition(spread).withColumns({c: F.lit(None).cast(t) for c, t in val.select(*design.bins.columns).dtypes if c not in own})
        points = sorted({fit_of(s, p) for p in grid})
        scored = [(logistic.score_path(full, design.features, linear[k * len(c_grid) : (k + 1) * len(c_grid)], keep), [f"c{k * len(c_grid) + j}" for j in range(len(c_grid))])]
        scored.append((boosting.score_many(full, design.bins, [(models[i], n) for i, n in points], keep), [f"t{i}:{n}" for i, n in points]))
        for scores, own_names in scored:
            every.append(scores.withColumn("first", F.lit(len(names))))
            names += own_names
    found = grid_overlaps(reduce(DataFrame.unionByName, every), reduce(DataFrame.unionByName, members), capacity)
    found = {names[r.point]: r.overlap_at_k or 0.0 for r in found.collect()}  # a row a grid point
    params, overlap, chosen, best = {}, {}, [], []
    for k, s in enumerate(specs):
        at = [found.get(f"c{k * len(c_grid) + j}", 0.0) for j in range(len(c_grid))]
        j = at.index(max(at))
        params[s.name, "logistic"], overlap[s.name, "logistic"] = {"C": c_grid[j]}, at[j]
        chosen.append(linear[k * len(c_grid) + j])
        at = [found.get("t{}:{}".format(*fit_of(s, p)), 0.0) for p in grid]
        j = at.index(max(at))
        params[s.name, "boosting"], overlap[s.name, "boosting"] = dict(grid[j]), at[j]
        i, n = fit_of(s, grid[j])
        best.append((models[i], n))
    keep = ["id", "split"]
    scores = _exploded(logistic.score_path(rows, design.features, chosen, keep), [(s.name, "logistic") for s in specs], ["block", "model"])
    scores = scores.unionByName(_exploded(boosting.score_many(rows, design.bins, best, keep), [(s.name, "boosting") for s in specs], ["block", "model"]))
    width = {s.name: len(design.features.of(_all_columns(s))) for s in specs}
    return Tuned(params, overlap, width, scores)


def random_scores(df: DataFrame) -> DataFrame:
    return df.withColumn("score", hash_uniform("anchor", "id"))
