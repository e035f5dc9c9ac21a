"""Gradient-boosted trees of many configurations, grown side by side over counted cells of a binned table.

Columns are binned once, and Spark counts the rows of each vector of bins: a fit is over these cells,
whose number is bounded by the levels, not by the rows. Each set of columns has cells of its own;
where these are few, each configuration is a task that goes through all of its passes. Where they
are not, a pass is one Spark job for all configurations that still grow: every
task sums gradients by configuration, node and bin over its cells, the sums meet by configuration,
and the best split of each node comes back, a few numbers a node. Trees grow best first to a
number of leaves, several nodes in one pass. Rows held back give the loss that ends a fit, in the
same pass. Gradients are whole multiples of a small unit, so that sums do not depend on the order
of rows, on their counting or the number of tasks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from heapq import heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import cut, dropped

#: Bins of a number, levels of a name, at most; leaves of a tree.
BINS, LEVELS, LEAVES = 255, 4096, 31
#: Trees without a smaller loss on the rows held back after which a fit ends, and what counts as smaller.
PATIENCE, LEAST_GAIN = 20, 1e-7
#: The least second derivative on a side of a split.
LEAST_WEIGHT = 1e-3
#: Gradients and losses are multiples of this.
UNIT = 2.0**-20
#: Cells of a block, and finished trees a configuration after which the cells' sums are saved.
BLOCK, SAVED = 8192, 6
#: Cells of a set of columns up to which a configuration is one task (some 30 MB of it).
CELLS = 1 << 18
#: Joint bins of columns that are summed together, and rows that are scored together, at most.
JOINT, SCORED = 1024, 1 << 15


@dataclass(frozen=True)
class Config:
    """Columns, depth (None: no limit), rate, trees and rows of a leaf."""

    columns: tuple[str, ...]
    depth: int | None
    rate: float
    trees: int
    leaf: int


class Tree(NamedTuple):
    """Nodes from the root; a row goes right if its code of the column is in [lo, hi]. A leaf is its own child."""

    column: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int


@dataclass
class Model:
    """Trees of one fit, and the log-odds it starts from; the first trees are the fit with fewer trees."""

    config: Config
    base: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    last: list[int] = field(default_factory=list, repr=False)
    stats: list[tuple[float, float, float]] = field(default_factory=list, repr=False)


class Bins(NamedTuple):
    """Columns with the upper values of their bins (numbers) or their levels (names), of the training rows."""

    columns: tuple[str, ...]
    edges: dict[str, list]
    named: frozenset[str]

    def size(self, column: str) -> int:
        return max(1, len(self.edges[column]) + (column in self.named))  # a bin for unknown levels


def fit_bins(train: DataFrame, named: Sequence[str], numbers: Sequence[str]) -> Bins:
    """Levels of ``named`` columns, and for ``numbers`` all values if these are few, else approximate quantiles.

    Distinct values are estimated first, so that only those of columns with few are collected.
    """
    columns, most = [*named, *numbers], {c: LEVELS if c in named else BINS for c in (*named, *numbers)}
    about = train.agg(*[F.approx_count_distinct(F.col(c)).alias(f"_{i}") for i, c in enumerate(columns)]).first()
    small = [c for i, c in enumerate(columns) if about[f"_{i}"] <= 2 * most[c]]
    values = train.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), (F.col(c) if c in named else F.col(c).cast("double")).cast("string").alias("v")) for c in small]))) if small else None
    edges: dict[str, list] = {c: [] for c in columns}
    for r in values.where("v IS NOT NULL").distinct().collect() if small else []:  # some 2 LEVELS a column at most
        edges[r.c].append(r.v if r.c in named else float(r.v))
    wide = [c for c in columns if c not in small or len(edges[c]) > most[c]]
    if many := [c for c in wide if c in named]:
        raise ValueError(f"{', '.join(many)}: more than {LEVELS} levels")
    if wide:
        places = [(i + 1) / BINS for i in range(BINS)]
        cuts = train.agg(*[F.percentile_approx(F.col(c).cast("double"), places, 10_000).alias(f"_{i}") for i, c in enumerate(wide)]).first()
        edges |= {c: list(set(cuts[f"_{i}"])) for i, c in enumerate(wide)}
    return Bins((*named, *numbers), {c: sorted(x) for c, x in edges.items()}, frozenset(named))


def codes_of(bins: Bins, batch: pa.RecordBatch) -> np.ndarray:
    """The bins of a batch's columns; a number beyond the last edge is in the last bin, a null in the first."""
    out = np.zeros((batch.num_rows, len(bins.columns)), np.int32)
    for i, c in enumerate(bins.columns):
        column, edges = batch.column(f"_code_{i}"), bins.edges[c]
        if c in bins.named:
            out[:, i] = pc.fill_null(pc.index_in(column, pa.array(edges, column.type)), len(edges)).to_numpy(zero_copy_only=False)
        else:
            values = np.nan_to_num(column.to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
            out[:, i] = np.minimum(np.searchsorted(np.array(edges), values), max(len(edges) - 1, 0))
    return out


def coded(bins: Bins) -> list[Column]:
    return [F.col(c).cast("string" if c in bins.named else "double").alias(f"_code_{i}") for i, c in enumerate(bins.columns)]


def quick_session(spark: SparkSession) -> SparkSession:
    """A session of the same application for many small jobs in a row, whose plans are not adapted as they run.

    The caller's session keeps its settings.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.adaptive.enabled", "false")
    return session


#: Rows of a cell that are fitted, by label, and that are held back, by label.
COUNTS = ("n0", "n1", "h0", "h1")
_PACKED = "block long, n int, codes binary, w binary, n0 binary, n1 binary, h0 binary, h1 binary"


def _vectors(bins: Bins) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row's bins as two bytes a column."""
        for batch in batches:
            raw, n = codes_of(bins, batch).astype("<u2").tobytes(), 2 * len(bins.columns)
            vector = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(np.arange(0, len(raw) + 1, n, dtype=np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([vector, *(batch.column(c) for c in ("_y", "_w", "_held"))], ["vector", "y", "w", "held"])

    return run


def cells_of(rows: DataFrame, bins: Bins, label: str, weight: str | None, held: Column | None) -> DataFrame:
    """``vector, w`` and the number of rows of each, fitted or held back and by label."""
    one, back = F.col(weight).cast("double") if weight else F.lit(1.0), F.lit(False) if held is None else held
    wide = rows.select(*coded(bins), F.col(label).cast("double").alias("_y"), one.alias("_w"), back.cast("int").alias("_held"))
    found = wide.mapInArrow(_vectors(bins), "vector binary, y double, w double, held int")
    own = [F.count_if((F.col("held") == back) & ((F.col("y") > 0) if y else ~(F.col("y") > 0))).alias(c) for c, (back, y) in zip(COUNTS, ((0, 0), (0, 1), (1, 0), (1, 1)), strict=True)]
    return found.groupBy("vector", "w").agg(*own)


def _columns_of(vector: pa.Array, width: int) -> np.ndarray:
    """Vectors as an array of rows and columns."""
    return np.frombuffer(b"".join(vector.to_pylist()), "<u2").reshape(-1, width)


def _pack(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block of cells: their codes, weights and counts."""
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                numbers = [part.column(c).to_numpy(zero_copy_only=False).astype(float).tobytes() for c in ("w", *COUNTS)]
                cols = [[part.column("block")[0].as_py()], [part.num_rows], [_columns_of(part.column("vector"), width).astype(np.int32).tobytes()], *[[x] for x in numbers]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), *[pa.binary()] * 6), strict=True)], ["block", "n", "codes", "w", *COUNTS])

    return run


def _pack_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each set of columns with all of its cells, at most CELLS; rows come in the order of sets."""

    def packed(own: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        numbers = [[whole.column(c).to_numpy(zero_copy_only=False).astype(float).tobytes()] for c in ("w", *COUNTS)]
        return pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.array([whole.num_rows], pa.int32()), pa.array([b"".join(whole.column("vector").to_pylist())]), *map(pa.array, numbers)], ["set", "n", "codes", "w", *COUNTS])

    own, parts = -1, []
    for batch in batches:
        sets = batch.column("set").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(sets)) + 1), len(sets)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a < b:
                if parts and sets[a] != own:
                    yield packed(own, parts)
                    parts = []
                own = int(sets[a])
                parts.append(batch.slice(a, b - a))
    if parts:
        yield packed(own, parts)


class _Forest(NamedTuple):
    """Trees of the configurations of one part as joined arrays; ``roots`` has a row a step and a column a configuration."""

    column: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: np.ndarray


def _join(trees: Sequence[Sequence[Tree]]) -> _Forest:
    """Node 0 is a leaf of value 0, for configurations with fewer trees."""
    parts = [Tree(*[np.zeros(1, np.int32)] * 5, np.zeros(1), 0)]
    steps, at = max((len(t) for t in trees), default=0), 1
    roots, depth = np.zeros((steps, len(trees)), np.int32), np.zeros(steps, np.int32)
    for i, own in enumerate(trees):
        for k, t in enumerate(own):
            roots[k, i], depth[k] = at, max(depth[k], t.depth)
            parts.append(t._replace(left=t.left + at, right=t.right + at))
            at += len(t.value)
    return _Forest(*[np.concatenate([p[i] for p in parts]) for i in range(6)], roots, depth)


def _walk(forest: _Forest, codes: np.ndarray, step: int) -> np.ndarray:
    """The node that each row (rows) reaches in each configuration's tree (columns)."""
    n, width = codes.shape
    flat, first = codes.ravel(), (np.arange(n, dtype=np.int64) * width)[:, None]
    node = np.broadcast_to(forest.roots[step], (n, forest.roots.shape[1]))
    for _ in range(forest.depth[step]):
        code = flat[first + forest.column[node]]
        node = np.where((code >= forest.lo[node]) & (code <= forest.hi[node]), forest.right[node], forest.left[node])
    return node


class _Work(NamedTuple):
    """What the tasks of one part do in a pass.

    ``runs`` are the configurations that still grow and ``columns`` their places in the saved
    sums, ``done`` their trees since these were saved, ``grown`` the trees that grow, ``slot``
    the slot of a node of these (or -1), and ``fresh`` marks those at the root.
    """

    runs: list[int]
    columns: list[int]
    base: float
    done: _Forest
    grown: _Forest
    slot: np.ndarray
    slots: list[tuple[int, int]]
    fresh: list[bool]


def _sent(work: list[_Work]) -> list[tuple]:
    """Plain values, as executors need not have this package's classes."""
    return [tuple(tuple(x) if isinstance(x, _Forest) else x for x in w) for w in work]


def _received(plain: tuple) -> _Work:
    return _Work(*[_Forest(*x) if isinstance(x, tuple) else x for x in plain])


def _margins(record: Mapping, work: _Work) -> tuple[np.ndarray, np.ndarray]:
    """Codes and log-odds less the base of a block's rows."""
    n = record["n"]
    codes = np.frombuffer(record["codes"], np.int32).reshape(n, -1)
    sums = np.frombuffer(record["sums"]).reshape(n, -1)[:, work.columns]
    for k in range(len(work.done.roots)):
        sums += work.done.value[_walk(work.done, codes, k)]
    return codes, sums


def _settle(shared: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks with the sums of all finished trees, for the configurations that still grow."""
        for batch in batches:
            sums = [_margins(r, _received(shared.value[r["part"]]))[1].tobytes() for r in batch.to_pylist()]
            yield batch.set_column(batch.schema.get_field_index("sums"), "sums", pa.array(sums, pa.binary()))

    return run


_SUMS = "run int, node int, sums binary"


def _derivatives(sums: np.ndarray, w: np.ndarray, n0: np.ndarray, n1: np.ndarray, h0: np.ndarray, h1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of cells with these log-odds: gradients, second derivatives and rows, and the loss and number of the rows held back."""
    rate, n = 1 / (1 + np.exp(-sums)), n0 + n1
    first = n0 * np.rint(rate * w / UNIT) + n1 * np.rint((rate - 1) * w / UNIT)
    back = (h0 + h1 > 0).ravel()
    kept, loss = sums[back], np.zeros((2, *sums.shape[1:]))
    loss[0] = (h0[back] * np.rint(np.logaddexp(0, kept) / UNIT) + h1[back] * np.rint(np.logaddexp(0, -kept) / UNIT)).sum(axis=0)
    loss[1] = (h0 + h1).sum()
    return first, n * np.rint(rate * (1 - rate) * w / UNIT), n, loss


def _add(total: np.ndarray, loss: np.ndarray, record: Mapping, codes: np.ndarray, sums: np.ndarray, work: _Work, sizes: Sequence[int]) -> None:
    """Add a block's gradients, second derivatives and rows by slot and bin, and the losses of its rows held back."""
    w, *counts = (np.frombuffer(record[c])[:, None] for c in ("w", *COUNTS))
    sums = sums + work.base
    first, second, n, found = _derivatives(sums, w, *counts)
    loss += found
    slot = work.slot[_walk(work.grown, codes, 0)]
    rows, runs = np.nonzero((slot >= 0) & (n > 0))
    slot, first, second, n, at = slot[rows, runs], first[rows, runs], second[rows, runs], n[rows, 0], 0
    for c, size in enumerate(sizes):
        place, end = slot * size + codes[rows, c], at + len(work.slots) * size
        for k, values in enumerate((first, second, n)):
            total[k, at:end] += np.bincount(place, values, end - at)
        at = end


def _by_node(total: np.ndarray, work: _Work, sizes: Sequence[int]) -> np.ndarray:
    """The sums of ``_add`` as (slot, kind, bin of all columns)."""
    parts, at = [], 0
    for size in sizes:
        end = at + len(work.slots) * size
        parts.append(total[:, at:end].reshape(3, -1, size))
        at = end
    return np.concatenate(parts, axis=2).swapaxes(0, 1)


def _grow(shared: Broadcast, sizes: list[int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums by configuration and node; node -1 has the loss of the rows held back, and their number."""
        held: dict[int, tuple[_Work, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for record in batch.to_pylist():
                part = record["part"]
                if part not in held:
                    work = _received(shared.value[part])
                    held[part] = work, np.zeros((3, len(work.slots) * sum(sizes))), np.zeros((2, len(work.runs)))
                work, total, loss = held[part]
                if work.runs:
                    _add(total, loss, record, *_margins(record, work), work, sizes)
        for work, total, loss in held.values():
            keys = [*work.slots, *((r, -1) for r, new in zip(work.runs, work.fresh, strict=True) if new)]
            sums = [*(x.tobytes() for x in _by_node(total, work, sizes)), *(x.tobytes() for x, new in zip(loss.T, work.fresh, strict=True) if new)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(sums, pa.binary())], ["run", "node", "sums"])

    return run


_SPLIT = ["gain", "column", "lo", "hi", "g_left", "h_left", "n_left", "g_right", "h_right", "n_right"]
_FOUND = f"run int, node int, {', '.join(f'{c} double' for c in _SPLIT)}"


class Cuts(NamedTuple):
    """Of the bins of all columns: their column, the codes that a split there sends to the right, whether it is one, and whether it is one level."""

    column: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    valid: np.ndarray
    level: np.ndarray
    last: np.ndarray
    first: int


def cuts_of(sizes: Sequence[int], named: Sequence[bool]) -> Cuts:
    """A split of a number sends the bins above one to the right, that of a name one level; neither unknown levels nor all bins are one."""
    column, code = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])
    size, level = np.array(sizes)[column], np.array(named, bool)[column]
    return Cuts(column, np.where(level, code, code + 1).astype(float), np.where(level, code, size).astype(float), code < size - 1, level, np.cumsum(sizes)[column] - 1, sizes[0])


def best_splits(sums: np.ndarray, cuts: Cuts, allowed: np.ndarray | bool, leaf: np.ndarray) -> np.ndarray:
    """For nodes' sums (node, gradient / second derivative / rows, bin of all columns) a row of _SPLIT; a gain of 0 is none.

    ``allowed`` has a row a node and a column a column of the table.
    """
    up = np.cumsum(sums, axis=2)  # whole numbers, so differences are exact
    right = np.where(cuts.level, sums, up[:, :, cuts.last] - up)
    whole = up[:, :, cuts.first - 1 : cuts.first]
    left = whole - right
    ok = cuts.valid & (np.minimum(left[:, 2], right[:, 2]) >= leaf[:, None]) & (np.minimum(left[:, 1], right[:, 1]) * UNIT >= LEAST_WEIGHT)
    if not isinstance(allowed, bool):
        ok &= allowed[:, cuts.column]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = UNIT * (left[:, 0] ** 2 / left[:, 1] + right[:, 0] ** 2 / right[:, 1] - whole[:, 0] ** 2 / whole[:, 1])
    gain = np.where(ok & (gain > 0), gain, 0.0)
    best, rows = gain.argmax(axis=1), np.arange(len(sums))
    parts = [gain[rows, best], cuts.column[best], cuts.lo[best], cuts.hi[best], *left[rows, :, best].T, *right[rows, :, best].T]
    parts[4:6], parts[7:9] = [x * UNIT for x in parts[4:6]], [x * UNIT for x in parts[7:9]]
    return np.stack(parts, axis=1)


def _choose(sizes: list[int], named: list[bool], allowed: np.ndarray, leaf: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best split of each node, and for node -1 the mean loss."""
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r, node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(raw)
                held[r, node] = held[r, node] + x if (r, node) in held else x
        keys = [k for k in held if k[1] >= 0]
        rows = [[*k, _mean_loss(held[k]), *[0.0] * (len(_SPLIT) - 1)] for k in held if k[1] < 0]
        if keys:
            runs = np.array([k[0] for k in keys])
            found = best_splits(np.stack([held[k] for k in keys]).reshape(len(keys), 3, -1), cuts_of(sizes, named), allowed[runs], leaf[runs])
            rows += [[*k, *x] for k, x in zip(keys, found.tolist(), strict=True)]
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:2]), *(pa.array(c, pa.float64()) for c in cols[2:])], ["run", "node", *_SPLIT])

    return run


def _mean_loss(sums: np.ndarray) -> float:
    return float(sums[0] * UNIT / max(sums[1], 1))


class _Growth:
    """The tree that one configuration grows, best first."""

    def __init__(self, config: Config) -> None:
        self.config = config
        self.start()

    def start(self) -> None:
        self.depth, self.stats, self.children, self.split = [0], [(0.0, 0.0, 0.0)], {}, {}
        self.asked = [0]

    def may_split(self, node: int) -> bool:
        return (self.config.depth is None or self.depth[node] < self.config.depth) and self.stats[node][2] >= 2 * self.config.leaf

    def chosen(self) -> list[int]:
        """Nodes in the order in which they are split, as far as their splits are known."""
        out, heap = [], []

        def push(node: int) -> None:
            if node in self.split and self.split[node][0] > 0:
                heappush(heap, (-self.split[node][0], node))

        push(0)
        while heap and len(out) < LEAVES - 1:
            node = heappop(heap)[1]
            out.append(node)
            for child in self.children.get(node, ()):
                push(child)
        return out

    def take(self, found: dict[int, list[float]]) -> bool:
        """Go on with the splits of the nodes asked for; False when the tree is done.

        A node that is not chosen now never is, as later splits only compete with it.
        """
        self.split |= found
        if 0 in found:
            x = found[0]
            self.stats[0] = (x[4] + x[7], x[5] + x[8], x[6] + x[9])
        self.asked = []
        for node in self.chosen():
            if node not in self.children:
                x, pair = self.split[node], []
                for k in (4, 7):
                    pair.append(len(self.depth))
                    self.depth.append(self.depth[node] + 1)
                    self.stats.append(tuple(x[k : k + 3]))
                self.children[node] = pair
                self.asked += [c for c in pair if self.may_split(c)]
        return bool(self.asked)

    def tree(self, grown: bool = False) -> Tree:
        """The tree of the chosen splits; with ``grown``, of all splits made so far, nodes keeping their numbers."""
        split = list(self.children) if grown else self.chosen()
        number = {n: n for n in range(len(self.depth))} if grown else {n: i for i, n in enumerate([0, *(c for n in split for c in self.children[n])])}
        size = len(number)
        column, lo, hi = (np.zeros(size, np.int32) for _ in range(3))
        left, right, value = np.arange(size, dtype=np.int32), np.arange(size, dtype=np.int32), np.zeros(size)
        deepest = 0
        for node in split:
            x, i = self.split[node], number[node]
            column[i], lo[i], hi[i] = int(x[1]), int(x[2]), int(x[3])
            left[i], right[i] = (number[c] for c in self.children[node])
            deepest = max(deepest, self.depth[node] + 1)
        for node, i in number.items():
            g, h, _ = self.stats[node]
            value[i] = -self.config.rate * g / h if h > 0 else 0.0
        return Tree(column, lo, hi, left, right, value, deepest)


def ends(losses: Sequence[float], patience: int = PATIENCE, least: float = LEAST_GAIN) -> bool:
    """Whether none of the last ``patience`` losses is smaller than the one before them."""
    return len(losses) > patience and min(losses[-patience:]) >= losses[-patience - 1] - least


class _Fits:
    """Fits that grow together: ``advance`` takes what a pass over the rows has found for the nodes that ``work`` asks for."""

    def __init__(self, configs: Sequence[Config], base: float, stops: bool) -> None:
        self.models, self.growth = [Model(c, base) for c in configs], [_Growth(c) for c in configs]
        self.base, self.stops, self.live = base, stops, {i for i, c in enumerate(configs) if c.trees > 0}

    def work(self, own: list[int], saved: Sequence[int]) -> _Work:
        """``own`` are the configurations of a part's columns, ``saved`` the trees that are in the saved sums."""
        runs = [r for r in own if r in self.live]
        grown = _join([[self.growth[r].tree(grown=True)] for r in runs])
        slot, slots = np.full(len(grown.value), -1, np.int32), []
        for i, r in enumerate(runs):
            for node in self.growth[r].asked:
                slot[grown.roots[0, i] + node] = len(slots)
                slots.append((r, node))
        done = _join([self.models[r].trees[saved[r] :] for r in runs])
        return _Work(runs, [own.index(r) for r in runs], self.base, done, grown, slot, slots, [self.growth[r].asked == [0] for r in runs])

    def advance(self, splits: Mapping[int, dict[int, list[float]]]) -> list[int]:
        """The fits that have a new tree."""
        out = []
        for r in sorted(self.live):
            found, model = splits.get(r, {}), self.models[r]
            if -1 in found:
                model.losses.append(found.pop(-1)[0])
                if self.stops and ends(model.losses):
                    self.live.discard(r)
                    continue
            if not self.growth[r].take(found):
                model.trees.append(self.growth[r].tree())
                model.last, model.stats = self.growth[r].chosen(), self.growth[r].stats
                self.growth[r].start()
                out.append(r)
                if len(model.trees) == model.config.trees:
                    self.live.discard(r)
        return out


class Joint(NamedTuple):
    """Columns whose bins are taken together, and what one bin of each adds to their joint code."""

    columns: list[int]
    strides: list[int]
    sizes: list[int]
    size: int


def joints(sizes: Sequence[int]) -> list[Joint]:
    """All columns in few sets of at most JOINT joint bins, or of one column."""
    out: list[list[int]] = []
    for c in sorted(range(len(sizes)), key=lambda c: -sizes[c]):
        own = next((g for g in out if np.prod([sizes[x] for x in g]) * sizes[c] <= JOINT), None)
        if own is None:
            out.append([c])
        else:
            own.append(c)
    return [Joint(g, [int(np.prod([sizes[x] for x in g[k + 1 :]])) for k in range(len(g))], [sizes[x] for x in g], int(np.prod([sizes[x] for x in g]))) for g in out]


class _Table:
    """The cells of one configuration's columns, in the task that fits it."""

    def __init__(self, record: Mapping, sizes: Sequence[int]) -> None:
        self.codes = np.ascontiguousarray(np.frombuffer(record["codes"], "<u2").reshape(record["n"], len(sizes)).T)
        self.w, *self.counts = (np.frombuffer(record[c]) for c in ("w", *COUNTS))
        self.joints, self.starts = joints(sizes), np.cumsum([0, *sizes]).tolist()
        self.places = [sum(self.codes[c].astype(np.intp) * k for c, k in zip(j.columns, j.strides, strict=True)) for j in self.joints]
        #: Bins of all columns, a row a cell.
        self.single = np.ascontiguousarray(self.codes.T.astype(np.intp) + np.array(self.starts[:-1]))
        #: Cells of a part from which on fewer sums by joint codes cost less than the adding up of these.
        self.many = 4 * sum(j.size for j in self.joints) / max(1, len(sizes) - len(self.joints))

    def sums(self, values: Sequence[np.ndarray], parts: list[np.ndarray]) -> np.ndarray:
        """The sums of ``values`` over each of ``parts`` (None: all cells) by the bins of all columns, as (part, value, bin)."""
        size = self.starts[-1]
        out = np.empty((len(parts), len(values), size))
        whole = len(parts) == 1 and len(parts[0]) == len(self.w)
        rows = None if whole else np.concatenate(parts)
        slot = None if len(parts) == 1 else np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        values = values if whole else [x[rows] for x in values]
        if sum(map(len, parts)) <= self.many * len(parts):
            at = self.single if whole else self.single[rows]
            at = (at if slot is None else at + (slot * size)[:, None]).ravel()
            for k, x in enumerate(values):
                out[:, k] = np.bincount(at, np.repeat(x, self.single.shape[1]), len(parts) * size).reshape(len(parts), size)
            return out
        for j, place in zip(self.joints, self.places, strict=True):
            at = place if whole else place[rows]
            at = at if slot is None else at + slot * j.size
            for k, x in enumerate(values):
                found = np.bincount(at, x, len(parts) * j.size).reshape(len(parts), *j.sizes)
                for i, c in enumerate(j.columns):
                    others = tuple(a + 1 for a in range(len(j.columns)) if a != i)
                    out[:, k, self.starts[c] : self.starts[c + 1]] = found.sum(axis=others) if others else found
        return out


def joined(second: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float] | None:
    """Second derivatives and rows as one number a cell, and what a row adds to it; None if their sums are not exact so.

    Both are whole numbers, and all second derivatives together are less than one row.
    """
    whole = second.sum()
    unit = 2.0 ** np.ceil(np.log2(whole + 1))
    return (second + n * unit, unit) if second.min(initial=0) >= 0 and whole < unit and (n.sum() + 1) * unit < 2.0**53 else None


def parted(sums: np.ndarray, unit: float) -> np.ndarray:
    """Sums of gradients and of ``joined`` numbers (second axis) as those of gradients, second derivatives and rows."""
    n = np.floor(sums[:, 1] * (1 / unit))
    return np.stack([sums[:, 0], sums[:, 1] - n * unit, n], axis=1)


def grow_alone(config: Config, table: _Table, base: float, stops: bool, cuts: Cuts) -> Model:
    """All passes of one configuration over cells in memory.

    A node keeps its cells, and of two children the one with fewer is summed, the other is the rest of their parent.
    """
    fits, sums = _Fits([config], base, stops), np.zeros(len(table.w))
    everyone, growth, model = np.arange(len(sums)), fits.growth[0], fits.models[0]
    leaf = float(config.leaf)

    def divide(children: Mapping[int, list[int]], splits: Mapping[int, list[float]]) -> list[int]:
        """Give the cells of nodes that have been split to their children; these nodes."""
        new = [k for k in children if children[k][0] not in own]
        for node in new:
            x, rows = splits[node], own[node]
            code = table.codes[int(x[1])][rows]
            right = code - np.uint16(x[2]) <= np.uint16(x[3] - x[2])  # codes below the range wrap around
            own[children[node][0]], own[children[node][1]] = rows[~right], rows[right]
        return new

    def summed(parts: list[np.ndarray]) -> np.ndarray:
        found = table.sums(values, parts)
        return parted(found, both[1]) if both else found

    while fits.live:
        if growth.asked == [0]:  # a new tree
            first, second, n, loss = _derivatives(sums + base, table.w, *table.counts)
            if stops and ends([*model.losses, _mean_loss(loss)]):
                model.losses.append(_mean_loss(loss))
                break
            both, own, known = joined(second, n), {0: everyone}, {}
            values = (first, both[0]) if both else (first, second, n)
            found = {0: summed([everyone])[0]}
        else:
            found, parts, rest = {}, [], []
            for node in divide(growth.children, growth.split):
                if any(c in growth.asked for c in growth.children[node]):
                    less, more = sorted(growth.children[node], key=lambda c: len(own[c]))
                    parts.append(less)
                    rest.append((less, more, node))
            for (less, more, node), x in zip(rest, summed([own[c] for c in parts]), strict=True):
                found[less], found[more] = x, known[node] - x
        known |= found
        asked = list(growth.asked)
        best = best_splits(np.stack([known[c] for c in asked]), cuts, True, np.full(len(asked), leaf)).tolist()
        splits = dict(zip(asked, best, strict=True))
        if 0 in splits:
            splits[-1] = [_mean_loss(loss)]
        children, made = growth.children, growth.split
        if fits.advance({0: splits}):
            divide(children, made)
            done = set(model.last)
            for node in [0, *(c for k in done for c in children[k])]:
                if node not in done:
                    g, h, _ = model.stats[node]
                    sums[own[node]] += -config.rate * g / h if h > 0 else 0.0
    return model


def _fit_alone(configs: Sequence[Config], columns: Sequence[Sequence[int]], base: float, stops: bool, sizes: list[int], named: list[bool]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Trees, as joined arrays, and losses of each configuration."""
        for batch in batches:
            for record in batch.to_pylist():
                r = record["run"]
                own = [sizes[c] for c in columns[r]]
                m = grow_alone(configs[r], _Table(record, own), base, stops, cuts_of(own, [named[c] for c in columns[r]]))
                place = np.array(columns[r], np.int32)
                trees = [t._replace(column=place[t.column]) for t in m.trees]
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([pickle.dumps(_flat(trees))], pa.binary()), pa.array([m.losses], pa.list_(pa.float64()))], ["run", "trees", "losses"])

    return run


def _flat(trees: Sequence[Tree]) -> tuple:
    return ([len(t.value) for t in trees], [t.depth for t in trees], *[np.concatenate([t[i] for t in trees]) if trees else np.zeros(0) for i in range(6)])


def _trees(flat: tuple) -> list[Tree]:
    sizes, depths, *fields = flat
    at = np.cumsum(sizes)[:-1]
    parts = [np.split(x, at) if sizes else [] for x in fields]
    return [Tree(*x, d) for *x, d in zip(*parts, depths, strict=True)]


def fit_many(train: DataFrame, bins: Bins, configs: Sequence[Config], label: str = "y", weight: str | None = None, held: Column | None = None, groups: int | None = None) -> list[Model]:
    """A model for each configuration, fitted on ``train`` without the rows ``held`` back, which end the fits early.

    Without rows held back all trees are grown. Rows are counted by their bins first, for each set of
    columns on its own: configurations of a set with at most CELLS cells are a task each, that goes through
    all passes. Others share passes over the blocks of all cells; ``groups`` parts of them are dealt to tasks of
    their own, by default as many as keep all cores busy. Models do not depend on any of this.
    """
    spark = train.sparkSession
    cells = cut(cells_of(train, bins, label, weight, held))
    ones, zeros = F.sum(F.col("w") * F.col("n1")), F.sum(F.col("w") * F.col("n0"))
    total = cells.agg(ones.alias("ones"), (ones + zeros).alias("all"), F.count(F.lit(1)).alias("n")).first()
    share = min(max((total.ones or 0) / (total["all"] or 1), 1e-9), 1 - 1e-9)
    base = float(np.log(share / (1 - share)))
    models = [Model(c, base) for c in configs]
    if not 1e-9 < share < 1 - 1e-9:  # one class only
        dropped(cells)
        return models
    sizes, named = [bins.size(c) for c in bins.columns], [c in bins.named for c in bins.columns]
    columns = [tuple(i for i, c in enumerate(bins.columns) if c in x.columns) for x in configs]
    sets = list(dict.fromkeys(columns))
    parts = [F.struct(F.lit(i).alias("set"), F.concat(*[F.substring("vector", 2 * c + 1, 2) for c in own]).alias("vector")) for i, own in enumerate(sets)]
    each = cut(cells.select(F.inline(F.array(*parts)), "w", *COUNTS).groupBy("set", "vector", "w").agg(*[F.sum(c).alias(c) for c in COUNTS]))
    few = {r["set"] for r in each.groupBy("set").count().where(F.col("count") <= CELLS).collect()}  # a row a set of columns
    alone = [r for r, own in enumerate(columns) if sets.index(own) in few]
    alone.sort(key=lambda r: (configs[r].rate, -(configs[r].depth or LEAVES)))  # the longest fits begin first
    if alone:
        runs = F.array(*[F.array(*[F.lit(r) for r in alone if columns[r] == own]).cast("array<int>") for own in sets])
        packed = each.where(F.col("set").isin(*few)).repartition(len(sets), "set").sortWithinPartitions("set").mapInArrow(_pack_sets, "set int, n int, codes binary, w binary, n0 binary, n1 binary, h0 binary, h1 binary")
        dealt = cut(packed).withColumn("run", F.explode(F.get(runs, F.col("set"))))
        place = F.get(F.array(*[F.lit(alone.index(r) if r in alone else 0) for r in range(len(configs))]), F.col("run"))
        kernel = _fit_alone(configs, columns, base, held is not None, sizes, named)
        found = dealt.repartitionById(len(alone), place).mapInArrow(kernel, "run int, trees binary, losses array<double>").toArrow()  # a row a configuration
        for r, trees, losses in zip(*(c.to_pylist() for c in found.columns), strict=True):
            models[r].trees, models[r].losses = _trees(pickle.loads(trees)), losses
    dropped(each)
    if rest := [r for r in range(len(configs)) if r not in alone]:
        for r, m in zip(rest, _fit_spread(cells, bins, [configs[r] for r in rest], base, total.n, held is not None, groups), strict=True):
            models[r] = m
    dropped(cells)
    return models


def _fit_spread(cells: DataFrame, bins: Bins, configs: Sequence[Config], base: float, n: int, stops: bool, groups: int | None) -> list[Model]:
    """Models of configurations with many cells, by passes over blocks of these."""
    spark = cells.sparkSession
    sizes, named = [bins.size(c) for c in bins.columns], [c in bins.named for c in bins.columns]
    blocks = cells.withColumn("block", F.monotonically_increasing_id()).coalesce(-(-n // BLOCK))
    packed, session = cut(blocks.mapInArrow(_pack(len(sizes)), _PACKED)), quick_session(spark)
    size, cores = packed.count(), spark.sparkContext.defaultParallelism
    groups = min(len(configs), groups or max(1, -(-cores // size)))
    of_part = [list(range(g, len(configs), groups)) for g in range(groups)]
    wide = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    parts = max(groups, min(size * groups, max(4 * cores, size * groups // 64)))
    wide = wide.repartitionById(parts, F.pmod(F.xxhash64("block") % 1_000_003 * groups + F.col("part"), F.lit(parts)).cast("int"))
    allowed, leaf = np.array([[c in x.columns for c in bins.columns] for x in configs]), np.array([x.leaf for x in configs], float)
    fits = _Fits(configs, base, stops)
    zeros = F.repeat(F.lit("\0"), (F.col("n") * F.get(F.array(*[F.lit(len(x)) for x in of_part]), F.col("part")) * 8).cast("int")).cast("binary")
    state = cut(wide.withColumn("sums", zeros), session)
    dropped(packed)
    saved = [0] * len(configs)
    while fits.live:
        shared = spark.sparkContext.broadcast(_sent([fits.work(own, saved) for own in of_part]))
        if max(len(fits.models[r].trees) - saved[r] for r in fits.live) >= SAVED:
            old, state = state, cut(state.mapInArrow(_settle(shared), f"{_PACKED}, part int, sums binary"), session)
            dropped(old)
            shared.destroy()
            of_part = [[r for r in own if r in fits.live] for own in of_part]
            saved = [len(m.trees) for m in fits.models]
            shared = spark.sparkContext.broadcast(_sent([fits.work(own, saved) for own in of_part]))
        sums = state.mapInArrow(_grow(shared, sizes), _SUMS).repartition(min(groups, cores), "run")
        found = sums.mapInArrow(_choose(sizes, named, allowed, leaf), _FOUND).toArrow()  # a row a node
        shared.destroy()
        splits: dict[int, dict[int, list[float]]] = {}
        for r, node, *x in zip(*(c.to_pylist() for c in found.columns), strict=True):
            splits.setdefault(r, {})[node] = x
        fits.advance(splits)
    dropped(state)
    return fits.models


#: Places of the lowest bit of a number of 32 bits, by its product with a constant of de Bruijn.
_BRUIJN = np.uint32(0x077CB531)


def leaf_masks(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """For each node the bits of the leaves left of it that a row loses which goes right there, and the values by place of the lowest bit left.

    Leaves are bits from left to right. A row is in the lowest leaf that no node at which it goes right has
    taken, whether it comes through that node or not.
    """
    masks, order, stack, values = np.zeros(len(tree.value), np.uint32), [], [0], []
    left, right = tree.left.tolist(), tree.right.tolist()
    spans: dict[int, int] = {}
    while stack:
        node = stack.pop()
        if node < 0:  # the left side of ~node is done
            order.append((~node, spans[~node], len(values)))
        elif left[node] == node:
            values.append(tree.value[node])
        else:
            spans[node] = len(values)
            stack += [right[node], ~node, left[node]]
    for node, a, b in order:
        masks[node] = (1 << b) - (1 << a)
    table = np.zeros(32)
    bits = np.uint32(1) << np.arange(len(values), dtype=np.uint32)
    table[(bits * _BRUIJN) >> np.uint32(27)] = values
    return masks, table


def _tables(tree: Tree, sizes: Sequence[int], sets: Sequence[Joint]) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """For the sets of columns that a tree splits, the bits that each joint code keeps; and the values."""
    masks, values = leaf_masks(tree)
    own: dict[int, np.ndarray] = {}
    for node in np.flatnonzero(masks):
        c = int(tree.column[node])
        if c not in own:
            own[c] = np.full(sizes[c], 0xFFFFFFFF, np.uint32)
        own[c][tree.lo[node] : tree.hi[node] + 1] &= ~masks[node]
    out = []
    for i, j in enumerate(sets):
        if any(c in own for c in j.columns):
            found = np.full(j.sizes, 0xFFFFFFFF, np.uint32)
            for k, c in enumerate(j.columns):
                if c in own:
                    found &= own[c].reshape([-1 if a == k else 1 for a in range(len(j.columns))])
            out.append((i, found.ravel()))
    return out, values


def score_many(df: DataFrame, bins: Bins, points: Sequence[tuple[Model, int]], keep: Sequence[str], out: str = "scores") -> DataFrame:
    """``keep`` and an array of the probabilities of each model with its first trees, rounded to nine digits.

    Models are broadcast: a tree has at most 2 LEAVES - 1 nodes of 28 bytes.
    """
    whole: list[Model] = []
    for m, _ in points:
        if not any(m is x for x in whole):
            whole.append(m)
    place = [next(i for i, x in enumerate(whole) if x is m) for m, _ in points]
    lengths = [min(n, len(m.trees)) for m, n in points]
    longest = [max((n for p, n in zip(place, lengths, strict=True) if p == i), default=0) for i in range(len(whole))]
    shared = df.sparkSession.sparkContext.broadcast([(m.base, _flat(m.trees[:n])) for m, n in zip(whole, longest, strict=True)])
    names, used, sizes = list(keep), {c for m in whole for c in m.config.columns}, [bins.size(c) for c in bins.columns]
    wanted = [{n: [j for j, (p, k) in enumerate(zip(place, lengths, strict=True)) if p == i and k == n] for n in set(lengths)} for i in range(len(whole))]

    def score(rows: pa.RecordBatch) -> pa.RecordBatch:
        codes, sets = codes_of(bins, rows), joints([n if c in used else 1 for c, n in zip(bins.columns, sizes, strict=True)])
        at = [sum(codes[:, c].astype(np.intp) * k for c, k, n in zip(j.columns, j.strides, j.sizes, strict=True) if n > 1) + np.zeros(rows.num_rows, np.intp) for j in sets]
        result = np.empty((rows.num_rows, len(points)))
        for (base, flat), own in zip(shared.value, wanted, strict=True):
            sums, trees = np.full(rows.num_rows, base), _trees(flat)
            for k in range(len(trees) + 1):
                for i in own.get(k, ()):
                    result[:, i] = sums
                if k < len(trees):
                    found, values = _tables(trees[k], sizes, sets)
                    bits = None
                    for i, table in found:
                        bits = table[at[i]] if bits is None else bits & table[at[i]]
                    sums += values[(np.uint32(1) * _BRUIJN) >> np.uint32(27)] if bits is None else values[((bits & (~bits + np.uint32(1))) * _BRUIJN) >> np.uint32(27)]
        scores = np.round(1 / (1 + np.exp(-result)), 9)
        width = np.arange(0, scores.size + 1, len(points), dtype=np.int32)
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.ListArray.from_arrays(pa.array(width), pa.array(scores.ravel()))], [*names, out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches are joined, as each of them needs the tables of all trees."""
        parts, n = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, SCORED):
                parts.append(batch.slice(a, SCORED))
                n += parts[-1].num_rows
                if n >= SCORED:
                    yield score(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])
                    parts, n = [], 0
        if n:
            yield score(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])

    kept = df.select(*names, *coded(bins))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema)
    return kept.mapInArrow(run, f"{schema}, {out} array<double>")
