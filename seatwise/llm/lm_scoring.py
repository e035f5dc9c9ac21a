"""Masked pseudo-likelihood of documents under a bidirectional window network in numpy.

A word's class is the first 11 bits of its hash. A class is predicted from the two words on
either side, as group and then member of the group, so that a prediction costs 96 outputs
rather than 2048; the word is then predicted from its class, by the counts of all words of the
corpus. Documents are dealt by a hash of id and text into buckets of about BUCKET_ROWS, and in
each round every bucket trains the network on its share of the round, in the order of the hash;
the rounds' shares are all documents. The buckets' weights are averaged on the executors, and
the next round starts from the mean, so the result does not depend on how the table is stored.
The last mean scores every word of every text from both sides.

Counts of the HEAD most frequent words are broadcast; all other words that occur more than once
meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbuf
from .decontamination import tokens
from .scratch import materialise, shuffle_partitions, table

GROUPS, MEMBERS, WIDTH, HIDDEN = 32, 64, 16, 32
SIDE = (-2, -1, 1, 2)
CLASSES = GROUPS * MEMBERS
#: A round trains on one in ROUNDS documents, another share each round, so that all are trained on.
ROUNDS, BATCH, RATE = 2, 8192, 0.08
SLICES = 8
#: Documents of a bucket, about, and of the mean's fixed-point numbers the unit.
BUCKET_ROWS, UNIT = 4096, 1 << 32
#: Words whose counts are broadcast, at most (16 bytes each).
HEAD = 1 << 18
#: Words with counts that a task holds before it folds them.
HELD = 4_000_000

_SHAPES = {"embed": (CLASSES + 1, WIDTH), "mix": (len(SIDE) * WIDTH, HIDDEN), "bias": (HIDDEN,), "group": (HIDDEN, GROUPS), "group_bias": (GROUPS,), "member": (GROUPS, HIDDEN, MEMBERS), "member_bias": (GROUPS, MEMBERS)}
SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def initial(seed: int = 7) -> np.ndarray:
    flat = np.random.default_rng(seed).normal(0, 0.1, SIZE).astype(np.float32)
    for name in ("bias", "group_bias", "member_bias"):
        views(flat)[name][:] = 0
    return flat


def _windows(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Classes around each word; CLASSES beyond a text's ends."""
    n = len(ids)
    out = np.full((len(SIDE), n), CLASSES)
    for j, d in enumerate(SIDE):
        a, b = (slice(0, max(n - d, 0)), slice(d, n)) if d > 0 else (slice(-d, n), slice(0, max(n + d, 0)))
        out[j, a] = np.where(rows[a] == rows[b], ids[b], CLASSES)
    return out


def _classes(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - (CLASSES.bit_length() - 1))).astype(np.int64)


def _soft(z: np.ndarray) -> np.ndarray:
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def train_step(flat: np.ndarray, seen: np.ndarray, context: np.ndarray, target: np.ndarray) -> None:
    """One Adagrad step on a batch, in place. ``context`` is (sides, n), in the order of groups of ``target``."""
    p, grad = views(flat), np.zeros(SIZE, np.float32)
    g = views(grad)
    n = len(target)
    group, member = target // MEMBERS, target % MEMBERS
    x = np.concatenate([p["embed"][c] for c in context], axis=1)
    h = np.tanh(x @ p["mix"] + p["bias"])
    out = _soft(h @ p["group"] + p["group_bias"])
    out[np.arange(n), group] -= 1
    out /= n
    g["group"][:] = h.T @ out
    g["group_bias"][:] = out.sum(0)
    dh = out @ p["group"].T
    bounds = np.searchsorted(group, np.arange(GROUPS + 1))
    for k in range(GROUPS):
        a, b = bounds[k], bounds[k + 1]
        if a < b:
            own = _soft(h[a:b] @ p["member"][k] + p["member_bias"][k])
            own[np.arange(b - a), member[a:b]] -= 1
            own /= n
            g["member"][k] = h[a:b].T @ own
            g["member_bias"][k] = own.sum(0)
            dh[a:b] += own @ p["member"][k].T
    dh *= 1 - h * h
    g["mix"][:] = x.T @ dh
    g["bias"][:] = dh.sum(0)
    dx = dh @ p["mix"].T
    for j, c in enumerate(context):
        order = np.argsort(c.astype(np.int16), kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(c[order]) != 0]))
        g["embed"][c[order[first]]] += np.add.reduceat(dx[order, j * WIDTH : (j + 1) * WIDTH], first, axis=0)
    seen += grad * grad
    flat -= RATE * grad / (np.sqrt(seen) + 1e-6)


def word_scores(flat: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Log-probability of each word's class given the words on both sides."""
    p = views(flat)
    parts = [p["embed"] @ p["mix"][j * WIDTH : (j + 1) * WIDTH] for j in range(len(SIDE))]
    around = _windows(ids, rows)
    out = np.empty(len(ids))
    for a in range(0, len(ids), 1 << 14):
        b = min(a + (1 << 14), len(ids))
        order = np.argsort((ids[a:b] // MEMBERS).astype(np.int16), kind="stable")
        target = ids[a:b][order]
        group, member = target // MEMBERS, target % MEMBERS
        h = p["bias"] + parts[0][around[0, a:b][order]]
        for j in range(1, len(SIDE)):
            h += parts[j][around[j, a:b][order]]
        np.tanh(h, out=h)
        z = h @ p["group"] + p["group_bias"]
        lp = z[np.arange(b - a), group] - np.log(np.exp(z).sum(1))
        bounds = np.searchsorted(group, np.arange(GROUPS + 1))
        for k in range(GROUPS):
            s, e = bounds[k], bounds[k + 1]
            if s < e:
                z = h[s:e] @ p["member"][k] + p["member_bias"][k]
                lp[s:e] += z[np.arange(e - s), member[s:e]] - np.log(np.exp(z).sum(1))
        out[a + order] = lp
    return out


def _class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes of each text's words, two bytes a word."""
    for batch in batches:
        for a, words, rows, n in tokens(batch.column(2)):
            ids = _classes(words).astype(np.uint16)
            bounds = np.searchsorted(rows, np.arange(n + 1)).tolist()
            blobs = [ids[i:j].tobytes() for i, j in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array(blobs, pa.binary())], ["bucket", "key", "ids"])


def _train(start: object) -> Callable:
    """Weights of each bucket after its documents, which come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = seen = at = None
        left: list[np.ndarray] = []
        size = 0

        def steps() -> None:
            nonlocal left, size
            if left:
                x = np.concatenate(left, axis=1)
                for a in range(0, x.shape[1], BATCH):
                    t = x[-1, a : a + BATCH]
                    order = np.argsort((t // MEMBERS).astype(np.int16), kind="stable")
                    train_step(flat, seen, x[:-1, a : a + BATCH][:, order], t[order])
            left, size = [], 0

        def done() -> Iterator[pa.RecordBatch]:
            steps()
            parts = [np.rint(s.astype(np.float64) * UNIT).astype(np.int64).tobytes() for s in np.array_split(flat, SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([1] * SLICES, pa.int64()), pa.array(parts, pa.binary())], ["slice", "n", "weights"])

        for batch in batches:
            bucket = batch.column(0).to_numpy()
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
            for a, b in zip(first, np.append(first[1:], len(bucket)), strict=True):
                if bucket[a] != at:
                    if at is not None:
                        yield from done()
                    flat, seen, at = start.value.copy(), np.full(SIZE, 1e-8, np.float32), bucket[a]
                blobs = batch.column(2).slice(a, b - a).to_pylist()
                ids = np.frombuffer(b"".join(blobs), np.uint16).astype(np.int64)
                rows = np.repeat(np.arange(len(blobs)), [len(x) // 2 for x in blobs])
                left.append(np.concatenate([_windows(ids, rows), ids[None]]))
                size += len(ids)
                while size >= 16 * BATCH:  # whole batches, so that the table's own batches don't matter
                    x = np.concatenate(left, axis=1)
                    left = [x[:, : 16 * BATCH]]
                    steps()
                    left, size = [x[:, 16 * BATCH :]], x.shape[1] - 16 * BATCH
        if at is not None:
            yield from done()

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fixed-point sums, which have no order."""
    total: dict[int, np.ndarray] = {}
    count: dict[int, int] = {}
    for batch in batches:
        for i, n, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total[i] = total.get(i, 0) + np.frombuffer(w, np.int64)
            count[i] = count.get(i, 0) + n
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([count[i] for i in total], pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "n", "weights"])


_WEIGHTS = "slice int, n long, weights binary"


def train(docs: DataFrame) -> np.ndarray:
    """Weights after ROUNDS rounds over ``docs (doc_id, text)``; the initial ones if there are no rows.

    Null and empty texts change nothing but the size of a bucket. Repeated rows all count, and
    lie in one bucket.
    """
    spark, flat = docs.sparkSession, initial()
    buckets = max(1, -(-docs.count() // BUCKET_ROWS))
    key = F.xxhash64("doc_id", "text")
    slim = docs.select(F.pmod(F.shiftrightunsigned(key, 8), F.lit(buckets)).cast("int").alias("bucket"), key.alias("key"), "text")
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(flat)
        dealt = slim.where(F.pmod("key", F.lit(ROUNDS)) == turn).mapInArrow(_class_rows, "bucket int, key long, ids binary")
        dealt = dealt.repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket", "key", "ids")
        rows = dealt.mapInArrow(_train(shared), _WEIGHTS).repartition(SLICES, "slice").mapInArrow(_sum, _WEIGHTS).collect()
        shared.destroy()
        if rows:
            flat = np.concatenate([np.frombuffer(r["weights"], np.int64) / (UNIT * r["n"]) for r in sorted(rows, key=lambda r: r["slice"])]).astype(np.float32)
    return flat


class Vocabulary(NamedTuple):
    words: np.ndarray  # sorted hashes of the HEAD most frequent words of those that occur more than once
    counts: np.ndarray
    classes: np.ndarray  # occurrences of all words of each class
    others: DataFrame | None  # ``word, n`` of the other words that occur more than once


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words and their counts, folded as they gather."""
    held, size = [], 0

    def fold() -> tuple[np.ndarray, np.ndarray]:
        words, which = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        return words, np.bincount(which, np.concatenate([n for _, n in held])).astype(np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        words, counts = fold()
        for a in range(0, len(words), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[a : a + 100_000].view(np.int64)), pa.array(counts[a : a + 100_000])], ["word", "n"])

    for batch in batches:
        for _, words, _, _ in tokens(batch.column(0)):
            held.append(np.unique(words, return_counts=True))
            size += len(held[-1][0])
        if size > HELD:
            held[:] = [fold()]
            size = len(held[0][0])
            if size > HELD // 2:
                yield from out()
                held, size = [], 0
    if held:
        yield from out()


def vocabulary(docs: DataFrame, head: int = HEAD) -> Vocabulary:
    """Counts of all words of ``docs``. Words that occur once need no entry."""
    counted = materialise(docs.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    of_class = F.shiftrightunsigned("word", 64 - (CLASSES.bit_length() - 1))
    classes = np.zeros(CLASSES, np.int64)
    for r in counted.groupBy(of_class.alias("c")).agg(F.sum("n").alias("n")).collect():
        classes[r["c"]] = r["n"]
    several = counted.where("n > 1")
    often = several.orderBy(F.col("n").desc(), "word").limit(head).toArrow()
    words, n = often["word"].to_numpy(), often["n"].to_numpy()
    others = None
    if len(words) == head:
        least, last = int(n[-1]), int(words[-1])
        others = several.where((F.col("n") < least) | ((F.col("n") == least) & (F.col("word") > last)))
    order = np.argsort(words.view(np.uint64))
    return Vocabulary(words.view(np.uint64)[order], n[order], classes, others)


def _known(held: tuple[np.ndarray, np.ndarray], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the words the broadcast counts hold, and their counts (1 for all others)."""
    known, counts = held
    if not len(known):
        return np.zeros(len(words), bool), np.ones(len(words), np.int64)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    found = known[at] == words
    return found, np.where(found, counts[at], 1)


_SCORED = "row long, doc_id long, n_words long, log_likelihood double, others array<struct<word: long, times: int>>"


def _score(model: object, counted: object | None) -> Callable:
    """Log-likelihoods, with the words whose counts are still to come."""
    kind = pa.list_(pa.struct([("word", pa.int64()), ("times", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, words, rows, n in tokens(batch.column(2)):
                lp = word_scores(model.value, _classes(words), rows)
                others = [None] * n
                if counted is not None:
                    *held, classes, more = counted.value
                    found, times = _known(held, words)
                    lp += np.log(times / np.maximum(classes[_classes(words)], times))
                    if more:
                        rest, which = words[~found].view(np.int64), rows[~found]
                        bounds = np.searchsorted(which, np.arange(n + 1)).tolist()
                        for r, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False)):
                            if i < j:
                                own, times = np.unique(rest[i:j], return_counts=True)
                                others[r] = [{"word": w, "times": t} for w, t in zip(own.tolist(), times.tolist(), strict=True)]
                count = np.bincount(rows, minlength=n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array(count), pa.array(np.bincount(rows, weights=lp, minlength=n).astype(np.float64)), pa.array(others, kind)], ["row", "doc_id", "n_words", "log_likelihood", "others"])

    return run


def score_documents(docs: DataFrame, weights: np.ndarray, words: Vocabulary | None = None) -> DataFrame:
    """``doc_id, n_words, log_likelihood, per_word``; without words the sum is 0 and the mean null.

    The likelihood is that of the words, or without ``words`` that of their classes. Null and
    empty texts have no words; repeated rows have one score; an empty table has no rows, and
    other columns do not matter.
    """
    context = docs.sparkSession.sparkContext
    model = context.broadcast(weights)
    counted = None if words is None else context.broadcast((*words[:3], words.others is not None))  # HEAD words at most
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = slim.mapInArrow(_score(model, counted), _SCORED)
    if words is not None and words.others is not None:
        out = materialise(out, "scores")
        each = out.select("row", F.inline("others"))
        more = each.join(words.others, "word").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("more"))
        out = out.join(more, "row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("more", F.lit(0.0)))
    per_word = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return out.select("doc_id", "n_words", "log_likelihood", per_word.alias("per_word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs), vocabulary(docs))
