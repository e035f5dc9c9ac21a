"""Toxicity by two Kneser-Ney character models with a shared base.

Texts become strings of 32 symbols: letters in lower case, the bytes of accented letters, and
one break for all else. Each class has interpolated models of orders 5 to 3 over its own
counts (continuation counts below order 5), which back off to a bigram model of counts pooled
over both classes, so rare expressions differ only as far as their parts do. A document's
evidence is the length-normalised difference of log-likelihoods, over the whole text and over
its most telling window, and a logistic curve fitted on held-back halves of the sample turns
it into a score.

The models are fitted on a bounded number of labelled rows, documented below, of texts of any
length. Executors count their symbols; the counts, at most one for each of 2 ** 25 keys of each
half, and the evidence of each sampled row are all that the driver sees. The fitted table of
2 ** 25 bytes travels compressed; every document is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textbuf
from .scratch import discard, materialise, shuffle_partitions, table

#: The sample: the documents of so many labelled ids of each class, first by a hash of the id.
SAMPLE_ROWS = 2000
#: Symbols of a window, the order, and the absolute discount.
WINDOW, ORDER, DISCOUNT = 24, 5, 2.0
#: Distinct keys that a task holds before it folds them.
HELD = 4_000_000
#: Steps of one unit in the stored log ratios.
STEPS = 16.0

_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[0x80:0xC0] = 29 + np.arange(64) % 3
_SYMBOL[0xC0:] = 28
_SYMBOL[0xC3] = 27


Counts = tuple[np.ndarray, np.ndarray]  # distinct five-symbol keys in order, and how often each occurs


class Model(NamedTuple):
    ratio: np.ndarray  # log ratio of the last symbol's probabilities, by five symbols, in STEPS
    curve: np.ndarray  # weights of evidence(), then the intercept


def grams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By slices: first row, the five-symbol key ending at each byte, and offsets of the rows."""
    data, offsets = textbuf.buffers(column)
    for a, b in textbuf.row_slices(offsets):
        off = offsets[a : b + 1] - offsets[a]
        symbol = _SYMBOL[textbuf.lower_latin(data[offsets[a] : offsets[b]])]
        key = symbol.copy()
        starts = off[:-1][np.diff(off) > 0]
        before = symbol
        for k in range(1, ORDER):
            moved = np.zeros_like(before)
            moved[1:] = before[:-1]
            moved[starts] = 0  # a text begins after breaks
            key |= moved << (5 * k)
            before = moved
        yield a, key, off


def _added(parts: list[Counts]) -> Counts:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``part, key, n`` of texts by part, folded as they gather."""
    held: dict[int, list[Counts]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for part, found in held.items():
            keys, n = _added(found)
            for a in range(0, len(keys), 100_000):
                cut = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[cut]), part, np.int32)), pa.array(keys[cut]), pa.array(n[cut])], ["part", "key", "n"])

    for batch in batches:
        parts = batch.column(0).to_numpy()
        for p in np.unique(parts).tolist():
            for _, key, _ in grams(batch.column(1).filter(pa.array(parts == p))):
                held.setdefault(p, []).append(np.unique(key, return_counts=True))
                size += len(held[p][-1][0])
        if size > HELD:
            yield from out()
            held, size = {}, 0
    yield from out()


def _log_ratio(tops: list[Counts]) -> np.ndarray:
    """The table of stored log ratios from the counts of the toxic and of the ordinary texts."""
    pooled = np.unique(np.concatenate([own & 0x7FFF for own, _ in tops]))  # continuation counts of bigrams: distinct symbols before them
    base = np.bincount(pooled & 0x3FF, minlength=1 << 10).reshape(32, 32) + 0.05
    shared = (base / base.sum(1, keepdims=True)).reshape(-1)
    logs = []
    for top, _ in tops:
        prob = shared
        for order in (3, 4):
            own = np.unique(top & ((1 << 5 * (order + 1)) - 1)) & ((1 << 5 * order) - 1)
            count = np.bincount(own, minlength=1 << 5 * order).astype(np.float32).reshape(-1, 32)
            total = count.sum(1, keepdims=True)
            taken = np.minimum(count, DISCOUNT).sum(1, keepdims=True)
            spare = np.where(total > 0, taken / np.maximum(total, 1), 1)
            lower = np.tile(prob, 32).reshape(-1, 32)
            prob = (np.maximum(count - DISCOUNT, 0) / np.maximum(total, 1) + spare * lower).astype(np.float32).reshape(-1)
        logs.append(prob)
    out = np.empty(1 << 25, np.int8)
    size = 1 << 20
    for first in range(32):  # by the first of the five symbols
        value = []
        for (own, number), prob in zip(tops, logs, strict=True):
            a, b = np.searchsorted(own, [first * size, (first + 1) * size])
            count = np.zeros(size, np.float32)
            count[own[a:b] - first * size] = number[a:b]
            count = count.reshape(-1, 32)
            total = count.sum(1, keepdims=True)
            spare = np.where(total > 0, np.minimum(count, DISCOUNT).sum(1, keepdims=True) / np.maximum(total, 1), 1)
            value.append(np.log(np.maximum(count - DISCOUNT, 0) / np.maximum(total, 1) + spare * prob.reshape(-1, 32)))
        out[first * size : (first + 1) * size] = np.clip(np.rint((value[0] - value[1]) * STEPS), -127, 127).astype(np.int8).reshape(-1)
    return out


def evidence(ratio: np.ndarray, key: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """By row: the mean log ratio a symbol, the greatest window's sum, and the logarithm of the length."""
    run = np.concatenate([[0], np.cumsum(ratio[key], dtype=np.int64)]) / STEPS
    n = np.diff(offsets)
    out = np.zeros((len(n), 3))
    out[:, 2] = np.log1p(n)
    some = np.flatnonzero(n > 0)
    if len(some):
        out[some, 0] = (run[offsets[1:]] - run[offsets[:-1]])[some] / n[some]
        end = np.arange(1, len(key) + 1)
        first = np.repeat(offsets[:-1], n)
        window = run[end] - run[np.maximum(end - WINDOW, first)]
        out[some, 1] = np.maximum(np.maximum.reduceat(window, offsets[:-1][some]), 0)
    return out


def _features(x: np.ndarray) -> np.ndarray:
    return np.stack([10 * x[:, 0], x[:, 1], x[:, 2], np.ones(len(x))], axis=1)


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton's steps with a small ridge."""
    f, w = _features(x), np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        grad = f.T @ (weight * (p - y)) + 1e-3 * w
        hess = (f * (weight * p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(4)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


_EMPTY: Counts = (np.zeros(0, np.int32), np.zeros(0, np.int64))


def _packed(ratio: np.ndarray) -> bytes:
    return pa.compress(ratio.tobytes(), "zstd", asbytes=True)  # most contexts are unseen, so most bytes repeat


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(blob, 1 << 25, "zstd", asbytes=True), np.int8)


def _judge(shared: object) -> Callable:
    """``toxic, e0, e1, e2``: the evidence of each row under the model of the other half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [_unpacked(x) for x in shared.value]
        for batch in batches:
            parts = batch.column(0).to_numpy()
            for p in np.unique(parts).tolist():
                x = [evidence(tables[1 - p // 2], key, off) for _, key, off in grams(batch.column(1).filter(pa.array(parts == p)))]
                x = np.concatenate(x) if x else np.zeros((0, 3))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p % 2, np.int32)), *(pa.array(x[:, i]) for i in range(3))], ["toxic", "e0", "e1", "e2"])

    return run


def train(sample: DataFrame, share: float) -> Model:
    """A model from ``sample (part, text)``; ``part`` is twice the half plus the class.

    ``share`` is the share of toxic rows among all labelled ones. If a class has no rows, every
    text gets the score of the other.
    """
    found = sample.mapInArrow(_count, "part int, key int, n long").groupBy("part", "key").agg(F.sum("n").alias("n")).toArrow()
    part, key, n = (found[c].to_numpy() for c in ("part", "key", "n"))
    counts = {}
    for p in range(4):
        own = np.flatnonzero(part == p)
        own = own[np.argsort(key[own])]
        counts[p] = (key[own], n[own]) if len(own) else _EMPTY
    halves = [_log_ratio([counts[2 * f + 1], counts[2 * f]]) for f in (0, 1)]
    shared = sample.sparkSession.sparkContext.broadcast([_packed(x) for x in halves])
    rows = sample.mapInArrow(_judge(shared), "toxic int, e0 double, e1 double, e2 double").toArrow()
    shared.destroy()
    y = rows["toxic"].to_numpy()
    if len(np.unique(y)) < 2:
        return Model(np.zeros(1 << 25, np.int8), np.array([0, 0, 0, 8.0 if len(y) and y[0] else -8.0]))
    x = np.stack([rows[c].to_numpy() for c in ("e0", "e1", "e2")], axis=1)
    order = np.lexsort((*x.T, y))  # the same sums whatever the order of rows
    x, y = x[order], y[order]
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(_log_ratio([_added([counts[c], counts[2 + c]]) for c in (1, 0)]), _fit_curve(x, y, weight))


def scores(model: Model, column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column))
    for a, key, offsets in grams(column):
        x = _features(evidence(model.ratio, key, offsets))
        out[a : a + len(x)] = 1 / (1 + np.exp(-np.clip(x @ model.curve, -30, 30)))
    return out


def _held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from ``docs (doc_id, text)`` and ``labels (doc_id, toxic)`` outside the held-out fifth.

    An id labelled more than once is toxic if any of its labels is; null labels do not count,
    nor do null, empty and repeated texts. Of an id with several texts the first by hash
    counts. Without labelled rows of both classes, all scores are those of the one class there
    is, or of ordinary texts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~_held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    picked = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS) for c in (0, 1)]
    both = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * SAMPLE_ROWS rows at most
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).where("text <> ''").join(both, "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("hash").alias("hash"), F.min_by("text", "hash").alias("text"))
    texts = texts.groupBy("hash", "toxic").agg(F.min("text").alias("text"))  # copies count once
    line = F.row_number().over(Window.partitionBy("toxic").orderBy("hash", "text"))  # the sample alone
    halves = texts.select((2 * (line % 2) + F.col("toxic")).cast("int").alias("part"), "text")
    sample = materialise(halves.repartition(shuffle_partitions(docs.sparkSession)), "sample")
    model = train(sample, (total.toxic or 0) / max(total.n, 1))
    discard(sample)
    return model


def toxicity(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """The score of a column of texts, 0 to 1; null and empty texts are scored as texts without words."""
    shared = spark.sparkContext.broadcast((_packed(model.ratio), model.curve))  # bounded by the table's size

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        blob, curve = shared.value
        fitted = Model(_unpacked(blob), curve)
        for column in texts:
            yield pa.array(scores(fitted, column))

    return scored


def score_documents(docs: DataFrame, model: Model, out: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``out``, 0 to 1; repeated rows have one score, an empty table stays empty."""
    return docs.withColumn(out, toxicity(docs.sparkSession, model)(F.col("text")))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic; null and empty texts stay, whatever their labels.

    Rows are judged one by one by their whole texts, so repeated rows stay or go together.
    Columns may have any names; without labels of both classes no row goes, unless all labels
    are toxic.
    """
    score = toxicity(docs.sparkSession, fit(docs, labels))
    return docs.where((F.coalesce("text", F.lit("")) == "") | (score(F.col("text")) < 0.5))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    found = score_documents(docs, fit(docs, labels))
    return found.select("doc_id", _held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
