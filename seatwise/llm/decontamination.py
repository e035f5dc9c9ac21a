"""Benchmark leaks: pairs of near words as seeds, then Smith-Waterman alignment of words.

Benchmark items are the query set and come in blocks of bounded bytes; all documents are
scanned against each block. An alignment's score is that of one match and of the steps from
match to match, and only steps with at most one mismatch or gap add to it. Such a step is a
pair of words at most two apart in text and item. So a text whose pairs of an item can't add
up to the score that a copy needs holds none, and all others are aligned: the result is that
of aligning every text with every item. The scan shuffles no texts, and every decision is made
where the text is read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbuf
from .scratch import table

#: Scores of a match, a mismatch and a gap.
MATCH, MISMATCH, GAP = 2, -1, -1
#: An item of fewer words matches only a text of just these words.
SHORT = 3
#: A passage is a copy of an item if it reaches this share of the item's own score, or so many words' score.
LIKENESS, LONG_WORDS = 0.5, 20
#: Bytes of benchmark text in one block.
BLOCK_BYTES = 4 << 20
#: Seeds times their owners that are looked at together; a text with more is looked at alone.
OWNED = 1 << 21
_FLAG_BITS = 20


class Items(NamedTuple):
    ids: list[int | None]
    words: list[np.ndarray]  # hashes of each item's words
    short: list[int]  # items of fewer than SHORT words
    seeds: np.ndarray  # sorted distinct hashes of pairs
    flags: np.ndarray  # by the first bits of a hash: whether a seed may have it
    bounds: np.ndarray  # of each seed's owners
    owners: np.ndarray  # items
    adds: np.ndarray  # what the pair adds to an alignment with the owner at most, if neighbours in the text
    most: np.ndarray  # what all its places in the owner do


def tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """By slices: first row, hashes of lower-cased runs of letters and digits, their rows, number of rows."""
    data, offsets = textbuf.buffers(column)
    for a, b in textbuf.row_slices(offsets):
        part, off = textbuf.lower_latin(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
        start, end, row = textbuf.word_spans(part, off, textbuf.NOT_ALNUM)
        yield a, textbuf.span_hash(textbuf.prefix_hash(part), start, end) if len(start) else np.zeros(0, np.uint64), row, b - a


def _flagged(seeds: np.ndarray) -> np.ndarray:
    flags = np.zeros(1 << _FLAG_BITS, bool)
    flags[(seeds >> np.uint64(64 - _FLAG_BITS)).astype(np.int64)] = True
    return flags


def _hits(grams: np.ndarray, seeds: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``grams`` that hold seeds, and the seeds' numbers."""
    maybe = np.flatnonzero(flags[(grams >> np.uint64(64 - _FLAG_BITS)).astype(np.int64)])
    at = np.searchsorted(seeds, grams[maybe])
    good = (at < len(seeds)) & (seeds[np.minimum(at, len(seeds) - 1)] == grams[maybe])
    return maybe[good], at[good]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, and first and end word in the passage."""
    n = len(passage)
    cols = np.arange(n + 1)
    h = np.zeros(n + 1, np.int64)
    begin = cols.copy()  # where the alignment that ends here began
    best, at, start = 0, 0, 0
    for w in item:
        diag = h[:-1] + np.where(passage == w, MATCH, MISMATCH)
        up = h + GAP
        new = np.maximum(up, 0)
        src = np.where(up > 0, begin, cols)
        better = diag > new[1:]
        new[1:][better] = diag[better]
        src[1:][better] = begin[:-1][better]
        lifted = new - GAP * cols  # a run of gaps to the right costs GAP each
        top = np.maximum.accumulate(lifted)
        from_left = top > lifted
        lead = np.maximum.accumulate(np.where(lifted == top, cols, 0))
        src = np.where(from_left, src[lead], src)
        h, begin = top + GAP * cols, src
        j = int(h.argmax())
        if h[j] > best:
            best, at, start = int(h[j]), j, int(begin[j])
    return best, start, at


def _need(m: int) -> float:
    """The least score of a copy of an item of ``m`` words."""
    return min(LIKENESS * MATCH * m, MATCH * LONG_WORDS)


def _pairs(words: np.ndarray, apart: int) -> np.ndarray:
    return textbuf.splitmix(words[: len(words) - apart] * np.uint64(0xFF51AFD7ED558CCD) + words[apart:]) if len(words) > apart else np.zeros(0, np.uint64)


def _ahead(at: np.ndarray, adds: np.ndarray, span: np.ndarray | float) -> np.ndarray:
    """What the seeds from each of the places ``at`` to ``span`` words on add together."""
    total = np.concatenate([[0], np.cumsum(adds)])
    return total[np.searchsorted(at, at + span, "right")] - total[:-1]


def best_copy(words: np.ndarray, item: np.ndarray, at: np.ndarray, seed: np.ndarray, adds: np.ndarray, most: np.ndarray) -> tuple[float, int, int, int] | None:
    """(likeness, seeds, first word, end word) of a text's best passage.

    ``at`` are the first words of its seeds, in order, ``adds`` what each adds at most, and
    ``most`` what all of one seed do, as an alignment uses a pair of the item once.
    """
    need, m = _need(len(item)), len(item)
    span = int(3 * m - need)  # matches and errors of an alignment that reaches ``need``
    may = at[_ahead(at, adds, span) + MATCH >= need]  # one begins at one of these
    if not len(may):
        return None
    own = np.isin(words, item)
    total = np.concatenate([[0], np.cumsum(np.where(own, MATCH, GAP))])
    over = total - np.minimum.accumulate(total)  # it lies in one stretch where this is positive
    edge = np.flatnonzero(np.diff((over > 0).astype(np.int8), append=0))
    starts, stops = edge[::2], edge[1::2]
    stretch = np.searchsorted(starts, may, "right") - 1
    good = np.isin(stretch, np.searchsorted(starts, np.flatnonzero(over >= need), "left") - 1)
    may, stretch = may[good], stretch[good]
    if not len(may):
        return None
    cut = np.flatnonzero((np.diff(may) > span) | (np.diff(stretch) != 0))
    best = None
    for a, z, k in zip(may[np.append(0, cut + 1)].tolist(), may[np.append(cut, len(may) - 1)].tolist(), stretch[np.append(0, cut + 1)].tolist(), strict=True):
        b = min(z + span, int(stops[k]))
        i, j = np.searchsorted(at, (a, b))
        _, first, which = np.unique(seed[i:j], return_index=True, return_inverse=True)
        if MATCH + np.minimum(np.bincount(which, adds[i:j]), most[i:j][first]).sum() < need:
            continue
        score, s, e = align(item, words[a:b])
        if score >= need and (best is None or score > best[0]):
            best = (score, int(np.count_nonzero(adds[i:j])), a + s, a + e)
    return best and (best[0] / (MATCH * len(item)), *best[1:])


def _seeded(words: np.ndarray, rows: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, numbers and distance of the seeds in texts, by place."""
    found = []
    for apart in (1, 2):
        at, seed = _hits(_pairs(words, apart), items.seeds, items.flags)
        same = rows[at] == rows[at + apart] if len(at) else np.zeros(0, bool)
        found.append((at[same], seed[same], np.full(int(same.sum()), apart)))
    at, seed, apart = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(at, kind="stable")
    return at[order], seed[order], apart[order]


def scan(column: pa.Array, items: Items) -> list[list[tuple[int, float, int, int, int]]]:
    """For each text (item, likeness, seeds, first word, end word) of its best passage for each item."""
    out: list[list[tuple[int, float, int, int, int]]] = [[] for _ in range(len(column))]
    need = np.array([_need(len(w)) for w in items.words])
    short = {}
    for i in items.short:
        short.setdefault(items.words[i].tobytes(), []).append(i)
    for first, words, rows, n in tokens(column):
        bounds = np.searchsorted(rows, np.arange(n + 1))
        if short:
            for r in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < SHORT)).tolist():
                m = int(bounds[r + 1] - bounds[r])
                out[first + r] += [(i, 1.0, 1, 0, m) for i in short.get(words[bounds[r] : bounds[r + 1]].tobytes(), [])]
        at, seed, apart = _seeded(words, rows, items)
        if not len(at):
            continue
        count = items.bounds[seed + 1] - items.bounds[seed]
        ends = np.concatenate([[0], np.cumsum(count)])
        starts = np.flatnonzero(np.concatenate([[True], np.diff(rows[at]) != 0]))  # of each text's seeds
        stops = np.append(starts[1:], len(at))
        k = 0
        while k < len(starts):
            last = max(k, int(np.searchsorted(ends[stops], ends[starts[k]] + OWNED, "right")) - 1)
            x, y = starts[k], stops[last]
            k = last + 1
            hit = np.repeat(np.arange(x, y), count[x:y])
            owner = np.arange(len(hit)) - np.repeat(ends[x:y] - ends[x], count[x:y]) + items.bounds[seed[hit]]
            adds = np.where(apart[hit] == 1, items.adds[owner], MATCH + GAP)
            key = rows[at[hit]] * len(items.words) + items.owners[owner]
            order = np.argsort(key, kind="stable")
            key, hit, owner, adds = key[order], hit[order], owner[order], adds[order]
            place = at[hit]
            adds[1:][(key[1:] == key[:-1]) & (place[1:] == place[:-1])] = 0  # of a word's two pairs, one counts
            lead = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0]))
            enough = MATCH + np.add.reduceat(adds, lead) >= need[key[lead] % len(items.words)]
            until = np.append(lead[1:], len(key))
            for a, b in zip(lead[enough].tolist(), until[enough].tolist(), strict=True):
                r, i = divmod(int(key[a]), len(items.words))
                if copy := best_copy(words[bounds[r] : bounds[r + 1]], items.words[i], place[a:b] - bounds[r], seed[hit[a:b]], adds[a:b], items.most[owner[a:b]]):
                    out[first + r].append((i, *copy))
    return [sorted(x) for x in out]


def _blocks(benchmark: DataFrame) -> Iterator[list]:
    """Rows of the benchmark in blocks of about BLOCK_BYTES; a longer item is a block of its own."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length("text") > 0)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    for i in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        if rows:
            yield sorted(rows, key=lambda r: (r.item_id is None, r.item_id or 0, r.text))


def prepare(rows: list) -> Items:
    """The block's items with the pairs of words at most two apart as seeds."""
    ids, words = [], []
    for r in rows:
        own = np.concatenate([w for _, w, _, _ in tokens(pa.array([r.text]))])
        if len(own):
            ids.append(r.item_id)
            words.append(own)
    pair, owner, adds, most = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, own in enumerate(words):
        if len(own) >= SHORT:
            near, far = _pairs(own, 1), _pairs(own, 2)
            own_pairs, times = np.unique(np.concatenate([near, far]), return_counts=True)
            worth = np.where(np.isin(own_pairs, near), MATCH, MATCH + GAP)
            pair.append(own_pairs)
            owner.append(np.full(len(own_pairs), i))
            adds.append(worth)
            most.append(worth * times)
    flat = np.concatenate(pair)
    order = np.argsort(flat, kind="stable")
    seeds, count = np.unique(flat, return_counts=True)
    short = [i for i, own in enumerate(words) if len(own) < SHORT]
    return Items(ids, words, short, seeds, _flagged(seeds), np.concatenate([[0], np.cumsum(count)]), *(np.concatenate(x)[order] for x in (owner, adds, most)))


def _matches(shared: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*shared.value)
        for batch in batches:
            rows = [(d, items.ids[i], *x) for d, found in zip(batch.column(0).to_pylist(), scan(batch.column(1), items), strict=True) for i, *x in found]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "likeness", "seeds", "first_word", "end_word"])

    return run


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, likeness, seeds, first_word, end_word``: a row for each document's best copy of an item.

    Words are lower-cased runs of letters and digits. Null and empty texts and items match
    nothing; an item of fewer than three words matches only a text of just these words. Each
    of repeated rows and items has its own matches.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for rows in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(tuple(prepare(rows)))
        found = slim.mapInArrow(_matches(shared), "doc_id long, item_id long, likeness double, seeds int, first_word int, end_word int")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, likeness double, seeds int, first_word int, end_word int")
    return out


def _clean(shared: object) -> Callable:
    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = Items(*shared.value)
        for column in texts:
            yield pa.array([not x for x in scan(column, items)], pa.bool_())

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a copy of any benchmark item.

    Null and empty texts and items match nothing, repeated rows stay or go together, an empty
    table of either kind changes nothing, and columns may have any names.
    """
    out = docs
    for rows in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(tuple(prepare(rows)))  # a block of bounded bytes
        out = out.where(_clean(shared)(F.col("text")))
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
