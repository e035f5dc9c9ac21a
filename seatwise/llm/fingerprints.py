"""Fingerprints of texts from content-defined chunks.

A gear hash over the last 16 bytes marks boundaries under two masks, a hard one before the
usual size and an easy one after it. The fingerprint is the set of chunk digests, each with
its chunk's length; likeness is the share of the shorter fingerprint's length in both.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textbuf
from .scratch import materialise, shuffle_partitions, table

#: Bytes: the hash's reach, the least, usual and greatest chunk.
REACH, LEAST, USUAL, MOST = 16, 24, 64, 384
#: Boundaries need so many leading zero bits, before and after the usual size.
HARD_BITS, EASY_BITS = 7, 5
_GEAR = (textbuf.splitmix(np.arange(256, dtype=np.uint64) + np.uint64(77)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At each byte, the shifted sum of the gears of the last REACH bytes."""
    h, have = _GEAR[data], 1
    while have < REACH:
        shifted = np.zeros_like(h)
        shifted[have:] = h[:-have] << np.uint32(have)
        h = h + shifted
        have *= 2
    return h


def chunk_ends(texts: list[bytes]) -> list[list[int]]:
    """For each text the ends of its chunks; each chunk but the last has LEAST to MOST bytes."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    h = gear_hashes(data) if len(data) else np.zeros(0, np.uint32)
    easy_at = np.flatnonzero(h < np.uint32(1 << (32 - EASY_BITS)))
    hard = (easy_at[h[easy_at] < np.uint32(1 << (32 - HARD_BITS))] + 1).tolist()
    easy = (easy_at + 1).tolist()
    far = len(data) + MOST
    hard.append(far)
    easy.append(far)
    out, base = [], 0
    for t in texts:
        at, end, ends = base, base + len(t), []
        while end - at > LEAST:
            most = min(at + MOST, end)
            cut = hard[bisect_left(hard, at + LEAST)]
            if cut > at + USUAL:
                cut = easy[bisect_left(easy, at + USUAL)]
            at = min(cut, most)
            ends.append(at - base)
        if at < end:
            ends.append(len(t))
        out.append(ends)
        base = end
    return out


def fingerprints(texts: list[bytes]) -> list[dict[str, int]]:
    """For each text its chunks' digests with their lengths; empty for an empty text."""
    out, digest = [], hashlib.blake2b
    for t, ends in zip(texts, chunk_ends(texts), strict=True):
        marks, a = {}, 0
        for b in ends:
            marks[digest(t[a:b], digest_size=5).hexdigest()] = b - a
            a = b
        out.append(marks)
    return out


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    """Length of the common chunks over the shorter fingerprint's; two empty ones are alike, one is unlike any other."""
    if not a or not b:
        return float(not a and not b)
    common = sum(n for d, n in a.items() if d in b)
    return common / min(sum(a.values()), sum(b.values()))


def _shown(marks: dict[str, int]) -> str:
    return " ".join(f"{d}:{n}" for d, n in sorted(marks.items()))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("place", pa.int32()), ("part", pa.int32()), ("text", pa.string())])
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, place int, part int, text string"


def _results(ids: list, texts: list[str], following: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of ``texts`` against the texts after them."""
    n, a = len(texts), 0
    while a < n:
        b, size = a, 0
        while b < n and (b == a or size < textbuf.SLICE_BYTES):
            size += len(texts[b])
            b += 1
        own = texts[a:b]
        edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(own, following[a:b], strict=True)]
        raw = [t.encode() for t in (*own, *edited, *following[a:b])]
        m = b - a
        marks = fingerprints(raw[: 2 * m])
        after: list[dict[str, int] | None] = [marks[i + 1] if i + 1 < m and following[a + i] is texts[a + i + 1] else None for i in range(m)]
        missing = [i for i in range(m) if after[i] is None]
        for i, x in zip(missing, fingerprints([raw[2 * m + i] for i in missing]), strict=True):
            after[i] = x
        cols = [
            ids[a:b], [len(t) for t in own], [hashlib.sha256(x).hexdigest() for x in raw[m : 2 * m]], [_shown(x) for x in marks[:m]], [_shown(x) for x in marks[m:]],
            [likeness(x, y) for x, y in zip(marks[:m], marks[m:], strict=True)], [likeness(x, y) for x, y in zip(marks[:m], after, strict=True)], [0] * m, [None] * m, [None] * m,
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)
        a = b


def _edge(doc_id: int | None, text: str, place: int, part: int) -> pa.RecordBatch:
    cols = [[doc_id], [None], [None], [None], [None], [None], [None], [place], [part], [text]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)


def _in_order() -> Callable:
    """Rows of a sorted partition against their followers; the first and the last row also go out with their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = None, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            if last is None:
                yield _edge(ids[0], texts[0], 1, part)
            else:
                ids, texts = [last[0], *ids], [last[1], *texts]
            yield from _results(ids[:-1], texts[:-1], texts[1:])
            last = (ids[-1], texts[-1])
        if last is not None:
            yield _edge(*last, 2, part)

    return run


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _results(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edits, whose last half the next text's start replaces.

    The next document is the one of next smaller id, and the first after the last; null ids
    come last, and rows of one id are ordered by text. A null text is empty. A single row is
    its own next. Texts are sorted by id in one exchange; only a partition's first and last
    text are matched outside it.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    done = materialise(slim.repartitionByRange(n, order[0]).sortWithinPartitions(*order).mapInArrow(_in_order(), _SCHEMA), "fingerprints")
    edges = done.where("place > 0")
    first, last = edges.where("place = 1"), edges.where("place = 2")
    line, whole = Window.orderBy("part"), Window.partitionBy()  # a number a partition
    pairs = first.select("part").select("part", F.coalesce(F.lead("part").over(line), F.min("part").over(whole)).alias("next"))
    ends = last.join(pairs, "part").join(first.select(F.col("part").alias("next"), F.col("text").alias("following")), "next")
    return done.where("place = 0").unionByName(ends.select("doc_id", "text", "following").mapInArrow(_across, _SCHEMA)).drop("place", "part", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
