"""Removal of long repeats by longest-previous-factor arrays.

Every 100-byte window belongs to the position of its least 24-byte gram (leftmost of equals),
which depends on the window's bytes alone, so equal windows meet at equal grams. A run of
windows with one such position travels as a record of two hashes and its place; the text of
a run is shipped only if its gram occurs with differing runs:

1. map: records of runs; equal runs within a batch fold to the first at once;
2. reduce by gram: later copies of an equal run are removed whole; where a gram has several
   different runs, the first of each goes on with its bytes;
3. reduce by gram: suffix order, previous and next smaller positions and from them the
   longest previous factor of each window's start decide window by window;
4. the removed spans go back to the documents.

The two joins with the documents share one exchange of the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbuf
from .scratch import materialise, shuffle_partitions, table

GRAM = 24
#: Bytes that one suffix array covers; a larger group of runs of one gram has a larger array.
ARRAY_BYTES = 1 << 20
_RUN = np.dtype([("gram", "<u8"), ("whole", "<u8"), ("n", "u1"), ("doc", "<i8"), ("hash", "<u4"), ("start", "<i4")])
_SPAN = np.dtype([("doc", "<i8"), ("hash", "<u4"), ("start", "<i4"), ("n", "<i4")])
_OPEN = np.dtype([("doc", "<i8"), ("hash", "<u4"), ("gram", "<u8"), ("start", "<i4"), ("n", "<i4")])
_CODEC = "zstd"


def _pack(x: np.ndarray) -> bytes:
    """Fields one after another, compressed."""
    raw = len(x).to_bytes(8, "little") + b"".join(np.ascontiguousarray(x[f]).tobytes() for f in x.dtype.names)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, _CODEC, asbytes=True)


def _unpack(blob: bytes, dtype: np.dtype) -> np.ndarray:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), _CODEC, asbytes=True)
    n, at = int.from_bytes(raw[:8], "little"), 8
    out = np.empty(n, dtype)
    for f in dtype.names:
        part = dtype.fields[f][0]
        out[f] = np.frombuffer(raw, part, n, at)
        at += n * part.itemsize
    return out


def _by_bucket(x: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    ids, first = np.unique(bucket[order], return_index=True)
    yield from zip(ids.tolist(), np.split(x[order], first[1:]), strict=True)


def _doc_bucket(x: np.ndarray, n: int) -> np.ndarray:
    return (textbuf.splitmix(x["doc"].view(np.uint64) + x["hash"]) % np.uint64(n)).astype(np.int64)


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of ``length`` bytes with one least gram: row, first window, windows, gram hash, run hash."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    n, w = len(data), length - GRAM + 1
    size = np.diff(offsets)
    if n < length or not (size >= length).any():
        return none
    prefix = textbuf.prefix_hash(data)
    at = np.arange(n - GRAM + 1)
    grams = textbuf.span_hash(prefix, at, at + GRAM)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    span = 1
    while 2 * span <= w:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[: len(low) - (w - span)], low[w - span :])  # low[s]: the least gram of window s
    rows = np.flatnonzero(size >= length)
    count = size[rows] - length + 1
    window = np.repeat(offsets[rows] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    place = (low[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (np.diff(window) != 1) | (np.diff(place) != 0)]))
    runs = np.diff(np.append(first, len(window)))
    start, place = window[first], place[first]
    whole = textbuf.span_hash(prefix, start, start + runs + length - 1) + (place - start).astype(np.uint64)
    row = np.searchsorted(offsets, start, "right") - 1
    return row, start - offsets[row], runs, grams[place], whole


def _later_copies(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs: masks of the first of each equal run, and of the copies in other places."""
    order = np.lexsort((runs["start"], runs["hash"], runs["doc"], runs["n"], runs["whole"], runs["gram"]))
    s = runs[order]
    head = np.ones(len(s), bool)
    head[1:] = (s["gram"][1:] != s["gram"][:-1]) | (s["whole"][1:] != s["whole"][:-1]) | (s["n"][1:] != s["n"][:-1])
    lead = s[np.flatnonzero(head)[np.cumsum(head) - 1]]
    same = (s["doc"] == lead["doc"]) & (s["hash"] == lead["hash"]) & (s["start"] == lead["start"])
    first, copy = np.zeros(len(s), bool), np.zeros(len(s), bool)
    first[order], copy[order] = head, ~same
    return first, copy


def _spans(runs: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(runs), _SPAN)
    for f in ("doc", "hash", "start"):
        out[f] = runs[f]
    out["n"] = runs["n"].astype(np.int32) + length - 1
    return out


_BLOB = "kind int, bucket int, blob binary"


def _rows(kind: int, parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(parts), pa.int32()), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["kind", "bucket", "blob"])


def _map_runs(length: int, n: int) -> Callable:
    """Kind 0: records of runs by gram; kind 1: spans that a copy in the same batch already removes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textbuf.buffers(batch.column(2))
            doc, text_hash = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = []
            for a, b in textbuf.row_slices(offsets):
                row, start, runs, gram, whole = window_runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length)
                x = np.empty(len(row), _RUN)
                x["gram"], x["whole"], x["n"], x["start"] = gram, whole, runs, start
                x["doc"], x["hash"] = doc[a + row], text_hash[a + row]
                found.append(x)
            x = np.concatenate(found) if found else np.empty(0, _RUN)
            if not len(x):
                continue
            first, copy = _later_copies(x)
            kept, gone = x[first], _spans(x[copy], length)
            yield _rows(0, [(i, _pack(p)) for i, p in _by_bucket(kept, (kept["gram"] % np.uint64(n)).astype(np.int64))])
            if len(gone):
                yield _rows(1, [(i, _pack(p)) for i, p in _by_bucket(gone, _doc_bucket(gone, n))])

    return run


def _reduce_runs(length: int, n: int) -> Callable:
    """Kind 1: spans of later copies of equal runs; kind 2: first runs whose gram has other runs too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            if passed := [(b, x) for k, b, x in zip(*(c.to_pylist() for c in batch.columns), strict=True) if k == 1]:
                yield _rows(1, passed)
            found += [_unpack(x, _RUN) for k, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True) if k == 0]
        if not found:
            return
        x = np.concatenate(found)
        del found
        x = x[np.argsort(x["gram"], kind="stable")]
        again = np.zeros(len(x), bool)
        again[1:] = x["gram"][1:] == x["gram"][:-1]
        again[:-1] |= again[1:].copy()
        x = x[again]
        if not len(x):
            return
        first, copy = _later_copies(x)
        gone = _spans(x[copy], length)
        if len(gone):
            yield _rows(1, [(i, _pack(p)) for i, p in _by_bucket(gone, _doc_bucket(gone, n))])
        lead = x[first]
        lead = lead[np.argsort(lead["gram"], kind="stable")]
        several = np.zeros(len(lead), bool)
        several[1:] = lead["gram"][1:] == lead["gram"][:-1]
        several[:-1] |= several[1:].copy()
        lead = lead[several]
        if len(lead):
            go = np.empty(len(lead), _OPEN)
            for f in _OPEN.names:
                go[f] = lead[f]
            yield _rows(2, [(i, _pack(p)) for i, p in _by_bucket(go, _doc_bucket(go, n))])

    return run


def _per_document(dtype: np.dtype, fields: list[str]) -> Callable:
    """One row per document from the blobs of its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_unpack(x, dtype) for batch in batches for x in batch.column(2).to_pylist()]
        if not found:
            return
        x = np.concatenate(found)
        x = x[np.lexsort((x["start"], x["hash"], x["doc"]))]
        first = np.flatnonzero(np.concatenate([[True], (x["doc"][1:] != x["doc"][:-1]) | (x["hash"][1:] != x["hash"][:-1])]))
        ends = np.append(first[1:], len(x))
        for i in range(0, len(first), 5000):
            blobs = [_pack(x[a:b][fields]) for a, b in zip(first[i : i + 5000], ends[i : i + 5000], strict=True)]
            at = first[i : i + 5000]
            yield pa.RecordBatch.from_arrays([pa.array(x["doc"][at]), pa.array(x["hash"][at].astype(np.int64)), pa.array(blobs, pa.binary())], ["d", "h", "blob"])

    return run


def _ship(length: int, n: int) -> Callable:
    """The bytes of the named runs, by gram."""
    named = np.dtype([(f, _OPEN.fields[f][0]) for f in ("gram", "start", "n")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textbuf.buffers(batch.column(2))
            runs, texts = [], []
            for i, (d, h, blob) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                x = _unpack(blob, named)
                own = np.empty(len(x), _OPEN)
                for f in named.names:
                    own[f] = x[f]
                own["doc"], own["hash"] = d, h
                runs.append(own)
                base = offsets[i]
                texts += [data[base + s : base + s + m + length - 1].tobytes() for s, m in zip(x["start"].tolist(), x["n"].tolist(), strict=True)]
            if not runs:
                continue
            x = np.concatenate(runs)
            bucket = (x["gram"] % np.uint64(n)).astype(np.int64)
            parts = []
            for i, at in _by_bucket(np.arange(len(x)), bucket):
                body = b"".join(texts[j] for j in at)
                parts.append((i, _pack(x[at]), len(body).to_bytes(8, "little") + pa.compress(body, _CODEC, asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary())], ["bucket", "runs", "body"])

    return run


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="stable")
    s = key[order]
    rank = np.empty(len(key), np.uint64)
    rank[order] = np.cumsum(np.concatenate([[0], s[1:] != s[:-1]])).astype(np.uint64)
    return rank


def longest_previous_factor(text: np.ndarray, depth: int, at: np.ndarray | None = None) -> np.ndarray:
    """For the positions ``at`` (all by default): how many bytes from there also start earlier, ``depth`` at most.

    ``depth`` is 64 to 128. Suffixes are ordered by ``depth`` bytes, equals by position. The
    earlier match is the previous or next smaller position in that order, found by descent
    over minima of power-of-two blocks; its length by descent over ranks of power-of-two lengths.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)

    def ahead(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(n, x.dtype)
        if by < n:
            out[: n - by] = x[by:]
        return out

    value = text.astype(np.uint64)
    levels = [(1, value)]
    for have in (1, 2, 4):
        value = (value << np.uint64(8 * have)) | ahead(value, have)
        levels.append((2 * have, value))
    rank = _dense(value)
    for have in (8, 16, 32):
        rank = _dense((rank << np.uint64(32)) | ahead(rank, have))
        levels.append((2 * have, rank))
    order = np.argsort((rank << np.uint64(32)) | ahead(rank, depth - 64), kind="stable")

    minima = [order]
    while 2 << (len(minima) - 1) <= n:
        x, step = minima[-1], 1 << (len(minima) - 1)
        minima.append(np.minimum(x[: len(x) - step], x[step:]))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    at = np.arange(n) if at is None else at
    best = np.zeros(len(at), np.int64)
    for forward in (False, True):
        j = place[at] + forward
        for k in range(len(minima) - 1, -1, -1):
            x, step = minima[k], 1 << k
            if forward:  # [j, j + step) has only larger positions
                ok = j + step <= n
                ok[ok] = x[j[ok]] >= at[ok]
                j[ok] += step
            else:
                ok = j >= step
                ok[ok] = x[j[ok] - step] >= at[ok]
                j[ok] -= step
        some = np.flatnonzero(j < n if forward else j > 0)
        p, q = at[some].copy(), order[j[some] if forward else j[some] - 1].copy()
        size = np.zeros(len(some), np.int64)
        for step, level in reversed(levels):
            same = (p + step <= n) & (q + step <= n)
            same[same] = level[p[same]] == level[q[same]]
            size[same] += step
            p[same] += step
            q[same] += step
        best[some] = np.maximum(best[some], np.minimum(size, depth))
    return best


def _factor(length: int, n: int) -> Callable:
    """Spans of the windows whose longest previous factor has ``length`` bytes."""

    def solve(runs: np.ndarray, parts: list[bytes]) -> np.ndarray:
        lens = np.array([len(x) for x in parts])
        begin = np.cumsum(lens + 1) - lens - 1
        text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)  # no UTF-8 text holds this byte
        count = runs["n"].astype(np.int64)
        owner = np.repeat(np.arange(len(runs)), count)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        hit = longest_previous_factor(text, length, begin[owner] + step) >= length
        owner, step = owner[hit], step[hit]
        if not len(owner):
            return np.empty(0, _SPAN)
        first = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(step) != 1)]))
        out = np.empty(len(first), _SPAN)
        out["doc"], out["hash"] = runs["doc"][owner[first]], runs["hash"][owner[first]]
        out["start"] = runs["start"][owner[first]] + step[first]
        out["n"] = np.diff(np.append(first, len(owner))) + length - 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, texts = [], []
        for batch in batches:
            for packed, body in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = _unpack(packed, _OPEN)
                raw = pa.decompress(body[8:], int.from_bytes(body[:8], "little"), _CODEC, asbytes=True)
                ends = np.cumsum(x["n"].astype(np.int64) + length - 1).tolist()
                texts += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                runs.append(x)
        if not runs:
            return
        x = np.concatenate(runs)
        order = np.lexsort((x["start"], x["hash"], x["doc"], x["gram"]))
        x = x[order]
        fresh = np.ones(len(x), bool)  # a repeated row is the same document
        fresh[1:] = np.any([x[f][1:] != x[f][:-1] for f in ("gram", "doc", "hash", "start")], axis=0)
        x, order = x[fresh], order[fresh]
        group_end = np.append(np.flatnonzero(x["gram"][1:] != x["gram"][:-1]) + 1, len(x))
        size = np.cumsum(x["n"].astype(np.int64) + length)
        a = 0
        found = []
        while a < len(x):
            base = size[a - 1] if a else 0
            fits = group_end[(group_end > a) & (size[group_end - 1] - base <= ARRAY_BYTES)]
            b = int(fits[-1]) if len(fits) else int(group_end[group_end > a][0])
            found.append(solve(x[a:b], [texts[i] for i in order[a:b]]))
            a = b
        gone = np.concatenate(found)
        if len(gone):
            yield _rows(1, [(i, _pack(p)) for i, p in _by_bucket(gone, _doc_bucket(gone, n))])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    named = np.dtype([("start", "<i4"), ("n", "<i4")])
    for batch in batches:
        data, offsets = textbuf.buffers(batch.column(1))
        kept, starts, ends = [], [], []
        for i, blob in enumerate(batch.column(2).to_pylist()):
            text = data[offsets[i] : offsets[i + 1]]
            if blob is None:
                kept.append(text.tobytes())
                starts.append([])
                ends.append([])
                continue
            x = _unpack(blob, named)
            change = np.zeros(len(text) + 1, np.int32)
            np.add.at(change, x["start"], 1)
            np.add.at(change, x["start"] + x["n"], -1)
            gone = np.cumsum(change) > 0  # its last entry is False
            edge = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)))
            kept.append(text[~gone[:-1]].tobytes())
            starts.append(edge[::2].tolist())
            ends.append(edge[1::2].tolist())
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(kept, pa.binary()), pa.array(starts, longs), pa.array(ends, longs)], ["doc_id", "n_bytes", "kept", "starts", "ends"])


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, kept binary, starts, ends``: each text without the bytes that repeat earlier ones.

    A byte goes if a string of ``length`` bytes (64 to 128) over it also starts earlier: in a
    smaller id, or earlier in the same document. ``starts`` and ``ends`` are the maximal
    removed runs in bytes. Null texts are empty; a null id comes first; rows of one id with
    different texts are ordered by a hash of the text; a repeated row is one document, and
    all its rows get the same result.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    no_id = F.lit(-(1 << 63)).cast("long")
    slim = docs.select(
        F.coalesce(F.col(id_col).cast("long"), no_id).alias("doc"),
        F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 32)).alias("hash"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    first = slim.mapInArrow(_map_runs(length, n), _BLOB).repartition(n, "bucket").mapInArrow(_reduce_runs(length, n), _BLOB)
    first = materialise(first, "runs")
    open_runs = first.where("kind = 2").repartition(n, "bucket").mapInArrow(_per_document(_OPEN, ["gram", "start", "n"]), "d long, h long, blob binary")
    on = (F.col("doc") == F.col("d")) & (F.col("hash") == F.col("h"))
    shipped = slim.join(open_runs.select(F.coalesce("d", no_id).alias("d"), F.coalesce("h", F.lit(0).cast("long")).alias("h"), "blob"), on)
    shipped = shipped.select("doc", "hash", "text", "blob").mapInArrow(_ship(length, n), "bucket int, runs binary, body binary")
    factored = shipped.repartition(n, "bucket").mapInArrow(_factor(length, n), _BLOB)
    gone = first.where("kind = 1").unionByName(factored).repartition(n, "bucket").mapInArrow(_per_document(_SPAN, ["start", "n"]), "d long, h long, blob binary")
    rows = slim.join(gone, on, "left").select("doc", "text", "blob")
    out = rows.mapInArrow(_cut, "doc_id long, n_bytes long, kept binary, starts array<long>, ends array<long>")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != no_id, F.col("doc_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Every 100-byte window as hexadecimal digits; the first place of each stays.
ORACLE = """
WITH hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (
  SELECT doc_id, p, md5_number_lower(substr(x, CAST(2 * p + 1 AS BIGINT), 200)) AS w, md5_number_upper(substr(x, CAST(2 * p + 1 AS BIGINT), 200)) AS v
  FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS p FROM hexed WHERE length(x) >= 200)),
later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w, v ORDER BY doc_id, p) AS r FROM windows) WHERE r > 1),
marked AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS fresh FROM later),
numbered AS (SELECT doc_id, p, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM marked),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, g),
gaps AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b, a = min(a) OVER (PARTITION BY doc_id) AS first, a AS s FROM spans),
kept AS (
  SELECT doc_id, 0 AS a, s AS b FROM gaps WHERE first
  UNION ALL SELECT doc_id, a, b FROM gaps),
joined AS (
  SELECT h.doc_id, string_agg(substr(h.x, CAST(2 * k.a + 1 AS BIGINT), CAST(2 * (coalesce(k.b, length(h.x) // 2) - k.a) AS BIGINT)), '' ORDER BY k.a) AS x
  FROM hexed h JOIN kept k USING (doc_id) GROUP BY h.doc_id)
SELECT h.doc_id, CAST(length(h.x) // 2 AS BIGINT) AS n_bytes,
  CAST(coalesce(s.gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(s.n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(j.x, h.x))) AS kept_sha256
FROM hexed h LEFT JOIN joined j USING (doc_id)
LEFT JOIN (SELECT doc_id, sum(b - a) AS gone, count(*) AS n FROM spans GROUP BY doc_id) s USING (doc_id)
"""
