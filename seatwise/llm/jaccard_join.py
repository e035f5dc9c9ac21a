"""Exact Jaccard self-join on word shingles, with set-relation skipping.

Three passes over the texts, none of which keeps text in a shuffle but the last, and that
only for documents with a candidate partner:

1. the size and a 128-bit digest of each document's shingle set; documents of equal sets form
   one class from here on;
2. sets of like sizes deal their shingles by hash to about twice the parts that two linked
   sets can differ in, so linked sets have about half their parts equal; a set with too few
   parts that any other set has drops out, and of the rest the rarest parts, as many as one
   equal part must be among, connect candidates;
3. the whole sets of each candidate group meet, in blocks of bounded size, and
   ``count_links`` answers them from inverted lists with position-ordered blocks, deriving
   a set's overlaps from those of a highly similar set.

Only counts, per-set roots and slim rows leave Python; pairs are never rows.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbuf
from .components import connected_components
from .scratch import key_filter, materialise, quoted, shuffle_partitions, table

#: Sets and shingles in one block of a candidate group; two blocks meet in a task.
BLOCK_SETS, BLOCK_TOKENS = 4096, 2_000_000
#: Digests of parts and of sets are cut to 48 bits here; equal ones only make a group larger.
#: ``need`` is twice the parts that a linked set must share, at most 2 ** 16 - 2, plus one in the scheme below the set's own.
_POSTING = np.dtype([("part_low", "<u4"), ("part_high", "<u2"), ("key_low", "<u4"), ("key_high", "<u2"), ("need", "<u2")])
_SHARED = np.dtype([*_POSTING.descr, ("sets", "<u4")])
_CUT = (1 << 48) - 1
_MOST_NEED = (1 << 15) - 1


def _set_keys(grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set: the sum and the exclusive or of differently mixed members."""
    n = len(bounds) - 1
    one, two = textbuf.splitmix(grams ^ np.uint64(0xA5A5A5A5)), textbuf.splitmix(grams + np.uint64(0x1234567))
    k1, k2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(some):
        k1[some] = np.add.reduceat(one, bounds[some])
        k2[some] = np.bitwise_xor.reduceat(two, bounds[some])
    return k1.view(np.int64), k2.view(np.int64)


def _profile(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, grams, bounds in textbuf.shingle_sets(batch.column(2), k):
                n, (k1, k2) = len(bounds) - 1, _set_keys(grams, bounds)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array(np.diff(bounds)), pa.array(k1), pa.array(k2)], ["doc_id", "text_hash", "n", "k1", "k2"])

    return run


class Schemes:
    """How many parts the sets of a size class have.

    Scheme c serves pairs whose smaller set is of class c; the larger one may be of the next
    class. Its parts exceed the most by which two linked sets of it can differ by more than
    ``spare``, so more than ``spare`` parts are equal, and all of them but the empty parts of
    either set have members. Sets with more than ``spare`` empty parts share one further digest.
    """

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.ratio = max(1.25, (den / num) ** 2)
        self.low, self.parts, self.spare = [1], [], []
        self._grow(1)

    def _grow(self, size: int) -> None:
        while self.low[-1] <= size:
            lo = self.low[len(self.parts)]
            hi = max(lo + 1, int(lo * self.ratio))
            longest = (hi - 1) * self.den // self.num
            differ = (self.den - self.num) * (hi - 1 + longest) // (self.den + self.num)
            empty = 2 * (differ + 1) * math.exp(-lo / (2 * (differ + 1)))
            spare = max(differ + 1, math.ceil(empty + 4 * math.sqrt(empty)))
            self.parts.append(differ + 1 + spare if differ else 0)
            self.spare.append(spare)
            self.low.append(hi)

    def of(self, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(sets, their scheme): each set in its own class, and in the one below if a partner may be there."""
        self._grow(int(sizes.max(initial=1)))
        low = np.array(self.low)
        own = np.searchsorted(low, sizes, "right") - 1
        yield np.flatnonzero(sizes > 0), own[sizes > 0]
        below = np.flatnonzero((own > 0) & (self.num * sizes <= self.den * (low[np.maximum(own, 0)] - 1)))
        yield below, own[below] - 1


def part_digests(grams: np.ndarray, bounds: np.ndarray, schemes: Schemes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of the parts of each set, the sets they belong to, and the ``need`` of those.

    Linked sets of different members share as many digests of one scheme as the greater need of both.
    """
    mixed = textbuf.splitmix(grams ^ np.uint64(0x5DEECE66D))
    halves = [(mixed & np.uint64(0xFFFFFFFF)).astype(np.float64), (mixed >> np.uint64(32)).astype(np.float64)]
    sizes = np.diff(bounds)
    out, owners, needs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for below, (sets, scheme) in enumerate(schemes.of(sizes)):
        parts = np.array(schemes.parts)[scheme]
        sets, scheme, parts = sets[parts > 0], scheme[parts > 0], parts[parts > 0]
        if not len(sets):
            continue
        first = np.cumsum(parts) - parts
        member = np.repeat(bounds[:-1][sets] - (np.cumsum(sizes[sets]) - sizes[sets]), sizes[sets]) + np.arange(sizes[sets].sum())
        part = np.repeat(first, sizes[sets]) + ((grams[member] >> np.uint64(8)) % np.repeat(parts, sizes[sets]).astype(np.uint64)).astype(np.int64)
        total = int(parts.sum())
        sums = [np.bincount(part, weights=h[member], minlength=total).astype(np.uint64) for h in halves]  # exact below 2 ** 53
        count = np.bincount(part, minlength=total)
        number = np.arange(total) - np.repeat(first, parts)
        salt = (np.repeat(scheme, parts).astype(np.uint64) << np.uint64(40)) + number.astype(np.uint64)
        digest = textbuf.splitmix(sums[0] ^ textbuf.splitmix(sums[1] ^ textbuf.splitmix(salt)))
        left = np.array(schemes.spare)[scheme] + 1 - np.add.reduceat(count == 0, first)
        need = 2 * np.clip(left, 1, _MOST_NEED) + below
        out.append(digest[count > 0])
        owners.append(np.repeat(sets, parts)[count > 0])
        needs.append(np.repeat(need, parts)[count > 0])
        over = left < 1
        out.append(textbuf.splitmix(scheme[over].astype(np.uint64) ^ np.uint64(0xE117)))
        owners.append(sets[over])
        needs.append(np.full(int(over.sum()), below))
    return np.concatenate(out), np.concatenate(owners), np.concatenate(needs)


def _planes(x: np.ndarray) -> bytes:
    """The numbers byte by byte, high bytes last, so that the zeros of small ones compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).reshape(-1).view("<u8")


def _pack(posts: np.ndarray) -> bytes:
    """Postings in the order of their parts: the steps from part to part, and which owner of a table each has."""
    part = _joined(posts, "part")
    order = np.argsort(part, kind="stable")
    posts, part = posts[order], part[order]
    owners, which = np.unique((_joined(posts, "key") << 16) | posts["need"], return_inverse=True)
    body = _planes(np.diff(part, prepend=0)) + _planes(which) + _planes(owners)
    if "sets" in posts.dtype.names:
        body += _planes(posts["sets"])
    head = np.array([len(posts), len(owners), len(body)], "<u8").tobytes()
    return head + pa.compress(body, "zstd", asbytes=True)


def _unpack(blob: bytes, kind: np.dtype) -> np.ndarray:
    n, m, size = np.frombuffer(blob, "<u8", 3).tolist()
    body, out = pa.decompress(blob[24:], size, "zstd", asbytes=True), np.empty(n, kind)
    part, owner = np.cumsum(_numbers(body, n)), _numbers(body[16 * n :], m)[_numbers(body[8 * n :], n).astype(np.int64)]
    for name, value in (("part", part), ("key", owner >> np.uint64(16))):
        out[f"{name}_low"], out[f"{name}_high"] = value & np.uint64(0xFFFFFFFF), value >> np.uint64(32)
    out["need"] = owner & np.uint64(0xFFFF)
    if "sets" in kind.names:
        out["sets"] = _numbers(body[16 * n + 8 * m :], n)
    return out


def _dealt(posts: np.ndarray, by: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """The postings as one blob a bucket."""
    bucket = (by % np.uint32(n_buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    posts, bucket = posts[order], bucket[order]
    ids, first = np.unique(bucket, return_index=True)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([_pack(x) for x in np.split(posts, first[1:])], pa.binary())], ["bucket", "posts"])


def _gathered(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> np.ndarray:
    blobs = [_unpack(x.as_py(), kind) for batch in batches for x in batch.column(1)]
    return np.concatenate(blobs) if blobs else np.empty(0, kind)


def _joined(posts: np.ndarray, name: str) -> np.ndarray:
    """The 48 bits of ``part`` or ``key``."""
    return posts[f"{name}_low"].astype(np.int64) | (posts[f"{name}_high"].astype(np.int64) << 32)


def _parts(k: int, num: int, den: int, n_buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schemes = Schemes(num, den)
        for batch in batches:
            out, seen = [], np.zeros(0, np.int64)
            for _, grams, bounds in textbuf.shingle_sets(batch.column(0), k):
                keys, _ = _set_keys(grams, bounds)
                digest, owner, need = part_digests(grams, bounds, schemes)
                fresh = np.zeros(len(keys), bool)  # equal sets of a batch go once
                fresh[np.unique(keys, return_index=True)[1]] = True
                fresh &= ~np.isin(keys, seen)
                seen = np.concatenate([seen, keys[fresh]])
                digest, owner, need = (x[fresh[owner]] for x in (digest, owner, need))
                posts, key = np.empty(len(digest), _POSTING), keys[owner]
                posts["part_low"], posts["part_high"] = digest & np.uint64(0xFFFFFFFF), (digest >> np.uint64(32)) & np.uint64(0xFFFF)
                posts["key_low"], posts["key_high"] = key & 0xFFFFFFFF, (key >> 32) & 0xFFFF
                posts["need"] = need
                out.append(posts)
            posts = np.concatenate(out) if out else np.empty(0, _POSTING)
            if len(posts):
                yield _dealt(posts, posts["part_low"], n_buckets)

    return run


def _shared_parts(n_buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Postings of the parts that several sets have, with how many, dealt by set."""
        posts = _gathered(batches, _POSTING)
        if not len(posts):
            return
        part, key = _joined(posts, "part"), _joined(posts, "key")
        order = np.lexsort((posts["need"], key, part))
        posts, part, key = posts[order], part[order], key[order]
        fresh = np.ones(len(posts), bool)
        fresh[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (posts["need"][1:] != posts["need"][:-1])
        posts, part, key = posts[fresh], part[fresh], key[fresh]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        new = np.ones(len(part), np.int64)
        new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1])
        sets = np.add.reduceat(new, starts)
        sets = np.repeat(sets, np.diff(np.append(starts, len(part))))
        kept = np.flatnonzero(sets > 1)
        for a in range(0, len(kept), 1_000_000):
            at = kept[a : a + 1_000_000]
            out = np.empty(len(at), _SHARED)
            for name in _POSTING.names:
                out[name] = posts[name][at]
            out["sets"] = sets[at]
            yield _dealt(out, out["key_low"], n_buckets)

    return run


def _rarest_parts(n_buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each set with enough shared parts its rarest, dealt by part.

        Linked sets share ``need`` parts; the rarest of these is among the first ``m - need + 1``
        of the ``m`` shared parts of both, in one order of all parts.
        """
        posts = _gathered(batches, _SHARED)
        if not len(posts):
            return
        part, key = _joined(posts, "part"), _joined(posts, "key")
        order = np.lexsort((part, posts["sets"], posts["need"], key))
        posts, key = posts[order], key[order]
        edge = np.ones(len(key), bool)
        edge[1:] = (key[1:] != key[:-1]) | (posts["need"][1:] != posts["need"][:-1])
        starts = np.flatnonzero(edge)
        m = np.diff(np.append(starts, len(key)))
        kept = np.arange(len(key)) - np.repeat(starts, m) <= np.repeat(m - (posts["need"][starts].astype(np.int64) >> 1), m)
        posts = posts[kept]
        for a in range(0, len(posts), 1_000_000):
            out = np.empty(len(posts[a : a + 1_000_000]), _POSTING)
            for name in _POSTING.names:
                out[name] = posts[name][a : a + 1_000_000]
            yield _dealt(out, out["part_low"], n_buckets)

    return run


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of the sets that have an equal part."""
    posts = _gathered(batches, _POSTING)
    part, key = _joined(posts, "part"), _joined(posts, "key")
    order = np.argsort(part)
    part, key = part[order], key[order]
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    if not len(starts):
        return
    least = np.repeat(np.minimum.reduceat(key, starts), np.diff(np.append(starts, len(key))))
    other = key != least
    pairs = np.unique(np.stack([key[other], least[other]]), axis=1) if other.any() else np.zeros((2, 0), np.int64)
    for a in range(0, pairs.shape[1], 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0, a : a + 100_000]), pa.array(pairs[1, a : a + 100_000])], ["u", "v"])


def _whole_sets(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, grams, bounds in textbuf.shingle_sets(batch.column(0), k):
                n, (k1, k2) = len(bounds) - 1, _set_keys(grams, bounds)
                blobs = [grams[i:j].tobytes() for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), batch.column(1).slice(a, n), batch.column(2).slice(a, n), batch.column(3).slice(a, n), pa.array(blobs, pa.binary())], ["k1", "k2", "mult", "comp", "n_blocks", "grams"])

    return run


def count_links(sets: list[np.ndarray], num: int, den: int, mult: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted link counts and component labels (least index) of the sets.

    Sets are sorted distinct hashes. Two link when ``den * |x & y| >= num * |x | y|``. Where
    ``block`` holds two values, only pairs across them count.
    """
    n = len(sets)
    order = np.argsort([len(x) for x in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order], np.int64)
    mult, block = mult[order], block[order]
    cross = len(np.unique(block)) > 1
    flat = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(n), size)
    _, token, freq = np.unique(flat, return_inverse=True, return_counts=True)
    by_freq = np.argsort(freq, kind="stable")
    rank = np.empty(len(freq), np.int64)
    rank[by_freq] = np.arange(len(freq))
    token = rank[token]
    o = np.lexsort((token, owner))
    token = token[o]  # each set's tokens, rarest first
    bound = np.concatenate([[0], np.cumsum(size)])
    o = np.argsort(token, kind="stable")
    full, full_at = owner[o], np.concatenate([[0], np.cumsum(freq[by_freq])])
    need = (num * size + den - 1) // den
    prefix = size - need + 1
    pos = np.arange(len(token)) - np.repeat(bound[:-1], size)
    inside = np.flatnonzero(pos < np.repeat(prefix, size))
    o = inside[np.lexsort((owner[inside], pos[inside], token[inside]))]  # lists by token; in each, blocks of one position
    list_pos, list_set = pos[o], owner[o]
    list_at = np.searchsorted(token[o], np.arange(len(freq) + 1))
    lowest = np.searchsorted(size, need)  # the first set long enough for each

    links, label = np.zeros(n, np.int64), np.arange(n)
    known: OrderedDict[int, np.ndarray] = OrderedDict()

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    def lists(tokens: np.ndarray) -> np.ndarray:
        parts = [full[full_at[t] : full_at[t + 1]] for t in tokens]
        return np.bincount(np.concatenate(parts), minlength=n) if parts else np.zeros(n, np.int64)

    for x in range(n):
        own = token[bound[x] : bound[x + 1]]
        lo, sx = int(lowest[x]), int(size[x])
        if lo >= x:
            continue
        found = []
        least = -(-num * (sx + int(size[lo])) // (num + den))  # the overlap that the shortest partner needs
        for i in range(int(prefix[x])):
            a, b = list_at[own[i]], list_at[own[i] + 1]
            if b - a < 2:
                continue
            b = a + np.searchsorted(list_pos[a:b], sx - least, "right")  # blocks of later positions can't reach it
            got = list_set[a:b]
            got = got[(got >= lo) & (got < x)]
            if len(got):
                found.append(got)
        if not found:
            continue
        cand = np.unique(np.concatenate(found))
        if cross:
            cand = cand[block[cand] != block[x]]
            if not len(cand):
                continue
        overlap = None
        for y in reversed(known):
            other = token[bound[y] : bound[y + 1]]
            more, less = np.setdiff1d(own, other, True), np.setdiff1d(other, own, True)
            if 2 * (len(more) + len(less)) <= sx:
                overlap = known[y] + lists(more) - lists(less)
                break
        if overlap is None:
            overlap = lists(own)
            known[x] = overlap
            if len(known) > 16:
                known.popitem(last=False)
        both = overlap[cand]
        good = cand[den * both >= num * (sx + size[cand] - both)]
        if len(good):
            links[x] += mult[good].sum()
            links[good] += mult[x]
            roots = {root(int(x))} | {root(int(g)) for g in np.unique(label[good])}
            r = min(roots)
            for q in roots:
                label[q] = r
    label = np.array([root(i) for i in range(n)])
    out_links, out_label = np.zeros(n, np.int64), np.zeros(n, np.int64)
    out_links[order], out_label[order] = links, order[label]
    return out_links, out_label


def _answer(num: int, den: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(at: tuple[int, int, int], group: dict) -> pa.RecordBatch | None:
            keys = list(group)
            if len(keys) < 2 or len({own for _, own, _ in group.values()}) < len(set(at[1:])):  # the other block is empty
                return None
            links, label = count_links([np.frombuffer(group[q][2], np.uint64) for q in keys], num, den, np.array([group[q][0] for q in keys], np.int64), np.array([group[q][1] for q in keys], np.int64))
            some = np.flatnonzero(links > 0)
            if not len(some):
                return None
            k = np.array(keys, np.int64)
            least = {int(r): min(map(tuple, k[label == r].tolist())) for r in np.unique(label[some])}
            r = np.array([least[int(label[i])] for i in some], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(k[some, 0]), pa.array(k[some, 1]), pa.array(links[some]), pa.array(r[:, 0]), pa.array(r[:, 1])], ["k1", "k2", "links", "r1", "r2"])

        at, group = None, {}
        for batch in batches:
            for comp, bi, bj, own, k1, k2, mult, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (comp, bi, bj) != at:
                    if group and (out := solve(at, group)) is not None:
                        yield out
                    at, group = (comp, bi, bj), {}
                group[k1, k2] = (mult, own, grams)
        if group and (out := solve(at, group)) is not None:
            yield out

    return run


def jaccard_classes(docs: DataFrame, shingle: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, text_hash, n_shingles, n_links, component_id, is_first``.

    Documents link when ``den * |A & B| >= num * |A | B|`` for their sets of distinct
    ``shingle``-word shingles; a text of fewer words is one shingle, an empty or null one has
    none and links with nothing. ``component_id`` is the least id reachable by links,
    ``n_links`` counts linked rows (equal sets included), ``is_first`` marks the rows of the
    first text (by id, then text hash) of each component. A null id sorts after all others;
    repeated rows count one by one, and all rows of the first text are marked.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    rows = materialise(slim.mapInArrow(_profile(shingle), "doc_id long, text_hash long, n long, k1 long, k2 long"), "profile")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    classes = materialise(rows.where("n > 0").groupBy("k1", "k2").agg(F.count("*").alias("mult"), first.alias("first"), F.first("n").alias("n")), "classes")

    posts = slim.select("text")
    for step in (_parts(shingle, num, den, parts), _shared_parts(parts), _rarest_parts(parts)):
        posts = posts.mapInArrow(step, "bucket int, posts binary").repartition(parts, "bucket")
    groups = connected_components(posts.mapInArrow(_candidates, "u long, v long"))
    wanted = classes.join(groups.select("node", F.col("root").alias("comp")), F.col("k1").bitwiseAND(_CUT) == F.col("node"))
    totals = wanted.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("n_blocks"), F.count("*").alias("n_sets")).where("n_sets > 1").drop("n_sets")
    wanted = materialise(wanted.join(totals, "comp").select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), "mult", "comp", "n_blocks"), "wanted")
    # merged at every size, so that the plan and its shuffle do not change with the input
    near = key_filter(wanted.select("text_hash"))
    texts = slim.where(near(F.col("text_hash"))).join(wanted.withColumnRenamed("doc_id", "id").withColumnRenamed("text_hash", "hash").hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    sets = texts.select("text", "mult", "comp", "n_blocks").mapInArrow(_whole_sets(shingle), "k1 long, k2 long, mult long, comp long, n_blocks int, grams binary")
    own = F.pmod(F.xxhash64("k1", "k2"), F.col("n_blocks")).cast("int")
    met = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    met = met.select("comp", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "k1", "k2", "mult", "grams")
    met = met.repartition(parts, "comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj")
    answers = materialise(met.mapInArrow(_answer(num, den), "k1 long, k2 long, links long, r1 long, r2 long"), "answers")

    key = F.struct("k1", "k2")
    linked = connected_components(answers.select(key.alias("u"), F.struct(F.col("r1").alias("k1"), F.col("r2").alias("k2")).alias("v")))
    counted = answers.groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    labelled = classes.join(counted, ["k1", "k2"], "left").join(linked.select("node.k1", "node.k2", "root"), ["k1", "k2"], "left")
    labelled = labelled.withColumn("root", F.coalesce("root", key)).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("mult") - 1)
    heads = labelled.groupBy("root").agg(F.min("first").alias("head"))
    labelled = labelled.join(heads, "root").select("k1", "k2", "links", "head")
    out = rows.join(labelled, ["k1", "k2"], "left")
    alone = F.col("n") == 0
    return out.select(
        "doc_id",
        "text_hash",
        F.col("n").alias("n_shingles"),
        F.when(alone, 0).otherwise(F.col("links")).cast("long").alias("n_links"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash")))).alias("is_first"),
    )


def keep_first(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each group of near copies: a row of its first text, by id (null last) and text hash.

    Null, empty and blank texts are near nothing, so all their rows stay, as do all texts
    without a near copy, however short or long. Of repeated rows, and of rows of one id and
    one text, one stays. An empty table gives an empty one, and columns may have any names.
    Only rows that may have to go are shuffled.
    """
    found = jaccard_classes(docs, shingle, num, den).where("n_shingles > 0")
    same = found.groupBy("doc_id", "text_hash").agg(F.first("is_first").alias("is_first"), F.count("*").alias("n"))
    doubt = same.where("n > 1 OR NOT is_first").select(F.col("doc_id").isNull().alias("_no"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("text_hash").alias("_hash"), "is_first")
    doubt = materialise(doubt, "doubt")
    may_go = key_filter(doubt.select("_hash"))(F.col("_hash"))
    own = F.col("doc_id").cast("long")
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("_row"), own.isNull().alias("_no"), F.coalesce(own, F.lit(0)).alias("_id"), F.xxhash64("text").alias("_hash"))
    clear = rows.where(~may_go).select("_row.*")
    # a row that is its text's only one can only be told from others by a number
    number = F.when(F.col("is_first").isNull(), F.monotonically_increasing_id())
    rest = rows.where(may_go).join(doubt.hint("merge"), ["_no", "_id", "_hash"], "left").where("is_first IS NULL OR is_first")
    rest = rest.withColumn("_number", number).dropDuplicates(["_no", "_id", "_hash", "_number"])
    return clear.unionByName(rest.select("_row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


#: The join by brute force over all pairs of documents with a common shingle.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x for x in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s
  FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, pairs.y FROM reach JOIN pairs ON reach.y = pairs.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CAST(c.component_id AS BIGINT) AS component_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links
FROM sets s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON s.doc_id = c.x
LEFT JOIN (SELECT x, count(*) AS n FROM pairs GROUP BY x) l ON s.doc_id = l.x
"""
