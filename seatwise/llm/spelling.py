"""Spelling variants: words one edit apart, and the form that each is taken to stand for.

One edit leaves one half of a word whole. Automata over the halves of all words, in shards by
hash of the half, are run over all words: a half found at the right end of a word whose length
differs by at most one names its owners as candidates, which are then verified. A word visits
only the shards that a half of a word of about its length can be in. A half of very many words
is split further by what is left of each word without it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hot import join_hot
from .scratch import materialise, shuffle_partitions, table

RUN = r"[A-Za-zÀ-ÿ]+"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: One run in so many of a document's distinct runs loses a letter; the least word, and the least count of a word.
NOISE, LETTERS, TIMES = 97, 5, 3
#: Halves of a shard, about; words of a half from which it is split, at least; halves that are split, at most.
SHARD, SHARED, SPLIT = 8192, 1024, 4096
#: Owners of a half from which an index of what is left of them replaces trying each.
_INDEXED = 8


def noisy(doc_id: Column, run: Column) -> Column:
    """A run without the code point that the hash of its document and itself takes, if it takes one."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), run))
    cut = (h % F.char_length(run)).cast("int")
    return F.when(h % NOISE == 0, F.concat(F.substring(run, F.lit(1), cut), F.substring(run, cut + 2, F.char_length(run)))).otherwise(run)


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: words of LETTERS code points or more with TIMES occurrences or more.

    Only A-Z are lower-cased. Null texts have no words and a null id counts as empty.
    """
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(0))).alias("run"))
    low = F.when(F.lower("run") == F.col("run"), F.col("run")).when(F.rlike("run", F.lit(r"[À-ÖØ-Þ]")), F.translate("run", _CAPITALS, _CAPITALS.lower())).otherwise(F.lower("run"))
    words = runs.select("id", low.alias("run")).select(noisy(F.col("id"), F.col("run")).alias("word")).where(F.char_length("word") >= LETTERS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= TIMES)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) != 1:
        return False
    i = next((i for i, x in enumerate(a) if x != b[i]), len(a))
    return a[i:] == b[i + 1 :]


def without_one(s: str) -> set[str]:
    """``s`` and what is left of it without one code point; strings at most one edit apart have one in common."""
    return {s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}


HEAD, TAIL = 0, 1


def halves(word: str) -> list[tuple[int, str, str]]:
    """Side, half and rest of both halves."""
    k = len(word) // 2
    return [(HEAD, word[:k], word[k:]), (TAIL, word[k:], word[:k])]


def possible_halves(word: str, least: int = LETTERS) -> list[tuple[int, str, str]]:
    """Side, half and rest of all halves that a word one edit away may share."""
    sizes = {n // 2 for n in range(max(least, len(word) - 1), len(word) + 2)}, {n - n // 2 for n in range(max(least, len(word) - 1), len(word) + 2)}
    return [(HEAD, word[:k], word[k:]) for k in sizes[0] if k <= len(word)] + [(TAIL, word[len(word) - k :], word[: len(word) - k]) for k in sizes[1] if k <= len(word)]


class Shards:
    """Where halves are: ``n`` shards, and the parts of the halves of very many words."""

    def __init__(self, n: int, split: dict[tuple[int, str], int]) -> None:
        self.n, self.split = n, split

    def of(self, side: int, half: str, part: int = 0) -> int:
        return zlib.crc32(f"{side}:{part}:{half}".encode()) % self.n

    def part(self, variant: str, parts: int) -> int:
        return zlib.crc32(variant.encode()) % parts

    def all(self, side: int, half: str, rest: str) -> set[int]:
        """The shards in which words with this half and rest meet."""
        parts = self.split.get((side, half))
        if not parts:
            return {self.of(side, half)}
        return {self.of(side, half, p) for p in {self.part(v, parts) for v in without_one(rest)}}

    def first(self, side: int, half: str, rest: str, other: str) -> int:
        """Of the shards in which two words with this half meet the one that counts them."""
        parts = self.split.get((side, half))
        return self.of(side, half, self.part(min(without_one(rest) & without_one(other)), parts)) if parts else self.of(side, half)


_DEALT = pa.schema([("shard", pa.int32()), ("kind", pa.int8()), ("word", pa.string()), ("n", pa.int64())])


def _deal(shards: Shards) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each word as an owner of its halves (kind: the side) and, as kind 2, to be scanned once in each shard."""
        for batch in batches:
            out: list[tuple] = []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for side, half, rest in halves(word):
                    out += [(s, side, word, n) for s in shards.all(side, half, rest)]
                out += [(s, 2, word, n) for s in set().union(*(shards.all(*x) for x in possible_halves(word)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _DEALT, strict=True)], schema=_DEALT)

    return run


class _Half:
    """The owners of one half at one end of a word."""

    def __init__(self) -> None:
        self.owners: list[tuple[int, str]] = []
        self.index: dict[str, list[int]] | None = None

    def near(self, rest: str) -> Iterable[tuple[int, str]]:
        """Owners (number and rest) that may be one edit from a word with this rest."""
        if len(self.owners) < _INDEXED:
            return self.owners
        if self.index is None:
            self.index = {}
            for i, (_, own) in enumerate(self.owners):
                for v in without_one(own):
                    self.index.setdefault(v, []).append(i)
        found = {i for v in without_one(rest) for i in self.index.get(v, ())}
        return [self.owners[i] for i in found]


def near_words(shards: Shards, shard: int, owners: list[tuple[int, str, int]], scanned: Iterable[tuple[str, int]]) -> list[tuple[str, int, int, str]]:
    """Of each owner ``(side, word, n)`` in a shard with near words among the scanned: word, their number, and the most frequent one's count and word.

    Each pair is counted in one shard: by its head where both words have it, else by its tail.
    """
    ends: dict[str, tuple[_Half, _Half]] = {}
    for i, (side, word, _) in enumerate(owners):
        k = len(word) // 2
        half, rest = (word[:k], word[k:]) if side == HEAD else (word[k:], word[:k])
        ends.setdefault(half, (_Half(), _Half()))[side].owners.append((i, rest))
    automaton = ahocorasick.Automaton()
    for half, both in ends.items():
        automaton.add_word(half, (half, both))
    if not ends:
        return []
    automaton.make_automaton()
    count, best = [0] * len(owners), [None] * len(owners)
    for v, n in scanned:
        for end, (half, both) in automaton.iter(v):
            found = []
            if both[HEAD].owners and end + 1 == len(half):
                found.append((HEAD, v[len(half) :]))
            if both[TAIL].owners and end + 1 == len(v):
                found.append((TAIL, v[: len(v) - len(half)]))
            for side, rest in found:
                for i, own in both[side].near(rest):
                    w = owners[i][1]
                    if abs(len(w) - len(v)) > 1 or not one_edit(own, rest) or (side == TAIL and v.startswith(w[: len(w) // 2])):
                        continue
                    if shards.first(side, half, own, rest) != shard:
                        continue
                    count[i] += 1
                    if best[i] is None or (-n, v) < best[i]:
                        best[i] = (-n, v)
    return [(owners[i][1], count[i], -best[i][0], best[i][1]) for i in range(len(owners)) if count[i]]


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("most", pa.int64()), ("form", pa.string())])


def _scan(shards: Shards) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards one after another, the owners of each before the words to be scanned."""
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for shard, own in groupby(rows, key=itemgetter(0)):
            owners, first = [], None
            for r in own:
                if r[1] == 2:
                    first = r
                    break
                owners.append(r[1:])
            if owners and first:
                out = near_words(shards, shard, owners, (r[2:] for r in chain([first], own)))
                for a in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[a : a + 10_000]), _NEAR, strict=True)], schema=_NEAR)

    return run


def near_forms(words: DataFrame) -> DataFrame:
    """``word, n_near, most, form`` for words of ``words (word, n)`` with near words: their number and the most frequent, ties by code point.

    Words are not null and each is there once. Each pair is counted in one task, and only counts
    of a word's shards meet again.
    """
    spark, total = words.sparkSession, words.count()
    if not total:
        return spark.createDataFrame([], "word string, n_near long, most long, form string")
    least = max(SHARED, 2 * total // SPLIT)  # so at most SPLIT halves are split
    k = F.floor(F.char_length("word") / 2).cast("int")
    ends = F.array(F.struct(F.lit(HEAD).alias("side"), F.substring("word", F.lit(1), k).alias("half")), F.struct(F.lit(TAIL).alias("side"), F.substring(F.col("word"), k + 1, F.char_length("word")).alias("half")))
    shared = words.select(F.inline(ends)).groupBy("side", "half").count().where(F.col("count") > least).collect()  # SPLIT rows at most
    # a word lies in a part for each code point of its rest, so there are some eight parts for one
    shards = Shards(max(shuffle_partitions(spark), -(-2 * total // SHARD)), {(r.side, r.half): 8 * -(-r["count"] // least) for r in shared})
    dealt = words.select("word", "n").mapInArrow(_deal(shards), "shard int, kind byte, word string, n long")
    met = dealt.repartition(shards.n, "shard").sortWithinPartitions("shard", "kind")
    found = met.mapInArrow(_scan(shards), "word string, n_near long, most long, form string")
    best = F.min(F.struct((-F.col("most")).alias("less"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("most"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``forms (word, form)``: the last word on following forms, which must not go round.

    Each round doubles the steps that words have taken; a form has at least twice the count of
    its word, so there are few rounds. Words on their way to one form are split.
    """
    up = materialise(forms.select("word", F.col("form").alias("root")), "spelling-up")
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if up.select("root").distinct().join(further, "root", "left_semi").isEmpty():
            return up
        met = join_hot(up, further, "root")
        up = materialise(met.select("word", F.coalesce("_next", "root").alias("root")), "spelling-up")


def variants(words: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every row of ``words (word, n)``.

    A word's form is its near word of the largest count (ties: the least in code-point order), if that is at
    least twice its own, else null; without one a word is its own root. No words give no rows.
    """
    words = materialise(words, "spelling-words")
    near = words.join(near_forms(words), "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)).cast("long"))
    known = F.col("most") >= 2 * F.col("n")
    near = materialise(near.select("word", "n", "n_near", F.when(known, F.col("form")).alias("form"), F.when(known, F.col("most")).alias("form_n")), "spelling-near")
    return near.join(roots(near.where("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(count_words(table(spark, sf_dir, "documents"))).select("word", "form", "root", "n", "n_near", "form_n")
