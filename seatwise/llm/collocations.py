"""Collocations: phrases whose words occur together far more often than apart.

Words that are frequent in their language get a number; a piece of text is broken at all other
words. At each word the numbers of up to five words are packed into one binary key of fixed
width, as far as neighbours are frequent as a pair. Keys are sorted and counted run by run within a task, dealt by range, sorted again and
counted by runs of equal prefixes, so that one key a word counts phrases of every length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .hot import join_hot
from .scratch import key_bits, materialise, may_hold, shuffle_partitions, table
from .textbuf import LOWER, buffers, prefix_hash, row_slices, span_hash, splitmix, word_spans

#: The least count of a phrase, words of the longest, and phrases of a language that are returned.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Frequent words with a number, at most (8 bytes each in every task); phrases with others are counted by hashes.
NUMBERED = 1 << 20
#: Bytes of a number, and of text that a kernel takes at a time, about.
WIDTH, SLICE = 3, 2 << 20
#: 1000 a n / (l r), rounded down, in whole numbers of up to 38 digits.
SCORE = "(cast(a as decimal(38, 0)) * cast(n as decimal(20, 0)) * 1000) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
#: Parts in which a language's phrases are ranked first.
_PARTS = 64

_PIECE_ENDS, _BREAKS = np.zeros(256, bool), np.zeros(256, bool)
_PIECE_ENDS[[*b".,;:!?", *range(10, 14)]] = True
_BREAKS[[*b".,;:!?", *range(10, 14), 32, 9]] = True


def _tokens(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of ``text, lang``: bytes, starts, ends, row of the batch, hash with the language, and whether the next word is in the same piece."""
    data, offsets = buffers(batch.column(0))
    langs = batch.column(1).dictionary_encode()
    seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs.dictionary.to_pylist()], np.uint64)
    of_row = seeds[langs.indices.to_numpy()] if len(langs) else np.zeros(0, np.uint64)
    for a, b in row_slices(offsets, SLICE):
        part, off = LOWER[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        start, end, row = word_spans(part, off, _BREAKS)
        if not len(start):
            continue
        words = splitmix(span_hash(prefix_hash(part), start, end) ^ of_row[row + a])
        ends = np.concatenate([[0], np.cumsum(_PIECE_ENDS[part])])
        follows = np.zeros(len(start), bool)
        follows[:-1] = (row[1:] == row[:-1]) & (ends[start[1:]] == ends[end[:-1]])
        yield part, start, end, row + a, words, follows


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(1)
        for part, start, end, row, words, _ in _tokens(batch):
            hashes, first, n = np.unique(words, return_index=True, return_counts=True)
            raw = part.tobytes()
            texts = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            cols = [langs.take(pa.array(row[first])), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "word", "h", "n"])


def _following(values: np.ndarray, follows: np.ndarray) -> list[np.ndarray]:
    """Columns of the values of the words from each on, as far as these are not 0 and in one piece; then 0."""
    n, out = len(values), [values]
    for k in range(1, LONGEST):
        column = np.zeros_like(values)
        if n > k:
            column[: n - k] = np.where((out[-1][: n - k] != 0) & follows[k - 1 : n - 1], values[k:], 0)
        out.append(column)
    return out


def packed(ids: list[np.ndarray]) -> np.ndarray:
    """Rows of big-endian numbers of WIDTH bytes: their byte order is that of the numbers."""
    out = np.empty((len(ids[0]), LONGEST * WIDTH), np.uint8)
    for k, column in enumerate(ids):
        out[:, k * WIDTH : (k + 1) * WIDTH] = column.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - WIDTH :]
    return out


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of rows of bytes, by stable passes over digits of two bytes, the last first."""
    n, width = keys.shape
    even = np.zeros((n, width + width % 2), np.uint8)
    even[:, :width] = keys
    digits = even.view(">u2").astype(np.uint16)
    order = np.arange(n)
    for k in range(digits.shape[1] - 1, -1, -1):
        order = order[np.argsort(digits[order, k], kind="stable")]  # a radix sort for two bytes
    return order


def run_starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    return np.flatnonzero(new)


def _numbers(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Numbers from 1 of the words' hashes among the sorted known ones, 0 for others."""
    if not len(known):
        return np.zeros(len(words), np.uint32)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return np.where(known[at] == words, at + 1, 0).astype(np.uint32)


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _pair_hashes(words: np.ndarray) -> np.ndarray:
    """Of each word and the next one; the last has none."""
    return splitmix(words[:-1] ^ splitmix(words[1:]))


def _pairs(shared: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of neighbouring words with numbers, with their counts."""
        for batch in batches:
            for *_, words, follows in _tokens(batch):
                known = _numbers(words, shared.value) != 0
                hashes, n = np.unique(_pair_hashes(words)[follows[:-1] & known[:-1] & known[1:]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    return run


def _windows(shared: Broadcast, pairs: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys of the words from each on, sorted, with the number of equal ones; text is broken between words that are rare as a pair."""
        for batch in batches:
            for *_, words, follows in _tokens(batch):
                follows[:-1] &= may_hold(pairs.value, _pair_hashes(words))
                ids = _following(_numbers(words, shared.value), follows)
                kept = ids[1] != 0
                keys = packed([x[kept] for x in ids])
                keys = keys[radix_order(keys)]
                starts = run_starts(keys)
                if len(starts):
                    yield pa.RecordBatch.from_arrays([_binary(keys[starts]), pa.array(np.diff(np.append(starts, len(keys))).astype(np.int64))], ["key", "n"])

    return run


def _lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(np.ascontiguousarray(rows).reshape(-1).view(np.int64)))


def _prefix_runs(shared: Broadcast, least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted keys the runs of equal prefixes of each length, as hashes of words; a batch's first and last may go on in others."""
        for batch in batches:
            column = batch.column(0)
            size = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            keys = np.frombuffer(column.buffers()[2], np.uint8)[size[0] : size[-1]].reshape(-1, LONGEST * WIDTH)
            counts = batch.column(1).to_numpy()
            for m in range(2, LONGEST + 1):
                held = np.flatnonzero(keys[:, (m - 1) * WIDTH : m * WIDTH].any(axis=1))
                if not len(held):
                    continue
                prefixes = keys[held, : m * WIDTH]
                starts = run_starts(prefixes)
                sums = np.add.reduceat(counts[held], starts)
                kept = sums >= least
                kept[[0, -1]] = True
                four = np.zeros((int(kept.sum()), m, 4), np.uint8)
                four[:, :, 4 - WIDTH :] = prefixes[starts[kept]].reshape(-1, m, WIDTH)
                ids = four.view(">u4")[:, :, 0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([_lists(shared.value[ids - 1]), pa.array(sums[kept])], ["words", "n"])

    return run


def _rest_phrases(shared: Broadcast, others: tuple[bytes, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phrases with a frequent word that has no number (or one taken for such), by hashes, with their counts."""
        for batch in batches:
            for *_, words, follows in _tokens(batch):
                numbered = _numbers(words, shared.value) != 0
                other = ~numbered & may_hold(others, words)
                held = _following(np.where(numbered | other, words, np.uint64(0)), follows)
                marks = _following(np.where(other, 2, numbered).astype(np.uint8), follows)
                for m in range(2, LONGEST + 1):
                    rows = np.flatnonzero((held[m - 1] != 0) & (np.max(marks[:m], axis=0) == 2))
                    if len(rows):
                        phrases = np.stack([x[rows] for x in held[:m]], axis=1)
                        phrases = phrases[np.lexsort(phrases.T[::-1])]
                        starts = run_starts(phrases)
                        yield pa.RecordBatch.from_arrays([_lists(phrases[starts]), pa.array(np.diff(np.append(starts, len(phrases))).astype(np.int64))], ["words", "n"])

    return run


def frequent_words(texts: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``lang, word, h, n`` of words with ``least`` occurrences in their language, and ``lang, total`` of all words."""
    counts = texts.mapInArrow(_word_counts, "lang string, word string, h long, n long").groupBy("lang", "word").agg(F.first("h").alias("h"), F.sum("n").alias("n"))
    often = F.col("n") >= least
    # all other words of a language are one row, whose word is null
    merged = counts.groupBy("lang", F.when(often, F.col("word")).alias("word")).agg(F.max(F.when(often, F.col("h"))).alias("h"), F.sum("n").alias("n"))
    merged = materialise(merged, "collocations-words")
    return merged.where("word IS NOT NULL"), merged.groupBy("lang").agg(F.sum("n").alias("total"))


def count_phrases(texts: DataFrame, words: DataFrame, least: int = LEAST, numbered: int = NUMBERED) -> DataFrame:
    """``words, n``: phrases of 2 to LONGEST words, as arrays of their hashes, with ``least`` occurrences in one language."""
    spark = texts.sparkSession
    found = words.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("h").alias("distinct")).first()
    if found.n != found.distinct:
        raise ValueError("two frequent words have one hash")
    head = words if found.n <= numbered else materialise(words.orderBy(F.desc("n"), "lang", "word").limit(numbered), "collocations-head")
    known = np.sort(head.select("h").toArrow()["h"].to_numpy().view(np.uint64))  # ``numbered`` hashes at most
    shared = spark.sparkContext.broadcast(known)
    pairs = texts.mapInArrow(_pairs(shared), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    often = spark.sparkContext.broadcast(key_bits(materialise(pairs.select("h"), "collocations-pairs")))
    keys = materialise(texts.mapInArrow(_windows(shared, often), "key binary, n long"), "collocations-keys")
    ranged = keys.repartitionByRange(shuffle_partitions(spark), "key").sortWithinPartitions("key")
    runs = ranged.mapInArrow(_prefix_runs(shared, least), "words array<long>, n long")
    if found.n > numbered:
        others = key_bits(words.join(head.select("h"), "h", "left_anti").select("h"))
        runs = runs.unionByName(texts.mapInArrow(_rest_phrases(shared, others), "words array<long>, n long"))
    return runs.groupBy("words").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _part(words: Column, start: int | Column, size: int | Column) -> Column:
    return F.slice(words, start, size)


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, numbered: int = NUMBERED) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language.

    A phrase with ``a`` occurrences is scored by its weakest cut into parts with ``l`` and ``r``
    occurrences: 1000 a n / (l r), rounded down, where ``n`` is the number of words of the language;
    of equal cuts the first counts. A phrase inside a longer one with as many occurrences goes.
    Order is by score, ``a``, both descending, and phrase. Null texts are empty, a null language is
    ``und``, repeated rows count again, and other columns are not read. An empty table gives no rows.
    """
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    words, totals = frequent_words(texts, least)
    known = materialise(join_hot(words, totals, "lang").select("h", "lang", "word", "n", F.col("total")), "collocations-known")
    phrases = materialise(count_phrases(texts, known, least, numbered), "collocations-phrases")

    # a longer phrase of as many occurrences holds one that is longer by one word, of as many
    m = F.size("words")
    inner = phrases.where(m > 2).select(F.explode(F.array(_part(F.col("words"), 1, m - 1), _part(F.col("words"), 2, m - 1))).alias("words"), F.col("n").alias("longer"))
    inner = inner.groupBy("words").agg(F.max("longer").alias("longer"))
    kept = phrases.join(inner, "words", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("n"))).select("words", F.col("n").alias("a"))

    shown = join_hot(kept.select("words", "a", F.posexplode("words").alias("at", "h")), known.select("h", "lang", "word", "total"), "h")
    shown = shown.groupBy("words").agg(F.first("a").alias("a"), F.first("lang").alias("lang"), F.first("total").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    shown = materialise(shown, "collocations-shown")

    counts = phrases.unionByName(known.select(F.array("h").alias("words"), "n")).select(F.col("words").alias("part"), F.col("n").alias("count_of_part"))
    cuts = shown.withColumn("k", F.explode(F.sequence(F.lit(1), m - 1)))
    for out, part in (("l", _part(F.col("words"), 1, F.col("k"))), ("r", _part(F.col("words"), F.col("k") + 1, m - F.col("k")))):
        cuts = materialise(join_hot(cuts.withColumn("part", part), counts, "part").withColumnRenamed("count_of_part", out).drop("part"), "collocations-cuts")
    weakest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr(SCORE).alias("score"), "k", "l", "r", "a", "n")).alias("x")).select("lang", "phrase", "x.*")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    first = weakest.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS)))
    first = first.withColumn("_nth", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_nth") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))  # _PARTS times ``top`` rows at most
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p, count(*) AS f
  FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces), (SELECT unnest(range(1, 6)) AS k)
  WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
candidates AS (SELECT lang, k AS m, p, string_split(p, ' ') AS w, f AS a FROM grams WHERE k > 1),
kept AS (
  SELECT * FROM candidates c
  WHERE NOT EXISTS (SELECT 1 FROM candidates x WHERE x.lang = c.lang AND x.m > c.m AND 100 * x.a >= 100 * c.a AND contains(' ' || x.p || ' ', ' ' || c.p || ' '))),
cuts AS (SELECT *, array_to_string(w[1:k], ' ') AS first_part, array_to_string(w[k + 1:], ' ') AS rest
         FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
scored AS (
  SELECT c.lang, c.p AS phrase, c.k, c.a, x.f AS l, y.f AS r, CAST(t.n AS BIGINT) AS n,
         CAST((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.p = c.first_part JOIN grams y ON y.lang = c.lang AND y.p = c.rest JOIN totals t ON t.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM weakest QUALIFY rank <= 2000
"""
