import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seatwise.llm import spelling

DOCS = "doc_id long, text string"


def brute_words(rows):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def brute_variants(words):
    form, near = {}, {}
    for w, n in words.items():
        found = [v for v in words if abs(len(v) - len(w)) <= 1 and distance(v, w) == 1]
        best = min(found, key=lambda v: (-words[v], v), default=None)
        near[w], form[w] = len(found), best if best and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, near[w], form[w] and words[form[w]]))
    return sorted(out)


def edited(rng, w):
    i = rng.randrange(len(w))
    return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1 :]])


def vocabulary(rng, n):
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(4, 9))): rng.randint(3, 9) for _ in range(n)}
    for w in list(words)[: n // 2]:
        for _ in range(3):
            w = edited(rng, w)
            words[w] = words.get(w, 0) + rng.choice([3, 6, 12, 25, 50])
    return {w: c for w, c in words.items() if len(w) >= 5}


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("shared, shard", [(1024, 8192), (6, 40)])
def test_variants_are_the_brute_force_ones(spark, monkeypatch, shared, shard):
    """Also with most halves split, and with few halves a shard."""
    monkeypatch.setattr(spelling, "SHARED", shared)
    monkeypatch.setattr(spelling, "SHARD", shard)
    words = vocabulary(random.Random(shared), 150)
    words |= {"x" * k: 2**k for k in range(5, 12)} | {"ab" * 4: 7, "ba" * 4: 7, "ababa": 5, "babab": 5}
    out = found(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)))
    assert out == brute_variants(words)
    assert any(r[1] and r[2] != r[1] for r in out)


def test_words_are_counted_as_by_brute_force(spark):
    rng = random.Random(2)
    base = [("".join(rng.choice("abcdeÀÉéß×") for _ in range(rng.randint(3, 9)))).capitalize() for _ in range(60)]
    rows = [(i, " ".join(rng.choice(base) for _ in range(200)) + "Ünder_Score İx naïve-naïve") for i in range(40)]
    rows += [(40, None), (41, ""), (None, "nullid " * 4), rows[3], (43, "longword " * 30_000), (44, "LONGWORD " * 5)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("word", "n", "run", "id")})
    assert {r.word: r.n for r in spelling.count_words(df).collect()} == brute_words(rows)


def test_whole_operator_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = brute_words([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert found(spelling.query(spark, "/root/testdata/sf0.001")) == brute_variants(words)


def test_no_words_and_words_alone(spark):
    none = spark.createDataFrame([], DOCS)
    assert spelling.variants(spelling.count_words(none)).count() == 0
    one = spelling.variants(spark.createDataFrame([("alone", 9)], "word string, n long")).collect()
    assert [(r.root, r.form, r.n_near) for r in one] == [("alone", None, 0)]


def test_one_edit_is_distance_one():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 5))) for _ in range(2))
        assert spelling.one_edit(a, b) == (distance(a, b) == 1)
        if distance(a, b) <= 1:
            assert spelling.without_one(a) & spelling.without_one(b)
