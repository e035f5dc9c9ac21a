import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from seatwise.llm import collocations

DOCS = "doc_id long, text string, lang string"


def brute(rows, least, top):
    f, total = Counter(), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    often = {p: n for p, n in f.items() if n >= least and len(p) > 2}
    inside = set()
    for p, n in often.items():
        for i in range(1, len(p)):
            for j in range(i + 2, len(p) + 1):
                q = (p[0], *p[i:j])
                if q != p and q in often and n >= often[q]:
                    inside.add(q)
    out = defaultdict(list)
    for p, a in often.items():
        if p not in inside:
            lang, n = p[0], total[p[0]]
            score, k = min((1000 * a * n // (f[p[: 1 + k]] * f[lang, *p[1 + k :]]), k) for k in range(1, len(p) - 1))
            out[lang].append((-score, -a, " ".join(p[1:]).encode(), f[p[: 1 + k]], f[lang, *p[1 + k :]], n))
    return sorted((lang, i + 1, x[2].decode(), -x[1], *x[3:], -x[0]) for lang, found in out.items() for i, x in enumerate(sorted(found)[:top]))


def corpus():
    rng = random.Random(4)
    bag = ["the", "of", "Über", "new", "YORK", "city", "é", "ÀB", "x", "house-of", "日本", "🙂"]
    rows = [(i, "".join(rng.choice(bag) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\xa0"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "de", None, "und"])) for i in range(60)]
    rows += [(60, None, "en"), (61, "", None), (62, "new york city " * 3000, "en"), (63, "a b c d e f g " * 9, "fr"), rows[3], rows[3], (None, "the the the the the the", "en")]
    return rows


@pytest.mark.parametrize("least, top, numbered", [(3, 2000, 1 << 20), (5, 7, 1 << 20), (3, 2000, 6), (4, 2000, 0)])
def test_phrases_are_the_brute_force_ones(spark, least, top, numbered):
    """Also when few or no words have numbers, so that the rest is counted by hashes."""
    df = spark.createDataFrame(corpus(), DOCS).withColumns({c: F.lit(1) for c in ("words", "h", "n", "key", "part", "total", "rank")}).repartition(3)
    out = collocations.mine(df, least=least, top=top, numbered=numbered)
    rows = sorted(tuple(r) for r in out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert rows == brute(corpus(), least, top) and len(rows) > 7


def test_runs_across_batches_and_tasks_are_one(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    monkeypatch.setattr(collocations, "SLICE", 50)
    try:
        rows = corpus()
        out = collocations.mine(spark.createDataFrame(rows, DOCS).repartition(5), least=3)
        assert sorted(tuple(r) for r in out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == brute(rows, 3, 2000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_radix_order_is_that_of_the_bytes():
    keys = np.random.default_rng(1).integers(0, 3, (500, 15)).astype(np.uint8)
    assert [bytes(k) for k in keys[collocations.radix_order(keys)]] == sorted(bytes(k) for k in keys)


def test_no_documents_and_no_frequent_words(spark):
    none = spark.createDataFrame([], DOCS)
    assert collocations.mine(none).count() == 0
    assert collocations.mine(spark.createDataFrame([(1, "one two three", "en")], DOCS)).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    a, n, l, r = 10**12 + 1, 10**13 + 3, 10**12 + 7, 10**12 + 9
    row = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long").select(F.expr(collocations.SCORE).alias("s")).first()
    assert row.s == 1000 * a * n // (l * r)
