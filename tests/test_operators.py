import json
import os
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from seatwise.functions.columns import capacity_label, hash_key, hash_uniform, letter_ordinal, verdict
from seatwise.operators import encoding, inference, metrics, mitigation, selection, splitting
from seatwise.sources import tables
from seatwise.streaming.marginals import running_counts, running_moments


def scored(spark, n=200):
    return spark.range(n).select("id", (F.col("id") % 7).cast("double").alias("score"), F.when(F.col("id") % 3 == 0, "EUROPE").otherwise("AFRICA").alias("grp"))


def test_quota_is_exact_with_heavy_ties_and_ignores_row_order(spark):
    df = scored(spark)
    a = selection.top_quota(df, "score", 0.1).where("selected")
    b = selection.top_quota(df.repartition(7, "grp").orderBy(F.col("id").desc()), "score", 0.1).where("selected")
    assert a.count() == 20
    assert {r.id for r in a.collect()} == {r.id for r in b.collect()}


def test_ranks_are_those_of_a_window_whatever_the_ties(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 2 == 0, 1.0).otherwise((F.col("id") % 40).cast("double")).alias("score"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("g"))
    for by in ([], ["g"]):
        both = selection.rank_within(df, "score", by, "a", "n").withColumn("b", F.row_number().over(Window.partitionBy(*by).orderBy(*selection.order_by_score("score"))))
        assert both.where("a <> b").count() == 0 and both.count() == 3000
        assert both.groupBy(*by).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("m")).where("n <> m").count() == 0


def test_boundaries_are_those_of_the_selection(spark):
    for k in (0.0, 0.03, 0.5):
        df = scored(spark)
        chosen = selection.top_quota(df, "score", k)
        r = selection.tie_info(df, "score", k).first()
        seats = [x.score for x in chosen.where("selected").collect()]
        assert r.k == len(seats) == int(k * 200)
        if seats:
            low, everyone = min(seats), [x.score for x in df.collect()]
            assert (r.boundary, r.n_above, r.n_tied, r.n_drawn) == (low, sum(x > low for x in everyone), everyone.count(low), seats.count(low))
            assert selection.tie_inclusive(df, "score", k, []).where("selected").count() == r.n_inclusive == r.n_above + r.n_tied
        else:
            assert r.boundary is None and selection.tie_inclusive(df, "score", k, []).where("selected").count() == 0


def test_quantiles_are_interpolated_exactly(spark):
    x = [random.Random(1).gauss(0, 3) for _ in range(999)] + [1.0] * 300
    df = spark.createDataFrame([(v,) for v in [*x, None]], "v double")
    probs = [0.0, 0.1, 0.333, 0.5, 0.975, 1.0]
    assert selection.exact_quantiles(df, "v", probs).first()[0] == pytest.approx(list(np.quantile(x, probs)))
    assert selection.exact_quantiles(df.where("false"), "v", probs).first()[0] == [None] * 6
    filled = encoding.sentinel_fill(df, F.lit(True), F.col("v"), F.col("v").isNull(), "w")
    assert filled.where("v IS NULL").first().w == pytest.approx(float(np.median(x)))


def test_split_search_is_the_loop_with_signed_gaps(spark):
    rng = random.Random(4)
    rows = [(i, "AB"[i % 2] if i % 7 else None, round(rng.random(), 2), rng.random() < 0.3, "c") for i in range(160)]
    df = spark.createDataFrame(rows, "id long, side string, score double, bench_selected boolean, cell string")
    order = {r.id: i for i, r in enumerate(df.orderBy(*selection.order_by_score("score")).collect())}
    line = {s: sorted((r for r in rows if r[1] == s), key=lambda r: order[r[0]]) for s in "AB"}
    rate = {s: [0.0, *np.cumsum([r[3] for r in x]) / sum(r[3] for r in x)] for s, x in line.items()}
    targets = [(level, t) for level, t in enumerate((0.4, 0.2, 0.0, -0.2, -0.4))]
    for seats in (5, 30, 100):
        found = mitigation.search_split(df, ["cell"], F.lit(seats), spark.createDataFrame([("c", *t) for t in targets], "cell string, level int, target double")).collect()
        for r in found:
            options = range(max(0, seats - len(line["B"])), min(seats, len(line["A"])) + 1)
            best = min(options, key=lambda n: (round(abs(rate["A"][n] - rate["B"][seats - n] - r.target), 9), n))
            assert (r.n_a, r.n_b) == (best, seats - best)
            assert r.tau_a == (float("inf") if best == 0 else float("-inf") if best == len(line["A"]) else line["A"][best - 1][2])
    gaps = [r.tpr_a - r.tpr_b for r in sorted(found, key=lambda r: r.level)]
    assert gaps == sorted(gaps, reverse=True)


def test_bounded_search_finds_what_a_loop_does_and_opens_few_parts(spark):
    rng = random.Random(3)
    rows, loops = [], []
    for cell, (na, nb, seats, hits) in enumerate([(90, 140, 60, 0.3), (200, 30, 100, 0.05), (40, 40, 80, 0.5), (300, 300, 250, 0.02), (20, 50, 30, 0.0)]):
        sides = {"A": na, "B": nb}
        line = {s: [rng.random() < hits * (1.6 if s == "A" else 1) if s == "A" or hits else i < 5 for i in range(n)] for s, n in sides.items()}
        rate = {s: [0.0, *[sum(line[s][: i + 1]) / sum(line[s]) if sum(line[s]) else None for i in range(n)]] for s, n in sides.items()}
        rows += [(cell, s, float(-i), line[s][i], i + 1000 * (s == "B"), seats) for s in sides for i in range(sides[s])]
        for level, target in enumerate((0.3, 0.11, 0.0, -0.2, 1.5)):
            options = [n for n in range(max(0, seats - nb), min(seats, na) + 1) if rate["A"][n] is not None and rate["B"][seats - n] is not None]
            best = min(options, key=lambda n: (round(abs(round(rate["A"][n], 9) - round(rate["B"][seats - n], 9) - target), 9), n), default=None)
            if best is not None:
                loops.append((cell, level, best))
    df = spark.createDataFrame(rows, "cell long, side string, score double, bench_selected boolean, id long, seats long")
    targets = spark.createDataFrame([(c, i, t) for c in range(5) for i, t in enumerate((0.3, 0.11, 0.0, -0.2, 1.5))], "cell long, level int, target double")
    for part in (2, 7, 4096):
        assert sorted((r.cell, r.level, r.n_a) for r in mitigation.search_split(df, ["cell"], F.col("seats"), targets, part).collect()) == loops
    ranked = spark.range(1, 200_001).selectExpr("'c' AS cell", "if(id % 2 = 0, 'A', 'B') AS side", "id div 2 + id % 2 AS rk").selectExpr("*", "cast(rk % 5 = 0 AS int) AS _hit", "rk div 500 AS _part")
    caps = spark.createDataFrame([("c", 90_000)], "cell string, seats long")
    few = mitigation._near_targets(mitigation._rate_ends(ranked, ["cell", "side"]), caps, spark.createDataFrame([("c", 0, 0.25)], "cell string, level int, target double"), ["cell"], 500)
    assert 0 < few.count() <= 8


def test_ratio_is_the_first_side_over_the_second(spark):
    df = spark.createDataFrame([("EUROPE", True)] * 3 + [("EUROPE", False)] + [("AFRICA", True)] + [("AFRICA", False)] * 3, "grp string, selected boolean").withColumn("c", F.lit(1))
    assert metrics.selection_table(df, ["c"]).first().ratio == 3
    led = df.withColumn("model_selected", F.col("selected")).withColumn("bench_selected", F.lit(False))
    assert metrics.group_metrics(led, ["c"]).first().ratio == 3


def test_areas_are_those_of_the_definitions(spark):
    rng = random.Random(6)
    rows = [("c", round(rng.random(), 1), rng.random() < 0.4) for _ in range(300)]
    df = spark.createDataFrame(rows, "cell string, score double, label boolean")
    pos, neg = [r[1] for r in rows if r[2]], [r[1] for r in rows if not r[2]]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    for t in sorted({r[1] for r in rows}, reverse=True):
        hit, chosen = sum(p >= t for p in pos), sum(r[1] >= t for r in rows)
        ap, last = ap + (hit / len(pos) - last) * hit / chosen, hit / len(pos)
    assert metrics.roc_auc(df, ["cell"]).first().roc_auc == pytest.approx(auc)
    assert metrics.average_precision(df, ["cell"]).first().pr_auc == pytest.approx(ap)


def test_joins_that_must_be_whole_halt_when_they_are_not(spark):
    a, b = scored(spark, 10), spark.range(10).withColumn("x", F.lit(1))
    assert tables.joined_whole(a, b).count() == tables.aligned(a, spark.range(12).withColumn("x", F.lit(1))).count() == 10
    assert tables.joined_whole(a, b).columns == [*a.columns, "x"]
    assert sorted(tables.joined_whole(a, b).collect()) == sorted(a.join(b, "id").select(*a.columns, "x").collect())
    less, twice = spark.range(9).withColumn("x", F.lit(1)), b.unionByName(b.where("id = 3"))
    for wrong in (less, twice, b.unionByName(b.where("id = 3").withColumn("id", F.lit(99).cast("long")))):
        with pytest.raises(PySparkException, match="not on both sides once"):
            tables.joined_whole(a, wrong).count()
    for wrong in (less, twice):
        with pytest.raises(PySparkException, match="missing or repeated"):
            tables.aligned(a, wrong).count()
    plan = tables.joined_whole(a, b)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    with pytest.raises(ValueError):
        metrics.greatest_difference(a, a.limit(9), ["id"])
    assert metrics.greatest_difference(a, a.withColumn("score", F.col("score") + 0.25), ["id"]) == 0.25
    led = a.select(F.lit("c").alias("c"), (F.col("id") < 4).alias("model_selected"))
    assert mitigation.require_capacity(led, ["c"], F.lit(4)) is led
    with pytest.raises(ValueError):
        mitigation.require_capacity(led, ["c"], F.lit(5))


def test_results_are_appended_stored_and_read_again(spark, tmp_path):
    path = str(tmp_path / "results")
    for block, c in (("B1", 0.1), ("B2", 10.0)):
        tables.append_csv(spark.createDataFrame([(block, "logistic", json.dumps({"C": c}))], "block string, model string, best_params string"), path)
    assert tables.read_parameters(spark, path) == {("B1", "logistic"): {"C": 0.1}, ("B2", "logistic"): {"C": 10.0}}
    assert tables.exists(spark, path) and not tables.exists(spark, path + "x")
    built = []
    for _ in range(2):
        out = tables.stored(spark, str(tmp_path), "t", lambda: built.append(1) or spark.range(3))
    assert out.count() == 3 and built == [1]
    tables.write_csv(scored(spark, 5), str(tmp_path / "one"), single=True)
    assert len(list((tmp_path / "one").glob("*.csv"))) == 1
    led = tables.ledger(scored(spark, 4).select("id", F.lit(True).alias("model_selected"), F.lit(False).alias("bench_selected"), F.lit("A").alias("side")), "t", "v", "B3", "m", 0.1)
    both = led.unionByName(led.withColumn("variant", F.lit("w")))
    tables.upsert_partitions(both, str(tmp_path / "led"))
    tables.upsert_partitions(led.limit(1), str(tmp_path / "led"))
    assert {r.variant: r["count"] for r in spark.read.parquet(str(tmp_path / "led")).groupBy("variant").count().collect()} == {"v": 1, "w": 4}
    tables.logger(str(tmp_path / "log.txt")).info("a line")
    assert "a line" in (tmp_path / "log.txt").read_text()
    assert [r[0] for r in spark.createDataFrame([(0.05,), (0.1,), (0.2,)], "k double").select(capacity_label(F.col("k"))).collect()] == ["K05", "K10", "K20"]


def test_increments_hold_their_point(spark):
    df = scored(spark, 400).select("id", F.when(F.col("grp") == "EUROPE", "A").otherwise("B").alias("side"), (F.col("score") > 4).alias("x"), (F.col("id") % 4 == 0).alias("y"), F.lit("c").alias("cell"))
    r = inference.bootstrap_increment(df, ["cell"], "x", "y", 300).first()
    rate = {(k, c): v for c in "xy" for k, v in ((r.side, r.v) for r in df.groupBy("side").agg(F.avg(F.col(c).cast("double")).alias("v")).collect())}
    assert r.increment_point == pytest.approx(100 * (rate["A", "y"] - rate["B", "y"] - rate["A", "x"] + rate["B", "x"]))
    assert r.increment_lo <= r.increment_point <= r.increment_hi


def test_zero_sum_holds_for_equal_quotas(spark):
    df = selection.top_quota(selection.top_quota(scored(spark), "score", 0.1, "bench_selected").withColumn("u", hash_uniform("t", F.col("id").cast("string"))), "u", 0.1, "model_selected").withColumn("c", F.lit(1))
    assert metrics.zero_sum(df, ["c"]).first().balanced


def test_split_sizes_and_extension_keep_labels(spark):
    df = scored(spark, 101)
    split = splitting.stratified_split(df, F.col("grp"))
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sizes == {"train": 60, "val": 20, "test": 21} or sizes == {"train": 60, "val": 21, "test": 20}
    wide = splitting.extend_split(scored(spark, 150), split, F.col("grp"))
    assert wide.count() == 150
    assert wide.join(split.select("id", F.col("split").alias("s")), "id").where("s <> split").count() == 0


def test_draws_end_at_a_row_and_order_no_whole_group(spark):
    rows = [(i, None if i % 7 == 0 else "ab"[i % 2] * (i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string")
    wanted = {g: n for g, n in zip(sorted({g for _, g in rows}, key=repr), (0, 1, 5, 10**6, 20), strict=False)}
    size = Counter(g for _, g in rows)
    table = spark.createDataFrame([(g, min(n, size[g])) for g, n in wanted.items()], "k string, _take long")
    last = splitting.last_drawn(df, ["g"], lambda m: m.join(table, F.col("g").eqNullSafe(F.col("k"))), "t")
    got = {r.id for r in splitting.drawn(df, ["g"], last, "t", "x").where("x").collect()}
    line = {r.id: r.h for r in df.select("id", hash_key("t", "id").alias("h")).collect()}
    want = {i for g in wanted for i in sorted((i for i, s in rows if s == g), key=lambda i: (line[i], i))[: wanted[g]]}
    assert got == want
    assert splitting.sample_fraction(df.where("false"), 0.4, ["g"]).count() == 0
    assert splitting.sample_fraction(df, 0.4, []).count() == 120
    plan = splitting.drawn(df, ["g"], last, "t", "x")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan


def test_bins_put_nulls_first_and_take_empty_tables(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.0,), (3.0,)], "v double")
    assert sorted((r.v or 0, r.b) for r in splitting.quantile_bins(df, "v", 2, "b").collect()) == [(0, 0), (1.0, 0), (2.0, 0), (3.0, 1)]
    assert [r.b for r in splitting.quantile_bins(df.where("v IS NULL"), "v", 2, "b").collect()] == [0]


def test_weights_average_to_one(spark):
    df = scored(spark).withColumn("label", F.col("score") > 4)
    assert mitigation.reweighing(df).agg(F.avg("weight")).first()[0] == pytest.approx(1)


def test_verdict_needs_both_ends_in_one_region(spark):
    df = spark.createDataFrame([(2.0, 1.5, 3.0), (2.0, 0.5, 3.0), (0.1, -0.5, 0.5), (-3.0, -4.0, -2.0)], "d double, lo double, hi double")
    assert [r[0] for r in df.select(verdict(F.col("d"), F.col("lo"), F.col("hi"))).collect()] == ["amplification", "inconclusive", "practical_reproduction", "attenuation"]


def test_bootstrap_interval_holds_its_point(spark):
    df = scored(spark).select("id", F.when(F.col("grp") == "EUROPE", "A").otherwise("B").alias("side"), (F.col("score") > 4).alias("model_selected"), (F.col("id") % 5 == 0).alias("bench_selected"), F.lit("c").alias("cell"))
    r = inference.bootstrap(df, ["cell"], 300).first()
    assert r.d_lo <= r.d_point <= r.d_hi


def test_upsert_replaces_whole_cells(spark):
    df = scored(spark, 10).select("id", (F.col("id") > 5).alias("model_selected"), (F.col("id") > 6).alias("bench_selected"), F.lit("A").alias("side"))
    old = tables.ledger(df, "t", "v", "B3", "m", 0.1).unionByName(tables.ledger(df, "t", "v", "B4", "m", 0.1))
    new = tables.ledger(df.limit(3), "t", "v", "B4", "m", 0.1)
    assert {r.block: r["count"] for r in tables.upsert(old, new).groupBy("block").count().collect()} == {"B3": 10, "B4": 3}


def test_letters_and_sniffing(spark, tmp_path):
    df = spark.createDataFrame([("A",), ("Z",), ("a",), (None,)], "c string")
    assert [r[0] for r in df.select(letter_ordinal(F.col("c"))).collect()] == [1, 26, None, None]
    (tmp_path / "x.csv").write_text("a;b\n1;é\n", encoding="latin-1")
    assert tables.sniff(spark, str(tmp_path / "x.csv")) == (";", "ISO-8859-1")
    (tmp_path / "y.csv").write_text("a,b\n1,é\n", encoding="utf-8")
    assert tables.sniff(spark, str(tmp_path / "y.csv")) == (",", "UTF-8")
    assert tables.read_csv(spark, str(tmp_path / "x.csv"), "a int, b string", ["b"]).first().b == "é"


def test_running_counts_over_a_stream(spark, tmp_path):
    scored(spark, 20).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, score double, grp string").parquet(str(tmp_path / "in"))
    q = running_counts(stream, "grp").writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {r.grp: r.n for r in spark.table("counts").collect()} == {"EUROPE": 7, "AFRICA": 13}


def test_moments_of_a_stream_are_those_of_the_table(spark, tmp_path):
    df = scored(spark, 50)
    df.write.parquet(str(tmp_path / "in"))
    q = running_moments(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "score", "grp").writeStream.outputMode("complete").format("memory").queryName("moments").start()
    q.processAllAvailable()
    q.stop()
    want = {r.grp: (r.n, r.m, r.s) for r in df.groupBy("grp").agg(F.count("score").alias("n"), F.avg("score").alias("m"), F.stddev_samp("score").alias("s")).collect()}
    assert {r.grp: (r.n, r["mean"], r.sd) for r in spark.table("moments").collect()} == {k: (v[0], pytest.approx(v[1]), pytest.approx(v[2])) for k, v in want.items()}


def test_functions_load_where_the_package_is_missing():
    blob = cloudpickle.dumps(hash_uniform)
    code = "import pickle, sys; f = pickle.load(sys.stdin.buffer); assert callable(f) and 'seatwise' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], input=blob, check=True, cwd="/", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
