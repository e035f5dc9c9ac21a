import numpy as np
import pytest
from pyspark.sql import functions as F

from seatwise.operators import boosting, logistic, models
from seatwise.operators.boosting import Config

NAMED, NUMBERS = ["kind", "place"], ["size", "age"]


def table(n=240, seed=1):
    rng = np.random.default_rng(seed)
    kind, place, size, age = rng.choice(list("abc"), n), rng.choice(["x", "y"], n), rng.integers(0, 12, n), np.round(rng.normal(0, 1, n), 1)
    y = (rng.random(n) < 1 / (1 + np.exp(-((kind == "a") + 0.3 * size - 2 + age * (place == "x"))))).astype(int)
    return [(i, str(k), str(p) if i % 50 else None, float(s), float(a), int(v), float(1 + i % 3), int(i % 10 == 0)) for i, (k, p, s, a, v) in enumerate(zip(kind, place, size, age, y))]


SCHEMA = "id long, kind string, place string, size double, age double, y int, w double, held int"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(table(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def bins(rows):
    return boosting.fit_bins(rows, NAMED, NUMBERS)


def naive(data, columns, config, weighted, leaves, patience):
    """Boosting by loops over all splits of all leaves; the scores of all rows after each tree, until the rows held back gain nothing."""
    names = {"kind": 1, "place": 2, "size": 3, "age": 4}
    grow, held = [i for i, r in enumerate(data) if not r[7]], [i for i, r in enumerate(data) if r[7]]
    w = {i: data[i][6] if weighted else 1.0 for i in range(len(data))}
    ones = sum(w[i] * data[i][5] for i in grow)
    base = np.log(ones / (sum(w[i] for i in grow) - ones))
    f, losses, out = np.full(len(data), base), [], []

    def tests():
        for c in columns:
            values = sorted({data[i][names[c]] for i in range(len(data)) if data[i][names[c]] is not None})
            for v in values if c in NAMED else values[:-1]:
                yield (lambda r, c=c, v=v: r[names[c]] == v) if c in NAMED else (lambda r, c=c, v=v: r[names[c]] > v)

    every = list(tests())
    while True:
        losses.append(np.mean([np.logaddexp(0, -f[i] if data[i][5] else f[i]) for i in held]))
        if len(out) == config.trees or len(losses) > patience and min(losses[-patience:]) >= losses[-patience - 1] - 1e-7:
            return out
        p = 1 / (1 + np.exp(-f))
        g, h = [w[i] * (p[i] - data[i][5]) for i in range(len(data))], [w[i] * p[i] * (1 - p[i]) for i in range(len(data))]

        def score(part):
            return sum(g[i] for i in part) ** 2 / sum(h[i] for i in part)

        def best(leaf):
            found = (0.0, None)
            if config.depth is None or leaf[1] < config.depth:
                for k, t in enumerate(every):
                    right = [i for i in leaf[0] if t(data[i])]
                    left = [i for i in leaf[0] if not t(data[i])]
                    if min(len(left), len(right)) >= config.leaf and min(sum(h[i] for i in left), sum(h[i] for i in right)) >= 1e-3:
                        gain = score(left) + score(right) - score(leaf[0])
                        if gain > found[0] + 1e-9:
                            found = (gain, k)
            return found

        tree = [(grow, 0, list(range(len(data))))]
        splits = [best(tree[0])]
        while len(tree) < leaves and max(x[0] for x in splits) > 0:
            k = max(range(len(tree)), key=lambda i: splits[i][0])
            own, depth, everyone = tree.pop(k)
            t = every[splits.pop(k)[1]]
            for side in (False, True):
                tree.append(([i for i in own if t(data[i]) == side], depth + 1, [i for i in everyone if t(data[i]) == side]))
                splits.append(best(tree[-1]))
        for own, _, everyone in tree:
            f[everyone] += -config.rate * sum(g[i] for i in own) / sum(h[i] for i in own)
        out.append(1 / (1 + np.exp(-f)))


CONFIGS = [Config(("kind", "place", "size", "age"), None, 0.3, 40, 5), Config(("kind", "size"), 2, 0.1, 6, 20), Config(("age", "size", "place"), 3, 0.5, 12, 50), Config(("place",), None, 0.5, 3, 300)]


def scores(df, bins, points):
    return {r.id: list(r.scores) for r in boosting.score_many(df, bins, points, ["id"]).collect()}


@pytest.mark.parametrize("weighted", [False, True])
def test_models_are_those_of_loops_and_stop_when_these_do(rows, bins, monkeypatch, weighted):
    monkeypatch.setattr(boosting, "LEAVES", 6)
    models = boosting.fit_many(rows, bins, CONFIGS, weight="w" if weighted else None, held=F.col("held") == 1)
    data = table()
    for m in models:
        want = naive(data, m.config.columns, m.config, weighted, 6, boosting.PATIENCE)
        assert len(m.trees) == len(want)
        lengths = sorted({1, len(want) // 2 or 1, len(want)})
        ours = scores(rows, bins, [(m, k) for k in lengths])
        for j, k in enumerate(lengths):
            assert np.allclose([ours[i][j] for i in range(len(data))], want[k - 1], atol=2e-4)
    assert len(models[0].trees) < 40  # rows held back ended it


def test_fits_side_by_side_are_those_one_by_one_whatever_the_layout(rows, bins, monkeypatch):
    few = [Config(CONFIGS[0].columns, None, 0.3, 3, 5), Config(("kind", "size"), 2, 0.1, 4, 20), Config(("age", "place"), 3, 0.5, 2, 30)]
    together = boosting.fit_many(rows, bins, few, held=F.col("held") == 1)
    alone = [boosting.fit_many(rows, bins, [c], held=F.col("held") == 1)[0] for c in few]
    monkeypatch.setattr(boosting, "BLOCK", 64)  # so that passes are jobs over several blocks
    monkeypatch.setattr(boosting, "SAVED", 2)
    spread = boosting.fit_many(rows.repartition(5), bins, few, held=F.col("held") == 1, groups=2)
    for a, b, c in zip(together, alone, spread, strict=True):
        assert a.losses == b.losses == c.losses and len(a.trees) == len(b.trees) == len(c.trees) > 0
    points = [[(m, 600) for m in x] for x in (together, alone, spread)]
    assert scores(rows, bins, points[0]) == scores(rows, bins, points[1]) == scores(rows, bins, points[2])


def test_first_trees_are_the_fit_with_fewer(rows, bins):
    long, short = CONFIGS[0], Config(*[*CONFIGS[0].__dict__.values()][:3], 4, CONFIGS[0].leaf)
    a, b = (boosting.fit_many(rows, bins, [c], held=F.col("held") == 1)[0] for c in (long, short))
    assert len(b.trees) == 4 < len(a.trees) and scores(rows, bins, [(a, 4)]) == scores(rows, bins, [(b, 600)])


def test_one_class_and_rows_without_a_level(spark, rows, bins):
    flat = boosting.fit_many(rows.withColumn("y", F.lit(1)), bins, CONFIGS[:1])
    assert flat[0].trees == [] and flat[0].base > 10
    models = boosting.fit_many(rows, bins, CONFIGS[:1])
    assert len(models[0].trees) == 40  # nothing held back, no early end
    new = spark.createDataFrame([(1, "unseen", None, None, None, 0, 1.0, 0)], SCHEMA)
    assert 0 < scores(new, bins, [(models[0], 40)])[1][0] < 1
    with pytest.raises(ValueError, match="levels"):
        boosting.fit_bins(spark.range(boosting.LEVELS + 1), ["id"], [])


def test_regressions_are_at_their_minimum(rows, bins):
    features = logistic.fit_features(rows, bins)
    fits = [logistic.Penalised(c, k) for c in (("kind", "size"), ("kind", "place", "size", "age")) for k in (0.001, 1.0, 100.0)]
    for weight in (None, "w"):
        found = logistic.fit_path(rows, features, fits, weight=weight)
        data = table()
        x = np.array([[r[1] == "a", r[1] == "b", r[1] == "c", r[2] == "x", r[2] == "y", r[3], r[4]] for r in data], float)
        assert np.allclose(features.deviation, x.std(axis=0))
        y, w = np.array([r[5] for r in data]), np.array([r[6] if weight else 1.0 for r in data])
        for fit, f in zip(fits, found, strict=True):
            own = features.of(fit.columns)
            assert f.gradient <= 1e-6 and not f.coefficients[np.setdiff1d(np.arange(7), own)].any()

            def objective(beta, intercept):
                margin = x @ beta + intercept
                return fit.c * (w * np.logaddexp(0, np.where(y > 0, -margin, margin))).sum() + 0.5 * ((beta * features.deviation) ** 2).sum()

            least = objective(f.coefficients, f.intercept)
            for k in own:  # no step along a feature or the intercept is better
                for d in (1e-4, -1e-4):
                    other = f.coefficients.copy()
                    other[k] += d
                    assert objective(other, f.intercept) >= least - 1e-9
            assert min(objective(f.coefficients, f.intercept + d) for d in (1e-4, -1e-4)) >= least - 1e-9
    shown = {r.id: r.scores for r in logistic.score_path(rows, features, found, ["id"]).collect()}
    assert np.allclose([shown[i][0] for i in range(len(data))], 1 / (1 + np.exp(-(x @ found[0].coefficients + found[0].intercept))), atol=1e-8)


def test_a_regression_that_has_not_converged_is_an_error(rows, bins, monkeypatch):
    monkeypatch.setattr(logistic, "STEPS", 1)
    with pytest.raises(ArithmeticError, match="not converged"):
        logistic.fit_path(rows, logistic.fit_features(rows, bins), [logistic.Penalised(("kind",), 100.0)])


def test_regression_of_one_class(rows, bins):
    fit = logistic.fit_path(rows.withColumn("y", F.lit(0)), logistic.fit_features(rows, bins), [logistic.Penalised(("kind",), 1.0)])[0]
    assert fit.intercept < -10 and not fit.coefficients.any()


def test_counted_rows_passes_in_one_task_and_over_blocks_give_the_same_models(spark, rows, bins, monkeypatch):
    few = [Config(CONFIGS[0].columns, None, 0.3, 5, 5), Config(("kind", "size"), 2, 0.1, 4, 20), Config(("age", "place"), 3, 0.5, 2, 30)]
    often = rows.unionByName(rows).unionByName(rows)
    cells = boosting.cells_of(often, bins, "y", "w", F.col("held") == 1).cache()
    assert cells.count() < often.count() / 3 + 1 and cells.agg(F.sum(F.expr("n0 + n1 + h0 + h1"))).first()[0] == often.count()
    alone = boosting.fit_many(often, bins, few, weight="w", held=F.col("held") == 1)
    monkeypatch.setattr(boosting, "CELLS", 0)
    monkeypatch.setattr(boosting, "BLOCK", 64)
    spread = boosting.fit_many(often, bins, few, weight="w", held=F.col("held") == 1, groups=2)
    monkeypatch.setattr(boosting, "CELLS", 60)  # some sets of columns have more
    mixed = boosting.fit_many(often, bins, few, weight="w", held=F.col("held") == 1)
    points = [[(m, 600) for m in x] for x in (alone, spread, mixed)]
    assert [m.losses for m in alone] == [m.losses for m in spread] == [m.losses for m in mixed]
    assert scores(rows, bins, points[0]) == scores(rows, bins, points[1]) == scores(rows, bins, points[2])


def test_bits_of_leaves_are_those_that_rows_reach():
    rng, growth = np.random.default_rng(5), boosting._Growth(Config(("a", "b"), None, 1.0, 1, 1))
    growth.depth, growth.stats = [0], [(0.0, 1.0, 100.0)]
    open_nodes = [0]
    while len(open_nodes) < boosting.LEAVES:
        node = open_nodes.pop(rng.integers(len(open_nodes)))
        lo = int(rng.integers(0, 9))
        growth.split[node] = [1.0, float(rng.integers(0, 2)), lo, int(rng.integers(lo, 10))]
        growth.children[node] = [len(growth.depth), len(growth.depth) + 1]
        open_nodes += growth.children[node]
        growth.depth += [growth.depth[node] + 1] * 2
        growth.stats += [(-float(rng.integers(1, 1000)), 1.0, 1.0) for _ in range(2)]
    tree = growth.tree(grown=True)
    codes = np.array([(a, b) for a in range(10) for b in range(10)], np.int32)
    forest = boosting._join([[tree]])
    want = forest.value[boosting._walk(forest, codes, 0)][:, 0]
    found, values = boosting._tables(tree, [10, 10], boosting.joints([10, 10]))
    bits = np.bitwise_and.reduce([table[codes @ [10, 1]] for _, table in found])
    assert (values[((bits & (~bits + np.uint32(1))) * boosting._BRUIJN) >> np.uint32(27)] == want).all() and len(set(want)) > 5


def test_overlaps_from_cells_are_those_of_rows(spark):
    rng = np.random.default_rng(3)
    data = [(i, int(c), bool(rng.random() < 0.1 + 0.05 * c)) for i, c in enumerate(rng.integers(0, 9, 400))]
    rows = spark.createDataFrame(data, "id long, cell long, label boolean").cache()
    score = spark.createDataFrame([(p, c, float(np.round(c * (p + 1) % 5 / 7, 9))) for p in range(4) for c in range(9)] + [(4, c, 0.5) for c in range(9)], "point int, cell long, score double").cache()
    cells = rows.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("label").alias("ones"))
    for k in (0.1, 0.37):
        want = {r.point: r.overlap_at_k for r in models.overlaps(rows.join(score, "cell"), ["point"], k).collect()}
        got = {r.point: r.overlap_at_k for r in models.cell_overlaps(score.join(cells, "cell"), rows, k).collect()}
        assert got == want and len(want) == 5 and len(set(want.values())) > 2


def test_last_seats_are_sought_by_ranges_and_few_scores_are_ordered(spark, monkeypatch):
    rng = np.random.default_rng(5)
    cells, points = 300, 7
    scores = np.round(rng.random((cells, points)) ** 3, 9)
    scores[:, 1], scores[:, 2], scores[:, 3] = np.round(scores[:, 1], 1), 0.25 + np.round(scores[:, 2] / 1000, 5), 0.0  # ties, one range, one score
    scores[rng.random(cells) < 0.2, 4] = 1.0
    data = [(i, int(c), bool(rng.random() < 0.2)) for i, c in enumerate(rng.integers(0, cells, 2000))]
    rows = spark.createDataFrame(data, "id long, cell long, label boolean").cache()
    counted = rows.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("label").alias("ones"))
    long = spark.createDataFrame([(c, p, float(scores[c, p])) for c in range(cells) for p in range(points)], "cell long, point int, score double").cache()
    wide = [spark.createDataFrame([(c, [float(x) for x in scores[c, a:b]]) for c in range(cells)], "cell long, scores array<double>").join(counted, "cell").withColumn("first", F.lit(a)) for a, b in ((0, 3), (3, points))]
    ordered, with_better = [], models.with_better
    monkeypatch.setattr(models, "with_better", lambda counts, by: ordered.append(counts.groupBy("point").count().agg(F.sum("count")).first()[0]) or with_better(counts, by))
    for k in (0.0, 0.0003, 0.1, 0.5, 1.0):
        want = {r.point: r.overlap_at_k for r in models.overlaps(rows.join(long, "cell"), ["point"], k).collect()}
        got = {r.point: r.overlap_at_k for r in models.grid_overlaps(wide[0].unionByName(wide[1]), rows, k).collect()}
        # without a seat the rate of the benchmark's rows is 0
        assert got == want and len(want) == points
    assert max(x or 0 for x in ordered) < 0.4 * cells * points  # a point within one range keeps all its scores


def test_sums_of_joined_numbers_are_those_of_each():
    rng = np.random.default_rng(5)
    sizes, n = [7, 40, 2], 3000
    codes = np.stack([rng.integers(0, k, n) for k in sizes], axis=1)
    record = {"n": n, "codes": codes.astype("<u2").tobytes(), "w": np.ones(n).tobytes()} | {c: np.ones(n).tobytes() for c in boosting.COUNTS}
    table = boosting._Table(record, sizes)
    first, second, rows = rng.integers(-(2**20), 2**20, n).astype(float), rng.integers(0, 2**18, n).astype(float), rng.integers(0, 90, n).astype(float)
    both, unit = boosting.joined(second, rows)
    for parts in ([np.arange(n)], [np.arange(0, n, 2)], [np.arange(5), np.arange(9, 12), np.array([], int)], [np.arange(1500), np.arange(1500, n)]):
        found = boosting.parted(table.sums((first, both), parts), unit)
        for many in (0, n):  # by joint codes, and by single ones
            table.many = many
            for part, own, same in zip(parts, table.sums((first, second, rows), parts), found, strict=True):
                brute = [np.concatenate([np.bincount(codes[part, c], x[part], k) for c, k in enumerate(sizes)]) for x in (first, second, rows)]
                assert np.array_equal(own, brute) and np.array_equal(same, brute)
    assert boosting.joined(second * 2.0**20, rows) is None  # not exact in a double
    assert boosting.joined(-second, rows) is None
