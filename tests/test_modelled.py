import json
import threading
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from seatwise.config import BLOCKS
from seatwise.operators import models
from seatwise.plans import modelled
from seatwise.sources import tables

FOLDER = "/root/testdata/sf0.01"
GRID = tuple({"depth": d, "rate": 0.3, "trees": n, "leaf": 20} for d in (2, None) for n in (3, 6))


@pytest.fixture(autouse=True)
def small_grids(monkeypatch):
    monkeypatch.setattr(models, "C_GRID", (0.1, 1.0))
    monkeypatch.setattr(models, "GBT_GRID", GRID)


def test_the_whole_grid_has_its_points(monkeypatch):
    monkeypatch.undo()
    assert len({tuple(p.items()) for p in models.GBT_GRID}) == 108 and {p["depth"] for p in models.GBT_GRID} == {3, 5, 8, None}


def test_settings_tables_and_their_changes_have_keys_of_their_own(spark, tmp_path, monkeypatch):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    first = modelled._settings(spark)
    spark.conf.set("seatwise.grid", "small")
    small = modelled._settings(spark)
    spark.conf.unset("seatwise.grid")
    assert small != first == modelled._settings(spark)
    homes = {tables.study_home(spark, str(tmp_path), s) for s in (first, small)}
    spark.range(4).write.mode("append").parquet(str(tmp_path / "t"))
    homes |= {tables.study_home(spark, str(tmp_path), s) for s in (first, small)}
    assert len(homes) == 4


def test_of_several_builders_the_first_ones_rows_are_everyones(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "t"))

    def build(i):
        return sorted(r.id for r in tables.stored(spark, str(tmp_path), "x", lambda: spark.range(i, i + 2)).collect())

    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(build, (0, 10, 20, 30)))
    assert len({tuple(x) for x in found}) == 1 and build(40) == found[0]
    with pytest.raises(RuntimeError):
        tables.stored(spark, str(tmp_path), "y", lambda: (_ for _ in ()).throw(RuntimeError("builder")))
    assert tables.stored(spark, str(tmp_path), "y", lambda: spark.range(2)).count() == 2


def test_main_grid_tunes_its_cells_and_a_failed_commit_leaves_nothing(spark, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(modelled, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            modelled.main_grid(spark, FOLDER)  # parameters and scores are written, but not seen
    rows = modelled.main_grid(spark, FOLDER).collect()
    assert sorted((r.block, r.model) for r in rows) == sorted((b, m) for b in BLOCKS for m in modelled.MODELS)
    scores, params = modelled.main_scores(spark, FOLDER)
    n_test = modelled.study_rows(spark, FOLDER).where("split = 'test'").count()
    for r in rows:
        assert json.loads(r.best_params) == params[r.block, r.model] and (params[r.block, r.model] in GRID or params[r.block, r.model]["C"] in models.C_GRID)
        assert r.n_selected == int(0.1 * n_test)
        assert abs(r.zero_sum_value) < 0.5 and 0 <= r.overlap_at_k <= 1 and 0 <= r.roc_auc <= 1 and r.n_features > 0
        assert r.gap_pp == pytest.approx(100 * (r.q_a - r.q_b)) and (r.ratio is None or r.ratio == pytest.approx(r.rate_a_pct / r.rate_b_pct))
    study = modelled.study_rows(spark, FOLDER)
    val = scores.where("split = 'val'").drop("split").join(study.select("id", "label"), "id")
    overlap = {(r.block, r.model): r.overlap_at_k for r in models.overlaps(val, ["block", "model"], modelled.K).collect()}
    assert all(overlap[r.block, r.model] == pytest.approx(r.val_overlap_at_k) for r in rows)
    assert modelled.main_bootstrap(spark, FOLDER).where("d_lo <= d_point AND d_point <= d_hi").count() == 12


def test_winners_are_those_of_points_fitted_one_by_one(spark):
    rows, specs = modelled.encoded(modelled.study_rows(spark, FOLDER)), [BLOCKS["B4"]]
    tuned = models.tune(rows, specs, GRID, models.C_GRID)
    for s in specs:
        for kind, points in (("logistic", [{"C": c} for c in models.C_GRID]), ("boosting", GRID)):
            found = []
            for p in points:
                own = models.fit_cells(rows, [s], {(s.name, kind): p, (s.name, "logistic" if kind == "boosting" else "boosting"): GRID[0] if kind == "logistic" else {"C": 1.0}})
                found.append(models.overlaps(own.where((F.col("split") == "val") & (F.col("model") == kind)), ["model"], modelled.K).first().overlap_at_k)
            assert tuned.overlap[s.name, kind] == pytest.approx(max(found)) and tuned.params[s.name, kind] == points[found.index(max(found))]


def _quota(led, by):
    """Cells of a ledger that select another number of rows than they have seats."""
    return led.groupBy(*by).agg((F.count_if("model_selected") - F.max("seats")).alias("off")).where("off <> 0").count()


@pytest.mark.parametrize(
    "name, ledger, n",
    [("capacity", "capacity_ledger", 48), ("composite_schemes", "composite_ledger", 20), ("state_only", "state_only_ledger", 10), ("group_extension", "groups_ledger", 20), ("population", "population_ledger", 4), ("absence", "absence_ledger", 4), ("reweighed_fit", "reweighed_ledger", 4)],
)
def test_cells_of_robustness_tasks_fill_their_seats(spark, name, ledger, n):
    rows = getattr(modelled, name)(spark, FOLDER).collect()
    assert len(rows) == n
    led = getattr(modelled, ledger)(spark, FOLDER)
    by = modelled.KEYS
    off = led if name != "capacity" else led.where("variant LIKE '%local'")  # global cells rank all rows
    assert _quota(off, by) == 0
    for r in rows:
        assert r.d_pp == pytest.approx(r.gap_pp - r.bench_gap_pp) and 0 <= r.overlap_at_k <= 1
    if name == "capacity":
        assert {r.definition for r in rows} == {"local", "global"} and all(r.diverges == (abs(r.gap_local_pp - r.gap_global_pp) > 1) for r in rows)
    if name == "state_only":
        assert all(r.delta_vs_primary_gap_pp == pytest.approx(r.gap_pp - r.primary_gap_pp) for r in rows)
        steps = modelled.primary_increments(spark, FOLDER).collect()
        assert len(steps) == 2 and all(r.differs == (abs(r.primary_increment_pp - r.state_only_increment_pp) > 1) for r in steps)
    if name == "group_extension":
        wide = [r for r in rows if r.variant == "undeclared_retained"]
        assert len(wide) == 4 and all(r.n_not_declared > 0 for r in wide) and all(r.n_not_declared is None for r in rows if r.variant != "undeclared_retained")
    if name == "population":
        assert led.where("side IS NULL").count() == 0
    if name == "absence":
        study = modelled.study_rows(spark, FOLDER)
        assert {r.k_seats for r in rows} == {int(0.1 * study.where("split = 'test'").count())} and all(r.n_test > r.k_seats for r in rows)
        w = led.groupBy("block", "model").agg(F.min(F.when(F.col("model_selected"), F.struct("score", (-F.col("id")).alias("i")))).alias("last"), F.max(F.when(~F.col("model_selected"), F.struct("score", (-F.col("id")).alias("i")))).alias("next"))
        assert w.where("last < next").count() == 0  # ties go by id


def test_all_robustness_cells_have_intervals(spark):
    rows = modelled.robustness_bootstrap(spark, FOLDER).collect()
    assert len(rows) == 106 and all(r.d_lo <= r.d_point <= r.d_hi for r in rows)


def test_single_cells_and_the_smoke_test(spark):
    for f, kind in ((modelled.logreg_cell, "logistic"), (modelled.gbt_cell, "boosting")):
        row = f(spark, FOLDER).collect()
        assert len(row) == 1 and row[0].model == kind and row[0].block == "B3"
    rows = {r.model: r for r in modelled.smoke_test(spark, FOLDER).collect()}
    assert set(rows) == {"logistic", "random"} and rows["random"].n_selected == rows["logistic"].n_selected


def test_sweep_keeps_seats_and_other_groups_and_closes_the_gap(spark):
    led = modelled.sweep_ledger(spark, FOLDER)
    assert _quota(led, ["block", "model", "level"]) == 0
    assert led.where("(side IS NULL OR level = 0) AND model_selected <> unmitigated_selected").count() == 0
    rows = modelled.frontier_cells(spark, FOLDER).collect()
    assert len(rows) == 44
    for cell in {(r.block, r.model) for r in rows}:
        line = sorted((r for r in rows if (r.block, r.model) == cell), key=lambda r: r.level)
        assert line[0].target == pytest.approx(line[0].tpr_a_val - line[0].tpr_b_val, abs=1e-6) and line[10].target == pytest.approx(0)
        off = [abs(r.tpr_a_val - r.tpr_b_val - r.target) for r in line[1:]]
        assert max(off) < 0.35  # some ten positives a side
    assert modelled.threshold_cells(spark, FOLDER).count() == 4 and modelled.anchor_cells(spark, FOLDER).count() == 52
    summary = {r.source: r for r in modelled.anchor_summary(spark, FOLDER).collect()}
    assert {s: r.n_cells for s, r in summary.items()} == {"reweighing": 4, "threshold": 4, "frontier": 44}
    assert all(r.least_gap_above_anchor <= r.median_gap_above_anchor <= r.most_gap_above_anchor for r in summary.values())
    boot = modelled.mitigation_bootstrap(spark, FOLDER).collect()
    assert len(boot) == 16 and all(r.cost_point == 0 for r in boot if r.variant == "level0_unmitigated")


def test_strata_and_ties(spark):
    rows = modelled.income_strata(spark, FOLDER).collect()
    assert len(rows) == 6 and all(r.increment_pp == pytest.approx(r.increment_point) and r.increment_lo <= r.increment_point <= r.increment_hi for r in rows)
    assert modelled.income_overlaps(spark, FOLDER).count() == 6
    cells = modelled.tie_cells(spark, FOLDER).collect()
    ties, impact = [r for r in cells if r.section == "ties"], [r for r in cells if r.section == "impact"]
    many = {(r.block, r.model) for r in ties if r.n_tied > modelled.MANY_TIED}
    assert len(ties) == 12 and len(impact) == 2 * len(many) and {(r.block, r.model) for r in impact} == many
    for b, m in many:
        n = {r.rule: r.n_selected for r in impact if (r.block, r.model) == (b, m)}
        t = next(r for r in ties if (r.block, r.model) == (b, m))
        assert n["strict"] == t.k and n["tie_inclusive"] == t.n_inclusive and all(r.verdict for r in impact)


def test_subsamples_of_schools(spark):
    cells = modelled.school_subsample(spark, FOLDER).collect()
    kinds = [r.row_type for r in cells]
    assert kinds.count("metrics") == 8 and kinds.count("composition") == 10
    assert all(abs(sum(r.sub_pct for r in cells if r.row_type == "composition" and r.subsample == s) - 100) < 1e-6 for s in ("school_kind", "school_register"))
    assert modelled.leaving_subsample(spark, FOLDER).count() == 4
    lines = modelled.subsample_export(spark, FOLDER).collect()
    assert len(lines) == 12 and all(r.line.startswith(f"| {r.subsample} | {r.block} | {r.model} |") for r in lines)


@pytest.mark.parametrize("ledger, variants", [(modelled.composite_ledger, 5), (modelled.capacity_ledger, 2)])
def test_variants_of_a_task_are_fitted_side_by_side(spark, monkeypatch, ledger, variants):
    met = threading.Barrier(variants, timeout=120)

    class Met(Exception):
        pass

    def fit(*_):
        met.wait()
        raise Met

    monkeypatch.setattr(modelled, "fit_cells", fit)
    monkeypatch.setattr(modelled, "_params", lambda *_: {})
    with pytest.raises(Met):
        ledger(spark, FOLDER)
