"""Queries with fitted models or random resamples: their digits depend on the library, so tests check invariants.

A study of one folder of tables is stored in the shared folder as it goes: the tuned
parameters and scores of the main grid, and each task's ledger of decisions. Queries that
need them read them, or build them first.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import replace
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BLOCKS, STUDY, BlockSpec, Contrast
from ..functions.columns import any_cell, capacity_label, hash_uniform
from ..operators import composite, encoding, inference, metrics, mitigation, models, selection, splitting
from ..sources.tables import aligned, append_csv, commit, cut, joined_whole, logger, read_parameters, read_small, side_by_side, stored, study_home
from .candidates import analytic, decisions, side, split_rows
from .relational import anchor_distance, random_cell, searched, side_sizes, tercile_increments, terciles, with_tercile

Query = Callable[[SparkSession, str], DataFrame]
K = STUDY.capacity
MODELS = models.MODELS
PAIR = ("B3", "B4")
CELL = ["block", "model", "k"]
KEYS = ["task", "variant", *CELL, "group_a", "group_b"]
A, B = "EUROPE", "AFRICA_AMERICA"


def labelled(rows: DataFrame, score: str = "composite", capacity: float = K) -> DataFrame:
    """The benchmark of each split among its own rows."""
    return selection.top_within(rows, score, capacity, ["split"], "label")


def _settings(spark: SparkSession) -> tuple:
    """All that results of a study depend on besides its tables."""
    return STUDY, models.C_GRID, models.boosting_grid(spark)


def kept(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stored table of the study under its settings."""
    return stored(spark, folder, name, build, _settings(spark))


def study_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates with their split, each once on both sides of the join, and the benchmark of their split."""
    base = stored(spark, folder, "analytic", lambda: analytic(spark, folder))
    split = stored(spark, folder, "split", lambda: split_rows(base).select("id", "decile", "split"))
    return stored(spark, folder, "rows", lambda: labelled(joined_whole(base, split)))


def encoded(rows: DataFrame) -> DataFrame:
    """Numeric features and the label as a double; saved, as every block and fit reads them."""
    return cut(encoding.numeric_features(cut(rows)).withColumn("y", F.col("label").cast("double")).withColumn("side", side()))


def fit_cells(rows: DataFrame, specs: Iterable[BlockSpec], params: dict, weight: str | None = None) -> DataFrame:
    return models.fit_cells(rows, list(specs), params, weight)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(partial(DataFrame.unionByName, allowMissingColumns=True), parts)


# --- the main grid


def _cells(spark: SparkSession, folder: str, blocks: Sequence[str]) -> dict[str, str]:
    """For each block the folder of its scores and parameters, which are tuned if no one has committed them."""
    home = study_home(spark, folder, _settings(spark))
    missing = [BLOCKS[b] for b in blocks if read_small(spark, f"{home}/{b}.done") is None]
    if missing:
        tuned = models.tune(encoded(study_rows(spark, folder)), missing, models.boosting_grid(spark), models.C_GRID)
        data = f"{home}/cells-{uuid.uuid4().hex}"
        rows = [(*cell, json.dumps(p), tuned.width[cell[0]], tuned.overlap[cell]) for cell, p in tuned.params.items()]
        for b, m, text, _, overlap in rows:
            logger().info("%s/%s: %s, validation overlap %.4f", b, m, text, overlap)
        append_csv(spark.createDataFrame(rows, "block string, model string, best_params string, n_features int, val_overlap_at_k double"), f"{data}/parameters")
        tuned.scores.write.partitionBy("block").parquet(f"{data}/scores")
        for s in missing:  # from here on both are seen
            commit(spark, f"{home}/{s.name}.done", data)
    return {b: read_small(spark, f"{home}/{b}.done") for b in blocks}


def main_scores(spark: SparkSession, folder: str, blocks: Sequence[str] = tuple(BLOCKS)) -> tuple[DataFrame, dict]:
    """Scores of the tuned cells for every split, and their parameters."""
    where = _cells(spark, folder, blocks)
    scores = _union([spark.read.parquet(f"{p}/scores/block={b}").withColumn("block", F.lit(b)) for b, p in where.items()])
    params = {}
    for b, p in where.items():
        params |= {cell: x for cell, x in read_parameters(spark, f"{p}/parameters").items() if cell[0] == b}
    return scores, params


def grid_report(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters, validation overlap and number of features of each cell."""
    parts = [spark.read.csv(f"{p}/parameters", header=True, escape='"').where(F.col("block") == b) for b, p in _cells(spark, folder, tuple(BLOCKS)).items()]
    return _union(parts).select("block", "model", "best_params", F.col("n_features").cast("int").alias("n_features"), F.col("val_overlap_at_k").cast("double").alias("val_overlap_at_k"))


def decided(scored: DataFrame, task: str, variant: str | Column, capacity: float = K, part: str = "test") -> DataFrame:
    """Decisions within one split against its benchmark ``label``, in the form of a ledger; ``seats`` is the quota."""
    rows = scored.where(F.col("split") == part).withColumn("bench_selected", F.col("label"))
    out = selection.top_within(rows, "score", capacity, ["block", "model"], "model_selected")
    seats = F.floor(F.lit(float(capacity)) * F.count(F.lit(1))).cast("long").alias("seats")
    return as_ledger(out.join(F.broadcast(out.groupBy("block", "model").agg(seats)), ["block", "model"]), task, variant, capacity)


def as_ledger(rows: DataFrame, task: str, variant: str | Column, capacity: float, groups: tuple[str, str] = (A, B)) -> DataFrame:
    heads = [F.lit(task).alias("task"), (variant if isinstance(variant, Column) else F.lit(variant)).alias("variant"), F.lit(float(capacity)).alias("k"), F.lit(groups[0]).alias("group_a"), F.lit(groups[1]).alias("group_b")]
    keep = ["id", "grp", "sex", "band", "side", "block", "model", "score", "label", "seats", "model_selected", "bench_selected"]
    return rows.select(*heads, *[c for c in keep if c in rows.columns])


def measures(led: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """Contrast and agreement of every cell, with the ledger's own sides."""
    return metrics.group_metrics(led, by, F.col("side")).join(metrics.agreement(led, by, F.col("seats")), list(by))


def evaluate(led: DataFrame, by: Sequence[str]) -> DataFrame:
    """All measures of a cell in one row."""
    parts = [metrics.group_metrics(led, by, F.col("side")), metrics.agreement(led, by, F.col("seats")), metrics.average_precision(led, by), metrics.roc_auc(led, by), metrics.zero_sum(led, by), metrics.side_errors(led, by)]
    return reduce(lambda a, b: a.join(b, list(by)), parts)


def main_ledger(spark: SparkSession, folder: str, blocks: Sequence[str] = tuple(BLOCKS)) -> DataFrame:
    def build() -> DataFrame:
        scores, _ = main_scores(spark, folder, blocks)
        rows = study_rows(spark, folder).where("split = 'test'").withColumn("side", side())
        return decided(scores.where("split = 'test'").drop("split").join(rows, "id"), "B5", "primary")

    return kept(spark, folder, "ledger-B5-" + "".join(blocks), build)


def main_grid(spark, folder):
    """Each block and model tuned on its own: 12 rows."""
    out = evaluate(main_ledger(spark, folder), CELL)
    return out.join(grid_report(spark, folder), ["block", "model"])


def _one_cell(spark: SparkSession, folder: str, model: str) -> DataFrame:
    return evaluate(main_ledger(spark, folder, ("B3",)).where(F.col("model") == model), CELL)


def logreg_cell(spark, folder):
    return _one_cell(spark, folder, "logistic")


def gbt_cell(spark, folder):
    return _one_cell(spark, folder, "boosting")


def smoke_test(spark, folder):
    """One block against uniform scores."""
    rows = study_rows(spark, folder).where("split = 'test'").withColumn("side", side()).withColumn("block", F.lit("none")).withColumn("model", F.lit("random"))
    anchor = decided(rows.withColumn("score", hash_uniform("anchor", "id")), "B4", "anchor")
    led = main_ledger(spark, folder, ("B1",)).where("model = 'logistic'").unionByName(anchor, allowMissingColumns=True)
    return evaluate(cut(led), CELL)


def main_bootstrap(spark, folder):
    """Intervals and verdicts of the main grid: 12 rows."""
    return inference.bootstrap(main_ledger(spark, folder), CELL)


# --- robustness: each task's ledger, stored, and its table


def _params(spark: SparkSession, folder: str, blocks: Sequence[str] = PAIR) -> dict:
    return main_scores(spark, folder, blocks)[1]


def _specs(blocks: Sequence[str] = PAIR) -> list[BlockSpec]:
    return [BLOCKS[b] for b in blocks]


def capacity_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The label is made again for each capacity; parameters stay. Local cells rank the test rows, global ones all rows."""

    def build() -> DataFrame:
        base, params = study_rows(spark, folder).drop("label"), _params(spark, folder, tuple(BLOCKS))

        def at(k: float) -> DataFrame:
            rows = selection.top_quota(cut(labelled(base, capacity=k)), "composite", k, "bench_global")
            scored = fit_cells(encoded(rows), BLOCKS.values(), params)
            local = decided(scored, "D1", F.concat(capacity_label(k), F.lit("_local")), k)
            ranked = selection.top_within(scored, "score", k, ["block", "model"], "model_selected").where("split = 'test'").withColumn("bench_selected", F.col("bench_global"))
            ranked = ranked.join(F.broadcast(local.select("block", "model", "seats").distinct()), ["block", "model"])
            return local.unionByName(as_ledger(ranked, "D1", F.concat(capacity_label(k), F.lit("_global")), k))

        return _union(side_by_side(spark, [partial(at, k) for k in (0.05, 0.20)]))

    return kept(spark, folder, "ledger-D1", build)


def capacity(spark, folder):
    """48 rows, with the flag of gaps that differ by more than a point between the definitions."""
    out = measures(capacity_ledger(spark, folder)).withColumn("definition", F.substring_index("variant", "_", -1))
    gap = {d: F.max(F.when(F.col("definition") == d, F.col("gap_pp"))).alias(f"gap_{d}_pp") for d in ("local", "global")}
    both = out.groupBy(*CELL).agg(*gap.values()).withColumn("diverges", F.abs(F.col("gap_local_pp") - F.col("gap_global_pp")) > 1)
    return out.join(both, CELL)


def composite_ledger(spark: SparkSession, folder: str) -> DataFrame:
    def build() -> DataFrame:
        base, params = cut(composite.standardised(study_rows(spark, folder).drop("label"))), _params(spark, folder)

        def under(name: str) -> DataFrame:
            score = F.col("composite_std") if name == "standardised" else composite.weighted_scheme(name)
            rows = labelled(base.withColumn("composite", score))
            return decided(fit_cells(encoded(rows), _specs(), params), "D2", name)

        return _union(side_by_side(spark, [partial(under, n) for n in [*composite.SCHEMES, "standardised"]]))

    return kept(spark, folder, "ledger-D2", build)


def composite_schemes(spark, folder):
    """20 rows: five composites."""
    return measures(composite_ledger(spark, folder))


def state_only_ledger(spark: SparkSession, folder: str) -> DataFrame:
    def build() -> DataFrame:
        blocks = tuple(b for b in BLOCKS if b != "B1")
        rows, params = encoded(study_rows(spark, folder)), _params(spark, folder, tuple(BLOCKS))
        return decided(fit_cells(rows, [replace(s, municipality=False) for s in _specs(blocks)], params), "D3", "state_only")

    return kept(spark, folder, "ledger-D3", build)


def state_only(spark, folder):
    """Blocks without the municipality against the primary cells: 10 rows."""
    primary = measures(main_ledger(spark, folder), CELL).select(*CELL, F.col("gap_pp").alias("primary_gap_pp"))
    out = aligned_cells(measures(state_only_ledger(spark, folder)), primary)
    return out.withColumn("delta_vs_primary_gap_pp", F.col("gap_pp") - F.col("primary_gap_pp"))


def aligned_cells(cells: DataFrame, primary: DataFrame) -> DataFrame:
    """Cells with the columns of the primary cell of the same block, model and capacity, which must be there."""
    key = F.concat_ws("/", "block", "model", "k")
    return aligned(cells.withColumn("_cell", key), primary.withColumn("_cell", key).drop(*CELL), "_cell").drop("_cell")


def primary_increments(spark, folder):
    """How the step from B3 to B4 changes the gap, with and without the municipality; by model."""

    def step(m: DataFrame, name: str) -> DataFrame:
        at = {b: F.max(F.when(F.col("block") == b, F.col("gap_pp"))) for b in PAIR}
        return m.groupBy("model").agg((at["B4"] - at["B3"]).alias(name))

    out = step(measures(main_ledger(spark, folder), CELL), "primary_increment_pp").join(step(measures(state_only_ledger(spark, folder)), "state_only_increment_pp"), "model")
    return out.withColumn("differs", F.abs(F.col("primary_increment_pp") - F.col("state_only_increment_pp")) > 1)


VARIANTS = {"second_vs_first": Contrast((A,), ("AFRICA",)), "third_vs_first": Contrast((A,), ("AMERICA",)), "others_vs_first": Contrast((A,), ("AFRICA", "AMERICA", "ASIA"))}


def groups_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Other contrasts of the stored decisions, and a population that keeps the undeclared."""

    def build() -> DataFrame:
        led, parts = main_ledger(spark, folder, PAIR), []
        for name, x in VARIANTS.items():
            sides = F.when(F.col("grp").isin(*x.a), "A").when(F.col("grp").isin(*x.b), "B")
            parts.append(as_ledger(led.withColumn("side", sides), "D4", name, K, ("_".join(x.a), "_".join(x.b))))
        parts.append(as_ledger(led.withColumn("side", F.when(F.col("sex") == "F", "A").otherwise("B")), "D4", "sex", K, ("F", "M")))
        known = study_rows(spark, folder).select("id", "split")
        wide = splitting.quantile_bins(cut(analytic(spark, folder, (1, 2, 3, 4))), "composite", 10, "decile")
        rows = labelled(splitting.extend_split(wide, known, F.concat_ws("_", F.col("grp"), F.col("decile").cast("string"))))
        parts.append(decided(fit_cells(encoded(rows), _specs(), _params(spark, folder)), "D4", "undeclared_retained"))
        return _union(parts)

    return kept(spark, folder, "ledger-D4", build)


def group_extension(spark, folder):
    """20 rows: four contrasts of stored decisions, and the refitted population with three counts of the undeclared."""
    led = groups_ledger(spark, folder)
    none = F.col("grp") == STUDY.undeclared
    counts = {"n_not_declared": none, "n_bench_positive_not_declared": none & F.col("bench_selected"), "n_model_positive_not_declared": none & F.col("model_selected")}
    more = led.where("variant = 'undeclared_retained'").groupBy(*KEYS).agg(*[F.count_if(x).alias(n) for n, x in counts.items()])
    return measures(led).join(more, KEYS, "left")


def population_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Other groups leave training and ranking; the benchmark is made again."""

    def build() -> DataFrame:
        rows = labelled(study_rows(spark, folder).drop("label").withColumn("_s", side()).where("_s IS NOT NULL").drop("_s"))
        return decided(fit_cells(encoded(rows), _specs(), _params(spark, folder)), "D5", "restricted")

    return kept(spark, folder, "ledger-D5", build)


def population(spark, folder):
    """4 rows."""
    n = study_rows(spark, folder).withColumn("_s", side()).where("_s IS NOT NULL").agg(F.count(F.lit(1)).alias("n_population"))
    return measures(population_ledger(spark, folder)).crossJoin(F.broadcast(n))


def absence_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Those without all scores count as not selected; seats are those of the completers, ties go by id."""

    def build() -> DataFrame:
        done = study_rows(spark, folder).drop("decile")
        rest = cut(analytic(spark, folder, (1, 2, 5)).join(done.select("id"), "id", "left_anti"))
        rest = splitting.stratified_split(rest, F.col("grp")).withColumn("label", F.lit(False))
        shared = sorted(set(done.columns) & set(rest.columns))
        both = done.select(*shared, F.lit(True).alias("completer")).unionByName(rest.select(*shared, F.lit(False).alias("completer")))
        scored = fit_cells(encoded(both), _specs(), _params(spark, folder)).where("split = 'test'")
        seats = done.where("split = 'test'").agg(F.floor(F.lit(K) * F.count(F.lit(1))).cast("long").alias("seats"))
        led = selection.top_seats(scored.crossJoin(F.broadcast(seats)), "score", F.col("seats"), ["block", "model"], "model_selected", seeded=False)
        return as_ledger(led.withColumn("bench_selected", F.col("label")), "D6", "end_to_end", K)

    return kept(spark, folder, "ledger-D6", build)


def absence(spark, folder):
    """4 rows."""
    led = absence_ledger(spark, folder)
    sizes = led.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_test"), F.max("seats").alias("k_seats"))
    return measures(led).join(sizes, KEYS)


def robustness_bootstrap(spark, folder):
    """Intervals and verdicts of every cell of the robustness tasks: 106 rows."""
    _cells(spark, folder, tuple(BLOCKS))  # all of them need these
    ledgers = side_by_side(spark, [partial(f, spark, folder) for f in (capacity_ledger, composite_ledger, state_only_ledger, groups_ledger, population_ledger, absence_ledger)])
    return inference.bootstrap(_union(ledgers), KEYS)


# --- mitigation


def _refitted(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the primary cells for validation and test rows, fitted again; they must be those of the main grid."""

    def build() -> DataFrame:
        scores, params = main_scores(spark, folder, PAIR)
        scored = fit_cells(encoded(study_rows(spark, folder)), _specs(), params)
        off = metrics.greatest_difference(scored.select("id", "block", "model", "score"), scores.select("id", "block", "model", "score"), ["id", "block", "model"])
        if off >= 1e-6:
            raise ValueError(f"scores of the refitted cells are up to {off} off")
        return scored.where("split <> 'train'")

    return kept(spark, folder, "refitted", build)


def reweighed_ledger(spark: SparkSession, folder: str) -> DataFrame:
    def build() -> DataFrame:
        rows = encoded(study_rows(spark, folder))
        weights = mitigation.reweighing(rows.where("split = 'train'")).groupBy("grp", "label").agg(F.first("weight").alias("weight"))
        weighted = rows.join(F.broadcast(weights), ["grp", "label"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        return decided(fit_cells(cut(weighted), _specs(), _params(spark, folder), "weight"), "E1", "reweighing")

    return kept(spark, folder, "ledger-E1", build)


def reweighed_fit(spark, folder):
    """4 rows."""
    return evaluate(reweighed_ledger(spark, folder), CELL).withColumn("mitigation", F.lit("reweighing"))


def sweep_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Test decisions of every level: searched on the validation rows, moved to the test rows as rates.

    Level 0 is the unmitigated selection; the rows of other groups keep their decisions, and
    every level selects as many rows as the unmitigated one.
    """

    def build() -> DataFrame:
        by, scored = ["block", "model"], _refitted(spark, folder)
        val, test = (cut(decided(scored, "E3", "sweep", part=p)) for p in ("val", "test"))
        levels = mitigation.target_gaps(val, by)
        found = searched(val, by, levels.where("level > 0").drop("gap0"))
        moved = mitigation.transfer(found, side_sizes(val, by), side_sizes(test, by), by).select(*by, "level", "n_a_test", "n_b_test", "tau_a", "tau_b", "tpr_a", "tpr_b")
        start = mitigation.unmitigated(test, by).select(*by, F.lit(0).alias("level"), F.col("n_a").alias("n_a_test"), F.col("n_b").alias("n_b_test"))
        before = mitigation.unmitigated(val, by).select(*by, "tpr_a", "tpr_b")
        seats = moved.unionByName(start.join(before, by), allowMissingColumns=True).join(levels, [*by, "level"])
        strength = F.when(F.col("gap0") != 0, 1 - F.col("target") / F.col("gap0"))
        seats = cut(seats.withColumn("strength", strength).drop("gap0").withColumnsRenamed({"tpr_a": "tpr_a_val", "tpr_b": "tpr_b_val"}))
        wide = test.withColumnRenamed("model_selected", "unmitigated_selected").join(F.broadcast(seats), by)
        held = F.col("side").isNotNull()
        own = F.when(F.col("side") == "A", F.col("n_a_test")).otherwise(F.col("n_b_test"))
        new = selection.top_seats(wide.where(held).withColumn("_seats", own), "score", F.col("_seats"), [*by, "level", "side"], "model_selected").drop("_seats")
        led = cut(new.unionByName(wide.where(~held).withColumn("model_selected", F.col("unmitigated_selected"))))
        return mitigation.require_capacity(led, [*by, "level"], F.col("seats"))

    return kept(spark, folder, "ledger-E3", build)


_LEVEL = ["target", "strength", "tau_a", "tau_b", "tpr_a_val", "tpr_b_val"]


def _levelled(spark: SparkSession, folder: str, led: DataFrame) -> DataFrame:
    by = [*CELL, "level"]
    counts = led.groupBy(*by).agg(F.count_if("model_selected").alias("n_realised"), F.max("seats").alias("n_target"), *[F.max(c).alias(c) for c in _LEVEL])
    return evaluate(led, by).join(counts, by)


def threshold_cells(spark, folder):
    """Equal rates of true positives: 4 rows."""
    return _levelled(spark, folder, sweep_ledger(spark, folder).where("level = 10"))


def frontier_cells(spark, folder):
    """11 levels of 4 cells: 44 rows."""
    return _levelled(spark, folder, sweep_ledger(spark, folder))


def anchor_cells(spark: SparkSession, folder: str) -> DataFrame:
    """All mitigated cells with their distance from a random selection of the same rows: 52 rows."""
    _cells(spark, folder, PAIR)  # both ledgers need these
    side_by_side(spark, [partial(f, spark, folder) for f in (reweighed_ledger, sweep_ledger)])
    led = random_cell(spark, folder)
    anchor = metrics.agreement(led, ["block"]).join(metrics.group_metrics(led, ["block"]), "block").select("overlap_at_k", "gap_pp")
    e1 = reweighed_fit(spark, folder).withColumn("source", F.lit("reweighing")).withColumn("level", F.lit(0))
    e2 = threshold_cells(spark, folder).withColumn("source", F.lit("threshold")).withColumn("strength", F.lit(1.0))
    e3 = frontier_cells(spark, folder).withColumn("source", F.lit("frontier"))
    return anchor_distance(_union([e1, e2, e3]), anchor)


def anchor_summary(spark, folder):
    """Least, median and greatest distance by source, and how many cells are near the anchor."""
    out = anchor_cells(spark, folder).groupBy("source")
    spread = [f(c).alias(f"{n}_{c}") for c in ("overlap_above_anchor", "gap_above_anchor") for n, f in (("least", F.min), ("median", F.median), ("most", F.max))]
    return out.agg(F.count(F.lit(1)).alias("n_cells"), *spread, F.count_if("near_anchor").alias("n_near"))


def mitigation_bootstrap(spark, folder):
    """D, its verdict and the cost in fidelity of reweighing, thresholds and the sweep's ends: 16 rows."""
    _cells(spark, folder, PAIR)  # all ledgers need these
    base, e1, e3 = side_by_side(spark, [partial(main_ledger, spark, folder, PAIR), *(partial(f, spark, folder) for f in (reweighed_ledger, sweep_ledger))])
    base = base.select("id", "block", "model", F.col("model_selected").alias("unmitigated_selected"))
    e1 = joined_cells(e1, base)
    ends = e3.withColumn("variant", F.when(F.col("level") == 0, "level0_unmitigated").when(F.col("level") == 10, "level10_full_eq"))
    e2 = e3.where("level = 10").withColumn("task", F.lit("E2")).withColumn("variant", F.lit("threshold_eq_opp"))
    wanted = {"E1": None, "E2": None, "E3": ("level0_unmitigated", "level10_full_eq")}
    led = cut(_union([e1, e2, ends]).where(any_cell(wanted)))
    return inference.bootstrap(led, KEYS).join(inference.bootstrap_fidelity(led, KEYS), KEYS)


def joined_cells(led: DataFrame, base: DataFrame) -> DataFrame:
    return led.join(base, ["id", "block", "model"])


# --- strata, ties, composition


def income_strata(spark, folder):
    """The step from B3 to B4 within terciles of the whole population, on test rows: 6 rows."""
    rows = study_rows(spark, folder)
    bench = selection.top_quota(rows, "composite", K, "bench_selected").where("split = 'test'").select("id", "bench_selected")
    led = main_ledger(spark, folder, PAIR).drop("bench_selected").join(bench, "id")
    led = cut(with_tercile(led, terciles(rows)))
    m = metrics.group_metrics(led, ["tercile", "model", "block"], F.col("side"))
    at = {b: F.max(F.when(F.col("block") == b, F.col("model_selected"))) for b in PAIR}
    wide = led.groupBy("id", "side", "tercile", "model").agg(at["B3"].alias("first"), at["B4"].alias("second"))
    boot = inference.bootstrap_increment(wide, ["tercile", "model"], "first", "second")
    return tercile_increments(m, ["tercile", "model"]).join(boot, ["tercile", "model"])


def income_overlaps(spark, folder):
    """Whether the intervals of two terciles overlap, by model: 6 rows."""
    boot = cut(income_strata(spark, folder))
    a, b = (boot.select("model", F.col("tercile").alias(f"tercile_{s}"), F.col("increment_lo").alias(f"lo_{s}"), F.col("increment_hi").alias(f"hi_{s}")) for s in "ab")
    both = a.join(b, "model").where("tercile_a < tercile_b")  # a row a tercile
    return both.select("model", "tercile_a", "tercile_b", (~((F.col("hi_a") < F.col("lo_b")) | (F.col("hi_b") < F.col("lo_a")))).alias("overlaps"))


#: Rows tied at the boundary beyond which a cell is looked at under the tie-inclusive rule too.
MANY_TIED = 10


def tie_cells(spark, folder):
    """Ties at the boundary of the main grid's cells, distinct scores and feature vectors: 12 rows.

    For each cell with more than MANY_TIED tied rows two more, with the gap and the verdict of its interval
    under the strict and the tie-inclusive rule.
    """
    led = main_ledger(spark, folder)
    by = ["block", "model"]
    info = selection.tie_info(led, "score", K, by)
    sizes = led.groupBy(*by, "score").agg(F.count(F.lit(1)).alias("m"))
    largest = F.max(F.struct("m", "score"))
    spread = sizes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_distinct_scores"), largest.alias("x")).select(*by, "n_distinct_scores", F.col("x.m").alias("largest_score_group"), F.col("x.score").alias("_largest"))
    rows = encoded(study_rows(spark, folder))
    vectors = [encoding.assemble(rows, s)[0].where("split = 'test'").select(F.col("features").cast("string").alias("v")).agg(F.countDistinct("v").alias("n_distinct_vectors")).withColumn("block", F.lit(s.name)) for s in _specs(tuple(BLOCKS))]
    cells = info.join(spread, by).join(_union(vectors), "block").withColumn("boundary_in_largest_group", F.col("boundary") == F.col("_largest")).drop("_largest")
    tied = cells.where(F.col("n_tied") > MANY_TIED).select(*by)  # a row a cell
    some = led.join(F.broadcast(tied), by)
    wide = selection.tie_inclusive(some.drop("model_selected"), "score", K, by, "model_selected")
    both = cut(some.withColumn("rule", F.lit("strict")).unionByName(wide.withColumn("rule", F.lit("tie_inclusive"))))
    keys = [*by, "rule"]
    impact = both.groupBy(*keys).agg(F.count_if("model_selected").alias("n_selected"))
    impact = impact.join(inference.bootstrap(both, keys).select(*keys, "gap_pp", F.col("ratio_point").alias("ratio"), F.col("d_point").alias("d_pp"), "verdict"), keys)
    return _union([cells.withColumn("section", F.lit("ties")), impact.withColumn("section", F.lit("impact"))])


# --- subsamples by school


def _subsample(spark: SparkSession, folder: str, name: str, where: str, extra: tuple[str, ...]) -> DataFrame:
    """A subsample keeps its split; its benchmark and fits are its own, with the primary parameters."""

    def build() -> DataFrame:
        rows = labelled(study_rows(spark, folder).drop("label").where(where))
        return decided(fit_cells(encoded(rows), [replace(s, extra=extra) for s in _specs()], _params(spark, folder)), "K", name)

    return kept(spark, folder, f"ledger-{name}", build)


SUBSAMPLES = {"school_kind": ("school IN (2, 3)", ("school",)), "school_register": ("owner IS NOT NULL AND place IS NOT NULL", ("owner", "place")), "leaving_no_features": ("status = 2", ())}


def subsample_cells(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """Cells of subsamples with their intervals, beside the full sample's: 4 rows a subsample."""
    _cells(spark, folder, PAIR)  # all subsamples need these
    led = _union(side_by_side(spark, [partial(_subsample, spark, folder, n, *SUBSAMPLES[n]) for n in names]))
    boot = inference.bootstrap(led, KEYS).select(*KEYS, "d_lo", "d_hi", "verdict")
    sizes = led.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_test"))
    full_led = main_ledger(spark, folder, PAIR)
    full = metrics.group_metrics(full_led, CELL, F.col("side")).join(inference.bootstrap(full_led, CELL).select(*CELL, F.col("verdict").alias("full_verdict")), CELL, "left")
    full = full.select(*CELL, *[F.col(c).alias(f"full_{c}") for c in ("gap_pp", "ratio", "d_pp")], "full_verdict")
    out = aligned_cells(measures(led).join(boot, KEYS, "left").join(sizes, KEYS), full)
    return out.withColumnRenamed("variant", "subsample").withColumn("verdict_matches", F.col("verdict") == F.col("full_verdict"))


def school_subsample(spark, folder):
    """Two subsamples with features of their schools, and their composition by group against the full sample: 18 rows on five groups."""
    names = ("school_kind", "school_register")
    rows, parts = study_rows(spark, folder), [subsample_cells(spark, folder, names).withColumn("row_type", F.lit("metrics"))]

    def shares(df: DataFrame, n: str, pct: str) -> DataFrame:
        sizes = df.groupBy("grp").agg(F.count(F.lit(1)).alias(n))
        total = sizes.agg(F.sum(n).alias("_t"))
        return sizes.crossJoin(F.broadcast(total)).select("grp", n, (100 * F.col(n) / F.col("_t")).alias(pct))

    for n in names:
        both = shares(rows.where(SUBSAMPLES[n][0]), "sub_n", "sub_pct").join(shares(rows, "full_n", "full_pct").drop("full_n"), "grp")
        parts.append(both.withColumn("diff_pp", F.col("sub_pct") - F.col("full_pct")).withColumn("subsample", F.lit(n)).withColumn("row_type", F.lit("composition")))
    return _union(parts)


def leaving_subsample(spark, folder):
    """The first subsample's population without features of schools: 4 rows. It must be the same population."""
    rows = study_rows(spark, folder)
    a, b = (rows.where(SUBSAMPLES[n][0]).select("id") for n in ("school_kind", "leaving_no_features"))
    differ = a.exceptAll(b).unionAll(b.exceptAll(a)).count()
    if differ:
        raise ValueError(f"{differ} rows are in one of two populations that should be the same")
    return subsample_cells(spark, folder, ("leaving_no_features",))


def subsample_export(spark, folder):
    """All subsamples' cells in one table: 12 rows, with a line of text for each."""
    out = subsample_cells(spark, folder, tuple(SUBSAMPLES))
    shown = F.format_string("| %s | %s | %s | %+.2fpp | [%+.2f, %+.2f] | %s | %.4f |", "subsample", "block", "model", "d_pp", "d_lo", "d_hi", "verdict", "overlap_at_k")
    return out.select("subsample", "block", "model", "d_pp", "d_lo", "d_hi", "verdict", "overlap_at_k", "gap_pp", "ratio", "bench_gap_pp", "n_test", shown.alias("line"))


# --- controls


def bootstrap_multinomial(spark, folder):
    return inference.bootstrap(decisions(analytic(spark, folder)), ["block"])


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        logreg_cell, gbt_cell, smoke_test, main_grid, main_bootstrap, capacity, composite_schemes, state_only, primary_increments, group_extension, population, absence, robustness_bootstrap,
        reweighed_fit, threshold_cells, frontier_cells, anchor_cells, anchor_summary, mitigation_bootstrap, income_strata, income_overlaps, tie_cells,
        school_subsample, leaving_subsample, subsample_export, bootstrap_multinomial,
    )
}
