"""Deterministic queries: each has the same rows in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import STUDY, Contrast
from ..functions.columns import any_cell, capacity_label, hash_uniform, letter_ordinal, verdict
from ..operators import cascade, composite, descriptives, encoding, inference, metrics, mitigation, selection, splitting
from ..sources.tables import ledger, read_parquet, study_home, upsert
from ..streaming import chunks
from . import candidates as c
from .candidates import CAND, DEC, SIDE, STEPS, analytic, ana_sql, candidates, decisions, rank_sql, side, split_rows, split_sql, top_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
K = STUDY.capacity
METRICS = "rate_a_pct rate_b_pct gap_pp ratio"
METRIC14 = METRICS + " bench_rate_a_pct bench_rate_b_pct bench_gap_pp d_pp"


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six digits, without a negative zero."""
    return df.select(*[(F.round(F.col(n), 6) + F.lit(0.0)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def query(name: str, ctes: str, final: str, doubles: str = "") -> Callable[[Query], Query]:
    """Register a query with its SQL; ``doubles`` are the columns that both sides round."""

    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, folder: tidy(f(spark, folder))
        rounded = ", ".join(f"round({d}, 6) + 0.0 AS {d}" for d in doubles.split())
        ORACLE_SQL[name] = f"WITH {ctes}\nSELECT *" + (f" REPLACE ({rounded})" if rounded else "") + f" FROM ({final})"
        return f

    return add


ANA = f"{CAND},\n{ana_sql()}"
LED = f"{ANA},\n{DEC}"
SPLIT = f"{ANA},\n{split_sql('ana')}"
RATES = """100 * avg({s}::INT) FILTER (grp = 'EUROPE') AS rate_a_pct, 100 * avg({s}::INT) FILTER (grp IN ('AFRICA', 'AMERICA')) AS rate_b_pct"""
GAP = "SELECT *, rate_a_pct - rate_b_pct AS gap_pp, rate_a_pct / nullif(rate_b_pct, 0) AS ratio FROM ({})"


def metric_sql(source: str, by: str, side_sql: str = "side") -> str:
    def rate(flag: str, s: str) -> str:
        return f"100 * avg({flag}::INT) FILTER (sd = '{s}')"

    def count(flag: str, s: str) -> str:
        return f"count(*) FILTER (sd = '{s}' AND {flag})"

    return f"""SELECT *, rate_a_pct - rate_b_pct AS gap_pp, rate_a_pct / nullif(rate_b_pct, 0) AS ratio, bench_rate_a_pct - bench_rate_b_pct AS bench_gap_pp,
  (rate_a_pct - rate_b_pct) - (bench_rate_a_pct - bench_rate_b_pct) AS d_pp FROM (
  SELECT {by}, {count('true', 'A')} AS n_a, {count('true', 'B')} AS n_b, {rate('model_selected', 'A')} AS rate_a_pct, {rate('model_selected', 'B')} AS rate_b_pct,
    {rate('bench_selected', 'A')} AS bench_rate_a_pct, {rate('bench_selected', 'B')} AS bench_rate_b_pct,
    {count('model_selected', 'A')} AS n_model_positive_a, {count('model_selected', 'B')} AS n_model_positive_b, {count('bench_selected', 'A')} AS n_bench_positive_a, {count('bench_selected', 'B')} AS n_bench_positive_b
  FROM (SELECT *, {side_sql} AS sd FROM {source}) GROUP BY {by})"""


# --- cascade and benchmark

_COUNTS = " UNION ALL ".join(f"SELECT {i} AS step, '{n}' AS name, count(*) AS n FROM cand" + (f" WHERE {' AND '.join(STEPS[:i])}" if i else "") for i, n in enumerate(["all", "no_practice", "status", "present", "scored", "declared"]))


@query("cascade_counts", CAND, _COUNTS)
def _(spark, folder):
    return cascade.cascade_counts(candidates(spark, folder))


@query("selection_table", ANA, " UNION ALL ".join(GAP.format(f"SELECT {k}::DOUBLE AS k, count(*) AS n, count(*) FILTER (selected) AS n_selected, {RATES.format(s='selected')} FROM {top_sql('ana', 'composite', k)}") for k in (0.05, 0.1, 0.2)), "k " + METRICS)
def selection_table(spark, folder):
    ranked = selection.rank_within(analytic(spark, folder), "composite", [], "rk", "_n")
    return metrics.selection_at(ranked, F.col("rk"), F.col("_n"), (0.05, 0.1, 0.2))


@query("topk_exact", ANA, f"SELECT id, grp, composite FROM {top_sql('ana', 'composite', K)} WHERE selected", "composite")
def _(spark, folder):
    return selection.top_quota(analytic(spark, folder), "composite", K).where("selected").select("id", "grp", "composite")


_LINES = "lines AS (SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS id, l_quantity AS q FROM lineitem)"
_TIES = "SELECT n, k, boundary, count(*) FILTER (q > boundary) AS n_above, count(*) FILTER (q = boundary) AS n_tied, count(*) FILTER (q = boundary AND selected) AS n_drawn, count(*) FILTER (q >= boundary) AS n_inclusive FROM (SELECT *, count(*) OVER () AS n, count(*) FILTER (selected) OVER () AS k, min(q) FILTER (selected) OVER () AS boundary FROM {}) GROUP BY n, k, boundary"


def _lines(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return lines.select((F.col("l_orderkey") * 100 + F.row_number().over(w)).alias("id"), F.col("l_quantity").alias("q"))


@query("topk_tie_info", _LINES, _TIES.format(top_sql("lines", "q", K)), "boundary")
def _(spark, folder):
    return selection.tie_info(_lines(spark, folder), "q", K)


@query("topk_tie_inclusive", ANA, f"SELECT id, band FROM (SELECT id, band, rank() OVER (ORDER BY band) AS r, count(*) OVER () AS n FROM ana) WHERE r <= floor({K}::DOUBLE * n)")
def _(spark, folder):
    # every row tied with the last seat is in: ranks of the few distinct values decide
    rows = analytic(spark, folder)
    sizes = rows.groupBy("band").count()
    before = sizes.withColumn("_r", F.sum("count").over(Window.orderBy("band")) - F.col("count") + 1).withColumn("_n", F.sum("count").over(Window.partitionBy()))
    keep = before.where(F.col("_r") <= F.floor(F.lit(K) * F.col("_n"))).select("band")
    return rows.join(F.broadcast(keep), "band", "left_semi").select("id", "band")


@query("topk_per_split", SPLIT, f"SELECT id, split FROM {top_sql('split', 'composite', K, 'split')} WHERE selected")
def _(spark, folder):
    return selection.top_within(split_rows(analytic(spark, folder)), "composite", K, ["split"]).where("selected").select("id", "split")


@query("topk_local_vs_global", SPLIT, f"SELECT split, count(*) AS n, count(*) FILTER (lo) AS n_local, count(*) FILTER (selected) AS n_global, count(*) FILTER (lo AND selected) AS n_both FROM (SELECT * FROM {top_sql(top_sql('split', 'composite', K, 'split', 'lo'), 'composite', K)}) GROUP BY split")
def _(spark, folder):
    local = selection.top_within(split_rows(analytic(spark, folder)), "composite", K, ["split"], "lo")
    both = selection.top_quota(local, "composite", K)
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if("lo").alias("n_local"), F.count_if("selected").alias("n_global"), F.count_if(F.col("lo") & F.col("selected")).alias("n_both"))


@query("topn_by_group", ANA, f"SELECT id, grp FROM (SELECT id, grp, {rank_sql('composite', 'grp')} AS rk FROM ana) WHERE rk <= 7")
def _(spark, folder):
    return selection.top_seats(analytic(spark, folder), "composite", F.lit(7), ["grp"]).where("selected").select("id", "grp")


@query("boundary_score", ANA, f"SELECT seats, CASE WHEN seats <= 0 THEN 'inf' WHEN seats >= n THEN '-inf' ELSE CAST(round(v, 2) AS VARCHAR) END AS boundary FROM (SELECT s.seats, count(*) AS n, max(composite) FILTER (rk = s.seats) AS v FROM (SELECT composite, {rank_sql('composite')} AS rk FROM ana), (SELECT unnest([0, 1, 10, 25, 100000000]) AS seats) s GROUP BY s.seats)")
def _(spark, folder):
    ranked = selection.global_rank(analytic(spark, folder), "composite").withColumn("seats", F.explode(F.array(*[F.lit(s) for s in (0, 1, 10, 25, 100_000_000)])))
    at = ranked.groupBy("seats").agg(F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("rk") == F.col("seats"), F.col("composite"))).alias("_v"))
    shown = F.regexp_replace(F.format_string("%.2f", "_v"), "0$", "")
    return at.select("seats", F.when(F.col("seats") <= 0, "inf").when(F.col("seats") >= F.col("_n"), "-inf").otherwise(shown).alias("boundary"))


@query("cutoff_diagnostics", SPLIT, f"SELECT split, n, k, boundary, count(*) FILTER (composite > boundary) AS n_above, count(*) FILTER (composite = boundary) AS n_tied, count(*) FILTER (composite = boundary AND selected) AS n_drawn, count(*) FILTER (composite >= boundary) AS n_inclusive, count(*) FILTER (selected) = k AS check_sums FROM (SELECT *, count(*) OVER w AS n, count(*) FILTER (selected) OVER w AS k, min(composite) FILTER (selected) OVER w AS boundary FROM {top_sql('split', 'composite', K, 'split')} WINDOW w AS (PARTITION BY split)) GROUP BY split, n, k, boundary", "boundary")
def _(spark, folder):
    out = selection.tie_info(split_rows(analytic(spark, folder)), "composite", K, ["split"])
    return out.withColumn("check_sums", F.col("n_above") + F.col("n_drawn") == F.col("k"))


# --- descriptives


@query("completion_rates", CAND, f"SELECT grp, count(*) AS n_denominator, count(*) FILTER ({STEPS[2]}) AS n_numerator, 100.0 * count(*) FILTER ({STEPS[2]}) / count(*)::DOUBLE AS value FROM cand WHERE {STEPS[0]} AND {STEPS[1]} GROUP BY grp", "value")
def _(spark, folder):
    return descriptives.completion_rates(cascade.apply_cascade(candidates(spark, folder), (1, 2)))


@query("subject_gaps", ANA, " UNION ALL ".join(f"SELECT 's{i}' AS subject, g AS gap, g / sd AS gap_sd FROM (SELECT avg(s{i}) FILTER (grp = 'EUROPE') - avg(s{i}) FILTER (grp IN ('AFRICA', 'AMERICA')) AS g, stddev_samp(s{i}) AS sd FROM ana)" for i in range(1, 6)), "gap gap_sd")
def _(spark, folder):
    return descriptives.subject_gaps(analytic(spark, folder))


@query("composite_by_group", ANA, "SELECT grp, count(*) AS n, avg(composite) AS mean, stddev_samp(composite) AS sd FROM ana GROUP BY grp", "mean sd")
def _(spark, folder):
    return descriptives.by_group(analytic(spark, folder), "composite")


_POOL = "SELECT grp, count(*) AS n, count(*) FILTER (selected) AS n_selected, 100 * count(*) / (sum(count(*)) OVER ())::DOUBLE AS eligible_pool_share_pct, 100 * count(*) FILTER (selected) / (sum(count(*) FILTER (selected)) OVER ())::DOUBLE AS selected_share_pct FROM {} GROUP BY grp"


@query("pool_composition", ANA, _POOL.format(top_sql("ana", "composite", K)), "eligible_pool_share_pct selected_share_pct")
def _(spark, folder):
    return descriptives.pool_shares(selection.top_quota(analytic(spark, folder), "composite", K))


@query("benchmark_counts", ANA, f"SELECT grp, count(*) FILTER (selected) AS n_selected FROM {top_sql('ana', 'composite', K)} GROUP BY grp")
def _(spark, folder):
    return selection.top_quota(analytic(spark, folder), "composite", K).groupBy("grp").agg(F.count_if("selected").alias("n_selected"))


_SAMPLE = f"samp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY md5(concat('{STUDY.seed}:sample:', id)), id) AS rk, count(*) OVER (PARTITION BY state) AS n FROM cand) WHERE rk <= round_even(0.4::DOUBLE * n, 0))"


@query("sample_fixed_fraction", f"{CAND},\n{_SAMPLE}", "SELECT id, state FROM samp")
def _(spark, folder):
    return splitting.sample_fraction(c.cut(candidates(spark, folder)), 0.4, ["state"]).select("id", "state")


_CATS = ("grp", "sex", "status", "band", "letter", "year", "marital")


def _marginal_sql(source: str) -> str:
    parts = " UNION ALL ".join(f"SELECT '{v}' AS variable, CAST({v} AS VARCHAR) AS category FROM {source}" for v in _CATS)
    return f"SELECT variable, category, count(*) AS n, 100 * count(*) / (sum(count(*)) OVER (PARTITION BY variable))::DOUBLE AS pct FROM ({parts}) GROUP BY variable, category"


@query("marginals", CAND, _marginal_sql("cand"), "pct")
def _(spark, folder):
    return descriptives.marginals(candidates(spark, folder), _CATS)


_COMPARE = f"SELECT coalesce(a.variable, b.variable) AS variable, coalesce(a.category, b.category) AS category, coalesce(round(a.pct, 6), 0) AS full_value, coalesce(round(b.pct, 6), 0) AS sample_value, abs(coalesce(round(a.pct, 6), 0) - coalesce(round(b.pct, 6), 0)) AS abs_diff FROM ({_marginal_sql('cand')}) a FULL JOIN ({_marginal_sql('samp')}) b ON a.variable = b.variable AND a.category IS NOT DISTINCT FROM b.category"
_CONT = ("s1", "s2", "s3", "s4", "s5")
_MOMENTS = " UNION ALL ".join(f"SELECT '{v}' AS variable, '{m}' AS category, round(a, 6) AS full_value, round(b, 6) AS sample_value, abs(round(a, 6) - round(b, 6)) AS abs_diff FROM (SELECT {f}({v}) AS a FROM cand), (SELECT {f}({v}) AS b FROM samp)" for v in _CONT for m, f in (("mean", "avg"), ("sd", "stddev_samp")))


@query("sample_moments", f"{CAND},\n{_SAMPLE}", _MOMENTS, "full_value sample_value abs_diff")
def _(spark, folder):
    rows = c.cut(candidates(spark, folder))
    return descriptives.compare_moments(rows, splitting.sample_fraction(rows, 0.4, ["state"]), _CONT)


for _name in ("sample_vs_full", "full_outer_freq"):

    @query(_name, f"{CAND},\n{_SAMPLE}", _COMPARE if _name == "sample_vs_full" else f"SELECT variable, category, full_value > 0 AS in_full, sample_value > 0 AS in_sample FROM ({_COMPARE})", "full_value sample_value abs_diff" if _name == "sample_vs_full" else "")
    def _(spark, folder, name=_name):
        rows = c.cut(candidates(spark, folder))
        out = descriptives.compare_marginals(rows, splitting.sample_fraction(rows, 0.4, ["state"]), _CATS)
        return out if name == "sample_vs_full" else out.select("variable", "category", (F.col("full_value") > 0).alias("in_full"), (F.col("sample_value") > 0).alias("in_sample"))


@query("sentinel_rates", ANA, " UNION ALL ".join(f"SELECT '{t}' AS population, count(*) AS n, 100 * avg(coalesce(letter = 'H', false)::INT) AS letter_pct, 100 * avg(coalesce(year = 0, false)::INT) AS year_pct FROM {t}" for t in ("cand", "ana")), "letter_pct year_pct")
def _(spark, folder):
    rows = candidates(spark, folder)
    both = [(n, x.agg(F.count(F.lit(1)).alias("n"), descriptives.sentinel_share(F.col("letter"), "H").alias("letter_pct"), descriptives.sentinel_share(F.col("year"), 0).alias("year_pct"))) for n, x in (("cand", rows), ("ana", cascade.apply_cascade(rows)))]
    return both[0][1].select(F.lit(both[0][0]).alias("population"), "*").unionByName(both[1][1].select(F.lit(both[1][0]).alias("population"), "*"))


@query("small_group_counts", CAND, "SELECT count(*) AS n_groups, count(*) FILTER (n < 12) AS n_below, min(n) AS least FROM (SELECT muni, count(*) AS n FROM cand GROUP BY muni)")
def _(spark, folder):
    return descriptives.small_groups(candidates(spark, folder), "muni", 12)


@query("largest_groups", CAND, "SELECT muni, count(*) AS n FROM cand GROUP BY muni ORDER BY n DESC, muni LIMIT 10")
def _(spark, folder):
    return candidates(spark, folder).groupBy("muni").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "muni").limit(10)


_CHUNKS = "SELECT c_mktsegment AS segment, count(c_acctbal) AS n, avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS sd FROM rows GROUP BY c_mktsegment"


@query("chunked_moments", "rows AS (SELECT * FROM customer)", _CHUNKS, "mean sd")
def _(spark, folder):
    """A scan by batches of files, which a study keeps; files are read once as long as the tables stay as they are."""
    schema = read_parquet(spark, folder, "customer").select("c_mktsegment", "c_acctbal").schema
    parts = chunks.scanned(spark, f"{folder}/customer.parquet", schema, lambda rows: chunks.partial_moments(rows, "c_acctbal", ["c_mktsegment"]), study_home(spark, folder, "chunks"))
    return chunks.merged_moments(parts, ["c_mktsegment"]).withColumnRenamed("c_mktsegment", "segment")


# --- composites, bins and splits


@query("composite_weighted", ANA, "SELECT id, " + ", ".join(f"round({' + '.join(f's{i + 1} * {w}::DOUBLE' for i, w in enumerate(ws))}, 4) AS {n}" for n, ws in composite.SCHEMES.items()) + " FROM ana")
def _(spark, folder):
    return analytic(spark, folder).select("id", *[F.round(composite.weighted_scheme(n), 4).alias(n) for n in composite.SCHEMES])


_Z = " + ".join(f"(s{i} - avg(s{i}) OVER ()) / stddev_samp(s{i}) OVER ()" for i in range(1, 6))


@query("composite_standardised", ANA, f"SELECT id, ({_Z}) / 5 AS composite_std FROM ana", "composite_std")
def _(spark, folder):
    return composite.standardised(analytic(spark, folder)).select("id", "composite_std")


@query("quantile_bins", SPLIT, "SELECT id, CAST(decile AS INT) AS decile FROM split_d")
def _(spark, folder):
    return splitting.quantile_bins(analytic(spark, folder), "composite", 10, "decile").select("id", "decile")


@query("stratified_split", SPLIT, "SELECT id, grp, CAST(decile AS INT) AS decile, split FROM split")
def _(spark, folder):
    return split_rows(analytic(spark, folder)).select("id", "grp", "decile", "split")


@query("stratum_sizes", SPLIT, "SELECT split, grp, count(*) AS n FROM split GROUP BY split, grp")
def _(spark, folder):
    return split_rows(analytic(spark, folder)).groupBy("split", "grp").agg(F.count(F.lit(1)).alias("n"))


_EXT = f"{SPLIT},\n{ana_sql((1, 2, 3, 4), 'wide')},\nfresh AS (SELECT * FROM wide WHERE id NOT IN (SELECT id FROM split)),\n{split_sql('fresh', 'ext')}"


@query("split_extension", _EXT, "SELECT id, split, false AS added FROM split UNION ALL SELECT id, split, true FROM ext")
def _(spark, folder):
    known = split_rows(analytic(spark, folder)).select("id", "split")
    wide = analytic(spark, folder, (1, 2, 3, 4)).join(known.withColumnRenamed("split", "_old"), "id", "left")
    fresh = splitting.quantile_bins(c.cut(wide.where("_old IS NULL").drop("_old")), "composite", 10, "decile")
    added = splitting.stratified_split(fresh, F.concat_ws("_", F.col("grp"), F.col("decile").cast("string")))
    return known.select("id", "split", F.lit(False).alias("added")).unionByName(added.select("id", "split", F.lit(True).alias("added")))


# --- encoders


@query("ordinal_letters", CAND, "SELECT id, ascii(band) - 64 AS band_ord, ascii(letter) - 64 AS letter_ord FROM cand")
def _(spark, folder):
    return candidates(spark, folder).select("id", letter_ordinal(F.col("band")).alias("band_ord"), letter_ordinal(F.col("letter")).alias("letter_ord"))


@query("sentinel_median_fill", SPLIT, "SELECT id, CASE WHEN letter = 'H' THEN m ELSE ascii(letter) - 64 END::DOUBLE AS letter_ord, (letter = 'H')::INT AS letter_ord_missing, CASE WHEN year = 0 THEN y ELSE year END::DOUBLE AS year_ord, (year = 0)::INT AS year_ord_missing FROM split, (SELECT median(ascii(letter) - 64) FILTER (letter <> 'H') AS m, median(year) FILTER (year <> 0) AS y FROM split WHERE split = 'train')", "letter_ord year_ord")
def _(spark, folder):
    rows, train = split_rows(analytic(spark, folder)), F.col("split") == "train"
    out = encoding.sentinel_fill(rows, train, letter_ordinal(F.col("letter")), F.col("letter") == "H", "letter_ord")
    return encoding.sentinel_fill(out, train, F.col("year"), F.col("year") == 0, "year_ord").select("id", "letter_ord", "letter_ord_missing", "year_ord", "year_ord_missing")


@query("onehot", SPLIT, "SELECT id, " + ", ".join(f"(marital = '{s}' AND '{s}' IN (SELECT marital FROM split WHERE split = 'train'))::INT AS \"marital_{s}\"" for s in c.SEGMENTS) + " FROM split")
def _(spark, folder):
    rows = split_rows(analytic(spark, folder))
    return encoding.one_hot(rows, rows.where("split = 'train'"), "marital")


_LAB = f"{SPLIT},\nlab AS {top_sql('split', 'composite', K, 'split', 'label')}"


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates with their split and the benchmark of their own split."""
    return selection.top_within(split_rows(analytic(spark, folder)), "composite", K, ["split"], "label")


@query("target_encode", _LAB + ",\ng AS (SELECT muni, min(state) AS state, avg(label::INT) AS mean, count(*) AS n FROM lab WHERE split = 'train' GROUP BY muni),\ns AS (SELECT state, avg(label::INT) AS smean FROM lab WHERE split = 'train' GROUP BY state),\nall_ AS (SELECT avg(label::INT) AS o FROM lab WHERE split = 'train')",
       "SELECT id, coalesce(CASE WHEN g.n < 3 THEN gs.smean ELSE g.n / (g.n + 30.0::DOUBLE) * g.mean + (1 - g.n / (g.n + 30.0::DOUBLE)) * gs.smean END, s.smean, o) AS muni_te FROM lab LEFT JOIN g ON lab.muni = g.muni LEFT JOIN s gs ON g.state = gs.state LEFT JOIN s ON lab.state = s.state, all_", "muni_te")
def _(spark, folder):
    return encoding.target_encode(labelled(spark, folder), F.col("split") == "train", F.col("label"), floor=3).select("id", "muni_te")


@query("standard_scale", SPLIT, "SELECT id, (composite - m) / d AS composite_z, year - y AS year_c FROM split, (SELECT avg(composite) AS m, stddev_pop(composite) AS d, avg(year) AS y FROM split WHERE split = 'train')", "composite_z year_c")
def _(spark, folder):
    out = encoding.scale(split_rows(analytic(spark, folder)), F.col("split") == "train", ["composite", "year"])
    mean = out.agg(F.avg(F.when(F.col("split") == "train", F.col("year"))).alias("_mean"))
    return out.crossJoin(F.broadcast(mean)).select("id", "composite_z", (F.col("year") - F.col("_mean")).alias("year_c"))


# --- joins and set operations


@query("anti_join_noncompleters", f"{ANA},\n{ana_sql((1, 2, 5), 'wide')}", "SELECT id, grp FROM wide WHERE id NOT IN (SELECT id FROM ana)")
def _(spark, folder):
    return analytic(spark, folder, (1, 2, 5)).join(analytic(spark, folder).select("id"), "id", "left_anti").select("id", "grp")


@query("left_lookup", SPLIT, "SELECT cand.id, cand.grp, coalesce(split.split, 'none') AS split, split.id IS NULL AS unmatched FROM cand LEFT JOIN split ON cand.id = split.id")
def _(spark, folder):
    out = candidates(spark, folder).join(split_rows(analytic(spark, folder)).select("id", "split"), "id", "left")
    return out.select("id", "grp", F.coalesce("split", F.lit("none")).alias("split"), F.col("split").isNull().alias("unmatched"))


@query("union_superset", LED, f"SELECT block, gap_pp, NULL::BIGINT AS level, 'main' AS source FROM ({metric_sql('dec', 'block')}) UNION ALL SELECT block, gap_pp, 0, 'frontier' FROM ({metric_sql('dec', 'block')})", "gap_pp")
def _(spark, folder):
    cells = metrics.group_metrics(decisions(analytic(spark, folder)), ["block"]).select("block", "gap_pp")
    main = cells.withColumn("source", F.lit("main"))
    return main.unionByName(cells.withColumn("source", F.lit("frontier")).withColumn("level", F.lit(0).cast("long")), allowMissingColumns=True)


@query("upsert_ledger", LED, "SELECT block, variant, count(*) AS n, count(*) FILTER (model_selected) AS n_model FROM (SELECT block, 'old' AS variant, bench_selected AS model_selected FROM dec WHERE block = 'B4' UNION ALL SELECT block, 'old', model_selected FROM dec WHERE block = 'B3') GROUP BY block, variant")
def _(spark, folder):
    led = decisions(analytic(spark, folder))
    blocks = {b: led.where(F.col("block") == b) for b in ("B3", "B4")}
    old = ledger(blocks["B3"], "t", "old", "B3", "det", K).unionByName(ledger(blocks["B4"], "t", "old", "B4", "det", K))
    new = ledger(blocks["B4"].withColumn("model_selected", F.col("bench_selected")), "t", "old", "B4", "det", K)
    return upsert(old, new).groupBy("block", "variant").agg(F.count(F.lit(1)).alias("n"), F.count_if("model_selected").alias("n_model"))


# --- metrics


@query("overlap_jaccard", LED, "SELECT block, count(*) FILTER (model_selected) AS n_selected, count(*) FILTER (model_selected AND bench_selected) / count(*) FILTER (bench_selected)::DOUBLE AS overlap_at_k, count(*) FILTER (model_selected AND bench_selected) / count(*) FILTER (model_selected OR bench_selected)::DOUBLE AS jaccard FROM dec GROUP BY block", "overlap_at_k jaccard")
def _(spark, folder):
    return metrics.agreement(decisions(analytic(spark, folder)), ["block"])


_STEP = "steps AS (SELECT block, score, count(*) FILTER (bench_selected) AS pos, count(*) FILTER (NOT bench_selected) AS neg FROM dec GROUP BY block, score)"


@query("average_precision", f"{LED},\n{_STEP}", "SELECT block, sum(pos / p::DOUBLE * (tp / a::DOUBLE)) AS pr_auc FROM (SELECT *, sum(pos) OVER (PARTITION BY block ORDER BY score DESC) AS tp, sum(pos + neg) OVER (PARTITION BY block ORDER BY score DESC) AS a, sum(pos) OVER (PARTITION BY block) AS p FROM steps) GROUP BY block", "pr_auc")
def _(spark, folder):
    return metrics.average_precision(decisions(analytic(spark, folder)).withColumnRenamed("bench_selected", "label"), ["block"])


@query("roc_auc", f"{LED},\n{_STEP}", "SELECT block, sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg))::DOUBLE AS roc_auc FROM (SELECT *, sum(neg) OVER (PARTITION BY block ORDER BY score) - neg AS below FROM steps) GROUP BY block", "roc_auc")
def _(spark, folder):
    return metrics.roc_auc(decisions(analytic(spark, folder)).withColumnRenamed("bench_selected", "label"), ["block"])


@query("confusion_by_group", LED, "SELECT *, fp / nullif(neg, 0)::DOUBLE AS fpr, fn / nullif(pos, 0)::DOUBLE AS fnr, 1 - fn / nullif(pos, 0)::DOUBLE AS tpr, q_g - p_g AS net_realloc FROM (SELECT block, grp, count(*) AS n, count(*) FILTER (model_selected AND NOT bench_selected) AS fp, count(*) FILTER (NOT model_selected AND bench_selected) AS fn, count(*) FILTER (bench_selected) AS pos, count(*) FILTER (NOT bench_selected) AS neg, avg(bench_selected::INT) AS p_g, avg(model_selected::INT) AS q_g FROM dec GROUP BY block, grp)", "p_g q_g fpr fnr tpr net_realloc")
def _(spark, folder):
    return metrics.confusion(decisions(analytic(spark, folder)), ["block"])


@query("group_metrics", LED, metric_sql("dec", "block"), METRIC14)
def _(spark, folder):
    return metrics.group_metrics(decisions(analytic(spark, folder)), ["block"])


@query("zero_sum", LED, "SELECT block, abs(sum(n * (q - p))) < 0.5 AS balanced, sum(n * (q - p)) AS zero_sum_value FROM (SELECT block, grp, count(*) AS n, avg(model_selected::INT) AS q, avg(bench_selected::INT) AS p FROM dec GROUP BY block, grp) GROUP BY block", "zero_sum_value")
def _(spark, folder):
    return metrics.zero_sum(decisions(analytic(spark, folder)), ["block"])


_VARIANTS = {"a_vs_first": Contrast(("EUROPE",), ("AFRICA",)), "a_vs_second": Contrast(("EUROPE",), ("AMERICA",)), "a_vs_all": Contrast(("EUROPE",), ("AFRICA", "AMERICA", "ASIA"))}


def _in(x: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in x) + ")"


_VAR_SQL = " UNION ALL ".join([f"SELECT '{n}' AS variant, * FROM ({metric_sql('dec', 'block', f'CASE WHEN grp IN {_in(v.a)} THEN {chr(39)}A{chr(39)} WHEN grp IN {_in(v.b)} THEN {chr(39)}B{chr(39)} END')})" for n, v in _VARIANTS.items()] + [f"SELECT 'sex' AS variant, * FROM ({metric_sql('dec', 'block', 'CASE sex WHEN ' + chr(39) + 'F' + chr(39) + ' THEN ' + chr(39) + 'A' + chr(39) + ' ELSE ' + chr(39) + 'B' + chr(39) + ' END')})"])


@query("group_variants", LED, _VAR_SQL, METRIC14)
def _(spark, folder):
    led = decisions(analytic(spark, folder))
    sides = [F.struct(F.lit(n).alias("variant"), F.when(F.col("grp").isin(*v.a), "A").when(F.col("grp").isin(*v.b), "B").alias("_s")) for n, v in _VARIANTS.items()]
    sides.append(F.struct(F.lit("sex").alias("variant"), F.when(F.col("sex") == "F", "A").otherwise("B").alias("_s")))
    long = led.select("*", F.inline(F.array(*sides)))
    return metrics.group_metrics(long, ["variant", "block"], side=F.col("_s")).select("variant", "block", *[x for x in metrics.group_metrics(led, ["block"]).columns if x != "block"])


_LOCAL = f"""{SPLIT},
both_ AS (SELECT * FROM {top_sql(top_sql('split', 'composite', K, 'split', 'bench_local'), 'composite', K, '', 'bench_global')}),
two AS (SELECT * FROM {top_sql(top_sql('both_', 'score_b4', K, 'split', 'model_local'), 'score_b4', K, '', 'model_global')}),
cells AS (SELECT 'local' AS definition, grp, model_local AS model_selected, bench_local AS bench_selected FROM two WHERE split = 'test' UNION ALL SELECT 'global', grp, model_global, bench_global FROM two WHERE split = 'test')"""


def _local_global(spark: SparkSession, folder: str) -> DataFrame:
    # a ranking reads its rows four times, so each starts from saved rows
    rows = split_rows(analytic(spark, folder))
    for score, role in (("composite", "bench"), ("score_b4", "model")):
        rows = selection.top_within(rows, score, K, ["split"], f"{role}_local")
        rows = selection.top_quota(rows, score, K, f"{role}_global")
    pairs = F.array(*[F.struct(F.lit(d).alias("definition"), F.col(f"model_{d}").alias("model_selected"), F.col(f"bench_{d}").alias("bench_selected")) for d in ("local", "global")])
    return rows.where("split = 'test'").select("id", "grp", F.inline(pairs))


@query("divergence_flag", _LOCAL, f"SELECT l.gap_pp AS local_gap_pp, g.gap_pp AS global_gap_pp, abs(l.gap_pp - g.gap_pp) > 1 AS diverges FROM (SELECT * FROM ({metric_sql('cells', 'definition', SIDE)}) WHERE definition = 'local') l, (SELECT * FROM ({metric_sql('cells', 'definition', SIDE)}) WHERE definition = 'global') g", "local_gap_pp global_gap_pp")
def _(spark, folder):
    m = metrics.group_metrics(_local_global(spark, folder), ["definition"])
    gap = {d: F.max(F.when(F.col("definition") == d, F.col("gap_pp"))) for d in ("local", "global")}
    return m.agg(gap["local"].alias("local_gap_pp"), gap["global"].alias("global_gap_pp")).withColumn("diverges", F.abs(F.col("local_gap_pp") - F.col("global_gap_pp")) > 1)


@query("block_delta", LED, f"SELECT b.gap_pp - a.gap_pp AS increment_pp, abs(b.gap_pp - a.gap_pp) > 1 AS material FROM ({metric_sql('dec', 'block')}) a, ({metric_sql('dec', 'block')}) b WHERE a.block = 'B3' AND b.block = 'B4'", "increment_pp")
def _(spark, folder):
    m = metrics.group_metrics(decisions(analytic(spark, folder)), ["block"])
    inc = F.max(F.when(F.col("block") == "B4", F.col("gap_pp"))) - F.max(F.when(F.col("block") == "B3", F.col("gap_pp")))
    return m.agg(inc.alias("increment_pp")).withColumn("material", F.abs("increment_pp") > 1)


_ANCHOR = f"{SPLIT},\ntest AS (SELECT *, CAST(concat('0x', substr(md5(concat('{STUDY.seed}:anchor:', id)), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496 AS u, {SIDE} AS side FROM split WHERE split = 'test'),\ncells AS (SELECT *, 'random' AS block FROM {top_sql(top_sql('test', 'composite', K, '', 'bench_selected'), 'u', K, '', 'model_selected')})"


# --- mitigation


@query("reweighing_weights", _LAB, "SELECT DISTINCT grp, label, count(*) OVER (PARTITION BY grp) * count(*) OVER (PARTITION BY label) / (count(*) OVER () * count(*) OVER (PARTITION BY grp, label))::DOUBLE AS weight FROM lab WHERE split = 'train'", "weight")
def _(spark, folder):
    return mitigation.reweighing(labelled(spark, folder).where("split = 'train'")).select("grp", "label", "weight").distinct()


_TPR = f"tpr AS (SELECT block, side, {rank_sql('score', 'block, side')} AS rk, score AS boundary, sum(bench_selected::INT) OVER (PARTITION BY block, side ORDER BY score DESC NULLS LAST, md5(concat('{STUDY.seed}:tie:', id)), id ROWS UNBOUNDED PRECEDING) AS hits, sum(bench_selected::INT) OVER (PARTITION BY block, side) AS pos FROM dec WHERE side IS NOT NULL),\ncum AS (SELECT block, side, rk, round(hits / nullif(pos, 0)::DOUBLE, 9) AS tpr, boundary FROM tpr)"


@query("cum_tpr", f"{LED},\n{_TPR}", "SELECT * FROM cum", "tpr boundary")
def _(spark, folder):
    return mitigation.cumulative_tpr(decisions(analytic(spark, folder)), ["block"])


# splits are searched on the validation rows, each part with the benchmark and the quota of its own
_VAL = f"""{_LAB.replace("'label'", "'bench_selected'").replace(' AS label', ' AS bench_selected')},
blocks AS ({c.BLOCKS_SQL.format(cols='id, grp, split, bench_selected', src='lab')}),
parts AS (SELECT *, {SIDE} AS side FROM {top_sql('blocks', 'score', K, 'block, split', 'model_selected')}),
dec AS (SELECT * FROM parts WHERE split = 'val')"""
_SEARCH = f"""{_VAL},
{_TPR},
every AS (SELECT block, side, rk, tpr, CASE WHEN rk = max(rk) OVER (PARTITION BY block, side) THEN '-inf'::DOUBLE ELSE boundary END AS boundary FROM cum
  UNION ALL SELECT DISTINCT block, side, 0, 0.0::DOUBLE, 'inf'::DOUBLE FROM dec WHERE side IS NOT NULL),
caps AS (SELECT block, count(*) FILTER (model_selected AND side IS NOT NULL) AS seats FROM dec GROUP BY block),
opts AS (
  SELECT a.block, caps.seats, a.rk AS n_a, b.rk AS n_b, a.tpr AS tpr_a, b.tpr AS tpr_b, a.boundary AS tau_a, b.boundary AS tau_b
  FROM every a JOIN caps ON a.block = caps.block JOIN every b ON a.block = b.block AND b.rk = caps.seats - a.rk WHERE a.side = 'A' AND b.side = 'B' AND a.tpr IS NOT NULL AND b.tpr IS NOT NULL),
base AS (
  SELECT block, avg(model_selected::INT) FILTER (side = 'A' AND bench_selected) - avg(model_selected::INT) FILTER (side = 'B' AND bench_selected) AS gap0,
    count(*) FILTER (side = 'A' AND model_selected) AS n_a0, count(*) FILTER (side = 'B' AND model_selected) AS n_b0,
    round(avg(model_selected::INT) FILTER (side = 'A' AND bench_selected), 9) AS tpr_a0, round(avg(model_selected::INT) FILTER (side = 'B' AND bench_selected), 9) AS tpr_b0
  FROM dec GROUP BY block),
levels AS (SELECT block, level, round(gap0 * (1 - level / 10.0::DOUBLE), 9) AS target FROM base, (SELECT unnest(range(0, 11)) AS level)),
best AS (SELECT * FROM (
  SELECT o.*, l.level, l.target, row_number() OVER (PARTITION BY o.block, l.level ORDER BY round(abs(tpr_a - tpr_b - target), 9), n_a) AS pick
  FROM opts o JOIN levels l ON o.block = l.block) WHERE pick = 1)"""


def validated(spark: SparkSession, folder: str) -> DataFrame:
    """Both deterministic scores against the benchmark within each split."""
    rows = c.by_block(labelled(spark, folder).withColumnRenamed("label", "bench_selected"))
    return selection.top_within(rows, "score", K, ["block", "split"], "model_selected").withColumn("side", side())


def searched(led: DataFrame, by: list[str], levels: DataFrame) -> DataFrame:
    """The found splits of ``led``'s own seats: those that its other rows leave."""
    caps = led.groupBy(*by).agg(F.count_if(F.col("model_selected") & F.col("side").isNotNull()).alias("_seats"))  # a row a cell
    return mitigation.search_split(led.join(F.broadcast(caps), by), by, F.col("_seats"), levels)


def side_sizes(led: DataFrame, by: list[str]) -> DataFrame:
    held = F.col("side").isNotNull()
    return led.groupBy(*by).agg(F.count_if(F.col("side") == "A").alias("size_a"), F.count_if(F.col("side") == "B").alias("size_b"), F.count_if(F.col("model_selected") & held).alias("seats"))


_PICKED = "level, target, seats, n_a, n_b, tpr_a, tpr_b, tau_a, tau_b"


@query("threshold_search", _SEARCH, f"SELECT block, {_PICKED} FROM best WHERE level = 10", "target tpr_a tpr_b tau_a tau_b")
def _(spark, folder):
    led = validated(spark, folder).where("split = 'val'")
    return searched(led, ["block"], mitigation.target_gaps(led, ["block"]).where("level = 10").drop("gap0"))


_SWEEP = """SELECT block, level, target, n_a, n_b, tpr_a, tpr_b, coalesce(1 - target / nullif(gap0, 0), 1) AS strength FROM best JOIN base USING (block) WHERE level > 0
UNION ALL SELECT block, level, target, n_a0, n_b0, tpr_a0, tpr_b0, coalesce(1 - target / nullif(gap0, 0), 1) FROM levels JOIN base USING (block) WHERE level = 0"""


def sweep(led: DataFrame, by: list[str]) -> DataFrame:
    """``level, target, n_a, n_b, tpr_a, tpr_b, strength``: level 0 as the decisions are, the others as found."""
    levels = mitigation.target_gaps(led, by)
    found = searched(led, by, levels.where("level > 0").drop("gap0")).select(*by, "level", "n_a", "n_b", "tpr_a", "tpr_b")
    start = mitigation.unmitigated(led, by).select(*by, F.lit(0).alias("level"), "n_a", "n_b", "tpr_a", "tpr_b")
    strength = F.round(F.coalesce(1 - F.try_divide("target", "gap0"), F.lit(1.0)), 6)
    return levels.join(found.unionByName(start), [*by, "level"]).select(*by, "level", "target", "n_a", "n_b", "tpr_a", "tpr_b", strength.alias("strength"))


@query("frontier", _SEARCH, _SWEEP, "target tpr_a tpr_b strength")
def _(spark, folder):
    return sweep(validated(spark, folder).where("split = 'val'"), ["block"])


_MOVED = """SELECT block, seats_test, least(ta, seats_test - n_b_test) AS n_a_test, n_b_test FROM (SELECT *, greatest(0, least(seats_test - a0, tb)) AS n_b_test FROM (
  SELECT b.block, ta, tb, seats_test, CAST(greatest(0, least(round_even(n_a / va::DOUBLE * ta, 0), ta, seats_test)) AS BIGINT) AS a0
  FROM best b JOIN (SELECT block, count(*) FILTER (side = 'A') AS va FROM dec GROUP BY block) USING (block)
  JOIN (SELECT block, count(*) FILTER (side = 'A') AS ta, count(*) FILTER (side = 'B') AS tb, count(*) FILTER (model_selected AND side IS NOT NULL) AS seats_test FROM parts WHERE split = 'test' GROUP BY block) USING (block)
  WHERE level = 10))"""


@query("threshold_transfer", _SEARCH, _MOVED)
def _(spark, folder):
    both = validated(spark, folder)
    val, test = (both.where(F.col("split") == p) for p in ("val", "test"))
    found = searched(val, ["block"], mitigation.target_gaps(val, ["block"]).where("level = 10").drop("gap0"))
    return mitigation.transfer(found, side_sizes(val, ["block"]), side_sizes(test, ["block"]), ["block"]).select("block", "seats_test", "n_a_test", "n_b_test")


_NEAR = f"""SELECT d.block, d.overlap_at_k, d.gap_pp, d.overlap_at_k - a.overlap_at_k AS overlap_above_anchor, d.gap_pp - a.gap_pp AS gap_above_anchor, d.overlap_at_k - a.overlap_at_k < 0.05 AS near_anchor
FROM (SELECT block, overlap_at_k, gap_pp FROM ({metric_sql('dec', 'block')}) JOIN ({{overlap}} dec GROUP BY block) USING (block)) d,
  (SELECT overlap_at_k, gap_pp FROM ({metric_sql('cells', 'block')}) JOIN ({{overlap}} cells GROUP BY block) USING (block)) a"""
_OVERLAP = "SELECT block, count(*) FILTER (model_selected AND bench_selected) / count(*) FILTER (bench_selected)::DOUBLE AS overlap_at_k FROM"


def anchor_distance(cells: DataFrame, anchor: DataFrame) -> DataFrame:
    """``cells`` with the distances of overlap and gap from those of a random selection (one row)."""
    one = anchor.select(F.col("overlap_at_k").alias("_o"), F.col("gap_pp").alias("_g"))
    out = cells.crossJoin(F.broadcast(one)).withColumn("overlap_above_anchor", F.col("overlap_at_k") - F.col("_o")).withColumn("gap_above_anchor", F.col("gap_pp") - F.col("_g"))
    return out.withColumn("near_anchor", F.col("overlap_above_anchor") < 0.05).drop("_o", "_g")


def random_cell(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions by uniform scores over the test rows."""
    rows = split_rows(analytic(spark, folder)).where("split = 'test'").withColumn("u", hash_uniform("anchor", F.col("id").cast("string"))).withColumn("block", F.lit("random"))
    return selection.top_quota(selection.top_quota(rows, "composite", K, "bench_selected"), "u", K, "model_selected")


@query("random_anchor", _ANCHOR, f"SELECT m.*, o.overlap_at_k FROM ({metric_sql('cells', 'block')}) m, (SELECT count(*) FILTER (model_selected AND bench_selected) / count(*) FILTER (bench_selected)::DOUBLE AS overlap_at_k FROM cells) o", METRIC14 + " overlap_at_k")
def _(spark, folder):
    led = random_cell(spark, folder)
    return metrics.group_metrics(led, ["block"]).join(metrics.agreement(led, ["block"]).select("block", "overlap_at_k"), "block")


@query("anchor_distance", f"{_ANCHOR},\n{DEC}", _NEAR.format(overlap=_OVERLAP), "overlap_at_k gap_pp overlap_above_anchor gap_above_anchor")
def _(spark, folder):
    def measured(led: DataFrame) -> DataFrame:
        return metrics.agreement(led, ["block"]).join(metrics.group_metrics(led, ["block"]), "block").select("block", "overlap_at_k", "gap_pp")

    return anchor_distance(measured(decisions(analytic(spark, folder))), measured(random_cell(spark, folder)))


# --- strata and inference

_BANDS = "bands AS (SELECT band, n, sum(n) OVER (ORDER BY band) / (sum(n) OVER ())::DOUBLE AS cum FROM (SELECT band, count(*) AS n FROM ana GROUP BY band)),\ncuts AS (SELECT arg_min(band, (round(abs(cum - 1 / 3.0::DOUBLE), 9), band)) AS lo, arg_min(band, (round(abs(cum - 2 / 3.0::DOUBLE), 9), band)) AS hi FROM bands)"


def terciles(df: DataFrame) -> DataFrame:
    """Cuts of the ordered bands nearest to the thirds of the population, as a one-row table."""
    sizes = df.groupBy("band").agg(F.count(F.lit(1)).alias("n"))  # one row a band
    cum = sizes.withColumn("cum", F.sum("n").over(Window.orderBy("band")) / F.sum("n").over(Window.partitionBy()))
    return cum.agg(*[F.min_by("band", F.struct(F.round(F.abs(F.col("cum") - t / 3), 9), F.col("band"))).alias(n) for n, t in (("lo", 1), ("hi", 2))])


def with_tercile(df: DataFrame, cuts: DataFrame) -> DataFrame:
    out = df.crossJoin(F.broadcast(cuts))
    return out.withColumn("tercile", F.when(F.col("band") <= F.col("lo"), "low").when(F.col("band") <= F.col("hi"), "mid").otherwise("high")).drop("lo", "hi")


_TER = "CASE WHEN band <= lo THEN 'low' WHEN band <= hi THEN 'mid' ELSE 'high' END AS tercile"


@query("income_terciles", f"{ANA},\n{_BANDS}", f"SELECT tercile, count(*) AS n, min(band) AS first_band, max(band) AS last_band FROM (SELECT band, {_TER} FROM ana, cuts) GROUP BY tercile")
def _(spark, folder):
    rows = analytic(spark, folder)
    return with_tercile(rows, terciles(rows)).groupBy("tercile").agg(F.count(F.lit(1)).alias("n"), F.min("band").alias("first_band"), F.max("band").alias("last_band"))


# the benchmark is that of the whole population, the cuts too; selections are those within the test rows
_STRATA = f"""{SPLIT},
{_BANDS},
ranked AS {top_sql('split', 'composite', K, out='bench_selected')},
tests AS (SELECT * FROM ranked WHERE split = 'test'),
blocks AS ({c.BLOCKS_SQL.format(cols='id, grp, band, bench_selected', src='tests')}),
dec AS (SELECT *, {SIDE} AS side FROM {top_sql('blocks', 'score', K, 'block', 'model_selected')}),
str AS (SELECT dec.*, {_TER} FROM dec, cuts)"""
_INCREMENT = f"""SELECT a.tercile, a.gap_pp AS b3_gap_pp, b.gap_pp AS b4_gap_pp, b.gap_pp - a.gap_pp AS increment_pp, a.n_bench_positive_a < 30 OR a.n_bench_positive_b < 30 AS low_events
FROM ({metric_sql('str', 'block, tercile')}) a JOIN ({metric_sql('str', 'block, tercile')}) b ON a.tercile = b.tercile AND a.block = 'B3' AND b.block = 'B4'"""


def tercile_increments(m: DataFrame, by: list[str]) -> DataFrame:
    """The gaps of both blocks by tercile, from ``group_metrics`` by tercile and block."""

    def at(block: str, col: str) -> F.Column:
        return F.max(F.when(F.col("block") == block, F.col(col)))

    few = (at("B3", "n_bench_positive_a") < STUDY.min_events) | (at("B3", "n_bench_positive_b") < STUDY.min_events)
    return m.groupBy(*by).agg(at("B3", "gap_pp").alias("b3_gap_pp"), at("B4", "gap_pp").alias("b4_gap_pp"), (at("B4", "gap_pp") - at("B3", "gap_pp")).alias("increment_pp"), few.alias("low_events"))


@query("income_increment", _STRATA, _INCREMENT, "b3_gap_pp b4_gap_pp increment_pp")
def _(spark, folder):
    rows = split_rows(analytic(spark, folder))
    bench = selection.top_quota(rows, "composite", K, "bench_selected").where("split = 'test'")
    led = selection.top_within(c.by_block(bench), "score", K, ["block"], "model_selected").withColumn("side", side())
    return tercile_increments(metrics.group_metrics(with_tercile(led, terciles(rows)), ["tercile", "block"]), ["tercile"])


_REGION = "CASE WHEN {0} > 1 THEN 'amplification' WHEN {0} < -1 THEN 'attenuation' WHEN {0} IS NOT NULL THEN 'practical_reproduction' END"
_BOOT = f"""{LED},
rows_ AS (SELECT *, row_number() OVER (PARTITION BY block, side ORDER BY id) AS i, count(*) OVER (PARTITION BY block, side) AS n FROM dec WHERE side IS NOT NULL),
draws AS (SELECT block, side, b, 1 + floor(CAST(concat('0x', substr(md5(concat('{STUDY.seed}:boot:', side, ':', b, ':', i)), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496 * n) AS i FROM rows_, (SELECT unnest(range(1, 21)) AS b)),
reps AS (SELECT d.block, b, round((100 * avg(model_selected::INT) FILTER (d.side = 'A') - 100 * avg(model_selected::INT) FILTER (d.side = 'B')) - (100 * avg(bench_selected::INT) FILTER (d.side = 'A') - 100 * avg(bench_selected::INT) FILTER (d.side = 'B')), 9) AS d FROM draws d JOIN rows_ r ON d.block = r.block AND d.side = r.side AND d.i = r.i GROUP BY d.block, b),
boot AS (SELECT block, round(quantile_cont(d, 0.025), 6) AS d_lo, round(quantile_cont(d, 0.975), 6) AS d_hi, count(*) AS n_boot FROM reps GROUP BY block)"""


@query("bootstrap_hash", _BOOT, "SELECT * FROM boot", "d_lo d_hi")
def _(spark, folder):
    return inference.bootstrap_by_hash(decisions(analytic(spark, folder)), ["block"], 20)


@query("verdicts", _BOOT, f"SELECT b.block, m.d_pp, d_lo, d_hi, CASE WHEN {_REGION.format('d_lo')} = {_REGION.format('d_hi')} THEN {_REGION.format('m.d_pp')} ELSE 'inconclusive' END AS verdict, sign(gap_pp) <> sign(bench_gap_pp) AND bench_gap_pp <> 0 AS reversal FROM boot b JOIN ({metric_sql('dec', 'block')}) m USING (block)", "d_pp d_lo d_hi")
def _(spark, folder):
    led = decisions(analytic(spark, folder))
    out = inference.bootstrap_by_hash(led, ["block"], 20).join(metrics.group_metrics(led, ["block"]), "block")
    reversal = (F.signum("gap_pp") != F.signum("bench_gap_pp")) & (F.col("bench_gap_pp") != 0)
    return out.select("block", "d_pp", "d_lo", "d_hi", verdict(F.col("d_pp"), F.col("d_lo"), F.col("d_hi")).alias("verdict"), reversal.alias("reversal"))


@query("interval_overlap", _BOOT, "SELECT a.block AS block_a, b.block AS block_b, NOT (a.d_hi < b.d_lo OR b.d_hi < a.d_lo) AS overlaps FROM boot a JOIN boot b ON a.block < b.block")
def _(spark, folder):
    boot = inference.bootstrap_by_hash(decisions(analytic(spark, folder)), ["block"], 20)
    a, b = (boot.select(F.col("block").alias(f"block_{s}"), F.col("d_lo").alias(f"lo_{s}"), F.col("d_hi").alias(f"hi_{s}")) for s in "ab")
    both = a.join(b, F.col("block_a") < F.col("block_b"))  # one row a cell
    return both.select("block_a", "block_b", (~((F.col("hi_a") < F.col("lo_b")) | (F.col("hi_b") < F.col("lo_a")))).alias("overlaps"))


@query("tie_diagnostic", LED, "SELECT block, count(*) AS n, count(DISTINCT score) AS n_distinct, max(m) AS largest_group FROM (SELECT *, count(*) OVER (PARTITION BY block, score) AS m FROM dec) GROUP BY block")
def _(spark, folder):
    sizes = decisions(analytic(spark, folder)).groupBy("block", "score").agg(F.count(F.lit(1)).alias("m"))
    return sizes.groupBy("block").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.max("m").alias("largest_group"))


@query("robust_population", f"{CAND},\n{ana_sql()},\npop AS (SELECT *, {SIDE} AS side FROM ana WHERE {SIDE} IS NOT NULL),\nr AS {top_sql('pop', 'composite', K, '', 'bench_selected')},\ndec AS (SELECT *, 'B3' AS block FROM {top_sql('r', 'score_b3', K, '', 'model_selected')})", metric_sql("dec", "block"), METRIC14)
def _(spark, folder):
    pop = analytic(spark, folder).withColumn("side", side()).where("side IS NOT NULL").withColumn("block", F.lit("B3"))
    return metrics.group_metrics(selection.top_quota(selection.top_quota(pop, "composite", K, "bench_selected"), "score_b3", K, "model_selected"), ["block"])


@query("first_per_group", _LAB, "SELECT grp, label, arg_min(w, id) AS weight, min(id) AS first_id FROM (SELECT id, grp, label, count(*) OVER (PARTITION BY grp) * count(*) OVER (PARTITION BY label) / (count(*) OVER () * count(*) OVER (PARTITION BY grp, label))::DOUBLE AS w FROM lab WHERE split = 'train') GROUP BY grp, label", "weight")
def _(spark, folder):
    weighted = mitigation.reweighing(labelled(spark, folder).where("split = 'train'"))
    return weighted.groupBy("grp", "label").agg(F.min_by("weight", "id").alias("weight"), F.min("id").alias("first_id"))


@query("feature_vector_ties", SPLIT, "SELECT split, count(*) AS n, count(DISTINCT (state, marital, status, band, letter, year)) AS n_vectors FROM split GROUP BY split")
def _(spark, folder):
    rows = split_rows(analytic(spark, folder))
    vectors = rows.groupBy("split", "state", "marital", "status", "band", "letter", "year").agg(F.count(F.lit(1)).alias("n"))
    return vectors.groupBy("split").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_vectors"))


@query("capacity_labels", CAND, "SELECT DISTINCT k, concat('K', lpad(CAST(CAST(floor(k * 100 + 1e-9) AS INT) AS VARCHAR), 2, '0')) AS label FROM cand, (SELECT unnest([0.05, 0.1, 0.2])::DOUBLE AS k)", "k")
def _(spark, folder):
    ks = F.explode(F.array(*[F.lit(k) for k in (0.05, 0.1, 0.2)])).alias("k")
    return candidates(spark, folder).select(ks).distinct().select("k", capacity_label(F.col("k")).alias("label"))


@query("cell_filter", LED, "SELECT block, grp, count(*) AS n FROM dec WHERE (block = 'B3' AND grp IN ('EUROPE', 'ASIA')) OR block = 'B4' GROUP BY block, grp")
def _(spark, folder):
    wanted = any_cell({"B3": ("EUROPE", "ASIA"), "B4": None}, "block", "grp")
    return decisions(analytic(spark, folder)).where(wanted).groupBy("block", "grp").agg(F.count(F.lit(1)).alias("n"))


@query("score_spread", LED, "SELECT block, min(score) AS least, quantile_cont(score, 0.5) AS median, max(score) AS most FROM dec GROUP BY block", "least median most")
def _(spark, folder):
    led = decisions(analytic(spark, folder))
    return led.groupBy("block").agg(F.min("score").alias("least"), F.percentile("score", F.lit(0.5)).alias("median"), F.max("score").alias("most"))


# --- composition of the benchmark, and controls


_PARTS = {
    "counts": "n_selected",
    "shares": "100 * n_selected / nullif(n_all, 0)::DOUBLE AS selected_share_pct, 100 * n / pool::DOUBLE AS eligible_pool_share_pct",
}
_BY_GROUP = """SELECT *, sum(n) FILTER (grp <> 'Total') OVER () AS pool, sum(n_selected) FILTER (grp <> 'Total') OVER () AS n_all
  FROM (SELECT coalesce(grp, 'Total') AS grp, count(*) AS n, count(*) FILTER (selected) AS n_selected FROM {} GROUP BY GROUPING SETS ((grp), ()))"""


_TIES_OF_COMPOSITE = _TIES.replace("(q ", "(composite ").replace("FILTER (q", "FILTER (composite").replace("min(q)", "min(composite)")


def _composition_sql() -> str:
    parts = []
    for k in (0.05, 0.1, 0.2):
        chosen = top_sql("ana", "composite", k)
        parts += [f"SELECT '{name}' AS section, {k}::DOUBLE AS k, grp, {cols} FROM ({_BY_GROUP.format(chosen)})" for name, cols in _PARTS.items()]
        parts.append(f"SELECT 'cutoff' AS section, {k}::DOUBLE AS k, k AS k_target, boundary AS cutoff, n_above, n_tied, n_drawn, n_above + n_drawn = k AS check_sums FROM ({_TIES_OF_COMPOSITE.format(chosen)})")
    return " UNION ALL BY NAME ".join(parts)


@query("benchmark_composition", ANA, _composition_sql(), "k selected_share_pct eligible_pool_share_pct cutoff")
def benchmark_composition(spark, folder):
    """Counts and shares of groups, with totals, and the cutoff at three capacities: 39 rows on five groups."""
    rows, parts = c.cut(analytic(spark, folder)), []
    for k in (0.05, 0.10, 0.20):
        cells = selection.top_quota(rows, "composite", k).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if("selected").alias("n_selected"))  # a row a group
        total = cells.agg(F.sum("n").alias("n"), F.sum("n_selected").alias("n_selected")).withColumn("grp", F.lit("Total"))
        sums = total.select(F.col("n").alias("_n"), F.col("n_selected").alias("_s"))
        both = cells.unionByName(total).crossJoin(F.broadcast(sums)).withColumn("k", F.lit(k))
        parts.append(both.select(F.lit("counts").alias("section"), "k", "grp", "n_selected"))
        shares = [(100 * F.try_divide("n_selected", "_s")).alias("selected_share_pct"), (100 * F.col("n") / F.col("_n")).alias("eligible_pool_share_pct")]
        parts.append(both.select(F.lit("shares").alias("section"), "k", "grp", *shares))
        info = selection.tie_info(rows, "composite", k).withColumn("check_sums", F.col("n_above") + F.col("n_drawn") == F.col("k"))
        parts.append(info.select(F.lit("cutoff").alias("section"), F.lit(k).alias("k"), F.col("k").alias("k_target"), F.col("boundary").alias("cutoff"), "n_above", "n_tied", "n_drawn", "check_sums"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


_UNIFORM = f"""{SPLIT},
control AS (
  SELECT *, CAST(concat('0x', substr(md5(concat('{STUDY.seed}:control:', block, ':', id)), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496 AS u
  FROM (SELECT id, composite, concat('r', i) AS block FROM split, (SELECT unnest(range(1, 21)) AS i) WHERE split = 'test')),
cells AS {top_sql(top_sql('control', 'composite', K, 'block', 'bench_selected'), 'u', K, 'block', 'model_selected')}"""


@query("bootstrap_uniform", _UNIFORM, """SELECT block, count(*) FILTER (model_selected) AS n_selected,
  count(*) FILTER (model_selected AND bench_selected) / count(*) FILTER (bench_selected)::DOUBLE AS overlap_at_k,
  count(*) FILTER (model_selected AND bench_selected) / count(*) FILTER (model_selected OR bench_selected)::DOUBLE AS jaccard FROM cells GROUP BY block""", "overlap_at_k jaccard")  # fmt: skip
def bootstrap_uniform(spark, folder):
    """Random scores in each of twenty seeds: the negative control of the whole chain."""
    seeds = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("r"), i.cast("string")))
    rows = split_rows(analytic(spark, folder)).where("split = 'test'").select("id", "composite", F.explode(seeds).alias("block"))
    rows = rows.withColumn("score", hash_uniform("control", F.concat_ws(":", F.col("block"), F.col("id").cast("string"))))
    bench = selection.top_within(rows, "composite", K, ["block"], "bench_selected")
    return metrics.agreement(selection.top_within(bench, "score", K, ["block"], "model_selected"), ["block"])


@query("cascade_population", ANA, "SELECT grp, count(*) AS n FROM ana GROUP BY grp")
def cascade_population(spark, folder):
    """The restricted population, halted if its counts are not those of its steps one by one."""
    rows = c.cut(candidates(spark, folder))
    now, expected = rows, [rows.count()]
    for _, step in cascade.steps():
        now = now.where(step)
        expected.append(now.count())
    return cascade.apply_cascade(cascade.assert_counts(rows, expected)).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
