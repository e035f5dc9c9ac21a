"""The bundled tables in the roles of a study: one row a candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import STUDY
from ..operators.cascade import apply_cascade
from ..operators.composite import raw_equal
from ..operators.selection import top_quota, top_within
from ..operators.splitting import quantile_bins, stratified_split
from ..sources.tables import cut, read_parquet

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _school(key: Column, balance: Column) -> list[Column]:
    """Kind of school of those of status 2, and for three quarters of them the register's owner and place."""
    leaving = (balance >= -900) & (balance < 2000)
    known = leaving & (key % 4 != 0)
    return [F.when(leaving, 2 + key % 3 % 2).otherwise(1).cast("int").alias("school"), F.when(known, key % 4).cast("int").alias("owner"), F.when(known, 1 + key % 5 % 2).cast("int").alias("place")]


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Scores are sums of a customer's orders by priority; groups are regions, states are nations."""
    price = F.col("o_totalprice")
    orders = read_parquet(spark, folder, "orders").groupBy("o_custkey").agg(
        *[F.round(F.sum(F.when(F.col("o_orderpriority") == p, price)), 2).alias(f"s{i}") for i, p in enumerate(PRIORITIES, 1)], F.count(F.lit(1)).alias("n_orders")
    )
    nation = read_parquet(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    region = read_parquet(spark, folder, "region").select("r_regionkey", "r_name")
    rows = read_parquet(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    rows = rows.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    grp = F.when(key % 50 == 0, STUDY.undeclared).otherwise(F.col("r_name"))
    segment = F.array_position(F.array(*[F.lit(s) for s in SEGMENTS]), F.col("c_mktsegment")) - 1
    b3 = F.round(balance / 1000 + 0.5 * F.coalesce("n_orders", F.lit(0)), 6)
    band = F.least(F.lit(16), F.floor((balance + 1000) / 647.06)).cast("int")
    return rows.select(
        key.alias("id"), *[f"s{i}" for i in range(1, 6)], *[F.col(f"s{i}").isNotNull().cast("int").alias(f"p{i}") for i in range(1, 5)], grp.alias("grp"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("sex"), F.when(key % 8 == 3, 1).otherwise(0).alias("practice"),
        F.when(balance < -900, 3).when(balance < 2000, 2).otherwise(1).alias("status"), F.col("c_nationkey").cast("int").alias("state"),
        (F.col("c_nationkey") * 10 + segment).cast("int").alias("muni"), F.col("c_mktsegment").alias("marital"), *_school(key, balance), F.char(band + 65).alias("band"),
        F.substring(F.lit("ABCDEFGH"), (key % 8 + 1).cast("int"), F.lit(1)).alias("letter"), (key % 7).cast("int").alias("year"),
        b3.alias("score_b3"), (b3 + F.when(grp.isin(*STUDY.contrast.a), 1.0).otherwise(0.0)).alias("score_b4"),
    )


def analytic(spark: SparkSession, folder: str, which: tuple[int, ...] = (1, 2, 3, 4, 5)) -> DataFrame:
    return apply_cascade(candidates(spark, folder), which).withColumn("composite", raw_equal())


def side() -> Column:
    c = STUDY.contrast
    return F.when(F.col("grp").isin(*c.a), "A").when(F.col("grp").isin(*c.b), "B")


def split_rows(df: DataFrame) -> DataFrame:
    """``df``, saved first, as quantiles and draws read it, with ``decile`` and ``split``, saved too."""
    return cut(stratified_split(quantile_bins(cut(df), "composite", 10, "decile"), F.concat_ws("_", F.col("grp"), F.col("decile").cast("string"))))


def decisions(df: DataFrame, capacity: float = STUDY.capacity) -> DataFrame:
    """Both deterministic scores against the benchmark over all of ``df``: two rows a candidate."""
    bench = top_quota(df, "composite", capacity, "bench_selected")
    return top_within(by_block(bench), "score", capacity, ["block"], "model_selected").withColumn("side", side())


def by_block(df: DataFrame) -> DataFrame:
    blocks = F.array(*[F.struct(F.lit(b).alias("block"), F.col(c).alias("score")) for b, c in (("B3", "score_b3"), ("B4", "score_b4"))])
    return df.select(*[c for c in df.columns if not c.startswith("score_b")], F.inline(blocks))


_S = [f"s{i}" for i in range(1, 6)]
#: SQL of the same views.
CAND = f"""o AS (
  SELECT o_custkey, {', '.join(f"round(sum(CASE WHEN o_orderpriority = '{p}' THEN o_totalprice END), 2) AS s{i}" for i, p in enumerate(PRIORITIES, 1))}, count(*) AS n_orders
  FROM orders GROUP BY o_custkey),
cand0 AS (
  SELECT c_custkey AS id, {', '.join(_S)}, {', '.join(f"CAST(s{i} IS NOT NULL AS INT) AS p{i}" for i in range(1, 5))},
    CASE WHEN c_custkey % 50 = 0 THEN 'NOT_DECLARED' ELSE r_name END AS grp, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
    CASE WHEN c_custkey % 8 = 3 THEN 1 ELSE 0 END AS practice, CASE WHEN c_acctbal < -900 THEN 3 WHEN c_acctbal < 2000 THEN 2 ELSE 1 END AS status,
    c_nationkey AS state, c_nationkey * 10 + list_position([{', '.join(f"'{s}'" for s in SEGMENTS)}], c_mktsegment) - 1 AS muni, c_mktsegment AS marital,
    chr(CAST(65 + least(16, floor((c_acctbal + 1000) / 647.06::DOUBLE)) AS INT)) AS band, substr('ABCDEFGH', CAST(1 + c_custkey % 8 AS INT), 1) AS letter, c_custkey % 7 AS year,
    round(c_acctbal / 1000 + 0.5::DOUBLE * coalesce(n_orders, 0), 6) AS score_b3
  FROM customer LEFT JOIN o ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cand AS (SELECT *, score_b3 + CASE WHEN grp = 'EUROPE' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score_b4 FROM cand0)"""
STEPS = ("practice = 0", "status IN (1, 2)", "p1 = 1 AND p2 = 1 AND p3 = 1 AND p4 = 1", " AND ".join(f"{s} IS NOT NULL" for s in _S), "grp IS DISTINCT FROM 'NOT_DECLARED'")


def ana_sql(which: tuple[int, ...] = (1, 2, 3, 4, 5), name: str = "ana") -> str:
    return f"{name} AS (SELECT *, round((s1 + s2 + s3 + s4 + s5) / 5, 6) AS composite FROM cand WHERE {' AND '.join(STEPS[i - 1] for i in which)})"


SIDE = "CASE WHEN grp = 'EUROPE' THEN 'A' WHEN grp IN ('AFRICA', 'AMERICA') THEN 'B' END"


def rank_sql(score: str, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({part}ORDER BY {score} DESC NULLS LAST, md5(concat('{STUDY.seed}:tie:', id)), id)"


def top_sql(source: str, score: str, k: float, by: str = "", out: str = "selected") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"(SELECT *, {rank_sql(score, by)} <= floor({k}::DOUBLE * count(*) OVER ({part})) AS {out} FROM {source})"


BLOCKS_SQL = "SELECT {cols}, 'B3' AS block, score_b3 AS score FROM {src} UNION ALL SELECT {cols}, 'B4' AS block, score_b4 AS score FROM {src}"
DEC = f"""ranked AS {top_sql('ana', 'composite', STUDY.capacity, out='bench_selected')},
blocks AS ({BLOCKS_SQL.format(cols='id, grp, sex, state, muni, band, composite, bench_selected', src='ranked')}),
dec AS (SELECT *, {SIDE} AS side FROM {top_sql('blocks', 'score', STUDY.capacity, 'block', 'model_selected')})"""


def part_sql(source: str, stratum: str, share: float, tag: str, out: str) -> str:
    """A stratified share by largest remainders."""
    return f"""(SELECT r.* EXCLUDE (rkx), rkx <= take AS {out} FROM (
    SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY md5(concat('{STUDY.seed}:{tag}:', id)), id) AS rkx FROM {source}) r
  JOIN (SELECT st, whole + CAST(row_number() OVER (ORDER BY round(exact - whole, 9) DESC, st) <= ceil({share}::DOUBLE * n) - sum(whole) OVER () AS INT) AS take FROM (
    SELECT st, n, ceil({share}::DOUBLE * n) * m / n AS exact, floor(ceil({share}::DOUBLE * n) * m / n) AS whole FROM (
      SELECT {stratum} AS st, count(*)::DOUBLE AS m, sum(count(*)) OVER ()::DOUBLE AS n FROM {source} GROUP BY 1))) q ON r.{stratum} = q.st)"""


def split_sql(source: str, name: str = "split") -> str:
    edges = "list_distinct(list_transform(quantile_cont(composite, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]), lambda e: round(e, 6)))"
    return f"""{name}_d AS (SELECT s.*, len([e for e in edges if s.composite > e]) AS decile FROM {source} s, (SELECT {edges} AS edges FROM {source})),
{name}_s AS (SELECT *, concat(grp, '_', decile) AS stratum FROM {name}_d),
{name}_1 AS {part_sql(name + '_s', 'stratum', 0.4, 'temp', 'in_temp')},
{name}_t AS (SELECT * EXCLUDE (in_temp) FROM {name}_1 WHERE in_temp),
{name}_2 AS {part_sql(name + '_t', 'stratum', 0.5, 'test', 'in_test')},
{name} AS (
  SELECT * EXCLUDE (in_temp, stratum), 'train' AS split FROM {name}_1 WHERE NOT in_temp
  UNION ALL SELECT * EXCLUDE (in_test, stratum), CASE WHEN in_test THEN 'test' ELSE 'val' END AS split FROM {name}_2)"""
