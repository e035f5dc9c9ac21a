"""Feature encoders: fitted on the training rows, applied to all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import STUDY, BlockSpec
from ..functions.columns import letter_ordinal
from .selection import exact_quantiles

#: Levels of a name that become columns, at most.
LEVELS = 4096
NOMINAL = ["state", "marital", "status"]


def one_hot(df: DataFrame, train: DataFrame, col: str) -> DataFrame:
    """``id`` and a 0/1 column for each level of the training rows, in order; others have zeros only."""
    levels = [r[0] for r in train.select(F.col(col).cast("string")).where(F.col(col).isNotNull()).distinct().limit(LEVELS + 1).collect()]
    if len(levels) > LEVELS:
        raise ValueError(f"{col} has more than {LEVELS} levels")
    return df.select("id", *[F.coalesce(F.col(col).cast("string") == v, F.lit(False)).cast("int").alias(f"{col}_{v}") for v in sorted(levels)])


def sentinel_fill(df: DataFrame, train: Column, value: Column, missing: Column, out: str) -> DataFrame:
    """Values with the median of the known training values where missing, and a flag."""
    known = df.where(train & ~missing).select(value.cast("double").alias("_value"))
    median = exact_quantiles(known, "_value", [0.5]).select(F.col("_edges")[0].alias("_median"))
    filled = F.when(missing, F.col("_median")).otherwise(value.cast("double"))
    return df.crossJoin(F.broadcast(median)).withColumn(out, filled).withColumn(f"{out}_missing", missing.cast("int")).drop("_median")


def target_encode(df: DataFrame, train: Column, label: Column, group: str = "muni", parent: str = "state", floor: int = STUDY.floor, m: int = STUDY.smoothing, out: str = "muni_te") -> DataFrame:
    """Smoothed mean label of the group; of its parent below the floor or when unseen, else overall."""
    y = label.cast("double")
    fit = df.where(train)
    groups = fit.groupBy(group).agg(F.avg(y).alias("_mean"), F.count(F.lit(1)).alias("_n"), F.min(parent).alias("_own_parent"))
    parents = fit.groupBy(parent).agg(F.avg(y).alias("_parent_mean"))
    overall = fit.agg(F.avg(y).alias("_overall"))
    groups = groups.join(F.broadcast(parents.withColumnRenamed(parent, "_own_parent").withColumnRenamed("_parent_mean", "_own_mean")), "_own_parent", "left").drop("_own_parent")
    weight = F.col("_n") / (F.col("_n") + F.lit(float(m)))
    smooth = F.when(F.col("_n") < floor, F.col("_own_mean")).otherwise(weight * F.col("_mean") + (1 - weight) * F.col("_own_mean"))
    joined = df.join(groups, group, "left").join(parents, parent, "left").crossJoin(F.broadcast(overall))
    return joined.withColumn(out, F.coalesce(smooth, F.col("_parent_mean"), F.col("_overall"))).drop("_mean", "_n", "_own_mean", "_parent_mean", "_overall")


def scale(df: DataFrame, train: Column, cols: Sequence[str]) -> DataFrame:
    """Columns less the training mean over the training population deviation; a constant is only centred."""
    stats = df.agg(*[F.avg(F.when(train, F.col(c))).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(F.when(train, F.col(c))).alias(f"_d_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(stats))
    for c in cols:
        out = out.withColumn(f"{c}_z", (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_d_{c}") > 0, F.col(f"_d_{c}")).otherwise(1.0))
    return out.drop(*stats.columns)


def numeric_features(df: DataFrame) -> DataFrame:
    """The encoded columns of ``df (…, split, label)`` that blocks are made of, one row a candidate."""
    train = F.col("split") == "train"
    out = sentinel_fill(df, train, F.col("year"), F.col("year") == 0, "year_ord")
    out = sentinel_fill(out, train, letter_ordinal(F.col("letter")), F.col("letter") == "H", "letter_ord")
    out = out.withColumn("band_ord", letter_ordinal(F.col("band")).cast("double"))
    return target_encode(out, train, F.col("label"))


def block_columns(spec: BlockSpec) -> tuple[list[str], list[str]]:
    """Names and numbers of a block."""
    nominal = [*NOMINAL, *(["grp"] if spec.group else []), *(["sex"] if spec.sex else []), *spec.extra]
    return nominal, ["year_ord", "year_ord_missing", *(["muni_te"] if spec.municipality else []), *(["letter_ord", "letter_ord_missing", "band_ord"] if spec.background else [])]


def assembler(spec: BlockSpec) -> Pipeline:
    """One-hot levels of the training rows (unseen ones get zeros) and numeric columns in one vector."""
    nominal, numeric = block_columns(spec)
    index = StringIndexer(inputCols=[f"{c}_s" for c in nominal], outputCols=[f"{c}_i" for c in nominal], stringOrderType="alphabetAsc", handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"{c}_i" for c in nominal], outputCols=[f"{c}_h" for c in nominal], dropLast=True)
    return Pipeline(stages=[index, hot, VectorAssembler(inputCols=[*[f"{c}_h" for c in nominal], *numeric], outputCol="features")])


def assemble(encoded: DataFrame, spec: BlockSpec) -> tuple[DataFrame, PipelineModel]:
    nominal = {f"{c}_s": F.col(c).cast("string") for c in [*NOMINAL, "grp", "sex", *spec.extra]}
    ready = encoded.withColumns(nominal)
    model = assembler(spec).fit(ready.where(F.col("split") == "train"))
    return model.transform(ready), model
