"""Restartable scans: partial aggregates by batch of files, kept in a folder and merged."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.tables import exists, is_file, write_parquet

#: Files of one batch.
FILES = 256


def scanned(spark: SparkSession, source: str, schema: StructType, partial: Callable[[DataFrame], DataFrame], state: str, files: int = FILES, kind: str = "parquet", options: Mapping[str, str] | None = None) -> DataFrame:
    """The rows of ``partial`` for every batch of at most ``files`` files of ``source``, a folder or a file.

    Batches and their rows are kept in ``state``. A scan that fails goes on with the batch that was
    being read, whose rows are written anew, and a later scan reads only files that have come since.
    ``partial`` aggregates a batch, so what is kept is small. An empty folder gives no rows.
    """
    if is_file(spark, source):
        source = f"{source[:-1]}[{source[-1]}]"  # streams take a single file as a pattern alone
    stream = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files).options(**(options or {})).load(source)

    def keep(batch: DataFrame, number: int) -> None:
        write_parquet(partial(batch), f"{state}/parts/batch={number}")

    run = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{state}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    if not exists(spark, f"{state}/parts"):
        return partial(spark.createDataFrame([], schema)).limit(0)
    return spark.read.parquet(f"{state}/parts").drop("batch")


def partial_moments(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """``n, mean, m2`` of a column by group: its values, their mean and their squared deviations from it."""
    value = F.col(col).cast("double")
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


def merged_moments(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, mean and sample deviation by group of all rows behind the rows of ``partial_moments``, one a batch and group."""
    own = Window.partitionBy(*by)
    mean = F.try_divide(F.sum(F.col("n") * F.col("mean")).over(own), F.sum(F.when(F.col("n") > 0, F.col("n"))).over(own))
    apart = F.col("m2") + F.col("n") * (F.col("mean") - F.col("_mean")) ** 2
    n = F.sum("n")
    sd = F.when(n > 1, F.sqrt(F.sum("_apart") / (n - 1)))
    return parts.withColumn("_mean", mean).withColumn("_apart", apart).groupBy(*by).agg(n.alias("n"), F.max("_mean").alias("mean"), sd.alias("sd"))
