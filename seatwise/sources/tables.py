"""Readers and sinks of study tables."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LEDGER_SCHEMA = "task string, variant string, block string, model string, k double, group_a string, group_b string, row_id long, model_selected boolean, bench_selected boolean, group_value string"
_HEAD = 1 << 16
CELL = ["task", "variant", "block", "model", "k", "group_a", "group_b"]


T = TypeVar("T")

#: Folders of local applications that name none.
_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a new local folder of the application where it is unset and the master is local."""
    root, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not root and app not in _LOCAL:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="seatwise-")
    return (root or _LOCAL[app]).rstrip("/")


def _file(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark reads."""
    system, target = _file(spark, path)
    return system.exists(target)


def is_file(spark: SparkSession, path: str) -> bool:
    """Whether a path is one file, not a folder."""
    system, target = _file(spark, path)
    return system.exists(target) and system.getFileStatus(target).isFile()


def cut(df: DataFrame, session: SparkSession | None = None) -> DataFrame:
    """``df`` with its rows saved in the shared folder, so that later plans (of ``session``) start from there; the rows go with the JVM."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/seatwise-cut-{uuid.uuid4().hex}"
    write_parquet(df, path)
    system, target = _file(spark, path)
    system.deleteOnExit(target)
    return (session or spark).read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the rows of ``cut`` whose last reader is done."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        system, target = _file(spark, path)
        system.delete(target, True)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def fingerprint(spark: SparkSession, folder: str, settings: object = "") -> str:
    """A hash of the files of ``folder``, by name, length and time, and of ``settings``: tables changed in place have another."""
    system, target = _file(spark, folder)
    files, seen = system.listFiles(target, True), []
    while files.hasNext():
        f = files.next()
        seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr((folder, sorted(seen), settings)).encode()).hexdigest()[:24]


def study_home(spark: SparkSession, folder: str, settings: object = "") -> str:
    """Where this application keeps what it has computed from ``folder`` under ``settings``; it goes with the JVM."""
    path = f"{shared_root(spark)}/seatwise-study-{spark.sparkContext.applicationId}-{fingerprint(spark, folder, settings)}"
    system, target = _file(spark, path)
    system.deleteOnExit(target)
    return path


def commit(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file visible as a whole by one rename; False, and nothing changes, if it is there already."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    system, made = _file(spark, f"{path}.{uuid.uuid4().hex}")
    out = system.create(made)
    out.write(text.encode())
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(made, target, none)  # fails if the target exists
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        system.delete(made, False)
        return False
    return True


def read_small(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if it isn't there."""
    system, target = _file(spark, path)
    if not system.exists(target):
        return None
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def stored(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame], settings: object = "") -> DataFrame:
    """A table of a study of ``folder``: read if this application has committed it, else built and written.

    The rows are seen once a file that names their folder is; of several builders the first one's
    rows are everyone's.
    """
    home = study_home(spark, folder, settings)
    if read_small(spark, f"{home}/{name}.done") is None:
        path = f"{home}/{name}-{uuid.uuid4().hex}"
        write_parquet(build(), path)
        commit(spark, f"{home}/{name}.done", path)
    return spark.read.parquet(read_small(spark, f"{home}/{name}.done"))


def side_by_side(spark: SparkSession, builds: Sequence[Callable[[], T]]) -> list[T]:
    """What the builders return, in their order. Their jobs run beside each other, as those of one keep few cores busy; an error of one is raised."""
    with ThreadPoolExecutor(max(len(builds), 1)) as pool:
        return list(pool.map(lambda build: build(), [inheritable_thread_target(spark)(b) for b in builds]))


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: StructType | str, columns: Sequence[str] | None = None, sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """A delimited file with a header and a fixed schema; only ``columns`` are parsed."""
    df = spark.read.schema(schema).csv(path, sep=sep, header=True, encoding=encoding)
    return df.select(*columns) if columns else df


def sniff(spark: SparkSession, path: str) -> tuple[str, str]:
    """The first separator and encoding under which the first five rows decode and have several columns."""
    system, target = _file(spark, path)
    stream = system.open(target)
    head = bytes(stream.readNBytes(_HEAD))
    stream.close()
    lines = head.split(b"\n")[: 6 if len(head) < _HEAD else min(6, max(1, head.count(b"\n")))]
    for sep in (";", ","):
        for encoding in ("UTF-8", "ISO-8859-1"):
            try:
                text = [x.decode(encoding) for x in lines]
            except UnicodeDecodeError:
                continue
            if len(text[0].split(sep)) > 1:
                return sep, encoding
    raise ValueError(f"no known delimiter in {path}")


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Add rows to a folder of CSV files, each with the header; the results so far stay readable after a failure."""
    df.coalesce(1).write.mode("append").option("header", True).option("escape", '"').csv(path)


def halting(df: DataFrame, ok: Column, message: Column) -> DataFrame:
    """``df``; the job that computes its rows fails with ``message`` at a row that is not ``ok``, so a write of them leaves nothing."""
    return df.where(F.when(ok, True).otherwise(F.raise_error(message).cast("boolean")))


def joined_whole(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """The inner join of two tables that must have the same keys, each once; anything else fails the job that reads it.

    Rows of both are grouped by key, so the check needs no job and no exchange of its own. A null key is a key.
    """
    mine, other = left.columns, [c for c in right.columns if c != key]
    tagged = [df.select(F.col(key).alias("_key"), *[(F.struct(*cols) if own == name else F.lit(None)).alias(own) for own in ("_l", "_r")]) for name, df, cols in (("_l", left, mine), ("_r", right.withColumn("_", F.lit(True)), ["_", *other]))]
    met = tagged[0].unionByName(tagged[1]).groupBy("_key").agg(F.count("_l").alias("_nl"), F.count("_r").alias("_nr"), F.first("_l", True).alias("_l"), F.first("_r", True).alias("_r"))
    key_text = F.coalesce(F.col("_key").cast("string"), F.lit("null"))
    whole = halting(met, (F.col("_nl") == 1) & (F.col("_nr") == 1), F.concat(F.lit(f"a key of {key} is not on both sides once: "), key_text))
    return whole.select(*[F.col("_l")[c].alias(c) for c in mine], *[F.col("_r")[c].alias(c) for c in other])


def aligned(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """``left`` with the columns of ``right``; a key of ``left`` that ``right`` lacks or has twice fails the job that reads the rows."""
    other = [c for c in right.columns if c != key]
    one = right.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(F.lit(True).alias("_"), *other)).alias("_r"))
    both = left.join(one, F.col(key) == F.col("_key"), "left")
    key_text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    found = halting(both, F.coalesce(F.col("_n"), F.lit(0)) == 1, F.concat(F.lit(f"a key of {key} is missing or repeated: "), key_text))
    return found.select(*left.columns, *[F.col("_r")[c].alias(c) for c in other])


def logger(path: str | None = None) -> logging.Logger:
    """The package's logger; with ``path`` it also appends to a file of the driver, line by line."""
    log = logging.getLogger("seatwise")
    log.setLevel(logging.INFO)
    if path and not any(getattr(h, "baseFilename", None) == os.path.abspath(path) for h in log.handlers):
        handler = logging.FileHandler(path, mode="a", encoding="utf-8")
        handler.setFormatter(logging.Formatter("%(asctime)s %(message)s"))
        log.addHandler(handler)
    return log


def read_parameters(spark: SparkSession, path: str) -> dict[tuple[str, str], dict]:
    """Tuned parameters by (block, model), from a results file with a JSON column."""
    rows = spark.read.csv(path, header=True, escape='"').select("block", "model", "best_params").collect()  # a row a cell
    return {(r.block, r.model): json.loads(r.best_params) for r in rows}


def ledger(df: DataFrame, task: str, variant: str, block: str, model: str, k: float, group_a: str = "A", group_b: str = "B") -> DataFrame:
    """Decisions ``(id, model_selected, bench_selected, side)`` in the form of the ledger."""
    head = {"task": task, "variant": variant, "block": block, "model": model, "group_a": group_a, "group_b": group_b}
    return df.select(*[F.lit(v).alias(c) for c, v in head.items()], F.lit(float(k)).alias("k"), F.col("id").alias("row_id"), "model_selected", "bench_selected", F.col("side").alias("group_value")).select(*[f.split()[0] for f in LEDGER_SCHEMA.split(", ")])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = tuple(CELL)) -> DataFrame:
    """``new`` and the rows of ``old`` whose cell ``new`` does not have."""
    cells = new.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return old.join(cells, on, "left_anti").unionByName(new)


def upsert_partitions(df: DataFrame, path: str) -> None:
    """Replace only the (task, variant) partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task", "variant").parquet(path)
