"""Tables written to the folder that driver and executors share, and filters of bounded size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files of a query whose rows are written go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of a key filter, at most (8 MB), and bits a key below that.
FILTER_BITS, KEY_BITS = 1 << 26, 16


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a new local folder where it is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="seatwise-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The table outlives lost executors and goes when the driver's JVM ends. The shuffle files
    behind it go at once.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/seatwise-{uuid.uuid4().hex}-{tag}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """A folder goes when the driver's JVM ends."""
    target = _path(spark, path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def _path(spark: SparkSession, path: str) -> JavaObject:
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialise`` whose last reader is done."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        target = _path(spark, path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = key.view(np.uint64) if key.dtype == np.int64 else key
    mask = np.uint64(bits - 1)
    return both & mask, (both >> np.uint64(32)) & mask


def key_bits(keys: DataFrame) -> tuple[bytes, int]:
    """A compressed table of bits, of bounded size, set for all hashes in the only column of ``keys``, and the number of bits.

    The bits are folded on the executors.
    """
    key = F.col(keys.columns[0])
    bits = 1 << 10
    while bits < min(FILTER_BITS, KEY_BITS * keys.count()):
        bits *= 2
    place = F.explode(F.array(key.bitwiseAND(bits - 1), F.shiftrightunsigned(key, 32).bitwiseAND(bits - 1)))
    words = keys.select(place.alias("p")).groupBy(F.shiftrightunsigned("p", 6).alias("word"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()  # bits / 64 rows at most
    table = np.zeros(bits // 64, np.uint64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return pa.compress(table.tobytes(), "zstd", asbytes=True), bits


def may_hold(filled: tuple[bytes, int], hashes: np.ndarray) -> np.ndarray:
    """True for all hashes that a table of ``key_bits`` was made of, and for few others."""
    held, bits = np.frombuffer(pa.decompress(filled[0], filled[1] // 8, "zstd", asbytes=True), np.uint64), filled[1]
    ok = np.ones(len(hashes), bool)
    for p in _places(hashes, bits):
        ok &= (held[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return ok


def key_filter(keys: DataFrame) -> Callable[[Column], Column]:
    """A test that holds for all hashes in the only column of ``keys`` and for few others.

    The bits have a bound, beyond which the test passes more and more other keys; so it may save
    a shuffle, and a join has to follow it.
    """
    shared = keys.sparkSession.sparkContext.broadcast(key_bits(keys))

    @F.arrow_udf("boolean")
    def may(hashes: pa.Array) -> pa.Array:
        return pa.array(may_hold(shared.value, hashes.to_numpy(zero_copy_only=False).astype(np.int64)))

    return may


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def quoted(name: str) -> str:
    """A column's name as ``F.col`` takes it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
