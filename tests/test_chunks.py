import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from seatwise.streaming import chunks

SCHEMA = "g string, v double"


def test_a_scan_goes_on_after_a_failure_and_reads_only_new_files(spark, tmp_path):
    source, state = str(tmp_path / "in"), str(tmp_path / "state")

    def add(first, last):
        rows = [(None if i % 5 == 0 else "ab"[i % 2], None if i % 11 == 0 else 1e6 + i / 7) for i in range(first, last)]
        spark.createDataFrame([*rows, ("alone", None)], SCHEMA).coalesce(1).write.mode("append").parquet(source)

    for i in range(3):
        add(i * 40, i * 40 + 40)
    schema, seen, fail = spark.createDataFrame([], SCHEMA).schema, [], [True]

    def partial(batch):
        seen.append(batch.count())
        if len(seen) == 2 and fail:
            fail.clear()
            raise RuntimeError("lost")
        return chunks.partial_moments(batch, "v", ["g"])

    def scan():
        return chunks.merged_moments(chunks.scanned(spark, source, schema, partial, state, files=1), ["g"])

    def whole():
        return spark.read.parquet(source).groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))

    def rows(df):
        return sorted(((r.g or "", r.n, r["mean"] and round(r["mean"], 6), r.sd and round(r.sd, 6)) for r in df.collect()), key=lambda r: r[0])

    with pytest.raises(StreamingQueryException):
        scan()
    assert seen == [41, 41]
    assert rows(scan()) == rows(whole())
    assert seen == [41] * 4  # the failed batch once more, the first one never
    add(120, 150)
    assert rows(scan()) == rows(whole())
    assert seen == [41] * 4 + [31]
    assert rows(scan()) == rows(whole()) and len(seen) == 5


def test_a_scan_of_an_empty_folder_has_no_rows(spark, tmp_path):
    (tmp_path / "none").mkdir()
    schema = spark.createDataFrame([], SCHEMA).schema
    got = chunks.scanned(spark, str(tmp_path / "none"), schema, lambda d: chunks.partial_moments(d, "v", ["g"]), str(tmp_path / "s"))
    assert chunks.merged_moments(got, ["g"]).count() == 0
