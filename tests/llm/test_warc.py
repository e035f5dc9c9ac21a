import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from seatwise.llm import hot, warc

PAGES = "page_id long, url string, html string"
TRICKY = ["WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3, "\r\n\r\nWARC/1.1\r\n" * 20, "WWARC/1.1\r\n\r\n\r\n", "a\r\n\r\nb" * 40, "ünï çødé 🙂" * 50, "\r\n", "x" * 99, "x" * 100, "y" * 3000]


def pages():
    rng = random.Random(3)
    texts = [*TRICKY, "", None, *["".join(rng.choice("abç\r\n") for _ in range(rng.randint(0, 400))) for _ in range(30)]]
    rows = [(i, f"http://h{i % 3}.org/{i}", t) for i, t in enumerate(texts)]
    rows += [(100 + i, None, t) for i, t in enumerate(TRICKY)] + [(200, "http://a\r\nWARC-Type: x", TRICKY[8]), (None, "u", TRICKY[8]), (None, None, None), rows[8], rows[20]]
    return rows


def expected(rows):
    least, out = {}, []
    for i, _, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, _, t in rows:
        raw = (t or "").encode()
        first = least.get(t or "")
        revisit = len(raw) >= 100 and i != first
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.mark.parametrize("chunk", [7, 100, warc.CHUNK])
def test_archives_read_back_as_written(spark, tmp_path, chunk):
    df = spark.createDataFrame(pages(), PAGES).withColumns({c: F.lit(1) for c in ("digest", "size", "record", "block", "_part", "id", "text", "first")}).repartition(3)
    path = str(tmp_path / "a")
    warc.write_archives(df, path, chunk=chunk)
    assert found(warc.read_records(spark, path)) == expected(pages())
    segments = warc.read_segments(spark, path).collect()
    assert max(len(r.block) for r in segments) <= chunk and any(r.segmented for r in segments)


def test_an_archive_is_what_the_format_says(spark, tmp_path):
    """Records of a file, read by their lengths alone."""
    path = tmp_path / "a"
    warc.write_archives(spark.createDataFrame(pages(), PAGES).coalesce(1), str(path), chunk=100)
    seen = 0
    for part in path.glob("part-*"):
        raw, at = gzip.decompress(part.read_bytes()), 0
        while at < len(raw):
            end = raw.index(b"\r\n\r\n", at)
            lines = raw[at:end].decode().split("\r\n")
            head = dict(x.split(": ", 1) for x in lines[1:])
            assert lines[0] == "WARC/1.1" and {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= head.keys()
            at = end + 4 + int(head["Content-Length"])
            assert raw[at : at + 4] == b"\r\n\r\n"
            at, seen = at + 4, seen + (head["WARC-Type"] != "continuation")
    assert seen == len(pages())


def test_running_digests_are_those_of_the_prefixes(spark, tmp_path):
    path, text = str(tmp_path / "a"), "0123456789é" * 500
    warc.write_archives(spark.createDataFrame([(1, "u", text)], PAGES), path, chunk=64)
    rows = sorted(warc.chunk_digests(warc.read_segments(spark, path)).collect(), key=lambda r: r.no)
    raw = text.encode()
    assert [r.digest for r in rows] == [hashlib.sha256(raw[: 64 * (i + 1)]).hexdigest() for i in range(len(rows))] and rows[-1].size == len(raw) and rows[-1].total == len(rows)


def test_damage_is_an_error(spark, tmp_path):
    path, text = str(tmp_path / "a"), "abcdefghij" * 100
    warc.write_archives(spark.createDataFrame([(1, "u", text)], PAGES), path, chunk=64)
    rows = warc.read_segments(spark, path)
    with pytest.raises(Exception, match="missing"):
        warc.chunk_digests(rows.where("no <> 3")).collect()
    (tmp_path / "b").mkdir()
    for i, part in enumerate((tmp_path / "a").glob("part-*")):
        (tmp_path / "b" / f"part-{i}").write_bytes(gzip.decompress(part.read_bytes()).replace(b"efgh", b"eFgh"))
    with pytest.raises(Exception, match="differ"):
        warc.read_records(spark, str(tmp_path / "b"))


def test_no_pages_and_only_empty_ones(spark, tmp_path):
    none = spark.createDataFrame([], PAGES)
    warc.write_archives(none, str(tmp_path / "a"))
    assert warc.read_records(spark, str(tmp_path / "a")).count() == 0
    warc.write_archives(spark.createDataFrame([(None, None, None), (1, None, "")], PAGES), str(tmp_path / "b"))
    assert {r.payload_bytes for r in warc.read_records(spark, str(tmp_path / "b")).collect()} == {0}


def test_hot_keys_are_split_and_meet_their_row(spark, monkeypatch):
    monkeypatch.setattr(hot, "ROWS", 10)
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(300, None)], "id long, key string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("unused", 3)], "key string, v int")
    rows = {r.id: r.v for r in hot.join_hot(left, right, "key").collect()}
    assert len(rows) == 301 and all(v == (1 if i % 3 and i < 300 else 2 if i == 0 else None) for i, v in rows.items())
