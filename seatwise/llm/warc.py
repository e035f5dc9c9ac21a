"""WARC archives written from a table of pages, and read back as a table of chunks.

A payload longer than a chunk is written as a response and continuation records, the format's
own segments, so no record in an archive is longer than a chunk. Archives are read record by
record by splitting files where records begin. The segments of a payload are rows of record
identifier and chunk number; a digest runs along them chunk by chunk, so that no task holds a
whole payload, however long.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hot import join_hot
from .scratch import delete_on_exit, materialise, shared_root, table

#: Bytes of a chunk, and the least payload that is written once only.
CHUNK, LEAST = 1 << 16, 100
_VERSION, _BREAK, _HTTP = "WARC/1.1\r\n", "\r\n\r\n", "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _payload(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _first_of_equals(pages: DataFrame, least: int) -> DataFrame:
    """``digest, count`` and the least ``first`` of ``pages (id, digest, size)`` for digests with several rows."""
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"))
    groups = pages.where(F.col("size") >= least).groupBy("digest").agg(F.min(order)["id"].alias("first"), F.count(F.lit(1)).alias("count"))
    return groups.where("count > 1")


def _chunks(text: Column, size: int) -> Column:
    """Byte chunks of a text, at least one, none longer than ``size`` and none with the line that begins a record."""
    pieces = F.when(F.contains(text, F.lit(_VERSION)), F.split(text, r"(?<=W)(?=ARC/1\.1\r\n)")).otherwise(F.array(text))

    def cut(piece: Column) -> Column:
        last = F.greatest(F.ceil(F.octet_length(piece) / size) - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.substring(piece.cast("binary"), (i * size + 1).cast("int"), F.lit(size)))

    return F.flatten(F.transform(pieces, cut))


def _field(name: str, value: Column) -> Column:
    """A header line, null for a null value; blanks and controls are percent-encoded, as they may break the line."""
    clean = value.cast("string")
    for c in "\r\n":
        clean = F.replace(clean, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.concat(F.lit(f"{name}: "), clean)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = LEAST, chunk: int = CHUNK) -> None:
    """One record a row of ``pages``, with the UTF-8 bytes of ``text_col`` as payload, in compressed archives under ``path``.

    Of rows with equal payloads of ``least`` bytes or more, those of the least id (null last)
    are responses and the others revisit them; repeated rows of the least id are each written
    whole. Null texts are empty payloads, null ids and urls have no header line, and other
    columns are not read. An empty table gives archives without records.
    """
    text = _payload(text_col)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("digest"), F.octet_length(text).alias("size"))
    firsts = materialise(_first_of_equals(rows.select("id", "digest", "size"), least), "warc-firsts")
    met = join_hot(rows, firsts.select("digest", "first", F.lit(True).alias("_found")), "digest", firsts.select("digest", "count"))
    revisit = (F.col("size") >= least) & F.col("_found").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    met = met.withColumn("revisit", F.coalesce(revisit, F.lit(False)))
    met = met.withColumn("record", F.concat_ws(":", F.lit("urn:page"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.monotonically_increasing_id().cast("string")))
    blocks = F.when(F.col("revisit"), F.array(F.lit(b""))).otherwise(_chunks(F.col("text"), chunk))
    parts = met.withColumn("blocks", blocks).select("record", "id", "url", "digest", "first", "revisit", F.size("blocks").alias("total"), F.posexplode("blocks").alias("no", "block"))
    http = ~F.col("revisit") & (F.col("no") == 0)
    block = F.when(http, F.concat(F.lit(_HTTP.encode()), F.col("block"))).otherwise(F.col("block"))
    own = F.when(F.col("no") == 0, F.col("record")).otherwise(F.concat_ws(":", "record", F.col("no").cast("string")))
    kind = F.when(F.col("revisit"), "revisit").when(F.col("no") == 0, "response").otherwise("continuation")
    segmented, head = F.col("total") > 1, F.col("no") == 0
    lines = [
        _field("WARC-Type", kind), _field("WARC-Record-ID", F.concat(F.lit("<"), own, F.lit(">"))),
        _field("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.when(head, _field("WARC-Target-URI", F.col("url"))), F.when(head, _field("WARC-Page-ID", F.col("id"))),
        F.when(head, _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))),
        F.when(F.col("revisit"), _field("WARC-Refers-To-Page-ID", F.col("first"))), F.when(F.col("revisit"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(segmented, _field("WARC-Segment-Number", F.col("no") + 1)), F.when(segmented & ~head, _field("WARC-Segment-Origin-ID", F.concat(F.lit("<"), F.col("record"), F.lit(">")))),
        F.when(segmented & (F.col("no") + 1 == F.col("total")), _field("WARC-Segment-Total-Length", F.col("total"))),
        F.when(~F.col("revisit") & head, F.lit("Content-Type: application/http; msgtype=response")), _field("Content-Length", F.octet_length("block")),
    ]
    written = parts.withColumn("block", block).select(F.concat(F.lit(_VERSION), F.concat_ws("\r\n", *lines), F.lit(_BREAK), F.col("block").cast("string")).alias("value"))
    written.write.option("lineSep", _BREAK).option("compression", "gzip").text(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """A row a record of the archives: ``record`` (of a segment: its origin), ``no`` (from 1), ``segmented``, ``kind``, ``page_id``, ``url``, ``digest``, ``refers_to``, ``block``.

    A block is without the HTTP header. Files are split where records begin, so they may be of any
    length; a record that is shorter than it says is an error.
    """
    raw = spark.read.option("lineSep", _BREAK + _VERSION).text(path).where("value <> ''")
    top = F.substring_index("value", _BREAK, 1)
    fields = F.str_to_map(F.when(F.startswith(top, F.lit(_VERSION)), F.substring(top, len(_VERSION) + 1, 1 << 30)).otherwise(top), F.lit("\r\n"), F.lit(": "))
    rows = raw.select(fields.alias("f"), F.octet_length(top).alias("skip"), F.col("value").cast("binary").alias("raw"))
    length = F.col("f")["Content-Length"].cast("int")
    rows = rows.withColumn("block", F.substring("raw", F.col("skip") + len(_BREAK) + 1, length)).where(F.when(F.octet_length("block") == length, F.lit(True)).otherwise(F.raise_error(F.lit("a record is shorter than its Content-Length")).cast("boolean")))
    http = F.octet_length(F.substring_index(F.col("block").cast("string"), _BREAK, 1)) + len(_BREAK)
    held = F.when(F.startswith(F.coalesce(F.col("f")["Content-Type"], F.lit("")), F.lit("application/http")), F.substring("block", http + 1, F.lit(1 << 30))).otherwise(F.col("block"))
    return rows.select(
        F.coalesce(F.col("f")["WARC-Segment-Origin-ID"], F.col("f")["WARC-Record-ID"]).alias("record"), F.coalesce(F.col("f")["WARC-Segment-Number"].cast("long"), F.lit(1)).alias("no"),
        F.col("f")["WARC-Segment-Number"].isNotNull().alias("segmented"), F.col("f")["WARC-Type"].alias("kind"), F.col("f")["WARC-Page-ID"].cast("long").alias("page_id"), F.col("f")["WARC-Target-URI"].alias("url"),
        F.replace(F.col("f")["WARC-Payload-Digest"], F.lit("sha256:"), F.lit("")).alias("digest"), F.col("f")["WARC-Refers-To-Page-ID"].cast("long").alias("refers_to"), held.alias("block"),
        F.col("f")["WARC-Segment-Total-Length"].cast("long").alias("total"),
    )


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For chunks by record and number the bytes and the digest so far; the hash goes on from one batch to the next."""
    record, no, size, state = None, 0, 0, hashlib.sha256()
    for batch in batches:
        sizes, digests = [], []
        for r, n, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if r != record:
                record, no, size, state = r, 0, 0, hashlib.sha256()
            no += 1
            if n != no:
                raise ValueError(f"segment {no} of {r} is missing or there twice")
            held = block.as_buffer()
            state.update(held)
            size += len(held)
            sizes.append(size)
            digests.append(state.copy().hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), batch.column(3)], ["record", "no", "size", "digest", "total"])


def chunk_digests(segments: DataFrame) -> DataFrame:
    """``record, no, size, digest, total``: the bytes and the SHA-256 of a payload up to each of its chunks.

    Chunks meet by record and pass through a task one after another in their order.
    """
    rows = segments.select("record", "no", "block", "total").repartition("record").sortWithinPartitions("record", "no")
    return rows.mapInArrow(_running, "record string, no long, size long, digest string, total long")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to``: one row a response or revisit.

    Sizes and digests are those of the bytes read, of a revisit those of the response with its
    digest; a revisit without one has no size. A payload that has not the digest of its record,
    or lacks segments, is an error.
    """
    segments = read_segments(spark, path)
    heads = segments.where("kind = 'response'")
    whole = heads.where("NOT segmented").select("page_id", "url", F.octet_length("block").cast("long").alias("size"), F.sha2("block", 256).alias("found"), "digest")
    ends = chunk_digests(segments.where("segmented")).where("no = total").select("record", "size", F.col("digest").alias("found"))
    long = heads.where("segmented").select("record", "page_id", "url", "digest").join(ends, "record", "left").drop("record")
    right = F.coalesce(F.col("found") == F.col("digest"), F.lit(False))
    responses = whole.unionByName(long).where(F.when(right, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("payload and digest differ: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))).cast("boolean")))
    responses = materialise(responses.drop("found"), "warc-responses")
    revisits = segments.where("kind = 'revisit'").select("page_id", "url", "digest", "refers_to")
    met = join_hot(revisits, responses.groupBy("digest").agg(F.min("size").alias("size")), "digest")
    out = responses.select("*", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(met.withColumn("record_type", F.lit("revisit")))
    return out.select("page_id", "url", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_root(spark)}/seatwise-{uuid.uuid4().hex}-warc"
    write_archives(table(spark, sf_dir, "pages"), path)
    delete_on_exit(spark, path)
    return read_records(spark, path).drop("url")


ORACLE = """
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN strlen(h) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 100 AND page_id > first THEN first END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""
