"""Shards along a Hilbert curve over metadata, with DataFrame and SQL functions only.

Each dimension is quantised in two steps: an order-preserving fine cell, then equal-depth
bins over the counts of the at most ``FINE`` cells. The curve's cells are cut into sub-cells
of bounded size by a hash, so that no task ranks a whole hot cell; ranks within sub-cells
plus offsets of sub-cells give every row its place, and places are cut into equal runs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranking import group_ranks
from .scratch import quoted, table

#: Fine cells of a dimension, and bits of a coordinate.
FINE, BITS = 4096, 4


def _text_key(value: Column, skip: int) -> Column:
    """The six bytes after the first ``skip`` as a number, in the order of the strings."""
    part = F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), skip + 1, 6)), 12, "0")
    return F.conv(part, 16, 10).cast("long")


def _number(df: DataFrame, dim: str) -> Column:
    """A dimension as a double: days, seconds or the number itself; null if it is not finite."""
    kind, col = dict(df.dtypes)[dim], F.col(quoted(dim))
    if kind == "date":
        return F.unix_date(col).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(col.cast("timestamp")) / 1e6
    value = col.cast("double")
    return F.when(F.abs(value) < float("inf"), value)  # NaN is greater


def _fine(df: DataFrame, dims: list[str]) -> list[Column]:
    """Order-preserving cells 1 to ``FINE`` of each dimension, 0 for null, from its least and greatest value."""
    kinds = dict(df.dtypes)
    keys = [F.col(quoted(d)) if kinds[d] == "string" else _number(df, d) for d in dims]
    ends = df.agg(*[f(k).alias(f"{n}_{i}") for i, k in enumerate(keys) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = []
    for i, (d, value) in enumerate(zip(dims, keys, strict=True)):
        lo, hi = ends[f"lo_{i}"], ends[f"hi_{i}"]
        if lo is None:
            out.append(F.lit(0))
            continue
        if kinds[d] == "string":
            a, b = lo.encode(), hi.encode()
            skip = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            key = _text_key(value, skip)
            lo, hi = (int.from_bytes(x[skip : skip + 6].ljust(6, b"\0"), "big") for x in (a, b))
            cell = F.floor((key - lo).cast("double") * FINE / (hi - lo + 1))
        elif kinds[d] == "date" or kinds[d].startswith("timestamp"):
            cell = F.floor((value - lo) * (FINE / max(hi - lo, 1.0)))
        else:  # numbers spread over orders of magnitude
            cell = F.floor(F.log1p(value - lo) * FINE / (F.log1p(F.lit(hi - lo)) + 1e-9))
        out.append(F.coalesce(F.least(F.greatest(cell, F.lit(0)), F.lit(FINE - 1)).cast("int") + 1, F.lit(0)))
    return out


def _bins(cells: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """``dim, cell, bin``: equal-depth bins of the fine cells; at most FINE + 1 rows a dimension."""
    long = cells.select(F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.col(f"_c{i}").alias("cell")) for i in range(len(dims))])).alias("x"))
    counts = long.groupBy("x.dim", "x.cell").count()
    w = Window.partitionBy("dim")
    before = F.sum("count").over(w.orderBy("cell")) - F.col("count") / 2
    return counts.select("dim", "cell", F.floor(before * (1 << bits) / F.sum("count").over(w)).cast("int").alias("bin"))


def hilbert_index(coords: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of a point with coordinates below ``2 ** bits``, by Skilling's transform."""
    n = len(coords)
    steps = F.array(*[F.struct(F.lit(1 << q).alias("q"), F.lit(i).alias("i")) for q in range(bits - 1, 0, -1) for i in range(n)])

    def undo(acc: Column, step: Column) -> Column:
        at, q, i = F.element_at(acc, step["i"] + 1), step["q"], step["i"]
        low = q - 1
        swap = (F.element_at(acc, 1).bitwiseXOR(at)).bitwiseAND(low)
        hit = at.bitwiseAND(q) != 0
        return F.transform(acc, lambda v, k: v.bitwiseXOR(F.when(hit & (k == 0), low).when(~hit & ((k == 0) | (k == i)), F.when(i == 0, 0).otherwise(swap)).otherwise(0)))

    masks = F.array(*[F.lit(1 << q) for q in range(bits - 1, 0, -1)])

    def spread(g: Column) -> Column:
        last = F.element_at(g, n)
        t = F.aggregate(masks, F.lit(0), lambda a, q: F.when(last.bitwiseAND(q) != 0, a.bitwiseXOR(q - 1)).otherwise(a))
        return F.transform(g, lambda v: v.bitwiseXOR(t))

    order = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])

    def weave(y: Column) -> Column:
        return F.aggregate(order, F.lit(0).cast("long"), lambda a, s: a * 2 + F.call_function("getbit", F.element_at(y, s["i"] + 1), s["b"]).cast("long"))

    def gray(x: Column) -> Column:
        return F.transform(x, lambda _, k: F.aggregate(F.slice(x, 1, k + 1), F.lit(0), lambda a, e: a.bitwiseXOR(e)))

    # each step reads its input several times, so it is bound once as the only element of an array
    bound = F.array(F.aggregate(steps, F.array(*coords), undo))
    return F.element_at(reduce(F.transform, [gray, spread, weave], bound), 1)


def hilbert_shards(df: DataFrame, dims: list[str], n_shards: int, tie: list[str], payload: list[str] | None = None, bits: int = BITS, part: Column | None = None) -> DataFrame:
    """``df`` (or its ``payload`` columns) with ``curve, shard, slot``; columns of these names go.

    Rows are ordered by the place of their ``dims`` (strings, numbers, dates or timestamps) on
    the curve, within a place by a hash of ``tie`` and then by ``tie``, or by ``part``, which
    cuts a place into bounded parts, and then by ``tie``; ``n_shards`` runs of this order differ
    by one row at most. Null dimensions, and numbers that are not finite, have bins of their
    own, repeated rows take neighbouring slots, and an empty table gives an empty result.
    """
    keep = [c for c in payload or df.columns if c not in ("curve", "shard", "slot")]
    ties = [F.col(quoted(t)).alias(f"_t{i}") for i, t in enumerate(tie)]
    whole = F.struct(*[F.col(quoted(c)) for c in keep]).alias("_row")
    parts = [] if part is None else [part.alias("_part")]
    cells = df.select(*[c.alias(f"_c{i}") for i, c in enumerate(_fine(df, dims))], whole, *ties, *parts)
    bins = _bins(cells.select(*[f"_c{i}" for i in range(len(dims))]), dims, bits)
    for i in range(len(dims)):  # FINE + 1 rows at most
        own = F.broadcast(bins.where(F.col("dim") == i).select(F.col("cell").alias(f"_c{i}"), F.col("bin").alias(f"_b{i}")))
        cells = cells.join(own, f"_c{i}")
    placed = cells.withColumn("_curve", hilbert_index([F.col(f"_b{i}") for i in range(len(dims))], bits)).drop(*[f"_c{i}" for i in range(len(dims))], *[f"_b{i}" for i in range(len(dims))])
    sub = None if part is None else F.col("_part")
    ranked = group_ranks(placed, ["_curve"], [f"_t{i}" for i in range(len(tie))], across=True, sub=sub)  # (2 ** bits) ** dims places at most
    shard = F.expr(f"(_rank * {n_shards}) div _total")
    cut = F.expr(f"((_rank * {n_shards}) div _total * _total + {n_shards - 1}) div {n_shards}")
    return ranked.select("_row.*", F.col("_curve").alias("curve"), shard.cast("int").alias("shard"), (F.col("_rank") - cut).cast("long").alias("slot"))


def shards_in_order(df: DataFrame, dims: list[str], n_shards: int) -> DataFrame:
    """``hilbert_shards`` of a table in files, where rows of one place on the curve keep the order they have in the files.

    A part is a file, as large as its writer made it. A table that is not in files has no order;
    its rows go by their hash.
    """
    try:
        place = df.metadataColumn("_metadata")
        named = df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("whole_row"), *[F.col(quoted(d)).alias(f"dim_{i}") for i, d in enumerate(dims)], place["file_name"].alias("file"), place["row_index"].alias("line"))
    except AnalysisException:
        return hilbert_shards(df, dims, n_shards, ["doc_id", "n_chars"])
    out = hilbert_shards(named, [f"dim_{i}" for i in range(len(dims))], n_shards, ["line"], ["whole_row"], part=F.col("file"))
    added = ["curve", "shard", "slot"]
    return out.select(*[F.col("whole_row")[c].alias(c) for c in df.columns if c not in added], *added)


DIMS = ["lang", "source", "n_chars"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.encode("text", "UTF-8"), F.encode(F.lit(""), "UTF-8"))
    slim = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *DIMS)
    out = hilbert_shards(slim, DIMS, 40, ["doc_id", "text_crc32", "size"], ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def pruning(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Rows and the least and greatest value of each dimension by shard, as file statistics would hold them."""
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *[f(d).alias(f"{name}_{d}") for d in dims for name, f in (("min", F.min), ("max", F.max))])
