"""Mixing sources to target weights by Pfair scheduling.

A source's rows form blocks. An ideal mix gives every source its weight's share of each slot
until its rows run out, and the others share what it leaves. A source's k-th block may start in
the slot in which the ideal mix starts it and has to be placed by the end of the one in which
the ideal mix ends it; in each slot the released block of the earliest deadline goes first. As
the ideal mix itself keeps to these bounds, so does the schedule: every source stays within one
block of its target at every slot, whatever has run out before. Releases and deadlines are
whole numbers from the exact weights, so nothing adds up. No row is dropped.

With whole weights the ideal mix is at a whole block of every source each time their sum has
passed. Between two of these times without a source running out the slots repeat, so the driver
simulates one such period for many, and each one in which a source runs out; rows are ranked
without a task that holds a whole source and compute their slots from the period's.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_right
from collections.abc import Mapping
from fractions import Fraction
from math import gcd, lcm
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranking import group_ranks
from .scratch import quoted, table

BLOCK_ROWS = 64
#: Places of a source that are one row of the table that rows are joined with.
CHUNK = 64
#: Without given weights a source's weight is its number of rows to this power, in whole parts of WHOLE.
POWER, WHOLE = 0.7, 4096
#: Simulated slots up to which their table (8 bytes each) is broadcast.
SENT = 1 << 20


class Run(NamedTuple):
    """``line`` gives the source of each slot from ``start`` on, ``times`` over."""

    start: int
    times: int
    line: array


def whole_weights(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of ``weights`` as they are written; if none is positive, all equal."""
    exact = [Fraction(repr(max(w, 0))) for w in weights]
    if not any(exact):
        return [1] * len(weights)
    unit = lcm(*(x.denominator for x in exact))
    out = [int(x * unit) for x in exact]
    return [x // gcd(*out) for x in out]


class _Ideal:
    """When the ideal mix has had so many rounds; a round gives every source as many blocks as its weight."""

    def __init__(self, blocks: list[int], quota: list[int]) -> None:
        order = sorted((Fraction(n, q), n, q) for n, q in zip(blocks, quota, strict=True))
        self.ends = [x for x, _, _ in order]  # sources run out
        self.near = [float(x) for x in self.ends]
        self.rate, self.gone = [sum(quota)], [0]  # blocks a round, and blocks of sources that have run out
        for _, n, q in order:
            self.rate.append(self.rate[-1] - q)
            self.gone.append(self.gone[-1] + n)

    def slot(self, a: int, b: int) -> tuple[int, int]:
        """Numerator and denominator of the slot at which ``a / b`` rounds are over."""
        k = bisect_right(self.near, a / b * (1 - 1e-12))
        while k < len(self.ends) and self.ends[k].numerator * b <= a * self.ends[k].denominator:
            k += 1
        return self.rate[k] * a + self.gone[k] * b, b


def _simulate(blocks: list[int], quota: list[int], ideal: _Ideal, first: int, last: int) -> array:
    """The source of each slot from round ``first`` to round ``last``."""
    out, ready = array("l"), []
    waiting = []

    def wait(i: int, k: int) -> None:  # k blocks of the source are placed
        if k < min(blocks[i], quota[i] * last):
            a, b = ideal.slot(k, quota[i])
            heapq.heappush(waiting, (a // b, i, k))

    for i in range(len(quota)):
        wait(i, quota[i] * first)
    t = waiting[0][0] if waiting else 0
    while waiting or ready:
        while waiting and waiting[0][0] <= t:
            _, i, k = heapq.heappop(waiting)
            a, b = ideal.slot(k + 1, quota[i])
            heapq.heappush(ready, (-(-a // b), i, k))
        _, i, k = heapq.heappop(ready)
        out.append(i)
        wait(i, k + 1)
        t += 1
    return out


def schedule(blocks: list[int], weights: list[float]) -> list[Run]:
    """Runs of slots that place ``blocks[i]`` blocks of each source. Sources of weight 0 come after all others."""
    out: list[Run] = []
    at = 0
    some = [i for i in range(len(blocks)) if blocks[i] > 0]
    for active in ([i for i in some if weights[i] > 0], [i for i in some if not weights[i] > 0]):
        if not active:
            continue
        quota, own = whole_weights([weights[i] for i in active]), [blocks[i] for i in active]
        ideal = _Ideal(own, quota)
        cuts = sorted({0, *(f for x in ideal.ends for f in (x.numerator // x.denominator, -(-x.numerator // x.denominator)))})
        spans: list[tuple[int, int, bool]] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            same = b - a > 2  # nothing runs out on the way
            if not same and spans and not spans[-1][2]:
                a = spans.pop()[0]
            spans.append((a, b, same))
        for a, b, same in spans:
            line = array("l", (active[i] for i in _simulate(own, quota, ideal, a, a + 1 if same else b)))
            out.append(Run(at, b - a if same else 1, line))
            at += out[-1].times * len(line)
    return out


class _Places(NamedTuple):
    """How a source's blocks find their slots, run by run."""

    first: list[int]  # block
    start: list[int]  # slot
    every: list[int]  # slots of a period
    each: list[int]  # blocks of a period
    base: list[int]  # index of the period's first place
    place: array  # slots within their periods


def places(runs: list[Run], n: int) -> list[_Places]:
    out = [_Places([], [], [], [], [], array("q")) for _ in range(n)]
    done = [0] * n
    for run in runs:
        base = {i: len(out[i].place) for i in set(run.line)}
        for t, i in enumerate(run.line):
            out[i].place.append(t)
        for i, b in base.items():
            each = len(out[i].place) - b
            for field, value in zip(out[i][:5], (done[i], run.start, len(run.line), each, b), strict=True):
                field.append(value)
            done[i] += each * run.times
    return out


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_rows: int = BLOCK_ROWS, payload: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``payload`` columns) with ``block, slot, row_in_block``; columns of these names go.

    ``weights`` are target weights by source; sources without one or with 0 come when the
    others have run out. Without ``weights`` a source's weight is the number of its rows to the
    power POWER, in whole parts of WHOLE of the sum, at least one. A null source is a source of
    its own. Within a source rows are ordered by a hash of id and text hash, then by these;
    repeated rows, and rows with null ids or texts, are ordered alike and all placed. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    added = ("block", "slot", "row_in_block")
    keep = [c for c in payload or docs.columns if c not in added]
    counts = sorted(docs.groupBy("source").count().collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    if weights is None:
        powers = [r["count"] ** POWER for r in counts]
        own = [max(1, round(WHOLE * x / sum(powers))) for x in powers]
    else:
        own = [weights.get(r["source"], 0) for r in counts]
    found = places(schedule([-(-r["count"] // block_rows) for r in counts], own), len(counts))
    lines = spark.createDataFrame([(g, r["source"], r["count"], *x[:5]) for g, (r, x) in enumerate(zip(counts, found, strict=True))], "_g int, _source string, count long, _first array<long>, _start array<long>, _every array<long>, _each array<long>, _base array<long>")
    chunks = spark.createDataFrame([(g, a // CHUNK, list(x.place[a : a + CHUNK])) for g, x in enumerate(found) for a in range(0, len(x.place), CHUNK)], "_g int, _chunk long, _slots array<long>")
    if sum(len(x.place) for x in found) <= SENT:
        chunks = F.broadcast(chunks)
    has_text = "text" in docs.columns
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in keep]).alias("_row"), F.col("source").alias("_s"), F.col("doc_id").alias("_id"), (F.xxhash64("text") if has_text else F.lit(0)).alias("_h"))
    # a row a source, of its runs of slots
    numbered = rows.join(F.broadcast(lines.select("_g", "_source")), F.col("_s").eqNullSafe(F.col("_source"))).drop("_s", "_source")
    ranked = group_ranks(numbered, ["_g"], ["_id", "_h"], lines.select("_g", "count")).join(F.broadcast(lines.drop("_source", "count")), "_g")
    ranked = ranked.withColumn("_block", F.expr(f"_rank div {block_rows}")).withColumn("_run", F.expr("size(filter(_first, x -> x <= _block))"))

    def of(field: str) -> Column:
        return F.element_at(field, F.col("_run"))

    ranked = ranked.withColumn("_m", F.col("_block") - of("_first")).withColumn("_at", of("_base") + F.col("_m") % of("_each"))
    ranked = ranked.withColumn("_from", of("_start") + F.expr("_m div element_at(_each, _run)") * of("_every")).drop("_first", "_start", "_every", "_each", "_base")
    placed = ranked.withColumn("_chunk", F.expr(f"_at div {CHUNK}")).join(chunks, ["_g", "_chunk"])
    slot = F.col("_from") + F.expr(f"element_at(_slots, cast(_at % {CHUNK} as int) + 1)")
    return placed.select("_row.*", F.col("_block").alias("block"), slot.alias("slot"), F.expr(f"cast(_rank % {block_rows} as int)").alias("row_in_block"))


def in_schedule(docs: DataFrame) -> DataFrame:
    """``docs`` in the order of the schedule; its columns may have any names.

    Rows of null sources, ids and texts, and repeated rows, take part like all others; an empty
    table stays empty.
    """
    whole = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("whole_row")
    mixed = mix_sources(docs.select(whole, "source", "doc_id", "text"), payload=["whole_row"])
    return mixed.orderBy("slot", "row_in_block").select("whole_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_sources(docs, payload=["doc_id", "source"])
