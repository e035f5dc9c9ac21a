"""A corpus pipeline: toxicity, near copies, benchmark leaks, mixing, shards.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seatwise.llm import decontamination, jaccard_join, mixing, sharding, toxicity
from seatwise.llm.scratch import discard, materialise, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that a model of ``labels`` calls toxic.

    Rows of null and empty texts stay, repeated rows are judged alike, and without labels of
    both classes nothing goes unless all labels are toxic. An empty table stays empty.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts with 0.8 or more of their five-word shingles in common.

    The row of the least id stays (null last). Null, empty and blank texts are near nothing and
    all stay; of repeated rows one stays. An empty table stays empty.
    """
    return jaccard_join.keep_first(docs, shingle=5, num=80, den=100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows that hold a copy, exact or edited, of an item of ``benchmark``.

    Null and empty texts and items match nothing, repeated rows stay or go together, and an
    empty table of either kind changes nothing.
    """
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of a schedule of their sources; the last stage keeps it within a place.

    A null source is a source of its own; repeated rows and null ids and texts are placed like
    all others. An empty table stays empty.
    """
    return mixing.in_schedule(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with ``curve, shard, slot``, in 40 shards along a Hilbert curve.

    Null dimensions have bins of their own, and rows of one place keep the order of the files
    they come in. An empty table stays empty.
    """
    return sharding.shards_in_order(docs, sharding.DIMS, 40)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
    ("sharding", shard),
]

#: The first stage is a fitted model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``documents`` that all stages keep, with all columns and ``curve, shard, slot``.

    A stage's table goes once the next one's is written.
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
