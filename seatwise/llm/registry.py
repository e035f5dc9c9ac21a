"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, decontamination, fingerprints, jaccard_join, lm_scoring, mixing, secrets, sharding, spelling, suffix_dedup, toxicity, url_reputation, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_shards": sharding.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_url_reputation": url_reputation.query,
    "op4_secret_scan": secrets.query,
    "op5_jaccard_join": jaccard_join.query,
    "op6_pseudo_likelihood": lm_scoring.query,
    "op7_chunk_fingerprints": fingerprints.query,
    "op8_toxicity": toxicity.query,
    "op9_decontamination": decontamination.query,
    "op10_pfair_mixing": mixing.query,
    "op11_warc_chunks": warc.query,
    "op12_spelling_variants": spelling.query,
    "op13_collocations": collocations.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_suffix_dedup": suffix_dedup.ORACLE,
    "op3_url_reputation": url_reputation.ORACLE,
    "op5_jaccard_join": jaccard_join.ORACLE,
    "op11_warc_chunks": warc.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
