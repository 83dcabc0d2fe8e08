"""Queries and oracle SQL of the corpus operators, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, html_text, jaccard_join, mixing, pieces, pii, quality_rules, secrets, sharding, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_sharding": sharding.op3_sharding,
    "op4_url_filters": url_filters.op4_url_filters,
    "op5_secrets": secrets.op5_secrets,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_mixing": mixing.op8_mixing,
    "op9_html_text": html_text.op9_html_text,
    "op10_pieces": pieces.op10_pieces,
    "viterbi_pieces": pieces.viterbi_pieces,
    "decoded_pieces": pieces.decoded_pieces,
}

ORACLES: dict[str, str] = {
    "op4_url_filters": url_filters.ORACLE_SQL,
    "op6_quality_rules": quality_rules.ORACLE_SQL,
}
