"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrace.llm import brown, centroids, exact_dedup, fuzzy_lines, matroska, mixing, ngram_join, ordinal, packing, repair, secrets, sharding, warc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: tuple[Query, ...] = (
    sharding.op1_hash_tree_sharding,
    fuzzy_lines.op2_fuzzy_line_dedup,
    matroska.op3_matroska_packets,
    packing.op4_mixture_packing,
    secrets.op5_forest_secret_scan,
    warc.op6_warc_salvage,
    exact_dedup.op7_digest_index_dedup,
    ngram_join.op8_ngram_jaccard_join,
    ordinal.op9_ordinal_quality,
    mixing.op10_flow_mixing,
    centroids.op11_pca_filtered_clusters,
    brown.op12_brown_class_scores,
    repair.op13_survivor_repair,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    """The other operators hash, learn or tokenize in ways that SQL can't state; the tests hold them against brute force."""
    return {
        "op6_warc_salvage": warc.ORACLE_OP6,
        "op7_digest_index_dedup": exact_dedup.ORACLE_OP7,
        "op8_ngram_jaccard_join": ngram_join.ORACLE_OP8,
        "op11_pca_filtered_clusters": centroids.ORACLE_OP11,
        "op13_survivor_repair": repair.ORACLE_OP13,
    }
