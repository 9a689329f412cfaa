"""From raw documents to packed training sequences, in five stages; each reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrace.llm import fuzzy_lines, mixing, ngram_join, ordinal, packing
from terrace.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade reaches the cutoff, by a model of the labelled ones among them.

    Null texts are scored as empty ones; rows that repeat are judged alike; without labelled documents the model knows nothing
    and gives all the same grade. Columns come back as they were, whatever their names.
    """
    model = ordinal.train(docs, ordinal.graded(table(spark, sf_dir, "labels")))
    return ordinal.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier one has in the same or nearly the same form.

    Earlier is by id, null first, then hash of the text and place. Null texts stay null; a text of which nothing is left is empty.
    """
    return fuzzy_lines.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of near copies.

    Null and blank texts are linked with nothing and stay; null ids come last; rows without a link stay though ids repeat.
    """
    return ngram_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it, 0 to 2.

    Texts without words have size 0 and are left out; a null source is one like others, the last; rows that repeat count each.
    """
    return mixing.repeat_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences: every id of every document once. Null and empty texts are the end id alone."""
    return packing.pack(docs, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources", mixture),
    ("packing", packed),
]

#: No stage but the mix's word counts can be written in SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
