"""Exact deduplication against a persistent index of digests, bucketed and sorted by digest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import join_groups, noted, parts, scratch, settled, shared_dir, stored, table

#: Deleted before texts are compared: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: keep_row is the number of the row in its batch.
FIELDS = "text_sha256 string, keep_id bigint, keep_points bigint, group_size bigint, keep_row bigint"


def digest(text: Column) -> Column:
    """SHA-256 of the text without blanks."""
    return F.sha2(F.encode(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", ""), "UTF-8"), 256)


class DigestIndex:
    """A table of one row per distinct digest, bucketed and sorted by it, in a folder that outlives the session.

    Bucketing lets the anti-join of each new batch read the index without a shuffle or a sort of it. What later batches add to
    digests that the index has, their best rows and numbers, is appended to a second table of the same form; :meth:`current`
    has both, bucket by bucket.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, name: str | None = None) -> None:
        self.spark, self.path, self.buckets = settled(spark), path, buckets
        self.name = name or f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        self.later = f"{self.name}_later"
        for table_, folder in ((self.name, path), (self.later, f"{path}-later")):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {table_} ({FIELDS}) USING parquet CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {buckets} BUCKETS LOCATION '{folder}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def forget(self) -> None:
        """Drop the tables' names; their files stay."""
        for name in (self.name, self.later):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def rows(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, points, text_sha256, _row) of documents, stored: what a batch is about."""
        points = F.length(F.coalesce(F.col(text), F.lit(""))).cast("long")
        return stored(docs.select(F.col(key), points.alias("points"), digest(F.col(text)).alias("text_sha256")).withColumn("_row", F.monotonically_increasing_id()), "digests")

    def add(self, rows: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
        """Append the digests of a batch: new ones to the index, others to the later table. Returns the batch's digests, with the
        best row of each, and those that the index had."""
        best = F.min(F.struct((-F.col("points")).alias("p"), F.col(key).alias("k"), F.col("_row").alias("r")))
        batch = rows.groupBy("text_sha256").agg(best.alias("b"), F.count("*").alias("group_size"))
        batch = batch.select("text_sha256", F.col("b.k").cast("long").alias("keep_id"), (-F.col("b.p")).alias("keep_points"), "group_size", F.col("b.r").alias("_first"))
        batch = stored(batch.repartition(self.buckets, "text_sha256"), "digest-batch")
        known = self.table().select("text_sha256", F.col("keep_id").alias("_known_id"), F.col("group_size").alias("_known_size"))
        fresh = batch.hint("merge").join(known.hint("merge"), "text_sha256", "left_anti")
        old = stored(batch.hint("merge").join(known.hint("merge"), "text_sha256"), "digest-known")
        for found, name in ((fresh, self.name), (old, self.later)):
            found.select("text_sha256", "keep_id", "keep_points", "group_size", F.col("_first").alias("keep_row")).repartition(self.buckets, "text_sha256").write.insertInto(name)
            self.spark.catalog.refreshTable(name)
        return batch, old

    def current(self) -> DataFrame:
        """(text_sha256, keep_id, keep_points, group_size, keep_row) of all batches together: of equal texts the row of most code
        points, then least key (null first) and row, and how many rows there are."""
        first = F.min(F.struct((-F.col("keep_points")).alias("p"), F.col("keep_id").alias("k"), F.col("keep_row").alias("r")))
        both = self.table().union(self.spark.table(self.later)).groupBy("text_sha256").agg(first.alias("b"), F.sum("group_size").alias("group_size"))
        return both.select("text_sha256", F.col("b.k").alias("keep_id"), (-F.col("b.p")).alias("keep_points"), "group_size", F.col("b.r").alias("keep_row"))

    def ingest(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Append the digests that are new and return a row per document: its digest, whether it stays, and the row that does.

        Of equal texts in a batch the row of most code points, then least key stays; a text that the index has already is
        dropped for the indexed row. Null texts count as empty. Of rows repeated with the same key and text length all carry
        that key as ``keep_id`` and exactly one is kept. A null key sorts before all others. Other columns are ignored.
        """
        rows = self.rows(docs, key, text)
        batch, old = self.add(rows, key)
        seen = old.select("text_sha256", "_known_id", "_known_size")
        groups = batch.join(seen, "text_sha256", "left").select(
            "text_sha256", F.when(F.col("_known_size").isNull(), F.col("keep_id")).otherwise(F.col("_known_id")).alias("keep_id"),
            F.col("group_size"), F.when(F.col("_known_size").isNull(), F.col("_first")).alias("_first"),
        )
        joined = join_groups(rows, groups, "text_sha256", "group_size", rows.count())
        return joined.select(F.col(key), "keep_id", "group_size", F.coalesce(F.col("_row") == F.col("_first"), F.lit(False)).alias("kept"), "text_sha256", "points")


#: Batches in which the query gives its table to the index.
BATCHES = 2


def dedup_in_batches(docs: DataFrame, batches: int = BATCHES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256, points) of every row, after all were ingested in batches into a new index.

    Exactly one row of each group of equal texts is kept, also where keys are null, which sort before all others, or repeat.
    Null texts count as empty. The index is deleted when its answers are stored.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        path = noted(f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}")
        noted(f"{path}-later")
        index = DigestIndex(spark, path, max(16, parts(spark)))
        rows = keep(index.rows(docs, key, text))
        for i in range(batches):
            index.add(rows.where(F.pmod(F.xxhash64(key), F.lit(batches)) == i), key)
        best = keep(stored(index.current(), "digest-best"))
        index.forget()
    joined = join_groups(rows, best, "text_sha256", "group_size", rows.count())
    return joined.select(key, "keep_id", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"), "text_sha256", "points")


def op7_digest_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row of its text that stays, after all were ingested in batches into one index."""
    return dedup_in_batches(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_OP7 = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256, points FROM g
"""
