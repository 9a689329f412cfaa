"""The engine's tables as views of the given ones, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"
LEASE, HOURS, LONG = 12 * 3600, 7 * 24, 24 * 3600
SOURCE_TYPES = ("table", "text", "image_ocr_table", "image_ocr")


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")  # Spark 4.1 joins the parts of a union wrongly, or not at all
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # what is read again is written, so no job reads another's shuffle
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type").isin("signup", "click"), "pending").when(F.col("event_type") == "view", "running").when(F.col("event_type") == "purchase", "completed").otherwise("failed")
    attempts = F.get_json_object("props", "$.k").cast("int") % 4
    ts = F.col("ts").cast("timestamp_ntz")
    rows = e.select(F.col("event_id").alias("id"), F.concat(F.lit("kb"), F.col("user_id") % 20).alias("knowledge_base_id"), status.alias("status"), attempts.alias("attempt_count"), ts.alias("created_at"), ts.alias("updated_at"), "user_id")
    running = F.col("status") == "running"
    return rows.select("id", "knowledge_base_id", "status", "attempt_count", "created_at", "updated_at", F.when(running, F.col("created_at")).alias("started_at"), F.when(running, F.col("created_at")).alias("locked_at"), F.when(running, F.concat(F.lit("w"), F.col("user_id") % 5)).alias("locked_by"))


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.where("event_type = 'click'").select(F.col("event_id").alias("task_id"), F.lit("retrying").alias("event_type"), F.col("ts").cast("timestamp_ntz").alias("created_at"))


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "documents").select("source").distinct()
    return s.select(F.concat(F.lit("kb"), F.regexp_replace("source", "^src", "")).alias("knowledge_base_id"), F.col("source").alias("knowledge_base_name"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("sequence"), "role", F.col("text").alias("content"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def keyword_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.filter(F.split("text", " "), lambda w: w.rlike("^[a-z]{4,}$")))
    return read(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), words.alias("keywords"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


SQL = {
    "tasks": """SELECT event_id AS id, 'kb' || (user_id % 20) AS knowledge_base_id,
  CASE WHEN event_type IN ('signup', 'click') THEN 'pending' WHEN event_type = 'view' THEN 'running' WHEN event_type = 'purchase' THEN 'completed' ELSE 'failed' END AS status,
  CAST(json_extract_string(props, '$.k') AS INT) % 4 AS attempt_count, ts AS created_at, ts AS updated_at,
  CASE WHEN event_type = 'view' THEN ts END AS started_at, CASE WHEN event_type = 'view' THEN ts END AS locked_at, CASE WHEN event_type = 'view' THEN 'w' || (user_id % 5) END AS locked_by FROM events""",
    "task_events": "SELECT event_id AS task_id, 'retrying' AS event_type, ts AS created_at FROM events WHERE event_type = 'click'",
    "bases": "SELECT DISTINCT 'kb' || regexp_replace(source, '^src', '') AS knowledge_base_id, source AS knowledge_base_name FROM documents",
    "messages": "SELECT conv_id AS conversation_id, turn AS sequence, role, text AS content FROM conversations",
    "chunks": "SELECT doc_id AS chunk_id, text FROM documents",
    "kq": """SELECT item_id AS query_id, list_transform(list_sort(list_transform(list_distinct(ws), lambda w: {'p': list_position(ws, w), 'w': w})), lambda x: x.w) AS keywords
  FROM (SELECT item_id, list_filter(string_split(text, ' '), lambda w: regexp_full_match(w, '[a-z]{4,}')) AS ws FROM benchmark WHERE item_id % 50 = 0)""",
    "vectors": "SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings",
    "vq": "SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS query_vector FROM embeddings WHERE vec_id % 50 = 0",
}


def with_views(body: str, *names: str) -> str:
    """SQL with the named views before it."""
    recursive, body = ("RECURSIVE ", body[10:]) if body.startswith("RECURSIVE ") else ("", body)
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + ("," if body.lstrip().startswith(",") else "\n") + body.lstrip().removeprefix(",")
