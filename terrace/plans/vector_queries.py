"""Registered queries on vectors kept in cells, a trained head, and payloads of unlike shape."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators import cells, payloads, training
from terrace.plans import fixtures as X
from terrace.plans.more_queries import RUNS, compared_runs
from terrace.plans.queries import ORACLES, query
from terrace.steps import shared_folder


@query(ORACLES["dense_l2_topk"])
def cell_dense_topk(spark, d):
    """The exact answer by cells: near ones first, then those that their radius doesn't rule out."""
    kept = cells.VectorCells(spark, f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}").build(X.vectors(spark, d).drop("label"), 16)
    return kept.search(X.vector_queries(spark, d), 15, exact=True)


def examples(spark: SparkSession, d: str) -> DataFrame:
    split = F.when(F.col("vec_id") % 5 == 0, "validation").otherwise("train")
    return X.read(spark, d, "embeddings").select("label", F.col("embedding").alias("vector"), split.alias("split"))


@query()
def trained_head_metrics(spark, d):
    """Rows only: 200 steps of an optimiser; tests hold its weights against a plain fit."""
    rows = examples(spark, d)
    return training.split_metrics(rows, training.train_head(rows))


#: Payloads of seven shapes from the events: whole, texts for numbers, nulls, other natures, cut off, nested texts, none.
PAYLOADS = """ev AS (SELECT event_id, event_id // 2 AS case_id, event_id % 2 AS side, json_extract_string(props, '$.k') AS k, CAST(user_id AS VARCHAR) AS u FROM events),
py AS (SELECT *, CASE event_id % 7 WHEN 0 THEN '{"hit": true, "score": ' || k || ', "debug": {"total_ms": ' || u || '}}' WHEN 1 THEN '{"hit": 1, "score": "' || k || '"}' WHEN 2 THEN '{"hit": false, "score": null, "debug": "none"}'
  WHEN 3 THEN '{"hit": "yes", "score": [1], "debug": {"total_ms": null}}' WHEN 4 THEN '{"hit": true, "score": ' || k WHEN 5 THEN '{"debug": {"total_ms": "' || k || '.5"}, "score": 0.' || k || '}' END AS p FROM ev),
vl AS (SELECT *, CASE WHEN json_valid(p) THEN CAST(p AS JSON) END AS j FROM py)"""


def told(spark: SparkSession, d: str) -> DataFrame:
    e = X.read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("user_id").cast("string").alias("u"))
    at = F.col("event_id") % 7
    text = (
        F.when(at == 0, F.concat(F.lit('{"hit": true, "score": '), "k", F.lit(', "debug": {"total_ms": '), "u", F.lit("}}"))).when(at == 1, F.concat(F.lit('{"hit": 1, "score": "'), "k", F.lit('"}')))
        .when(at == 2, '{"hit": false, "score": null, "debug": "none"}').when(at == 3, '{"hit": "yes", "score": [1], "debug": {"total_ms": null}}').when(at == 4, F.concat(F.lit('{"hit": true, "score": '), "k"))
        .when(at == 5, F.concat(F.lit('{"debug": {"total_ms": "'), "k", F.lit('.5"}, "score": 0.'), "k", F.lit("}")))
    )
    return payloads.parsed(e.select("event_id", F.expr("event_id div 2").alias("case_id"), (F.col("event_id") % 2).alias("side"), text.alias("p")), "p")


_NUMBER = "CASE json_type(j, '{0}') WHEN 'BOOLEAN' THEN if(json_extract_string(j, '{0}') = 'true', 1.0, 0.0) WHEN 'OBJECT' THEN 0.0 WHEN 'ARRAY' THEN 0.0 ELSE coalesce(TRY_CAST(json_extract_string(j, '{0}') AS DOUBLE), 0.0) END"
METRICS = {"hit": "$.hit", "score": "$.score", "latency": "$.debug.total_ms"}
_CHANGES = f"""{PAYLOADS}, nm AS (SELECT event_id, case_id, side, unnest(['hit', 'score', 'latency']) AS metric, unnest([{', '.join(f'CAST({_NUMBER.format(p)} AS DOUBLE)' for p in METRICS.values())}]) AS value FROM vl),
ch AS (SELECT metric, a.case_id, a.value AS baseline, b.value AS contender, CASE WHEN a.value = b.value THEN 'unchanged' WHEN (b.value > a.value) = (metric <> 'latency') THEN 'improved' ELSE 'regressed' END AS change
  FROM nm a JOIN nm b USING (metric, case_id) WHERE a.side = 0 AND b.side = 1)"""


def changes(spark: SparkSession, d: str) -> DataFrame:
    rows = told(spark, d)
    return payloads.case_changes(rows.where("side = 0"), rows.where("side = 1"), METRICS, ["latency"])


@query(f"WITH {_CHANGES} SELECT metric, case_id, baseline, contender, change FROM ch")
def case_changes(spark, d):
    return changes(spark, d)


@query(f"WITH {_CHANGES} SELECT metric, count(*) AS cases, round(avg(baseline), 4) AS baseline_avg, round(avg(contender), 4) AS contender_avg, round(avg(contender - baseline), 4) AS delta, count(*) FILTER (change = 'improved') AS improved, count(*) FILTER (change = 'regressed') AS regressed, count(*) FILTER (change = 'unchanged') AS unchanged FROM ch GROUP BY 1")
def change_summary(spark, d):
    return payloads.change_summary(changes(spark, d))


@query(
    f"""WITH {PAYLOADS}, en AS (SELECT event_id, j, unnest(json_keys(j)) AS key FROM vl WHERE j IS NOT NULL)
SELECT event_id, key, CASE json_type(j, '$.' || key) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'text' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS nature, false AS malformed FROM en
UNION ALL SELECT event_id, NULL, NULL, true FROM vl WHERE p IS NOT NULL AND j IS NULL"""
)
def payload_entries(spark, d):
    rows = told(spark, d)
    whole = payloads.entries(rows.where("payload is not null")).select("event_id", "key", payloads.nature(F.col("value")).alias("nature"), "malformed")
    return whole.union(rows.where("malformed").select("event_id", F.lit(None).cast("string"), F.lit(None).cast("string"), "malformed"))


@query(f"WITH {RUNS}, e AS (SELECT id, unnest(f) AS field FROM rn) SELECT id, field FROM e WHERE field IN ('lang', 'length')")
def drifted_cases(spark, d):
    return payloads.drifted_cases(compared_runs(spark, d), ["lang", "length"])
