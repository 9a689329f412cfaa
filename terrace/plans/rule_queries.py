"""Registered queries on rules with several terms, preserved candidates, checks of pages, resumed runs and test logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators import context, evaluation, retrieval, routing
from terrace.plans import fixtures as X
from terrace.plans.queries import query

_ITEMS = "it AS (SELECT item_id, list_filter(string_split(text, ' '), lambda w: regexp_full_match(w, '[a-z]{3,}')) AS w FROM benchmark)"


def items(spark: SparkSession, d: str) -> DataFrame:
    return X.read(spark, d, "benchmark").select("item_id", F.filter(F.split("text", " "), lambda w: w.rlike("^[a-z]{3,}$")).alias("w"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    return X.read(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


@query(
    f"""WITH {_ITEMS}, r AS (SELECT item_id AS pos, 'rule' || item_id AS rule, list_distinct(w[1:4]) AS t FROM it WHERE len(w) > 0)
SELECT doc_id AS query_id, arg_min(rule, pos) AS rule FROM documents JOIN r ON len(list_filter(t, lambda x: NOT contains(text, x))) = 0 GROUP BY 1"""
)
def first_rules(spark, d):
    rules = items(spark, d).where(F.size("w") > 0).select(F.col("item_id").alias("pos"), F.concat(F.lit("rule"), "item_id").alias("rule"), F.slice("w", 1, 4).alias("terms"))
    return routing.first_rule(asked(spark, d), rules)


@query(
    f"""WITH {_ITEMS}, c AS (SELECT item_id AS rule_id, i % 3 AS group_id, w[i] AS keyword FROM it, unnest(range(1, len(w) + 1)) AS u(i) WHERE i <= 9), g AS (SELECT rule_id, count(DISTINCT group_id) AS n FROM c GROUP BY 1),
m AS (SELECT doc_id, rule_id, count(DISTINCT group_id) AS n FROM documents JOIN c ON contains(text, keyword) GROUP BY ALL)
SELECT DISTINCT doc_id AS query_id, 'alias' || (rule_id % 20) AS alias FROM m JOIN g USING (rule_id, n)"""
)
def conditional_aliases(spark, d):
    clauses = items(spark, d).select(F.col("item_id").alias("rule_id"), F.posexplode(F.slice("w", 1, 9)).alias("i", "keyword")).select("rule_id", ((F.col("i") + 1) % 3).alias("group_id"), "keyword")
    aliases = items(spark, d).select(F.col("item_id").alias("rule_id"), F.concat(F.lit("alias"), F.col("item_id") % 20).alias("alias"))
    return routing.expand_conditional(asked(spark, d), clauses, aliases)


_POOL = """pl AS (SELECT doc_id % 40 AS query_id, doc_id AS chunk_id, split_part(text, chr(10), 1) AS child_text, lang || source AS parent_text FROM documents),
se AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS sel_rank FROM pl WHERE chunk_id % 7 = 0),
fr AS (SELECT * FROM pl WHERE NOT EXISTS (SELECT 1 FROM se WHERE se.query_id = pl.query_id AND se.child_text || se.parent_text = pl.child_text || pl.parent_text))"""


def pool(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Candidates of forty questions, and what is selected of them."""
    docs = X.read(spark, d, "documents")
    rows = docs.select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("chunk_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("child_text"), F.concat("lang", "source").alias("parent_text"))
    return retrieval.top(rows.where("chunk_id % 7 = 0"), ["query_id"], [F.asc("chunk_id")], 1 << 30, "sel_rank"), rows


def _kept(wanted: str, most: str) -> str:
    return f"""WITH {_POOL}, nw AS (SELECT * FROM fr WHERE {wanted} QUALIFY row_number() OVER (PARTITION BY query_id, child_text || parent_text ORDER BY chunk_id) = 1),
ad AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS n FROM nw QUALIFY n <= {most})
SELECT query_id, chunk_id, CAST(sel_rank AS INT) AS sel_rank FROM se UNION ALL SELECT query_id, chunk_id, CAST(n + coalesce((SELECT max(sel_rank) FROM se WHERE se.query_id = ad.query_id), 0) AS INT) FROM ad"""


@query(_kept("query_id % 2 = 0 AND (contains(child_text, 'the') OR contains(child_text, 'der') OR contains(parent_text, 'src3'))", "1000000000"))
def preserved_policy_docs(spark, d):
    selected, rows = pool(spark, d)
    found = retrieval.preserve_policy_docs(selected, rows, F.col("query_id") % 2 == 0, ["the", "der", "src3"], [F.asc("chunk_id")])
    return found.select("query_id", "chunk_id", F.col("sel_rank").cast("int").alias("sel_rank"))


@query(_kept("query_id % 3 = 0", "4"))
def preserved_overview_docs(spark, d):
    selected, rows = pool(spark, d)
    found = retrieval.preserve_overview_docs(selected, rows, F.col("query_id") % 3 == 0, [F.asc("chunk_id")])
    return found.select("query_id", "chunk_id", F.col("sel_rank").cast("int").alias("sel_rank"))


@query(
    f"""WITH {_ITEMS}, k AS (SELECT i - 1 AS page_number, CASE WHEN item_id % 2 = 0 THEN 'contains' ELSE 'lacks' END AS kind, w[i] AS wanted, item_id FROM it, unnest(range(1, 4)) AS u(i) WHERE i <= len(w)),
p AS (SELECT doc_id % 200 AS item_id, doc_id, n AS page_number, line AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(l) WITH ORDINALITY AS u(line, o), (SELECT 0) z(q), unnest([o - 1]) AS v(n) WHERE n < 2)
SELECT c.doc_id AS "case", CAST(k.page_number AS INT) AS page_number, kind, wanted, p.text IS NOT NULL AND contains(coalesce(p.text, ''), wanted) = (kind = 'contains') AS passed
FROM documents c JOIN k ON k.item_id = c.doc_id % 200 LEFT JOIN p ON p.doc_id = c.doc_id AND p.page_number = k.page_number"""
)
def page_checks(spark, d):
    """Pages are a document's first two lines; checks ask for a third page too, which fails."""
    docs = X.read(spark, d, "documents")
    pages = docs.select(F.col("doc_id").alias("case"), F.posexplode(F.slice(F.split("text", "\n"), 1, 2)).alias("page_number", "text"))
    checks = items(spark, d).select("item_id", F.when(F.col("item_id") % 2 == 0, "contains").otherwise("lacks").alias("kind"), F.posexplode(F.slice("w", 1, 3)).alias("page_number", "wanted"))
    checks = docs.select(F.col("doc_id").alias("case"), (F.col("doc_id") % 200).alias("item_id")).join(checks, "item_id").drop("item_id")
    return evaluation.page_checks(pages, checks).select("case", "page_number", "kind", "wanted", "passed")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unfinished_cases(spark, d):
    return evaluation.unfinished(X.read(spark, d, "documents").select("doc_id", "lang"), X.read(spark, d, "labels"), "doc_id")


@query("SELECT doc_id, greatest(n_chars - (length(lang) * 10 + length(source) * 100 + CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 500 END), 0) AS overhead_ms FROM documents")
def stage_overheads(spark, d):
    runs = X.read(spark, d, "documents").select("doc_id", "n_chars", (F.length("lang") * 10).alias("a"), (F.length("source") * 100).alias("b"), F.when(F.col("doc_id") % 3 != 0, 500).alias("c"))
    return context.stage_times(runs, "n_chars", ["a", "b", "c"]).select("doc_id", "overhead_ms")


@query(
    """SELECT doc_id, CAST(doc_id % 90 AS INT) AS passed, CAST(if(doc_id % 2 = 0, length(lang), 0) AS INT) AS failed, CAST(if(doc_id % 3 = 0, 1, 0) AS INT) AS errors, CAST(if(doc_id % 5 = 0, n_chars, 0) AS INT) AS skipped, CAST(doc_id % 100 + 0.25 AS DOUBLE) AS seconds FROM documents"""
)
def test_logs(spark, d):
    some = lambda n, value, word: F.when(F.col("doc_id") % n == 0, F.concat(F.lit(", "), value.cast("string"), F.lit(f" {word}"))).otherwise("")
    line = F.concat((F.col("doc_id") % 90).cast("string"), F.lit(" passed"), some(2, F.length("lang"), "failed"), some(3, F.lit(1), "error"), some(5, F.col("n_chars"), "skipped"), F.lit(" in "), (F.col("doc_id") % 100).cast("string"), F.lit(".25s"))
    return X.read(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in evaluation.test_log(line).items()])
