"""Registered queries on routing to bases; rule tables come from the benchmark texts, bases from the documents' sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.functions.text import normalise
from terrace.operators import base_routing
from terrace.plans import fixtures as X
from terrace.plans.queries import NORMAL, RULES, query, word_rules

# Tables

_ITEMS = "it AS (SELECT item_id, list_filter(string_split(text, ' '), lambda w: regexp_full_match(w, '[a-z]{5,}')) AS w FROM benchmark)"
_TERMS = """rt AS (SELECT 'r' || r AS rule, kind, term, min(i) AS pos FROM (SELECT item_id % 12 AS r, CASE i % 4 WHEN 0 THEN 'match' WHEN 1 THEN 'alias' WHEN 2 THEN 'priority' ELSE 'exclude' END AS kind, w[i + 1] AS term, i FROM it, unnest(range(0, len(w))) AS u(i) WHERE i < 12) GROUP BY ALL),
qr AS (SELECT 'r' || (item_id % 12) AS rule, 'n' || item_id AS name, CASE WHEN item_id % 7 = 0 OR item_id % 6 = 5 THEN [] ELSE w[1:1] END AS all_of, CASE WHEN item_id % 7 = 0 OR item_id % 6 = 5 THEN [] ELSE w[2:4] END AS any_of,
  CASE WHEN item_id % 7 = 0 THEN [] ELSE w[5:5] END AS none_of, CAST(3 + item_id % 5 AS INT) AS boost FROM it),
ru AS (SELECT DISTINCT 'r' || (item_id % 12) AS rule, item_id % 12 AS pos, CASE WHEN item_id % 12 % 3 = 0 THEN 'cat' || (item_id % 12 % 7) ELSE '' END AS category FROM benchmark)"""
_BASES = """bs AS (SELECT *, CASE WHEN pos % 6 = 4 THEN 'failed' WHEN pos % 6 = 5 THEN 'indexing' ELSE 'ready' END AS status, CASE WHEN pos % 3 = 0 THEN 'd' || (pos % 4) ELSE '' END AS domain FROM (
  SELECT source AS name, min(lang) AS subject, arg_min(text[1:300], doc_id) AS description, row_number() OVER (ORDER BY min(doc_id)) - 1 AS pos FROM documents WHERE source IS NOT NULL GROUP BY 1)),
fl AS (SELECT source AS name, string_agg(f, ' ' ORDER BY n) AS files FROM (SELECT source, lang || '_' || doc_id || '.txt' AS f, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 8 GROUP BY 1)"""
_DOMAINS = "dm AS (SELECT DISTINCT 'd' || (length(keyword) % 4) AS category, length(keyword) % 4 AS pos, keyword FROM rl WHERE length(keyword) >= 9)"
_PROFILES = f"""{RULES}, {_ITEMS}, {_TERMS}, {_BASES}, {_DOMAINS},
pb AS (SELECT bs.*, {NORMAL.format("concat_ws(' ', bs.name, subject, description, files)")} AS plain FROM bs LEFT JOIN fl USING (name)),
bh AS (SELECT pb.name, rule, count(*) AS hits FROM pb JOIN rt ON kind = 'match' AND {NORMAL.format('term')} <> '' AND (contains(plain, {NORMAL.format('term')}) OR {NORMAL.format('term')} = {NORMAL.format('pb.name')}) GROUP BY ALL),
br AS (SELECT name, rule FROM bh JOIN ru USING (rule) QUALIFY row_number() OVER (PARTITION BY name ORDER BY hits DESC, ru.pos, rule) = 1),
ow AS (SELECT rule, string_agg(t, ' ' ORDER BY o, n, p, t) AS own FROM (SELECT rule, if(kind = 'alias', 0, 1) AS o, '' AS n, pos AS p, term AS t FROM rt WHERE kind IN ('alias', 'priority')
  UNION ALL SELECT rule, 2, name, i - 1, list_concat(all_of, any_of)[i] FROM qr, unnest(range(1, len(all_of) + len(any_of) + 1)) AS u(i)) GROUP BY 1),
pr AS (SELECT pb.*, rule, plain || coalesce({NORMAL.format('own')}, '') AS profile FROM pb LEFT JOIN br USING (name) LEFT JOIN ow USING (rule)),
dt AS (SELECT name, rl.category, min(rl.pos) AS pos, count(*) AS hits FROM pr JOIN rl ON contains(profile, keyword) GROUP BY ALL),
td AS (SELECT name, category AS told FROM dt QUALIFY row_number() OVER (PARTITION BY name ORDER BY hits DESC, pos, category) = 1),
pf AS (SELECT pr.*, coalesce(nullif(ru.category, ''), told) AS category, CASE WHEN ru.category <> '' AND ru.category IN (SELECT category FROM rl) THEN ru.category ELSE told END AS words FROM pr LEFT JOIN td USING (name) LEFT JOIN ru USING (rule))"""


def _words(spark: SparkSession, d: str) -> DataFrame:
    return X.read(spark, d, "benchmark").select("item_id", F.filter(F.split("text", " "), lambda w: w.rlike("^[a-z]{5,}$")).alias("w"))


def _rule(mod: Column) -> Column:
    return F.concat(F.lit("r"), mod)


def rule_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """All tables of :func:`base_routing.routes` but the questions."""
    items, docs, categories = _words(spark, d), X.read(spark, d, "documents"), word_rules(spark, d)
    r = F.col("item_id") % 12
    kind = F.element_at(F.array(*map(F.lit, ("match", "alias", "priority", "exclude"))), F.col("i") % 4 + 1)
    terms = items.select(_rule(r).alias("rule"), F.posexplode(F.slice("w", 1, 12)).alias("i", "term")).select("rule", kind.alias("kind"), "term", "i").groupBy("rule", "kind", "term").agg(F.min("i").alias("pos"))
    none, seventh, plain = F.array().cast("array<string>"), F.col("item_id") % 7 == 0, F.col("item_id") % 6 == 5
    clauses = items.select(
        _rule(r).alias("rule"), F.concat(F.lit("n"), "item_id").alias("name"), F.when(seventh | plain, none).otherwise(F.slice("w", 1, 1)).alias("all_of"), F.when(seventh | plain, none).otherwise(F.slice("w", 2, 3)).alias("any_of"),
        F.when(seventh, none).otherwise(F.slice("w", 5, 1)).alias("none_of"), (3 + F.col("item_id") % 5).cast("int").alias("boost"),
    )
    rules = items.select(_rule(r).alias("rule"), r.alias("pos"), F.when(r % 3 == 0, F.concat(F.lit("cat"), r % 7)).otherwise("").alias("category")).distinct()
    pos = F.row_number().over(Window.orderBy("first")) - 1  # of sources
    bases = docs.where("source is not null").groupBy("source").agg(F.min("lang").alias("subject"), F.min_by(F.substring("text", 1, 300), "doc_id").alias("description"), F.min("doc_id").alias("first")).withColumn("pos", pos)
    state = F.when(F.col("pos") % 6 == 4, "failed").when(F.col("pos") % 6 == 5, "indexing").otherwise("ready")
    bases = bases.select(F.col("source").alias("knowledge_base_id"), F.col("source").alias("name"), "subject", "description", "pos", state.alias("status"), F.when(F.col("pos") % 3 == 0, F.concat(F.lit("d"), F.col("pos") % 4)).otherwise("").alias("domain"))
    domains = categories.where(F.length("keyword") >= 9).select(F.concat(F.lit("d"), F.length("keyword") % 4).alias("category"), (F.length("keyword") % 4).cast("long").alias("pos"), "keyword").distinct()
    files = docs.select(F.col("source").alias("knowledge_base_id"), F.concat("lang", F.lit("_"), "doc_id", F.lit(".txt")).alias("filename"), F.col("doc_id").alias("created_at"))
    return {"bases": bases, "documents": files, "domains": domains, "categories": categories, "rules": rules, "rule_terms": terms, "query_rules": clauses}


def questions(spark: SparkSession, d: str) -> DataFrame:
    said = X.messages(spark, d).where("role = 'user'")
    return said.select(F.concat_ws("-", "conversation_id", "sequence").alias("query_id"), F.concat("content", F.lit(" src"), F.col("conversation_id") % 20).alias("query"), F.when(F.col("conversation_id") % 3 == 0, F.concat(F.lit("src"), F.col("conversation_id") % 7)).alias("requested"))


@query(f"WITH {_PROFILES} SELECT name AS knowledge_base_id, rule, category, words AS keyword_category, profile FROM pf")
def base_profiles(spark, d):
    t = rule_tables(spark, d)
    return base_routing.base_profiles(t["bases"], t["documents"], t["rules"], t["rule_terms"], t["query_rules"], t["categories"])


_CLAUSES = "len(all_of) + len(any_of) + len(none_of) > 0 AND len(list_filter(all_of, lambda t: NOT contains(q, t))) = 0 AND (len(any_of) = 0 OR len(list_filter(any_of, lambda t: contains(q, t))) > 0) AND len(list_filter(none_of, lambda t: contains(q, t))) = 0"


@query(f"WITH {_ITEMS}, {_TERMS}, q AS (SELECT doc_id, {NORMAL.format('text')} AS q FROM documents) SELECT doc_id AS query_id, rule, count(*) AS rules, CAST(sum(boost) AS BIGINT) AS boost FROM q, qr WHERE {_CLAUSES} GROUP BY ALL")
def boolean_rule_hits(spark, d):
    q = X.read(spark, d, "documents").select(F.col("doc_id").alias("query_id"), normalise("text").alias("q"))
    met = base_routing.clause_rules(q, rule_tables(spark, d)["query_rules"])
    return met.groupBy("query_id", "rule").agg(F.count("*").alias("rules"), F.sum("boost").cast("long").alias("boost"))


_SCORES = f"""{_PROFILES}, qs AS (SELECT conv_id || '-' || turn AS query_id, text || ' src' || (conv_id % 20) AS query, CASE WHEN conv_id % 3 = 0 THEN 'src' || (conv_id % 7) END AS requested FROM conversations WHERE role = 'user'),
qt AS (SELECT *, {NORMAL.format('query')} AS q, list_distinct(regexp_extract_all(lower(query), '[a-z0-9_]{{2,}}|[\\x{{4e00}}-\\x{{9fff}}]{{2,}}')) AS terms FROM qs),
qd AS (SELECT query_id, arg_min(category, (-hits, pos, category)) AS said FROM (SELECT query_id, category, pos, count(*) AS hits FROM qt JOIN dm ON contains(q, keyword) GROUP BY ALL) GROUP BY 1),
qc AS (SELECT query_id, arg_min(category, (-hits, pos, category)) AS q_category FROM (SELECT query_id, category, pos, count(*) AS hits FROM qt JOIN rl ON contains(q, keyword) GROUP BY ALL) GROUP BY 1),
lv AS (SELECT * FROM pf WHERE status IN ('ready', 'indexing')),
qa AS (SELECT qt.*, CASE WHEN said IN (SELECT domain FROM lv) THEN said END AS in_domain, q_category FROM qt LEFT JOIN qd USING (query_id) LEFT JOIN qc USING (query_id)),
tp AS (SELECT query_id, rule, sum(CASE kind WHEN 'alias' THEN 12 WHEN 'priority' THEN 6 ELSE -12 END) AS p FROM qt JOIN rt ON kind <> 'match' AND contains(q, {NORMAL.format('term')}) GROUP BY ALL),
cp AS (SELECT query_id, rule, sum(boost) AS p FROM qt, qr WHERE {_CLAUSES} GROUP BY ALL),
kw AS (SELECT query_id, lv.name, count(*) AS n FROM qa, lv JOIN rl ON rl.category = lv.words WHERE contains(q, keyword) AND contains(profile, keyword) GROUP BY ALL),
sc AS (SELECT qa.query_id, requested, lv.name, lv.pos, coalesce(8 * n, 0) + coalesce(list_sum(list_transform(list_filter(list_transform(terms, lambda t: {NORMAL.format('t')}), lambda t: length(t) >= 2 AND contains(profile, t)), lambda t: greatest(2, least(length(t), 6)))), 0)
  + if(requested = lv.name, 2, 0) + coalesce(tp.p, 0) + coalesce(cp.p, 0) + if(q_category = lv.category, 10, 0) AS score
  FROM qa JOIN lv ON in_domain IS NULL OR lv.domain = in_domain LEFT JOIN kw ON kw.query_id = qa.query_id AND kw.name = lv.name LEFT JOIN tp ON tp.query_id = qa.query_id AND tp.rule = lv.rule LEFT JOIN cp ON cp.query_id = qa.query_id AND cp.rule = lv.rule),
bt AS (SELECT query_id, any_value(requested) AS requested, arg_min(name, (-score, pos)) AS best, max(score) AS score, max(CASE WHEN name = requested THEN score END) AS own FROM sc GROUP BY 1)"""


@query(
    f"""WITH {_SCORES}, ch AS (SELECT *, coalesce(best <> requested AND score < own + 3, false) AS stays FROM bt)
SELECT query_id, if(stays, requested, best) AS knowledge_base_id, CAST(if(stays, own, score) AS BIGINT) AS score, if(stays, requested, best) IS DISTINCT FROM requested AS auto_routed FROM ch"""
)
def base_routes(spark, d):
    return base_routing.routes(questions(spark, d), **rule_tables(spark, d))
