"""Registered queries on the kept full-text index, held against SQL that counts phrases and words in the texts that are left."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators import lexical
from terrace.operators.retrieval import B, K1
from terrace.plans import fixtures as X
from terrace.plans.fixtures import with_views
from terrace.plans.queries import query
from terrace.steps import shared_folder

_OLD, _GONE = 7, 11


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks: the first line is the child, the whole text its parent."""
    return X.read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("child_text"), F.col("text").alias("parent_text"), F.col("source").alias("document_id"))


def kept_index(spark: SparkSession, d: str) -> lexical.LexicalIndex:
    """An index in two batches: all chunks, some with texts that are out of date; then these anew, and others deleted."""
    index = lexical.LexicalIndex(spark, f"{shared_folder(spark)}/lexical-{uuid.uuid4().hex}", 16)
    rows = chunks(spark, d)
    old = F.col("chunk_id") % _OLD == 0
    index.update(rows.withColumns({c: F.when(old, F.reverse(c)).otherwise(F.col(c)) for c in ("child_text", "parent_text")}))
    index.update(rows.where(old & (F.col("chunk_id") % _GONE != 0)), rows.where(F.col("chunk_id") % _GONE == 0).select("chunk_id"))
    return index


def phrase_queries(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of one to three words, from every benchmark text."""
    w = F.filter(F.split("text", " "), lambda x: x.rlike(r"^[A-Za-z]+[,.]?$"))
    run = lambda *at: F.array_join(F.array(*[F.get("w", F.lit(i)) for i in at]), " ")
    keys = F.array(run(0, 1), run(2), run(3, 4, 5), run(6, 7), run(8))
    return X.read(spark, d, "benchmark").select("item_id", w.alias("w")).where(F.size("w") >= 9).select(F.col("item_id").alias("query_id"), keys.alias("keywords"))


_TOKENS = r"list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^\p{{L}}\p{{N}}\p{{Co}}]+'), lambda x: x <> '')"
_CHUNKS = f"""cs AS (SELECT doc_id AS chunk_id, split_part(text, chr(10), 1) AS child_text, text AS parent_text FROM documents WHERE doc_id % {_GONE} <> 0),
tk AS (SELECT *, {_TOKENS.format('child_text')} AS own, {_TOKENS.format('parent_text')} AS above FROM cs), al AS (SELECT *, list_concat(own, above) AS a FROM tk)"""
_PHRASES = r"pq AS (SELECT item_id AS query_id, [w[1] || ' ' || w[2], w[3], w[4] || ' ' || w[5] || ' ' || w[6], w[7] || ' ' || w[8], w[9]] AS keywords FROM (SELECT item_id, list_filter(string_split(text, ' '), lambda x: regexp_full_match(x, '[A-Za-z]+[,.]?')) AS w FROM benchmark) WHERE len(w) >= 9)"

#: Every word of every text with its place, for each of the three fields; the words of a phrase must follow each other in one field.
PHRASES = f"""WITH {_CHUNKS}, {_PHRASES},
fd AS (SELECT chunk_id, 0 AS f, own AS t FROM al UNION ALL SELECT chunk_id, 1, above FROM al UNION ALL SELECT chunk_id, 2, a FROM al),
ps AS (SELECT DISTINCT phrase, {_TOKENS.format('phrase')} AS t FROM (SELECT unnest(keywords) AS phrase FROM pq)),
pt AS (SELECT phrase, len(t) AS m, i - 1 AS i, t[i] AS token FROM ps, unnest(range(1, len(t) + 1)) AS u(i)),
pl AS (SELECT chunk_id, f, p, t[p] AS token FROM fd, unnest(range(1, len(t) + 1)) AS u(p)),
ht AS (SELECT phrase, chunk_id, f, p - i AS s FROM pl JOIN pt USING (token) GROUP BY phrase, chunk_id, f, p - i, m HAVING count(*) = m),
tf AS (SELECT phrase, chunk_id, count(*) AS tf FROM ht GROUP BY ALL), df AS (SELECT phrase, count(*) AS df FROM tf GROUP BY 1),
st AS (SELECT count(*) AS n, sum(2 * len(a)) / count(*) AS mean FROM al),
sc AS (SELECT query_id, chunk_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), {lexical.LEAST_IDF}) * tf * {lexical.PHRASE_K1 + 1} / (tf + {lexical.PHRASE_K1} * ({1 - lexical.PHRASE_B} + {lexical.PHRASE_B} * 2 * len(a) / mean))), 6) AS score
  FROM (SELECT query_id, unnest(keywords) AS phrase FROM pq) JOIN tf USING (phrase) JOIN df USING (phrase) JOIN al USING (chunk_id), st GROUP BY ALL)"""


@query(
    f"""{PHRASES}, fs AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 100),
h AS (SELECT query_id, chunk_id, score, child_text, len(list_filter(keywords, lambda k: contains(child_text || chr(10) || parent_text, k))) AS h FROM fs JOIN pq USING (query_id) JOIN cs USING (chunk_id))
SELECT query_id, chunk_id, CAST(h AS INT) AS keyword_hit_count, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY h DESC, score DESC, length(child_text) DESC, chunk_id) AS INT) AS rank FROM h WHERE h >= 2 QUALIFY rank <= 5"""
)
def phrase_topk(spark, d):
    return lexical.phrase_search(kept_index(spark, d), phrase_queries(spark, d), 5)


@query(
    with_views(
        f""", {_CHUNKS}, q AS (SELECT DISTINCT query_id, unnest({_TOKENS.format("array_to_string(keywords, ' ')")}) AS token FROM kq),
ix AS (SELECT chunk_id, len(a) AS size, token, count(*) AS tf FROM (SELECT chunk_id, a, unnest(a) AS token FROM al) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(a)) AS mean FROM al), df AS (SELECT token, count(*) AS df FROM ix GROUP BY 1),
s AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * size / mean)))), 6) AS score FROM q JOIN ix USING (token) JOIN df USING (token), st GROUP BY ALL)
SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= 15""",
        "kq",
    )
)
def term_index_topk(spark, d):
    return lexical.word_search(kept_index(spark, d), X.keyword_queries(spark, d), 15)


@query(
    f"""WITH {_CHUNKS}, {_PHRASES} SELECT query_id, keywords[3] AS phrase, count(*) AS chunks FROM pq, al WHERE contains(' ' || array_to_string(a, ' ') || ' ', ' ' || array_to_string({_TOKENS.format('keywords[3]')}, ' ') || ' ') GROUP BY ALL"""
)
def phrase_counts(spark, d):
    """How many chunks have the longest keyword of each query as a phrase, by the index."""
    asked = phrase_queries(spark, d).select("query_id", F.get("keywords", F.lit(2)).alias("phrase"))
    found = lexical.phrase_starts(kept_index(spark, d), asked).select("phrase", "chunk_id")
    return asked.join(found, "phrase").groupBy("query_id", "phrase").agg(F.count("*").alias("chunks"))
