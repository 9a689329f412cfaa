"""Registered queries on what goes on over pages, held against SQL that takes a document's pages one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions import text as T
from terrace.operators import chunking, paging
from terrace.plans import fixtures as X

from terrace.plans.more_queries import _OPEN, _RESULT, _STRONG, _UNIT, CJK, IS_HEADER, STRIP, ZH_PAGES, chinese, chinese_pages
from terrace.plans.queries import BLOCKS, line_blocks, query

# Sentences

_HEAD = "CASE WHEN regexp_extract(n.text, '^([^\\n]{0,80}?[。！？；!?;])', 1) <> '' THEN regexp_extract(n.text, '^([^\\n]{0,80}?[。！？；!?;])', 1) WHEN length(n.text) <= 80 THEN n.text ELSE '' END"
_TAIL = STRIP.format("regexp_extract(w.own, '[^\\n]*$')")
_POINTS = f"""if(regexp_matches(tail, '[。！？；.!?;]$'), -1, 1) + if(regexp_matches(tail, '{_OPEN}'), 2, 0) + if(regexp_matches(text, '{_STRONG}'), 2, 0) + if(regexp_matches(text, '{_RESULT}'), 3, 0)
  + if(NOT regexp_matches(tail, '[。！？；.!?;]$') AND regexp_matches(tail, '{_OPEN}') AND (regexp_matches(text, '{_STRONG}') OR regexp_matches(text, '{_RESULT}') OR regexp_matches(text, '^[{CJK}]')), 1, 0)"""


@query(
    f"""WITH RECURSIVE {ZH_PAGES}, nm AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS i FROM pg),
bx AS (SELECT doc_id, CAST(page_number AS INT) AS page_number, arg_min(length(line), n) AS f, arg_max(length(line), n) AS l, min(n) % 8 AS fn, max(n) % 8 AS ln FROM pl GROUP BY ALL),
ly AS (SELECT *, if((lag(ln) OVER w * 100 + 90) / 800.0 >= 0.72, 1, 0) + if(fn * 100 / 800.0 <= 0.28, 1, 0) + if(abs(lag(l) OVER w % 40 - f % 40) <= 24, 1, 0) + if(lag(l) OVER w % 5 <> 4 AND f % 5 <> 4 AND abs(lag(l) OVER w % 5 - f % 5) <= 1.5, 1, 0) AS layout
  FROM bx WINDOW w AS (PARTITION BY doc_id ORDER BY page_number)),
walk AS (
  SELECT doc_id, i, page_number, text AS own, false AS moved, '' AS head, 0 AS score FROM nm WHERE i = 1
  UNION ALL
  SELECT doc_id, i, page_number, CASE WHEN may THEN {STRIP.format("substr(text, length(head) + 1)")} ELSE text END, may, head, score FROM (
    SELECT *, own <> '' AND head <> '' AND NOT regexp_matches(text, '{_UNIT}') AND score >= 2 AS may FROM (
      SELECT *, {_POINTS} + layout AS score FROM (
        SELECT n.doc_id, n.i, n.page_number, n.text, w.own, {_HEAD} AS head, {_TAIL} AS tail, layout FROM walk w JOIN nm n ON n.doc_id = w.doc_id AND n.i = w.i + 1 JOIN ly ON ly.doc_id = n.doc_id AND ly.page_number = n.page_number)))),
nx AS (SELECT *, lead(moved) OVER v AS got, lead(head) OVER v AS more, lead(page_number) OVER v AS page, lead(score) OVER v AS points FROM walk WINDOW v AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, page_number, CASE WHEN got THEN own || more ELSE own END AS text, CASE WHEN got THEN page END AS source_page, CASE WHEN got THEN more END AS merged_text, CAST(CASE WHEN got THEN points END AS INT) AS merge_score FROM nx"""
)
def joined_sentences(spark, d):
    lines = chinese(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("text", T.strip("line"))
    size, nth = F.length("text"), F.col("n") % 8
    blocks = lines.select(
        "doc_id", F.expr("cast(n div 8 as int)").alias("page_number"), nth.alias("nth"), "text", (size % 40).cast("double").alias("x0"), (nth * 100).cast("double").alias("y0"), F.lit(700.0).alias("x1"),
        (nth * 100 + 90).cast("double").alias("y1"), F.lit(800.0).alias("page_height"), F.when(size % 5 != 4, (size % 5).cast("double")).alias("avg_font_size"),
    )
    return paging.join_sentences(chinese_pages(spark, d), blocks)


# Tables

TABLES = f"""{BLOCKS}, gr AS (SELECT doc_id, CAST(page_number AS INT) AS page_number, CAST(floor(y0 / 4) AS INT) AS table_index, y0, list_transform(string_split(text, ','), lambda c: trim(c)) AS r FROM bl WHERE contains(text, ',')),
gt AS (SELECT doc_id, page_number, table_index, min(y0) * 40 AS y0, list(r ORDER BY y0) AS rows FROM gr GROUP BY ALL),
tb AS (SELECT doc_id, page_number, table_index, y0, CASE WHEN (doc_id + page_number) % 3 <> 0 THEN list_concat([['name', 'kind', 'n']], rows) ELSE rows END AS rows, CASE WHEN (doc_id * 7 + page_number) % 11 = 0 THEN 'error' ELSE 'normal' END AS quality FROM gt)"""


def page_tables(spark: SparkSession, d: str) -> DataFrame:
    """Lines with commas as rows, four lines to a table and two tables to a page, two thirds of the pages' with a header, some marked as errors."""
    cells = F.transform(F.split("text", ","), lambda c: F.trim(c))
    rows = line_blocks(spark, d).where(F.contains("text", F.lit(","))).select("doc_id", F.col("page_number").cast("int").alias("page_number"), F.expr("cast(floor(y0 / 4) as int)").alias("table_index"), "y0", cells.alias("r"))
    found = rows.groupBy("doc_id", "page_number", "table_index").agg((F.min("y0") * 40).alias("y0"), F.transform(F.array_sort(F.collect_list(F.struct("y0", "r"))), lambda x: x["r"]).alias("rows"))  # four lines
    head = F.array(F.array(F.lit("name"), F.lit("kind"), F.lit("n")))
    headed = F.when((F.col("doc_id") + F.col("page_number")) % 3 != 0, F.concat(head, "rows")).otherwise(F.col("rows"))
    return found.select("doc_id", "page_number", "table_index", "y0", headed.alias("rows"), F.when((F.col("doc_id") * 7 + F.col("page_number")) % 11 == 0, "error").otherwise("normal").alias("quality"))


_WIDTH = "coalesce(list_max(list_transform(rows, lambda r: coalesce(list_max(list_transform(range(1, len(r) + 1), lambda i: if(r[i] <> '', i, 0))), 0))), 0)"
_ONE = "{'nth': table_index, 'width': width, 'row': row, 'high': high, 'titled': titled, 'ok': ok}"


@query(
    f"""WITH RECURSIVE {TABLES},
hb AS (SELECT *, list_filter(coalesce(rows[1], []), lambda c: c <> '') AS head, list_filter(coalesce(rows[2], []), lambda c: c <> '') AS below FROM tb),
one AS (SELECT doc_id, page_number, table_index, CAST({_WIDTH} AS INT) AS width, rows[1] AS row, y0 <= 150 AS high, {IS_HEADER} AS titled, quality <> 'error' AS ok FROM hb),
per AS (SELECT doc_id, page_number, list({_ONE} ORDER BY table_index) AS t FROM one GROUP BY ALL),
pgs AS (SELECT doc_id, page_number, t, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS i FROM (SELECT DISTINCT doc_id, CAST(page_number AS INT) AS page_number FROM bl) LEFT JOIN per USING (doc_id, page_number)),
ps AS (SELECT *, t[1] AS f, list_filter(t, lambda x: x.ok)[-1] AS l, list_filter(t[2:], lambda x: x.ok)[-1] AS r FROM pgs),
walk AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS INT) AS page_number, CAST(NULL AS STRUCT(page INT, nth INT, width INT, row VARCHAR[])) AS a, false AS met, CAST(NULL AS INT) AS nth, CAST(NULL AS INT) AS to_page, CAST(NULL AS INT) AS to_nth, false AS again
  FROM (SELECT DISTINCT doc_id FROM ps)
  UNION ALL
  SELECT doc_id, i, page_number, CASE WHEN f IS NULL OR NOT f.ok THEN NULL WHEN goes_on AND r IS NOT NULL THEN {{'page': page_number, 'nth': r.nth, 'width': r.width, 'row': r.row}}
      WHEN goes_on THEN {{'page': a.page, 'nth': a.nth, 'width': greatest(a.width, f.width), 'row': a.row}} WHEN l IS NOT NULL THEN {{'page': page_number, 'nth': l.nth, 'width': l.width, 'row': l.row}} END,
    goes_on, f.nth, a.page, a.nth, same FROM (
    SELECT *, coalesce(f.ok AND a.width > 0 AND f.width > 0 AND abs(a.width - f.width) <= 1 AND f.high AND (same OR NOT f.titled), false) AS goes_on FROM (
      SELECT p.*, w.a, coalesce(w.a.row = p.f.row, false) AS same FROM walk w JOIN ps p ON p.doc_id = w.doc_id AND p.i = w.i + 1))),
mg AS (SELECT * FROM walk WHERE met),
ad AS (SELECT m.doc_id, m.to_page AS page_number, m.to_nth AS table_index, flatten(list(CASE WHEN again THEN rows[2:] ELSE rows END ORDER BY m.page_number)) AS more, list(m.page_number ORDER BY m.page_number) AS pages
  FROM mg m JOIN tb ON tb.doc_id = m.doc_id AND tb.page_number = m.page_number AND tb.table_index = m.nth GROUP BY ALL)
SELECT tb.doc_id, tb.page_number, tb.table_index, array_to_string(list_transform(list_concat(rows, coalesce(more, [])), lambda x: array_to_string(x, ',')), ';') AS rows, m.doc_id IS NOT NULL AS merged_to_previous, m.to_page AS merged_target_page,
  ad.doc_id IS NOT NULL AS is_cross_page_merged, CASE WHEN ad.doc_id IS NOT NULL THEN array_to_string(list_prepend(tb.page_number, pages), ',') END AS merged_pages
FROM tb LEFT JOIN mg m ON m.doc_id = tb.doc_id AND m.page_number = tb.page_number AND m.nth = tb.table_index LEFT JOIN ad ON ad.doc_id = tb.doc_id AND ad.page_number = tb.page_number AND ad.table_index = tb.table_index"""
)
def cross_page_tables(spark, d):
    pages = line_blocks(spark, d).select("doc_id", F.col("page_number").cast("int").alias("page_number"))
    found = paging.merge_tables(page_tables(spark, d), pages)
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";")
    return found.select("doc_id", "page_number", "table_index", rows.alias("rows"), "merged_to_previous", "merged_target_page", "is_cross_page_merged", F.array_join("merged_pages", ",").alias("merged_pages"))


# Markdown

_INLINE = "trim(regexp_replace(regexp_replace(regexp_replace({0}, '\\*\\*(.*?)\\*\\*', '\\1', 'g'), '__(.*?)__', '\\1', 'g'), '`([^`]+)`', '\\1', 'g'))"
#: Lines as Markdown by their place: titles, chapters, sections, tables of contents, lists, articles and rules.
MARKDOWN = f"""md AS (SELECT doc_id, i, CASE WHEN doc_id % 4 = 0 AND i = 9 THEN '## 目录' WHEN i % 9 = 1 THEN '# ' || left(s, 20) WHEN i % 9 = 4 THEN '## **' || left(s, 12) || '**' WHEN i % 9 = 6 THEN '### ' || left(s, 9)
  WHEN i % 9 = 7 THEN '- ' || s WHEN i % 9 = 8 THEN '**第' || i || '条** ' || s WHEN i % 9 = 0 THEN '---' ELSE s END AS s
  FROM (SELECT doc_id, i, {STRIP.format('l[i]')} AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(i)) WHERE s <> ''),
mn AS (SELECT doc_id, {STRIP.format('s')} AS s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM md)"""


def markdown(spark: SparkSession, d: str) -> DataFrame:
    lines = X.read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("doc_id", (F.col("n") + 1).alias("i"), T.strip("line").alias("s")).where("s != ''")
    at, part = F.col("i") % 9, lambda n: F.substring("s", 1, n)
    line = (
        F.when((F.col("doc_id") % 4 == 0) & (F.col("i") == 9), "## 目录").when(at == 1, F.concat(F.lit("# "), part(20))).when(at == 4, F.concat(F.lit("## **"), part(12), F.lit("**"))).when(at == 6, F.concat(F.lit("### "), part(9)))
        .when(at == 7, F.concat(F.lit("- "), "s")).when(at == 8, F.concat(F.lit("**第"), F.col("i").cast("string"), F.lit("条** "), "s")).when(at == 0, "---").otherwise(F.col("s"))
    )
    rows = lines.select("doc_id", "i", line.alias("line")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("x"))  # one text's lines
    return rows.select("doc_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"))


@query(
    f"""WITH RECURSIVE {MARKDOWN},
k AS (SELECT *, length(regexp_extract(s, '^(#{{1,6}})\\s', 1)) AS lvl, {_INLINE.format("regexp_extract(s, '^#{1,6}\\s+(.*)$', 1)")} AS name, s = '---' AS rule, regexp_matches(s, '^\\*\\*第[一二两三四五六七八九十百千0-9]+条\\*\\*') AS mark FROM mn),
walk AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS n, '' AS t, '' AS c, '' AS h, false AS toc, false AS open, -1 AS sec, CAST(NULL AS VARCHAR) AS added FROM (SELECT DISTINCT doc_id FROM mn)
  UNION ALL
  SELECT doc_id, n, CASE WHEN lvl = 1 THEN name ELSE t END, CASE WHEN lvl = 1 OR contents THEN '' WHEN lvl = 2 THEN name ELSE c END, CASE WHEN lvl IN (1, 2) OR contents THEN '' WHEN lvl >= 3 THEN name ELSE h END,
    CASE WHEN lvl = 1 THEN false WHEN contents THEN true WHEN lvl = 2 THEN false ELSE toc END, CASE WHEN rule OR lvl > 0 THEN false WHEN body THEN true ELSE open END, sec + if(opens, 1, 0),
    CASE WHEN opens THEN concat_ws(chr(10), nullif(t, ''), nullif(c, ''), nullif(h, ''), line) WHEN body THEN line END FROM (
      SELECT *, body AND (mark OR NOT open) AS opens, CASE WHEN mark THEN trim(regexp_replace(s, '^\\*\\*(第[^*]+条)\\*\\*\\s*', '\\1 ')) ELSE regexp_replace({_INLINE.format('s')}, '^[*-]\\s+', '') END AS line FROM (
        SELECT k.*, w.t, w.c, w.h, w.toc, w.open, w.sec, lvl >= 2 AND name = '目录' AS contents, lvl = 0 AND NOT rule AND NOT w.toc AS body FROM walk w JOIN k ON k.doc_id = w.doc_id AND k.n = w.n + 1)))
SELECT doc_id, sec AS section, string_agg(added, chr(10) ORDER BY n) AS body FROM walk WHERE added IS NOT NULL GROUP BY ALL"""
)
def markdown_section_texts(spark, d):
    return chunking.markdown_sections(markdown(spark, d)).select("doc_id", "section", "body")
