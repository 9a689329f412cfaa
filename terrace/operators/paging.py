"""What goes on from page to page of a document: sentences broken by a page's end, and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.text import strip, text_or_empty
from terrace.operators.cleaning import HEAD_ENDS, NEW_UNIT, continuation_score, is_header, last_line, layout_score, table_text, width

LINE_ENDS = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85  ]"
BLOCK = ("x0", "y0", "x1", "y1", "page_height", "avg_font_size")


def outer_blocks(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page_number, first, last): the first and the last block with text of each page, as structs of BLOCK.

    ``blocks``: key, page_number, nth (place on the page), text and BLOCK; null where something is unknown.
    """
    box = F.struct(*BLOCK)
    return blocks.where(strip(text_or_empty("text")) != "").groupBy(key, "page_number").agg(F.min_by(box, "nth").alias("first"), F.max_by(box, "nth").alias("last"))


def _placed(block: Column) -> Column:
    """Whether a block's box is known; a box with a part missing counts as none."""
    known = F.lit(True)
    for c in BLOCK[:4]:
        known = known & block[c].isNotNull()
    return known


def join_sentences(pages: DataFrame, blocks: DataFrame | None = None, key: str = "doc_id", least: int = 2, most: int = 80) -> DataFrame:
    """(key, page_number, text, source_page, merged_text, merge_score): pages with the rest of a sentence moved back to the page it began on.

    A page's head moves up to its first sentence end within ``most`` characters of its first line, or whole if it is no longer than
    that; where neither holds, or the head begins a unit, or its score with the page before is below ``least``, nothing moves.
    Points for the layout need ``blocks`` as :func:`outer_blocks` takes them. The last three columns say what a page got, from
    which page and with what score. Pages are in order of number.

    A page's own head may have moved before the next one is looked at, which can leave another last line, or none. So each page has
    two answers, for the page before as it came and as that leaves it; which one holds follows from the last page whose answers
    agree and the number of pages since then whose answers turn the one before around.
    """
    w = Window.partitionBy(key).orderBy("page_number")
    came = strip(text_or_empty("text"))
    found = pages.select(key, "page_number", text_or_empty("text").alias("text"), came.alias("came"))
    ended = F.regexp_extract("came", rf"^([^\n]{{0,{most}}}?[{HEAD_ENDS}])", 1)
    found = found.withColumn("head", F.when(ended != "", ended).when(F.length("came") <= most, F.col("came")).otherwise(""))
    found = found.withColumn("left", strip(F.substring(F.col("came"), F.length("head") + 1, F.length("came"))))
    layout = F.lit(0)
    if blocks is not None:
        found = found.join(outer_blocks(blocks, key), [key, "page_number"], "left").withColumn("above", F.lag("last").over(w))
        last, first = F.col("above"), F.col("first")
        both = _placed(last) & _placed(first)
        layout = layout_score(F.when(both, last["y1"] / last["page_height"]), F.when(both, first["y0"] / first["page_height"]), F.when(both, last["x0"] - first["x0"]), last["avg_font_size"] - first["avg_font_size"])
    sides = {}
    for name, before in (("came", F.lag("came").over(w)), ("left", F.lag("left").over(w))):
        score = continuation_score(last_line(F.col(f"before_{name}")), F.col("came"), layout)
        may = (F.col(f"before_{name}") != "") & (F.col("head") != "") & ~F.col("came").rlike(NEW_UNIT) & (score >= least)
        found = found.withColumn(f"before_{name}", before)
        sides[name] = (score, F.coalesce(may, F.lit(False)))
    found = found.withColumns({f"{x}_{name}": c for name, pair in sides.items() for x, c in zip(("score", "may"), pair)})
    fixed = F.col("may_came") == F.col("may_left")
    since = found.withColumn("run", F.sum(F.when(fixed, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(key, "run").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    turned = F.sum(F.when(~fixed & F.col("may_came"), 1).otherwise(0)).over(own) % 2 == 1
    moved = since.withColumn("moved", F.first("may_came").over(own) != turned)
    moved = moved.withColumn("score", F.when(F.lag("moved", 1, False).over(w), F.col("score_left")).otherwise(F.col("score_came")))
    kept = moved.withColumn("own", F.when(F.col("moved"), F.col("left")).otherwise(F.col("text")))
    for name, c in (("got", F.when(F.col("moved"), F.col("head"))), ("from", F.when(F.col("moved"), F.col("page_number"))), ("points", F.when(F.col("moved"), F.col("score")))):
        kept = kept.withColumn(name, F.lead(c).over(w))
    lines = F.filter(F.split(strip("own"), LINE_ENDS), lambda x: strip(x) != "")
    glued = F.concat(F.regexp_replace(F.array_join(lines, "\n"), r"(?U)\s+\z", ""), F.regexp_replace("got", r"(?U)^\s+", ""))
    return kept.select(key, "page_number", F.when(F.col("got").isNotNull(), strip(glued)).otherwise(F.col("own")).alias("text"), F.col("from").alias("source_page"), F.col("got").alias("merged_text"), F.col("points").cast("int").alias("merge_score"))


#: A document's pages in order, with what the fold needs to know of their tables: the first, the last without an error, and the last of those after the first.
_TABLE = "struct<nth:int,ok:boolean,filled:boolean,high:boolean,titled:boolean,width:int,row:array<string>>"
_ACTIVE = "struct<page:int,nth:int,filled:boolean,width:int,row:array<string>>"
_STATE = f"struct<active:{_ACTIVE},merges:array<struct<page:int,nth:int,to_page:int,to_nth:int,again:boolean>>>"
_AS_ACTIVE = "named_struct('page', p.page, 'nth', {0}.nth, 'filled', {0}.filled, 'width', {0}.width, 'row', {0}.row)"
_SAME = "size(s.active.row) > 0 and s.active.row = p.first.row"
_GOES_ON = f"""s.active is not null and s.active.filled and p.first.filled and s.active.width > 0 and p.first.width > 0
  and abs(s.active.width - p.first.width) <= 1 and p.first.high and (({_SAME}) or not p.first.titled)"""
_FOLD = f"""aggregate(pages, cast(named_struct('active', null, 'merges', array()) as {_STATE}), (s, p) -> cast(case
  when p.first is null or not p.first.ok then named_struct('active', null, 'merges', s.merges)
  when {_GOES_ON} then named_struct(
    'active', case when p.rest is not null then {_AS_ACTIVE.format('p.rest')} else named_struct('page', s.active.page, 'nth', s.active.nth, 'filled', true, 'width', greatest(s.active.width, p.first.width), 'row', s.active.row) end,
    'merges', concat(s.merges, array(named_struct('page', p.page, 'nth', p.first.nth, 'to_page', s.active.page, 'to_nth', s.active.nth, 'again', {_SAME}))))
  else named_struct('active', case when p.last is null then null else {_AS_ACTIVE.format('p.last')} end, 'merges', s.merges) end as {_STATE}), s -> s.merges)"""


def table_merges(tables: DataFrame, pages: DataFrame, key: str = "doc_id", top: float = 150.0) -> DataFrame:
    """(key, page, nth, to_page, to_nth, again): tables that go on another one; ``again``: with its first row repeated.

    The first table of a page goes on the active one when both have rows, their widths differ by one column at most, it starts within
    ``top`` of its page, and it repeats the active one's first row or has no header of its own. The active table is the last sound
    one of the page before, with all that was put to it; pages without tables, or whose first table is an error, end it. Tables: key,
    page_number, table_index, y0 (null: unknown), rows, quality. Only first rows and widths of a document's tables meet in one row.
    """
    rows = F.coalesce(F.col("rows"), F.array().cast("array<array<string>>"))
    widest = F.coalesce(F.array_max(F.transform(rows, width)), F.lit(0))
    one = F.struct(
        F.col("table_index").cast("int").alias("nth"), F.coalesce(F.col("quality") != "error", F.lit(True)).alias("ok"), (F.size(rows) > 0).alias("filled"),
        F.coalesce(F.col("y0") <= top, F.lit(True)).alias("high"), F.coalesce(is_header(F.get(rows, F.lit(0)), F.get(rows, F.lit(1))), F.lit(False)).alias("titled"),
        widest.cast("int").alias("width"), F.coalesce(F.get(rows, F.lit(0)), F.array().cast("array<string>")).alias("row"),
    ).cast(_TABLE)
    sound = lambda t: F.element_at(F.filter(t, lambda x: x["ok"]), -1)
    here = tables.select(key, "page_number", one.alias("t")).groupBy(key, "page_number").agg(F.array_sort(F.collect_list("t")).alias("t"))
    last = lambda t: F.when(F.exists(t, lambda x: x["ok"]), sound(t))
    rest = F.slice("t", F.lit(2), F.greatest(F.size("t") - 1, F.lit(0)))
    here = here.select(key, "page_number", F.get("t", F.lit(0)).alias("first"), last(F.col("t")).alias("last"), last(rest).alias("rest"))
    whole = pages.select(key, "page_number").distinct().join(here, [key, "page_number"], "left")
    folded = whole.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("page_number").cast("int").alias("page"), "first", "last", "rest"))).alias("pages"))
    return folded.select(key, F.explode(F.expr(_FOLD)).alias("m")).select(key, "m.*")


def merge_tables(tables: DataFrame, pages: DataFrame, key: str = "doc_id", top: float = 150.0) -> DataFrame:
    """All tables, those that others go on with their rows: key, page_number, table_index, rows, text, merged_to_previous,
    merged_target_page, is_cross_page_merged, merged_pages.

    A repeated first row is left out of what is added. A table that goes on another keeps its rows and is marked; ``text`` is given
    where rows were added. ``pages`` (key, page_number) has pages without tables too.
    """
    merges = table_merges(tables, pages, key, top)
    went = tables.join(merges.select(key, F.col("page").alias("page_number"), F.col("nth").alias("table_index"), "to_page", "to_nth", "again"), [key, "page_number", "table_index"], "left")
    cut = F.when(F.col("again"), F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0)))).otherwise(F.col("rows"))
    added = went.where("to_page is not null").groupBy(key, F.col("to_page").alias("page_number"), F.col("to_nth").alias("table_index")).agg(F.array_sort(F.collect_list(F.struct("page_number", cut.alias("rows")))).alias("more"))
    found = went.join(added, [key, "page_number", "table_index"], "left")
    more = F.coalesce(F.col("more"), F.array().cast(added.schema["more"].dataType))
    rows = F.concat(F.col("rows"), F.flatten(F.transform(more, lambda x: x["rows"])))
    pages_ = F.concat(F.array(F.col("page_number").cast("long")), F.transform(more, lambda x: x["page_number"].cast("long")))
    out = found.select(
        key, "page_number", "table_index", F.when(F.col("more").isNull(), F.col("rows")).otherwise(rows).alias("rows"), F.col("to_page").isNotNull().alias("merged_to_previous"),
        F.col("to_page").alias("merged_target_page"), F.col("more").isNotNull().alias("is_cross_page_merged"), F.when(F.col("more").isNotNull(), pages_).alias("merged_pages"),
    )
    return out.withColumn("text", F.when(F.col("is_cross_page_merged"), table_text(F.col("rows"))))
