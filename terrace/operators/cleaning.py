"""Pages to clean text: lines, contents pages, repeated headers, sentences broken over pages, tables and OCR."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.text import TERMINALS, clean_lines, contains_any, ends_any, starts_any, strip, text_or_empty

# What begins a unit of a document, what goes on from the text before, and what leaves a text open.
NEW_UNITS = (
    "第[一二两三四五六七八九十百千0-9]+[章节条]",
    "[一二两三四五六七八九十百千0-9]+[章节条]",
    "[一二三四五六七八九十]+、",
    r"[0-9]+[\.．、]",
    "（[一二三四五六七八九十0-9]+）",
    r"[\(（][0-9]+[\)）]",
    r"(?:目录|附则|总则|说明|备注|附件|附录)(?:\s|[:：]|$)",
)
NEW_UNIT = f"^(?:{'|'.join(NEW_UNITS)})"
GOES_ON = ("的", "并", "且", "或", "及", "与", "而", "但", "由", "按", "扣", "处", "给予", "进行")
STRONG = ("的", "并", "且", "或", "及", "与", "而", "但", "同时", "其中", "上述", "该", "本项", "本条")
RESULTS = ("扣", "按", "由", "处", "给予", "进行", "视为", "记", "罚", "取消", "不得", "可以")
OPEN_MARKS = ("，", "、", "：", "（", "《", "【", "(")
OPEN_WORDS = ("按", "由", "为", "与", "和", "及", "或", "并", "但", "而", "扣", "处", "给予", "进行", "视为", "不得", "可以", "应当", "应", "未", "不", "被", "将")
PAGE_ENDS, HEAD_ENDS = "。！？；.!?;", "。！？；!?;"
TOC_UNIT = r"^(第[一二两三四五六七八九十百千0-9]+[章节]|[一二两三四五六七八九十]+、|[0-9]+[\.．、]|[（(][一二两三四五六七八九十0-9]+[）)]).+[0-9]+\s*$"
HEADER_WORDS = (
    "序号", "项目", "类别", "类型", "名称", "行为", "情形", "条件", "内容", "要求", "标准", "规则", "依据", "条款", "处理", "方式", "结果", "说明",
    "备注", "分值", "扣分", "处罚", "奖励", "部门", "人员", "对象", "范围", "日期", "时间", "金额", "费用", "考核", "指标", "状态", "责任",
)
SENTENCE_MARKS = "，。；：,.!?！？（）()"
VALUES = (r"[-+]?[0-9]+(\.[0-9]+)?", "[0-9]{4}[-/年][0-9]{1,2}([-/月][0-9]{1,2}日?)?", "[0-9]{1,2}[:：][0-9]{1,2}([:：][0-9]{1,2})?")
AMOUNTS = (r"[0-9]+\s*(元|万元|%|分/次|分/天|分|次|天|小时|分钟)", r"(扣|罚|奖励|赔偿|补贴|报销)\s*[0-9]+")
OCR_NUMBER = r"([0-9Oo〇Il|１２３４５６７８９０]+)\s*(分|分钟|页|条|次|天)"
OCR_DIGITS = ("Oo〇Il|１２３４５６７８９０", "0001111234567890")
OCR_VALUES = ("扣[0-9]+分/(?:次|天)", "如有违反扣[0-9]+分/(?:次|天)", "第[一二三四五六七八九十]+次.*")
OCR_SANCTIONS = ("通报批评", "予以开除", "保证书")
OCR_HEADERS, OCR_TITLE = ("序号", "扣分", "具体扣分项"), "课堂纪律"
CJK = "一-鿿"


def merges(before: Column, after: Column) -> Column:
    """Whether a line goes on in the next: it doesn't end a sentence, and both sides are Chinese or the next begins as a continuation."""
    joined = before.rlike(f"[{CJK}]$") & after.rlike(f"^[{CJK}]")
    return (before != "") & (after != "") & ~before.rlike(f"[{TERMINALS}]$") & (joined | starts_any(after, GOES_ON))


def paragraph(c: Column | str) -> Column:
    """Lines joined where a sentence goes on, then blanks beside Chinese characters and marks removed.

    Whether lines are joined depends on the two alone, as a joined text ends as its last line does.
    """
    lines = clean_lines(c)
    before = F.concat(F.array(F.lit("")), lines)  # one longer: its last has no line after it
    out = F.array_join(F.zip_with(before, lines, lambda b, x: F.concat(F.when((b == "") | merges(b, x), "").otherwise("\n"), x)), "")
    marks = "，。；：、！？"
    for pattern, to in (
        (r"分/\s*\n\s*次", "分/次"), (rf"(?<=[{CJK}])\s+(?=[{marks}）】》])", ""), (rf"(?<=[（【《])\s+(?=[{CJK}])", ""), (rf"(?<=[{marks}（【《])\s+(?=[{CJK}])", ""),
        (rf"(?<=[{CJK}])\s+(?=[{CJK}])", ""), (rf"(?<=[{CJK}])\s+(?=[0-9])", ""), (rf"(?<=[0-9])\s+(?=[{CJK}])", ""), (r"[ \t]+", " "),
    ):
        out = F.regexp_replace(out, pattern, to)
    return strip(out)


def is_contents_item(line: Column) -> Column:
    """A line of a table of contents: it ends in a number after dots, wide blanks or the name of a unit."""
    compact = F.trim(F.regexp_replace(line, r"(?U)\s+", " "))
    by_mark = compact.rlike(r"[.．·•…]{2,}\s*[0-9]+\s*$") | line.rlike(r"\s{2,}[0-9]+\s*$") | compact.rlike(TOC_UNIT)
    return F.length(compact).between(4, 120) & compact.rlike(r"[0-9]+\s*$") & by_mark


def contents_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Pages with is_toc_page, and their text emptied where true.

    A title in the first three lines and two items, or three items that make up 45 % of the lines.
    """
    lines = clean_lines("text")
    items = F.size(F.filter(lines, is_contents_item))
    titled = F.exists(F.slice(lines, 1, 3), lambda x: x.rlike(r"^目\s*录$"))
    toc = F.coalesce((titled & (items >= 2)) | ((items >= 3) & (items >= 0.45 * F.size(lines))), F.lit(False))
    return pages.withColumn("is_toc_page", toc).withColumn("text", F.when(F.col("is_toc_page"), "").otherwise(text_or_empty("text")))


def repeated_noise(blocks: DataFrame, key: str = "doc_id", most_length: int = 80, least_pages: int = 3, ratio: float = 0.5, x_spread: float = 50.0, y_spread: float = 0.06) -> DataFrame:
    """(key, text) of headers and footers: short texts on half of a document's pages, three at least, at one place of the page.

    ``blocks``: key, page_number, text, x0, y0, page_height. Table rows and texts that begin a unit stay.
    """
    size = blocks.groupBy(key).agg(F.count_distinct("page_number").alias("pages"))
    short = blocks.withColumn("text", strip("text")).where((F.col("text") != "") & (F.length("text") <= most_length) & ~F.contains("text", F.lit("|")) & ~F.col("text").rlike(NEW_UNIT))
    y = F.col("y0") / F.col("page_height")
    seen = short.groupBy(key, "text").agg(F.count_distinct("page_number").alias("on"), (F.max("x0") - F.min("x0")).alias("dx"), (F.max(y) - F.min(y)).alias("dy"))
    found = seen.join(size, key).where((F.col("pages") >= least_pages) & (F.col("on") >= F.greatest(F.lit(least_pages), F.ceil(F.col("pages") * ratio))))
    return found.where((F.coalesce("dx", F.lit(0.0)) <= x_spread) & (F.coalesce("dy", F.lit(0.0)) <= y_spread)).select(key, "text")


def without_noise(blocks: DataFrame, noise: DataFrame, key: str = "doc_id") -> DataFrame:
    return blocks.withColumn("_text", strip("text")).join(noise.select(key, F.col("text").alias("_text")), [key, "_text"], "left_anti").drop("_text")


def layout_score(bottom: Column, top: Column, indent: Column, font: Column) -> Column:
    """A point each for text that ends low, goes on high, at nearly the same indent and font size; unknown counts nothing."""
    return sum((F.when(c, 1).otherwise(0) for c in (bottom >= 0.72, top <= 0.28, F.abs(indent) <= 24, F.abs(font) <= 1.5)), F.lit(0))


def continuation_score(tail: Column, head: Column, layout: Column | None = None) -> Column:
    """How strongly the head of a page goes on from the last line of the one before; 2 is enough to join them."""
    ended = tail.rlike(f"[{PAGE_ENDS}]$")
    open_ = ends_any(tail, OPEN_MARKS + OPEN_WORDS)
    strong = starts_any(head, STRONG)
    result = starts_any(head, RESULTS) | head.rlike(r"^(扣除|扣减)?[0-9]+\s*分")
    plain = ~ended & open_ & (strong | result | head.rlike(f"^[{CJK}]"))
    score = F.when(ended, -1).otherwise(1) + F.when(open_, 2).otherwise(0) + F.when(strong, 2).otherwise(0) + F.when(result, 3).otherwise(0) + F.when(plain, 1).otherwise(0)
    return score + (layout if layout is not None else F.lit(0))


def last_line(c: Column | str) -> Column:
    """The last line that isn't blank, stripped; empty for none."""
    return F.coalesce(F.try_element_at(clean_lines(c), F.lit(-1)), F.lit(""))


def outside_tables(blocks: DataFrame, tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks whose box (x0, y0, x1, y1) meets no table's box on the same page."""
    t = tables.select(F.col(key).alias("_k"), F.col("page_number").alias("_p"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    meets = (F.col(key) == F.col("_k")) & (F.col("page_number") == F.col("_p")) & (F.col("x0") < F.col("_x1")) & (F.col("_x0") < F.col("x1")) & (F.col("y0") < F.col("_y1")) & (F.col("_y0") < F.col("y1"))
    return blocks.join(t, meets, "left_anti")


def margins(blocks: DataFrame, top: float = 0.05, bottom: float = 0.06) -> DataFrame:
    """Blocks that aren't in a page's margins and aren't page numbers."""
    inside = (F.col("y1") > F.col("page_height") * top) & (F.col("y0") < F.col("page_height") * (1 - bottom))
    noise = strip("text").rlike(r"^$|^[0-9]+$|^[-—]\s*[0-9]+\s*[-—]$|^第\s*[0-9]+\s*页")
    return blocks.where(inside & ~noise)


def width(row: Column) -> Column:
    """Cells up to the last one that isn't empty."""
    return F.aggregate(F.transform(row, lambda c, i: F.when(c != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))


def share(cells: Column, test: Callable[[Column], Column]) -> Column:
    """Part of the cells that pass a test; 0 for no cells."""
    return F.size(F.filter(cells, lambda c: test(c))) / F.greatest(F.size(cells), F.lit(1))


def mean_length(cells: Column) -> Column:
    return F.aggregate(cells, F.lit(0), lambda a, c: a + F.length(c)) / F.greatest(F.size(cells), F.lit(1))


def longest(cells: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(cells, F.length)), F.lit(0))


def table_rows(rows: Column) -> Column:
    """array<array<string>> with cells on one line, without empty cells at the ends of rows and rows that are 70 % empty."""
    clean = lambda c: strip(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]+", " "), r"[ \t]+", " "))
    cells = F.transform(F.filter(rows, lambda r: r.isNotNull()), lambda r: F.transform(r, clean))
    cut = F.transform(cells, lambda r: F.slice(r, F.lit(1), width(r)))
    return F.filter(cut, lambda r: (F.size(r) > 0) & (F.size(F.filter(r, lambda c: c == "")) < 0.7 * F.size(r)))


def row_lines(rows: Column) -> Column:
    """A line of cells for each row."""
    lines = F.transform(rows, lambda r: F.array_join(F.filter(r, lambda c: strip(c) != ""), " | "))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def table_text(rows: Column) -> Column:
    """The lines of the rows, then the records."""
    return strip(F.concat_ws("\n", F.nullif(row_lines(rows), F.lit("")), F.array_join(table_records(rows), "\n")))


def is_sentence(cell: Column, marked: int = 16, long: int = 24) -> Column:
    """Text rather than a label: long, with marks and not short, or of three words."""
    return (F.length(cell) >= long) | ((F.length(cell) >= marked) & contains_any(cell, SENTENCE_MARKS)) | (F.size(F.filter(F.split(cell, r"(?U)\s+"), lambda w: w != "")) >= 3)


def bare(cell: Column) -> Column:
    return F.translate(strip(cell), ",，%¥$", "")


def is_number(cell: Column) -> Column:
    """A number, date or time."""
    return bare(cell).rlike(f"^(?:{'|'.join(VALUES)})$")


def is_value(cell: Column) -> Column:
    """A number, date or time, or an amount anywhere."""
    return is_number(cell) | bare(cell).rlike("|".join(AMOUNTS))


def header_score(rows: Column) -> Column:
    """How much the first row looks like a header: short, labelled cells without sentences and values, unlike the rows below."""
    head = F.filter(F.transform(F.get(rows, F.lit(0)), strip), lambda c: c != "")
    body = F.filter(F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.transform(r, strip)), lambda r: F.exists(r, lambda c: c != ""))
    cells = F.filter(F.flatten(body), lambda c: c != "")
    named = F.size(F.filter(head, lambda c: contains_any(c, HEADER_WORDS)))
    sentences, values = share(head, is_sentence), share(head, is_value)
    wide = F.size(F.get(rows, F.lit(0)))
    steady = share(body, lambda r: (F.abs(F.size(r) - wide) <= 1) | (F.abs(F.size(F.filter(r, lambda c: c != "")) - wide) <= 1))
    below = lambda least: F.when((F.size(cells) > 0) & least, 1).otherwise(0)
    points = (
        F.when(share(head, lambda c: F.length(c) <= 10) >= 0.7, 2).otherwise(0), F.when(mean_length(head) <= 12, 1).otherwise(0), F.when(longest(head) <= 24, 1).otherwise(-3),
        F.when(named >= 2, 3).when(named == 1, 2).otherwise(-2), F.when(sentences <= 0.25, 1).otherwise(-3), F.when(values == 0, 2).when(values <= 0.25, 1).otherwise(-3),
        F.when((F.size(body) > 0) & (steady >= 0.6), 2).otherwise(0), below(mean_length(head) < mean_length(cells)), below(values < share(cells, is_value)), below(sentences < share(cells, is_sentence)),
    )
    return F.when((F.size(rows) >= 2) & (F.size(head) >= 2), sum(points, F.lit(2))).otherwise(0)


def is_header(row: Column, below: Column) -> Column:
    """Whether a row is a header by itself and beside the row below: two labels or more, fewer numbers and sentences, shorter."""
    head, after = (F.filter(F.transform(F.coalesce(r, F.array().cast("array<string>")), strip), lambda c: c != "") for r in (row, below))
    said = lambda c: is_sentence(c, 0, 18)
    label = (share(head, lambda c: F.length(c) <= 10) >= 0.7) & (mean_length(head) <= 12) & (longest(head) <= 24) & (share(head, is_number) <= 0.4) & (share(head, said) <= 0.4)
    unlike = (share(head, said) < share(after, said)) | (share(head, is_number) < share(after, is_number)) | (mean_length(head) <= 0.8 * mean_length(after)) | (longest(head) < longest(after))
    return (F.size(head) >= 2) & label & ((F.size(after) == 0) | unlike)


def table_records(rows: Column, least: int = 7) -> Column:
    """Texts of the rows below a header as "header: value" lines; none where the first row isn't one."""
    head = F.transform(F.get(rows, F.lit(0)), strip)
    body = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))
    pair = lambda r: F.filter(F.transform(head, lambda h, i: F.when((h != "") & (strip(F.coalesce(F.get(r, i), F.lit(""))) != ""), F.concat(h, F.lit(": "), strip(F.get(r, i))))), lambda x: x.isNotNull())
    made = F.transform(body, lambda r, i: F.when(F.size(pair(r)) > 0, F.concat(F.format_string("[记录 %d]\n", i + 1), F.array_join(pair(r), "\n"))))
    return F.when(header_score(rows) >= least, F.filter(made, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))


def ocr_numbers(text: Column) -> Column:
    """Letters that OCR takes for digits, as digits, where only such stand before a unit."""
    between = F.split(text, OCR_NUMBER)
    found = F.regexp_extract_all(text, F.lit(OCR_NUMBER), F.lit(0))
    fixed = F.transform(found, lambda x: F.concat(F.translate(F.regexp_extract(x, OCR_NUMBER, 1), *OCR_DIGITS), F.regexp_extract(x, OCR_NUMBER, 2)))
    return F.array_join(F.zip_with(between, fixed, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")


def ocr_line(x: Column) -> Column:
    """A stripped line without blanks beside Chinese characters, its numbers mended."""
    for pattern, to in ((r"[ \t]+", " "), (rf"(?<=[{CJK}])\s+(?=[{CJK}])", ""), (rf"(?<=[{CJK}])\s+(?=[0-9])", ""), (rf"(?<=[0-9])\s+(?=[{CJK}])", ""), (r"分/\s*次", "分/次"), (r"分/\s*天", "分/天")):
        x = F.regexp_replace(x, pattern, to)
    return ocr_numbers(x)


def ocr_lines(c: Column | str) -> Column:
    return F.transform(clean_lines(c), ocr_line)


def is_ocr_value(x: Column) -> Column:
    """A line that states a result: points taken off, a sanction, or what follows at the n-th time."""
    return x.rlike(f"^(?:{'|'.join(OCR_VALUES)})$") | (F.contains(x, F.lit("扣")) & F.contains(x, F.lit("分")) & (F.length(x) <= 40)) | (contains_any(x, OCR_SANCTIONS) & (F.length(x) <= 60))


def ocr_item(x: Column) -> Column:
    """(item, content) of a line that begins with a number of one or two digits and goes on in a text that is no result; else null."""
    content = strip(F.regexp_extract(x, "^([0-9]{1,2})(.+)$", 2))
    return F.when((content != "") & ~is_ocr_value(content), F.struct(F.regexp_extract(x, "^([0-9]{1,2})(.+)$", 1).alias("item"), content.alias("content")))


def ocr_is_table(lines: Column) -> Column:
    """Five lines or more with two items and two results, or with a header, an item and a result."""
    count = lambda test: F.size(F.filter(lines, test))
    items, values = count(lambda x: ocr_item(x).isNotNull() | x.rlike("^[0-9]{1,2}$")), count(is_ocr_value)
    titled = F.exists(lines, lambda x: x.isin(*OCR_HEADERS) | F.contains(x, F.lit(OCR_TITLE)))
    return (F.size(lines) >= 5) & (((items >= 2) & (values >= 2)) | (titled & (items >= 1) & (values >= 1)))


def ocr_records(lines: Column) -> Column:
    """(sections, records) of OCR lines: numbered items with their contents and results, and the lines outside of them.

    A fold over the lines. A number alone waits for its content in the next line.
    """
    record = "struct<item:string,content:string,value:string>"
    none = F.lit(None).cast(record)
    start = F.struct(F.array().cast("array<string>").alias("sections"), F.array().cast(f"array<{record}>").alias("records"), none.alias("open"), F.lit("").alias("waits"))
    made = lambda item, content, *value: F.struct(item.alias("item"), content.alias("content"), (value or (F.lit(""),))[0].alias("value"))
    join = lambda a, b: F.when(a == "", b).when(a.rlike("[。！？；.!?;]$"), F.concat(a, b)).otherwise(F.concat_ws(" ", a, b))
    closed = lambda acc: F.when(acc["open"].isNull(), acc["records"]).otherwise(F.array_append(acc["records"], acc["open"]))

    def state(sections: Column, records: Column, open_: Column, waits: Column) -> Column:
        return F.struct(sections.alias("sections"), records.alias("records"), open_.alias("open"), waits.alias("waits"))

    def step(acc: Column, x: Column) -> Column:
        s, r, o, w = (acc[c] for c in ("sections", "records", "open", "waits"))
        value, item = is_ocr_value(x), ocr_item(x)
        more = F.when((o["value"] == "") & ~value, made(o["item"], join(o["content"], x), o["value"])).otherwise(made(o["item"], o["content"], join(o["value"], x)))
        return (
            F.when((w != "") & o.isNull() & ~value, state(s, r, made(w, x), F.lit("")))
            .when(x.rlike("^[0-9]{1,2}$"), state(s, closed(acc), none, x))
            .when(item.isNotNull(), state(s, closed(acc), made(item["item"], item["content"]), F.lit("")))
            .when(o.isNull(), state(F.array_append(s, x), r, o, w))
            .otherwise(state(s, r, more, w))
        )

    def end(acc: Column) -> Column:
        sections = F.when(acc["waits"] == "", acc["sections"]).otherwise(F.array_append(acc["sections"], acc["waits"]))
        return F.struct(sections.alias("sections"), closed(acc).alias("records"))

    return F.aggregate(lines, start, step, end)


def ocr_table_texts(rows: DataFrame, lines: str) -> DataFrame:
    """Add text to rows with OCR lines: a title, items with contents and results, and the records of the table that they make."""
    found = rows.withColumn("_found", ocr_records(F.col(lines)))
    head = F.array(F.array(F.lit("条目"), F.lit("内容"), F.lit("结果")))
    found = found.withColumn("_table", F.concat(head, F.transform("_found.records", lambda x: F.array(x["item"], x["content"], x["value"]))))
    titles = F.when(F.size("_found.sections") > 0, F.concat(F.array(F.lit("[图片OCR表格标题]")), F.col("_found.sections"))).otherwise(F.array().cast("array<string>"))
    items = F.flatten(F.transform("_found.records", lambda x: F.array(F.concat(F.lit("[条目 "), x["item"], F.lit("]")), strip(F.concat(F.lit("内容: "), x["content"])), strip(F.concat(F.lit("结果: "), x["value"])))))
    text = strip(F.array_join(F.filter(F.concat(titles, items, table_records(F.col("_table"))), lambda x: strip(x) != ""), "\n"))
    return found.withColumn("text", text).drop("_found", "_table")


def ocr_quality(text: Column, confidences: Column) -> Column:
    """low for an empty text, a mean below 0.72, a least below 0.45, two lines below 0.55, or 18 % odd characters in 8 or more;
    unknown for a text without scores; else normal."""
    known = F.filter(F.coalesce(confidences, F.array().cast("array<double>")), lambda x: x.isNotNull())
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))
    plain = F.regexp_replace(text_or_empty(text), r"(?U)\s+", "")
    odd = F.length(F.regexp_replace(plain, f"[{CJK}A-Za-z0-9，。；：、！？（）()/.\\-]", ""))
    low = (mean < 0.72) | (F.array_min(known) < 0.45) | (F.size(F.filter(known, lambda x: x < 0.55)) >= 2)
    strange = (F.length(plain) >= 8) & (odd / F.greatest(F.length(plain), F.lit(1)) >= 0.18)
    blank = strip(text_or_empty(text)) == ""
    return F.when((F.size(known) == 0) & ~blank, "unknown").when(blank | strange | F.coalesce(low, F.lit(False)), "low").otherwise("normal")
