"""Texts to parent and child chunks: strategies, sections, sentences, hard splits, packing, Markdown and structured pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.text import strip, text_or_empty


@dataclass(frozen=True)
class Strategy:
    """How texts of a kind split into sections; used where its patterns match ``least`` times in all."""

    name: str
    boundary: str
    patterns: tuple[str, ...] = ()
    least: int = 0


@dataclass(frozen=True)
class SplitRules:
    """Strategies in order, the last one the default; sentence ends; weaker boundaries for pieces that are too long."""

    strategies: tuple[Strategy, ...]
    sentence: str
    weaker: tuple[str, ...] = field(default=())


# The boundaries of Chinese regulations, and of texts in Latin letters.
REGULATIONS = SplitRules(
    (
        Strategy("law_article", r"(?m)(?=^(?:第[一二三四五六七八九十百千0-9]+条)(?:\s|$))", (r"第[一二三四五六七八九十百千0-9]+条",), 2),
        Strategy("regulation_rule", r"(?=(?:[一二三四五六七八九十]+、)|(?:扣分处理标准如下：?))", (r"[一二三四五六七八九十]+、", "扣分处理标准如下"), 2),
        Strategy("generic_paragraph", r"(?:\r?\n\s*){2,}"),
    ),
    r"(?<=[。！？；\n])",
    (r"(?<=[，、：:,])", r"(?=(?:[（(][一二三四五六七八九十0-9]+[）)]|[一二三四五六七八九十]+、|\d+[.．、]))", r"(?<=[）)])"),
)
LATIN = SplitRules((Strategy("generic_paragraph", r"\n"),), r"(?<=[.!?;\n])", (r"(?<=[,:])", r"(?<= )"))


def strategy(text: Column, rules: SplitRules) -> Column:
    """Name of the first strategy whose patterns match often enough, else of the default."""
    out = None
    for s in rules.strategies[:-1]:
        count = sum((F.regexp_count(text, F.lit(p)) for p in s.patterns), F.lit(0))
        out = F.when(count >= s.least, s.name) if out is None else out.when(count >= s.least, s.name)
    return F.lit(rules.strategies[-1].name) if out is None else out.otherwise(rules.strategies[-1].name)


def filled(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, strip), lambda x: x != "")


def sections(text: Column, rules: SplitRules) -> Column:
    """The sections of a text under its strategy, stripped, without empty ones."""
    chosen, out = strategy(text, rules), None
    for s in rules.strategies:
        cut = filled(F.split(text, s.boundary))
        out = F.when(chosen == s.name, cut) if out is None else out.when(chosen == s.name, cut)
    return out


def sentences(text: Column, rules: SplitRules) -> Column:
    return filled(F.split(text_or_empty(text), rules.sentence))


def hard_split(text: Column, size: int) -> Column:
    """Pieces of ``size`` characters, the last one shorter."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(text) / size).cast("int") - 1)), lambda i: F.substring(text, i * size + 1, F.lit(size)))
    return F.filter(pieces, lambda x: x != "")


def refine(pieces: Column, limit: int, rules: SplitRules) -> Column:
    """Cut pieces above ``limit`` characters at ever weaker boundaries, then by size; others stay."""

    def cut(boundary: str) -> Callable[[Column], Column]:
        return lambda p: F.when(F.length(p) > limit, filled(F.split(p, boundary))).otherwise(F.array(p))

    for boundary in rules.weaker:
        pieces = F.flatten(F.transform(pieces, cut(boundary)))
    return filled(F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) > limit, hard_split(p, limit)).otherwise(F.array(p)))))


def pack(rows: DataFrame, pieces: str, limit: int) -> DataFrame:
    """Replace the array ``pieces`` of each row: neighbouring pieces joined greedily while the sum of lengths is at most ``limit``.

    Linear in the pieces, by Arrow batches.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = []
            for row in batch[pieces]:
                done, open_, size = [], [], 0
                for p in row if row is not None else ():
                    if open_ and size + len(p) > limit:
                        done.append("".join(open_))
                        open_, size = [], 0
                    open_.append(p)
                    size += len(p)
                packed.append([*done, "".join(open_)] if open_ else done)
            yield batch.assign(**{pieces: packed})

    return rows.mapInPandas(run, rows.schema)


def chunks(docs: DataFrame, rules: SplitRules, parent_limit: int = 260, child_limit: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, parent_id, parent_text, child_index, child_text, chunk_id) of each document.

    Sections are cut to sentences and packed to parents of at most ``parent_limit`` characters; parents are cut and packed to
    children of at most ``child_limit``. A section of one parent keeps its id, others are numbered. Null and blank texts have
    no chunks.
    """
    cut = docs.select(key, F.posexplode(sections(text_or_empty(text), rules)).alias("section", "body"))
    return section_chunks(cut, rules, parent_limit, child_limit, key)


def section_chunks(cut: DataFrame, rules: SplitRules, parent_limit: int, child_limit: int, key: str) -> DataFrame:
    """Chunks of sections (key, section, body)."""
    packed = pack(cut.select(key, "section", refine(sentences(F.col("body"), rules), parent_limit, rules).alias("parents")), "parents", parent_limit)
    prefix = F.concat(F.lit("rule_doc_"), F.col("section"))
    rows = packed.select(key, prefix.alias("prefix"), F.size("parents").alias("many"), F.posexplode("parents").alias("i", "parent_text"))
    rows = rows.withColumn("parent_id", F.when(F.col("many") == 1, F.col("prefix")).otherwise(F.concat_ws("_", "prefix", "i")))
    small = rows.select(key, "parent_id", "parent_text", refine(sentences(F.col("parent_text"), rules), child_limit, rules).alias("children"))
    out = pack(small, "children", child_limit).select(key, "parent_id", "parent_text", F.posexplode("children").alias("child_index", "child_text"))
    return out.withColumn("chunk_id", chunk_id(F.col("child_text"), F.col("parent_id")))


def chunk_id(child: Column, parent_id: Column) -> Column:
    return F.md5(F.concat(child, parent_id).cast("binary"))


def new_chunks(found: DataFrame, stored: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Chunks whose id isn't stored, each id once."""
    return found.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def latest(found: DataFrame, stored: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Stored chunks with those of the same id replaced by the found ones."""
    return stored.join(found.select(key), key, "left_anti").unionByName(found.dropDuplicates([key]), allowMissingColumns=True)


#: A heading, an article's mark, a list's mark, what stands between marks of emphasis, and the name of a table of contents.
HEADING, ARTICLE, BULLET = re.compile(r"(#{1,6})\s+(.*)"), re.compile(r"\*\*(第[一二两三四五六七八九十百千0-9]+条)\*\*\s*(.*)"), re.compile(r"[*-]\s+")
EMPHASIS = (re.compile(r"\*\*(.*?)\*\*"), re.compile(r"__(.*?)__"), re.compile(r"`([^`]+)`"))
CONTENTS = "目录"


@F.udtf(returnType="section int, heading string, body string")
class MarkdownSections:
    """The sections of a Markdown text, in one pass over its lines: number, path of headings, and text after its headings.

    Headings, rules and article marks end a section. Title, chapter and section names stand before each section's lines; what
    follows a heading of a table of contents is left out up to the next title or chapter; marks of lists and emphasis go.
    """

    def eval(self, text: str | None) -> Iterator[tuple[int, str, str]]:
        names, skipping, lines, path, number = {1: "", 2: "", 3: ""}, False, [], "", 0
        for raw in [*(text or "").splitlines(), "---"]:
            line = raw.strip()
            heading = HEADING.fullmatch(line)
            article = None if heading or skipping else ARTICLE.fullmatch(line)
            if lines and (heading or article or line == "---"):
                body = "\n".join(x for x in lines if x.strip()).strip()
                if body:
                    yield number, path, body
                    number += 1
                lines = []
            if heading:
                level, name = min(3, len(heading[1])), self.plain(heading[2])
                contents = level > 1 and name == CONTENTS
                skipping = contents or skipping and level == 3
                if contents:
                    names |= {2: "", 3: ""}
                else:
                    names |= {n: name if n == level else "" for n in range(level, 4)}
            elif line and line != "---" and not skipping:
                if not lines:
                    above = [x for x in names.values() if x]
                    lines, path = list(above), " > ".join(above)
                lines.append(f"{article[1]} {article[2]}".strip() if article else BULLET.sub("", self.plain(line), count=1) if BULLET.match(self.plain(line)) else self.plain(line))

    @staticmethod
    def plain(line: str) -> str:
        for marks in EMPHASIS:
            line = marks.sub(r"\1", line)
        return line.strip()


def markdown_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, heading, body) of Markdown texts: each section's text after the headings above it."""
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).lateralJoin(MarkdownSections(F.col("_text").outer())).select(F.col("_key").alias(key), "section", "heading", "body")


def markdown_chunks(docs: DataFrame, rules: SplitRules, parent_limit: int = 260, child_limit: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The chunks of Markdown texts as :func:`chunks` gives them, each with the headings above its section."""
    return section_chunks(markdown_sections(docs, key, text).select(key, "section", "body"), rules, parent_limit, child_limit, key)


def structured_parts(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page_number, source_type, block_index, text, ocr_quality) of pages with text, tables and images.

    Tables that were merged into another or failed are skipped; of images the translation counts before the OCR text.
    """
    page = F.coalesce(F.try_to_number(F.col("page_number").cast("string"), F.lit("999999999")).cast("int"), F.lit(0)).alias("page_number")
    none = F.lit(None).cast("string").alias("ocr_quality")
    body = pages.select(key, page, F.lit("text").alias("source_type"), F.lit(0).alias("block_index"), text_or_empty("text").alias("text"), none)
    tables = pages.select(key, page, F.posexplode("tables").alias("block_index", "t")).where("not coalesce(t.merged_to_previous, false) and coalesce(t.quality, '') != 'error'")
    tables = tables.select(key, "page_number", F.lit("table").alias("source_type"), "block_index", text_or_empty("t.text").alias("text"), none)
    images = pages.select(key, page, F.posexplode("images").alias("block_index", "m"))
    said = F.nullif(strip(text_or_empty("m.translated_text")), F.lit(""))
    kind = F.when(said.isNotNull(), F.coalesce(F.nullif(F.col("m.translated_source_type"), F.lit("")), F.lit("image_ocr"))).otherwise("image_ocr")
    words = F.coalesce(F.when(said.isNotNull(), F.concat(F.lit("[正文转译]\n"), said)), text_or_empty("m.ocr_text"))
    images = images.select(key, "page_number", kind.alias("source_type"), "block_index", words.alias("text"), F.col("m.ocr_quality").alias("ocr_quality"))
    return body.unionByName(tables).unionByName(images).where(strip("text") != "")
