"""Files and payloads as DataFrames: whole texts, structured JSON, uploads and their checks, office files, datasets and reports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.functions.text import stem, strip, suffix, text_or_empty

PAGES = (
    "file_name string, pages array<struct<page_number:string,page_height:double,text:string,"
    "text_blocks:array<struct<text:string,bbox:array<double>,page_height:double,avg_font_size:double>>,"
    "tables:array<struct<index:int,bbox:array<double>,rows:array<array<string>>,text:string,quality:string,merged_to_previous:boolean>>,"
    "images:array<struct<index:string,ocr_text:string,translated_text:string,translated_source_type:string,ocr_quality:string>>>>"
)
# What files of a suffix begin with, and the entries that office files have.
MAGIC = {".pdf": "255044462D", ".docx": "504B0304", ".xlsx": "504B0304", ".png": "89504E470D0A1A0A", ".jpg": "FFD8FF", ".jpeg": "FFD8FF"}
INNER = {".docx": "word/document.xml", ".xlsx": "xl/workbook.xml"}


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, source_format) of whole text and Markdown files."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.withColumn("source_format", F.when(suffix("path").isin(".md", ".markdown"), "markdown").otherwise("plain"))


def structured(spark: SparkSession, path: str) -> DataFrame:
    """Structured documents, a JSON file each; doc_id is the file's stem."""
    rows = spark.read.schema(PAGES).json(path, multiLine=True)
    return rows.withColumn("doc_id", stem(F.col("_metadata.file_path")))


def pages(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.*")


def extractable(documents: DataFrame) -> Column:
    """Whether some page has text, a table with text or an image with text."""
    said = lambda c: strip(F.coalesce(c, F.lit(""))) != ""
    none = lambda c: F.coalesce(c, F.array())
    return F.exists(F.coalesce("pages", F.array()), lambda p: said(p["text"]) | F.exists(none(p["tables"]), lambda t: said(t["text"])) | F.exists(none(p["images"]), lambda m: said(m["ocr_text"]) | said(m["translated_text"])))


def binaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def upload_error(name: Column, content: Column, declared: Column, limits: dict[str, int], mimes: dict[str, tuple[str, ...]]) -> Column:
    """Why an upload is refused: suffix, emptiness, size, declared type, or first bytes; null if it isn't."""
    kind = suffix(name)
    out = F.when(~kind.isin(*limits), "suffix").when(F.length(content) == 0, "empty")
    for s, n in limits.items():
        out = out.when((kind == s) & (F.length(content) > n), "size")
    for s, m in mimes.items():
        out = out.when((kind == s) & declared.isNotNull() & (declared != "") & ~declared.isin(*m), "type")
    for s, h in MAGIC.items():
        out = out.when((kind == s) & (F.hex(F.substring(content, 1, len(h) // 2)) != h), "bytes")
    for s, entry in INNER.items():
        out = out.when((kind == s) & ~F.contains(content, F.lit(entry).cast("binary")), "structure")
    return out


def duplicates(documents: DataFrame) -> DataFrame:
    """The newest of the documents that agree in knowledge base, name, size and content hash, with their number."""
    keys = ["knowledge_base_id", "filename", "file_size", "content_hash"]
    return documents.groupBy(*keys).agg(F.max_by("id", F.struct("created_at", "id")).alias("newest_id"), F.count("*").alias("copies"))


def changed(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files (path, modificationTime) without an artifact as new as they are."""
    fresh = done.select("path", F.col("made_at"))
    return files.join(fresh, (files["path"] == fresh["path"]) & (fresh["made_at"] >= files["modificationTime"]), "left_anti")


def docx_text(content: bytes) -> str:
    """Paragraphs and table rows in order; a row's cells joined by bars."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{w}t"))
    out = []
    for e in body if body is not None else ():
        if e.tag == f"{w}p":
            out.append(said(e))
        elif e.tag == f"{w}tbl":
            out += [" | ".join(x for c in row.findall(f"{w}tc") if (x := " ".join(said(p) for p in c.iter(f"{w}p")).strip())) for row in e.findall(f"{w}tr")]
    return "\n".join(x for x in out if x.strip())


def xlsx_text(content: bytes) -> str:
    """Sheets with their names; merged cells have the value of their first; empty cells are left out."""
    m, r = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = ["".join(t.text or "" for t in si.iter(f"{m}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    place = lambda ref: (int(re.sub("[^0-9]", "", ref)), sum((ord(ch) - 64) * 26**i for i, ch in enumerate(reversed(re.sub("[^A-Z]", "", ref)))))
    out = []
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{m}sheet"):
        root = ElementTree.fromstring(z.read("xl/" + targets[sheet.get(f"{r}id")].removeprefix("/xl/")))
        cells = {}
        for c in root.iter(f"{m}c"):
            v = c.find(f"{m}v")
            text = shared[int(v.text)] if v is not None and c.get("t") == "s" else "".join(t.text or "" for t in c.iter(f"{m}t")) if c.get("t") == "inlineStr" else (v.text if v is not None else "") or ""
            cells[place(c.get("r"))] = text.strip()
        for merged in root.iter(f"{m}mergeCell"):
            (r0, c0), (r1, c1) = map(place, merged.get("ref").split(":"))
            for i in range(r0, r1 + 1):
                for j in range(c0, c1 + 1):
                    cells[i, j] = cells.get((r0, c0), "")
        rows: dict[int, list[str]] = {}
        for (i, _), v in sorted(cells.items()):
            if v:
                rows.setdefault(i, []).append(v)
        out += [f"[Sheet] {sheet.get('name')}", *[" | ".join(v) for _, v in sorted(rows.items())]]
    return "\n".join(out)


#: Parsers of file contents by suffix. A parser of PDF pages or images needs a library or model of the user's: add it here.
PARSERS: dict[str, Callable[[bytes], str]] = {".docx": docx_text, ".xlsx": xlsx_text}


def parsed(files: DataFrame, parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """(path, text, error) of files (path, content) by their suffixes; text files are decoded, others without a parser are an error."""
    known = parsers or PARSERS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, kind, content in zip(batch["path"], batch["kind"], batch["content"]):
                try:
                    text = known[kind](bytes(content)) if kind in known else bytes(content).decode("utf-8") if kind in (".txt", ".md", ".markdown", ".json") else None
                    out.append((path, text, None if text is not None else "unsupported"))
                except Exception as e:  # a broken file must not end the job
                    out.append((path, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    return files.select("path", suffix("path").alias("kind"), "content").mapInPandas(run, "path string, text string, error string")


EVAL_CASES = "id string, question string, answer_mode string, category string, expected_answer_keywords array<string>, expected_context_keywords array<string>, expected_answer_keyword_groups array<array<string>>, expected_context_keyword_groups array<array<string>>"
INTENTS = "id string, label string, query string, split string, source string, notes string, history_messages array<struct<role:string,content:string>>"


def eval_cases(lines: DataFrame) -> DataFrame:
    """JSON lines (value) as evaluation cases with defaults; ``error`` says what is wrong with a case."""
    rows = lines.where(F.trim("value") != "").select(F.from_json("value", EVAL_CASES).alias("c")).select("c.*")
    groups = lambda g, k: F.coalesce(g, F.transform(F.coalesce(k, F.array().cast("array<string>")), lambda x: F.array(x)))
    rows = rows.withColumn("answer_mode", F.coalesce("answer_mode", F.lit("grounded"))).withColumn("category", F.coalesce("category", F.lit("general")))
    rows = rows.withColumn("expected_answer_keyword_groups", groups(F.col("expected_answer_keyword_groups"), F.col("expected_answer_keywords")))
    rows = rows.withColumn("expected_context_keyword_groups", groups(F.col("expected_context_keyword_groups"), F.col("expected_context_keywords")))
    error = F.when(F.col("id").isNull() | (F.col("id") == ""), "id").when(F.col("question").isNull() | (F.trim("question") == ""), "question").when(~F.col("answer_mode").isin("grounded", "no_answer"), "answer_mode")
    return rows.withColumn("error", error)


def intent_examples(lines: DataFrame) -> DataFrame:
    """JSON lines (value) as labelled queries; ``error`` says what is wrong: format, label, split, history or repeated id."""
    rows = lines.where(F.trim("value") != "").select(F.from_json("value", INTENTS).alias("c")).select("c.*")
    copies = F.count("*").over(Window.partitionBy("id"))
    error = (
        F.when(F.col("id").isNull() | F.col("query").isNull(), "format").when(~F.coalesce(F.col("label").isin("business_query", "follow_up_query", "off_topic", "meaningless_input"), F.lit(False)), "label")
        .when(~F.coalesce(F.col("split").isin("train", "validation", "test"), F.lit(False)), "split")
        .when((F.col("label") == "follow_up_query") & (F.size(F.coalesce("history_messages", F.array())) == 0), "history").when(copies > 1, "repeated")
    )
    return rows.withColumn("error", error)


def readable(pages_: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): a document's pages as text for people, to be written by ``write.text``."""
    page = F.concat(F.format_string("=== page %s ===\n", F.col("page_number").cast("string")), text_or_empty("text"))
    rows = pages_.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("page_number").cast("int").alias("n"), page.alias("t")))).alias("x"))  # pages of one document
    return rows.select(key, F.array_join(F.transform("x", lambda p: p["t"]), "\n\n").alias("text"))


def report(summary: DataFrame) -> DataFrame:
    """A row (value) of JSON for each row, to be written by ``write.text``."""
    return summary.select(F.to_json(F.struct(*sorted(summary.columns))).alias("value"))


def write_partition(df: DataFrame, path: str, by: str = "knowledge_base_id") -> None:
    """Replace only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
