"""Sentences and tables over pages against plain models that take the pages one after the other."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from terrace.operators import cleaning, paging

PAGES = "doc_id int, page_number int, text string"
BLOCKS = "doc_id int, page_number int, nth int, text string, x0 double, y0 double, x1 double, y1 double, page_height double, avg_font_size double"
TABLES = "doc_id int, page_number int, table_index int, y0 double, rows array<array<string>>, quality string"


def points(tail, head):
    ended, open_ = tail[-1] in "。！？；.!?;", tail[-1] in "，、：（《【(" or tail.endswith(cleaning.OPEN_WORDS)
    strong, result = head.startswith(cleaning.STRONG), head.startswith(cleaning.RESULTS) or bool(re.match("(扣除|扣减)?[0-9]+\\s*分", head))
    plain = not ended and open_ and (strong or result or "一" <= head[0] <= "鿿")
    return (-1 if ended else 1) + 2 * open_ + 2 * strong + 3 * result + plain


def place(above, below):
    if not above or not below:
        return 0
    x0, y0, _, y1, height, font = above[1]
    u0, v0, _, _, tall, other = below[1]
    boxes = None not in above[1][:4] and None not in below[1][:4]
    low = boxes and height and y1 / height >= 0.72
    return int(bool(low)) + int(bool(boxes and tall and v0 / tall <= 0.28)) + int(bool(boxes and abs(x0 - u0) <= 24)) + int(None not in (font, other) and abs(font - other) <= 1.5)


def walked(pages, blocks):
    """Texts, and what moved, of one document's pages in order."""
    text, out = [t for _, t in pages], [None] * len(pages)
    for i in range(len(pages) - 1):
        now, head = (text[i] or "").strip(), (text[i + 1] or "").strip()
        if not now or not head or re.match(cleaning.NEW_UNIT, head):
            continue
        full = lambda n: [b for b in blocks.get(n, []) if b[0].strip()]
        above, below = full(pages[i][0]), full(pages[i + 1][0])
        score = points([x.strip() for x in now.split("\n") if x.strip()][-1], head) + place(above[-1] if above else None, below[0] if below else None)
        found = re.match("(.{0,80}?[。！？；!?;])", head)
        moved = found.group(1) if found else head if len(head) <= 80 else ""
        if score < 2 or not moved:
            continue
        lines = [x for x in now.split("\n") if x.strip()]
        text[i] = "\n".join([*lines[:-1], lines[-1].rstrip() + moved]).strip()
        text[i + 1] = head[len(moved) :].strip()
        out[i] = (pages[i + 1][0], moved, score)
    return [(n, text[i] or "", *(out[i] or (None, None, None))) for i, (n, _) in enumerate(pages)]


@pytest.mark.parametrize("with_blocks", [False, True])
def test_sentences_equal_a_walk_over_pages(spark, with_blocks):
    rng = random.Random(3)
    bits = ["学生应当", "按规定", "办理。", "扣2分", "。", "的", "\n", " ", "第一条 ", "说明", "，", "abc", "处", "；", "给予", "予", "x" * 85, "不", "\n\n"]
    rows, blocks, docs = [], [], {}
    for doc in range(150):
        pages = [(n * 2, "".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) if rng.random() > 0.05 else None) for n in range(rng.randint(1, 7))]
        docs[doc] = pages, {}
        rows += [(doc, n, t) for n, t in pages]
        for n, _ in pages if with_blocks else ():
            for i in range(rng.randint(0, 3)):
                box = [rng.choice([0.0, 20.0, 60.0]), rng.choice([10.0, 500.0]), 90.0, rng.choice([100.0, 790.0]), rng.choice([800.0, 800.0, None]), rng.choice([10.0, 11.0, 14.0, None])]
                if rng.random() < 0.1:
                    box[rng.randrange(4)] = None
                blocks.append((doc, n, i, rng.choice(["a", " ", "b"]), *box))
                docs[doc][1].setdefault(n, []).append((blocks[-1][3], box))
    given = spark.createDataFrame(blocks, BLOCKS) if with_blocks else None
    found = paging.join_sentences(spark.createDataFrame(rows, PAGES), given)
    got = {}
    for r in found.orderBy("doc_id", "page_number").collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    want = {d: walked(*x) for d, x in docs.items()}
    assert got == want
    assert sum(x[2] is not None for d in want.values() for x in d) > 50


def test_a_sentence_end_behind_a_line_break_moves_nothing(spark):
    pages = [(1, 1, "各班按"), (1, 2, "学校规定\n扣2分。" + "长" * 90)]
    assert [r.text for r in paging.join_sentences(spark.createDataFrame(pages, PAGES)).orderBy("page_number").collect()] == [t for *_, t in pages]


def folded(pages, tables, header):
    """Merges of one document: (page, first table) to (page, table), and whether the first row is repeated."""
    wide = lambda rows: max((max((i + 1 for i, c in enumerate(r) if c), default=0) for r in rows), default=0)
    active, out = None, {}
    for n in pages:
        here = tables.get(n, [])
        sound = [t for t in here if t["quality"] != "error"]
        if not here or here[0]["quality"] == "error":
            active = None
            continue
        first = here[0]
        if active and active["all"] and first["rows"] and wide(active["all"]) and wide(first["rows"]) and abs(wide(active["all"]) - wide(first["rows"])) <= 1 and (first["y0"] is None or first["y0"] <= 150):
            same = bool(active["all"][0]) and active["all"][0] == first["rows"][0]
            if same or not header(first):
                out[n, first["nth"]] = (active["page"], active["nth"], same)
                active["all"] = active["all"] + first["rows"][same:]
                rest = [t for t in here[1:] if t["quality"] != "error"]
                if rest:
                    active = {"page": n, "nth": rest[-1]["nth"], "all": rest[-1]["rows"]}
                continue
        active = {"page": n, "nth": sound[-1]["nth"], "all": sound[-1]["rows"]} if sound else None
    return out


def test_tables_equal_a_walk_over_pages(spark):
    rng = random.Random(5)
    head, body = [["行为", "分值"], ["姓名", "班级", "备注"]], [["迟到三次以上的学生，扣分。", "2"], ["1", "2", "3"], ["甲", "", ""], ["4", "5"], []]
    rows, docs = [], {}
    for doc in range(200):
        pages, tables = list(range(1, rng.randint(2, 7))), {}
        for n in pages:
            for nth in range(rng.choice([0, 1, 1, 1, 2])):
                made = ([rng.choice(head)] if rng.random() < 0.5 else []) + [rng.choice(body) for _ in range(rng.randint(0, 3))]
                t = {"nth": nth, "y0": rng.choice([20.0, 20.0, 150.0, 300.0, None]), "rows": made, "quality": "error" if rng.random() < 0.1 else rng.choice(["normal", "low"])}
                tables.setdefault(n, []).append(t)
                rows.append((doc, n, nth, t["y0"], made, t["quality"]))
        docs[doc] = pages, tables
    given = spark.createDataFrame(rows, TABLES)
    titled = {(r.doc_id, r.page_number, r.table_index): r.h for r in given.select("doc_id", "page_number", "table_index", cleaning.is_header(F.get("rows", F.lit(0)), F.get("rows", F.lit(1))).alias("h")).collect()}
    pages = spark.createDataFrame([(d, n) for d, (p, _) in docs.items() for n in p], "doc_id int, page_number int")
    want, whole = {}, {(d, n, t["nth"]): list(t["rows"]) for d, (_, x) in docs.items() for n, ts in x.items() for t in ts}
    parts = {}
    for d, (p, tables) in docs.items():
        for (n, nth), (to, at, same) in folded(p, tables, lambda t, d=d, x=tables: titled[d, next(n for n, ts in x.items() if any(t is u for u in ts)), t["nth"]]).items():
            want[d, n, nth] = (to, at, same)
            parts.setdefault((d, to, at), []).append((n, next(t["rows"] for t in tables[n] if t["nth"] == nth)[same:]))
    got = paging.merge_tables(given, pages).collect()
    assert {(r.doc_id, r.page, r.nth): (r.to_page, r.to_nth, r.again) for r in paging.table_merges(given, pages).collect()} == want and len(want) > 60
    for r in got:
        at = (r.doc_id, r.page_number, r.table_index)
        more = parts.get(at, [])
        assert r.rows == whole[at] + [x for _, rows_ in more for x in rows_] and r.merged_to_previous == (at in want) and r.is_cross_page_merged == bool(more)
        assert r.merged_pages == ([r.page_number, *[n for n, _ in more]] if more else None) and r.merged_target_page == (want[at][0] if at in want else None)
    assert len(got) == len(rows) and any(len(m) > 1 for m in parts.values())


def test_a_header_that_comes_again_after_a_page_without_one(spark):
    """The active table is what counts, not the page before: header on pages 1 and 3."""
    t = [(1, 1, 0, 400.0, [["行为", "分值"], ["1", "2"]], "normal"), (1, 2, 0, 20.0, [["3", "4"]], "normal"), (1, 3, 0, 20.0, [["行为", "分值"], ["5", "6"]], "normal"), (1, 4, 0, 20.0, [["7", "8"]], "error"), (1, 5, 0, 20.0, [["9", "9"]], "normal")]
    pages = spark.createDataFrame([(1, n) for n in range(1, 6)], "doc_id int, page_number int")
    got = paging.merge_tables(spark.createDataFrame(t, TABLES), pages).orderBy("page_number").collect()
    assert got[0].rows == [["行为", "分值"], ["1", "2"], ["3", "4"], ["5", "6"]] and got[0].merged_pages == [1, 2, 3]
    assert [r.merged_to_previous for r in got] == [False, True, True, False, False]
    assert paging.merge_tables(spark.createDataFrame([], TABLES), pages).count() == 0
