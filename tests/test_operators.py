"""Operators on small tables."""

import datetime as dt
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.operators import chunking, cleaning, context, evaluation, messages, retrieval, routing, tasks
from terrace.sources import files
from terrace.streaming import monitor


def test_articles_become_parents(spark):
    docs = spark.createDataFrame([(1, "第一条 甲。\n第二条 乙，见第一条。"), (2, None)], "doc_id int, text string")
    rows = chunking.chunks(docs, chunking.REGULATIONS).collect()
    assert {r.parent_id for r in rows} == {"rule_doc_0", "rule_doc_1"} and all(r.doc_id == 1 for r in rows)


def test_long_piece_splits_at_weaker_boundary_then_by_size(spark):
    docs = spark.createDataFrame([(1, "甲" * 30 + "，" + "乙" * 70)], "doc_id int, text string")
    got = [r.child_text for r in chunking.chunks(docs, chunking.REGULATIONS).orderBy("child_index").collect()]
    assert max(map(len, got)) <= 50 and "".join(got) == docs.first().text


def test_weaker_boundaries_keep_digits(spark):
    rows = spark.createDataFrame([(1, ["a0b0c, dddddddd 10 x", "short", "0123456789012345"])], "i int, p array<string>")
    got = rows.select(chunking.refine(F.col("p"), 10, chunking.LATIN).alias("p")).first().p
    assert got == ["a0b0c,", "dddddddd", "10", "x", "short", "0123456789", "012345"]
    packed = chunking.pack(spark.createDataFrame([(1, ["ab", "cd", "efghij", "k"]), (2, []), (3, None)], "i int, p array<string>"), "p", 5)
    assert {r.i: list(r.p) for r in packed.collect()} == {1: ["abcd", "efghij", "k"], 2: [], 3: []}


def test_a_trailing_colon_leaves_a_page_open(spark):
    pairs = spark.createDataFrame([("包括：", "学生迟到"), ("完。", "新的"), ("应当", "扣2分"), ("abc", "def")], "a string, b string")
    assert [r[0] for r in pairs.select(cleaning.continuation_score(F.col("a"), F.col("b"))).collect()] == [4, -1, 7, 1]


def test_contents_items(spark):
    lines = spark.createDataFrame([("第一章 总则 ··5",), ("三、附则 9",), ("总则 .... 3",), ("1. 9",), ("正文 2024",), ("x 1",)], "t string")
    assert [r[0] for r in lines.select(cleaning.is_contents_item(F.col("t"))).collect()] == [True, True, True, True, False, False]


def test_paragraphs_join_broken_lines(spark):
    rows = spark.createDataFrame([("学生 应当\n按 规定。\n第二 行\nabc  def",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(cleaning.paragraph("t")).collect()] == ["学生应当按规定。第二行\nabc def", "", ""]


def test_ocr_table(spark):
    lines = ["课堂纪律", "1迟到", "扣l分/次", "2", "早退的学生", "扣2分/次", "通报批评", "3旷课", "补充说明文字很长很长很长"]
    rows = spark.createDataFrame([(1, lines)], "i int, l array<string>").withColumn("l", F.transform("l", cleaning.ocr_line))
    got = rows.select(cleaning.ocr_is_table(F.col("l")).alias("t"), cleaning.ocr_records(F.col("l")).alias("r")).first()
    assert got.t and got.r.sections == ["课堂纪律"]
    assert [tuple(x) for x in got.r.records] == [("1", "迟到", "扣1分/次"), ("2", "早退的学生", "扣2分/次 通报批评"), ("3", "旷课 补充说明文字很长很长很长", "")]
    text = cleaning.ocr_table_texts(rows, "l").first().text
    assert text.startswith("[图片OCR表格标题]\n课堂纪律\n[条目 1]\n内容: 迟到\n结果: 扣1分/次\n[条目 2]")
    numbers = spark.createDataFrame([("l0页 I条 Oil 2O分",)], "t string")
    assert numbers.select(cleaning.ocr_numbers(F.col("t"))).first()[0] == "10页 1条 Oil 20分"


@pytest.mark.parametrize(("text", "scores", "want"), [("", [], "low"), ("正常文字", [], "unknown"), ("正常文字", [0.9, 0.95], "normal"), ("正常文字", [0.9, 0.5, 0.5], "low"), ("@@##正常文字字字", [0.9], "low")])
def test_ocr_quality(spark, text, scores, want):
    row = spark.createDataFrame([(text, scores)], "t string, s array<double>")
    assert row.select(cleaning.ocr_quality(F.col("t"), F.col("s"))).first()[0] == want


def test_header_rows(spark):
    rows = spark.createDataFrame([([["项目", "分值"], ["迟到的学生按规定处理。", "扣2分"]],), ([["2", "3"], ["4", "5"]],), ([["只有一格"]],)], "r array<array<string>>")
    got = rows.select(cleaning.header_score(F.col("r")).alias("s"), cleaning.is_header(F.get("r", F.lit(0)), F.get("r", F.lit(1))).alias("h")).collect()
    assert [(r.s, r.h) for r in got] == [(16, True), (4, False), (0, False)]


def test_legal_breaks_and_contexts(spark):
    text = "中华人民共和国劳动法第一章总则第一条下列：（一）甲；（二）乙"
    row = spark.createDataFrame([(text,)], "text string").select(context.prettify("text").alias("t")).first()
    assert row.t == "中华人民共和国劳动法\n第一章总则\n第一条下列：\n（一）甲；\n（二）乙"
    chosen = spark.createDataFrame([(1, 1, "甲", "来"), (1, 2, "乙", None)], "query_id int, sel int, text string, source_name string")
    assert context.context_text(chosen).first().context == "[来源：来]\n甲\n\n乙"


def test_context_stages(spark):
    texts = ["第四十条 关键内容。", "第四十二条 限制。", "背景的文字。", "好的 别的文字。", "低价值", "普通的。"]
    rows = [(1, f"p{i}", i, t, "问题 概览", ["关键"], False, True, "d", "text") for i, t in enumerate(texts)]
    rows += [(2, f"q{i}", i, t, "问题", ["没有"], False, False, "d", "text") for i, t in enumerate(texts)]
    parents = spark.createDataFrame(rows, "query_id int, parent_id string, pos int, text string, query string, keywords array<string>, is_policy boolean, is_overview boolean, document_id string, source_type string")
    ranked = spark.createDataFrame([(1, "p2", 1, -0.5), (1, "p3", 2, 0.4), (2, "q3", 1, 0.2), (2, "q2", 2, -0.1)], "query_id int, parent_id string, rank int, rerank_score double")
    got = context.staged_context(parents, ranked, 3, low_value=("低价值",)).orderBy("query_id", "sel").collect()
    # article 40, then the restriction article 42, then the first parents that are left (one of them negative), then the reranked rest
    assert [(r.query_id, r.parent_id, r.stage) for r in got] == [(1, "p0", 3), (1, "p1", 4), (1, "p3", 7), (2, "q3", 8)]
    none = context.staged_context(parents.where("pos = 5"), ranked.limit(0), 3).collect()
    assert [(r.query_id, r.stage) for r in none] == [(1, 7)]


def test_shadow_summary_and_benchmark_diff(spark):
    cases = spark.createDataFrame([("a", "match", [], 10, 20, True), ("b", "error", ["ids", "text"], 30, 40, False)], "id string, status string, mismatch_fields array<string>, legacy_ms int, graph_ms int, same boolean")
    got = {r.metric: r.value for r in evaluation.shadow_summary(cases, ["same"], drift=("ids",)).collect()}
    assert got["case_count"] == 2 and got["same_rate"] == 0.5 and got["retrieval_drift_rate"] == 0.5 and got["drift:ids"] == 1 and got["mismatch:text"] == 1 and got["avg_graph_latency_ms"] == 30


def test_many_words_are_matched_alike(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "aaaa bab"), (2, None), (3, "")], "chunk_id int, text string")
    words = spark.createDataFrame([("aa",), ("ab",), ("",), ("zz",)], "word string")
    found = lambda: sorted(map(tuple, retrieval.contained(texts, words, "chunk_id").collect()))
    want = [(1, "aa", 8, 2), (1, "ab", 8, 1)]
    assert found() == want
    monkeypatch.setattr(retrieval, "MOST_WORDS", 1)
    assert found() == want


def test_dense_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(40, 5)), rng.normal(size=(7, 5))
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, [1.0])], "chunk_id int, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id int, query_vector array<double>")
    monkeypatch.setattr(retrieval, "BLOCK", 3)
    for metric, value in (("l2", lambda x: ((v - x) ** 2).sum(1)), ("cosine", lambda x: -(v @ x) / np.linalg.norm(v, axis=1) / np.linalg.norm(x))):
        got = {(r.query_id, r.rank): r.chunk_id for r in retrieval.dense(vectors, queries, 4, metric).collect()}
        assert got == {(i, k + 1): int(c) for i, x in enumerate(q) for k, c in enumerate(np.argsort(np.round(value(x), 6), kind="stable")[:4])}
    assert retrieval.dense(vectors, queries.limit(0), 4).count() == 0


def test_references_have_windows_of_their_own(spark):
    rows = spark.createDataFrame([("依照第三条，" + "甲" * 80 + "详见第五条和第三条；第七条。参见第九条",), ("第一条 无。",)], "t string")
    from terrace.functions.text import referenced_articles

    assert [r[0] for r in rows.select(referenced_articles("t")).collect()] == [[3, 5, 9], []]


def test_case_choice_and_second_classifier(spark, tmp_path):
    cases = spark.createDataFrame([("a",), ("b",)], "id string")
    assert evaluation.select_cases(cases, ["b"]).count() == 1 and evaluation.select_cases(cases, limit=1).first().id == "a"
    for wrong in ({"ids": ["c"]}, {"limit": 0}):
        with pytest.raises(ValueError):
            evaluation.select_cases(cases, **wrong)
    asked = spark.createDataFrame([("这个呢", False), ("请假流程是什么样子的呢", False), ("请假", False), ("", True), ("那么迟到的处理办法呢", True)], "q string, h boolean")
    assert [r[0] for r in asked.select(routing.needs_second_classifier(F.col("q"), F.col("h"), ("请假",))).collect()] == [True, False, False, False, True]
    (tmp_path / "profiles" / "cn").mkdir(parents=True)
    (tmp_path / "rules.json").write_text('{"name": "default"}')
    (tmp_path / "profiles" / "cn" / "rules.json").write_text('{"name": "own"}')
    read = lambda profile: routing.profile_rules(spark, str(tmp_path), "rules.json", "name string", profile).first().name
    assert (read("cn"), read("other"), read(None)) == ("own", "default", "default")
    with pytest.raises(ValueError):
        read("../x")


def test_markdown_headings(spark):
    text = "# A\nx\n\n## B\n- **y** `z`\nmore\n### 目录\nskipped\n### still\nskipped\n## C\n**第三条** 内容\n**第四条**\n---\nend\n# D\nlast"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "plain\n\nlines"), (4, "# only a title")], "doc_id int, text string")
    got = [(r.doc_id, r.section, r.heading, r.body) for r in chunking.markdown_sections(docs).orderBy("doc_id", "section").collect()]
    assert got == [
        (1, 0, "A", "A\nx"), (1, 1, "A > B", "A\nB\ny z\nmore"), (1, 2, "A > C", "A\nC\n第三条 内容"), (1, 3, "A > C", "A\nC\n第四条"), (1, 4, "A > C", "A\nC\nend"), (1, 5, "D", "D\nlast"), (3, 0, "", "plain\nlines"),
    ]
    found = chunking.markdown_chunks(docs, chunking.LATIN).where("doc_id = 1").collect()
    assert {r.parent_id.split("_")[2] for r in found} == set("012345") and any("A" in r.parent_text and "y z" in r.parent_text for r in found)


def test_table_records_and_ocr(spark):
    rows = F.array(F.array(F.lit("行为"), F.lit("处理标准"), F.lit("分值")), F.array(F.lit("迟到"), F.lit("提醒"), F.lit("2")))
    got = spark.range(1).select(cleaning.table_records(rows).alias("x"), cleaning.ocr_numbers(F.lit("扣l0分 Oil")).alias("n"), cleaning.ocr_quality(F.lit("正常文字"), F.array(F.lit(0.9), F.lit(0.4))).alias("q")).first()
    assert got.x == ["[记录 1]\n行为: 迟到\n处理标准: 提醒\n分值: 2"] and got.n == "扣10分 Oil" and got.q == "low"


def test_mmr_agrees_with_a_plain_model(spark):
    rng = np.random.default_rng(0)
    v, q = rng.normal(size=(12, 6)), rng.normal(size=6)
    rows = [(1, i, i, v[i].tolist(), q.tolist()) for i in range(12)]
    got = [r.chunk_id for r in retrieval.mmr(spark.createDataFrame(rows, "query_id int, chunk_id int, place int, embedding array<double>, query_vector array<double>"), 5).orderBy("turn").collect()]
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    want = []
    while len(want) < 5:
        rest = [i for i in range(12) if i not in want]
        want.append(max(rest, key=lambda i: (0.6 * cos(v[i], q) - 0.4 * max(cos(v[i], v[j]) for j in want)) if want else cos(v[i], q)))
    assert got == want


def test_article_runs_references_and_neighbours(spark):
    rows = [(1, f"p_{i}", i, t, ["关键"], False, True, "d", "text") for i, t in enumerate(["第一条 关键。", "第二条 无。", "第五条 无。", "第九条 依照第五条办理。"])]
    parents = spark.createDataFrame(rows, "query_id int, parent_id string, pos int, text string, keywords array<string>, is_policy boolean, is_overview boolean, document_id string, source_type string")
    assert [r.pos for r in context.article_cluster(parents).orderBy("place").collect()] == [0, 1]
    chosen = parents.where("pos = 3").withColumn("sel", F.lit(1))
    assert [r.pos for r in context.referenced_parents(parents, chosen).collect()] == [2]
    pair = parents.withColumn("text", F.when(F.col("pos") == 0, "包括下列情形：").when(F.col("pos") == 1, "（一）甲").otherwise("别的。"))
    assert [r.parent_id for r in context.adjacent_parents(pair, pair.where("pos = 0").withColumn("sel", F.lit(1))).collect()] == ["p_1"]


def test_intents_and_rules(spark):
    q = spark.createDataFrame([(1, "你好，谢谢！"), (2, "哈哈哈哈"), (3, "请假怎么审批")], "query_id int, query string")
    rules = [("greeting", "你好[呀啊]*"), ("thanks", "谢谢")]
    got = {r.query_id: r.x for r in q.select("query_id", routing.intent(F.col("query"), F.lit(False), rules, [], [], [], []).alias("x")).collect()}
    assert got == {1: "light:thanks", 2: "meaningless", 3: "business"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, knowledge_base_id string, status string, attempt_count int, created_at timestamp_ntz, updated_at timestamp_ntz, started_at timestamp_ntz, locked_at timestamp_ntz, locked_by string")
    events = spark.createDataFrame([], "task_id long, event_type string, created_at timestamp_ntz")
    one = tasks.overview(none, events, F.lit("2024-01-01").cast("timestamp_ntz"), 60, 24, 60).first()
    assert one.total == 0 and one.oldest_pending_age_seconds is None
    said = spark.createDataFrame([], "conversation_id long, sequence long, role string, content string")
    assert messages.turn_pairs(said).count() == 0 and messages.recent_history(said).count() == 0


def test_heartbeat_only_by_the_holder(spark):
    at = dt.datetime(2024, 1, 1)
    t = spark.createDataFrame([(1, "running", at, "w1"), (2, "running", at, "w2")], "id int, status string, locked_at timestamp_ntz, locked_by string")
    beats = spark.createDataFrame([(1, "w1", at + dt.timedelta(hours=1)), (2, "w1", at + dt.timedelta(hours=1))], "id int, worker string, at timestamp_ntz")
    assert {r.id: r.locked_at.hour for r in tasks.heartbeat(t, beats).collect()} == {1: 1, 2: 0}


def test_hits_and_stream_parse(spark):
    groups = F.array(F.array(F.lit("社保"), F.lit("保险")), F.array(F.lit("缺")))
    got = spark.range(1).select(evaluation.missing_groups(F.lit("有 保险。"), groups).alias("m"), evaluation.stream_events(F.lit("event: token\ndata: {\"a\":1}\n\nevent: end\ndata: x\n\n")).alias("e")).first()
    assert got.m == ["缺"] and [(x.event, x.data) for x in got.e] == [("token", '{"a":1}'), ("end", "x")]


def office(name: str, parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def test_office_files_and_broken_ones(spark):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    doc = office("a", {"word/document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>甲</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
    m, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    book = office("b", {
        "xl/workbook.xml": f'<workbook {m} xmlns:r="{r}"><sheets><sheet name="S" r:id="i1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="i1" Target="worksheets/s.xml"/></Relationships>',
        "xl/worksheets/s.xml": f'<worksheet {m}><sheetData><row><c r="A1" t="inlineStr"><is><t>x</t></is></c><c r="B1"><v>3</v></c></row></sheetData><mergeCells><mergeCell ref="A1:A2"/></mergeCells></worksheet>',
    })
    rows = spark.createDataFrame([("a.docx", bytearray(doc)), ("b.xlsx", bytearray(book)), ("c.docx", bytearray(b"no")), ("d.pdf", bytearray(b"%PDF"))], "path string, content binary")
    got = {x.path: (x.text, x.error) for x in files.parsed(rows).collect()}
    assert got["a.docx"] == ("甲\n1 | 2", None) and got["b.xlsx"] == ("[Sheet] S\nx | 3\nx", None)
    assert got["c.docx"][1].startswith("BadZipFile") and got["d.pdf"][1] == "unsupported"
    refused = rows.select("path", files.upload_error(F.col("path"), F.col("content"), F.lit(None).cast("string"), {".docx": 10000, ".xlsx": 10}, {}).alias("e"))
    assert {x.path: x.e for x in refused.collect()} == {"a.docx": None, "b.xlsx": "size", "c.docx": "bytes", "d.pdf": "suffix"}


def test_datasets_report_their_errors(spark):
    lines = spark.createDataFrame([('{"id":"a","question":"q","expected_answer_keywords":["k"]}',), ('{"id":"","question":"q"}',), (" ",)], "value string")
    assert sorted((r.error or "", r.expected_answer_keyword_groups) for r in files.eval_cases(lines).collect()) == [("", [["k"]]), ("id", [])]
    bad = spark.createDataFrame([('{"id":"1","label":"off_topic","query":"q","split":"train"}',)] * 2, "value string")
    assert {r.error for r in files.intent_examples(bad).collect()} == {"repeated"}


def test_stream_counts_equal_batch_counts(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h), "click", h) for h in range(5)] + [(dt.datetime(2024, 1, 3), "view", 9)]
    batch = spark.createDataFrame(rows, "ts timestamp, event_type string, id int")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    run = monitor.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, monitor.windowed_counts(batch).collect()))


@pytest.mark.parametrize("name", ["claim_next_tasks", "keyword_scan_topk", "cited_context", "chunk_table"])
def test_registered_queries_run(spark, name):
    from terrace.plans import registry

    assert registry.queries()[name](spark, "/root/testdata/sf0.001").limit(1).count() == 1


def test_keyword_scan_hands_on_the_best_of_each_task_only(spark, monkeypatch):
    import random

    import pyarrow as pa

    rng = random.Random(5)
    said = [(i, " ".join(rng.choice(["common", "alpha", "beta", "gam", "gamma", "delta"]) for _ in range(rng.randint(0, 9)))) for i in range(300)] + [(300, None), (301, "")]
    asked = [(1, ["common", "alpha", "common"]), (2, ["beta", "gam"]), (3, []), (4, ["", "common", "delta", "gamma"]), (5, ["absent", "beta", "alpha"]), (6, None)]

    def best(k, least):
        out = []
        for q, words in asked:
            found = sorted((-n, -len(t), i) for i, t in said if t is not None and (n := sum(w in t for w in words or () if w)) >= least)
            out += [(q, i, -n, r) for r, (n, _, i) in enumerate(found[:k], 1)]
        return sorted(out)

    chunks, queries = spark.createDataFrame(said, "chunk_id long, text string").repartition(3), spark.createDataFrame(asked, "query_id int, keywords array<string>")
    assert sorted(map(tuple, retrieval.keyword_scan(chunks, queries, 7).collect())) == best(7, 2)
    monkeypatch.setattr(retrieval, "MOST_ASKED", 4)  # several passes
    assert sorted(map(tuple, retrieval.keyword_scan(chunks, queries, 7, 1).collect())) == best(7, 1)
    monkeypatch.setattr(retrieval, "MOST_HELD", 8)  # picked in between
    text = pa.RecordBatch.from_arrays([pa.array([i for i, t in said if t is not None]), pa.array([t for _, t in said if t is not None])], ["chunk_id", "text"])
    made = [r for b in retrieval._most_hits([(0, "common"), (0, "alpha"), (1, "beta"), (1, "gam")], 3, 1)(iter([text[:100], text[100:]])) for r in b.to_pylist()]
    assert len(made) == 6 and sorted(r["chunk_id"] for r in made if r["q"] == 1) == [i for q, i, _, _ in best(3, 1) if q == 2]


def test_candidates_carry_no_texts(spark):
    from terrace.plans import queries

    d = "/root/testdata/sf0.001"
    assert not {"text", "child_text", "parent_text"} & set(queries.candidates(spark, d).columns)
    assert not {"text", "child_text", "parent_text", "matched_children"} & set(queries.parent_rows(spark, d).columns)


def test_texts_of_other_chunks_are_not_shuffled(spark):
    rows, wanted = spark.range(100).withColumn("text", F.lit("x")), spark.createDataFrame([(3,), (3,), (7,), (200,), (None,)], "id long")
    left = retrieval.among(rows, wanted, "id")
    assert sorted(r.id for r in left.collect()) == [3, 7] and "BroadcastHashJoin" in left._jdf.queryExecution().executedPlan().toString()


def test_superseded_stages_of_a_context_are_deleted(spark):
    from terrace.steps import listed, shared_folder

    parents = spark.createDataFrame([(1, "p_0", 1, "甲乙", "q", ["甲"], True, True, "d", "text")], "query_id int, parent_id string, pos int, text string, query string, keywords array<string>, is_policy boolean, is_overview boolean, document_id string, source_type string")
    ranked = parents.select("query_id", "parent_id", F.lit(1).alias("rank"), F.lit(0.5).alias("rerank_score"))
    before = set(listed(spark, shared_folder(spark)))
    assert [r.text for r in context.staged_context(parents, ranked, 3).collect()] == ["甲乙"]
    assert not [x for x in set(listed(spark, shared_folder(spark))) - before if x.startswith("terrace-staged-")]
