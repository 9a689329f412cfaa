"""The kept full-text index against an embedded search library, and against an index built anew."""

from __future__ import annotations

import random
import sqlite3

import pytest

from terrace.operators import lexical

CHUNKS = "chunk_id string, child_text string, parent_text string, document_id string"
WORDS = ["red", "blue", "green", "Café", "naïve", "tree", "house", "river", "stone", "42", "校园", "管理", "x_y", "über"]


def texts(n, seed):
    rng = random.Random(seed)
    prose = lambda k: " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(k))
    return [(f"c{i}", prose(rng.randint(0, 9)), prose(rng.randint(0, 30)), f"d{i % 7}") for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, CHUNKS)


@pytest.fixture
def index(spark, tmp_path):
    return lexical.LexicalIndex(spark, f"{tmp_path}/index", 8)


def library(rows):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, child, parent, whole, tokenize = 'unicode61')")
    db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(i, a, b, f"{a}\n{b}") for i, a, b, _ in rows])
    return db


QUERIES = [(1, ["red tree", "blue"]), (2, ["Café house", "naive", "green green"]), (3, ["校园", "x_y", "42 red blue"]), (4, ["not there", "?!"]), (5, ["uber river", "uber river", "stone"]), (6, [])]


def test_phrases_rank_as_in_an_embedded_search_library(spark, index):
    rows = texts(400, 1)
    index.update(frame(spark, rows))
    queries = spark.createDataFrame(QUERIES, "query_id int, keywords array<string>")
    got = {}
    for r in lexical.phrase_search(index, queries, 400, min_hits=0).collect():
        got.setdefault(r.query_id, {})[r.chunk_id] = r.score
    db = library(rows)
    for q, keywords in QUERIES:
        asked = " OR ".join(f'"{k}"' for k in keywords)
        want = {i: -s for i, s in db.execute("SELECT id, bm25(t) FROM t WHERE t MATCH ?", (asked,))} if keywords else {}
        assert got.get(q, {}).keys() == want.keys() and all(abs(got[q][i] - s) < 2e-6 for i, s in want.items()), q
        assert q in (4, 6) or want


def test_hits_come_first_and_repeats_count(spark, index):
    index.update(frame(spark, [("a", "red tree", "red tree", "d"), ("b", "red", "tree blue", "d"), ("c", "RED TREE", "Blue", "d"), ("e", "", "", "d"), (None, "red tree", "", "d")]))
    got = lexical.phrase_search(index, spark.createDataFrame([(1, ["red tree", "blue"])], "query_id int, keywords array<string>"), 5, min_hits=1).orderBy("rank").collect()
    assert {r.chunk_id: r.keyword_hit_count for r in got} == {"a": 1, "b": 1} and index.n == 4  # c has them in other letters; b spans two lines


def ranked(index, spark):
    queries = spark.createDataFrame(QUERIES, "query_id int, keywords array<string>")
    return sorted(map(tuple, lexical.phrase_search(index, queries, 30, 1).collect())), sorted(map(tuple, lexical.word_search(index, queries, 30).collect()))


def test_batches_equal_an_index_built_anew(spark, index, tmp_path):
    first, second = texts(120, 2), texts(160, 3)
    index.update(frame(spark, first))
    index.update(frame(spark, second[100:160]), spark.createDataFrame([("d3",)], "document_id string"))
    index.update(None, spark.createDataFrame([("c5",), ("c155",), ("c155",), ("nope",), (None,)], "chunk_id string"))
    index.update(frame(spark, [second[7], second[7]]))
    left = {r[0]: r for r in first if r[3] != "d3"} | {r[0]: r for r in second[100:160]}
    left = {k: v for k, v in left.items() if k not in ("c5", "c155")} | {"c7": second[7]}
    anew = lexical.LexicalIndex(spark, f"{tmp_path}/anew", 4)
    anew.update(frame(spark, list(left.values())))
    assert (index.n, index.total) == (anew.n, anew.total) == (len(left), anew.total)
    want = ranked(anew, spark)
    assert ranked(index, spark) == want != ([], [])
    every = spark.createDataFrame([(w,) for w in ("red", "cafe", "校园", "tree", "none")], "token string")
    assert sorted(index.frequencies(every).collect()) == sorted(anew.frequencies(every).collect())
    again = lexical.LexicalIndex(spark, index.path)  # from its folder alone
    assert again.version == 4
    again.compact()
    assert len(again.segments) == 1 and ranked(again, spark) == want and sorted(again.frequencies(every).collect()) == sorted(anew.frequencies(every).collect())
    assert len(again.vacuum()) == 4 and lexical.LexicalIndex(spark, index.path).chunks().count() == len(left)
    again.clear()
    assert ranked(again, spark) == ([], []) and again.n == 0


def test_a_failed_batch_and_a_second_writer_leave_no_trace(spark, index):
    index.update(frame(spark, texts(30, 4)))
    before = ranked(index, spark)
    other = lexical.LexicalIndex(spark, index.path)
    index._publish, publish = (lambda *a: (_ for _ in ()).throw(OSError("lost"))), index._publish
    with pytest.raises(OSError):
        index.update(frame(spark, texts(60, 5)))
    index._publish = publish
    assert ranked(lexical.LexicalIndex(spark, index.path), spark) == before
    index.update(frame(spark, texts(60, 5)))
    with pytest.raises(FileExistsError):
        other.update(frame(spark, texts(10, 6)))
    assert lexical.LexicalIndex(spark, index.path).n == index.n == 60
    assert len(index.vacuum()) == 2


def test_only_asked_buckets_are_read(spark, index):
    index.update(frame(spark, texts(50, 7)))
    plan = index.postings(spark.createDataFrame([("red",)], "token string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan, plan


def test_phrases_go_in_passes_and_repeated_ids_alone_are_shuffled(spark, index, monkeypatch):
    rows = texts(150, 8)
    index.update(frame(spark, [*rows, ("c3", "aaa", "aaa", "d"), ("c4", "zzz red tree", "zzz", "d")]))
    assert {r.chunk_id: r.child_text for r in index.chunks().collect()}["c4"] == "zzz red tree" and index.n == 150
    asked = spark.createDataFrame([("red tree",), ("green green",), ("42 red blue",), ("stone",), ("no such",)], "phrase string")
    found = lambda: sorted((r.phrase, r.chunk_id, sorted(r.starts)) for r in lexical.phrase_starts(index, asked).collect())
    want = found()
    assert {p for p, _, _ in want} >= {"red tree", "stone"}
    monkeypatch.setattr(lexical, "MOST_STARTS", 20)
    assert found() == want
    plan = index.postings(asked.select(lexical.tokens("phrase").alias("t")).selectExpr("explode(t) AS token"))
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text  # postings stay where they are read
    assert "words" not in index.chunks().columns


def test_postings_are_made_where_a_chunk_is_read(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical, "MOST_TOKENS", 3)
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "c", "d"]), pa.array([1, 0, 0, 2]), pa.array([3, 0, 1, 5]), pa.array([["x", "y", "x"], [], ["y"], ["z", "z", "x", "z", "y"]])], ["chunk_id", "split", "size", "_all"])
    got = sorted((r["chunk_id"], r["token"], r["split"], r["size"], r["positions"]) for b in lexical._inverted(iter([batch, batch.slice(1, 1)])) for r in b.to_pylist())
    assert got == [("a", "x", 1, 3, [0, 2]), ("a", "y", 1, 3, [1]), ("c", "y", 0, 1, [0]), ("d", "x", 2, 5, [2]), ("d", "y", 2, 5, [4]), ("d", "z", 2, 5, [0, 1, 3])]
