"""Dense search by blocks and cells, training of a head, and payloads, against plain models."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.operators import cells, payloads, retrieval, training


def frames(spark, v, q):
    return (
        spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, embedding array<double>").repartition(4),
        spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, query_vector array<double>"),
    )


def exact(v, q, k):
    far = np.round(((q[:, None, :] - v[None]) ** 2).sum(axis=2), 6)
    return {(i, int(c), n + 1) for i, row in enumerate(far) for n, c in enumerate(np.lexsort((np.arange(len(v)), row))[:k])}


def points(df):
    return {(r.query_id, r.chunk_id, r["rank"]) for r in df.collect()}


def test_blocks_of_queries_give_the_same_answers(spark, monkeypatch):
    rng = np.random.default_rng(1)
    v, q = np.round(rng.normal(size=(300, 5)), 1), np.round(rng.normal(size=(50, 5)), 1)
    v[100:140] = v[0]  # ties
    given = frames(spark, v, q)
    monkeypatch.setattr(retrieval, "BLOCK", 7)
    assert points(retrieval.dense(*given, 6)) == exact(v, q, 6)


def test_vectors_of_another_length_have_cosine_0(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [-1.0, 0.0])], "chunk_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id long, query_vector array<double>")
    assert [(r.chunk_id, r.similarity) for r in retrieval.dense(rows, asked, 4, "cosine").orderBy("rank").collect()] == [(1, 1.0), (2, 0.0), (3, 0.0), (4, -1.0)]
    assert [(r.chunk_id, r.distance) for r in retrieval.dense(rows, asked, 4).orderBy("rank").collect()] == [(1, 0.0), (4, 4.0)]


def test_cells_answer_exactly_and_nearly_and_read_less(spark, tmp_path):
    rng = np.random.default_rng(2)
    hubs = rng.normal(size=(12, 8)) * 4
    v = hubs[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 8)) * 0.5
    v[:400] = v[0]  # a hot vector
    q = np.vstack([v[rng.integers(0, 1500, 30)] + 0.01, rng.normal(size=(10, 8)) * 4])
    given = frames(spark, v, q)
    kept = cells.VectorCells(spark, f"{tmp_path}/cells").build(given[0], 12)
    assert points(kept.search(given[1], 10, probes=1, exact=True)) == exact(v, q, 10)
    near = kept.search(given[1], 10, probes=3)
    want = exact(v, q, 10)
    found, right = {(i, c) for i, c, _ in points(near)}, {(i, c) for i, c, _ in want}
    assert len(found & right) >= 0.9 * len(right)
    one = spark.createDataFrame([(0, q[0].tolist())], "query_id long, query_vector array<double>")
    plan = kept.search(one, 5, probes=1)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1][:80]
    other = spark.createDataFrame([(0, [1.0, 2.0])], "query_id long, query_vector array<double>")
    assert kept.search(other, 5).count() == 0
    with pytest.raises(ValueError):
        cells.VectorCells(spark, f"{tmp_path}/none").build(given[0].limit(0), 4)


def test_recall_of_cells_on_the_given_vectors(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = rows.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    kept = cells.VectorCells(spark, f"{tmp_path}/cells").build(rows, 16)
    right = {(r.query_id, r.chunk_id) for r in retrieval.dense(rows, asked, 15).collect()}
    found = {(r.query_id, r.chunk_id) for r in kept.search(asked, 15).collect()}
    assert len(found & right) >= 0.9 * len(right), len(found & right) / len(right)


def test_head_equals_a_plain_fit(spark):
    rng = np.random.default_rng(3)
    hubs = rng.normal(size=(4, 6))
    y = rng.integers(0, 4, 240)
    x = hubs[y] + rng.normal(size=(240, 6))
    split = np.where(rng.random(240) < 0.7, "train", "validation")
    rows = [(f"l{a}", b.tolist(), str(c)) for a, b, c in zip(y, x, split)] + [(None, [0.0] * 6, "train"), ("l0", None, "train"), ("l1", [1.0], "train"), ("l9", [0.0] * 6, "test")]
    examples = spark.createDataFrame(rows, "label string, vector array<double>, split string").repartition(5)
    head = training.train_head(examples, epochs=40)
    labels = ["l0", "l1", "l2", "l3", "l9"]
    tx, ty = np.hstack([x[split == "train"], np.ones((sum(split == "train"), 1))]), y[split == "train"]
    w, m, s = np.zeros((5, 7)), np.zeros((5, 7)), np.zeros((5, 7))
    for t in range(1, 41):
        e = np.exp(tx @ w.T)
        p = e / e.sum(axis=1, keepdims=True)
        p[np.arange(len(ty)), ty] -= 1
        g = p.T @ tx / len(ty) + 0.001 * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    got = head.orderBy("pos").collect()
    assert [r.label for r in got] == labels and np.allclose([[*r.weights, r.bias] for r in got], w, atol=1e-9)
    told = {r["split"]: r for r in training.split_metrics(examples, head).collect()}
    vx, vy = np.hstack([x[split == "validation"], np.ones((sum(split == "validation"), 1))]), y[split == "validation"]
    said = (vx @ w.T).argmax(axis=1)
    f1 = [2 * ((said == c) & (vy == c)).sum() / max(1, (said == c).sum() + (vy == c).sum()) for c in range(5)]
    assert told["validation"]["count"] == len(vy) and abs(told["validation"].accuracy - (said == vy).mean()) < 1e-4 and abs(told["validation"].macro_f1 - np.mean(f1)) < 1e-4
    assert told["validation"].accuracy > 0.6


def test_payloads_keep_what_is_malformed_and_fall_back(spark):
    texts = ['{"a": {"b": [1, {"c": "x"}]}, "n": "7.5", "t": true, "z": null}', '{"a": 3', "[1, 2]", None, '"word"', "{}"]
    rows = payloads.parsed(spark.createDataFrame(list(enumerate(texts)), "id int, p string"), "p")
    got = rows.select("id", "malformed", payloads.field("payload", "$.a.b[1].c", "string", "none").alias("c"), payloads.number("payload", "$.n").alias("n"), payloads.number("payload", "$.t").alias("t"), payloads.number("payload", "$.a").alias("a")).orderBy("id").collect()
    assert [tuple(r)[1:] for r in got] == [(False, "x", 7.5, 1.0, 0.0), (True, "none", 0.0, 0.0, 0.0), *[(False, "none", 0.0, 0.0, 0.0)] * 4]
    whole = payloads.entries(rows).select("id", "key", payloads.nature(F.col("value")).alias("nature")).collect()
    assert {(r.id, r.key, r.nature) for r in whole if r.nature} == {(0, "a", "object"), (0, "n", "text"), (0, "t", "boolean"), (0, "z", "null"), (2, None, "number")}


def test_changes_of_cases(spark):
    rng = random.Random(1)
    make = lambda: [(i, rng.choice([json.dumps({"hit": rng.choice([True, False, 1, "0.5", None, [1]]), "debug": rng.choice([{"ms": rng.randint(1, 3)}, "none", {}])}), "{broken", None])) for i in range(60)]
    a, b = make(), make()[5:]

    def value(text, name):
        try:
            x = json.loads(text)
            x = x["debug"]["ms"] if name == "ms" else x["hit"]
            return float(x)
        except (TypeError, ValueError, KeyError):
            return 0.0

    frame = lambda rows: payloads.parsed(spark.createDataFrame(rows, "case_id int, p string"), "p")
    found = payloads.case_changes(frame(a), frame(b), {"hit": "$.hit", "ms": "$.debug.ms"}, ["ms"])
    told = {(r.metric, r.case_id): (r.baseline, r.contender, r.change) for r in found.collect()}
    other = dict(b)
    for i, text in a:
        for name in ("hit", "ms"):
            if i not in other:
                assert (name, i) not in told
                continue
            x, y = value(text, name), value(other[i], name)
            better = y < x if name == "ms" else y > x
            assert told[name, i] == (x, y, "unchanged" if x == y else "improved" if better else "regressed")
    assert sum(r.cases for r in payloads.change_summary(found).collect()) == len(told) == 110
