"""Clusters, language-model scores and repaired conversations against brute force, with odd inputs."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from terrace.llm import brown, centroids, repair

VECTORS = "vec_id long, embedding array<float>, v string, head string, rest string, cluster string, distance string, h string"
TALK = "conv_id long, turn long, role string, text string, conv string, first string, said string, _t string, fate string"
TEXTS = "doc_id long, text string, row string, key string, ids string, rare string, word string, held_out string"


def lloyd(rows, k, rounds, dims, scale):
    """The contract's rounds, a vector at a time."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    points = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        points = [[sum(x) // len(own[c]) for x in zip(*own[c])] if own[c] else p for c, p in enumerate(points)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    sums = Counter()
    for _, c, d in found:
        sums[c] += d
    return [(i, c, d, sums[c], sum(sums.values()), hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for i, c, d in found]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, *"abcdef") for i, v in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("spread", [0.01, 0.3, 40.0])
def test_clusters_equal_plain_rounds(spark, spread):
    rng = random.Random(spread)
    hubs = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, spread) for x in rng.choice(hubs)]) for i in range(400)]
    rows += [(7, [0.5] * 6), (7, [0.5] * 6), (None, [0.25] * 6), (None, None), (900, [1.0] * 5), (901, [None] + [1.0] * 5), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [])]
    rows += [(1000 + i, [0.1] * 6) for i in range(300)]  # a hot vector
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    found = centroids.centroid_clusters(vectors(spark, rows), k=8, dims=6, lead=2)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(lloyd(rows, 8, 3, 6, 64), key=repr)


def test_clusters_of_few_or_no_or_huge_vectors(spark):
    few = [(i, [float(i % 2)] * 4) for i in range(3)]
    found = centroids.centroid_clusters(vectors(spark, few), k=8, dims=4).collect()
    assert sorted(map(tuple, found)) == sorted(lloyd(few, 8, 3, 4, 64))
    assert centroids.centroid_clusters(vectors(spark, [])).count() == 0
    huge = centroids.centroid_clusters(vectors(spark, [(1, [3e38] * 4), (2, [-3e38] * 4)]), k=1, dims=4).collect()
    assert [r.distance for r in huge] == [4 * centroids.LIMIT**2] * 2  # held to the limit, the mean is 0


def test_bound_spares_distances_and_ties_go_to_the_smaller_number():
    rng = np.random.default_rng(3)
    hubs = rng.normal(0, 40, (16, 64)).astype(np.int64)
    v = (hubs[rng.integers(0, 16, 3000)] + rng.normal(0, 3, (3000, 64))).astype(np.int64)
    axes = np.linalg.eigh(np.cov(v.T))[1][:, ::-1]
    points = centroids.Centroids.of([*hubs.tolist()[:15], hubs[3].tolist()], axes, 16)
    turned = v @ axes
    cluster, distance, tested = points.nearest(v, turned[:, :16], np.linalg.norm(turned[:, 16:], axis=1))
    exact = ((v[:, None, :] - points.points[None]) ** 2).sum(axis=2)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all() and 15 not in cluster
    assert tested < 0.2 * exact.size, tested


def texts_of(spark, rows):
    return spark.createDataFrame([(i, t, *"abcdef") for i, t in rows], TEXTS).repartition(3)


def tokens_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 10 == 0


@pytest.fixture(scope="module")
def prose():
    """Sentences in which kinds of words alternate, so that classes tell what comes next; and odd texts."""
    rng = random.Random(4)
    kinds = [[f"{k}{i}x" for i in range(60)] for k in ("da", "no", "ve", "ad")]
    rows = [(i, " ".join(rng.choices(kinds[j % 4], [1 / (1 + n) for n in range(60)])[0] for j in range(rng.randint(5, 40)))) for i in range(900)]
    return rows + [(None, "Nul Id"), (5000, None), (5001, ""), (5002, " \t\n"), (5003, "Q" * 5000 + " ümlaut Ümlaut \x1c \x85 \xa0"), (5004, "da1x " * 3000), (5004, "da1x " * 3000), (5005, "only once, here. 77")]


def test_base_scores_equal_counts(spark, prose):
    train, n = Counter(), 0
    for i, t in prose:
        if not held(i):
            train.update(tokens_of(t))
    n, v = train.total(), len(train)
    found = brown.class_scores(texts_of(spark, prose), known=100, clustered=40, classes=6, rounds=3)
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    want = []
    for i, t in prose:
        words = tokens_of(t)
        want.append((i, held(i), len(words), sum(train[w] > 0 for w in words), n, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)))
    got = found.collect()
    key = lambda r: (str(r[0]), r[2])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert tuple(a)[:5] == b[:5] and abs(a.base_score - b[5]) < 1e-6 * max(1, abs(b[5])), (a, b)
    outside = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    gain = sum(r.score - r.base_score for r in outside) / sum(r.n_tokens for r in outside)
    assert gain > 0.3, gain  # the kind of the next word is known: log10(4) = 0.6 at most, less what shapes lose


def test_scores_equal_the_model_and_sum_to_one(spark, prose):
    docs = texts_of(spark, prose)
    counts = brown.word_counts(docs.where(~brown.held_out(docs.doc_id)).select(docs.text.cast("binary").alias("text")))
    frequent, times = brown.most_frequent(counts, 100)
    words = brown.Words(frequent, 40)
    rows = docs.selectExpr("monotonically_increasing_id() as row", "doc_id as key", "false as held_out", "cast(text as binary) as text")
    codes = brown.encoded(rows.where(~brown.held_out(rows.key)), words)
    model = brown.learn(codes, counts, words, times, 6, 3)
    told = [(bytes(r.word), r["shape"], r.c) for r in counts.collect()]
    table, shape = {w: c for w, _, c in told}, {w: s for w, s, _ in told if w.startswith(b" ")}  # digests of long words
    at = {w: i for i, w in enumerate(frequent)}

    def emission(word):
        if word is None:
            return model.lut[words.end], 0.0
        w = word if isinstance(word, bytes) else word.encode()
        if w in at:
            return model.lut[at[w]], model.emits[at[w]]
        s = shape.get(w, brown.shape_of(w))
        return model.lut[words.end + 1 + s], math.log10((table.get(brown.name_of(w), table.get(w, 0)) + 0.1) / model.shape_mass[s])

    want = []
    for _, t in prose:
        before, total = [model.lut[words.end]] * 2, 0.0
        for w in tokens_of(t):
            c, e = emission(w)
            total += model.steps[before[0], before[1], c] + e
            before = [before[1], c]
        want.append(total)
    got = [r.score for r in brown.scored(brown.encoded(rows, words), counts, model).collect()]
    assert np.allclose(sorted(got), sorted(want), rtol=1e-9)
    mass = defaultdict(float)  # of each class: all training words, the end, and one unknown word of each shape
    for w in [None, *table]:
        if w != brown.END:
            c, e = emission(w)
            mass[c] += 10**e
    for s in range(brown.SHAPES):
        mass[model.lut[words.end + 1 + s]] += 0.1 / model.shape_mass[s]
    for x, y in itertools.product(range(0, model.steps.shape[0], 5), repeat=2):
        assert abs(sum(10 ** model.steps[x, y, c] * m for c, m in mass.items()) - 1) < 1e-9


def test_gains_equal_differences_of_likelihood():
    rng = np.random.default_rng(2)
    words, targets, total = 30, 4, 6
    bigrams = rng.integers(0, 9, (words, words)).astype(float)
    at = rng.integers(0, total, words)

    def whole(at):
        out = np.zeros((total, total))
        np.add.at(out, (at[:, None].repeat(words, 1), at[None, :].repeat(words, 0)), bigrams)
        return out

    side = np.zeros((words, total))
    r, l = side.copy(), side.copy()
    for c in range(total):
        r[:, c], l[:, c] = bigrams[:, at == c].sum(axis=1), bigrams[at == c].sum(axis=0)
    got = brown.gains(r, l, np.diag(bigrams).copy(), at, whole(at), targets)
    for w in range(words):
        moved = [brown.likelihood(whole(np.where(np.arange(words) == w, c, at))) for c in range(targets)]
        assert np.allclose(got[w] - got[w][0], np.array(moved) - moved[0], atol=1e-6)


def test_exchange_raises_the_likelihood(spark, prose):
    docs = texts_of(spark, prose)
    raw = docs.select(docs.text.cast("binary").alias("text"))
    frequent, _ = brown.most_frequent(brown.word_counts(raw), 400)
    words = brown.Words(frequent, len(frequent))
    codes = brown.encoded(docs.selectExpr("1L as row", "doc_id as key", "false as held_out", "cast(text as binary) as text"), words)
    at, seen = brown.exchange(brown.neighbours(codes, words), words.clustered, 8, 8)
    assert seen[-1] > seen[1]
    classes = defaultdict(Counter)
    for i, w in enumerate(frequent):
        if re.fullmatch(rb"(da|no|ve|ad)\d+x", w):
            classes[at[i]][w[:2]] += 1
    assert sum(c.most_common(1)[0][1] for c in classes.values()) >= 0.95 * sum(c.total() for c in classes.values()), classes
    assert {c.most_common(1)[0][0] for c in classes.values()} == {b"da", b"no", b"ve", b"ad"}


def test_scores_without_training_or_rows(spark):
    assert brown.class_scores(texts_of(spark, [])).count() == 0
    alone = [i for i in range(200) if held(i)][:3]
    found = brown.class_scores(texts_of(spark, [(i, "some words") for i in alone])).collect()
    assert {(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found} == {(True, 3, 0, 0, 0.0)} and all(math.isfinite(r.score) for r in found)


def damaged(rows):
    """The contract's damage, a row at a time, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        here = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        here += [(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def cheapest(rows):
    """Counts and repair of a conversation by searching all edits, cheapest and then ASCII-least first."""
    turns = [t for t, _, _ in rows if t is not None]
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            break
        if (i, roles) in done:
            continue
        done.add((i, roles))
        steps = []
        if i < len(rows):
            _, role, text = rows[i]
            steps.append((4, "D", 1, "", None))
            if faults[i] not in ("b", "d"):
                more = 3 if faults[i] == "t" else 0
                steps.append((more, "K", 1, role[:1] or "-", f"{role}:{text}"))
                steps += [(3 + more, "R", 1, r[0], f"{r}:{text}") for r in ("user", "assistant")]
        steps += [(3, "I", 0, r[0], f"{r}:") for r in ("user", "assistant")]
        for c, e, n, r, line in steps:
            if re.fullmatch("s?(ua)*u?", roles + r):
                heapq.heappush(heap, (cost + c, audit + e, i + n, roles + r, lines if line is None else (*lines, line)))
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def talk(spark, rows):
    return spark.createDataFrame([(*r, *"abcde") for r in rows], TALK).repartition(3)


@pytest.fixture(scope="module")
def chats():
    rng = random.Random(8)
    said = ["Yes.", "No!", "Why?", "so", "", " \t", "Well. ", "end", "Ümläut 世界."]
    rows = []
    for conv in range(400):
        roles = ["system"] * (rng.random() < 0.3) + ["user", "assistant"] * 4
        for turn in range(rng.randint(1, 8)):
            role = roles[turn] if rng.random() < 0.8 else rng.choice(["system", "user", "assistant", "tool", "", None, "User", "ubuntu"])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None]), role, rng.choice([*said, f"Said {turn}.", f"Said {turn}.", None])))
    return rows + [(None, 1, "user", "Hi."), (None, None, None, None)]


def test_repairs_equal_a_search_of_all_edits(spark, chats):
    found = repair.repair_digests(repair.damage(talk(spark, chats))).collect()
    want = {c: cheapest(r) for c, r in damaged(chats).items()}
    assert {r.conv_id: tuple(r)[1:] for r in found} == want and len(found) == len(want)
    assert any(c[6] == "" for c in want.values())


def test_repaired_turns_are_what_the_digest_is_of(spark, chats):
    rows = repair.damage(talk(spark, chats))
    turns = defaultdict(list)
    for r in repair.repaired_turns(rows).orderBy("turn").collect():
        turns[r.conv_id].append(f"{r.role}:{r.text}")
    for r in repair.repair_digests(rows).collect():
        assert hashlib.sha256("\n".join(turns[r.conv_id]).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in turns[r.conv_id]))
    clean = [(1, 0, "user", "A."), (1, 1, "assistant", "B.")]
    assert [(r.cost, r.audit) for r in repair.repair_digests(repair.plain(talk(spark, clean))).collect()] == [(0, "KK")]
    assert repair.repair_digests(repair.damage(talk(spark, []))).count() == 0 and repair.repaired_turns(repair.plain(talk(spark, []))).count() == 0


@pytest.mark.parametrize("kind", ["clean", "blank", "users", "mixed"])
def test_long_conversations_keep_a_small_tree(kind):
    rng = random.Random(1)
    sent = Counter()
    search = repair.Survivors(lambda e, row: sent.update([e]))
    for i in range(20_000):
        role = {"clean": ("user", "assistant")[i % 2], "blank": "user", "users": "user", "mixed": rng.choice(["user", "assistant", "system", "tool"])}[kind]
        search.step(role, "x", kind == "blank" or kind == "mixed" and rng.random() < 0.2, kind == "mixed" and rng.random() < 0.3)
    assert search.deepest < 64 or kind == "users", search.deepest  # there two repairs stay as good to the end
    search.finish()
    assert sent.total() >= 20_000
