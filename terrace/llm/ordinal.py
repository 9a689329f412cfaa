"""Quality grades by an ordinal cumulative-link regression on hashed text."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import row_of, table

SLOTS = 1 << 18
#: At most so many labelled rows, those of least hash, are used to fit.
SAMPLE = 12_000
#: Words' slots seen in fewer labelled documents weigh nothing.
LEAST_DOCS = 12
ROUNDS = 250
SMOOTH = 2e-4
CUTOFF = 0.5
CACHE = 500_000
STEPS = (0.02, 0.1, 0.3, 0.6)
TAILS = re.compile(r"[#%&*$!?]{2,}")
SHAPES = 8 * (1 + len(STEPS))


def words_of(text: str) -> list[str]:
    return text.lower().split()


def shapes_of(text: str, words: list[str], distinct: int) -> list[float]:
    """Shares of the text that tell prose from noise, each as it is and as steps."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    size, n, lines = max(1, raw.size), max(1, len(words)), text.split("\n")
    upper = np.count_nonzero((raw >= 65) & (raw <= 90))
    digit = np.count_nonzero((raw >= 48) & (raw <= 57))
    shares = (
        words.count("|") / n, len(TAILS.findall(text)) / n, 1 - distinct / n, upper / size, digit / size,
        1 - len(set(lines)) / len(lines), min(1.0, abs(size / n - 6) / 10), 1.0 / n,
    )
    return [x for s in shares for x in (s, *(float(s > t) for t in STEPS))]


def slot(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) & (SLOTS - 1)


@dataclass
class OrdinalModel:
    """P(grade <= k) = logistic(cuts[k] - score), where the score sums one weight for each distinct word's slot and each shape."""

    weights: np.ndarray
    shapes: np.ndarray
    cuts: np.ndarray

    def scores(self, texts: Iterator[str | None], cache: dict[str, float]) -> np.ndarray:
        out = []
        for t in texts:
            words = words_of(t or "")
            distinct = set(words)
            if len(cache) > CACHE:
                cache.clear()
            total = 0.0
            for w in sorted(distinct):  # a fixed order, so that sums agree to the last bit
                got = cache.get(w)
                if got is None:
                    got = cache[w] = float(self.weights[slot(w)])
                if got:
                    total += got
            out.append(total + float(np.dot(self.shapes, shapes_of(t or "", words, len(distinct)))))
        return np.array(out)

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1 on, a column each."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - scores[:, None], -40, 40)))


def fit(rows: list[np.ndarray], shapes: np.ndarray, grades: np.ndarray, levels: int, rounds: int = ROUNDS, smooth: float = SMOOTH) -> OrdinalModel:
    """Weights and ordered cuts of least regularised log loss, by full-batch adaptive gradient steps from 0.

    Cuts are kept in order by fitting the logarithms of the steps between them. Without rows all weights are 0.
    """
    n = len(rows)
    cuts = np.arange(levels - 1) - (levels - 2) / 2.0
    if not n:
        return OrdinalModel(np.zeros(SLOTS), np.zeros(SHAPES), cuts)
    flat = np.concatenate([np.zeros(0, np.int32), *rows])
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    first = np.ones(flat.size, bool)
    first[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])  # slots come sorted
    seen = np.bincount(flat[first], minlength=SLOTS)
    used = np.flatnonzero(seen >= LEAST_DOCS)
    place = np.full(SLOTS, -1, np.int32)
    place[used] = np.arange(used.size)
    col = place[flat]
    owner, col = owner[col >= 0], col[col >= 0]
    del flat, first
    share = np.bincount(grades, minlength=levels) / n
    mass = np.sqrt(1 / np.maximum(share, 1 / n))[grades]
    mass /= mass.sum()
    theta = np.concatenate([np.zeros(used.size + shapes.shape[1]), [cuts[0]], np.zeros(levels - 2)])
    k, g2 = used.size, np.full(theta.size, 1e-8)
    decay = np.concatenate([np.full(k, smooth), np.full(shapes.shape[1], smooth / 10), np.zeros(levels - 1)])
    for _ in range(rounds):
        w, v, c = theta[:k], theta[k : k + shapes.shape[1]], theta[k + shapes.shape[1] :]
        bounds = np.concatenate([[c[0]], c[0] + np.cumsum(np.exp(c[1:]))])
        s = np.bincount(owner, w[col], n) + shapes @ v
        edge = np.concatenate([[-np.inf], bounds, [np.inf]])
        up = 1 / (1 + np.exp(-np.clip(edge[grades + 1] - s, -40, 40)))
        lo = 1 / (1 + np.exp(-np.clip(edge[grades] - s, -40, 40)))
        up[grades == levels - 1], lo[grades == 0] = 1.0, 0.0
        p = np.maximum(up - lo, 1e-12)
        du, dl = up * (1 - up) / p * mass, lo * (1 - lo) / p * mass
        ds = du - dl
        db = np.array([-du[grades == j].sum() + dl[grades == j + 1].sum() for j in range(levels - 1)])
        steps = np.exp(c[1:])
        dc = np.concatenate([[db.sum()], [db[j + 1 :].sum() * steps[j] for j in range(levels - 2)]])
        grad = np.concatenate([np.bincount(col, ds[owner], k), shapes.T @ ds, dc]) + decay * theta
        g2 += grad**2
        theta -= 0.5 * grad / np.sqrt(g2)
    weights = np.zeros(SLOTS)
    weights[used] = theta[:k]
    c = theta[k + shapes.shape[1] :]
    return OrdinalModel(weights, theta[k : k + shapes.shape[1]], np.concatenate([[c[0]], c[0] + np.cumsum(np.exp(c[1:]))]))


def graded(labels: DataFrame) -> DataFrame:
    """Ratings 0 (toxic), 1 (poor) and 2 (good) of labelled documents; rows without a label are left out."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade")).where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, grades: DataFrame, levels: int = 3, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most ``sample`` rated documents, those of least hash of their key; the driver gets the model alone.

    ``sample`` bounds what one task fits. A document whose key repeats counts once, by the least hash of its text. Null keys
    and grades teach nothing; without rated documents all weights are 0.
    """
    chosen = grades.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(sample)
    rated = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t, g in zip(batch["doc_id"], batch["text"], batch["grade"]):
                words = words_of(t or "")
                distinct = set(words)
                out.append((k, g, zlib.crc32((t or "").encode("utf-8", "replace")), np.array(sorted(map(slot, distinct)), "<i4").tobytes(), np.array(shapes_of(t or "", words, len(distinct))).tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "grade", "th", "slots", "shapes"])

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots, shapes, marks = [], [], []
        for batch in batches:  # in order of doc_id
            for _, g, _, s, x in batch.itertuples(index=False, name=None):
                slots.append(np.frombuffer(s, "<i4"))
                shapes.append(np.frombuffer(x))
                marks.append(g)
        model = fit(slots, np.array(shapes).reshape(len(slots), SHAPES), np.array(marks, np.int64), levels)
        yield pd.DataFrame({"weights": [model.weights.tobytes()], "shapes": [model.shapes.tobytes()], "cuts": [model.cuts.tobytes()]})

    made = rated.mapInPandas(features, "doc_id long, grade int, th long, slots binary, shapes binary")
    one = made.groupBy("doc_id").agg(F.min(F.struct("th", "grade", "slots", "shapes")).alias("x")).select("doc_id", "x.*")  # a key may repeat without bound
    row = one.select("doc_id", "grade", "th", "slots", "shapes").repartition(1).sortWithinPartitions("doc_id").mapInPandas(learn, "weights binary, shapes binary, cuts binary").first()  # at most ``sample`` keys
    return OrdinalModel(*[np.frombuffer(x) for x in row]) if row else fit([], np.zeros((0, SHAPES)), np.zeros(0, np.int64), levels)


def judged(docs: DataFrame, model: OrdinalModel, text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """(doc, s): each row as it came, and a struct of score, expected_grade, tail_1 ... tail_k = P(grade >= k), and kept (the last
    tail reaches ``cutoff``). Null and empty texts have no words and are scored by their shapes alone."""
    names = ["score", "expected_grade", *[f"tail_{k + 1}" for k in range(len(model.cuts))], "kept"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB whatever the input

    @F.pandas_udf(", ".join(f"{c} {'boolean' if c == 'kept' else 'double'}" for c in names))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache: dict[str, float] = {}
        for texts in batches:
            s = shared.value.scores(texts, cache)
            tails = shared.value.tails(s)
            yield pd.DataFrame({"score": s, "expected_grade": tails.sum(axis=1), **{f"tail_{k + 1}": tails[:, k] for k in range(tails.shape[1])}, "kept": tails[:, -1] >= cutoff})[names]

    return docs.select(row_of(docs).alias("doc"), run(F.coalesce(F.col(text), F.lit(""))).alias("s"))


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows with the columns of :func:`judged` beside their own, which these replace where names are the same."""
    found = judged(docs, model, text, cutoff)
    own = {x.lower() for x in found.schema["s"].dataType.names}
    return found.select(*[F.col(f"doc.`{c}`") for c in docs.columns if c.lower() not in own], "s.*")


def keep_good(docs: DataFrame, model: OrdinalModel, text: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows whose probability of the best grade reaches ``cutoff``, in the columns they came with, whatever their names."""
    return judged(docs, model, text, cutoff).where("s.kept").select("doc.*")


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, expected grade, tail probabilities and decision of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, graded(table(spark, sf_dir, "labels")))
    return score(docs.select("doc_id", "text"), model).drop("text")
