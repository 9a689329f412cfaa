"""Training and measuring of a linear head on vectors: tasks sum gradients, the driver holds the weights."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions.vectors import doubles, dot, softmax
from terrace.steps import written

# Passes over all examples, step, decay, and the constants of the optimiser.
EPOCHS, RATE, DECAY, BETA1, BETA2, EPSILON = 200, 0.05, 0.001, 0.9, 0.999, 1e-8
#: Labels at most: the weights are a row for each.
MOST_LABELS = 10_000


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _gradient(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, int]:
    """The sum over all rows (pos, v) of the gradient of the log loss, biases last, and how many rows there are."""
    labels, width = weights.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((labels, width)), 0
        for batch in batches:
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width - 1)
            x = np.hstack([x, np.ones((len(x), 1))])
            error = _softmax(x @ weights.T)
            error[np.arange(len(x)), batch.column("pos").to_numpy()] -= 1
            total, n = total + error.T @ x, n + len(x)
        if n:
            at = pa.array(np.arange(0, (labels + 1) * width, width, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(labels, dtype=np.int32)), pa.array(np.full(labels, n)), pa.ListArray.from_arrays(at, pa.array(total.ravel()))], names=["pos", "n", "g"])

    parts = rows.mapInArrow(run, "pos int, n long, g array<double>")
    sums = parts.groupBy("pos").agg(F.sum("n").alias("n"), *[F.sum(F.col("g")[j]).alias(f"g{j}") for j in range(width)]).collect()  # a row for each label
    out = np.zeros((labels, width))
    for r in sums:
        out[r["pos"]] = [r[f"g{j}"] for j in range(width)]
    return out, sums[0]["n"] if sums else 0


def train_head(examples: DataFrame, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> DataFrame:
    """(pos, label, weights, bias): a softmax head of examples (label, vector, split) by adaptive steps on all of ``train`` at once.

    Labels are those of all splits, in order. Weights start at 0; decay adds to the gradient of weights and biases. Examples
    without a label, and vectors of another length than most, are left out.
    """
    spark = examples.sparkSession
    known = examples.where("label is not null and vector is not null").select("label", doubles("vector").alias("v"), "split")
    labels = sorted(r[0] for r in known.select("label").distinct().limit(MOST_LABELS + 1).collect())
    if len(labels) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    kind = dict(examples.dtypes)["label"]
    at = spark.createDataFrame([(x, i) for i, x in enumerate(labels)], f"label {kind}, pos int")
    size = known.where("split = 'train'").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        raise ValueError("no examples to train on")
    rows = written(known.where((F.col("split") == "train") & (F.size("v") == size["n"])).join(F.broadcast(at), "label").select("pos", "v"), "examples")
    weights = np.zeros((len(labels), size["n"] + 1))
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for t in range(1, epochs + 1):
        total, n = _gradient(rows, weights)
        g = total / n + decay * weights
        first, second = BETA1 * first + (1 - BETA1) * g, BETA2 * second + (1 - BETA2) * g**2
        weights = weights - rate * (first / (1 - BETA1**t)) / (np.sqrt(second / (1 - BETA2**t)) + EPSILON)
    made = [(i, x, w[:-1].tolist(), float(w[-1])) for i, (x, w) in enumerate(zip(labels, weights))]
    return spark.createDataFrame(made, f"pos int, label {kind}, weights array<double>, bias double")


def split_metrics(examples: DataFrame, head: DataFrame) -> DataFrame:
    """(split, count, accuracy, macro_f1, loss) of a head on each split; the mean of F1 is over all its labels, one that never
    occurs has 0. Vectors of another length are left out."""
    one = head.agg(F.array_sort(F.collect_list(F.struct("pos", "label", "weights", "bias"))).alias("head"))  # a row for each label
    found = examples.where("label is not null").crossJoin(F.broadcast(one)).where(F.size("vector") == F.size(F.get("head", F.lit(0))["weights"]))
    scored = found.withColumn("p", softmax(F.transform("head", lambda h: dot(F.col("vector"), h["weights"]) + h["bias"])))
    said = F.get("head", (F.array_position("p", F.array_max("p")) - 1).cast("int"))["label"]
    own = F.get("p", (F.array_position(F.transform("head", lambda h: h["label"]), F.col("label")) - 1).cast("int"))
    rows = scored.select("split", "label", said.alias("said"), (-F.log(own)).alias("loss"), F.size("head").alias("labels"))
    whole = rows.groupBy("split").agg(F.count("*").alias("count"), F.avg((F.col("said") == F.col("label")).cast("int")).alias("accuracy"), F.avg("loss").alias("loss"), F.max("labels").alias("labels"))
    each = rows.select("split", F.explode(F.array_distinct(F.array("label", "said"))).alias("x"), "label", "said").groupBy("split", "x").agg(
        F.count_if((F.col("label") == F.col("x")) & (F.col("said") == F.col("x"))).alias("tp"), F.count_if(F.col("said") == F.col("x")).alias("told"), F.count_if(F.col("label") == F.col("x")).alias("real")
    )
    f1 = each.groupBy("split").agg(F.sum(2 * F.col("tp") / (F.col("told") + F.col("real"))).alias("f1"))
    return whole.join(f1, "split").select("split", "count", F.round("accuracy", 4).alias("accuracy"), F.round(F.col("f1") / F.col("labels"), 4).alias("macro_f1"), F.round("loss", 4).alias("loss"))
