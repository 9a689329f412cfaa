"""Centroid clustering of integer vectors; a bound from PCA-rotated coordinates spares most exact distances."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.llm.common import scratch, stored, table

DIMS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
#: Rotated coordinates that are stored of each vector; the others count by their norm alone.
HEAD = 16
#: Integer components are held within these bounds, so that squared distances of 64 of them stay whole longs.
LIMIT = 1 << 26
MOST = (1 << 63) - 1


def integers(vector: Column, scale: int = SCALE) -> Column:
    """Each component x as floor(scale * x), in double, held to LIMIT on both sides."""
    held = lambda x: F.greatest(F.least(x.cast("double") * F.lit(float(scale)), F.lit(float(LIMIT))), F.lit(float(-LIMIT)))
    return F.transform(vector, lambda x: F.floor(held(x)).cast("int"))


def usable(vector: Column, dims: int = DIMS) -> Column:
    """Whether a vector has exactly ``dims`` components, none null or not finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce((F.size(vector) == dims) & ~F.exists(vector, odd), F.lit(False))


def matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """A list column whose lists all have ``width`` values."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


def lists(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as a list column."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.array(values.ravel()))


def rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """The principal axes of all vectors as columns, by falling variance. Tasks sum products; the driver gets dims + 1 rows.

    Sums in doubles are enough: the axes decide what is spared, not what is found.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, total, n = np.zeros((dims, dims)), np.zeros(dims), 0
        for batch in batches:
            x = matrix(batch.column("v"), dims, np.float64)
            gram, total, n = gram + x.T @ x, total + x.sum(axis=0), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1, dtype=np.int32)), pa.array(np.full(dims + 1, n, np.int64)), lists(np.vstack([gram, total]))], names=["i", "n", "s"])

    parts = vectors.select("v").mapInArrow(moments, "i int, n long, s array<double>")
    sums = parts.groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(dims)]).orderBy("i").collect()
    if not sums:
        return np.eye(dims)
    n = sums[0]["n"]
    full = np.array([[row[f"s{j}"] for j in range(dims)] for row in sums])
    mean = full[dims] / n
    _, axes = np.linalg.eigh(full[:dims] / n - np.outer(mean, mean))
    return axes[:, ::-1]


@dataclass
class Centroids:
    """Integer centroids with their leading rotated coordinates and the norms of the others."""

    points: np.ndarray
    head: np.ndarray
    rest: np.ndarray

    @staticmethod
    def of(points: list[list[int]], axes: np.ndarray, lead: int) -> Centroids:
        whole = np.array(points, np.int64).reshape(len(points), axes.shape[0])
        turned = whole.astype(float) @ axes
        return Centroids(whole, turned[:, :lead], np.linalg.norm(turned[:, lead:], axis=1))

    def nearest(self, v: np.ndarray, head: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each vector the nearest centroid (ties: the smaller number), its squared distance, and how many distances were computed.

        The squared distance of the leading coordinates plus the squared difference of the norms of the others never exceeds the
        squared distance. The centroid of least bound is computed first; of the others only those are whose bound, less what
        rounding may add, reaches no further than the best found. These distances are in integers, so no tie is decided by rounding.
        """
        own, other = (head**2).sum(axis=1) + rest**2, (self.head**2).sum(axis=1) + self.rest**2
        apart = (head**2).sum(axis=1)[:, None] + (self.head**2).sum(axis=1)[None, :] - 2 * head @ self.head.T
        low = apart + (rest[:, None] - self.rest[None, :]) ** 2
        low -= 1e-9 * (own[:, None] + other[None, :]) + 1e-6
        first = low.argmin(axis=1)
        best, cluster, tested = ((v - self.points[first]) ** 2).sum(axis=1), first.copy(), len(v)
        for c in range(len(self.points)):
            rows = np.flatnonzero((low[:, c] <= best) & (first != c))
            d = ((v[rows] - self.points[c]) ** 2).sum(axis=1)
            won = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
            best[rows[won]], cluster[rows[won]] = d[won], c
            tested += len(rows)
        return cluster, best, tested


def assigner(centroids: Centroids, dims: int, lead: int) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    def run(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v = matrix(batch.column("v"), dims, np.int64)
        cluster, distance, _ = centroids.nearest(v, matrix(batch.column("head"), lead, np.float64), batch.column("rest").to_numpy())
        return v, cluster, distance

    return run


def moved(vectors: DataFrame, centroids: Centroids, dims: int, lead: int) -> list[list[int]]:
    """The floor of each centroid's mean; a centroid without vectors stays. Tasks send a row per centroid, summed exactly by Spark."""
    assign, k = assigner(centroids, dims, lead), len(centroids.points)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            v, cluster, _ = assign(batch)
            np.add.at(total, cluster, v)
            n += np.bincount(cluster, minlength=k)
        got = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(got.astype(np.int32)), pa.array(n[got]), lists(total[got])], names=["cluster", "n", "s"])

    made = vectors.select("v", "head", "rest").mapInArrow(sums, "cluster int, n long, s array<long>")
    rows = made.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(dims)]).collect()
    out = centroids.points.tolist()
    for row in rows:
        out[row["cluster"]] = [int(row[f"s{j}"]) // row["n"] for j in range(dims)]
    return out


def centroid_clusters(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, lead: int = HEAD) -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector, after ``rounds`` rounds.

    Vectors of another length, null ones and those with a null or non-finite component are left out; the others become integers.
    The first centroids are the ``k`` vectors of least SHA-256 of ``1:<key>`` (null: nothing after the colon; equal keys: least
    vector); fewer vectors give fewer centroids, none an empty result. Rows that repeat are vectors of their own. Components
    beyond LIMIT are held to it, and an inertia beyond a long to the greatest long. Other columns are ignored, whatever their names.

    Each round is one pass over the stored vectors; nothing is shuffled but a row per centroid and task.
    """
    spark = rows.sparkSession
    with scratch(spark) as keep:
        whole = rows.where(usable(F.col(vector), dims)).select(F.col(key).alias("key"), integers(F.col(vector), scale).alias("v"))
        axes = rotation(whole, dims)
        lead = min(lead, dims)

        def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = matrix(batch.column("v"), dims, np.float64) @ axes
                yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("v"), lists(np.ascontiguousarray(at[:, :lead])), pa.array(np.linalg.norm(at[:, lead:], axis=1))], names=["key", "v", "head", "rest"])

        schema = T.StructType([*whole.schema.fields, T.StructField("head", T.ArrayType(T.DoubleType())), T.StructField("rest", T.DoubleType())])
        vectors = stored(whole.mapInArrow(turned, schema), "turned-vectors")
        seed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256)
        points = [list(r["v"]) for r in vectors.select("v", seed.alias("h")).orderBy("h", "v").limit(k).collect()]
        for _ in range(rounds if points else 0):
            points = moved(vectors, Centroids.of(points, axes, lead), dims, lead)
        assign = assigner(Centroids.of(points, axes, lead), dims, lead) if points else None

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, cluster, distance = assign(batch)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["key", "cluster", "distance"])

        schema = T.StructType([schema["key"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
        found = keep(stored(vectors.select("key", "v", "head", "rest").mapInArrow(placed, schema), "placed-vectors"))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    told = [(c, min(s, MOST), min(sum(sums.values()), MOST), hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()) for c, s in sums.items()]
    about = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(about), "cluster")  # k rows
    return out.select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_pca_filtered_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every usable vector of ``embeddings``, with what the contract asks of clusters and centroids."""
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


_DISTANCE = f"list_sum(list_transform(range(1, {DIMS + 1}), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i])))"


def _round(n: int) -> str:
    """SQL of a round: the nearest centroid of each vector, then the centroids' new places."""
    return f"""
a{n} AS (SELECT id, c, d FROM (SELECT v.id, c.c, {_DISTANCE} AS d FROM v, c{n} c) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1),
u{n} AS (SELECT c, list(m ORDER BY i) AS v FROM (SELECT a.c, i, CAST(floor(sum(v.v[i]) / count(*)) AS BIGINT) AS m FROM a{n} a JOIN v USING (id), range(1, {DIMS + 1}) r(i) GROUP BY a.c, i) GROUP BY c),
c{n + 1} AS (SELECT c.c, coalesce(u.v, c.v) AS v FROM c{n} c LEFT JOIN u{n} u USING (c)),"""


ORACLE_OP11 = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT v, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT {CENTROIDS})),
{''.join(_round(n) for n in range(ROUNDS))}
f AS (SELECT id, c, d FROM (SELECT v.id, c.c, {_DISTANCE} AS d FROM v, c{ROUNDS} c) QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, c) = 1)
SELECT vec_id, CAST(f.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY f.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM f JOIN v USING (id) JOIN c{ROUNDS} k ON k.c = f.c
"""
