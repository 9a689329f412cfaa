"""Vectors kept in cells of a k-means, so that a search reads the cells near its queries; exact where that is asked for."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.vectors import doubles
from terrace.operators.retrieval import answers, best_of, blocks_of, top, values_of

#: Cells are fitted on at most about so many vectors, chosen by hash; all vectors are dealt to them.
SAMPLE = 100_000
#: Cells that a search reads for each query, unless it asks for others. Where vectors have no clusters most cells hold some of the nearest.
PROBES = 12


class VectorCells:
    """Vectors (chunk_id, embedding) of one length in a folder, a partition for each cell, with the cells' centres and radii.

    Null vectors and those of another length than most are left out.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, vectors: DataFrame, cells: int = 64, sample: int = SAMPLE, seed: int = 7, rounds: int = 10) -> VectorCells:
        """Fit the cells and write all vectors; fewer distinct vectors than cells give fewer cells."""
        rows = vectors.select("chunk_id", doubles("embedding").alias("v")).where("v is not null")
        sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        if sizes is None:
            raise ValueError("no vectors to index")
        rows = rows.where(F.size("v") == sizes["n"])
        part = F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / sizes["count"]))
        model = KMeans(k=cells, seed=seed, maxIter=rounds, featuresCol="f").fit(rows.where(part).select(array_to_vector("v").alias("f")))
        centres = np.array(model.clusterCenters())

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                v = np.stack(batch["v"].to_numpy())
                far = (v**2).sum(axis=1)[:, None] - 2 * v @ centres.T + (centres**2).sum(axis=1)[None, :]
                cell = far.argmin(axis=1)
                yield batch.assign(chunk_id=batch["chunk_id"].astype(object) if batch["chunk_id"].dtype.kind not in "iuf" else batch["chunk_id"], away=np.linalg.norm(v - centres[cell], axis=1), cell=cell.astype(np.int32))

        placed = rows.mapInPandas(place, f"chunk_id {dict(rows.dtypes)['chunk_id']}, v array<double>, away double, cell int")
        # large cells are split, small ones share a task
        placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{self.path}/vectors")
        about = self.vectors().groupBy("cell").agg(F.max("away").alias("radius"), F.count("*").alias("n"))
        known = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        known.join(about, "cell").write.parquet(f"{self.path}/cells")  # a row for each cell
        return self

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def _scan(self, ids: np.ndarray, q: np.ndarray, wanted: np.ndarray, k: int, schema: str) -> DataFrame:
        """The ``k`` nearest of each query among the cells that it wants (queries x cells); other cells aren't read."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for batch in batches:
                for cell, here in batch.groupby("cell"):
                    who = np.flatnonzero(wanted[:, cell])
                    found, chunk = values_of(q[who], np.stack(here["v"].to_numpy()), "l2"), here["chunk_id"].to_numpy()
                    at = best_of(found, chunk, k, "l2")
                    part = answers(np.repeat(ids[who], at.shape[1]), chunk[at].ravel(), "distance", np.take_along_axis(found, at, 1).ravel())
                    best = part if best is None else pd.concat([best, part])
                best = best.sort_values(["query_id", "distance", "chunk_id"]).groupby("query_id", sort=False).head(k)
            if best is not None:
                yield best

        cells = np.flatnonzero(wanted.any(axis=0)).tolist()
        return self.vectors().where(F.col("cell").isin(cells)).select("chunk_id", "v", "cell").mapInPandas(run, schema)

    def search(self, queries: DataFrame, k: int, probes: int = PROBES, exact: bool = False) -> DataFrame:
        """Per query (query_id, query_vector) the ``k`` nearest vectors by squared distance among its ``probes`` nearest cells.

        With ``exact``, cells that may still hold something nearer than the ``k``-th found, by their centre's distance less their
        radius, are read too, so the answer is that of :func:`retrieval.dense`. Queries of another length find nothing.
        """
        cells = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").toPandas()  # a row for each cell
        number, radius = cells["cell"].to_numpy(), cells["radius"].to_numpy()
        centres = np.stack(cells["centre"].to_numpy())
        schema = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id {dict(self.vectors().dtypes)['chunk_id']}, distance double"
        parts: list[DataFrame] = []
        for block in blocks_of(queries.select("query_id", doubles("query_vector").alias("q"))):
            q = np.stack(block["q"].to_numpy())
            if q.shape[1] != centres.shape[1]:
                continue
            far = np.sqrt(np.maximum(((q[:, None, :] - centres[None]) ** 2).sum(axis=2), 0))
            order = np.argsort(far, axis=1, kind="stable")[:, :probes]
            wanted = np.zeros((len(q), int(number.max()) + 1), bool)
            np.put_along_axis(wanted, number[order], True, axis=1)
            ids = block["query_id"].to_numpy()
            first = top(self._scan(ids, q, wanted, k, schema), ["query_id"], [F.asc("distance"), F.asc("chunk_id")], k).drop("rank")
            parts.append(first)
            if exact:
                parts.append(self._scan(ids, q, self._open(first, ids, far, radius, number, wanted, k), k, schema))
        out = reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], schema)
        return top(out, ["query_id"], [F.asc("distance"), F.asc("chunk_id")], k)

    @staticmethod
    def _open(first: DataFrame, ids: np.ndarray, far: np.ndarray, radius: np.ndarray, number: np.ndarray, seen: np.ndarray, k: int) -> np.ndarray:
        """The unread cells that may hold one of the ``k`` nearest of each query."""
        worst = first.groupBy("query_id").agg(F.max("distance").alias("d"), F.count("*").alias("n")).toPandas().set_index("query_id")  # of one block
        bound = np.array([worst["d"].get(i, np.inf) if worst["n"].get(i, 0) >= k else np.inf for i in ids])
        near = np.maximum(far - radius[None, :], 0) - 1e-6
        open_ = np.zeros_like(seen)
        open_[:, number] = (near < 0) | (near**2 <= bound[:, None] + 1e-6)
        return open_ & ~seen


