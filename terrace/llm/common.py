"""Helpers shared by the corpus operators: stored intermediates, skew-safe joins, prefix sums and connected groups."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key counts as heavy from this fraction of all rows on, so at most 1 / HEAVY keys are heavy; that bounds what is broadcast.
HEAVY = 0.001
WORD = r"[^\x20\x09-\x0D]+"


#: Settings of the operators' jobs. Spark 4.1 takes the union of tables that are bucketed alike for one that is, and then groups each
#: side alone. Shuffle files are deleted when the job that made them has ended, as every result that is read again is stored.
SETTINGS = {"spark.sql.unionOutputPartitioning": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def settled(spark: SparkSession) -> SparkSession:
    """The session with SETTINGS."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return settled(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session's ``spark.checkpoint.dir``.

    Where that is unset a local session gets a folder of its own; a cluster is refused, as its executors share no local folder.
    """
    found = settled(spark).conf.get("spark.checkpoint.dir", None) or getattr(spark, "_terrace_dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = spark._terrace_dir = tempfile.mkdtemp(prefix="spark-terrace-")
    return found.rstrip("/")


#: For each scratch that is open in this thread or task of the driver, the folders that were stored in it.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("terrace-scratch", default=())


def stored(df: DataFrame, name: str, *partition: str, compression: str = "snappy") -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: lineage ends here, and a lost executor costs no recomputation of it."""
    path = noted(f"{shared_dir(df.sparkSession)}/terrace-{name}-{uuid.uuid4().hex}")
    writer = df.write.partitionBy(*partition) if partition else df.write
    writer.parquet(path, compression=compression)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._terrace_path = path
    return found


def noted(path: str) -> str:
    """The path, which the innermost scratch deletes when it closes."""
    if _OPEN.get():
        _OPEN.get()[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes what was stored within, but for what is passed to the function that it gives; an outer scratch takes that over."""
    made, kept = [], set()
    token = _OPEN.set((*_OPEN.get(), made))

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._terrace_path)
        return df

    try:
        yield keep
    finally:
        _OPEN.reset(token)
        for path in made:
            if path in kept:
                noted(path)
            else:
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def row_of(df: DataFrame) -> Column:
    """The whole row as one struct, in which no name can clash with those of an operator; ``select("name.*")`` gives it back."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join rows to one row per group without gathering a hot group in one task.

    Groups of at least ``HEAVY`` of all ``total`` rows number 1 / HEAVY at most and are broadcast; the rows they match get a
    key of their own for the shuffled join of the others, so they spread evenly. A null key matches nothing.
    """
    cols = [c for c in groups.columns if c != key]
    least = max(2, int(total * HEAVY))
    tag = lambda p: [F.col(c).alias(f"{p}{c}") for c in cols]
    heavy = groups.where(F.col(size) >= least).select(F.col(key), F.lit(True).alias("_h"), *tag("_h_"))
    light = groups.where(F.col(size) < least).select(F.col(key).alias("_lk"), *tag("_l_"))
    hit = rows.join(F.broadcast(heavy), key, "left")
    # a key of its own may be a light group's too: what that gives is not looked at
    own = F.monotonically_increasing_id()
    own = F.concat(F.lit("\u0001"), own.cast("string")) if dict(rows.dtypes)[key] == "string" else own
    out = hit.withColumn("_k", F.when(F.col("_h"), own).otherwise(F.col(key))).join(light, F.col("_k") == F.col("_lk"), "left")
    return out.select(*[F.col(c) for c in rows.columns], *[F.when(F.col("_h"), F.col(f"_h_{c}")).otherwise(F.col(f"_l_{c}")).alias(c) for c in cols])


def running_start(df: DataFrame, group: list[str], chunk: str, order: list[Column], size: Column, out: str) -> DataFrame:
    """Add the sum of ``size`` over the rows that precede each row of its group, in (chunk, order).

    Only chunks, not groups, are gathered in a task: chunk totals are summed first, and their running sums joined back.
    """
    sized = df.withColumn("_size", size.cast("long"))
    keys = [*group, chunk]
    totals = sized.groupBy(*keys).agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = sized.withColumn("_own", F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys])
    return own.join(starts, same).select(*df.columns, (F.col("_before") + F.col("_own")).alias(out))


def components(edges: DataFrame, a: str, b: str, name: str = "cc") -> DataFrame:
    """Connected groups of undirected edges as (node, root), root the least node of the group.

    Alternates large-star and small-star steps until nothing changes. Every step is stored, so no links or labels are held by
    the driver, and the least neighbours are stored before they are joined back: both sides of that join are plain shuffles,
    of which adaptive execution splits the partition of a node with very many neighbours.
    """

    with scratch(edges.sparkSession) as keep:
        return keep(_labels(edges, a, b, name))


def _labels(edges: DataFrame, a: str, b: str, name: str) -> DataFrame:
    def step(found: DataFrame) -> tuple[DataFrame, dict]:
        made = stored(found.distinct(), name)
        return made, made.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first().asDict()

    cur, had = step(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    while had["n"]:
        # large star: each node's larger neighbours point to the least of its neighbourhood
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        down = stored(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), name)
        # small star: a node and its smaller neighbours point to the least of them
        low = stored(down.groupBy("u").agg(F.min("v").alias("m")), name)
        small = down.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur, now = step(small.union(low.select("u", F.col("m").alias("v"))))
        if now == had:
            break
        had = now
    roots = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stored(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()), name)
