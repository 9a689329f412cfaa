"""Mixing sources to target weights as a min-cost flow from membership patterns to source quotas."""

from __future__ import annotations

import heapq
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.llm.common import WORD, row_of, stored, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
BINS = 4096
#: Patterns of sources, and sources, that a mix may have: what the driver collects and broadcasts.
PATTERNS = 20_000
SEED = 17


def word_count(text: Column) -> Column:
    """Number of runs of anything but blanks, 0 for null."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(squeezed, " \t\n\x0b\x0c\r", "")).cast("long")


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Share ``total`` by weight; a share stops at ``most`` times its size and the excess is shared again until none is above."""
    got, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                got[i] = left * weights[i] / weight
            break
        for i in over:
            got[i] = float(most * sizes[i])
        left -= sum(got[i] for i in over)
        open_ = [i for i in open_ if i not in over]
    return got


def route(capacity: dict[tuple[str, ...], int], quota: dict[str, float], repeats: int) -> dict[tuple[tuple[str, ...], str], float]:
    """Tokens that each membership pattern gives each of its sources, at least total repetition cost.

    A pattern offers its size once per repetition, the r-th at cost r**2 a token, which is convex: a second reading is used
    only where no first reading is left. Successive shortest paths over residual arcs; the graph has a node for each pattern
    and source, never for documents.
    """
    nodes = ["<from>", "<to>", *[("p", p) for p in capacity], *[("s", s) for s in quota]]
    at = {n: i for i, n in enumerate(nodes)}
    graph: list[list[list]] = [[] for _ in nodes]

    def arc(u: int, v: int, cap: float, cost: float) -> None:
        graph[u].append([v, cap, cost, len(graph[v])])
        graph[v].append([u, 0.0, -cost, len(graph[u]) - 1])

    for p, size in capacity.items():
        for r in range(repeats):
            arc(0, at["p", p], float(size), float(r * r))
        for s in p:
            if s in quota:
                arc(at["p", p], at["s", s], float("inf"), 0.0)
    for s, q in quota.items():
        arc(at["s", s], 1, q, 0.0)
    rise = [0.0] * len(nodes)
    while True:
        dist, via, heap = [float("inf")] * len(nodes), [None] * len(nodes), [(0.0, 0)]
        dist[0] = 0.0
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for k, (v, cap, cost, _) in enumerate(graph[u]):
                if cap > 1e-9 and (n := d + cost + rise[u] - rise[v]) < dist[v] - 1e-12:
                    dist[v], via[v] = n, (u, k)
                    heapq.heappush(heap, (n, v))
        if via[1] is None:
            break
        rise = [r + d if d < float("inf") else r for r, d in zip(rise, dist)]
        path, v = [], 1
        while v:
            path.append(via[v])
            v = via[v][0]
        push = min(graph[u][k][1] for u, k in path)
        for u, k in path:
            graph[u][k][1] -= push
            graph[graph[u][k][0]][graph[u][k][3]][1] += push
    return {(p, nodes[a[0]][1]): graph[a[0]][a[3]][1] for p in capacity for a in graph[at["p", p]] if a[0] > 1 and graph[a[0]][a[3]][1] > 0}


def name_of(source: Column) -> Column:
    """Sources as text that sorts by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def mix(
    docs: DataFrame, members: str, size: str, quota: dict[str, float], repeats: int = REPEATS, seed: int = SEED, key: str = "doc_id", row: str = "row", most: int = PATTERNS
) -> DataFrame:
    """Add ``taken``: how much of each document the mix takes, a whole multiple of its size from 0 to ``repeats``.

    ``members`` is the array of names of the sources that a document belongs to. Documents are summed by pattern of sources,
    :func:`route` decides how much each pattern gives, and within a pattern documents are taken in an order of seeded hashes:
    all of them for each full pass, then those that fill what is left, the last one where that brings the sum nearer. Rows of
    the same key and size share a hash and are ordered by ``row``, a number of each. Names without a quota take nothing. Rows
    of size 0 are taken 0 times. Patterns are the nodes of the flow, which is solved at once, so more than ``most`` of them
    are refused with an error.
    """
    named = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(members), F.array().cast("array<string>")), lambda x: x.isNotNull())))
    body = docs.select(row_of(docs).alias("doc"), F.to_json(named).alias("pattern"), F.col(key).alias("key"), F.col(size).alias("size"), F.col(row).alias("row"))
    keyed = body.withColumn("hash", F.xxhash64(F.lit(seed), "key", "size")).withColumn("bin", F.pmod("hash", F.lit(BINS)).cast("int"))
    bins = keyed.groupBy("pattern", "bin").agg(F.sum("size").alias("in_bin"))
    patterns = bins.groupBy("pattern").agg(F.sum("in_bin").alias("n")).where("n > 0").limit(most + 1).collect()
    if len(patterns) > most:
        raise ValueError(f"more than {most} patterns of sources")
    of = {tuple(json.loads(r["pattern"])): r["pattern"] for r in patterns}
    capacity = {tuple(json.loads(r["pattern"])): r["n"] for r in patterns}
    flow: dict[tuple[str, ...], float] = {}
    for (p, _), x in route(capacity, quota, repeats).items():
        flow[p] = flow.get(p, 0.0) + x
    full = {p: int(min(repeats, x // capacity[p])) for p, x in flow.items()}
    plan = [(of[p], full[p], x - full[p] * capacity[p]) for p, x in flow.items()]
    plan_df = F.broadcast(docs.sparkSession.createDataFrame(plan, "of_pattern string, full int, rest double"))  # at most ``most`` rows
    before = Window.partitionBy("pattern").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bins.withColumn("start", F.coalesce(F.sum("in_bin").over(before), F.lit(0))).join(plan_df, F.col("pattern") == F.col("of_pattern"))
    starts = starts.select("of_pattern", F.col("bin").alias("of_bin"), "start", "full", "rest")
    own = Window.partitionBy("pattern", "bin").orderBy("hash", "key", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    placed = placed.join(starts, (F.col("pattern") == F.col("of_pattern")) & (F.col("bin") == F.col("of_bin")), "left")
    extra = (F.col("start") + F.col("own") + F.col("size") / 2 <= F.col("rest")) & (F.col("full") < repeats)
    times = F.coalesce(F.col("full"), F.lit(0)) + F.coalesce(extra.cast("int"), F.lit(0))
    return placed.select("doc.*", (times * F.col("size")).cast("long").alias("taken"))


def mix_by_source(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", row: Column | None = None) -> DataFrame:
    """Mix documents of one source each; sources in order of code point, null last, weigh 3, 1, 2, repeating.

    Together they get 150 % of all sizes, each at most twice its own. Returns key, size, the source's size and target,
    ``taken``, and ``row``, a number of each row (default: Spark's order). Null texts have size 0, an empty table gives no
    rows. Repeated keys are mixed row by row. Other columns are ignored.
    """
    number = F.monotonically_increasing_id() if row is None else row
    rows = docs.select(F.col(key).alias("key"), number.alias("row"), word_count(F.col(text)).alias("size"), name_of(F.col(source)).alias("from_source"))
    rows = stored(rows, "mix")
    totals = rows.groupBy("from_source").agg(F.sum("size").alias("n")).limit(PATTERNS + 1).collect()
    if len(totals) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} sources")
    totals = sorted((r["from_source"], r["n"]) for r in totals)
    sizes = [n for _, n in totals]
    targets = water_fill(sizes, [WEIGHTS[i % 3] for i in range(len(sizes))], SHARE * sum(sizes), REPEATS)
    quota = {s: t for (s, _), t in zip(totals, targets)}
    known = docs.sparkSession.createDataFrame([(s, n, quota[s]) for s, n in totals], "name string, source_size long, target double")
    out = mix(rows.withColumn("members", F.array("from_source")), "members", "size", quota, key="key")
    return out.join(F.broadcast(known), F.col("from_source") == F.col("name")).select(F.col("key").alias(key), "size", "source_size", "target", "taken", "row")  # a row for each source


def repeat_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents, each row as often as the mix takes it, in the columns they came with; those of size 0 are left out."""
    rows = stored(docs.select(row_of(docs).alias("doc"), F.monotonically_increasing_id().alias("row")), "mix-rows")
    sized = rows.select("row", *[F.col(f"doc.`{c}`").alias(n) for c, n in ((key, "key"), (text, "text"), (source, "source"))])
    taken = mix_by_source(sized, "key", "text", "source", row=F.col("row")).where("taken > 0").select("row", F.expr("taken div size").alias("times"))
    return rows.join(taken, "row").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("i")).select("doc.*")


def op10_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, source, target and what the mix takes of every document."""
    return mix_by_source(table(spark, sf_dir, "documents")).drop("row")
