"""Placement by a hierarchical weighted hash tree: region, then rack, then shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import row_of, running_start, table

#: One leaf: (region, rack, shard, weight).
Leaf = tuple[str, str, int, float]
BASE = 8
CHUNKS = 256


def topology(shards: int, base: int = BASE) -> list[Leaf]:
    """Leaves of equal weight for ``shards`` shards.

    The first ``base`` shards fill regions of two racks of two. Each further shard opens a region of its own, so no other
    subtree changes weight and rows move into the new shard only.
    """
    return [(f"r{s // 4}", f"r{s // 4}k{s // 2 % 2}", s, 1.0) if s < base else (f"g{s}", f"g{s}k0", s, 1.0) for s in range(shards)]


def _levels(leaves: list[Leaf]) -> list[dict[str, list[tuple[str, float]]]]:
    """For each level the children of each parent with the sum of the weights below them."""
    out: list[dict[str, dict[str, float]]] = [{}, {}, {}]
    for region, rack, shard, weight in leaves:
        if weight < 0:
            raise ValueError("weights must not be negative")
        for level, (parent, child) in enumerate((("", region), (region, rack), (rack, str(shard)))):
            below = out[level].setdefault(parent, {})
            below[child] = below.get(child, 0.0) + weight
    return [{p: sorted(c.items()) for p, c in level.items()} for level in out]


def _draw(key: Column, child: Column, weight: Column) -> Column:
    """An exponential draw of rate ``weight`` fixed by key and child: the least draw wins with probability in proportion to weight."""
    bits = F.shiftrightunsigned(F.xxhash64(key, child), 11).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / weight


def place(df: DataFrame, key: str, leaves: list[Leaf], out: str = "shard") -> DataFrame:
    """Add each row's shard by descending the tree.

    At each level the child of the least weighted draw is taken. A draw depends on the key and the child alone, so a changed
    weight moves rows only between that child and its siblings, and everything below an unchanged subtree stays. Children of
    weight 0 get nothing. A null key is a key like any other. Repeated keys go to the same shard.
    """
    if not any(w > 0 for *_, w in leaves):
        raise ValueError("the tree needs a positive weight")
    found = df.select(row_of(df).alias("row"), F.col(key).alias("key"), F.lit("").alias("at"))
    for level in _levels(leaves):
        kids = {p: [(c, w) for c, w in cs if w > 0] for p, cs in level.items()}
        entries = [x for p, cs in kids.items() if cs for x in (F.lit(p), F.array(*[F.struct(F.lit(c).alias("c"), F.lit(w).alias("w")) for c, w in cs]))]
        drawn = F.transform(F.create_map(*entries)[F.col("at")], lambda x: F.struct(_draw(F.col("key"), x["c"], x["w"]).alias("d"), x["c"].alias("c")))
        found = found.select("row", "key", F.array_min(drawn)["c"].alias("at"))
    return found.select("row.*", F.col("at").cast("int").alias(out))


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, gapless slot in the shard, and the shard with one shard more, for every row.

    Null texts have size 1 and the CRC of nothing. Slots follow (hash chunk, key, size, CRC): equal rows get different slots.
    Extra columns are ignored; an empty table gives an empty result.
    """
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(F.col(key), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"))
    placed = place(place(rows, key, topology(shards)), key, topology(shards + 1), "grown_shard")
    chunked = placed.withColumn("_chunk", F.pmod(F.xxhash64(F.col(key), F.lit("slot")), F.lit(CHUNKS)).cast("int"))
    order = [F.col(key), F.col("size"), F.col("text_crc32")]
    return running_start(chunked, ["shard"], "_chunk", order, F.lit(1), "slot").drop("_chunk")


def op1_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document among eight shards, and its shard among nine; null texts have size 1."""
    return shard_documents(table(spark, sf_dir, "documents"), BASE)
