"""Mixture-controlled packing: deficit round-robin over source queues, then a cut into sequences."""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.llm.common import running_start, stored, table

SEQUENCE = 2048
#: Tokens in a window, which is filled to the target proportions: 32 sequences.
WINDOW = 32 * SEQUENCE
END_ID = 1
CHUNKS = 256
ROUNDS = 256
#: Sources whose quanta are planned at once, by the driver.
SOURCES = 2000
CACHE = 400_000


class Pieces(dict):
    """Ids, as bytes, of a space and the characters up to the next space; filled as they come, emptied when too many.

    Tokens that the tokenizer file beside the vocabulary adds to it are cut out of texts first.
    """

    def __init__(self, vocabulary: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        if max(ranks.values()) >= 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.added = added_tokens(vocabulary)
        self.cut = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) or "(?!)")

    def __missing__(self, piece: str) -> bytes:
        found = self[piece] = array("H", self.encoding.encode_ordinary(f" {piece}")).tobytes()
        return found

    def encode(self, text: str) -> bytes:
        """Ids of 16 bits each."""
        out, start = [], 0
        for found in self.cut.finditer(text):
            out += [self.plain(text[start : found.start()]), array("H", [self.added[found[0]]]).tobytes()]
            start = found.end()
        return b"".join([*out, self.plain(text[start:])]) if out else self.plain(text)

    def plain(self, text: str, odd=re.compile(r"\s\s|[^\S \t\n\r]").search) -> bytes:
        """Ids of a text without added tokens. Where every blank stands alone, no token crosses a space but as its first character."""
        if odd(text):
            return array("H", self.encoding.encode_ordinary(text)).tobytes()
        if len(self) > CACHE:
            self.clear()
        first, *rest = text.split(" ")
        return array("H", self.encoding.encode_ordinary(first)).tobytes() + b"".join(map(self.__getitem__, rest))


def added_tokens(vocabulary: str) -> dict[str, int]:
    """Ids of the tokens that the tokenizer file of the same name adds; none without such a file."""
    path = f"{os.path.splitext(vocabulary)[0]}.json"
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def default_vocabulary() -> str:
    """The ranks of the vocabulary of byte_bpe_50k.json, in the form that the fast encoder reads."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def tokenize(docs: DataFrame, key: str, text: str, source: str, vocabulary: str | None = None) -> DataFrame:
    """(row, key, source, number of ids, compressed ids) of whole texts, each ended by id 1; null texts are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces, end = Pieces(vocabulary or default_vocabulary()), array("H", [END_ID]).tobytes()
        for batch in batches:
            ids = [pieces.encode(t or "") + end for t in batch.pop("text")]
            batch["n"] = [len(x) // 2 for x in ids]
            batch["ids"] = [zlib.compress(x, 1) for x in ids]
            yield batch

    # small batches, so that a batch of long texts stays small
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"))
    kinds = dict(docs.dtypes)
    return rows.mapInPandas(run, f"row long, key {kinds[key]}, source {kinds[source]}, n long, ids binary")


class Phase(NamedTuple):
    """From round ``first`` on, after ``credit`` tokens of credit, a queue gets ``quantum`` more in each round."""

    credit: int
    first: int
    quantum: int


def phases(totals: dict[str | None, int], weights: dict[str | None, float], window: int = WINDOW) -> dict[str | None, list[Phase]]:
    """The quanta of deficit round-robin over queues of these totals of tokens.

    A window is dealt to the queues that aren't empty, by weight, so it is filled to the targets of what is left. A queue is
    empty after the round in which its credit covers its total. Then a new phase begins for the others. There are as many
    phases as queues that empty at different times.
    """
    open_, credit, turn = {s for s, n in totals.items() if n > 0}, dict.fromkeys(totals, 0), 0
    out: dict[str | None, list[Phase]] = {s: [] for s in totals}
    while open_:
        whole = sum(weights[s] for s in open_)
        quantum = {s: max(1, int(window * weights[s] / whole)) for s in open_}
        last = min(-(-(totals[s] - credit[s]) // quantum[s]) for s in open_)
        for s in open_:
            out[s].append(Phase(credit[s], turn, quantum[s]))
            credit[s] += last * quantum[s]
        turn += last
        open_ = {s for s in open_ if credit[s] < totals[s]}
    return out


def repeating(sources: Iterable[str | None], weights: Sequence[float] = (3, 1, 2)) -> dict[str | None, float]:
    """Weights of sources by code point, null last."""
    return {s: float(weights[i % len(weights)]) for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}


def schedule(meta: DataFrame, weights: dict[str | None, float] | Sequence[float] | None = None, sequence: int = SEQUENCE, window: int = WINDOW) -> DataFrame:
    """Pieces (row, start, length, sequence_id, offset) of documents (row, key, source, n > 0).

    Each source has a queue of its documents by hash chunk and key. In a round, a window, a queue gets its quantum of credit and
    sends whole documents while its credit covers them; what is left over, its deficit, is carried to the next round. So the
    round of a document is the first in which the credit reaches its end in the queue, and deficits carry over windows and
    partitions without state. Credit is in proportion to ``weights``: by source, repeating by order of sources, or (default)
    the sources' tokens, with which all queues empty in the same round. A source without weight gets the least one. What rounds
    send is laid end to end, by round and source, and cut at multiples of ``sequence``. More than SOURCES sources are refused.
    """
    chunked = meta.withColumn("_chunk", F.pmod(F.xxhash64("key", F.lit("queue")), F.lit(CHUNKS)).cast("int"))
    queued = running_start(chunked, ["source"], "_chunk", [F.col("key"), F.col("n"), F.col("row")], F.col("n"), "q0")
    found = meta.groupBy("source").agg(F.sum("n").alias("sent")).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    totals = {r["source"]: r["sent"] for r in found}
    if weights is None:
        shares = {s: float(n) for s, n in totals.items()}
    elif isinstance(weights, dict):
        least = min([w for w in weights.values() if w > 0], default=1.0)
        shares = {s: float(weights.get(s, 0) or least) for s in totals}
    else:
        shares = repeating(totals, weights)
    plan = [(s, [tuple(p) for p in ps]) for s, ps in phases(totals, shares, window).items()]
    kind = dict(meta.dtypes)["source"]
    plan_df = meta.sparkSession.createDataFrame(plan, f"_source {kind}, phases array<struct<credit:long,first:long,quantum:long>>")
    due = queued.join(F.broadcast(plan_df), F.col("source").eqNullSafe(F.col("_source")))  # a row for each source
    due = due.withColumn("end", F.col("q0") + F.col("n")).withColumn("phase", F.element_at(F.filter("phases", lambda p: p["credit"] < F.col("end")), -1))
    turns = due.select("row", "source", "q0", F.col("n").alias("length"), F.expr("phase.first + (end - phase.credit + phase.quantum - 1) div phase.quantum").alias("round"))
    turns = stored(turns.withColumn("_group", F.expr(f"round div {ROUNDS}")), "turns")
    inside = running_start(turns, ["_group"], "round", [F.col("source"), F.col("q0")], F.col("length"), "at")
    groups = turns.groupBy("_group").agg(F.sum("length").alias("_sum"))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)  # a row for 256 windows of 65,536 tokens
    groups = groups.select(F.col("_group").alias("_g"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    laid = inside.join(groups, F.col("_group") == F.col("_g")).select("row", "length", (F.col("_base") + F.col("at")).alias("at"))
    cut = laid.select("*", F.explode(F.expr(f"sequence(at div {sequence}, (at + length - 1) div {sequence})")).alias("sequence_id"))
    low, high = F.greatest(F.col("at"), F.col("sequence_id") * sequence), F.least(F.col("at") + F.col("length"), (F.col("sequence_id") + 1) * sequence)
    return cut.select("row", (low - F.col("at")).alias("start"), (high - low).alias("length"), "sequence_id", (low - F.col("sequence_id") * sequence).alias("offset"))


def pack(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: dict[str | None, float] | Sequence[float] | None = None,
    vocabulary: str | None = None, with_ids: bool = True,
) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens, each window of about 32 sequences in the target proportions of its sources.

    Returns a row per piece: key, source, start, length, ids (array, unless ``with_ids`` is false), the CRC of the ids as
    little-endian 32-bit integers, the document's tokens, sequence and offset there. Every id is in one piece; sequences are
    full but the last. Null and empty texts are the end id alone; null keys and sources are values like others, repeated rows
    are packed each, and no rows give no pieces.
    """
    tokens = stored(tokenize(docs, key, text, source, vocabulary), "tokens")
    cuts = schedule(tokens.select("row", "key", "source", "n"), weights)
    mine = cuts.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))  # of one document
    kinds = dict(docs.dtypes)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, s, n, blob, cuts in batch.itertuples(index=False, name=None):
                ids = array("H", zlib.decompress(blob))
                for c in cuts:
                    piece = ids[c["start"] : c["start"] + c["length"]]
                    out.append((k, s, c["start"], c["length"], zlib.crc32(array("I", piece).tobytes()), n, c["sequence_id"], c["offset"], *([list(piece)] if with_ids else [])))
            frame = pd.DataFrame(out, columns=names)
            frame[key] = frame[key].astype("object")
            yield frame

    names = [key, source, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    schema = f"`{key}` {kinds[key]}, `{source}` {kinds[source]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return tokens.join(mine, "row").select("key", "source", "n", "ids", "cuts").mapInPandas(digest, schema)


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents; sources in order of code point weigh 3, 1, 2, repeating."""
    return pack(table(spark, sf_dir, "documents"), weights=(3, 1, 2), with_ids=False)
