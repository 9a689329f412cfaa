"""A kept full-text index with positions: phrases, words and their BM25, updated in batches.

The index is a folder. Each batch adds a segment, and one small file, written last, names the segments that count; a batch that fails
leaves nothing that is read. A segment has the positions of each token in each chunk, in folders by a hash of the token and sorted
by it; the chunks themselves; what became of chunks of earlier segments; and by how much each token's number of chunks changed.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.functions.text import col, hits, text_or_empty
from terrace.operators.retrieval import B, K1, MOST_KEYS, among, top
from terrace.steps import listed, publish, written

#: Of the phrase ranking; words use the other constants.
PHRASE_K1, PHRASE_B, LEAST_IDF = 1.2, 0.75, 1e-6
BUCKETS = 64
#: About so many tokens are turned into postings at once.
MOST_TOKENS = 1_000_000
#: About so many candidates of phrases are joined with postings in one pass.
MOST_STARTS = 20_000_000
PIECES = ("postings", "chunks", "gone", "terms")


def _marked_letters() -> tuple[str, str]:
    """Lower-case letters with one diacritic, and the letters without it."""
    found = [(c, d[0]) for c in map(chr, range(0xC0, 0x1F00)) if len(d := unicodedata.normalize("NFD", c)) == 2 and d[0].isascii() and d[0].islower() and unicodedata.combining(d[1])]
    return "".join(c for c, _ in found), "".join(d for _, d in found)


MARKED, PLAIN = _marked_letters()
DIACRITICS = "".join(map(chr, range(0x300, 0x370)))


def tokens(c: Column | str) -> Column:
    """Runs of letters and digits in lower case without diacritics, in order."""
    low = F.lower(text_or_empty(c))
    bare = F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, MARKED + DIACRITICS, PLAIN)).otherwise(low)
    return F.filter(F.split(bare, r"[^\p{L}\p{N}\p{Co}]+"), lambda w: w != "")


def _small(df: DataFrame) -> DataFrame:
    """For a join of much larger rows: sent to every task if it has up to MOST_KEYS rows; it is read twice."""
    return F.broadcast(df) if df.count() <= MOST_KEYS else df


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, chunk_id, split, size, positions) of chunks (chunk_id, split, size, tokens): all postings of a chunk are made where it is read."""
    for batch in batches:
        ends = np.cumsum(batch.column(3).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(ends):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + MOST_TOKENS, "right")))
            chunk, split, size, lists = batch.slice(start, stop - start).columns
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            named = lists.flatten().dictionary_encode()
            code, row = named.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            key = code * len(sizes) + row
            order = np.argsort(key, kind="stable")  # places stay in order
            first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else np.empty(0, int)
            at = pa.array(row[order][first])
            positions = pa.ListArray.from_arrays(pa.array(np.r_[first, len(key)], pa.int32()), pa.array(place[order], pa.int32()))
            token = named.dictionary.take(pa.array(code[order][first]))
            yield pa.RecordBatch.from_arrays([token, chunk.take(at), split.take(at), size.take(at), positions], ["token", "chunk_id", "split", "size", "positions"])
            start = stop


class LexicalIndex:
    """An index of chunks (chunk_id, child_text, parent_text, document_id) in a folder of ``spark.checkpoint.dir`` or any shared one.

    A chunk counts as its child's tokens followed by its parent's: ``split`` of ``size`` tokens are the child's. ``n`` and ``total``
    are the numbers of live chunks and of their tokens.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        spark.conf.set("spark.sql.unionOutputPartitioning", "false")
        names = sorted(x for x in listed(spark, self.path) if x.startswith("state-"))
        state = json.loads(spark.read.text(f"{self.path}/{names[-1]}", wholetext=True).first()[0]) if names else {"version": 0, "segments": [], "n": 0, "total": 0, "buckets": buckets}
        self.version, self.segments, self.n, self.total, self.buckets = (state[k] for k in ("version", "segments", "n", "total", "buckets"))

    # what is stored

    def bucket(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def _piece(self, name: str) -> DataFrame | None:
        found = [self.spark.read.parquet(f"{self.path}/{x['folder']}/{name}").drop("words").withColumn("segment", F.lit(x["number"])) for x in self.segments if name in x["pieces"]]
        return reduce(DataFrame.unionByName, found) if found else None

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows of segments whose chunks no later segment replaced or deleted."""
        gone = self._piece("gone")
        if gone is None:
            return rows
        g = _small(gone.select(F.col("chunk_id").alias("_c"), F.col("segment").alias("_s")))
        return rows.join(g, (F.col("chunk_id") == F.col("_c")) & (F.col("_s") > F.col("segment")), "left_anti")

    def chunks(self, wanted: DataFrame | None = None) -> DataFrame | None:
        """The live chunks: chunk_id, document_id, child_text, parent_text, split, size; with ``wanted`` (chunk_id) these alone."""
        found = self._piece("chunks")
        return None if found is None else self._live(found if wanted is None else among(found, wanted, "chunk_id"))

    def postings(self, asked: DataFrame) -> DataFrame | None:
        """(token, chunk_id, split, size, positions) of live chunks for the tokens of ``asked`` (token); other buckets aren't read."""
        found = self._piece("postings")
        if found is None:
            return None
        wanted = asked.select("token").distinct()
        near = [r[0] for r in wanted.select(self.bucket(F.col("token"))).distinct().collect()]  # as many as there are buckets at most
        return self._live(among(found.where(F.col("bucket").isin(near)), wanted, "token")).drop("bucket", "segment")

    def frequencies(self, asked: DataFrame) -> DataFrame | None:
        """(token, df): in how many live chunks each asked token is; tokens in none have no row."""
        found = self._piece("terms")
        if found is None:
            return None
        wanted = asked.select("token").distinct()
        near = [r[0] for r in wanted.select(self.bucket(F.col("token"))).distinct().collect()]
        return among(found.where(F.col("bucket").isin(near)), wanted, "token").groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")

    # changes

    def _write(self, folder: str, piece: str, rows: DataFrame, by_bucket: bool = True, gather: bool = True) -> None:
        if by_bucket:
            rows = rows.withColumn("bucket", self.bucket(F.col("token")))
            if gather:  # large buckets are split, small ones share a task; otherwise each task has files of its own
                rows = rows.hint("rebalance", "bucket")
            rows = rows.sortWithinPartitions("bucket", "token", *[c for c in ("chunk_id",) if c in rows.columns])
            rows.write.partitionBy("bucket").parquet(f"{self.path}/{folder}/{piece}", compression="zstd")
        else:
            rows.write.parquet(f"{self.path}/{folder}/{piece}", compression="zstd")

    def _publish(self, segments: list[dict], n: int, total: int) -> None:
        state = {"version": self.version + 1, "segments": segments, "n": n, "total": total, "buckets": self.buckets}
        publish(self.spark, f"{self.path}/state-{state['version']:010d}", json.dumps(state))
        self.version, self.segments, self.n, self.total = state["version"], segments, n, total

    @staticmethod
    def _described(chunks: DataFrame) -> DataFrame:
        """One row per chunk with its tokens; of rows that repeat an id the one with the greatest texts counts."""
        kept = [F.col("document_id") if "document_id" in chunks.columns else F.lit(None).cast("string").alias("document_id")]
        rows = chunks.where("chunk_id is not null").select("chunk_id", text_or_empty("child_text").alias("child_text"), text_or_empty("parent_text").alias("parent_text"), *kept)
        best = lambda df: df.groupBy("chunk_id").agg(F.max(F.struct("child_text", "parent_text", "document_id")).alias("x")).select("chunk_id", "x.*")
        twice = chunks.where("chunk_id is not null").groupBy("chunk_id").count().where("count > 1").select("chunk_id")
        repeated = twice.count()
        if repeated > MOST_KEYS:
            rows = best(rows)
        elif repeated:  # only texts of ids that repeat are shuffled
            rows = rows.join(F.broadcast(twice), "chunk_id", "left_anti").unionByName(best(rows.join(F.broadcast(twice), "chunk_id", "left_semi")))
        rows = rows.withColumns({"_own": tokens("child_text"), "_above": tokens("parent_text")})
        return rows.select("chunk_id", "document_id", "child_text", "parent_text", F.size("_own").alias("split"), (F.size("_own") + F.size("_above")).alias("size"), F.concat("_own", "_above").alias("_all"))

    def _segment(self, folder: str, rows: DataFrame | None, gone: DataFrame | None) -> list[str]:
        """Write the pieces of a segment: chunks with ``_all``, their tokens in order, and chunks that are live no longer."""
        pieces, changes = [], []
        if rows is not None:
            self._write(folder, "chunks", rows.drop("_all"), by_bucket=False)
            made = rows.select("chunk_id", "split", "size", "_all").mapInArrow(_inverted, f"token string, chunk_id {dict(rows.dtypes)['chunk_id']}, split int, size int, positions array<int>")
            self._write(folder, "postings", made, gather=False)
            pieces += ["chunks", "postings"]
            changes.append(self.spark.read.parquet(f"{self.path}/{folder}/postings").select("token", F.lit(1).alias("d")))
        if gone is not None:
            self._write(folder, "gone", gone.select("chunk_id"), by_bucket=False)
            pieces.append("gone")
            left = self.chunks(self.spark.read.parquet(f"{self.path}/{folder}/gone"))
            if left is not None:
                changes.append(left.select(F.explode(F.array_distinct(F.concat(tokens("child_text"), tokens("parent_text")))).alias("token"), F.lit(-1).alias("d")))
        if changes:
            self._write(folder, "terms", reduce(DataFrame.union, changes).groupBy("token").agg(F.sum("d").alias("df")).where("df != 0"))
            pieces.append("terms")
        return pieces

    def update(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> None:
        """Add a segment: chunks to insert or replace, and ids to delete: ``deletes`` has chunk_id or document_id.

        What is both replaced and deleted is replaced. Null ids are left out. Only what changes is written.
        """
        known, folder = self.chunks(), f"segment-{self.version + 1:010d}-{uuid.uuid4().hex}"
        rows = None if upserts is None else self._described(upserts)
        gone = []
        if known is not None and rows is not None:
            gone.append(known.join(upserts.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id"))
        if known is not None and deletes is not None:
            by = "chunk_id" if "chunk_id" in deletes.columns else "document_id"
            gone.append(known.join(deletes.select(by).distinct(), by, "left_semi").select("chunk_id"))
        pieces = self._segment(folder, rows, reduce(DataFrame.union, gone).distinct() if gone else None)
        n, total = self.n, self.total
        if "chunks" in pieces:
            n, total = (a + b for a, b in zip((n, total), self._sizes(self.spark.read.parquet(f"{self.path}/{folder}/chunks"))))
        if "gone" in pieces:
            n, total = (a - b for a, b in zip((n, total), self._sizes(known.join(self.spark.read.parquet(f"{self.path}/{folder}/gone"), "chunk_id", "left_semi"))))
        if pieces:
            self._publish([*self.segments, {"number": self.version + 1, "folder": folder, "pieces": pieces}], n, total)

    @staticmethod
    def _sizes(rows: DataFrame) -> tuple[int, int]:
        return tuple(rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first())

    def clear(self) -> None:
        """No chunk is live any more."""
        self._publish([], 0, 0)

    def compact(self) -> None:
        """Write what is live as one segment; readers of the old ones go on until :meth:`vacuum`."""
        known = self.chunks()
        if known is None:
            return
        folder = f"segment-{self.version + 1:010d}-{uuid.uuid4().hex}"
        self._write(folder, "chunks", known.drop("segment"), by_bucket=False)
        self._write(folder, "postings", self._live(self._piece("postings")).drop("bucket", "segment"))
        self._write(folder, "terms", self._piece("terms").groupBy("token").agg(F.sum("df").alias("df")).where("df > 0"))
        self._publish([{"number": self.version + 1, "folder": folder, "pieces": ["chunks", "postings", "terms"]}], self.n, self.total)

    def vacuum(self) -> list[str]:
        """Delete the folders that the newest state doesn't name, of failed batches too; returns their names."""
        used = {x["folder"] for x in self.segments}
        old = [x for x in listed(self.spark, self.path) if x.startswith("segment-") and x not in used]
        for name in old:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return old


def phrase_starts(index: LexicalIndex, phrases: DataFrame) -> DataFrame:
    """(phrase, m, chunk_id, split, size, starts): where the ``m`` tokens of each phrase stand one after the other.

    The rarest token of a phrase gives the candidates; its other tokens, rarer ones first, are joined by chunk one after the other,
    their positions, shifted to the phrase's start, intersected, and what has no start left is dropped. Candidates go in passes of
    about MOST_STARTS, so what is shuffled at once is bounded. Phrases without tokens are nowhere.
    """
    asked = phrases.select("phrase").distinct().select("phrase", tokens("phrase").alias("t")).where(F.size("t") > 0)
    asked = written(asked.withColumn("p", F.monotonically_increasing_id()).select("p", "phrase", F.size("t").alias("m"), F.posexplode("t").alias("i", "token")), "asked")
    w = Window.partitionBy("p")
    known = asked.join(index.frequencies(asked), "token").withColumn("nth", F.row_number().over(w.orderBy("df", "i"))).withColumn("known", F.count("*").over(w))
    known = written(known.where("known = m").drop("known"), "known")  # all tokens are somewhere
    shifted = F.transform("positions", lambda p: p - F.col("i"))
    columns = ["p", "m", "chunk_id", "split", "size", "starts"]

    def begun(rare: DataFrame) -> DataFrame:
        return index.postings(rare).join(_small(rare.select("p", "m", "i", "token")), "token").withColumn("starts", shifted).select(columns)

    out = [begun(known.where("nth = 1 and m = 1"))]
    several = known.where("nth = 1 and m > 1").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.coalesce(F.max("m"), F.lit(1)).alias("longest")).first()
    passes = -(-several["n"] // MOST_STARTS)
    for part in range(passes):
        mine = known.where(F.pmod(F.xxhash64("p"), F.lit(passes)) == part)
        rows = begun(mine.where("nth = 1 and m > 1"))
        for nth in range(2, several["longest"] + 1):
            here = mine.where(F.col("nth") == nth)
            met = rows.join(_small(here.select("p", "i", "token")), "p").join(index.postings(here).select("token", "chunk_id", "positions"), ["token", "chunk_id"])
            rows = written(met.withColumn("starts", F.array_intersect("starts", shifted)).where(F.size("starts") > 0).select(columns), "starts")
            out.append(rows.where(F.col("m") == nth))
            rows = rows.where(F.col("m") > nth)
    names = _small(asked.select("p", "phrase").distinct())
    return reduce(DataFrame.unionByName, out).join(names, "p").select("phrase", "m", "chunk_id", "split", "size", "starts")


def phrase_search(index: LexicalIndex, queries: DataFrame, k: int, min_hits: int = 2) -> DataFrame:
    """Per query (query_id, keywords) the ``k`` chunks in which any keyword stands as a phrase.

    The best max(20 k, 50) by BM25 over phrases come first: a phrase counts in the child's text, in the parent's, and in both put
    together; its weight is at least LEAST_IDF. Of those the ones that contain ``min_hits`` keywords as they are written stay, most
    keywords, better score and longer children first. A keyword given twice counts twice.
    """
    schema = f"query_id {dict(queries.dtypes)['query_id']}, chunk_id string, keyword_hit_count int, score double, rank int"
    if index.chunks() is None:
        return index.spark.createDataFrame([], schema)
    asked = written(queries.select("query_id", F.explode("keywords").alias("phrase")).where("phrase != ''"), "asked")
    found = phrase_starts(index, asked)
    m, split = F.col("m"), F.col("split")
    count = F.size("starts") + F.size(F.filter("starts", lambda s: (s + m <= split) | (s >= split)))
    met = written(found.select("phrase", "chunk_id", (2 * F.col("size")).alias("size"), count.alias("tf")), "met")
    df = met.groupBy("phrase").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    mean = 2 * index.total / max(1, index.n)
    weigh = F.col("tf") * (PHRASE_K1 + 1) / (F.col("tf") + PHRASE_K1 * (1 - PHRASE_B + PHRASE_B * F.col("size") / F.lit(mean)))
    scored = met.join(_small(df), "phrase").select("phrase", "chunk_id", (idf * weigh).alias("s")).join(_small(asked), "phrase")
    first = written(top(scored.groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), 6).alias("score")), ["query_id"], [F.desc("score"), F.asc("chunk_id")], max(20 * k, 50), "_first"), "first")
    texts = index.chunks(first).select("chunk_id", F.concat_ws("\n", "child_text", "parent_text").alias("_text"), F.length("child_text").alias("_long"))
    both = first.join(queries.select("query_id", "keywords"), "query_id").join(texts, "chunk_id").withColumn("keyword_hit_count", hits(F.col("_text"), F.col("keywords")))
    order = [F.desc("keyword_hit_count"), F.desc("score"), F.desc("_long"), F.asc("chunk_id")]
    return top(both.where(F.col("keyword_hit_count") >= min_hits), ["query_id"], order, k).select("query_id", "chunk_id", "keyword_hit_count", "score", "rank")


def word_search(index: LexicalIndex, queries: DataFrame, k: int) -> DataFrame:
    """Per query (query_id, keywords) the ``k`` chunks by BM25 of the keywords' distinct words; only the buckets of these are read."""
    words = queries.select("query_id", F.explode(F.array_distinct(F.flatten(F.transform("keywords", tokens)))).alias("token"))
    post, df = index.postings(words), index.frequencies(words)
    if post is None:
        return index.spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, chunk_id string, score double, rank int")
    idf = F.log(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.size("positions")
    weigh = tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / F.lit(index.total / max(1, index.n))))
    scored = post.join(df, "token").select("token", "chunk_id", (idf * weigh).alias("s")).join(words, "token")
    return top(scored.groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), 6).alias("score")), ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def phrase_in(text: Column | str, phrase: Column | str) -> Column:
    """Whether a phrase's tokens stand one after the other in a text: the search's test as an expression, without an index."""
    said, asked = (F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" ")) for c in (col(text), col(phrase)))
    return (F.length(asked) > 2) & F.contains(said, asked)
