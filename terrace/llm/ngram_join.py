"""Near duplicates by Jaccard similarity of word shingles: prefix filters under several global token orders, then exact checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrace.llm.common import components, join_groups, parts, row_of, scratch, stored, table

WORDS = 5
#: Similarity of at least NUM / DEN links two documents.
NUM, DEN = 3, 4
ORDERS = 3
#: Pivots of a token in every round after the first, and how many of them, the closest by bitmap, a set is checked against.
PIVOTS, CLOSEST = 4, 8
#: Rounds end when one finds fewer links than this share of the linked sets: most of these were linked before.
SETTLED = 0.5
#: Longs of a bitmap.
LANES = 16
#: Tokens whose low bits are below PART of 8 are counted for the first filter; documents of up to SHORT shingles count all of theirs.
PART = 3
SHORT = 48
CHUNK = 1 << 20
BUCKET_BYTES = 1 << 22
#: Documents whose tokens are sent together, each distinct one once.
BATCH = 1 << 11
#: In place of the document's number: a token that several documents of its batch have.
SEVERAL = np.uint16(0xFFFF)

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_PLACES = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


class Shingler:
    """Sets of hashed shingles of texts, by arrays over about a megabyte of text at a time."""

    def __init__(self, words: int = WORDS) -> None:
        self.words, self.n = words, 0
        self.places = [_PLACES[i % 5] * U(2 * (i // 5) + 1) for i in range(words)]

    def _powers(self, n: int) -> None:
        if n > self.n:
            self.n = max(n, 2 * CHUNK)
            back = U(pow(int(_ODD), -1, 1 << 64))
            self.up = np.cumprod(np.concatenate([[U(1)], np.full(self.n, _ODD)]), dtype=U)
            self.down = np.cumprod(np.concatenate([[U(1)], np.full(self.n, back)]), dtype=U)

    def _chunk(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = _LOWER[np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)]
        self._powers(data.size)
        inside = ~_BLANK[data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        first, last = edge[::2], edge[1::2]
        total = np.concatenate([[U(0)], np.cumsum((data + U(1)) * self.up[: data.size], dtype=U)])
        word = mixed((total[last] - total[first]) * self.down[first])
        ends = np.cumsum([len(r) + 1 for r in raw])
        bound = np.concatenate([[0], np.searchsorted(first, ends)])
        count = np.diff(bound)
        k = self.words
        if word.size >= k:
            run = sum(word[i : word.size - k + 1 + i] * self.places[i] for i in range(k))
        else:
            run = np.zeros(0, U)
        sizes = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
        start = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(int(start[-1]), U)
        for d in np.flatnonzero(sizes).tolist():
            a, b = bound[d], bound[d + 1]
            part = out[start[d] : start[d + 1]]
            if b - a >= k:
                part[:] = run[a : b - k + 1]
            else:
                part[0] = sum((word[a + i] * self.places[i] for i in range(b - a)), U(b - a))
        out = mixed(out)
        for d in np.flatnonzero(sizes > 1).tolist():
            out[start[d] : start[d + 1]].sort()
        new = np.ones(out.size, bool)
        new[1:] = out[1:] != out[:-1]
        new[start[:-1][sizes > 0]] = True
        owner = np.repeat(np.arange(len(raw)), sizes)
        return out[new], np.bincount(owner[new], minlength=len(raw))

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens, those of each text sorted and distinct, one text after the other; and each text's number of them."""
        tokens, sizes, held, size = [], [], [], 0
        with np.errstate(over="ignore"):
            for t in texts:
                held.append((t or "").encode("utf-8", "surrogatepass"))
                size += len(held[-1])
                if size >= CHUNK:
                    a, b = self._chunk(held)
                    tokens, sizes, held, size = [*tokens, a], [*sizes, b], [], 0
            if held:
                a, b = self._chunk(held)
                tokens, sizes = [*tokens, a], [*sizes, b]
        return np.concatenate([np.zeros(0, U), *tokens]), np.concatenate([np.zeros(0, np.int64), *sizes]).astype(np.int64)


def per_set(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of values by set, 0 for empty ones."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def signatures(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, equal for equal sets."""
    with np.errstate(over="ignore"):
        return mixed(per_set(mixed(tokens ^ _ODD), sizes) + sizes.astype(U) * _PLACES[1]).view(np.int64)


def need(n: np.ndarray | int):
    """The least intersection of a set of n tokens with a similar one."""
    return -(-NUM * n // DEN)


def split(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key with the positions that have it."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for at in np.split(order, cuts):
        if at.size:
            yield int(keys[at[0]]), at


def describe(docs: DataFrame, buckets: int) -> DataFrame:
    """A row per document (row, id, text): row, id, th (hash of the text), n (shingles), sig (a name of its set), and live: it
    may have a partner.

    A document whose partner shares at least 3/4 of its tokens shares all but a quarter of them in any part of the token
    space. Tokens of a fixed part of it are sent to hash buckets, packed, and those that another document has are counted
    there; what documents of one batch share is counted before, so a batch sends a token once however many have it. A
    document with too few shared tokens has no link and needs no more work.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make, number = Shingler(), TaskContext.get().partitionId() << 32
        for whole in batches:
            for at in range(0, len(whole), BATCH):
                batch = whole.iloc[at : at + BATCH]
                tokens, sizes = make.sets(batch["text"].tolist())
                owner = np.repeat(np.arange(len(batch), dtype=np.uint16), sizes)
                part = (tokens & U(7)) < PART
                mine = np.where(sizes <= SHORT, sizes, np.bincount(owner[part], minlength=len(batch)))
                sig = signatures(tokens, sizes)
                sent = part | (sizes <= SHORT * DEN // NUM)[owner]
                tokens, owner, part = tokens[sent], owner[sent], part[sent]
                distinct, first, which, times = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
                again = times[which] >= 2
                near = [np.bincount(owner[x], minlength=len(batch)) for x in (again, again & part)]
                facts = [*[batch[c].to_numpy("<i8") for c in ("row", "id", "th")], *[x.astype("<i8") for x in (sizes, mine, sig, *near)]]
                rows = [(-1 - number % buckets, number, np.concatenate(facts).tobytes(), b"")]
                owner = np.where(times >= 2, SEVERAL, owner[first])
                for b, where in split(((distinct >> U(32)) % U(buckets)).astype(np.int64)):
                    rows.append((b, number, distinct[where].astype(np.uint32).tobytes(), owner[where].tobytes()))
                yield pd.DataFrame(rows, columns=["bucket", "batch", "a", "b"])
                number += 1

    def count(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        if group["bucket"].iloc[0] < 0:
            for batch, a in zip(group["batch"], group["a"]):
                known = dict(zip([*names, "shared", "in_part"], np.frombuffer(a, "<i8").reshape(len(names) + 2, -1)))
                out.append(pd.DataFrame({"batch": batch, "at": np.arange(known["row"].size), "shared": known.pop("shared"), "in_part": known.pop("in_part"), **known}))
        else:
            tokens = np.frombuffer(b"".join(group["a"]), np.uint32)
            _, which, times = np.unique(tokens, return_inverse=True, return_counts=True)
            shared, part, first = times[which] >= 2, (tokens & np.uint32(7)) < PART, 0
            for batch, b in zip(group["batch"], group["b"]):
                owner = np.frombuffer(b, np.uint16)
                here, first = slice(first, first + owner.size), first + owner.size
                hit = shared[here] & (owner != SEVERAL)
                every = np.bincount(owner[hit])
                at = np.flatnonzero(every)
                inside = np.bincount(owner[hit & part[here]], minlength=every.size)
                out.append(pd.DataFrame({"batch": batch, "at": at, "shared": every[at], "in_part": inside[at], **dict.fromkeys(names)}))
        return pd.concat(out).astype(dict.fromkeys(names, "Int64"))

    names = ["row", "id", "th", "n", "mine", "sig"]
    hashed = docs.select("row", "id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    sent = hashed.mapInPandas(emit, "bucket int, batch long, a binary, b binary")
    counted = sent.groupBy("bucket").applyInPandas(count, "batch long, at int, shared long, in_part long, " + ", ".join(f"{c} long" for c in names))
    facts = counted.groupBy("batch", "at").agg(F.sum("shared").alias("shared"), F.sum("in_part").alias("in_part"), *[F.max(c).alias(c) for c in names])
    got = F.when(F.col("n") <= SHORT, F.col("shared")).otherwise(F.col("in_part"))
    spare = F.expr(f"n - ({NUM} * n + {DEN - 1}) div {DEN}")
    return facts.select("row", "id", "th", "n", "sig", ((F.col("n") > 0) & (got >= F.col("mine") - spare)).alias("live"))


def live_sets(docs: DataFrame, facts: DataFrame, per_batch: int = 1 << 19) -> DataFrame:
    """The distinct sets that may have a partner, in batches: sigs, sizes and tokens, packed."""
    wanted = facts.where("live").groupBy("sig").agg(F.min("row").alias("row")).select("row", F.col("sig").alias("want"))
    texts = docs.select("row", "text").join(wanted, "row")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, number, held, size = Shingler(), TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            tokens, sizes = shingler.sets(batch["text"].tolist())
            ends = np.cumsum(sizes)
            for i, want in enumerate(batch["want"].tolist()):
                held.append((want, sizes[i], tokens[ends[i] - sizes[i] : ends[i]]))
                size += int(sizes[i])
                if size >= per_batch:
                    yield _batch(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield _batch(number, held)

    return texts.mapInPandas(make, "batch long, sigs binary, sizes binary, tokens binary")


def _batch(number: int, held: list[tuple[int, int, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame({"batch": [number], "sigs": [np.array([h[0] for h in held], "<i8").tobytes()], "sizes": [np.array([h[1] for h in held], "<i8").tobytes()], "tokens": [np.concatenate([h[2] for h in held]).astype("<u8").tobytes()]})


def _unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row.sigs, "<i8"), np.frombuffer(row.sizes, "<i8"), np.frombuffer(row.tokens, "<u8")


def prefixes(sets: DataFrame, buckets: int) -> DataFrame:
    """Postings (ord, token, sig, n, pos) of the prefixes under each global order, without tokens that one set alone has.

    The orders sort tokens by the number of sets that have them and then by a hash of their own, so rare tokens come first
    and common passages last. Two similar sets share a token of their prefixes under every order.
    """

    def distinct(row) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The distinct tokens of a batch by bucket, and how many of its sets have each: a batch sends a token once."""
        tokens, times = np.unique(_unpack(row)[2], return_counts=True)
        for b, where in split(((tokens >> U(32)) % U(buckets)).astype(np.int64)):
            yield b, tokens[where], times[where].astype("<u4")

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                rows = [(b, row.batch, tokens.tobytes(), times.tobytes()) for b, tokens, times in distinct(row)]
                yield pd.DataFrame(rows, columns=["bucket", "batch", "tokens", "times"])

    def count(group: pd.DataFrame) -> pd.DataFrame:
        _, which = np.unique(np.frombuffer(b"".join(group["tokens"]), "<u8"), return_inverse=True)
        total = np.bincount(which, np.frombuffer(b"".join(group["times"]), "<u4"))
        cuts = np.cumsum([len(t) // 8 for t in group["tokens"]])[:-1]
        df = [x.astype("<u4").tobytes() for x in np.split(total[which], cuts)]
        return pd.DataFrame({"bucket": group["bucket"], "batch": group["batch"], "df": df})

    counted = sets.mapInPandas(send, "bucket int, batch long, tokens binary, times binary").groupBy("bucket").applyInPandas(count, "bucket int, batch long, df binary")
    back = counted.groupBy("batch").agg(F.collect_list(F.struct("bucket", "df")).alias("dfs"))  # of one batch of sets

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                sigs, sizes, tokens = _unpack(row)
                parts_ = {r["bucket"]: r["df"] for r in row.dfs}
                known, counts = (np.concatenate(x) for x in zip(*[(t, np.frombuffer(parts_[b], "<u4")) for b, t, _ in distinct(row)]))
                order = np.argsort(known)
                df = counts[order][np.searchsorted(known, tokens, sorter=order)]
                owner, starts = np.repeat(np.arange(sizes.size), sizes), np.cumsum(sizes) - sizes
                keep = sizes - need(sizes) + 1
                for o in range(ORDERS):
                    with np.errstate(over="ignore"):
                        order = np.lexsort((mixed(tokens + _PLACES[o]), df, owner))
                    rank = np.arange(tokens.size) - starts[owner]
                    chosen = (rank < keep[owner]) & (df[order] >= 2)
                    pick = order[chosen]
                    yield pd.DataFrame({"ord": o, "token": tokens[pick].view(np.int64), "sig": sigs[owner[pick]], "n": sizes[owner[pick]], "pos": rank[chosen]})

    return sets.join(back, "batch").mapInPandas(choose, "ord int, token long, sig long, n long, pos long")


def one_by_one(sets: DataFrame) -> DataFrame:
    """(sig, tokens): a row for each set of the batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                sigs, sizes, tokens = _unpack(row)
                yield pd.DataFrame({"sig": sigs, "tokens": np.split(tokens.view("<i8"), np.cumsum(sizes)[:-1])})

    return sets.mapInPandas(run, "sig long, tokens array<long>")


def similar(pairs: DataFrame, each: DataFrame) -> DataFrame:
    """The pairs (a, b) of sigs whose sets (sig, tokens) are similar, by their whole sets."""
    left = each.select(F.col("sig").alias("a"), F.col("tokens").alias("x"))
    right = each.select(F.col("sig").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", F.size("x").alias("p"), F.size("y").alias("q"), F.size(F.array_intersect("x", "y")).alias("common"))
    return both.where(f"{DEN} * common >= {NUM} * (p + q - common)").select("a", "b")


def bitmaps(sets: DataFrame) -> DataFrame:
    """(sig, size, m0 ... m15): each set's tokens as a bitmap of 1024 bits."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                sigs, sizes, tokens = _unpack(row)
                bits = np.zeros((sigs.size, LANES), U)
                lane, bit = ((tokens >> U(26)) & U(LANES - 1)).astype(np.int64), U(1) << ((tokens >> U(20)) & U(63))
                np.bitwise_or.at(bits, (np.repeat(np.arange(sizes.size), sizes), lane), bit)
                yield pd.DataFrame({"sig": sigs, "size": sizes, **{f"m{i}": bits[:, i].view(np.int64) for i in range(LANES)}})

    return sets.mapInPandas(make, "sig long, size long, " + ", ".join(f"m{i} long" for i in range(LANES)))


def may_be_similar(a: str, b: str) -> str:
    """Condition on the bitmaps and sizes of two sets, with these prefixes of their columns, that similar ones always meet.

    Each bit that one set alone has stands for a token, at least, that it alone has.
    """
    least = f"(({NUM} * ({a}size + {b}size) + {NUM + DEN - 1}) div {NUM + DEN})"
    alone = lambda x, y: " + ".join(f"bit_count({x}m{i} & ~{y}m{i})" for i in range(LANES))
    return f"{a}size >= {least} and {b}size >= {least} and {alone(a, b)} <= {a}size - {least} and {alone(b, a)} <= {b}size - {least}"


def alone(a: str, b: str) -> str:
    """How many bits of their bitmaps two sets don't share, as SQL with these prefixes of their columns."""
    return " + ".join(f"bit_count({a}m{i} ^ {b}m{i})" for i in range(LANES))


def links(sets: DataFrame, buckets: int) -> DataFrame:
    """(node, root) of the sets that are linked to another, root the least sig of the connected group.

    Each round picks pivots for every prefix token whose sets are in several groups, and checks each set against the pivots of
    other groups that are closest to it by bitmap. That joins large groups of near copies at a cost in proportion to their
    sizes. Rounds go on until few sets find new links. Then all pairs of different groups are checked that share a prefix
    token under every order, at places that leave enough tokens after them, and whose bitmaps agree. So no link between
    groups is lost, whatever the rounds have found.
    """
    post = stored(prefixes(sets, buckets), "postings", "ord")
    info = stored(bitmaps(sets), "bitmaps")
    each = stored(one_by_one(sets), "each")
    one, two = (info.select(*[F.col(c).alias(f"{x}_{c}") for c in info.columns]) for x in "ab")
    first = post.where("ord = 0").select("token", "sig", "pos")
    near, roots, turn = None, None, 0
    while True:
        here = first if roots is None else first.join(roots, F.col("sig") == F.col("node"), "left")
        here = here.select("token", "sig", (F.col("sig") if roots is None else F.coalesce("root", "sig")).alias("root"))
        draws = [F.min(F.struct(F.xxhash64("sig", F.lit(turn), F.lit(i), F.pmod("token", F.lit(32 if turn else 1))).alias("h"), "sig", "root")).alias(f"p{i}") for i in range(PIVOTS if turn else 1)]
        drawn = here.groupBy("token").agg(*draws, F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
        pivots = F.array_distinct(F.array(*[F.struct(F.col(f"p{i}.sig").alias("pivot"), F.col(f"p{i}.root").alias("other")) for i in range(len(draws))]))
        stars = here.join(drawn.select("token", F.explode(pivots).alias("p")), "token").where("root != p.other")
        pairs = stars.select(F.col("sig").alias("a_sig"), F.col("p.pivot").alias("b_sig")).distinct()
        fit = pairs.join(one, "a_sig").join(two, "b_sig").where(may_be_similar("a_", "b_")).select("a_sig", "b_sig", F.expr(f"({alone('a_', 'b_')}) / (a_size + b_size)").alias("gap"))
        rank = F.row_number().over(Window.partitionBy("a_sig").orderBy("gap", "b_sig"))  # a_sig: PIVOTS pairs for each of its prefix tokens at most
        best = fit.withColumn("rank", rank).where(F.col("rank") <= (CLOSEST if turn else 1)).select(F.col("a_sig").alias("a"), F.col("b_sig").alias("b"))
        found = stored(similar(best, each), "near")
        near = found if near is None else near.union(found)
        roots = components(near, "a", "b", "stars")
        turn += 1
        if found.count() <= SETTLED * roots.count():
            break
    placed = first.join(roots, F.col("sig") == F.col("node"), "left").select("token", "sig", "pos", F.coalesce("root", "sig").alias("root"))
    open_ = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("token")
    placed = placed.join(open_, "token").withColumnRenamed("sig", "a_sig").join(one, "a_sig")
    placed = stored(placed.select("token", *[F.col(c) if c.startswith("a_") else F.col(c).alias(f"a_{c}") for c in placed.columns if c != "token"]), "open")
    other = placed.select("token", *[F.col(c).alias(f"b{c[1:]}") for c in placed.columns if c.startswith("a_")])
    after = f"least(a_size - a_pos, b_size - b_pos) >= ({NUM} * (a_size + b_size) + {NUM + DEN - 1}) div {NUM + DEN}"
    pairs = placed.join(other, "token").where(f"a_root < b_root and {after} and {may_be_similar('a_', 'b_')}")
    pairs = stored(pairs.select(F.col("a_sig").alias("a"), F.col("b_sig").alias("b")).distinct(), "pairs")
    # the pairs' prefixes under the other orders must meet too
    named = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
    rest = post.where("ord > 0").join(named, "sig", "left_semi").groupBy("sig").agg(*[F.collect_list(F.when(F.col("ord") == o, F.col("token"))).alias(f"o{o}") for o in range(1, ORDERS)])  # of one set
    for x in "ab":
        pairs = pairs.join(rest.select(F.col("sig").alias(x), *[F.col(f"o{o}").alias(f"{x}{o}") for o in range(1, ORDERS)]), x)
    met = " and ".join(f"arrays_overlap(a{o}, b{o})" for o in range(1, ORDERS))
    return components(near.union(similar(pairs.where(met).select("a", "b"), each)), "a", "b", "links")


def groups(rows: DataFrame) -> DataFrame:
    """A row per stored row (row, id, text): row, id, n (shingles), and head, the (id, th, row) of its group that comes first.

    ``row`` is unique; rows without shingles have no head.
    """
    spark = rows.sparkSession
    with scratch(spark) as keep:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(parts(spark), size // BUCKET_BYTES + 1)
        facts = stored(describe(rows, buckets), "facts")
        sets = stored(live_sets(rows, facts), "sets")
        roots = links(sets, buckets)
        least = facts.where("n > 0").groupBy("sig").agg(F.min(F.struct("id", "th", "row")).alias("first"))
        classes = least.join(roots, F.col("sig") == F.col("node"), "left").select("sig", "first", F.coalesce("root", "sig").alias("root"))
        classes = stored(classes, "classes")
        tops = classes.groupBy("root").agg(F.min("first").alias("head"), F.count("*").alias("sets"))
        classes = join_groups(classes, tops, "root", "sets", classes.count()).select("sig", "head")
        # a set's rows may be a third of the table: spread what large sets need over tasks
        counts = facts.groupBy("sig").agg(F.count("*").alias("size")).join(classes, "sig")
        keyed = facts.select("row", "id", "n", F.when(F.col("n") > 0, F.col("sig")).alias("sig"))
        return keep(stored(join_groups(keyed, counts, "sig", "size", facts.count()), "heads"))


def sortable(key: str) -> Column:
    """The key with nulls last."""
    return F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: key, n_shingles, component_id (the least key reachable by links, its own included).

    Documents link at a Jaccard similarity of their sets of 5-word shingles of at least 0.75, without a cap on partners. Texts
    are lower-cased in A-Z and split at blanks; fewer than five words are one shingle; null and blank texts have none and link
    with nothing. Equal sets are one node, so copies cost no pairs. Null keys are linked like others and come last in
    ``component_id``; repeated rows stay. Other columns are ignored. Tokens and sets are compared by hashes of 64 bits.
    """
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), sortable(key).alias("id"), F.col(text).alias("text")), "rows")
    out = groups(rows)
    real = lambda c: F.when(c != (1 << 63) - 1, c)
    return out.select(real(F.col("id")).alias(key), F.col("n").alias("n_shingles"), real(F.coalesce("head.id", "id")).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that are linked, over any number of links, to one of lesser key.

    Of linked rows with one key that of the least hash of its text stays. Rows are told apart by a stored number, so keys may
    be null or repeat: rows without a link stay, whatever their keys.
    """
    rows = stored(docs.select(row_of(docs).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    found = groups(rows.select("row", sortable(f"doc.`{key}`").alias("id"), F.col(f"doc.`{text}`").alias("text")))
    kept = found.where("head is null or row = head.row").select("row")
    return rows.join(kept, "row", "left_semi").select("doc.*")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles, and the least document reachable by links, of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE_OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL
  HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.c = e.x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, (SELECT min(r.c) FROM r WHERE r.doc_id = s.doc_id) AS component_id FROM s
"""
