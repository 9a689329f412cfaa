"""Fuzzy line dedup: keys of normalised lines, joins on them, edit similarity, and one occurrence of each connected group.

``SimHashLines``, the default, links lines whose SimHashes differ in few bits and which are near by edits; blocks of the SimHash find
them all. ``NearLines`` links by edits alone and finds lines by sampled word and character n-grams, at several times the cost.
Everything on the path is a DataFrame expression.
"""

from __future__ import annotations

import itertools
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import components, join_groups, noted, parts, row_of, scratch, shared_dir, stored, table

#: Lines linked by SimHash differ in at most so many of its 64 bits ...
DISTANCE = 3
#: ... and all linked lines in at most this share of the longer line's characters, by edit distance.
EDITS = 0.15
#: Bytes of a SimHash that its keys hold, four of eight each: those whose numbers give 0 by exclusive or. Any three bytes are in one of these
#: 14 sets, and what a set leaves out is one of them too, so lines within the distance share a key, of 32 bits. Keys of two of five
#: blocks have 25, which lines share by chance: on 2 million lines 1.28 million such keys were shared, of these 0.25 million.
BLOCKS = tuple(x for x in itertools.combinations(range(8), 4) if x[0] ^ x[1] ^ x[2] ^ x[3] == 0)
#: Words whose bits are added before they are summed over rows; one less than a power of two, so that counts fill their bits.
PIECE = 15
#: Words whose bits are summed in bytes, a multiple of PIECE; below 128, so that the sum of a long stays positive.
CHUNK = 120
ONES = 0x0101010101010101
LANES = 0x0001000100010001
#: Keys of a line by each kind of n-gram.
SKETCH = 12
#: Lines are compared if they share this part of the keys of the one that has fewer; lines within EDITS share more, but for a few in a thousand.
SHARED = 0.15
#: Letters that are counted before texts are compared.
LETTERS = "etains"
#: Characters that a unit stands for where whole words are compared.
UNIT = 3


def normal(lower: Column) -> Column:
    """Of a lower-cased line, runs of blanks as one space, none at the ends."""
    odd = reduce(lambda a, b: a | b, [lower.contains(x) for x in ("  ", "\t", "\x0b", "\f", "\r")])
    return F.trim(F.when(odd, F.regexp_replace(lower, r"[\t\x0B\f\r ]+", " ")).otherwise(lower))


def line_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, th, pos, norm, id) of each line that isn't blank; th is the hash of the text, id that of the normalised line."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = docs.select(F.col(key).alias("key"), F.xxhash64(whole).alias("th"), F.posexplode(F.split(F.lower(whole), "\n")).alias("pos", "line"))
    lines = lines.where(F.btrim("line", F.lit(" \t\x0b\f\r")) != "").select("key", "th", "pos", normal(F.col("line")).alias("norm"))
    return lines.withColumn("id", F.xxhash64("norm"))


def added(rows: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """The rows with the bits of 2^n - 1 columns of longs counted by place: n columns that hold a binary digit of each place's count, the lowest first."""
    kept, digits, made = [c for c in rows.columns if c not in names], [list(names)], 0
    while any(len(same) > 1 for same in digits):  # three of the same weight give their sum's two digits, all of a layer at once
        sums, more = [], [[] for _ in range(len(digits) + 1)]
        for weight, same in enumerate(digits):
            while len(same) > 2:
                x, y, z = same.pop(), same.pop(), same.pop()
                sums += [f"{x} ^ {y} ^ {z} as _sum{made}", f"({x} & {y}) | ({z} & ({x} ^ {y})) as _carry{made}"]
                more[weight].append(f"_sum{made}")
                more[weight + 1].append(f"_carry{made}")
                made += 1
        rows = rows.selectExpr(*kept, *itertools.chain(*digits), *sums)
        digits = [x + y for x, y in itertools.zip_longest(digits, more, fillvalue=[]) if x or y]
    return rows, [same[0] for same in digits]


def simhash(lines: DataFrame) -> DataFrame:
    """(id, simhash): bit i is set where more than half of the line's distinct words have it in their hashes; where half have it, the
    word of least hash decides, so that short lines have as many set bits as others.

    A row is made of each PIECE of a line's words, whose bits are added with a few operations on longs. Eight counters share a long from
    there. Of up to CHUNK words four are compared with the half at once, each with two bytes of its own: what is missing to 127 is added, and
    the bit of 128 then tells. Longer lines are summed by chunks and then in two counters a long, each of 31 bits, more than a line can have
    words. ``lines`` must be one row per id and partitioned by it, so that the words stay in their task.
    """
    many = F.expr(f"length(norm) > {2 * CHUNK} and length(norm) - length(replace(norm, ' ', '')) >= {CHUNK}")
    lane = lambda digit, i, weight: f"shiftleft(shiftrightunsigned({digit}, {i}) & {ONES}L, {weight})"

    def pieces(some: DataFrame) -> DataFrame:
        hashed = some.select("id", F.array_distinct(F.transform(F.split("norm", " "), lambda w: F.xxhash64(w))).alias("hs"))
        cut = hashed.select("id", F.size("hs").alias("n"), F.array_min("hs").alias("m"), "hs", F.explode(F.expr(f"sequence(0, (size(hs) - 1) div {PIECE})")).alias("at"))
        words = [f"_h{i}" for i in range(PIECE)]
        cut = cut.selectExpr("id", "n", "m", f"cast(at div {CHUNK // PIECE} as int) as chunk", *[f"coalesce(get(hs, cast(at * {PIECE} + {i} as int)), 0L) as {w}" for i, w in enumerate(words)])
        cut, digits = added(cut, words)
        return cut.selectExpr("id", "n", "m", "chunk", *[" | ".join(lane(d, i, weight) for weight, d in enumerate(digits)) + f" as s{i}" for i in range(8)])

    line = [F.max("n").alias("n"), F.max("m").alias("m")]  # all the same
    sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(8)]
    short = pieces(lines.where(~many)).groupBy("id").agg(*line, *sums)
    short = short.withColumn("rest", F.expr(f"(127 - n div 2) * {LANES}L"))
    tied = lambda i: f"if(n % 2 = 0, shiftrightunsigned(m, {i}) & {LANES}L, 0L)"
    told = [f"shiftleft(shiftrightunsigned(((shiftrightunsigned(s{i}, {j}) & {LANES * 255}L) + rest + {tied(i + j)}) & {LANES * 128}L, 7), {i + j})" for i in range(8) for j in (0, 8)]
    hashed = short.select("id", F.expr(" | ".join(told)).alias("simhash"))
    some = pieces(lines.where(many)).groupBy("id", "chunk").agg(*line, *sums)
    pair = lambda i: F.expr(f"(shiftrightunsigned(s{i % 8}, {i - i % 8}) & 255L) + shiftleft(shiftrightunsigned(s{i % 8}, {i - i % 8 + 32}) & 255L, 31)")
    whole = some.groupBy("id").agg(*line, *[F.sum(pair(i)).alias(f"c{i}") for i in range(32)])
    own = lambda i: f"(shiftrightunsigned(m, {i}) & 1L)"
    bits = [f"(if(2 * (c{i} & {(1 << 31) - 1}L) + {own(i)} > n, {1 << i}L, 0L) | if(2 * shiftrightunsigned(c{i}, 31) + {own(i + 32)} > n, shiftleft(1L, {i + 32}), 0L))" for i in range(32)]
    return hashed.union(whole.select("id", F.expr(" | ".join(bits)).alias("simhash")))


def block_keys(value: Column) -> Column:
    """A key for each choice of bytes that lines within the distance can agree in, the bits of these; some choice agrees for sure."""
    masks = [sum(255 << 8 * i for i in chosen) for chosen in BLOCKS]
    return F.array(*[value.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])


def units(norm: Column) -> Column:
    """The words of a line as letters of an alphabet of 20,480, each repeated once for every UNIT characters of the word and its space.

    UNIT times the edit distance of two such texts is an upper bound of their lines' distance, at a small part of the cost.
    """
    letter = lambda w: F.repeat(F.hex(F.lit(0x3000).cast("long") + F.pmod(F.xxhash64(w), F.lit(0x5000).cast("long"))), F.ceil((F.length(w) + 1) / UNIT).cast("int"))
    return F.decode(F.unhex(F.array_join(F.transform(F.split(norm, " "), letter), "")), "UTF-16BE")


#: Condition on two lines: at most ``most`` edits apart. Whole words come first, as they are enough for most.
WITHIN = f"levenshtein(units_a, units_b, most div {UNIT}) >= 0 or levenshtein(norm_a, norm_b, most) >= 0"


def lowest(grams: Column) -> Column:
    """The SKETCH least of an array of longs, each once, in order."""
    return F.array_distinct(F.slice(F.sort_array(grams), 1, SKETCH))


class Lines:
    """The distinct lines of a table: ``texts`` (id, norm), and ``all``, with what is known of each before its text is read, and
    keys. Lines that may be linked share a key. Both are bucketed by id, so that joins by it don't move them.

    Lines are named by a hash of 64 bits.
    """

    known: tuple[str, ...] = ("size",)

    def __init__(self, lines: DataFrame) -> None:
        self.names: list[str] = []
        distinct = lines.groupBy("id").agg(F.max("norm").alias("norm"))  # all the same
        self.all = self.texts = self.kept(self.describe(distinct.withColumn("size", F.length("norm"))))

    def kept(self, rows: DataFrame) -> DataFrame:
        """Rows as a table bucketed by id."""
        spark = rows.sparkSession
        self.names.append(name := f"lines_{uuid.uuid4().hex}")
        path = noted(f"{shared_dir(spark)}/terrace-{name}")
        rows.write.bucketBy(parts(spark), "id").sortBy("id").option("path", path).option("compression", "zstd").saveAsTable(name)
        return spark.table(name)

    def drop(self) -> None:
        for name in self.names:
            self.all.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")

    def describe(self, distinct: DataFrame) -> DataFrame:
        """Add what is known of (id, norm, size), and the array of keys."""
        raise NotImplementedError

    def may_link(self, a: str, b: str) -> str:
        """Condition on what is known of two lines, as SQL with these patterns of their columns; it never rules out a link."""
        raise NotImplementedError

    def enough(self, common: str, keys_a: str, keys_b: str) -> str:
        """Condition on the number of keys that two lines share and have."""
        return f"{common} >= 1"

    #: What pairs of a key need beside what is known, so that each is taken once.
    once_by: tuple[str, ...] = ("keys",)

    def once(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of pairs of a key's lines, each once: at the least key that its lines share; if only two lines have that, they were
        checked before."""
        met = pairs.where("key = array_min(array_intersect(keys, b_keys))").where(self.enough("size(array_intersect(keys, b_keys))", "size(keys)", "size(b_keys)"))
        return met.select(F.col("id").alias("a"), F.col("b_id").alias("b"))

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of ids that may be linked whose texts pass the edit check."""
        with scratch(pairs.sparkSession) as keep:
            near = pairs
            for x in "ab":  # what is small comes first, keys are joined to what it leaves
                near = near.join(self.all.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in self.known]), x)
            near = stored(near.where(self.may_link("{}_a", "{}_b")).select("a", "b"), "like-lines")
            if self.once_by:
                for x in "ab":
                    near = near.join(self.all.select(F.col("id").alias(x), F.col("keys").alias(f"keys_{x}")), x)
                near = near.where(self.enough("size(array_intersect(keys_a, keys_b))", "size(keys_a)", "size(keys_b)"))
                near = stored(near.select("a", "b"), "close-lines")
            # the texts are read once, where they lie, and only those of close lines go on
            needed = near.select(F.col("a").alias("id")).union(near.select("b")).distinct()
            texts = self.texts.select("id", "norm").join(needed.hint("shuffle_hash"), "id", "left_semi")
            texts = stored(texts.select("id", "norm", units(F.col("norm")).alias("units")), "close-texts")
            for x in "ab":
                near = near.join(texts.select(F.col("id").alias(x), F.col("norm").alias(f"norm_{x}"), F.col("units").alias(f"units_{x}")), x)
            near = near.withColumn("most", F.expr(f"cast({EDITS} * greatest(length(norm_a), length(norm_b)) as int)")).where("abs(length(norm_a) - length(norm_b)) <= most")
            dealt = near.repartition(4 * parts(self.all.sparkSession))  # by number: the checks take long, not the bytes
            return keep(stored(dealt.where(WITHIN).select("a", "b"), "near-lines"))

    #: How lines are joined with their pivots: where few keys are shared, those of a task are held in memory and the lines need no sort.
    met_by: str = "merge"

    def blocks(self) -> tuple[DataFrame, DataFrame]:
        """(id, key, pivot, members) of the lines whose keys others have too, the pivot a key's least line; and (a, b, common) of each
        line and each of its pivots."""
        keyed = self.all.select("id", F.explode("keys").alias("key")).repartition(parts(self.all.sparkSession), "key")
        least = keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("members")).where("members > 1")
        shared = stored(keyed.join(least.hint(self.met_by), "key"), "blocks")
        return shared, shared.where("id != pivot").groupBy(F.col("id").alias("a"), F.col("pivot").alias("b")).agg(F.count("*").alias("common"))

    def starred(self, stars: DataFrame) -> DataFrame:
        """Links of lines with pivots: first with the one that each shares most keys with, then with those that are in another group by then."""
        stars = stored(stars, "line-stars")
        near = self.linked(stars.groupBy("a").agg(F.max_by("b", F.struct("common", "b")).alias("b")))
        roots = components(near, "a", "b", "line-stars")
        for x in "ab":
            stars = stars.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left")
        return near.union(self.linked(stars.where("not coalesce(root_a, a) <=> coalesce(root_b, b)").select("a", "b")))

    def groups(self) -> DataFrame:
        """(node, root) of the lines that have a link.

        First lines are checked against the lines of least id of their keys; that joins groups of near copies at a cost in
        proportion to their sizes. Keys with three lines or more that then still hold several groups give all pairs of different
        groups, so no link between groups that share a key is lost.
        """
        shared, stars = self.blocks()
        near = self.starred(stars)
        roots = components(near, "a", "b", "line-stars")
        placed = shared.where("members > 2").join(roots, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("root", "id").alias("root"))
        open_ = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
        placed = stored(placed.join(open_, "key").join(self.all.select("id", *self.once_by, *self.known), "id"), "open-blocks")
        other = placed.select("key", *[F.col(c).alias(f"b_{c}") for c in placed.columns if c != "key"])
        more = self.linked(self.once(placed.join(other, "key").where(f"root < b_root and {self.may_link('{}', 'b_{}')}")))
        if more.isEmpty():
            return roots
        # the groups so far are stars, so their links need no more than the new ones
        return components(roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), "a", "b", "line-links")


class SimHashLines(Lines):
    """Lines that link by edits and by a SimHash within DISTANCE bits; the keys are choices of its blocks."""

    known = ("simhash",)
    once_by = ()
    met_by = "shuffle_hash"

    def __init__(self, lines: DataFrame) -> None:
        self.names = []
        self.texts = self.kept(lines.groupBy("id").agg(F.max("norm").alias("norm")))
        hashed = self.kept(simhash(self.texts))  # the words stay where the lines are
        self.all = hashed.withColumn("keys", block_keys(F.col("simhash")))

    def once(self, pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("id").alias("a"), F.col("b_id").alias("b")).distinct()

    def starred(self, stars: DataFrame) -> DataFrame:
        """All pivots at once: few that aren't near share 32 bits."""
        return self.linked(stars.select("a", "b"))

    def may_link(self, a: str, b: str) -> str:
        return f"bit_count({a.format('simhash')} ^ {b.format('simhash')}) <= {DISTANCE}"


class NearLines(Lines):
    """Lines that link by edits alone.

    A line's keys are a bottom-k sketch of its n-grams: of three words, of four where it is long, and where it is short of the
    characters from the start of each word on or from anywhere. Long n-grams, which few unrelated lines share, come first in
    the order. The part of their keys that two lines share estimates the part of their n-grams that they do: a pair is missed
    where it is under SHARED. The bounds of the kinds overlap, so lines on both sides of one meet too.
    """

    known = ("size", *[f"n_{c}" for c in LETTERS])

    def describe(self, distinct: DataFrame) -> DataFrame:
        told = distinct.withColumn("ws", F.split("norm", " ")).withColumn("n", F.size("ws"))
        mark = lambda w: F.shiftleft(F.least(F.length(w), F.lit(4095)).cast("long"), 48) + F.xxhash64(w).bitwiseAND(F.lit((1 << 48) - 1))
        told = told.withColumn("marks", F.when(F.col("n") >= 20, F.transform("ws", mark)))
        none = F.array().cast("array<long>")

        def runs(width: int) -> Column:
            """Hashes of ``width`` words each, halved for every other character; a sum of marks has the lengths' sum above its hash."""
            total = lambda i: reduce(lambda x, y: x + y, [F.get("marks", i + j if j else i) for j in range(width)])
            ranked = lambda t: F.call_function("shiftrightunsigned", F.xxhash64(t), F.least(F.lit(16), F.shiftright(t, 49).cast("int")))
            return lowest(F.transform(F.transform(F.sequence(F.lit(0), F.col("n") - width), total), ranked))

        hashed = lambda kind, gram: F.shiftrightunsigned(F.xxhash64(F.lit(kind), gram), 1)
        starts = F.transform("ws", lambda w, i: hashed(3, F.substring(F.concat_ws(" ", w, F.get("ws", i + 1), F.get("ws", i + 2)), 1, 12)))
        inside = lambda kind, width: lowest(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("size") - (width - 1))), lambda i: hashed(kind, F.substring(F.col("norm"), i, F.lit(width)))))
        kinds = [
            ("n >= 20 and n < 48", runs(3)), ("n >= 36", runs(4)), ("n >= 7 and n < 24 and size >= 17", lowest(starts)),
            ("n < 9 and size >= 17", inside(4, 5)), ("size >= 7 and size < 24", inside(5, 3)),  # below 7 characters no edit is allowed
        ]
        keys = F.concat(*[F.when(F.expr(where), made).otherwise(none) for where, made in kinds])
        counts = [F.expr(f"length(norm) - length(replace(norm, '{c}', ''))").alias(f"n_{c}") for c in LETTERS]
        return told.select("id", "norm", "size", *counts, keys.alias("keys"))

    def may_link(self, a: str, b: str) -> str:
        x, y = a.format, b.format
        longer = f"greatest({x('size')}, {y('size')})"
        apart = [f"{x(c)} - {y(c)}" for c in self.known[1:]]  # letters that one has more of must be replaced or removed
        return f"abs({x('size')} - {y('size')}) <= {EDITS} * {longer} and {' + '.join(f'abs({d})' for d in apart)} + abs({' + '.join(apart)}) <= 2 * cast({EDITS} * {longer} as int)"

    def enough(self, common: str, keys_a: str, keys_b: str) -> str:
        return f"{common} >= greatest(1, {SHARED} * least({keys_a}, {keys_b}))"


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", kind: type[Lines] = SimHashLines) -> DataFrame:
    """(key, th, drop): the positions of the lines to remove from each document, named by key and hash of text, that has some.

    Of each group of equal or linked lines the first occurrence stays, by key (null first), hash and position. Blank lines
    are never removed. Rows that repeat a key and its text are one document.
    """
    with scratch(docs.sparkSession) as keep:
        lines = line_table(docs, key, text)
        seen = stored(lines, "occurrences", compression="zstd")  # texts are cut into lines once
        distinct = kind(seen)
        roots = distinct.groups()
        distinct.drop()
        firsts = seen.groupBy("id").agg(F.min(F.struct("key", "th", "pos")).alias("first"), F.count("*").alias("n"))
        classes = stored(firsts.join(roots, F.col("id") == F.col("node"), "left").where("n > 1 or root is not null").select("id", "first", "n", "root"), "line-classes")
        tops = classes.where("root is not null").groupBy("root").agg(F.min("first").alias("top"), F.sum("n").alias("total"), F.count("*").alias("lines"))
        classes = join_groups(classes, tops, "root", "lines", classes.count())
        classes = classes.select("id", F.coalesce("top", "first").alias("top"), F.coalesce("total", "n").alias("total"), "n")
        placed = join_groups(seen, classes, "id", "n", seen.count())
        again = placed.where("total > 1 and not (key <=> top.key and th = top.th and pos = top.pos)")
        drops = again.groupBy("key", "th").agg(F.array_sort(F.collect_set("pos")).alias("drop"))  # the lines of one document
        return keep(stored(drops, "drops"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", kind: type[Lines] = SimHashLines) -> DataFrame:
    """The documents with repeated lines removed from their texts, in the columns they came with.

    A document whose lines are all removed keeps an empty text; null texts stay null.
    """
    drops = repeated_lines(docs, key, text, kind).select(F.col("key").alias("of_key"), F.col("th").alias("of_th"), F.col("drop").alias("gone"))
    here = docs.select(row_of(docs).alias("doc"), F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))
    found = here.join(drops, F.col("key").eqNullSafe(F.col("of_key")) & (F.col("th") == F.col("of_th")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    return found.withColumn("doc", F.col("doc").withField(f"`{text}`", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept))).select("doc.*")


def op2_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its lines, how many of them are removed, and their positions."""
    docs = table(spark, sf_dir, "documents")
    drops = repeated_lines(docs).select(F.col("key").alias("_key"), F.col("th").alias("_th"), F.col("drop").alias("dropped"))
    whole = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(whole).alias("_here"), F.size(F.split(whole, "\n")).cast("long").alias("n_lines"))
    found = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("_key")) & (F.col("_here") == F.col("_th")), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return found.select("doc_id", "n_lines", F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped"))
