"""Language-model scores by class-based n-grams: exchange clustering assigns words to classes, class transitions and word emissions
give the probability of a text.

Words are UTF-8 bytes with A-Z lower-cased, cut at ASCII blanks; every text ends with a token of its own. Counts of all training
words are kept in a table; the most frequent, a bounded number, are also known to every task, and the others are joined.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm.common import parts, scratch, stored, table

#: Words that every task knows with their counts, and those of them that are clustered, at most. Others are joined, and their class is their shape.
KNOWN = 1 << 17
CLUSTERED = 1 << 14
CLASSES = 64
#: Rounds of exchanges at most.
EXCHANGES = 10
#: Longer words go by their digest, with a blank before it, which no word has.
LONGEST = 64
#: What is added to every count of a word.
ADDED = 0.1
#: Bins of counts for each factor of two, by which the most frequent words are told without sorting all.
BINS = 16
SHAPES = 20
#: The text's end among the words of the table.
END = b""
#: Distinct words or pairs that a task gathers before it sends them on.
HELD = 400_000


def name_of(word: bytes) -> bytes:
    return word if len(word) <= LONGEST else b" " + hashlib.sha256(word).digest()


def shape_of(word: bytes) -> int:
    """A class of words by their last byte and length."""
    last = word[-1]
    kind = 0 if 97 <= last <= 122 else 1 if last in b",;:" else 2 if last in b".!?" else 3 if 48 <= last <= 57 else 4
    return 4 * kind + min(len(word) // 4, 3)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, tasks send Python at most so many rows at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    had = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, had)


def held_out(key: Column) -> Column:
    """Whether a document is kept from learning; a null id is an empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(10)) == 0


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, shape, c) of all tokens of ``text``; the end has no shape. Tasks count before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        ends = 0

        def told() -> pa.RecordBatch:
            words = [END, *seen]
            shapes = [None, *map(shape_of, seen)]
            return pa.RecordBatch.from_arrays([pa.array(list(map(name_of, words)), pa.binary()), pa.array(shapes, pa.int32()), pa.array([ends, *seen.values()], pa.int64())], names=["word", "shape", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
                ends += 1
                if len(seen) > HELD:
                    yield told()
                    seen.clear()
                    ends = 0
        if ends:
            yield told()

    return texts.mapInArrow(count, "word binary, shape int, n long").groupBy("word", "shape").agg(F.sum("n").alias("c"))


def most_frequent(counts: DataFrame, most: int) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words and their counts, at most ``most``, by falling count and then bytes. Counts are binned, so no task sorts all
    words; a bin is taken whole or not at all."""
    rank = F.floor(F.log2(F.col("c").cast("double")) * BINS)
    able = counts.where((F.octet_length("word") > 0) & (F.octet_length("word") <= LONGEST))
    total, least = 0, None
    for row in able.groupBy(rank.alias("r")).count().orderBy(F.desc("r")).collect():
        total += row["count"]
        if total > most:
            break
        least = row["r"]
    if least is None:
        return [], np.zeros(0, np.int64)
    found = able.where(rank >= least).select("word", "c").toArrow()
    rows = sorted(zip(found["c"].to_pylist(), found["word"].to_pylist()), key=lambda x: (-x[0], x[1]))
    return [w for _, w in rows], np.array([c for c, _ in rows], np.int64)


@dataclass
class Words:
    """The words that every task knows, by falling count: their numbers come first, then that of the end, then those of shapes."""

    words: list[bytes]
    clustered: int

    @property
    def end(self) -> int:
        return len(self.words)

    def units(self) -> np.ndarray:
        """For each number the unit that it is counted as: a clustered word, the end, or a shape."""
        k, m = len(self.words), self.clustered
        shapes = [m + 1 + shape_of(w) for w in self.words[m:]]
        return np.array([*range(m), *shapes, m, *range(m + 1, m + 1 + SHAPES)], np.int64).reshape(k + 1 + SHAPES)


def encoded(docs: DataFrame, words: Words) -> DataFrame:
    """Adds to (row, key, held_out, text): ids, the numbers of the text's tokens, and rare, its other words with shape and number."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # KNOWN words of LONGEST bytes at most

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        index, end = {w: i for i, w in enumerate(known.words)}, known.end
        for batch in batches:
            ids, at, names, shapes, times = [], [0], [], [], []
            for text in batch.column("text").to_pylist():
                found = words_of(text)
                got = np.fromiter((index.get(w, -1) for w in found), np.int32, len(found))
                odd = np.flatnonzero(got < 0)
                if odd.size:
                    others = [found[i] for i in odd.tolist()]
                    got[odd] = [end + 1 + shape_of(w) for w in others]
                    for w, n in Counter(others).items():
                        names.append(name_of(w))
                        shapes.append(shape_of(w))
                        times.append(n)
                ids.append(np.append(got, np.int32(end)).astype("<i4").tobytes())
                at.append(len(names))
            rare = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(shapes, pa.int32()), pa.array(times, pa.int64())], ["word", "shape", "n"])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "key", "held_out")], pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), rare)], names=["row", "key", "held_out", "ids", "rare"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(encode, f"row long, key {kind}, held_out boolean, ids binary, rare array<struct<word:binary,shape:int,n:long>>")


def sequences(batch: pa.RecordBatch, lut: np.ndarray, end: int, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of all texts of a batch through a table, ``before`` ends set before each; where they start; and their own numbers."""
    texts = [np.frombuffer(x, "<i4") for x in batch.column("ids").to_pylist()]
    lead = np.full(before, end, np.int32)
    flat = np.concatenate([y for x in texts for y in (lead, x)]) if texts else np.zeros(0, np.int32)
    sizes = np.array([before + len(x) for x in texts], np.int64)
    return lut[flat], np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]) + before if len(texts) else [], sizes).astype(np.int64), flat


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(place, np.concatenate(counts)).astype(np.int64)


def neighbours(codes: DataFrame, words: Words) -> DataFrame:
    """(unit, side, other, n): for each unit the units that follow (side 0) and precede it (side 1), a list each with numbers of times.

    A unit's lists are no longer than there are units, whatever the input. Pairs are counted in tasks, then by all three, so that
    no frequent word gathers more than its lists.
    """
    units = words.units()
    m, end = words.clustered + 1 + SHAPES, words.end

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def told() -> Iterator[pa.RecordBatch]:
            k, n = summed(keys, counts)
            yield pa.RecordBatch.from_arrays([pa.array((k // m).astype(np.int32)), pa.array((k % m).astype(np.int32)), pa.array(n)], names=["u", "v", "n"])

        for batch in batches:
            seq, start, _ = sequences(batch, units, end, 1)
            here = np.flatnonzero(np.arange(seq.size) >= start)
            k, n = np.unique(seq[here - 1] * m + seq[here], return_counts=True)
            keys.append(k)
            counts.append(n)
            held += k.size
            if held > 8 * HELD:
                merged = summed(keys, counts)
                keys, counts, held = [merged[0]], [merged[1]], merged[0].size
                if held > 4 * HELD:
                    yield from told()
                    keys, counts, held = [], [], 0
        if keys:
            yield from told()

    found = codes.select("ids").mapInArrow(pairs, "u int, v int, n long").groupBy("u", "v").agg(F.sum("n").alias("n"))
    both = F.explode(F.array(F.struct(F.col("u").alias("unit"), F.lit(0).alias("side"), F.col("v").alias("other")), F.struct(F.col("v").alias("unit"), F.lit(1).alias("side"), F.col("u").alias("other"))))
    sides = found.select(both.alias("x"), "n").select("x.*", "n").repartition(parts(codes.sparkSession), "unit")
    lists = sides.groupBy("unit", "side").agg(F.collect_list(F.struct("other", "n")).alias("l"))
    return lists.select("unit", "side", F.col("l.other").alias("other"), F.col("l.n").alias("n")).groupBy("unit").agg(
        *[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}{s}") for s in (0, 1) for c in ("other", "n")]
    )


def by_class(column: pa.Array, counts: pa.Array, classes: np.ndarray, total: int) -> np.ndarray:
    """For each row of a list column of units how often each class is among them; a null list counts as empty."""
    offsets, n = column.offsets.to_numpy(), len(column)
    other = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    times = counts.values.to_numpy(zero_copy_only=False)[counts.offsets[0].as_py() : counts.offsets[-1].as_py()]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    return np.bincount(owner * total + classes[other], times, n * total).reshape(n, total)


def _g(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def gains(r: np.ndarray, l: np.ndarray, own: np.ndarray, at: np.ndarray, table_: np.ndarray, targets: int) -> np.ndarray:
    """What the log likelihood of class pairs gains when a word, taken out of its class, is put into each of the first ``targets`` classes.

    r, l: how often each class follows and precedes each word; own: how often a word follows itself; at: its class; table_: pairs of
    classes. Exact for one move at a time.
    """
    n, total = r.shape
    rows = np.arange(n)
    r, l = r.copy(), l.copy()
    r[rows, at] -= own
    l[rows, at] -= own
    # rows and columns of the table as they are without the word: only its own class differs
    row = np.repeat(table_[None, :targets, :], n, axis=0)
    col = np.repeat(table_.T[None, :targets, :], n, axis=0)
    row[rows, :, at] -= l[:, :targets]
    col[rows, :, at] -= r[:, :targets]
    inside = np.flatnonzero(at < targets)
    row[inside, at[inside]] = table_[at[inside]] - r[inside]
    col[inside, at[inside]] = table_.T[at[inside]] - l[inside]
    row[inside, at[inside], at[inside]] = col[inside, at[inside], at[inside]] = table_[at[inside], at[inside]] - (r + l)[inside, at[inside]] - own[inside]
    # pairs with the word count for the classes of its neighbours wherever it is
    out_sum, in_sum = row.sum(axis=2) + l[:, :targets], col.sum(axis=2) + r[:, :targets]
    gain = (_g(row + r[:, None, :]) - _g(row)).sum(axis=2) + (_g(col + l[:, None, :]) - _g(col)).sum(axis=2)
    k = np.arange(targets)
    cell, add_r, add_l = row[:, k, k], r[:, :targets], l[:, :targets]
    gain -= _g(cell + add_r) - _g(cell) + _g(cell + add_l) - _g(cell)
    gain += _g(cell + add_r + add_l + own[:, None]) - _g(cell)
    gain -= _g(out_sum + r.sum(axis=1)[:, None] + own[:, None]) - _g(out_sum) + _g(in_sum + l.sum(axis=1)[:, None] + own[:, None]) - _g(in_sum)
    return gain


def likelihood(pairs: np.ndarray) -> float:
    return float(_g(pairs).sum() - _g(pairs.sum(axis=0)).sum() - _g(pairs.sum(axis=1)).sum())


def exchange(lists: DataFrame, clustered: int, classes: int = CLASSES, rounds: int = EXCHANGES) -> tuple[np.ndarray, list[float]]:
    """The class of each unit, and the log likelihood of class pairs before each round. Classes after the first ``classes``: the end's, those of
    shapes, and one of the words that wait for the first round.

    The most frequent words start in classes of their own. In each round tasks find the best class of each word by :func:`gains`
    against the same table; in the first all others move, later only half of the words, by turns, as moves made at once may spoil each
    other. The best classes of all rounds are returned. The driver holds the classes of the units and the table of class pairs.
    """
    total = classes + 2 + SHAPES
    at = np.concatenate([np.minimum(np.arange(clustered), classes), classes + np.arange(1 + SHAPES)]).astype(np.int64)
    at[classes:clustered] = total - 1

    def pairs(at: np.ndarray) -> np.ndarray:
        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((total, total))
            for b in batches:
                np.add.at(sums, at[b.column("unit").to_numpy()], by_class(b.column("other0"), b.column("n0"), at, total))
            u, v = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int32)), pa.array(v.astype(np.int32)), pa.array(sums[u, v].astype(np.int64))], names=["u", "v", "n"])

        out = np.zeros((total, total))
        for u, v, n in lists.mapInArrow(tally, "u int, v int, n long").groupBy("u", "v").agg(F.sum("n").alias("n")).collect():  # total ** 2 at most
            out[u, v] = n
        return out

    def moves(at: np.ndarray, table_: np.ndarray, turn: int) -> list[tuple[int, int]]:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                unit = b.column("unit").to_numpy().astype(np.int64)
                mine = (unit < clustered) & (at[unit] == total - 1 if turn == 0 else (unit * 2654435761 >> 7) % 2 == turn % 2)
                if not mine.any():
                    continue
                b = b.filter(pa.array(mine))
                unit = unit[mine]
                r, l = (by_class(b.column(f"other{s}"), b.column(f"n{s}"), at, total) for s in (0, 1))
                own = loops(b, unit)
                got = gains(r, l, own, at[unit], table_, classes)
                best = got.argmax(axis=1)
                had = np.where(at[unit] < classes, got[np.arange(unit.size), np.minimum(at[unit], classes - 1)], -np.inf)
                won = got[np.arange(unit.size), best] > had + 1e-6
                yield pa.RecordBatch.from_arrays([pa.array(unit[won].astype(np.int32)), pa.array(best[won].astype(np.int32))], names=["unit", "to"])

        return [tuple(x) for x in lists.mapInArrow(find, "unit int, to int").collect()]  # a row for each clustered word at most

    seen, best = [], (-np.inf, at)
    for turn in range(rounds + 1):
        now = pairs(at)
        seen.append(likelihood(now))
        if turn > 0 and seen[-1] > best[0]:
            best = (seen[-1], at)
        if turn == rounds or turn > 2 and seen[-1] - seen[-3] < 1e-4 * abs(seen[-1] - seen[1]):
            break
        made = moves(at, now, turn)
        at = at.copy()
        if made:
            unit, to = np.array(made).T
            at[unit] = to
        elif turn:
            break
    return best[1], seen


def loops(batch: pa.RecordBatch, unit: np.ndarray) -> np.ndarray:
    """How often each unit follows itself."""
    column, counts = batch.column("other0"), batch.column("n0")
    offsets = column.offsets.to_numpy()
    other = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    times = counts.values.to_numpy(zero_copy_only=False)[counts.offsets[0].as_py() : counts.offsets[-1].as_py()]
    owner = np.repeat(np.arange(len(column)), np.diff(offsets))
    return np.bincount(owner, np.where(other == unit[owner], times, 0), len(column))


def triples(codes: DataFrame, lut: np.ndarray, end: int, total: int) -> np.ndarray:
    """How often each class follows each two classes; ``total`` ** 3 numbers, whatever the input."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(total**3, np.int64)
        for batch in batches:
            seq, start, _ = sequences(batch, lut, end, 2)
            here = np.flatnonzero(np.arange(seq.size) >= start)
            sums += np.bincount((seq[here - 2] * total + seq[here - 1]) * total + seq[here], minlength=total**3)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["at", "n"])

    found = codes.select("ids").mapInArrow(tally, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(total**3)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(total, total, total)


def transitions(counts: np.ndarray, able: np.ndarray) -> np.ndarray:
    """P(class | two classes before), each order smoothed with the one below by the number of classes seen after the context.

    ``able``: classes that may come though they weren't seen. The sum over all classes is 1.
    """
    one, two = counts.sum(axis=(0, 1)), counts.sum(axis=0)
    p = np.where((one > 0) | able, one + ADDED, 0.0)
    p /= p.sum()
    for n in (two, counts):
        kinds = np.maximum((n > 0).sum(axis=-1, keepdims=True), 1)
        p = (n + kinds * p) / (n.sum(axis=-1, keepdims=True) + kinds)
    return p


@dataclass
class BrownModel:
    """log10 of transitions by three classes, of emissions and of the base by the tokens' numbers; the rest is what rare words need."""

    words: Words
    lut: np.ndarray
    steps: np.ndarray
    emits: np.ndarray
    base: np.ndarray
    tokens: int
    base_mass: float
    shape_mass: list[float]

    @staticmethod
    def of(words: Words, counts: np.ndarray, ends: int, tokens: int, distinct: int, shapes: dict[int, tuple[int, int]], at: np.ndarray, triple: np.ndarray) -> BrownModel:
        """``shapes``: for each shape the tokens and the distinct words of training that aren't clustered."""
        k, m, total = len(words.words), words.clustered, triple.shape[0]
        lut = at[words.units()]
        sizes = np.bincount(at[:m], counts[:m], total)
        shape_mass = [shapes.get(s, (0, 0))[0] + ADDED * (shapes.get(s, (0, 0))[1] + 1) for s in range(SHAPES)]
        emits, base_mass = np.zeros(k + 1 + SHAPES), tokens + ADDED * (distinct + 1)
        emits[:m] = np.log10(counts[:m] / sizes[at[:m]])
        emits[m:k] = np.log10((counts[m:] + ADDED) / np.array(shape_mass)[[shape_of(w) for w in words.words[m:]]])
        base = np.concatenate([np.log10((counts + ADDED) / base_mass), [np.log10((ends + ADDED) / base_mass)], np.zeros(SHAPES)])
        able = np.zeros(total, bool)
        able[at[m:]] = True
        with np.errstate(divide="ignore"):  # classes without words never come
            steps = np.log10(transitions(triple, able))
        return BrownModel(words, lut, steps, emits, base, tokens, base_mass, shape_mass)


def learn(codes: DataFrame, counts: DataFrame, words: Words, frequent: np.ndarray, classes: int = CLASSES, rounds: int = EXCHANGES) -> BrownModel:
    """The model of encoded training texts and the counts of their words."""
    spark = codes.sparkSession
    total = classes + 2 + SHAPES
    whole = {r["shape"]: (r["c"], r["v"]) for r in counts.groupBy("shape").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    ends, tokens, distinct = whole.get(None, (0, 0))[0], sum(c for c, _ in whole.values()), sum(v for _, v in whole.values())
    shapes = {s: list(x) for s, x in whole.items() if s is not None}
    for w, c in zip(words.words[: words.clustered], frequent.tolist()):
        shapes[shape_of(w)][0] -= c
        shapes[shape_of(w)][1] -= 1
    lists = stored(neighbours(codes, words), "neighbours")
    with batches_of(spark, 64):  # the lists are long
        at, _ = exchange(lists, words.clustered, classes, rounds)
    triple = triples(codes, at[words.units()], words.end, total)
    return BrownModel.of(words, frequent, ends, tokens, distinct, {s: tuple(x) for s, x in shapes.items()}, at, triple)


def scored(codes: DataFrame, counts: DataFrame, model: BrownModel) -> DataFrame:
    """(row, key, held_out, n_tokens, n_known, train_tokens, base_score, score) of encoded texts.

    Tasks sum what they know; rare words are joined with the counts of all, and their sums added by row.
    """
    shared = codes.sparkSession.sparkContext.broadcast(model)  # bounded by KNOWN and the number of classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known = np.concatenate([np.ones(m.words.end, np.int64), [int(m.tokens > 0)], np.zeros(SHAPES, np.int64)])
        for batch in batches:
            seq, start, ids = sequences(batch, m.lut, m.words.end, 2)
            here = np.arange(seq.size) >= start
            at = np.flatnonzero(here)
            owner = np.searchsorted(np.unique(start), at, "right") - 1
            n = batch.num_rows
            add = lambda values: np.bincount(owner, values, n)
            score = add(m.steps[seq[at - 2], seq[at - 1], seq[at]] + m.emits[ids[at]])
            arrays = [add(np.ones(at.size)).astype(np.int64), add(known[ids[at]]).astype(np.int64), add(m.base[ids[at]]), score]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "key", "held_out")], *map(pa.array, arrays)], names=["row", "key", "held_out", "n_tokens", "n", "b", "s"])

    kind = codes.schema["key"].dataType.simpleString()
    own = codes.select("row", "key", "held_out", "ids").mapInArrow(run, f"row long, key {kind}, held_out boolean, n_tokens long, n long, b double, s double")
    rare = codes.select("row", F.explode("rare").alias("x")).select("row", "x.*").join(counts.select("word", "c"), "word", "left")
    c = F.coalesce("c", F.lit(0)) + F.lit(ADDED)
    mass = F.get(F.array(*[F.lit(float(x)) for x in model.shape_mass]), F.col("shape"))
    more = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_n"),
        F.sum(F.col("n") * F.log10(c / F.lit(float(model.base_mass)))).alias("more_b"),
        F.sum(F.col("n") * F.log10(c / mass)).alias("more_s"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return own.join(more, "row", "left").select(
        "row", "key", "held_out", "n_tokens", plus("n", "more_n").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        plus("b", "more_b").alias("base_score"), plus("s", "more_s").alias("score"),
    )


def class_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", known: int = KNOWN, clustered: int = CLUSTERED, classes: int = CLASSES, rounds: int = EXCHANGES) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Learns from the documents that aren't held out. ``score`` is the log10 probability of the whole text, its end included, by
    classes of the two tokens before: P(class | two classes) P(word | class). Words that aren't clustered have a class by shape, in
    which each has the mass of its count and ADDED, and so has the unknown. Null and empty texts are an end alone. Rows that repeat
    count each; without training documents there is no known word and the base is 0. Other columns are ignored.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep, batches_of(spark, 2000):
        rows = docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"), F.col(text).cast("binary").alias("text"))
        counts = stored(word_counts(rows.where("not held_out").select("text")), "word-counts")
        frequent, times = most_frequent(counts, known)
        words = Words(frequent, min(clustered, len(frequent)))
        codes = stored(encoded(rows.select(F.monotonically_increasing_id().alias("row"), "*"), words), "codes", compression="zstd")
        model = learn(codes.where("not held_out"), counts, words, times, classes, rounds)
        found = keep(stored(scored(codes, counts, model), "class-scores"))
    return found.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_brown_class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document by a class-based model of those that aren't held out."""
    return class_scores(table(spark, sf_dir, "documents"))
