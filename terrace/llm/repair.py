"""Repair of conversations' structure at least cost, by a Viterbi search that emits edits as soon as all survivors agree on them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrace.llm.common import table

BLANKS = " \t\n\x0b\x0c\r"
MARKS = ".!?"
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: What the repaired roles end with: nothing yet, a system row, a user's, an assistant's. Complete are the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State and role that a row gets whose role is changed, or that is inserted.
NEXT = {START: (USER, "user"), SYSTEM: (USER, "user"), ASSISTANT: (USER, "user"), USER: (ASSISTANT, "assistant")}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LEGAL = {"su", "ua", "au"}
MOST = (1 << 63) - 1

#: Gets an edit's initial and the repaired row, (role, text), that it leaves, if any.
Sink = Callable[[str, tuple[str, str] | None], None]


class Node:
    """An edit on a path; ``refs`` counts the edits after it and the survivors that end here."""

    __slots__ = ("edit", "row", "up", "depth", "refs")

    def __init__(self, edit: str, row: tuple[str, str] | None, up: Node | None) -> None:
        self.edit, self.row, self.up, self.refs = edit, row, up, 0
        self.depth = up.depth + 1 if up else 0
        if up:
            up.refs += 1


@dataclass
class Survivor:
    """The cheapest path to a state. ``order`` tells it from the others: the place of the path up to its last row among those of all
    survivors, and what was done since then. That decides as a comparison of the whole paths behind their last common edit would."""

    cost: int
    order: tuple[int, str]
    node: Node


class Survivors:
    """The cheapest path to each state, as leaves of a tree of edits.

    Edits that all survivors share are given to ``sink`` and forgotten, so the tree is as deep as survivors disagree: a few edits
    mostly, a whole conversation where two repairs stay as good to its end, as with rows of users alone. States that can't be on a
    cheapest path any more are given up: from a last assistant row all that is possible from nothing costs 4 more at most (a system
    row is deleted), and all that is possible from a system row costs the same.
    """

    def __init__(self, sink: Sink) -> None:
        self.sink, self.root = sink, Node("", None, None)
        self.root.refs = 1
        self.at: dict[int, Survivor] = {START: Survivor(0, (0, ""), self.root)}
        self.deepest = 0
        self._insert()

    def _release(self, node: Node | None) -> None:
        while node is not None:
            node.refs -= 1
            if node.refs or node is self.root:
                return
            node = node.up

    @staticmethod
    def _new(cost: int, order: tuple[int, str], edit: str, row: tuple[str, str] | None, up: Node) -> Survivor:
        node = Node(edit, row, up)
        node.refs = 1
        return Survivor(cost, order, node)

    def _insert(self) -> None:
        """Inserted rows: a user's after all but a user's, then an assistant's after that."""
        for states in ((START, SYSTEM, ASSISTANT), (USER,)):
            for state in states:
                if (here := self.at.get(state)) is None:
                    continue
                to, role = NEXT[state]
                cost, order = here.cost + INSERT, (here.order[0], here.order[1] + "I")
                had = self.at.get(to)
                if had is None or (cost, order) < (had.cost, had.order):
                    self.at[to] = self._new(cost, order, "I", (role, ""), here.node)
                    if had is not None:
                        self._release(had.node)

    def step(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        """Take the next row."""
        found: dict[int, tuple] = {}
        more = TRUNCATED if truncated else 0

        def offer(to: int, here: Survivor, cost: int, edit: str, row: tuple[str, str] | None) -> None:
            new = (here.cost + cost, (here.order[0], here.order[1] + edit), edit, row, here.node)
            if to not in found or new[:2] < found[to][:2]:
                found[to] = new

        for state, here in self.at.items():
            offer(state, here, DELETE, "D", None)
            if must_go:
                continue
            to = KEPT.get((state, role[:1]))
            if to is not None:
                offer(to, here, more, "K", (role, text))
            to, other = NEXT[state]
            offer(to, here, REROLE + more, "R", (other, text))
        before, self.at = self.at, {}
        for place, (state, (cost, _, edit, row, up)) in enumerate(sorted(found.items(), key=lambda x: x[1][1])):
            self.at[state] = self._new(cost, (place, ""), edit, row, up)
        for here in before.values():
            self._release(here.node)
        self._insert()
        last = self.at[ASSISTANT].cost
        for state, slack in ((START, DELETE), (SYSTEM, 0)):
            if state in self.at and self.at[state].cost > last + slack:
                self._release(self.at.pop(state).node)
        self._settle()

    def _path(self, leaf: Node) -> list[Node]:
        path = []
        while leaf is not self.root:
            path.append(leaf)
            leaf = leaf.up
        return path

    def _settle(self) -> None:
        """Give away what all survivors share."""
        leaf = self.at[ASSISTANT].node
        self.deepest = max(self.deepest, leaf.depth - self.root.depth)
        if self.root.refs > 1:
            return
        path = self._path(leaf)
        while self.root.refs == 1 and len(path) > 1:
            self.root = path.pop()
            self.root.up = None
            self.sink(self.root.edit, self.root.row)
            self.root.row = None

    def finish(self) -> int:
        """Give away the rest of the cheapest complete path; its cost."""
        best = min((self.at[s] for s in (START, ASSISTANT) if s in self.at), key=lambda x: (x.cost, x.order))
        for node in reversed(self._path(best.node)):
            self.sink(node.edit, node.row)
        return best.cost


@dataclass
class Conversation:
    """Counts and repair of one conversation, row by row."""

    sink: Sink
    search: Survivors = field(init=False)
    low: int | None = None
    high: int | None = None
    turns: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    before: tuple | None = None

    def __post_init__(self) -> None:
        self.search = Survivors(self.sink)

    def take(self, turn: int | None, role: str, text: str, first: bool, blank: bool, cut: bool) -> None:
        """The next row by turn; ``first``: no earlier turn has its role and text."""
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        again = not first or self.before == (turn, role, text)  # equal rows of a turn are neighbours
        self.illegal += self.before is not None and self.before[1][:1] + role[:1] not in LEGAL
        self.before = (turn, role, text)
        if blank:
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif cut:
            self.truncated += 1
        self.search.step(role, text, blank or again, cut and not blank and not again)

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.turns, MOST)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone) with faults by CRC-32 of ``conv:turn`` modulo 20; null ids count as one space there, null roles and
    texts become one. Dropped rows stay, marked ``gone``, so that no conversation is lost."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.concat(space(conv), F.lit(":"), space(turn))), F.lit(20))
    told = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), fate.alias("fate"))
    return told.select(
        "conv", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", MARKS, "")).otherwise(F.col("text")).alias("text"),
        (F.col("fate") == 0).alias("gone"), F.explode(F.sequence(F.lit(1), F.when(F.col("fate") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def plain(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone) of rows as they are; null roles and texts become one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), space(role).alias("role"), space(text).alias("text"), F.lit(False).alias("gone"))


def ordered(rows: DataFrame) -> DataFrame:
    """Rows with their faults, each conversation in one partition, by turn (null first), then role and text.

    Whether an earlier turn has a row's role and text is found by a grouping of all rows by these, so no task keeps what a conversation
    has said. A conversation stays whole, as its digest can only be taken in order; it is streamed, not gathered.
    """
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    told = rows.withColumns({"said": F.sha2(F.col("text"), 256), "blank": bare == "", "cut": ~F.right(bare, F.lit(1)).isin(*MARKS)})
    firsts = told.where("not gone").groupBy("conv", "role", "said").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("f"))
    firsts = firsts.select(F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("said").alias("_s"), F.col("f.turn").alias("_t"))
    joined = told.join(firsts, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("said") == F.col("_s")), "left")
    found = joined.select("conv", "turn", "role", "text", "gone", F.col("turn").eqNullSafe(F.col("_t")).alias("first"), "blank", "cut")
    return found.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")


def each(batches: Iterator[pa.RecordBatch], sink_of: Callable[[object], Sink], done: Callable[[object, Conversation], None]) -> Iterator[pa.DataType]:
    """Feed the rows of a partition to their conversations; yields the type of their keys after each batch, and at the end."""
    open_: Conversation | None = None
    conv, kind = None, None
    for batch in batches:
        kind = batch.schema.field("conv").type
        for key, turn, role, text, gone, first, blank, cut in zip(*[c.to_pylist() for c in batch.columns]):
            if open_ is None or key != conv:
                if open_ is not None:
                    done(conv, open_)
                conv, open_ = key, Conversation(sink_of(key))
            if not gone:
                open_.take(turn, role, text, first, blank, cut)
        yield kind
    if open_ is not None:
        done(conv, open_)
        yield kind


FAULTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_digests(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation of :func:`plain` or
    :func:`damage` rows.

    ``audit`` has the initials of the cheapest edits, ASCII-least among equals, that leave role initials ``(s?(ua)+)?``. Conversations
    without rows have zeros, no edits and the digest of nothing; a null key is one conversation. Rows of the same turn are ordered by
    role and text; of rows repeated within a conversation all but the first are duplicates. Roles of other initials are changed or
    deleted. An empty table gives an empty result; other columns are ignored.
    """
    kind = rows.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state: dict[str, object] = {}

        def sink_of(_: object) -> Sink:
            audit, sha = [], hashlib.sha256()
            state.update(audit=audit, sha=sha, lines=0)

            def sink(edit: str, row: tuple[str, str] | None) -> None:
                audit.append(edit)
                if row:
                    sha.update(("\n" * (state["lines"] > 0) + f"{row[0]}:{row[1]}").encode())
                    state["lines"] += 1

            return sink

        def done(conv: object, c: Conversation) -> None:
            cost = c.search.finish()
            out.append((conv, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, cost, "".join(state["audit"]), state["sha"].hexdigest()))

        for key_type in each(batches, sink_of, done):
            if out:
                types = [key_type, *[pa.int64()] * len(FAULTS), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["conv", *FAULTS, "audit", "repaired_sha256"])
                out.clear()

    schema = T.StructType([T.StructField("conv", kind), *[T.StructField(c, T.LongType()) for c in FAULTS], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return ordered(rows).mapInArrow(run, schema).withColumnRenamed("conv", key)


def repaired_turns(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """The repaired conversations themselves: (key, turn, role, text), turns from 0, of :func:`plain` or :func:`damage` rows.

    Rows are sent on as soon as all survivors agree on them, batch by batch, whatever a conversation's length.
    """
    kind = rows.schema["conv"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def sink_of(conv: object) -> Sink:
            turn = 0

            def sink(edit: str, row: tuple[str, str] | None) -> None:
                nonlocal turn
                if row:
                    out.append((conv, turn, *row))
                    turn += 1

            return sink

        for key_type in each(batches, sink_of, lambda _, c: c.search.finish()):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (key_type, pa.int64(), pa.string(), pa.string()))], names=["conv", "turn", "role", "text"])
                out.clear()

    schema = T.StructType([T.StructField("conv", kind), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    return ordered(rows).mapInArrow(run, schema).withColumnRenamed("conv", key)


def op13_survivor_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation."""
    return repair_digests(damage(table(spark, sf_dir, "conversations")))


_CRC = "list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"


def _edit(state: str, cost: str, edit: str, line: str, where: str = "true") -> str:
    return f"CASE WHEN {state} IS NOT NULL AND ({where}) THEN {{'c': {state}.c + {cost}, 'p': {state}.p || '{edit}', 't': {state}.t || {line}}} END"


def _least(*found: str) -> str:
    return f"list_sort(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL))[1]"


def _kept(state: str, initial: str) -> str:
    return _edit(state, "more", "K", "chr(10) || role || ':' || text", f"NOT gone AND left(role, 1) = '{initial}'")


def _changed(state: str, role: str) -> str:
    return _edit(state, f"{REROLE} + more", "R", f"chr(10) || '{role}:' || text", "NOT gone")


_STEP = ", ".join([
    f"{_edit('s', str(DELETE), 'D', chr(39) * 2)} AS s1",
    f"{_least(_edit('y', str(DELETE), 'D', chr(39) * 2), _kept('s', 's'))} AS y1",
    f"{_least(_edit('u', str(DELETE), 'D', chr(39) * 2), *[f(x, r) for x in 'sya' for f, r in ((_kept, 'u'), (_changed, 'user'))])} AS u1",
    f"{_least(_edit('a', str(DELETE), 'D', chr(39) * 2), _kept('u', 'a'), _changed('u', 'assistant'))} AS a1",
])
_INSERT_U = _least("u1", *[_edit(x, str(INSERT), "I", "chr(10) || 'user:'") for x in ("s1", "y1", "a1")])
_INSERT_A = _least("a1", _edit("u2", str(INSERT), "I", "chr(10) || 'assistant:'"))

#: A row of the recursion for each row of a conversation, with the cheapest edits to each state.
ORACLE_OP13 = rf"""
WITH RECURSIVE fated AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({_CRC}, 4294967295) % 20 AS fate
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM fated WHERE fate <> 0),
told AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    NOT regexp_matches(text, '[^ 	-
]') AS blank, NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before FROM damaged),
rows_ AS MATERIALIZED (SELECT *, blank OR again AS gone, CASE WHEN cut AND NOT blank AND NOT again THEN {TRUNCATED} ELSE 0 END AS more FROM told),
search AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'p': '', 't': ''}} AS s, CAST(NULL AS STRUCT(c BIGINT, p VARCHAR, t VARCHAR)) AS y,
    {{'c': CAST({INSERT} AS BIGINT), 'p': 'I', 't': chr(10) || 'user:'}} AS u, {{'c': CAST({2 * INSERT} AS BIGINT), 'p': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS a
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, s1, y1, u2, {_INSERT_A} FROM (
    SELECT *, {_INSERT_U} AS u2 FROM (SELECT r.conv_id, r.i, {_STEP} FROM search p JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1))),
last AS (SELECT conv_id, {_least("s", "a")} AS best FROM search QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
    count(*) FILTER (more > 0) AS truncated, count(*) FILTER (before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM rows_ GROUP BY conv_id)
SELECT l.conv_id, {', '.join(f'CAST(coalesce({c}, 0) AS BIGINT) AS {c}' for c in FAULTS[:-1])}, CAST(best.c AS BIGINT) AS cost, best.p AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM last l LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM l.conv_id
"""
