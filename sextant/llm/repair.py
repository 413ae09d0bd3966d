"""Conversation repair: the cheapest edits that make turns alternate.

A row is kept (cost 0), given the role user or assistant (2) or deleted (3); empty
turns of user or assistant are inserted (2). Blank rows and duplicates must be deleted; a
truncated row that is not costs 1 more. The roles' initials then read ``s?(ua)+``,
or nothing is left.

The search is Viterbi's over four states: at the start, after the system's turn, the
user's, the assistant's. Of the ways to a state the cheapest survives, of equal
ones that whose edits come first in ASCII. Survivors are leaves of a tree of
backpointers with reference counts: a branch that no survivor refers to is freed, and
the edits up to the last ancestor that all survivors share are final. They are
emitted at once, so a task holds only the rows that are still undecided.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import in_order, positioned
from .common import new_folder, small_or_shuffled, stage, temporary

#: Rows from which a conversation is divided among tasks, and rows of a piece of it.
LONG, PIECE = 200_000, 50_000
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The next role after a state, and its name.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Initials that a kept turn may have; all others are alike.
LETTERS = tuple({initial for _, initial in KEPT})
#: Inserts that end a conversation in each state.
ENDS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: What going on from one state costs more than from another at most: by inserts before,
#: or at the end, or by deleting the system's turn that only the start can keep.
EXTRA = {
    START: {SYSTEM: 0, USER: 2, ASSISTANT: 0}, SYSTEM: {START: 4, USER: 2, ASSISTANT: 4},
    USER: {START: 5, SYSTEM: 2, ASSISTANT: 2}, ASSISTANT: {START: 3, SYSTEM: 0, USER: 2},
}
SPACE = " \t\n\x0b\x0c\r"
FAR = 1 << 60


@lru_cache(maxsize=None)
def moves(initial: str, must: bool, truncated: bool) -> list[list[tuple[int, int, str]]]:
    """For each state the states after one more row: each with its cost and first cheapest edits."""
    found: list[list[tuple[int, int, str]]] = []
    for state in STATES:
        best: dict[int, tuple[int, str]] = {}
        here, inserts = state, ""
        for _ in range(3):  # more than two inserts come back to a state
            ways = [(here, 3, "D")]
            if not must:
                ways.append((NEXT[here], 2 + truncated, "R"))
                if (here, initial) in KEPT:
                    ways.append((KEPT[here, initial], int(truncated), "K"))
            for to, cost, edit in ways:
                best[to] = min(best.get(to, (FAR, "")), (cost + 2 * len(inserts), inserts + edit))
            here, inserts = NEXT[here], inserts + "I"
        found.append([(to, cost, edits) for to, (cost, edits) in best.items()])
    return found


class _Node:
    """The edits of one row, after those of its parent; ``refs`` counts children and survivors."""

    __slots__ = ("edits", "kids", "parent", "refs")

    def __init__(self, parent: _Node | None, edits: str):
        self.parent, self.edits, self.kids, self.refs = parent, edits, [], 0


class Survivors:
    """The search over one conversation, or a piece of it that is entered in ``state``.

    ``push`` takes a row and returns the edits, row by row, that are final now;
    ``finish`` the rest. Rows of survivors are as many, so none's edits are the
    beginning of another's: where the undecided edits of two differ first stays,
    and the order of these complete suffixes is kept as a rank instead of being read
    again. A state that can no longer win, whatever follows, is given up: else the
    way that deletes everything would survive for ever.
    """

    def __init__(self, state: int = START):
        self.root = _Node(None, "")
        self.root.refs = 1
        self.alive: dict[int, tuple[int, int, _Node]] = {state: (0, 0, self.root)}  # cost, rank, leaf

    def push(self, initial: str, must: bool, truncated: bool) -> list[str]:
        step = moves(initial if initial in LETTERS else "", must, truncated)
        best: dict[int, tuple[int, int, str, _Node]] = {}
        for state, (cost, rank, leaf) in self.alive.items():
            for to, more, edits in step[state]:
                way = (cost + more, rank, edits, leaf)
                if to not in best or way[:3] < best[to][:3]:
                    best[to] = way
        before = self.alive
        self.alive = {}
        able = [(to, way) for to, way in best.items() if not any(way[0] > other[0] + EXTRA[at][to] for at, other in best.items() if at != to)]
        for rank, (to, (cost, _, edits, leaf)) in enumerate(sorted(able, key=lambda x: x[1][1:3])):
            node = _Node(leaf, edits)
            node.refs = 1
            leaf.kids.append(node)
            leaf.refs += 1
            self.alive[to] = (cost, rank, node)
        for _, _, leaf in before.values():
            self._release(leaf)
        return self._final()

    def finish(self, ends: dict[int, int] | None = None) -> tuple[int, int, list[str]]:
        """The state that the whole search ends in, its cost, and the edits left.

        ``ends`` has what each state costs after this piece; without it, the
        conversation ends here, and the last edits include its closing inserts."""
        rest = ends or {state: 2 * len(inserts) for state, inserts in ENDS.items()}
        state = min((s for s in self.alive if rest[s] < FAR), key=lambda s: (self.alive[s][0] + rest[s], self.alive[s][1]))
        cost, _, leaf = self.alive[state]
        edits: list[str] = [] if ends else [ENDS[state]] if ENDS[state] else []
        while leaf is not self.root:
            edits.append(leaf.edits)
            leaf = leaf.parent
        return state, cost + (0 if ends else rest[state]), edits[::-1]

    def _release(self, node: _Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            node.parent.kids.remove(node)
            node = node.parent
            node.refs -= 1

    def _final(self) -> list[str]:
        found = []
        while len(self.root.kids) == 1 and self.root.refs == 1:
            self.root = self.root.kids[0]
            self.root.parent = None
            found.append(self.root.edits)
        return found


class _Conversation:
    """One conversation as its rows come, in order: faults, edits and repaired turns.

    With ``known`` the edits were decided before and come as a text, a piece at a time."""

    def __init__(self, key: object, wanted: bool, known: bool):
        self.key, self.wanted, self.known = key, wanted, ""
        self.search = None if known else Survivors()
        self.seen: set[bytes] = set()
        self.rows: deque[tuple[str, str, bool]] = deque()
        self.state, self.place, self.cost = START, 0, 0
        self.initial = self.first_turn = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.digest, self.begun = hashlib.sha256(), False
        self.audit: list[str] = []
        self.out: list[tuple] = []

    def push(self, turn: int | None, role: str, text: str, blank: bool, truncated: bool, duplicate: bool | None) -> None:
        if duplicate is None:
            code = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            duplicate = code in self.seen
            self.seen.add(code)
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1
        self.illegal += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        must = blank or duplicate
        truncated = truncated and not must
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + (duplicate and not blank), self.truncated + truncated
        self.rows.append((role, text, truncated))
        if self.search:
            for edits in self.search.push(self.initial, must, truncated):
                self._apply(edits)
        else:
            at = len(self.known) - len(self.known.lstrip("I")) + 1
            self._apply(self.known[:at])
            self.known = self.known[at:]

    def _apply(self, edits: str) -> None:
        self.audit.append(edits)
        for edit in edits:
            role, text, truncated = ("", "", False) if edit == "I" else self.rows.popleft()
            if edit == "D":
                self.cost += 3
            else:
                self.state = KEPT[self.state, role[:1]] if edit == "K" else NEXT[self.state]
                role = role if edit == "K" else NAMES[self.state]
                self.cost += truncated + (0 if edit == "K" else 2)
                self.digest.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
                self.begun = True
            if self.wanted:
                self.out.append((self.key, self.place, edit, role, text))
                self.place += 1

    def close(self) -> None:
        """After the last row; the summary joins ``out`` if the edits are not wanted."""
        for edits in self.search.finish()[2] if self.search else [self.known]:
            self._apply(edits)
        if not self.wanted:
            gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
            self.out.append((self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()))


FIELDS = ["conv_id", "turn", "role", "text", "blank", "truncated", "duplicate", "lost", "edits"]
EDITS = {"place": "long", "edit": "string", "role": "string", "text": "string"}
SUMMARY = {**dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), "long"), "audit": "string", "repaired_sha256": "string"}


def _walked(rows: DataFrame, wanted: bool) -> DataFrame:
    """Sorted rows of whole conversations, one after the other, as edits (``wanted``) or one row each."""
    columns = EDITS if wanted else SUMMARY
    plain = {"long": pa.int64(), "string": pa.string()}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Conversation | None = None
        schema = None

        def said(out: list[tuple]) -> pa.RecordBatch:
            parts = zip(*out, strict=True) if out else [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(parts, schema.types, strict=True)], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), *((c, plain[kind]) for c, kind in columns.items())])
            out: list[tuple] = []
            for key, turn, role, text, blank, truncated, duplicate, lost, edits in zip(*(batch.column(c).to_pylist() for c in FIELDS), strict=True):
                if current is None or key != current.key:
                    if current:
                        current.close()
                        out += current.out
                    current = _Conversation(key, wanted, edits is not None)
                if edits is not None:
                    current.known += edits
                elif not lost:
                    current.push(turn, role, text, blank, truncated, duplicate)
            if current:
                out, current.out = out + current.out, []
            yield said(out)
        if current:
            current.close()
            yield said(current.out)

    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.select(*FIELDS).mapInArrow(walk, ", ".join([f"conv_id {kind}", *(f"{c} {k}" for c, k in columns.items())]))


@lru_cache(maxsize=None)
def _steps(initial: str, must: bool, truncated: bool) -> np.ndarray:
    found = np.full((4, 4), FAR)
    for state, ways in enumerate(moves(initial, must, truncated)):
        for to, cost, _ in ways:
            found[state, to] = cost
    return found


def _shortest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), FAR)


def _flags(group: pa.Table) -> Iterator[tuple[str, bool, bool]]:
    group = group.sort_by("_pos")
    for initial, blank, truncated, duplicate in zip(*(group[c].to_pylist() for c in ("initial", "blank", "truncated", "duplicate")), strict=True):
        yield initial, blank or duplicate, truncated and not (blank or duplicate)


def _pieces(rows: DataFrame) -> DataFrame:
    """Edits ``conv_id, piece, edits`` of long conversations, whose pieces are searched apart.

    Each piece tells the cheapest cost from every state to every other; these, a
    row a piece, are added up from the end, so a piece knows what each state costs
    after it. Then a piece is searched from each state, and the first piece,
    entered at the start, settles in which state the next is entered."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    key = ("conv_id", "piece")
    narrow = rows.select(*key, "_pos", F.substring("role", 1, 1).alias("initial"), "blank", "truncated", "duplicate")

    def crossed(group: pa.Table) -> pa.Table:
        costs = np.where(np.eye(4, dtype=bool), 0, FAR)
        for flags in _flags(group):
            initial, must, truncated = flags
            costs = _shortest(costs, _steps(initial if initial in LETTERS else "", must, truncated))
        return group.slice(0, 1).select(key).append_column("costs", pa.array([costs.ravel().tolist()], pa.list_(pa.int64())))

    def added(group: pa.Table) -> pa.Table:
        group = group.sort_by("piece")
        after, rests = np.array([2 * len(ENDS[s]) for s in STATES]), []
        for costs in reversed(group["costs"].to_pylist()):
            rests.append(after.tolist())
            after = _shortest(np.array(costs).reshape(4, 4), after[:, None])[:, 0]
        return group.select(key).append_column("rests", pa.array(rests[::-1], pa.list_(pa.int64())))

    def searched(group: pa.Table, rest: pa.Table) -> pa.Table:
        rests, flags = dict(enumerate(rest["rests"][0].as_py())), list(_flags(group))
        exits, texts = [], []
        for state in STATES:
            search, edits = Survivors(state), []
            for row in flags:
                edits += search.push(*row)
            exit_state, _, left = search.finish(rests)
            exits.append(exit_state)
            texts.append("".join(edits + left))
        return rest.select(key).append_column("exits", pa.array([exits], pa.list_(pa.int64()))).append_column("edits", pa.array([texts], pa.list_(pa.string())))

    def entered(group: pa.Table) -> pa.Table:
        group = group.sort_by("piece")
        state, states, ends = START, [], []
        for exits in group["exits"].to_pylist():
            states.append(state)
            state = exits[state]
            ends.append("")
        ends[-1] = ENDS[state]
        return group.select(key).append_column("state", pa.array(states, pa.int64())).append_column("end", pa.array(ends, pa.string()))

    costs, _ = stage(narrow.groupBy(*key).applyInArrow(crossed, f"conv_id {kind}, piece long, costs array<long>"), "repair-costs")
    rests, _ = stage(costs.groupBy("conv_id").applyInArrow(added, f"conv_id {kind}, piece long, rests array<long>"), "repair-rests")
    found = narrow.groupBy(*key).cogroup(rests.groupBy(*key)).applyInArrow(searched, f"conv_id {kind}, piece long, exits array<long>, edits array<string>")
    found, _ = stage(found, "repair-found")
    states = found.select(*key, "exits").groupBy("conv_id").applyInArrow(entered, f"conv_id {kind}, piece long, state long, end string")
    states, _ = stage(states.select(F.col("conv_id").alias("c"), F.col("piece").alias("p"), "state", "end"), "repair-states")
    on = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p"))
    return found.join(small_or_shuffled(states), on).select(*key, F.concat(F.get("edits", F.col("state").cast("int")), "end").alias("edits"))


def _prepared(rows: DataFrame, lost: Column | None) -> DataFrame:
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    stripped = F.btrim(F.col("text"), F.lit(SPACE))
    named = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"), (F.lit(False) if lost is None else lost).alias("lost"))
    named = named.withColumns({"blank": stripped == "", "truncated": (stripped != "") & ~F.right(stripped, F.lit(1)).isin(".", "!", "?")})
    return named.withColumns({"duplicate": F.lit(None).cast("boolean"), "edits": F.lit(None).cast("string")})


def _repaired(rows: DataFrame, lost: Column | None, wanted: bool, long: int, piece: int) -> DataFrame:
    rows = _prepared(rows, lost)
    spark = rows.sparkSession
    counts = rows.where("NOT lost").groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > long)
    many, _ = stage(counts.select(F.col("conv_id").alias("c")), "repair-long")
    on = F.col("conv_id").eqNullSafe(F.col("c"))
    if many.isEmpty():
        return _walked(rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"), wanted)
    few = rows.join(small_or_shuffled(many), on, "left_anti")
    found_at = new_folder(spark, "repair-rows")
    with temporary(spark):
        there = rows.where("NOT lost").join(small_or_shuffled(many), on, "left_semi").withColumn("u", F.monotonically_increasing_id())
        placed = positioned(in_order(there, ["conv_id", "turn", "role", "text", "u"]), ["conv_id"]).drop("duplicate")
        placed = placed.withColumns({"piece": F.floor(F.col("_pos") / piece).cast("long"), "code": F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256)})
        firsts, _ = stage(placed.groupBy("conv_id", "code").agg(F.min("_pos").alias("first")).select(F.col("conv_id").alias("c"), F.col("code").alias("x"), "first"), "repair-firsts")
        told = placed.join(small_or_shuffled(firsts), on & (F.col("code") == F.col("x"))).withColumn("duplicate", F.col("_pos") > F.col("first"))
        told, _ = stage(told.select(*FIELDS, "_pos", "piece"), "repair-told")
        decided = _pieces(told).select("conv_id", "edits", (F.col("piece") * piece).alias("_pos"))
        # the digest of a conversation goes on from turn to turn, so its rows pass through one task, none of them held
        told.select(*FIELDS, "_pos").unionByName(decided, allowMissingColumns=True).write.option("compression", "zstd").parquet(found_at)
    both = spark.read.schema(told.select(*FIELDS, "_pos").schema).parquet(found_at)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "_pos", F.col("edits").asc_nulls_last())
    return _walked(few.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"), wanted).unionByName(_walked(both, wanted))


def repaired_turns(conversations: DataFrame, lost: Column | None = None, long: int = LONG, piece: int = PIECE) -> DataFrame:
    """``conv_id, place, edit, role, text``: every edit in order, as K, R, D or I.

    ``role`` and ``text`` are those of the repaired turn; of a deleted row, its own.
    See ``repair_summary`` for what rows there may be."""
    return _repaired(conversations, lost, True, long, piece)


def repair_summary(conversations: DataFrame, lost: Column | None = None, long: int = LONG, piece: int = PIECE) -> DataFrame:
    """One row for each ``conv_id``: ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``conversations`` has ``conv_id, turn, role, text``; other columns, whatever their
    names, are not looked at. Rows for which ``lost`` holds are not there, but their
    conversations are reported. Null roles and texts are one space, so faulty;
    a null ``conv_id`` is a conversation; null turns come first, equal turns by role
    and text. Repeated rows are duplicates but for the first. A role without
    a letter is never kept. Texts of any length are hashed whole. ``audit`` joins
    the edits' initials, ``repaired_sha256`` digests lines ``role:text``. Duplicates
    are told by 128 bits of a digest. An empty table gives an empty result.

    Conversations of more than ``long`` rows are searched in pieces of ``piece`` rows
    by many tasks, with the same result.
    """
    return _repaired(conversations, lost, False, long, piece)


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` with seeded faults, and ``lost`` for rows that are to go: by crc32 of
    ``conv_id:turn`` modulo 20, 0 loses a row, 1 empties its text, 2 takes its ``.!?``, 3
    repeats it, 4 makes it the user's. Nulls are one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(told("conv_id"), F.lit(":"), told("turn")), "UTF-8")) % 20
    text = F.when(kind <= 1, F.lit("")).when(kind == 2, F.translate(told("text"), ".!?", "")).otherwise(told("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return conversations.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(told("role")).alias("role"), text.alias("text"), (kind == 0).alias("lost"), copies.alias("copy")).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations``, damaged and repaired: one row each."""
    return repair_summary(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")), F.col("lost"))


def _moves_sql() -> str:
    """Every way from state to state over one row: its cost, edits, the initial it needs, whether it deletes."""
    rows = []
    for state in STATES:
        here = state
        for inserts in ("", "I", "II"):
            ways = [(here, 3, "D", ""), (NEXT[here], 2, "R", "")] + [(to, 0, "K", initial) for (at, initial), to in KEPT.items() if at == here]
            rows += [f"({state}, {to}, {cost + 2 * len(inserts)}, '{inserts}{edit}', '{need}', {edit == 'D'})" for to, cost, edit, need in ways]
            here = NEXT[here]
    return ", ".join(rows)


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP11_SQL = f"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind
  FROM conversations, crc_table),
r AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM d, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) c(copy) WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text)) AS n, trim(text, {_SPACES}) AS s FROM r),
p AS (SELECT *, s = '' AS blank, s <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM o),
f AS (SELECT *, blank OR again AS must, NOT blank AND NOT again AND right(s, 1) NOT IN ('.', '!', '?') AS cut FROM p),
facts AS (
  SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, list({{'r': role, 't': text}} ORDER BY n) AS turns FROM f GROUP BY conv_id),
moves(src, dst, cost, edits, need, del) AS (VALUES {_moves_sql()}),
w AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS n, 0 AS state, {{'c': 0, 'a': ''}} AS best FROM conversations
  UNION ALL
  SELECT w.conv_id, f.n, m.dst, min({{'c': w.best.c + m.cost + CASE WHEN m.del THEN 0 ELSE f.cut::INT END, 'a': w.best.a || m.edits}})
  FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.n + 1 JOIN moves m ON m.src = w.state AND (m.del OR (NOT f.must AND (m.need = '' OR m.need = f.i)))
  GROUP BY w.conv_id, f.n, m.dst),
ends(state, inserts) AS (VALUES {", ".join(f"({state}, '{inserts}')" for state, inserts in ENDS.items())}),
best AS (
  SELECT w.conv_id, min({{'c': best.c + 2 * length(inserts), 'a': best.a || inserts}}) AS b FROM w JOIN ends USING (state) LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM w.conv_id
  WHERE w.n = coalesce(facts.rows, 0) GROUP BY w.conv_id),
told AS (
  SELECT best.conv_id, b, facts.* EXCLUDE (conv_id), list_reduce(
    list_prepend({{'e': '', 'k': 0::BIGINT, 'prev': '', 'out': ''}}, list_transform(list_filter(string_split(b.a, ''), lambda e: e <> ''), lambda e: {{'e': e, 'k': 0::BIGINT, 'prev': '', 'out': ''}})),
    lambda a, x: {{'e': x.e, 'k': a.k + CASE x.e WHEN 'I' THEN 0 ELSE 1 END,
      'prev': CASE x.e WHEN 'D' THEN a.prev WHEN 'K' THEN turns[a.k + 1].r ELSE CASE WHEN left(a.prev, 1) = 'u' THEN 'assistant' ELSE 'user' END END,
      'out': CASE x.e WHEN 'D' THEN a.out ELSE a.out || CASE a.prev WHEN '' THEN '' ELSE chr(10) END
        || CASE x.e WHEN 'K' THEN turns[a.k + 1].r ELSE CASE WHEN left(a.prev, 1) = 'u' THEN 'assistant' ELSE 'user' END END || ':' || CASE x.e WHEN 'I' THEN '' ELSE turns[a.k + 1].t END END}}) AS made
  FROM best LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM best.conv_id)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       b.c::BIGINT AS cost, b.a AS audit, sha256(made.out) AS repaired_sha256 FROM told
"""
