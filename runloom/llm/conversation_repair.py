"""Operator 13: repair of the structure of conversations at least cost, with an audit of every edit.

A conversation is to read as one optional system turn and pairs of user and assistant. A dynamic
program runs backwards over its rows; its states are what the turn before was. The edits from a row
to the end are a chain of nodes, one letter each, that share their tails, with ancestors at powers of
two and hashes of the letters up to each; of edits that cost the same the ones whose letters come
first are found by the longest common prefix, and letters that hash alike are compared.

A conversation of any length is cut into blocks. Each block is solved on its own for every state
before and after it; then only four costs travel along a conversation's blocks, backwards to choose
and forwards to settle, and each block writes down its letters. Blocks can be put together that way
because no cheapest repair inserts a turn: leaving out the pair that the turn completes costs less
(at most two deletions and one of the system turn before it). So all cheapest audits of a block are
as long as the block, and which of two comes first does not hang on what follows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key, lru_cache
from hashlib import sha256
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runloom.llm.tables import saved

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
#: What a truncated row costs if it stays.
TRUNCATED_COST = 5
FAULTS = ("", "blank", "duplicate", "truncated")
INITIALS = ("", "s", "u", "a")
#: States: nothing yet, after a system turn, after a user's, after an assistant's. A repair may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
ENDS = (START, ASSISTANT)
#: The turn that must come next, except that a system turn may come first.
NEXT = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 40
#: Rows of a block.
BLOCK = 4096
WHITE = " \t\n\x0b\x0c\r"
BASE, MODULUS = 1_000_003, (1 << 61) - 1
_POWERS = [BASE]
for _ in range(40):
    _POWERS.append(_POWERS[-1] * _POWERS[-1] % MODULUS)


class Audits:
    """Edits as nodes: a letter and the node of the letters after it. Node 0 is the end."""

    def __init__(self) -> None:
        self.letter, self.up, self.hashes = [""], [[]], [[]]
        self.alike: dict[tuple[int, int, int], bool] = {}

    def node(self, letter: str, rest: int) -> int:
        """A letter before ``rest``; up[k] is the node 2 ** k letters on, hashes[k] that of the letters up to there."""
        up, hashes, at, code, k = [rest], [ord(letter)], rest, ord(letter), 0
        while len(self.up[at]) > k:
            code = (code * _POWERS[k] + self.hashes[at][k]) % MODULUS
            at = self.up[at][k]
            up.append(at)
            hashes.append(code)
            k += 1
        self.letter.append(letter)
        self.up.append(up)
        self.hashes.append(hashes)
        return len(self.up) - 1

    def same(self, a: int, b: int, k: int) -> bool:
        """Whether the 2 ** k letters from two nodes are the same. Hashes rule out, letters decide."""
        if a == b:
            return True
        if self.hashes[a][k] != self.hashes[b][k]:
            return False
        if k == 0:
            return self.letter[a] == self.letter[b]
        key = (a, b, k)
        if key not in self.alike:
            self.alike[key] = self.same(a, b, k - 1) and self.same(self.up[a][k - 1], self.up[b][k - 1], k - 1)
        return self.alike[key]

    def compare(self, a: int, b: int) -> int:
        """Below, at or above 0 as the letters from ``a`` come before, are, or come after those from ``b``."""
        for k in range(min(len(self.up[a]), len(self.up[b])) - 1, -1, -1):
            if a == b:
                return 0
            if k < min(len(self.up[a]), len(self.up[b])) and self.same(a, b, k):
                a, b = self.up[a][k], self.up[b][k]
        x, y = self.letter[a], self.letter[b]
        return (x > y) - (x < y)

    def text(self, a: int) -> str:
        out = []
        while a:
            out.append(self.letter[a])
            a = self.up[a][0]
        return "".join(out)


class Block:
    """The cheapest edits of some rows from every state before them to every state after them.

    ``codes`` has a byte a row: the place of its role's initial in INITIALS plus four times that of its fault in FAULTS.
    """

    def __init__(self, codes: bytes) -> None:
        self.audits = Audits()
        self.best = [self._solved(codes, end) for end in STATES]
        order = cmp_to_key(self.audits.compare)
        self.costs = [self.best[end][start][0] for start in STATES for end in STATES]
        self.ranks = []
        for start in STATES:
            first = sorted(STATES, key=lambda end: order(self.best[end][start][1]))
            self.ranks += [first.index(end) for end in STATES]

    def _solved(self, codes: bytes, end: int) -> list[tuple[int, int]]:
        """Cost and edits from each state to ``end``."""
        after = self._with_insertions([(0 if state == end else FAR, 0) for state in STATES])
        for code in reversed(codes):
            initial, fault = code & 3, FAULTS[code >> 2]
            now = []
            for state in STATES:
                options = [(COST[DELETE], DELETE, state)]
                if fault in ("", "truncated"):
                    stays, wanted = TRUNCATED_COST if fault else 0, NEXT[state]
                    options.append((COST[REROLE] + stays, REROLE, wanted))
                    if initial == wanted or state == START and initial == SYSTEM:
                        options.append((COST[KEEP] + stays, KEEP, initial))
                cost, letter, then = min((cost + after[then][0], letter, then) for cost, letter, then in options)  # letters of equal cost differ: the first decides
                now.append((cost, self.audits.node(letter, after[then][1]) if cost < FAR else 0))
            after = self._with_insertions(now)
        return after

    def _with_insertions(self, held: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The same where turns may be inserted before the next row."""
        changed = True
        while changed:
            changed = False
            for state in STATES:
                cost, rest = held[NEXT[state]][0] + COST[INSERT], held[NEXT[state]][1]
                if cost < held[state][0] or cost == held[state][0] < FAR and self._before(INSERT, rest, held[state][1]):
                    held[state], changed = (cost, self.audits.node(INSERT, rest)), True
        return held

    def _before(self, letter: str, rest: int, other: int) -> bool:
        return self.audits.compare(self.audits.node(letter, rest), other) < 0

    def letters(self, start: int, end: int) -> str:
        return self.audits.text(self.best[end][start][1])


@lru_cache(maxsize=4096)
def _short(codes: bytes) -> Block:
    return Block(codes)


def block(codes: bytes) -> Block:
    return _short(codes) if len(codes) <= 32 else Block(codes)


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with the faults that a hash of conversation and turn picks; missing values are one space, but for conv_id and turn themselves."""
    space, text = F.lit(" "), F.coalesce("text", F.lit(" "))
    pick = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    held = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), text.alias("text"), pick.alias("pick")).where("pick != 0")
    return held.select(
        "conv_id", "turn", F.when(F.col("pick") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("pick") == 1, "").when(F.col("pick") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("pick") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows with ``at``, their place: by conversation, turn (null first), role and text. Ranges of rows are dealt out, so a long conversation is many tasks; texts are ordered by their hash, and equal rows by where they came from."""
    held = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    held = held.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "_hash", "_row")]
    return held.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("at"))


def _coded(rows: DataFrame) -> DataFrame:
    """conv_id, at and code (role's initial and first fault) of ordered rows. A text is known by its SHA-256; the first of equal rows is found by an aggregate, so no task sees all rows of a text."""
    bare = F.rtrim("text", F.lit(WHITE))
    name = F.sha2(F.concat("role", F.lit(":"), "text"), 256)
    blank, truncated = bare == "", ~F.substring(bare, -1, 1).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0)
    held = rows.select("conv_id", "at", F.length("role").alias("_role"), name.alias("_name"), blank.alias("_blank"), truncated.alias("_cut"), place.alias("_initial"))
    first = held.groupBy("conv_id", "_role", "_name").agg(F.min("at").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    names = ("conv_id", "_role", "_name")
    keys = [F.col(f"h.{c}").eqNullSafe(F.col(f"f.{c}")) for c in names]
    fault = F.when(F.col("_blank"), 1).when(F.col("h.at") > F.col("_first"), 2).when(F.col("_cut"), 3).otherwise(0)
    joined = held.alias("h").join(first.alias("f"), keys[0] & keys[1] & keys[2], "left")
    return joined.select("h.conv_id", "h.at", (F.col("_initial") + 4 * fault).cast("int").alias("code"))


def _solve(size: int):
    """Ordered rows of codes as blocks with the costs and the order of their cheapest edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: Any = None
        codes, first, done = bytearray(), 0, []

        def made() -> tuple:
            solved = block(bytes(codes))
            return key, first, bytes(codes), solved.costs, solved.ranks

        for batch in batches:
            for conv, at, code in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "at", "code")), strict=True):
                if codes and (conv != key or at != first + len(codes) or len(codes) == size):
                    done.append(made())
                    codes = bytearray()
                if not codes:
                    key, first = conv, at
                codes.append(code)
            if done:
                yield _batch(done, batch.schema.field("conv_id"), [("at", pa.int64()), ("codes", pa.binary()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32()))])
                done = []
            kind = batch.schema.field("conv_id")
        if codes:
            yield _batch([made()], kind, [("at", pa.int64()), ("codes", pa.binary()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int32()))])

    return run


def _batch(rows: list[tuple], key: pa.Field, rest: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    fields = [pa.field("conv_id", key.type), *(pa.field(*x) for x in rest)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=pa.schema(fields))


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from the last to the first, with the state after each for every state before it."""
    key, then = object(), []
    for batch in batches:
        ends = []
        for conv, costs, ranks in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "costs", "ranks")), strict=True):
            if conv != key:
                key, then = conv, [0 if s in ENDS else FAR for s in STATES]
            best = [min((costs[4 * s + e] + then[e], ranks[4 * s + e], e) for e in STATES) for s in STATES]
            then = [min(cost, FAR) for cost, _, _ in best]
            ends.append([e for _, _, e in best])
        kept = [batch.column(c) for c in ("conv_id", "at", "codes")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(ends, pa.list_(pa.int32()))], ["conv_id", "at", "codes", "ends"])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation from the first to the last, with the states before and after each."""
    key, state = object(), START
    for batch in batches:
        before, after = [], []
        for conv, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ends")), strict=True):
            if conv != key:
                key, state = conv, START
            before.append(state)
            state = ends[state]
            after.append(state)
        kept = [batch.column(c) for c in ("conv_id", "at", "codes")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(before, pa.int32()), pa.array(after, pa.int32())], ["conv_id", "at", "codes", "before", "after"])


def _lettered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        letters = [block(codes).letters(a, b) for codes, a, b in zip(*(batch.column(c).to_pylist() for c in ("codes", "before", "after")), strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "at", "codes")), pa.array(letters, pa.string())], ["conv_id", "at", "codes", "letters"])


_TURN = "edit string, fault string, turn long, role string, text string, new_role string, cost long"


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, each before its rows, as turns with their edits. A row without edit stands for a conversation without rows."""
    kinds = [("place", pa.int64()), *((c, pa.string()) for c in ("edit", "fault")), ("turn", pa.int64()), *((c, pa.string()) for c in ("role", "text", "new_role")), ("cost", pa.int64())]
    key, state, place, letters, codes = object(), START, 0, iter(()), iter(())
    for batch in batches:
        out: list[tuple] = []
        names = ("conv_id", "kind", "turn", "role", "text", "codes", "letters")

        def inserted(conv: Any) -> str | None:
            """Writes down inserted turns; returns the edit of the next row."""
            nonlocal state, place
            for letter in letters:
                if letter != INSERT:
                    return letter
                state = NEXT[state]
                out.append((conv, place, INSERT, "", None, None, "", ROLES[state], COST[INSERT]))  # noqa: B023  used at once
                place += 1
            return None

        for conv, kind, turn, role, text, code, block_letters in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if kind == 0 or conv != key:
                inserted(key)
                key, state, place, letters, codes = conv, START, 0, iter(()), iter(())
            if kind == 0:
                out.append((conv, -1, None, None, None, None, None, None, 0))
            elif kind == 1:
                inserted(conv)
                letters, codes = iter(block_letters), iter(code)
            else:
                edit, fault = inserted(conv), FAULTS[next(codes) >> 2]
                cost, new = COST[edit], None
                if edit != DELETE:
                    cost += TRUNCATED_COST if fault == "truncated" else 0
                    state = NEXT[state] if edit == REROLE else INITIALS.index(role[:1])
                    new = ROLES[state] if edit == REROLE else role
                out.append((conv, place, edit, fault, turn, role, text, new, cost))
                place += 1
        if out:
            yield _batch(out, batch.schema.field("conv_id"), kinds)


def repaired_turns(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Every row of every conversation with its edit, in order within its partition, each conversation whole in one.

    ``rows``: conv_id, turn, role, text; ``conversations`` (conv_id) names further conversations that
    may have no rows. Columns: conv_id, place (from 0), edit (K, R, D, I), fault (blank, duplicate,
    truncated or empty), turn, role, text, new_role (null if deleted) and cost. Each conversation also
    has one row of place -1 without edit. Rows are taken by turn, null first, then by role and a hash
    of the text. Null roles and texts are one space; rows without conv_id are one conversation; a role
    that begins with none of s, u and a can only be changed or deleted. Further columns are not read.
    """
    key = rows.select("conv_id").schema["conv_id"]

    def kind(rest: str) -> StructType:
        return StructType([key, *StructType.fromDDL(rest).fields])

    ordered = saved(_ordered(rows))
    codes = _coded(ordered).repartitionByRange("at").sortWithinPartitions("at")
    blocks = codes.mapInArrow(_solve(BLOCK), kind("at long, codes binary, costs array<long>, ranks array<int>"))
    blocks = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("at")).mapInArrow(_chosen, kind("at long, codes binary, ends array<int>"))
    blocks = blocks.sortWithinPartitions("conv_id", "at").mapInArrow(_settled, kind("at long, codes binary, before int, after int"))
    blocks = blocks.repartition("at").mapInArrow(_lettered, kind("at long, codes binary, letters string"))  # letters of a long conversation's blocks come from many tasks
    every = rows.select("conv_id") if conversations is None else rows.select("conv_id").unionByName(conversations.select("conv_id"))

    def part(df: DataFrame, number: int) -> DataFrame:
        columns = {"kind": "int", "at": "long", "turn": "long", "role": "string", "text": "string", "codes": "binary", "letters": "string"}
        values: dict[str, Column] = {"kind": F.lit(number)} | ({"at": F.lit(-1)} if number == 0 else {})
        return df.select("conv_id", *(values.get(c, F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))

    parts = part(every.distinct(), 0).unionByName(part(blocks, 1)).unionByName(part(ordered, 2))
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "at", "kind").mapInArrow(_merged, kind("place long, " + _TURN))


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    kinds = [*((c, pa.int64()) for c in names), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    state: dict[str, Any] | None = None
    field = None

    def closed(s: dict[str, Any]) -> tuple:
        gaps = s["last"] - s["first"] + 1 - s["turns"] if s["turns"] else 0
        return s["conv"], gaps, *(s["faults"][f] for f in FAULTS[1:]), s["illegal"], s["cost"], "".join(s["audit"]), s["sha"].hexdigest()

    for batch in batches:
        field, done = batch.schema.field("conv_id"), []
        columns = ("conv_id", "place", "edit", "fault", "turn", "role", "text", "new_role", "cost")
        for conv, place, edit, fault, turn, role, text, new, cost in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if place == -1:
                if state:
                    done.append(closed(state))
                state = {"conv": conv, "first": None, "last": None, "turns": 0, "faults": dict.fromkeys(FAULTS, 0), "illegal": 0, "cost": 0, "audit": [], "sha": sha256(), "before": None, "some": False}
                continue
            state["audit"].append(edit)
            state["cost"] += cost
            if edit != INSERT:
                state["faults"][fault] += 1
                if turn is not None and turn != state["last"]:
                    state["first"] = turn if state["first"] is None else state["first"]
                    state["last"], state["turns"] = turn, state["turns"] + 1
                if state["before"] is not None and state["before"] + role[:1] not in ("su", "ua", "au"):
                    state["illegal"] += 1
                state["before"] = role[:1]
            if new is not None:
                state["sha"].update(("\n" if state["some"] else "").encode() + f"{new}:{text}".encode())
                state["some"] = True
        if done:
            yield _batch(done, field, kinds)
    if state:
        yield _batch([closed(state)], field, kinds)


def repair_report(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    As repaired_turns(), and read from its turns as they come: gaps are turn numbers left out between
    the first and the last, illegal counts neighbours whose roles may not meet, the hash is that of
    the repaired turns as role:text, joined by line ends. Without rows all is zero or empty. One task
    reads a conversation's turns in order, as the hash of them all demands, and keeps none but its audit.
    """
    turns = repaired_turns(rows, conversations)
    kind = StructType([turns.schema["conv_id"], *StructType.fromDDL("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string").fields])
    return turns.mapInArrow(_report, kind)
