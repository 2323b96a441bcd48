"""Operator 13 against an exhaustive search over all edits, in blocks of any size, and its query against SQL."""

from __future__ import annotations

import itertools
import random
import re
import sys
import zlib
from functools import cache
from hashlib import sha256
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from runloom.llm import conversation_repair as repair

WHITE = re.compile(r"[^\x20\x09-\x0D]")


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        marks = WHITE.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """All edits of the rows, with up to two insertions, tried one by one: the least (cost, audit), and its turns."""
    faults, best = faults_of(rows), None
    slots = [*range(len(rows) + 1)]
    for inserted in itertools.chain([()], itertools.combinations_with_replacement(slots, 1), itertools.combinations_with_replacement(slots, 2)):
        choices = []
        for i in range(len(rows) + 1):
            choices += [["Iu", "Ia"]] * inserted.count(i)
            if i < len(rows):
                choices.append(["D"] if faults[i] in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"])
        for edits in itertools.product(*choices):
            left, cost, turns = list(range(len(rows))), 0, []
            for e in edits:
                if e[0] == "I":
                    turns.append(({"u": "user", "a": "assistant"}[e[1]], ""))
                    cost += 5
                    continue
                i = left.pop(0)
                cost += {"K": 0, "R": 1, "D": 2}[e[0]]
                if e != "D":
                    cost += 5 * (faults[i] == "truncated")
                    turns.append((rows[i][0] if e == "K" else {"u": "user", "a": "assistant"}[e[1]], rows[i][1]))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)):
                found = (cost, "".join(e[0] for e in edits), turns)
                best = found if best is None or found[:2] < best[:2] else best
    return best


def expected(turned):
    """What the report says of rows (turn, role, text) of one conversation."""
    rows = [(r, x) for _, r, x in turned]
    turns = [t for t, _, _ in turned if t is not None]
    cost, audit, kept = fast(tuple(rows))
    faults, initials = faults_of(rows), [r[:1] for r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit, sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest(),
    )


def fast(rows):
    """The same as cheapest() for any number of rows, written as a plain forward search over whole strings without insertions."""
    faults, held = faults_of(rows), {"": (0, "", [])}
    for (role, text), fault in zip(rows, faults, strict=True):
        now = {}
        for s, (cost, audit, kept) in held.items():
            wanted = "a" if s == "u" else "u"
            options = [(s, 2, "D", kept)]
            if fault in ("", "truncated"):
                stays = 5 * (fault == "truncated")
                options.append((wanted, 1 + stays, "R", [*kept, ({"u": "user", "a": "assistant"}[wanted], text)]))
                if role[:1] == wanted or s == "" and role[:1] == "s":
                    options.append((role[:1], stays, "K", [*kept, (role, text)]))
            for to, more, letter, turns in options:
                found = (cost + more, audit + letter, turns)
                if to not in now or found[:2] < now[to][:2]:
                    now[to] = found
        held = now
    return min((held[s] for s in ("", "a") if s in held), key=lambda x: x[:2])


def some_rows(rng, n):
    roles = ["user", "assistant", "system", "tool", "", "user", "assistant"]
    texts = ["Yes.", "No!", "so", " ", "", "Why?\n", "a. b", "Fine.  "]
    return [(rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randint(0, 99)}.") for _ in range(n)]


@pytest.mark.parametrize("seed", range(40))
def test_search_agrees_with_all_edits(seed):
    rng = random.Random(seed)
    rows = some_rows(rng, rng.randint(0, 4))
    assert fast(rows)[:2] == cheapest(rows)[:2]
    assert fast(rows)[2] == cheapest(rows)[2]


def codes_of(rows):
    return bytes({"s": 1, "u": 2, "a": 3}.get(r[:1], 0) + 4 * repair.FAULTS.index(f) for (r, _), f in zip(rows, faults_of(rows), strict=True))


def through_blocks(codes, size):
    blocks = [repair.Block(codes[i : i + size]) for i in range(0, len(codes), size)]
    then, chosen = [0 if s in repair.ENDS else repair.FAR for s in repair.STATES], []
    for b in reversed(blocks):
        best = [min((b.costs[4 * s + e] + then[e], b.ranks[4 * s + e], e) for e in repair.STATES) for s in repair.STATES]
        then = [x[0] for x in best]
        chosen.append([x[2] for x in best])
    state, audit = 0, ""
    for b, ends in zip(blocks, reversed(chosen), strict=True):
        audit, state = audit + b.letters(state, ends[state]), ends[state]
    return then[0], audit


@pytest.mark.parametrize("seed", range(60))
def test_blocks_of_any_size(seed):
    rng = random.Random(seed)
    rows = some_rows(rng, rng.randint(1, 60))
    wanted = fast(rows)[:2]
    for size in (1, 2, 3, 7, 100):
        assert through_blocks(codes_of(rows), size) == wanted


def test_long_ties():
    """Rows of one role: which of them go is a tie all along."""
    for roles in (["user"] * 301, ["assistant"] * 300, ["user", "user", "assistant"] * 100):
        rows = [(r, f"t{i}.") for i, r in enumerate(roles)]
        assert through_blocks(codes_of(rows), 1000) == fast(rows)[:2] == through_blocks(codes_of(rows), 64)


def test_hashes_that_collide(monkeypatch):
    """All hashes alike: letters decide."""
    monkeypatch.setattr(repair, "MODULUS", 1)
    rows = some_rows(random.Random(3), 80)
    assert through_blocks(codes_of(rows), 100) == fast(rows)[:2]


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_report(spark, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 5)
    rng = random.Random(11)
    made, wanted = [], {}
    for conv in [*range(30), None]:
        turned = [(turn if rng.random() < 0.9 else None, r, x) for turn, (r, x) in zip(sorted(rng.sample(range(60), 24)), some_rows(rng, 24), strict=True)]
        turned = [(None, r, x) for t, r, x in turned if t is None][:1] + [x for x in turned if x[0] is not None]
        wanted[conv] = expected([(t, r, x) for t, r, x in turned])
        made += [(conv, t, r, x, "clash", 1) for t, r, x in turned]
    rng.shuffle(made)
    rows = spark.createDataFrame(made, "conv_id long, turn long, role string, text string, edit string, place int").repartition(5)
    more = spark.createDataFrame([(99,), (99,), (3,)], "conv_id long")
    report = repair.repair_report(rows, more)
    assert report.columns == COLUMNS
    got = {r["conv_id"]: tuple(r)[1:] for r in report.collect()}
    wanted[99] = (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
    assert got == wanted
    turns = repair.repaired_turns(rows, more).collect()
    assert sorted(r["place"] for r in turns if r["conv_id"] == 7) == list(range(-1, sum(1 for x in made if x[0] == 7)))
    assert sum(r["cost"] for r in turns if r["conv_id"] == 7) == wanted[7][5]
    assert all((r["new_role"] is None) == (r["edit"] in (None, "D")) for r in turns)
    assert repair.repair_report(rows.where(F.lit(False))).collect() == []


def test_one_long_conversation(spark):
    """A conversation of many blocks and long texts, repeated rows among them."""
    rng = random.Random(5)
    turned = [(i // 3, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"long {'x' * 3000} {i}."])) for i in range(9000)]
    turned.sort(key=lambda r: (r[0], r[1]))
    rows = spark.createDataFrame([(1, *x) for x in turned], "conv_id long, turn long, role string, text string").repartition(6)
    got = repair.repair_report(rows).collect()
    assert len(got) == 1
    # rows that share turn and role may come in either order, so only what does not hang on it is compared
    assert len(got[0]["audit"]) == 9000
    assert got[0]["duplicate"] == 9000 - len({x[1:] for x in turned})


def broken(conv, turn, role, text):
    """The faults of one row, by zlib."""
    pick = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    if pick == 0:
        return []
    text = "" if pick == 1 else re.sub("[.!?]", "", text) if pick == 2 else text
    return [(conv, turn, "user" if pick == 4 else role, text)] * (2 if pick == 3 else 1)


def test_damage(spark):
    rows = [(c, t, r, x) for c in [None, *range(40)] for t in [None, 0, 1, 2] for r, x in [(None, "a.b"), ("user", None), ("assistant", "Hi! ?")]]
    got = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((y for x in rows for y in broken(*x)), key=repr)


@cache
def conversations():
    import duckdb

    return duckdb.connect().execute("SELECT conv_id, turn, role, text FROM '/root/testdata/sf0.01/conversations.parquet'").fetchall()


def test_query_by_plain_python(spark):
    from runloom.llm.queries import QUERIES

    wanted = {conv: [] for conv, *_ in conversations()}
    for row in sorted(conversations(), key=lambda r: (r[0], r[1])):
        for conv, *rest in broken(*row):
            wanted[conv].append(tuple(rest))
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {conv: expected(rows) for conv, rows in wanted.items()}
