"""Operator 12 against whole texts encoded one by one, and its plan against what any packing needs."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from functools import cache
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from runloom.llm.packing import best_fit, encoder, exact_plan, pack_documents, packing_plan
from runloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@cache
def model() -> Tokenizer:
    return Tokenizer.from_file(PATH)


def encoded(text: str | None) -> list[int]:
    return [*model().encode(text or "", add_special_tokens=False).ids, 0]


def held(rows, documents, limit):
    """Checks every piece against its document's ids, and that sequences have no gaps; returns the number of sequences."""
    made, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        made[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    wanted = defaultdict(list)
    for doc_id, text in documents:
        ids = encoded(text)
        first = len(ids) % limit or min(limit, len(ids))
        starts = [0, *range(first, len(ids), limit)]
        for piece, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            assert b - a == limit or piece == 0
            wanted[doc_id].append((piece, a, b - a, crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert {k: sorted(v) for k, v in made.items()} == {k: sorted(v) for k, v in wanted.items()}
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= limit
    return len(sequences)


def test_query(spark):
    found = QUERIES["op12_packing"](spark, SF)
    assert found.columns == COLUMNS
    rows = found.collect()
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert held(rows, documents, 2048) <= 1.02 * -(-sum(r["length"] for r in rows) // 2048) + 1


ODD = [
    "", " ", "  ", "   a", " a", "a ", "a  b", "a   b", "a \n b", "a\n b", "a\n  b", "a   b", "a b", "　 x", "it's 12 o'clock, don't", "<|endoftext|> and <|endoftext|>x", "\x00 \x85 y", "éè ü ñ 漢字 😀 z",
    "x" * 5000, "a b " * 3000, "\t\ttab\r\n\r\nlines\v\f end", "﻿mark", None,
]


def test_encoder_is_the_tokenizer():
    rng = random.Random(7)
    texts = ODD + ["".join(rng.choice(["a", "the ", " ", "\n", "é", "'s", "12", " ", ".", "word"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for _ in range(2):  # with and without remembered parts
        assert [x.tolist() for x in encoder(PATH).encode(pa.array(texts, pa.large_string()))] == [encoded(t)[:-1] for t in texts]


def test_edges(spark):
    rows = [(i % 7 if i % 5 else None, t, "clash", 1) for i, t in enumerate(ODD * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string, length int").repartition(3)
    for limit in (7, 64):
        got = pack_documents(docs, limit=limit).collect()
        total = sum(len(encoded(r[1])) for r in rows)
        assert sum(r["length"] for r in got) == total
        assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(r[0] for r in rows)
        ends = defaultdict(list)
        for r in got:
            ends[r["sequence_id"]].append((r["offset"], r["length"]))
        assert all(sorted(x)[k + 1][0] == sorted(x)[k][0] + sorted(x)[k][1] for x in ends.values() for k in range(len(x) - 1))
    ids = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(ODD)], "doc_id string, text string")
    assert held(pack_documents(ids, limit=50).collect(), ids.collect(), 50)
    assert pack_documents(docs.where(F.lit(False))).collect() == []
    assert pack_documents(docs.where(F.lit(False))).columns == COLUMNS


def least(items: list[int], limit: int) -> int:
    """Fewest sequences, by trying all."""
    items = sorted(items, reverse=True)
    best = len(items)

    def place(k: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for gap in set(b for b in bins if b >= items[k]):
            i = bins.index(gap)
            place(k + 1, [*bins[:i], gap - items[k], *bins[i + 1 :]])
        place(k + 1, [*bins, limit - items[k]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(60))
def test_plan_holds_every_piece_once(seed):
    rng = random.Random(seed)
    limit = rng.choice([1, 2, 5, 12, 30])
    counts = Counter(rng.randint(1, limit) for _ in range(rng.randint(0, 11)))
    for plan in (packing_plan(counts, limit), exact_plan(counts, limit), best_fit(counts, limit)):
        used = Counter()
        for times, slots in plan:
            assert times > 0 and sum(length * each for length, each in slots) <= limit
            for length, each in slots:
                used[length] += times * each
        assert used == counts
    assert sum(n for n, _ in packing_plan(counts, limit)) <= least(list(counts.elements()), limit) + 1


def test_exact_fills_come_first():
    plan = exact_plan({97: 2, 3: 1, 1: 3, 50: 2, 30: 2, 19: 2}, 100)
    assert (1, [(97, 1), (3, 1)]) in plan and (1, [(97, 1), (1, 3)]) in plan and (1, [(50, 2)]) in plan


def test_plan_of_a_large_corpus_is_small():
    rng = random.Random(5)
    counts = {n: rng.randint(1, 10**9) for n in range(1, 2049)}
    plan = packing_plan(counts)
    assert len(plan) < 10_000
    assert sum(n for n, _ in plan) <= 1.02 * max(sum(k * v for k, v in counts.items()) / 2048, sum(v for k, v in counts.items() if k > 1024))
