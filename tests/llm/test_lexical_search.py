"""Operator 11 against scores of every pair, computed one by one."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from runloom.llm import lexical_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans(search.UPPER, search.LOWER)


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    held = [(i, Counter(terms(x))) for i, x in docs if terms(x)]
    n_docs, words = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, r, None if none else doc_id, -low) for r, (low, none, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def corpus(seed, n_docs, n_items, n_words=120):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" if i % 3 else f"ü{i}É" for i in range(n_words)]

    def text(most):
        return rng.choice([" ", "-", "\n", "…", "_"]).join(rng.choice(vocabulary[: rng.choice([5, 30, n_words])]) for _ in range(rng.randint(0, most)))

    docs = [(rng.choice([i, i, None]), text(60)) for i in range(n_docs)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(5000, None), (5001, ""), (5002, "zzz " * 20_000 + "W1"), (5003, docs[7][1]), (5003, docs[7][1])]
    rng.shuffle(docs)
    items = [(rng.choice([i, i, None, 0]), text(20)) for i in range(n_items)] + [(900, None), (901, "..."), (902, "w1 W1 w1 unheard")]
    return docs, items


def ranked(found):
    return sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_all_pairs(spark, monkeypatch, seed):
    for name, value in (("BLOCK_ITEMS", 11), ("LEAF", 4), ("FAN", 3), ("ITEM_FAN", 2), ("CELLS", 2000), ("SEED", 5)):
        monkeypatch.setattr(search, name, value)
    docs, items = corpus(seed, 150, 25)
    d = spark.createDataFrame([(i, x, "clash", 1) for i, x in docs], "doc_id long, text string, item string, score int").repartition(3)
    q = spark.createDataFrame([(i, x, "clash") for i, x in items], "item_id long, text string, row string").repartition(2)
    found = search.lexical_search(d, q, 6)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked(found) == brute(docs, items, 6)


def test_words_that_are_joined(spark, monkeypatch):
    """A vocabulary too long to send gives the same."""
    docs, items = corpus(9, 60, 9)
    monkeypatch.setattr(search, "SENT_ROWS", 3)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert ranked(search.lexical_search(d, spark.createDataFrame(items, "item_id long, text string"), 10)) == brute(docs, items, 10)


def test_heavy_items_are_summed_in_whole_numbers():
    block = search.Items([(0, {1: 1 << 40, 2: 1 << 40}), (1, {2: 5})])
    assert block.kind is np.int64
    assert search.Items([(0, {1: 7})]).kind is np.float64


def test_empty_tables(spark):
    docs, items = corpus(2, 10, 3)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    none = F.lit(False)
    for got in (search.lexical_search(d.where(none), q), search.lexical_search(d, q.where(none)), search.lexical_search(d.where("text is null"), q)):
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert got.collect() == []


def test_whole_batches_are_pruned(monkeypatch):
    """Documents that share no heavy term with an item are not scored one by one."""
    import pyarrow as pa

    rng = random.Random(1)
    items = [(i, {i * 3: 9000, i * 3 + 1: 8000, 999: 3}) for i in range(60)]
    rows = []
    for row in range(6000):
        own = row % 60 if row < 3000 else None
        rows.append((row, row, 100, [999] + ([own * 3, own * 3 + 1] if own is not None else []), [rng.randint(1, 4)] + ([1 + row % 5] * 2 if own is not None else [])))
    columns = [pa.array(c) for c in zip(*rows, strict=True)]
    batch = pa.RecordBatch.from_arrays([columns[0], columns[1], columns[2], columns[3], columns[4]], ["row", "doc_id", "n", "terms", "tfs"])
    block = search.Items(items)
    scored = 0
    add = search.np.argwhere

    def counting(mask):
        nonlocal scored
        scored += mask.size
        return add(mask)

    monkeypatch.setattr(search.np, "argwhere", counting)
    (out,) = search._search(block, np.zeros(60), 10, 6000, 600_000)(iter([batch]))
    assert out.num_rows == 600
    assert scored < 0.3 * 6000 * 60
    least = {}
    for item, score in zip(out.column("item").to_pylist(), out.column("score").to_pylist(), strict=True):
        least[item] = min(score, least.get(item, score))
    scored = 0
    (again,) = search._search(block, np.array([least[n] for n in block.numbers]), 10, 6000, 600_000)(iter([batch]))
    assert again.equals(out)
    assert scored < 0.03 * 6000 * 60
