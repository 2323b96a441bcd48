"""The registered queries against SQL and plain Python on the smallest tables, and the pipeline stage by stage."""

from __future__ import annotations

import os
import random
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import connection, rows_of_spark, rows_of_sql  # noqa: E402
from test_operators import DOCS, brute_components, brute_hits, filled, prose  # noqa: E402

import corpus_pipeline  # noqa: E402
from runloom.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402
from runloom.llm.tables import documents, saved  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_thirteen_queries():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    names, got = rows_of_spark(QUERIES[name](spark, SF))
    expected_names, expected = rows_of_sql(connection(SF), ORACLE_SQL[name])
    assert names == expected_names
    assert got == expected


def test_licenses_of_documents(spark):
    """In these documents a licence is a line of its own."""
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    texts = dict(documents(spark, SF).select("doc_id", "text").collect())
    got = {r["doc_id"]: r["licenses"] for r in QUERIES["op5_license_scan"](spark, SF).collect()}
    assert got == {d: ",".join(sorted({lines[x] for x in t.split("\n") if x in lines})) for d, t in texts.items()}


def test_pipeline(spark):
    docs = documents(spark, SF)
    labels = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect())
    texts = {r["doc_id"]: r for r in docs.collect()}
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append(docs.collect())
        assert all(texts[r["doc_id"]] == r for r in kept[-1])
    good, distinct, clean, mixed = kept
    assert sum((d in {r["doc_id"] for r in good}) == bool(q) for d, q in labels.items() if d in texts) >= 0.97 * sum(d in texts for d in labels)
    groups = brute_components([(r["doc_id"], r["text"]) for r in good], 5, 4, 5)
    assert {r["doc_id"] for r in distinct} == {d for d, (_, c) in groups.items() if d == c}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert {r["doc_id"] for r in clean} == {r[0] for r in brute_hits([(r["doc_id"], r["text"]) for r in distinct], items) if not r[5]}
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= 2
    sizes = {}
    for r in clean:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    total = Counter()
    for r in mixed:
        total[r["source"]] += len(r["text"].split())
    largest = max(len(r["text"].split()) for r in clean)
    assert all(abs(total[s] - t) <= largest + 0.02 * t for s, t in filled(sizes).items())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r["doc_id"] for r in last) == Counter(r["doc_id"] for r in mixed)
    assert sorted((r["slot"] * 8 + r["shard"]) for r in last) == list(range(len(last)))


def test_pipeline_of_nothing(spark):
    docs = documents(spark, SF).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SF))
    assert docs.count() == 0


def _documents(spark, rows):
    return saved(spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS))


def test_pipeline_with_null_and_repeated_ids(spark):
    rng = random.Random(3)
    a, b, c, d = (prose(rng, 80) for _ in range(4))
    rows = [(1, a), (1, a), (1, b), (2, a), (None, a), (None, c), (None, c), (None, d), (7, c + " more"), (8, ""), (8, ""), (9, ""), (None, None)]
    got = corpus_pipeline.distinct(spark, _documents(spark, [(*r, "a") for r in rows]), SF).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(1, a), (1, b), (None, d), (7, c + " more"), (8, ""), (9, ""), (None, None)])

    item = max((r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    rows = [(None, item), (None, a), (5, item), (5, b), (6, c), (6, c)]
    got = corpus_pipeline.uncontaminated(spark, _documents(spark, [(*r, "a") for r in rows]), SF).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(None, a), (5, b), (6, c), (6, c)])

    rows = [(rng.choice([None, 1, 2, 3]), prose(rng, rng.randrange(20, 120)), rng.choice("abc")) for _ in range(600)]
    got = corpus_pipeline.mixed(spark, _documents(spark, rows), SF).collect()
    sizes, total = Counter(), Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    for r in got:
        total[r["source"]] += len(r["text"].split())
    assert {r["doc_id"] for r in got} == {None, 1, 2, 3}
    assert all(abs(total[s] - t) <= 120 + 0.02 * t for s, t in filled(sizes).items())


def test_pipeline_passes_columns_of_any_name_through(spark):
    names = ("score", "predicted", "_stats", "_row", "row", "document", "component_id", "n_words", "taken", "size", "id", "key", "term")
    docs = saved(documents(spark, SF).withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in names}))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows
        assert all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in names)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(last.columns) == sorted([*docs.columns, "shard", "slot"])
    assert last.count() == docs.count()
