"""Operators against plain Python, and their edge cases."""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import math
import random
import time
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runloom.llm import chat_format as chat
from runloom.llm import decontaminate as decontaminate_module
from runloom.llm import license_scan as license_scan_module
from runloom.llm import line_dedup, linking, mixing, ngram_jaccard, quality_classifier, quality_rules, sharding, tables, warc
from runloom.llm.components import components
from runloom.llm.decontaminate import anchors, build_index, decontaminate, exact_matches, proximity_matches, windows, words_of
from runloom.llm.license_scan import SENTENCES, _pieces, known_sentences, license_scan
from runloom.llm.tables import saved

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "su", "ta", "vo", "re") for b in ("ra", "di", "po", "lu", "sen", "tik")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (".\n" if rng.random() < 0.05 else "") for _ in range(n))


def edited(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def rows():
    """Prose, groups of exact and near copies, nulls, empty, very long and repeated rows."""
    rng, out = random.Random(7), []
    bases = [prose(rng, n) for n in (3, 8, 20, 60, 150, 400, 401, 900)]
    for base in bases:
        out += [base, base] + [edited(rng, base, s) for s in (0.01, 0.02, 0.03, 0.05, 0.1)]
    hub = prose(rng, 120)
    out += [edited(rng, hub, 0.015) for _ in range(60)]
    out += [prose(rng, rng.randrange(1, 300)) for _ in range(60)]
    out += [None, "", " \n\t", "one", "ONE", "one two", prose(rng, 30_000), "é" * 50 + " ñ", "!!! *** \n\n !!!"]
    rng.shuffle(out)
    table = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None]), len(t or "")) for i, t in enumerate(out)]
    return [*table, table[0], table[0], (None, hub, None, None, 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """The rows, with more columns whose names the operators use themselves."""
    extra = {c: F.lit(1) for c in ("score", "size", "key", "id", "n", "shard", "slot", "keys", "term", "pos", "words", "taken", "row_number")}
    return saved(spark.createDataFrame(rows, DOCS).withColumns(extra))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


# 1


def test_escapes_are_undone():
    rng, bits = random.Random(1), ["<", "[", "\\", "/", "s>", "INST]", "/INST]", "|image|>", "ROLE]", " ", "</s>", "[SYS]", "a"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        held = chat.escape(text)
        assert chat.unescape(held) == text
        assert not any(c.strip() in held for m in (*chat.MARKS.values(), chat.OTHER) for c in m)
        assert not any(p in held for p in chat.PLACEHOLDERS.values())


def test_chat_round_trip(spark):
    rng, bits, table = random.Random(2), ["</s>", "[INST]", " [/INST]", "\\", "é", "\n", "ok"], []
    for conv in [*range(30), None]:
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", "tool\n\\x", "", None])
            table.append((conv, rng.choice([turn, None]), role, rng.choice([None, "".join(rng.choice(bits) for _ in range(6))]), 1))
    table += table[:3]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string, formatted int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    key = lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for conv in {r[0] for r in table}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in table if r[0] == conv), key=key)]
        learned = "".join(t for role, t in turns if role == "assistant")
        r = got.pop(conv)
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert not got
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_parts(spark):
    part = lambda kind, **x: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | x
    parts = [part("text", text="see [IN"), part("text", text="ST] here"), part("image", ref="a.png", width=56, height=57), part("audio", ref="b.wav", seconds=1.5), part("text", text="<|image|>"), None, part("document", ref="c.pdf", pages=2), part("strange", text="!")]
    df = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(df).first()
    assert list(chat.read_turns(r["formatted"])) == [("assistant", "see [INST] here<|image|>!"), ("user", "")]
    assert [(a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "a.png", 6), ("audio", "b.wav", 38), ("document", "c.pdf", 1024)]
    assert all(r["formatted"][a["begin"] :].startswith(chat.PLACEHOLDERS[a["kind"]]) for a in r["attachments"])
    assert "".join(chat.unescape(r["formatted"][s["begin"] : s["end"]]) for s in r["loss"]) == "see [INST] here<|image|>!"
    assert r["n_tokens"] == 3 + 6 + 38 + 1 + 1024 + 1


# 2


def brute_hits(texts, items, width=10):
    found = {}
    for item, text in items:
        w = words_of((text or "").encode())
        for i in range(max(len(w) - width + 1, bool(w))):
            found.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    out = []
    for doc, text in texts:
        w, hit, named = words_of((text or "").encode()), set(), set()
        for k in {len(x) for x in found}:
            for i in range(len(w) - k + 1):
                if named_ := found.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    named |= named_
        out.append((doc, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return out


def test_decontaminate(spark, docs, rows, nothing):
    rng = random.Random(9)
    long = next(r[1] for r in rows if r[1] and len(r[1]) > 100_000).split()
    items = [(i, " ".join(long[k : k + 25])) for i, k in enumerate((0, 5, 7000, len(long) - 25))]
    items += [(10, prose(rng, 30)), (11, "one two"), (12, None), (13, ""), (14, "One"), (15, "kara " * 12), (16, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("x"))
    got = sorted(map(tuple, decontaminate(docs, bench).collect()), key=repr)
    assert got == sorted(brute_hits([(r[0], r[1]) for r in rows], items), key=repr)
    assert decontaminate(nothing, bench).count() == 0
    assert {r["n_hit"] for r in decontaminate(docs, bench.limit(0)).collect()} == {0}


def test_proximity(spark):
    texts = [(1, "aa bb cc dd ee"), (2, "aa xx bb cc dd ee"), (3, "ee dd cc bb aa")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    wins = saved(windows(spark.createDataFrame([("q", "aa bb cc dd ee")], "item_id string, text string"), 5))
    anchor = anchors(df, wins, 2)
    index = build_index(df, anchor, 5)
    assert [r["doc_id"] for r in exact_matches(index, anchor).collect()] == [1]
    assert {(r["doc_id"], abs(r["gap"])) for r in proximity_matches(index, anchor, 2).collect()} == {(2, 1), (3, 2)}


def test_near_passages(spark):
    """A word replaced, left out or added gives a proximity match, also where the passage has a word that no text has."""
    rng = random.Random(13)
    passage, other = ([f"{rng.choice(WORDS)}{i}" for i in range(40)] for _ in range(2))
    texts = [(1, passage), (2, [*passage[:20], "nowhere", *passage[21:]]), (3, [*passage[:5], *passage[6:]]), (4, other), (None, [*passage[:8], "more", *passage[8:]]), (6, list(reversed(passage)))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id long, text string")
    bench = spark.createDataFrame([("a", " ".join(passage)), ("b", " ".join(["absent", *passage[1:9], "gone"])), ("c", "word")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_items"], r["n_near"]) for r in decontaminate(df, bench, near=True).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 0), 4: (0, 0), None: (1, 1), 6: (0, 2)}  # reversed: neighbours are two words off


def test_decontaminate_beyond_what_is_sent(spark, docs, rows, monkeypatch):
    """Terms and ids that are too many to be sent are joined; the rows are the same."""
    long = next(r[1] for r in rows if r[1] and len(r[1]) > 100_000).split()
    bench = spark.createDataFrame([(1, " ".join(long[3:40])), (2, "one two")], "item_id long, text string")
    wanted = sorted(map(repr, decontaminate(docs, bench, near=True).collect()))
    monkeypatch.setattr(decontaminate_module, "SENT_ROWS", 1)
    monkeypatch.setattr(decontaminate_module, "SENT_ANCHORS", 1)
    monkeypatch.setattr(tables, "SENT_ROWS", 1)
    assert sorted(map(repr, decontaminate(docs, bench, near=True).collect())) == wanted


# 3


def test_unrelated_short_sets_share_no_keys():
    rng = np.random.default_rng(5)
    for t in (ngram_jaccard.Threshold(85, 100), ngram_jaccard.Threshold(4, 5)):
        for size in range(1, 21):
            keys = [k for _ in range(2000) for k in ngram_jaccard.band_keys(np.unique(rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64)), t)]
            assert len(keys) - len(set(keys)) < 100
            assert bool(keys) == (t.partner(size) > size)


@pytest.mark.parametrize(("num", "den"), [(85, 100), (4, 5), (3, 5), (1, 2)])
def test_similar_sets_share_a_key(num, den):
    rng, t = np.random.default_rng(6), ngram_jaccard.Threshold(num, den)
    for size in [*range(1, 40), 100, 300]:
        for _ in range(20):
            base = np.unique(rng.integers(0, 2**63, size, dtype=np.int64).astype(np.uint64))
            largest = t.partner(size)
            both = size - rng.integers(0, t.difference(size, size) // 2 + 1)
            other = np.unique(np.concatenate([base[:both], rng.integers(0, 2**63, int(rng.integers(size - both, largest - both + 1)), dtype=np.int64).astype(np.uint64)]))
            shared = len(np.intersect1d(base, other))
            if shared < size or len(other) > size:
                alike = den * shared >= num * (size + len(other) - shared)
                assert not alike or set(ngram_jaccard.band_keys(base, t)) & set(ngram_jaccard.band_keys(other, t))


def brute_components(texts, n, num, den):
    sets = {}
    for doc, text in texts:
        w = (text or "").encode().lower().split()
        sets[doc] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    root = {d: d for d in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 4, 5), (1, 1, 2), (3, 1, 1)])
def test_ngram_jaccard(docs, rows, n, num, den):
    got = ngram_jaccard.ngram_jaccard_components(docs, n, num, den).collect()
    assert len(got) == len(rows)
    expected = brute_components([(r[0], r[1]) for r in rows if r[0] is not None], n, num, den)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == expected


def test_one_id_and_several_texts(spark):
    """Rows are documents, in whatever order they come; rows without id link others too."""
    rng = random.Random(21)
    a, b, c, d = (prose(rng, 200) for _ in range(4))
    held = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (None, c), (None, c + " y"), (9, c + " x"), (7, d), (7, d), (5, None), (5, ""), (None, "")]
    wanted = sorted([(1, 1), (1, 1), (2, 1), (3, 1), (None, 9), (None, 9), (9, 9), (7, 7), (7, 7), (5, 5), (5, 5), (None, None)], key=repr)
    passage = " ".join(a.split()[20:35])
    bench = spark.createDataFrame([("q", passage), ("z", " ".join(b.split()[5:15]))], "item_id string, text string")
    for _ in range(3):
        df = spark.createDataFrame(held, "doc_id long, text string").repartition(rng.randint(1, 4))
        got = ngram_jaccard.ngram_jaccard_components(df, 5, 4, 5).select("doc_id", "component_id").collect()
        assert sorted(map(tuple, got), key=repr) == wanted
        hits = decontaminate(df, bench).collect()
        assert sorted(map(tuple, hits), key=repr) == sorted(brute_hits(held, [("q", passage), ("z", " ".join(b.split()[5:15]))]), key=repr)
        assert all(r["n_hit"] <= r["n_words"] for r in hits)
        rng.shuffle(held)


def test_ngram_jaccard_edges(nothing):
    assert ngram_jaccard.ngram_jaccard_components(nothing).count() == 0
    with pytest.raises(ValueError, match="similarity"):
        ngram_jaccard.Threshold(4, 3)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 199)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 199: 199, 200: 199}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 4


def test_classifier_on_fixture(spark):
    rng = random.Random(4)
    table = []
    for i in range(1200):
        text, kind = prose(rng, rng.randrange(30, 120)), i % 6
        if kind == 0:
            text = " ".join(w + "***" for w in text.split())
        elif kind == 1:
            text = " ".join(w for w in text.split()[:15] for _ in range(8))
        table.append((i, text, int(kind > 1)))
    df = saved(spark.createDataFrame([*table, (5000, None, None), (5001, "", None)], "doc_id long, text string, quality int"))
    labels = df.where("quality is not null").select("doc_id", "quality")
    labels = labels.unionByName(spark.createDataFrame([(1, None), (None, 1), (99999, 1), (2, 1)], "doc_id long, quality int"))
    got = quality_classifier.classify_quality(df.select("doc_id", "text"), labels).join(df.select("doc_id", "quality"), "doc_id").collect()
    assert len(got) == 1202
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [r for r in got if r["held_out"] and r["quality"] is not None]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.97 * len(held)


def test_classifier_without_labels(spark, docs, rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality_classifier.classify_quality(docs, none).limit(2).collect()] == [0.5, 0.5]
    assert quality_classifier.classify_quality(docs, none).count() == len(rows)


def test_scores_by_hand(spark, docs, rows):
    """Scores recomputed from the rules in plain Python."""
    rng = random.Random(14)
    table = [(i, prose(rng, 60) if i % 3 else "*** " * rng.randrange(5, 60), int(i % 3 > 0)) for i in range(600)]
    labelled = saved(spark.createDataFrame(table, "doc_id long, text string, quality int"))
    model = quality_classifier.train(labelled.select("doc_id", "text"), labelled.select("doc_id", "quality"))
    assert model.rules
    got = quality_classifier.scored(docs.select("doc_id", "text"), model).collect()
    for r in got:
        held = dict(zip(quality_classifier.STATISTICS, quality_classifier.statistics_of((r["text"] or "").encode()), strict=True))
        total = model.intercept + sum(weight for rule, weight in model.rules if all((held[b.name] > b.limit) == b.above for b in rule))
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-9
        assert r["predicted"] == (r["score"] >= 0.7)


def test_statistics_by_hand():
    text = "Ab ab, 12\n\nab. é! ab ab\nAb ab, 12"
    words = text.split()
    got = dict(zip(quality_classifier.STATISTICS, quality_classifier.statistics_of(text.encode()), strict=True))
    assert (got["words"], got["chars"], got["breaks"]) == (len(words), len(text), text.count("\n") / len(text))
    assert got["repeats"] == sum(a == b for a, b in itertools.pairwise(words)) / len(words)
    assert (got["distinct"], got["same_lines"]) == pytest.approx((len(set(words)) / len(words), 1 / 3))
    assert (got["capitals"], got["digits"]) == (sum(c in "ABC" for c in text) / len(text), sum(c in "12" for c in text) / len(text))


def test_paths_of_a_tree():
    tree = "Tree: uid=x\n  If (feature 3 <= 0.5)\n   If (feature 3 <= 0.2)\n    Predict: 0.0\n   Else (feature 3 > 0.2)\n    Predict: 1.0\n  Else (feature 3 > 0.5)\n   Predict: 1.0\n"
    name = quality_classifier.STATISTICS[3]
    got = {tuple((b.name, b.above, b.limit) for b in r) for r in quality_classifier.paths(tree)}
    assert got == {((name, False, 0.5),), ((name, False, 0.2),), ((name, False, 0.5), (name, True, 0.2)), ((name, True, 0.5),)}


# 5

MIT = """MIT License

Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, and sell copies of the Software, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING THE WARRANTIES OF MERCHANTABILITY.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list.
2. Redistributions in binary form must reproduce the above copyright notice in the documentation.
{}THIS SOFTWARE IS PROVIDED BY THE HOLDERS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING FITNESS, ARE DISCLAIMED.
"""
THIRD = "3. Neither the name of the holder nor of others may be used to endorse or promote products derived from this software without permission.\n"
LICENSES = [
    ("Some words.\nThis work is licensed under the GNU General Public License, version 3.\nMore.", ["GPL-3.0-only"]),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("words Released under the MIT License", []), ("x.\nReleased under the MIT License.", ["MIT"]),
    ("Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", ["Apache-2.0", "MIT"]),
    (MIT, ["MIT"]), (BSD.format(""), ["BSD-2-Clause"]), (BSD.format(THIRD), ["BSD-3-Clause"]),
    ("// SPDX-License-Identifier: Apache-2.0\ncode", ["Apache-2.0"]),
    ("Licensed under the GNU Lesser General Public License v2.1 or later.", ["LGPL-2.1-or-later"]),
    ("The licence was granted. See the license for details.", []), (None, []), ("", []), ("word " * 50_000 + "\nLicensed under CC BY 4.0.", ["CC-BY-4.0"]),
]


def test_licenses(spark):
    df = spark.createDataFrame([(i, t, 1) for i, (t, _) in enumerate(LICENSES)], "doc_id long, text string, matches int")
    got = {r["doc_id"]: r for r in license_scan(df).collect()}
    assert [got[i]["licenses"] for i in range(len(LICENSES))] == [names for _, names in LICENSES]
    m = got[0]["matches"][0]
    assert LICENSES[0][0][m["begin"] : m["end"]].strip() == "This work is licensed under the GNU General Public License, version 3."
    assert license_scan(df.limit(0)).count() == 0


SAMPLES = {
    "spdx": "SPDX-License-Identifier: MIT", "apache-ref": "Released under the Apache License, Version 2.0.", "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at", "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-ref": "Distributed under the MIT License.", "mit-title": "The MIT License (MIT)", "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "asis": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, AND SO ON.", "no-liability": "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, at all.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, as said.", "isc-asis": "The software is provided \"as is\" and the author disclaims all warranties of all kinds.",
    "bsd-ref": "Released under the BSD 3-Clause License.", "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list.", "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list.",
    "bsd-endorse": "Neither the name of X nor others may be used to endorse or promote products derived from this software without leave.",
    "bsd-asis": "This software is provided by X \"as is\" and any express or implied warranties, all of them, are disclaimed.", "gpl-ref": "Distributed under the GNU General Public License v3 or later.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY, at all.", "gpl-see": "See the GNU General Public License for more details.",
    "mpl-ref": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-short": "Released under the Mozilla Public License 2.0.",
    "cc-ref": "Released under CC BY 4.0.", "cc0-ref": "CC0 1.0 Universal", "unlicense": "This is free and unencumbered software released into the public domain.",
}


@pytest.mark.parametrize("name", SAMPLES)
def test_license_sentences_pass_the_trigger(name):
    for text in (SAMPLES[name], SAMPLES[name].upper(), SAMPLES[name].replace(" ", "\n", 8)):
        assert [s.name for s in known_sentences(text)] == [name]


@pytest.mark.parametrize(("text", "names"), [
    ("distributed under Creative Commons Attribution 4.0 International", ["cc-ref"]), ("Given to all by public\ndomain dedication", ["cc0-ref"]),
    ("word " * 600 + "SPDX-License-Identifier: MIT\ncode", ["spdx"]), ("word " * 600 + "\nThe code is released under the MIT License.", ["mit-ref"]),
    ("All of our old code is released\nunder the MIT License.", ["mit-ref"]), ("The code is not released under the MIT License.", []),
    ("Licensed under the Apache License, Version 2.0.\nThe text is also licensed under CC BY 4.0.\n# SPDX-License-Identifier: MIT", ["apache-ref", "cc-ref", "spdx"]),
])
def test_license_sentences_after_other_words(text, names):
    assert [s.name for s in known_sentences(text)] == names


def brute_sentences(text):
    """Every run of pieces against every pattern; of those that begin at a piece, the one that ends last."""
    pieces, out, i = _pieces(text or ""), [], 0
    while i < len(pieces):
        best = None
        for cut in license_scan_module._starts(pieces[i][0]):
            for name, pattern in SENTENCES:
                for j in range(i, len(pieces)):
                    joined = " ".join([pieces[i][0][cut:], *(p[0] for p in pieces[i + 1 : j + 1])])
                    if re.fullmatch(pattern, joined):
                        if best is None or j > best[1]:
                            best = (name, j, pieces[i][1], pieces[j][2])
                        if ".*" in pattern:
                            break
            if best:
                break
        if best:
            out.append((best[0], best[2], best[3]))
        i = best[1] + 1 if best else i + 1
    return out


def test_sentences_against_all_runs_of_pieces():
    rng = random.Random(15)
    samples = [t for name, t in SAMPLES.items() if name != "spdx"]
    texts = [t for t, _ in LICENSES if t and "SPDX" not in t and len(t) < 5000]
    for _ in range(60):
        parts = [rng.choice([rng.choice(samples), prose(rng, rng.randrange(1, 9)), rng.choice(samples).replace(" ", "\n", rng.randrange(9))]) for _ in range(rng.randrange(1, 7))]
        texts.append(rng.choice(["\n", " ", ".\n"]).join(parts))
    for text in texts:
        assert [(s.name, s.begin, s.end) for s in known_sentences(text)] == brute_sentences(text)


def test_long_and_wrapped_licences():
    wrapped = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, " + "including\nwithout\nlimit\n" * 300 + "and so on, subject to the following conditions:"
    assert [s.name for s in known_sentences(wrapped)] == ["mit-grant"]
    full = {"Apache License\n   Version 2.0, January 2004\n  http://www.apache.org/licenses/\n": "Apache-2.0", "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\nPreamble": "GPL-3.0-only", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999": None, "Mozilla Public License\nVersion 2.0": "MPL-2.0"}
    for text, name in full.items():
        assert [m.license for m in license_scan_module.match_rules(known_sentences(text))[0]] == ([name] if name else [])


def test_spdx_expressions():
    names = lambda text: [m.license for m in license_scan_module.match_rules(known_sentences(text))[0]]
    assert names("SPDX-License-Identifier: MIT OR Apache-2.0 and trailing words here") == ["MIT", "Apache-2.0"]
    assert names("/* SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND MIT */") == ["GPL-2.0-only WITH Classpath-exception-2.0", "MIT"]
    assert names("x\nspdx-license-identifier: 0BSD.\nReleased under the MIT License.") == ["0BSD", "MIT"]


REFERENCES = {
    "Nothing here is licensed under the MIT License": [], "The code is never released under the GPLv3.": [], "Code under the MIT License": ["MIT"], "MIT licensed.": ["MIT"], "Licensed under Apache 2.0.": ["Apache-2.0"],
    "Licensed under the LGPL-2.1": ["LGPL-2.1-only"], "Released under the GPLv3.": ["GPL-3.0-only"], "licensed under the GNU GPL version 3": ["GPL-3.0-only"], "Content is available under CC BY-SA 3.0": ["CC-BY-SA-3.0"],
    "Released under a BSD-style license.": ["LicenseRef-BSD"], "Licensed under the Eclipse Public License 2.0": ["EPL-2.0"], "Distributed under the Boost Software License, Version 1.0.": ["BSL-1.0"], "The code is released under GPL v2\nor later.": ["GPL-2.0-or-later"],
    "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation.": ["GPL-2.0-only"], "SPDX-License-Identifier: apache-2.0": ["Apache-2.0"],
    "Released under the Foo License.": [], "It was licensed.": [], "Licensed under the apache.": [],
    "This software is provided 'as-is', without any express or implied warranty. In no event.\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.": ["Zlib"],
}


@pytest.mark.parametrize("text", REFERENCES)
def test_license_references(text):
    for spaced in (text, f"Some words.\n{text}\nMore words here", text.upper() if "SPDX" not in text else text):
        assert [m.license for m in license_scan_module.match_rules(known_sentences(spaced))[0]] == REFERENCES[text]


def test_names_of_licences_name_one_each():
    """Every version of every name is known by each of its phrases, and no phrase names two."""
    for name, phrases in license_scan_module.NAMES.items():
        for version in license_scan_module.VERSIONS[name.split("-")[0]] if "{}" in name else ("",):
            for phrase in phrases:
                assert license_scan_module._NAMED[phrase.format(version)] == name.format(version)


def test_sentences_that_begin_again_and_again():
    """Thousands of beginnings without an end are no work to speak of, and the one with an end is found."""
    begun = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, x\n"
    took = time.process_time()
    assert known_sentences(begun * 4000) == []
    assert time.process_time() - took < 1.5
    found = known_sentences(begun * 50 + "y subject to the following conditions:\n" + begun * 3)
    assert [(s.name, s.first) for s in found] == [("mit-grant", 0)]


# 6


def test_very_long_lines(spark, monkeypatch):
    """Lines that are hashed in pieces have the shingles of whole ones, and their near copies are found."""
    rng = random.Random(16)
    line = line_dedup.normal_line(prose(rng, 150_000).replace("\n", " "))
    assert len(line) > line_dedup._CHARS
    with monkeypatch.context() as patch:
        patch.setattr(line_dedup, "_CHARS", len(line))
        whole = line_dedup._distinct([line])
    assert np.array_equal(line_dedup._distinct([line]), whole)
    rare = "".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(4_000_000))
    texts = [(1, rare), (2, rare[:2_000_000] + "x" + rare[2_000_000:] + "\nanother line"), (3, line)]
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0], 3: []}


def test_lines(spark, docs, rows, nothing):
    places = {}
    for doc, text, *_ in rows:
        for place, raw in enumerate((text or "").split("\n")):
            if line := line_dedup.normal_line(raw):
                places.setdefault(line, set()).add((doc is None, doc or 0, place))
    lines = sorted(places)
    sets = [line_dedup.shingles(x) for x in lines]
    root = list(range(len(lines)))
    find = lambda x: x if root[x] == x else find(root[x])
    links = [(a, b) for a, b in itertools.combinations(range(len(lines)), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for a, b in links:
        root[find(b)] = find(a)
    got = line_dedup.line_classes(docs).distinct().collect()
    kept = {(r["doc_id"] is None, r["doc_id"] or 0, r["place"]) for r in got if r["kept"]}
    groups = {}
    for i, line in enumerate(lines):
        groups.setdefault(find(i), set()).update(places[line])
    assert len(got) == sum(map(len, places.values()))
    found = sum(min(g) in kept and not (g - {min(g)}) & kept for g in groups.values())
    assert found >= 0.97 * len(groups)
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_dropped_lines(spark):
    a = "the quick brown fox jumps over the lazy dog and runs into the deep dark forest again, where it sleeps until the sun comes up over the hills"
    texts = [(1, f"{a}\nother line here\n\n{a.upper()}"), (2, f"{a.replace('lazy', 'hazy')}\nOther  line here\nnew"), (3, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("dropped", F.lit(1))
    out = line_dedup.dedup_lines(df)
    assert {r["doc_id"]: (r["n_lines"], r["n_kept"], r["dropped"]) for r in out.collect()} == {1: (3, 2, [3]), 2: (3, 1, [0, 1]), 3: (0, 0, [])}
    assert {r["doc_id"]: r["text"] for r in line_dedup.without_lines(df, out).collect()} == {1: f"{a}\nother line here\n", 2: "new", 3: None}


def test_signatures_estimate_similarity():
    rng = random.Random(6)
    for words, short in ((60, False), (60, True), (20, True)):
        _estimated(rng, prose(rng, words), short)


def _estimated(rng, base, short):
    pairs = [(base, edited(rng, base, 0.03)) for _ in range(40)]
    sims = [len(line_dedup.shingles(x) & line_dedup.shingles(y)) / len(line_dedup.shingles(x) | line_dedup.shingles(y)) for x, y in pairs]
    sigs = line_dedup.signatures(line_dedup._distinct([x for p in pairs for x in p]), np.arange(80), short)[:, : line_dedup.ROWS * line_dedup.BANDS]
    assert abs(np.mean(sims) - (sigs[::2] == sigs[1::2]).mean()) < 0.05
    ((_, keys),) = line_dedup.band_keys(["short", "short", "shart"])
    assert (keys[0] == keys[1]).all()
    assert not set(keys[0]) & set(keys[2])


def test_lines_of_any_size_share_keys():
    """Alike lines of any two sizes meet, also where one is short and the other long, and where a long line repeats few shingles."""
    rng = random.Random(21)
    for n in (20, 150, 160, 180, 190, 200, 230, 300):
        missed = 0
        for _ in range(50):
            line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
            found = [set() for _ in range(2)]
            for which, keys in line_dedup.band_keys([line, line + line[: n // 8][::-1]]):
                for at, row in zip(which, keys, strict=True):
                    found[at] |= set(row.tolist())
            missed += not found[0] & found[1]
        assert missed <= 1
    (a, b) = (set(np.concatenate([keys[list(which).index(i)] for which, keys in line_dedup.band_keys(["=-" * 90, "=-" * 400]) if i in which]).tolist()) for i in range(2))
    assert a == b


def test_normal_lines():
    texts = [None, "", " a", "a ", "a  b", "A\tb", "a\u00a0b\u2003c", "x\r\ny\x0b\n\n \nΑΣ\nΑΣ α", "a\u200bb \u3000", "\u2028 q\x85"]
    for text in texts:
        assert line_dedup.normal_lines(text) == [line_dedup.normal_line(x) for x in (text or "").split("\n")]


EDITS = [
    ("the river turned slowly past the old mill and under the bridge", "the river turned slowly past the old mill and under the fridge"),
    ("some people walk along the quiet harbour every morning before the shops open again", "some people walk along the quiet harbour every morning before shops open again"),
    ("we counted nineteen boats near the island before the fog came", "we counted nineteen boots near the island before the fog came"),
]


def test_edits_of_lines_of_40_to_100_characters(spark):
    """One letter or one word, as a set of shingles of 5 sees them; a short line is not alike to just any other."""
    texts = [(i, line) for i, line in enumerate(line for pair in EDITS for line in pair)] + [(10, "nothing like the other lines stands here, to be sure")]
    got = {r["doc_id"]: r["n_kept"] for r in line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(40 <= len(line) <= 100 for _, line in texts)
    assert got == {0: 1, 1: 0, 2: 1, 3: 0, 4: 1, 5: 0, 10: 1}


def test_sketches_lose_no_pair():
    rng = random.Random(12)
    lines = [edited(rng, base, share) for base in (prose(rng, n) for n in (1, 2, 5, 12, 30, 90, 300)) for share in (0, 0.02, 0.05, 0.3)]
    sets, (counts, bits) = [line_dedup.shingles(x) for x in lines], line_dedup.sketches(lines)
    assert list(counts) == list(map(len, sets))
    for a, b in itertools.combinations(range(len(lines)), 2):
        assert sum((x ^ y).bit_count() for x, y in zip(bits[a].view(np.uint64).tolist(), bits[b].view(np.uint64).tolist(), strict=True)) <= len(sets[a] ^ sets[b])


# 7


def brute_rules(text):
    w = (text or "").encode().split()
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    held = {k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(i, i + 3)} if len(w) < 1000 else None
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), held if held is None else len(held)


def test_quality_rules(docs, rows, nothing):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in got:
        if r["doc_id"] is None:
            continue
        *counts, repeats = brute_rules(texts[r["doc_id"]])
        assert [r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]] == counts
        assert repeats is None or r["n_repeat_words"] == repeats
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.quality_rules(nothing).count() == 0


def test_divergence(spark):
    rng = random.Random(8)
    table = [(i, prose(rng, 150), "xx") for i in range(300)]
    table += [(1000, prose(rng, 150).upper(), "xx"), (1001, " ".join(w + "%%" for w in prose(rng, 150).split()), "xx"), (1002, " ".join(f"q{i}z" for i in range(200)), "xx"), (1003, prose(rng, 150).upper(), "rare")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(table, "doc_id long, text string, lang string")).collect()}
    assert all(kept[i] for i in range(300))
    assert [kept[i] for i in (1000, 1001, 1002, 1003)] == [False, False, False, True]
    assert quality_rules.js_distance(np.array([1.0, 0]), np.array([0, 2.0])) == 1.0
    assert quality_rules.js_distance(np.array([1.0, 3]), np.array([2.0, 6])) == 0.0


def language_rows(rng):
    """A large language, the empty string and null as languages, and one language with a document in each task."""
    rows = [(i, prose(rng, 200), "xx") for i in range(150)] + [(1000 + i, prose(rng, 200).upper(), "") for i in range(150)]
    rows += [(2000 + i, " ".join(w[::-1] for w in prose(rng, 200).split()), "thin") for i in range(150)] + [(3000 + i, prose(rng, 150), None) for i in range(150)]
    return rows + [(4000, prose(rng, 200), "few"), (4001, prose(rng, 200).upper(), "xx"), (4002, prose(rng, 200), "")]


def test_languages_of_any_name(spark):
    rows = language_rows(random.Random(17))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(12)
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    assert all(got[i]["kept"] for i, _, lang in rows[:600])
    assert got[4000]["kept"]
    assert got[4000]["class_distance"] < 1e-6  # a language's only document is its reference
    assert not got[4001]["kept"]
    assert not got[4002]["kept"]
    wanted: dict = {}
    for _, text, lang in rows:
        if len(words := text.split()) >= quality_rules.Limits.word_words:
            held = wanted.setdefault(lang, [Counter(), 0])
            held[1] += 1
            for w in words:
                held[0][w] += 1 / len(words)
    refs = {r["lang"]: {bytes(w).decode(): n for w, n in zip(r["words"], r["counts"], strict=False)} for r in quality_rules.references(df.select("lang", "text")).collect()}
    assert set(refs) == set(wanted)
    for lang, (shares, n) in wanted.items():
        assert refs[lang] == pytest.approx({w: x for w, x in shares.items() if x >= quality_rules.COMMON * n * (1 - 1e-9)})


def test_verdicts_do_not_depend_on_size(spark):
    """A table repeated ten times has the verdicts of the table, small languages and outliers in them included."""
    rng = random.Random(19)
    rows = language_rows(rng)[::5] + [(5000 + i, prose(rng, 160), "small") for i in range(12)]
    rows += [(5100, " ".join(f"{i}|{i * i}" for i in range(3000)), "small"), (5101, "ein wort", "tiny"), (5102, " \n", "blank"), (5103, None, "none")]
    df = saved(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    once = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(df).collect()}
    again = quality_rules.quality_rules(df.crossJoin(spark.range(10)).drop("id")).groupBy("doc_id").agg(F.count("*").alias("n"), F.collect_set("kept").alias("kept")).collect()
    assert {r["doc_id"]: r["kept"] for r in again} == {i: [x] for i, x in once.items()}
    assert {r["n"] for r in again} == {10}
    assert all(once[5000 + i] for i in range(12))
    assert not any(once[i] for i in (5100, 5101, 5102, 5103))


def test_more_languages_than_are_sent(spark, monkeypatch):
    df = saved(spark.createDataFrame(language_rows(random.Random(17)), "doc_id long, text string, lang string").repartition(5))
    wanted = sorted(map(repr, quality_rules.quality_rules(df).collect()))
    monkeypatch.setattr(quality_rules, "SENT_LANGUAGES", 1)
    assert sorted(map(repr, quality_rules.quality_rules(df).collect())) == wanted


def test_rare_words_are_dropped_from_counts(monkeypatch):
    """With few counters, bounds still hold: no common word is missed."""
    monkeypatch.setattr(quality_rules, "COUNTERS", 64)
    rng = random.Random(18)
    words = [f"w{min(int(rng.paretovariate(1.1)), 100_000)}" for _ in range(60_000)]
    bounds, floors = Counter(), 0.0
    for part in range(6):
        texts = [" ".join(words[i : i + 100]).encode() for i in range(part * 10_000, part * 10_000 + 10_000, 100)]
        for batch in quality_rules._spotted(quality_rules.Limits(word_words=100))(iter([pa.RecordBatch.from_arrays([pa.array(["x"] * len(texts)), pa.array(texts)], ["lang", "text"])])):
            for r in batch.to_pylist():
                if r["word"] is None:
                    floors += r["counts"][1]
                else:
                    bounds[r["word"].decode()] += r["over"]
    for word, n in Counter(words).items():
        assert n / 100 <= bounds[word] + floors + 1e-6


# 8


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000, 4097])
def test_permutation(spark, n):
    r = spark.range(n).select("id", sharding.permuted(F.col("id"), n, 5).alias("p")).withColumn("q", sharding.permuted(F.col("p"), n, 5, back=True)).collect()
    assert sorted(x["p"] for x in r) == list(range(n))
    assert all(x["q"] == x["id"] for x in r)


def test_sharding(docs, rows, nothing):
    got = sharding.shard_documents(docs).collect()
    again = sharding.shard_documents(docs.repartition(7)).collect()
    assert len(got) == len(rows)
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    slots = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    assert all((r["size"], r["text_crc32"]) == (len((texts[r["doc_id"]] or "").encode()) + 1, zlib.crc32((texts[r["doc_id"]] or "").encode())) for r in got if r["doc_id"] is not None)
    assert sharding.shard_documents(nothing).count() == 0
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"])) if r["doc_id"] is not None]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.2


# 9


def test_warc(spark, tmp_path):
    big, small = "<p>" + "x" * 200 + "é</p>", "<p></p>"
    pages = [(5, "http://a", big), (3, "http://b\r\nX: y", big), (9, None, big), (1, "http://c", small), (2, "http://d", small), (4, "u", None), (6, "u", "y" * 3_000_000), (3, "http://b", big), (None, "n", big), (None, "n", "z" * 100), (7, "v", "\r\n\r\n" * 40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    archives = warc.write_warc(df, "file://" + str(tmp_path / "w"))
    got = warc.read_warc(archives, keep_payload=True).collect()
    assert len(got) == len(pages) == archives.agg(F.sum("records")).first()[0]
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    keyed = lambda page, t: (page, sha(t), len((t or "").encode()), "revisit" if t == big and page != 3 else "response", 3 if t == big and page != 3 else None)
    assert sorted(((r["page_id"], r["payload_digest"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got), key=repr) == sorted((keyed(p, t) for p, _, t in pages), key=repr)
    assert all(hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] for r in got if r["record_type"] == "response")
    assert warc.read_warc(warc.write_warc(df.limit(0), "file://" + str(tmp_path / "e"))).count() == 0
    for path in (tmp_path / "w").glob("*.gz"):
        assert gzip.decompress(path.read_bytes()).startswith(b"WARC/1.1\r\n")


def test_damaged_archives():
    good = warc.record("response", 1, "http://a", b"payload " * 50, hashlib.sha256(b"payload " * 50).hexdigest(), None)
    assert [x[1] for x in warc.read_records(io.BytesIO(good + good))] == [b"payload " * 50] * 2
    bad = gzip.compress(gzip.decompress(good).replace(b"payload", b"Payload", 1))
    short = gzip.compress(gzip.decompress(good)[:-20])
    for data in (good[:-30], bad, short, b"no gzip", good + b"rest", gzip.compress(b"WARC/1.1\r\nX: y\r\n\r\n")):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(data)))


# 10


def filled(sizes, budget=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    total, held = budget * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in held)
        w = sum(weight[s] for s in names if s not in held)
        over = {s for s in names if s not in held and left * weight[s] / w > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in held else left * weight[s] / w for s in names}
        held |= over


def test_mixing(docs, rows, nothing):
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(rows)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_documents(docs.repartition(5)).collect()))
    size = lambda r: len((r[1] or "").encode().split())
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r)
    expected = filled(sizes)
    source = {r[0]: r[3] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert r["taken"] <= 2 * r["size"]
        if r["doc_id"] is not None:
            assert r["source_size"] == sizes[s]
            assert abs(r["target"] - expected[s]) < 1e-6 * expected[s] + 1e-6
        taken[s] += r["taken"]
    assert all(abs(taken[s] - expected[s]) <= 0.02 * expected[s] + 8 for s in sizes)
    assert mixing.mix_documents(nothing).count() == 0


def test_schedule_is_even_everywhere(docs):
    sizes = saved(mixing.sized(docs))
    plan = mixing.planned(sizes)
    slots = mixing.schedule(plan).collect()
    shares = {r["source_no"]: r["target"] / r["block_words"] for r in plan.collect()}
    total = sum(shares.values())
    order = [r["source_no"] for r in sorted(slots, key=lambda r: r["slot"])]
    for n in range(50, len(order), 97):
        for s, share in shares.items():
            assert abs(order[:n].count(s) - n * share / total) < 8
    for s in shares:
        assert sorted(r["rank"] for r in slots if r["source_no"] == s) == list(range(order.count(s)))


def test_only_lines_in_pairs_are_verified(spark, monkeypatch):
    """Texts that no pair names are left where they are."""
    held = []
    keep = line_dedup.keep_ids
    monkeypatch.setattr(line_dedup, "keep_ids", lambda *args: held.append(keep(*args)) or held[-1])
    nodes = spark.createDataFrame([(i, "one line of text" + "s" * (i % 2) + (f" number {i}" if i > 1 else "")) for i in range(200)], "id long, line string")
    found = line_dedup._verifier(4, 5)(nodes)(spark.createDataFrame([(0, 1), (0, 2)], "a long, b long"))
    assert [tuple(r) for r in found.collect()] == [(0, 1)]
    assert [df.count() for df in held] == [3]


def test_rows_that_no_size_fits_are_left_out(spark):
    """Only lines that share a key with one of a size that can be alike are asked for; equal and repeated ones are."""
    rows = [(1, 1, 10), (1, 1, 10), (1, 2, 12), (1, 3, 100), (2, 3, 100), (2, 4, 10), (3, 5, 7), (3, 6, 7), (4, 7, 5), (4, 7, 5), (5, 1, 10), (5, 8, 8), (5, 9, 200), (5, 10, 240)]
    asked = []

    def nodes(ids):
        asked.extend(r["id"] for r in ids.collect())
        return ids.join(spark.createDataFrame(sorted({r[1:] for r in rows}), "id long, n int"), "id").withColumn("mark", F.col("n"))

    fits, _ = line_dedup._plausible(4, 5)
    found = linking.linked(spark.createDataFrame(rows, "key long, id long, n int"), nodes, fits, lambda x, y: F.lit(True), lambda _: tables.saved)
    assert sorted(asked) == [1, 2, 5, 6, 8, 9, 10]
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 1), (5, 5), (6, 5), (8, 1), (9, 9), (10, 9)]


def test_lines_are_hashed_in_any_pieces(monkeypatch):
    """Names and keys of lines do not depend on how many are hashed together."""
    rng = random.Random(31)
    batch = pa.RecordBatch.from_pydict({"text": [None, "", "\n\n", *(prose(rng, 40) + "\n\n" + prose(rng, 3) + "\n Two  blanks " for _ in range(30))]})
    made = []
    for chars in (1 << 19, 300):
        monkeypatch.setattr(line_dedup, "_CHARS", chars)
        made.append(sorted((r["id"], r["n"], tuple(r["keys"])) for out in line_dedup._keys(4, 5)(iter([batch])) for r in out.to_pylist()))
    assert made[0] == made[1]
    assert {(i, n) for i, n, _ in made[0]} == {(int.from_bytes(line_dedup.line_name(x)[:8], "big", signed=True), len(line_dedup.shingles(x))) for t in batch.to_pydict()["text"] for x in map(line_dedup.normal_line, (t or "").split("\n")) if x}
    assert sum(len(out) for out in line_dedup._places(iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["", None]}, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))]))) == 0


def test_keys_packed_by_ranges_are_the_same_rows(monkeypatch):
    """Keys of all lines come back in order, each once, however many are packed together or pile up in a range."""
    rng = random.Random(37)
    texts = [prose(rng, 40) + "\n" + prose(rng, 4) + "\nthe same line in every text" for _ in range(40)]
    batches = [pa.RecordBatch.from_pydict({"text": texts[i : i + 10]}) for i in range(0, 40, 10)]
    wanted = {(key & ~line_dedup.NUMBER | r["n"], r["id"]) for out in line_dedup._keys(4, 5)(iter(batches)) for r in out.to_pylist() for key in r["keys"]}
    for ranges, count in ((1 << 13, 1 << 20), (1 << 13, 50), (2, 10)):
        monkeypatch.setattr(line_dedup, "RANGES", ranges)
        monkeypatch.setattr(line_dedup, "PACKED", count)
        packed = pa.Table.from_batches(line_dedup._ranges(4, 5)(iter(batches))).sort_by("range").to_batches(max_chunksize=7)
        got = [tuple(r.values()) for out in line_dedup._unpacked(iter(packed)) for r in out.to_pylist()]
        assert got == sorted(wanted)
    assert sum(len(b) for b in packed) < len(wanted) / 5


def test_rows_with_a_fitting_neighbour():
    """Of rows in order of key and number, in any batches, those stay that another line of their key fits."""
    rng = np.random.default_rng(1)
    for _ in range(100):
        rows = sorted((int(key) << 16 | int(id_) + 3, int(id_)) for key, id_ in zip(rng.integers(-4, 4, 40), rng.integers(0, 9, 40), strict=True))
        cuts = [0, *sorted(rng.integers(0, 41, 3).tolist()), 40]
        batches = [pa.RecordBatch.from_pydict({"at": pa.array([r[0] for r in rows[a:b]], pa.int64()), "id": pa.array([r[1] for r in rows[a:b]], pa.int64())}) for a, b in itertools.pairwise(cuts)]
        got = {tuple(r.values()) for out in line_dedup._meeting(4, 5)(iter(batches)) for r in out.to_pylist()}
        assert got == {(x & ~0xFFFF, i) for x, i in rows if any(x >> 16 == y >> 16 and i != j and 5 * min(i + 3, j + 3) >= 4 * max(i + 3, j + 3) for y, j in rows)}


def test_pairs_are_compared_by_whole_shingles():
    """Many pairs at once have the verdicts of sets, also with more kinds of characters than fit a number."""
    rng = random.Random(3)
    for letters in ("ab cd", "abcdefghij klm", "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))):
        pairs = []
        for _ in range(60):
            line = [rng.choice(letters) for _ in range(rng.randrange(1, 120))]
            other = [rng.choice(letters) if rng.random() < 0.02 else x for x in line]
            pairs.append(("".join(line), "".join(other)[: rng.randrange(1, 130)]))
        sets = [tuple(map(line_dedup.shingles, pair)) for pair in pairs]
        want = [5 * len(x & y) >= 4 * len(x | y) for x, y in sets]
        assert line_dedup._alike(pairs, 4, 5).tolist() == want
        assert any(want)
