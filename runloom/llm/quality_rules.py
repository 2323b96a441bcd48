"""Operator 7: quality rules by divergence from a language's usual distribution.

Each language has a reference: the shares of character classes, and the shares of its common words,
which are all words with a share of at least COMMON. A document is held against the reference of its language by the Jensen-Shannon distance of both
histograms. Short documents are not judged, as their histograms are mostly noise.

A reference is the mean of the histograms of all documents that are long enough to be judged by it,
so one rule holds at every size: a table repeated any number of times gives the same verdicts. All
documents have the same weight, so one long document of tables or code hardly moves the reference of
a small language. A language's only document agrees with its own reference.

Common words are found in two passes. In the first, each task counts the words of each language with
bounded memory, dropping rare words and remembering how much was dropped, and reports every word that
may have a share of SPOTTED in its part; a count here is a sum of shares of documents. What a word has over that floor, summed over the parts that
report it, plus the floors of all parts bounds its count from above; words whose bound stays below
COMMON are out, so about 1 / (COMMON - SPOTTED) a language are left. The second pass counts these exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.tables import discard, saved, text_bytes

COMMON, SPOTTED = 0.002, 0.0002
#: Counters of a language and task between two rounds of dropping.
COUNTERS = 16_384
#: References of so many languages, a few kilobytes each, are sent to all tasks; more are joined to their documents.
SENT_LANGUAGES = 2_000

_SPACE, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"


def _classes() -> np.ndarray:
    """Class of each byte: 0 lower case, 1 upper case, 2 digit, 3 space, 4 symbol, 5 other ASCII, 6 first byte beyond ASCII, 7 continuation."""
    kinds = np.full(256, 5)
    kinds[97:123], kinds[65:91], kinds[48:58] = 0, 1, 2
    kinds[list(_SPACE)], kinds[list(_SYMBOLS)] = 3, 4
    kinds[128:192], kinds[192:] = 7, 6
    return kinds


CLASS_OF = _classes()
N_CLASSES = 7


def class_counts(text: bytes) -> np.ndarray:
    """Characters of each class."""
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    return np.bincount(CLASS_OF, weights=seen, minlength=8)[:N_CLASSES]


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, in base 2: 0 to 1."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(x > 0, x * np.log2(x / m), 0.0).sum() for x in (p, q)]
    return float(np.sqrt(max(0.0, sum(parts) / 2)))


@dataclass(frozen=True)
class Limits:
    """Words that a document needs to be judged by each histogram, and the distance that fails it."""

    class_words: int = 100
    class_distance: float = 0.27
    word_words: int = 150
    word_distance: float = 0.36


def _spotted(limits: Limits):
    """Words that may be spotted, per language, with what they may have over a floor, and the documents, floor and character classes of a language (word null, counts). A task reports in several parts if it has many counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, _Part] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or b""
                if len(found := text.split()) >= min(limits.class_words, limits.word_words):
                    held.setdefault(lang, _Part(limits)).add(text, found)
            if sum(len(p.seen) for p in held.values()) > 64 * COUNTERS:
                yield from (p.report(lang) for lang, p in held.items())
                held = {}
        yield from (p.report(lang) for lang, p in held.items())

    return run


class _Part:
    """Counts of one language in a part of a task."""

    def __init__(self, limits: Limits) -> None:
        self.limits = limits
        self.seen: dict[bytes, float] = {}
        self.dropped, self.total, self.classes = 0.0, 0, np.zeros(N_CLASSES)

    def add(self, text: bytes, found: list[bytes]) -> None:
        if len(found) >= self.limits.class_words:
            classes = class_counts(text)
            self.classes += classes / classes.sum()
        if len(found) >= self.limits.word_words:
            self.total += 1
            _add_shares(self.seen, found)
        if len(self.seen) > COUNTERS:
            least = float(np.partition(np.fromiter(self.seen.values(), float, len(self.seen)), COUNTERS // 4)[COUNTERS // 4])
            self.seen = {w: n for w, n in self.seen.items() if n > least}
            self.dropped += least

    def report(self, lang: str | None) -> pa.RecordBatch:
        floor = max(SPOTTED * self.total, self.dropped)  # no word that is not reported has more
        found = [(w, n + self.dropped - floor) for w, n in self.seen.items() if n + self.dropped >= floor]
        names, over = [None, *(w for w, _ in found)], [None, *(x for _, x in found)]
        counts = [[float(self.total), floor, *self.classes], *[None] * len(found)]
        columns = [pa.array([lang] * len(names), pa.string()), pa.array(names, pa.binary()), pa.array(over, pa.float64()), pa.array(counts, pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, ["lang", "word", "over", "counts"])


def _add_shares(seen: dict[bytes, float], found: list[bytes], among: frozenset[bytes] | None = None) -> None:
    """Adds each word's share of the words ``found`` in a document."""
    for word, n in Counter(found if among is None else filter(among.__contains__, found)).items():
        seen[word] = seen.get(word, 0.0) + n / len(found)


def _counted(candidates: dict[str | None, frozenset[bytes]] | None, limits: Limits):
    """Sums of shares of the candidates, or of all words, in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str | None, dict[bytes, float]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                if (text := text.as_py()) and (candidates is None or lang in candidates) and len(found := text.split()) >= limits.word_words:
                    _add_shares(seen.setdefault(lang, {}), found, candidates and candidates[lang])
            rows = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
            langs, names, counts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(names, pa.binary()), pa.array(counts, pa.float64())], ["lang", "word", "n"])

    return run


@dataclass(frozen=True)
class Reference:
    """classes: sums of the shares of each character class; words: the common words; counts: sums of the shares of each of them, and of all other words."""

    classes: np.ndarray
    words: tuple[bytes, ...]
    counts: np.ndarray


def references(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """The reference of each language of ``docs`` (lang, text) that has a document to be judged: lang, classes, words and counts; a written table."""
    held = docs.select("lang", text_bytes())
    spotted = saved(held.mapInArrow(_spotted(limits), "lang string, word binary, over double, counts array<double>"))
    sums = [F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(N_CLASSES + 2)]
    totals = spotted.where("word is null").groupBy(F.col("lang").alias("_lang")).agg(*sums)
    totals = saved(totals.select("_lang", F.col("c0").alias("total"), F.col("c1").alias("floor"), F.array(*(f"c{i}" for i in range(2, N_CLASSES + 2))).alias("classes")))
    same = F.col("lang").eqNullSafe(F.col("_lang"))
    over = spotted.where("word is not null").groupBy("lang", "word").agg(F.sum("over").alias("over"))
    likely = saved(over.join(totals, same).where(F.col("over") + F.col("floor") >= COMMON * F.col("total") * (1 - 1e-9)).select("lang", "word"))
    candidates = None
    if totals.limit(SENT_LANGUAGES + 1).count() <= SENT_LANGUAGES:  # about 1 / (COMMON - SPOTTED) words a language
        candidates = {r["lang"]: frozenset(map(bytes, r["words"])) for r in likely.groupBy("lang").agg(F.collect_list("word").alias("words")).collect()}
    counted = held.mapInArrow(_counted(candidates, limits), "lang string, word binary, n double").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    if candidates is None:
        x, y = counted.alias("x"), likely.alias("y")
        counted = x.join(y, F.col("x.lang").eqNullSafe(F.col("y.lang")) & (F.col("x.word") == F.col("y.word")), "left_semi")
    common = counted.join(totals.select("_lang", "total"), same).where(F.col("n") >= COMMON * F.col("total") * (1 - 1e-9))
    listed = common.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("common"))
    made = totals.join(listed, same, "left").select(F.col("_lang").alias("lang"), "total", "classes", F.coalesce("common", F.array().cast("array<struct<word: binary, n: double>>")).alias("common"))
    known = F.aggregate("common", F.lit(0.0), lambda a, x: a + x["n"])
    counts = F.concat(F.transform("common", lambda x: x["n"]), F.array(F.greatest(F.col("total") - known, F.lit(0.0))))
    out = saved(made.select("lang", "classes", F.col("common.word").alias("words"), counts.alias("counts")))
    discard(spotted, likely, totals)
    return out


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number = dict(zip(dict.fromkeys(words), range(len(words)), strict=False))
    if len(number) == len(words):
        return 0
    codes = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    keys = codes[:n]
    for i in range(1, size):  # numbers of distinct windows of each length, so that they fit 64 bits at any length
        keys = np.unique(keys, return_inverse=True)[1] * len(number) + codes[i : i + n] if len(number) > 2_000_000 else keys * len(number) + codes[i : i + n]
    order = np.sort(keys)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    again, held = np.isin(keys, twice), np.zeros(len(words), bool)
    for i in range(size):
        held[i : i + n] |= again
    return int(held.sum())


def _reference(classes: list, words: list, counts: list) -> Reference:
    return Reference(np.array(classes, float), tuple(map(bytes, words)), np.array(counts, float))


def _row_references(batch: pa.RecordBatch) -> Iterator[Reference | None]:
    """The reference that each row brings along; rows of a language mostly follow each other."""
    before, ref = None, None
    for row in zip(batch.column("lang").to_pylist(), *(batch.column(c) for c in ("classes", "words", "counts")), strict=True):
        if before is None or row[0] != before[0]:
            before, ref = row, _reference(*(c.as_py() for c in row[1:])) if row[1].is_valid else None
        yield ref


def _judged(refs: dict[str | None, Reference] | None, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            known = _row_references(batch) if refs is None else map(refs.get, batch.column("lang").to_pylist())
            for ref, text in zip(known, batch.column("text"), strict=True):
                text = text.as_py() or b""
                words, classes = text.split(), class_counts(text)
                lines = [line for line in text.split(b"\n") if line.strip()]
                by_class = by_word = None
                if ref is not None:
                    if len(words) >= limits.class_words:
                        by_class = js_distance(classes, ref.classes)
                    if len(words) >= limits.word_words:
                        seen = Counter(words)
                        common = [seen[w] for w in ref.words]
                        by_word = js_distance(np.array([*common, len(words) - sum(common)], float), ref.counts)
                rows.append((len(words), int(classes.sum() - classes[3]), int(classes[4]), len(lines) - len(set(lines)), repeated_words(words), by_class, by_word))
            columns = zip(*rows, strict=True) if rows else [()] * 7
            kinds = [pa.int64()] * 5 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], _NAMES)

    return run


_NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance"]


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Base counts, distances and verdict of every row of ``docs`` (doc_id, text, lang; others are ignored).

    base_failed: fewer than 50 words, or more than half of the words in repeated windows of three.
    kept: not base_failed, and no distance above its limit. A distance is null, and does not fail a
    document, if the document is too short for it; null is a language like others. Null and empty texts have no words and fail. Repeated rows get equal
    results; an empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    found, held, refs = references(docs, limits), docs.select("doc_id", "lang", text_bytes()), None
    if found.limit(SENT_LANGUAGES + 1).count() <= SENT_LANGUAGES:
        refs = {r["lang"]: _reference(*r[1:]) for r in found.collect()}
    else:
        of = found.withColumnRenamed("lang", "_lang")
        held = held.join(of, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    judged = held.mapInArrow(_judged(refs, limits), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    near = (F.coalesce("class_distance", F.lit(0.0)) <= limits.class_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= limits.word_distance)
    return judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & near).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
