"""Operator 2: benchmark passages in training texts, by a positional inverted index.

Items are cut into windows of consecutive words. The corpus frequency of every item word is counted
over all texts, and each window keeps its rarest words that occur as anchors. The index holds the
postings (term, document, position) of all anchor terms of the corpus; those of a first anchor also
carry the words around the position, and count only where most of the window's words are among them.
Lists of a window's anchors are shifted by the anchors' offsets in the window and intersected on
(document, window): starts that are equal, with all words in place, are exact matches; starts that
lie up to a few words apart, or equal ones with a word replaced, are proximity matches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from runloom.llm.tables import SENT_ROWS, by_row, discard, keep_ids, own_ids, saved, text_bytes

#: At most this many anchors, each with the words of its window, are sent to all tasks; more are joined.
SENT_ANCHORS = 200_000
#: Lower-cases A-Z and turns every other ASCII byte that is no digit or letter into a blank.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


def _column(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind)


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, starts, phrases = [], [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text"), strict=True):
                words = words_of(text.as_py())
                for i in range(max(len(words) - width + 1, bool(words))):
                    items.append(item)
                    starts.append(i)
                    phrases.append([w.decode(errors="replace") for w in words[i : i + width]])
            yield pa.RecordBatch.from_arrays([_column(items, pa.string()), _column(starts, pa.int32()), _column(phrases, pa.list_(pa.string()))], ["item", "first", "phrase"])

    return run


def _counts(terms: frozenset[bytes] | None):
    """Count of each term in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column("text"):
                words = words_of(text.as_py())
                seen.update(words if terms is None else filter(terms.__contains__, words))
            yield pa.RecordBatch.from_arrays([_column([w.decode(errors="replace") for w in seen], pa.string()), _column(list(seen.values()), pa.int64())], ["term", "n"])

    return run


def _postings(terms: frozenset[bytes] | None, leaders: frozenset[bytes] | None, width: int):
    """A row for each occurrence of a term, and one without a term for each document, with the number of its words as position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, len(batch), 1000):
                docs, found, at, lead, around = [], [], [], [], []
                rows = batch.slice(part, 1000)
                for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text"), strict=True):
                    words = words_of(text.as_py())
                    docs.append(doc)
                    found.append(None)
                    at.append(len(words))
                    lead.append(None)
                    around.append(None)
                    for i in range(len(words)) if terms is None else [i for i, w in enumerate(words) if w in terms]:
                        docs.append(doc)
                        found.append(words[i].decode(errors="replace"))
                        at.append(i)
                        if leaders is None or words[i] in leaders:
                            a = max(0, i - width + 1)
                            lead.append(i - a)
                            around.append(b" ".join(words[a : i + width]).decode(errors="replace"))
                        else:
                            lead.append(None)
                            around.append(None)
                yield pa.RecordBatch.from_arrays([_column(docs, pa.int64()), _column(found, pa.string()), _column(at, pa.int64()), _column(lead, pa.int32()), _column(around, pa.string())], ["doc_id", "term", "pos", "lead", "around"])

    return run


def _listed(terms: DataFrame) -> frozenset[bytes] | None:
    """The terms of a one-column table, or None if they are too many to be sent to all tasks."""
    rows = terms.limit(SENT_ROWS + 1).collect()
    return None if len(rows) > SENT_ROWS else frozenset(r[0].encode() for r in rows)


def windows(items: DataFrame, width: int = 10) -> DataFrame:
    """item, first and phrase of every window of ``items`` (item_id, text). Fewer words, but not none, are one window."""
    return items.select(F.col("item_id").cast("string").alias("item_id"), text_bytes()).mapInArrow(_windows(width), "item string, first int, phrase array<string>")


def anchors(docs: DataFrame, wins: DataFrame, rarest: int = 2) -> DataFrame:
    """The ``rarest`` words of each window among those that occur in ``docs``: item, first, phrase, n_anchors, rank (0: rarest), term, offset."""
    words = wins.select("item", "first", "phrase", F.posexplode("phrase").alias("offset", "term"))
    vocabulary = wins.select(F.explode("phrase").alias("term")).distinct()
    counts = docs.select(text_bytes()).mapInArrow(_counts(_listed(vocabulary)), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = saved(vocabulary.join(counts, "term"))
    window = W.partitionBy("item", "first", "phrase")
    ranked = words.join(counts, "term").withColumns({"rank": F.row_number().over(window.orderBy("n", "offset")) - 1, "n_anchors": F.least(F.count("*").over(window), F.lit(rarest))})
    return saved(ranked.where(F.col("rank") < rarest).select("item", "first", "phrase", "n_anchors", "rank", "term", "offset"))


def build_index(docs: DataFrame, anchor: DataFrame, width: int = 10) -> DataFrame:
    """The written index: doc_id, term, pos, lead, around; and a row without a term for each document (pos: its words)."""
    terms, leaders = _listed(anchor.select("term").distinct()), _listed(anchor.where("rank = 0").select("term").distinct())
    index = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(_postings(terms, leaders, width), "doc_id long, term string, pos long, lead int, around string")
    return saved(index)


def matches(index: DataFrame, anchor: DataFrame, slop: int = 2, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, item, first, start, width, exact and gap of exact and proximity matches of windows, a written table.

    Exact: all words of the window follow each other from start on (gap 0). Proximity: the two rarest
    words of the window that occur stand up to ``slop`` words off their distance in the window, or as
    far apart as there with another word between or beside them, and at least ``share`` of the window's
    distinct words are among those around the first. A window of which only one word occurs has none.
    """
    phrase, near = F.col("phrase"), F.split("around", " ")
    most = share[1] * F.size(F.array_intersect(phrase, near)) >= share[0] * F.size(F.array_distinct(phrase))
    whole = F.expr("lead >= offset and slice(split(around, ' '), lead - offset + 1, size(phrase)) = phrase")
    start = (F.col("pos") - F.col("offset")).alias("start")
    few = anchor.limit(SENT_ANCHORS + 1).count() <= SENT_ANCHORS
    firsts, rest = (F.broadcast(x) if few else x for x in (anchor.where("rank = 0"), anchor.where("rank > 0")))
    leading = index.where("lead is not null").join(firsts, "term").where(most)
    leading = saved(leading.select("doc_id", "item", "first", start, F.size("phrase").alias("width"), whole.alias("whole"), "n_anchors"))
    known = leading.where("doc_id is not null").select("doc_id").distinct()
    postings = index.where("term is not null")
    postings = keep_ids(postings, known, "doc_id").unionByName(postings.where("doc_id is null"))
    others = postings.join(rest, "term").select("doc_id", "item", "first", "rank", start)
    here = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("doc_id", "item", "first")]
    gap = F.col("y.start") - F.col("x.start")
    pairs = leading.alias("x").join(others.alias("y"), here, "left").select("x.*", "y.rank", gap.alias("gap"))
    each = pairs.groupBy("doc_id", "item", "first", "start", "width", "whole", "n_anchors").agg(
        F.count_distinct(F.when(F.col("gap") == 0, F.col("rank"))).alias("met"), F.min_by("gap", F.when((F.col("rank") == 1) & (F.abs("gap") <= slop), F.struct(F.abs("gap"), "gap"))).alias("gap")
    )
    exact = F.col("whole") & (F.col("met") == F.col("n_anchors") - 1)
    found = each.withColumn("exact", exact).where(F.col("exact") | F.col("gap").isNotNull())
    found = saved(found.select("doc_id", "item", "first", "start", "width", "exact", F.when(F.col("exact"), F.lit(0).cast("long")).otherwise(F.col("gap")).alias("gap")))
    discard(leading)
    return found


def exact_matches(index: DataFrame, anchor: DataFrame) -> DataFrame:
    """doc_id, item, start and width of every place where all words of a window follow each other."""
    return matches(index, anchor).where("exact").select("doc_id", "item", "start", "width")


def proximity_matches(index: DataFrame, anchor: DataFrame, slop: int) -> DataFrame:
    """doc_id, item, first, start and gap of the places of matches() that are not exact."""
    return matches(index, anchor, slop).where("not exact").select("doc_id", "item", "first", "start", "gap")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, rarest: int = 2, slop: int = 2, near: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and, with ``near``, n_near of every row of ``docs`` (doc_id, text).

    Words are runs of digits, lower-cased A-Z and characters beyond ASCII. A word is hit if it lies in
    an occurrence of a window of an item (item_id, text). n_near is the number of items without such
    an occurrence that have proximity matches; these do not make a document contaminated. A text or item that is null or empty has no
    words; such an item has no window. Without items, or without documents, nothing is hit. Every row
    is judged by its own text, whatever its doc_id; ids that are missing or repeated cost one more
    table of the texts, as rows are then numbered. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    if own_ids(docs):
        return _decontaminate(docs, items, width, rarest, slop, near)
    rows = by_row(docs)
    found = _decontaminate(rows.select(F.col("row").alias("doc_id"), "text"), items, width, rarest, slop, near)
    return rows.select("row", "doc_id").join(found.withColumnRenamed("doc_id", "row"), "row").drop("row")


def _decontaminate(docs: DataFrame, items: DataFrame, width: int, rarest: int, slop: int, near: bool) -> DataFrame:
    """The same for documents of which each has a doc_id of its own."""
    wins = saved(windows(items.select("item_id", "text"), width))
    anchor = anchors(docs, wins, rarest)
    index = build_index(docs, anchor, width)
    found = matches(index, anchor, slop)
    exact = found.where("exact")
    before = F.max(F.col("start") + F.col("width")).over(W.partitionBy("doc_id").orderBy("start", "width").rowsBetween(W.unboundedPreceding, -1))
    spans = exact.select("doc_id", "start", "width").distinct()
    hit = spans.withColumn("new", F.greatest(F.lit(0), F.col("start") + F.col("width") - F.greatest("start", F.coalesce(before, F.lit(0))))).groupBy("doc_id").agg(F.sum("new").alias("n_hit"))
    listed = found.groupBy("doc_id", "item").agg(F.max("exact").alias("exact")).groupBy("doc_id").agg(
        F.count_if("exact").alias("n_items"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item")))), ",").alias("items"), F.count_if(~F.col("exact")).alias("n_near")
    )
    hits = listed.alias("l").join(hit.alias("h"), F.col("h.doc_id").eqNullSafe(F.col("l.doc_id")), "left").select(F.col("l.doc_id").alias("hit_id"), "n_hit", "n_items", "items", "n_near")
    rows = index.where("term is null").select("doc_id", F.col("pos").alias("n_words"))
    count = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_hit", "n_items", "n_near")}
    return rows.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").select(
        "doc_id", "n_words", count["n_hit"].alias("n_hit"), count["n_items"].alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (count["n_hit"] > 0).alias("contaminated"), *([count["n_near"].alias("n_near")] if near else []),
    )
