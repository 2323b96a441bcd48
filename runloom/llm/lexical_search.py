"""Operator 11: exact ranked lexical search by a dual tree over items and documents.

Documents become narrow rows of the searched terms they hold. Each task orders its documents by
their leading term and builds two levels of nodes over them, as there are over the items; a node has
the greatest value of every coordinate below it. The product of a document node's and an item node's
maxima bounds the scores of all their pairs, so a pair of nodes is left out as a whole if that is
below the weakest kth score of its items. Nothing else is left out: the bound holds for every pair.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W

from runloom.llm.tables import SENT_ROWS, discard, saved, text_bytes

#: Terms are runs of these; A-Z are lower-cased, and nothing else is.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same for UTF-8 bytes: whatever ends a term is a space.
_BYTES = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
# The share of length in a document's m, and the scale of scores.
LENGTH, SCALE, UNIT = 75, 1_000_000_000, 1000
#: Items of a block, at most, and its terms but for a block of one item; a block is searched in one pass.
BLOCK_ITEMS, BLOCK_TERMS = 256, 8192
#: Documents of a leaf and leaves of a node; items of a node.
LEAF, FAN, ITEM_FAN = 32, 8, 8
#: Cells of a task's matrix of documents by terms.
CELLS = 1 << 22
#: One in so many documents is searched first, for scores that the search of all documents starts from.
SEED = 64


def term_list(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"({TERM})"), F.lit(1))


def _counted(known: dict[bytes, int]):
    """Batches of (row, doc_id, text in bytes) as doc_id, n, terms and tfs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, terms, tfs, ends = [], [], [], [], [0]
            for row, text in enumerate(batch.column("text")):
                words = (text.as_py() or b"").translate(_BYTES).split()
                if words:
                    for word, n in Counter(words).items():
                        if (term := known.get(word)) is not None:
                            terms.append(term)
                            tfs.append(n)
                    rows.append(row)
                    sizes.append(len(words))
                    ends.append(len(terms))
            kept = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("row", "doc_id")]
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), *lists], ["row", "doc_id", "n", "terms", "tfs"])

    return run


def _index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """row, doc_id, n, terms and tfs of every document with a term; only terms of the vocabulary (term, id) are listed. The vocabulary is sent to the tasks if it is short, else joined."""
    held = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    if vocabulary.limit(SENT_ROWS + 1).count() <= SENT_ROWS:
        known = {r["term"].encode(): r["id"] for r in vocabulary.collect()}
        kind = StructType([*held.select("row", "doc_id").schema.fields, *StructType.fromDDL("n long, terms array<long>, tfs array<long>").fields])
        return held.withColumn("text", text_bytes()).mapInArrow(_counted(known), kind)
    held = saved(held)
    sizes = held.select("row", "doc_id", F.size(term_list(F.col("text"))).cast("long").alias("n")).where("n > 0")
    counts = held.select("row", F.explode(term_list(F.col("text"))).alias("term")).groupBy("row", "term").agg(F.count("*").alias("tf")).join(vocabulary, "term")
    lists = counts.groupBy("row").agg(F.collect_list("id").alias("terms"), F.collect_list("tf").alias("tfs"))
    none = F.array().cast("array<long>")
    return sizes.join(lists, "row", "left").withColumns({c: F.coalesce(c, none) for c in ("terms", "tfs")})


class Items:
    """A block of items: weights by term, ordered so that items which share their heaviest term are neighbours, and the maxima of each ITEM_FAN of them."""

    def __init__(self, items: list[tuple[int, dict[int, int]]]) -> None:
        items = sorted(items, key=lambda x: (max(x[1].items(), key=lambda t: (t[1], t[0]))[0], x[0]))
        self.numbers = [number for number, _ in items]
        self.terms = np.unique(np.array([t for _, weights in items for t in weights], np.int64))
        exact = max(sum(weights.values()) for _, weights in items) * (SCALE // UNIT) < 1 << 53  # sums of doubles are then sums of whole numbers
        self.kind = np.float64 if exact else np.int64
        self.weights = np.zeros((len(items), len(self.terms)), self.kind)
        for i, (_, weights) in enumerate(items):
            self.weights[i, np.searchsorted(self.terms, list(weights))] = list(weights.values())
        self.starts = np.arange(0, len(items), ITEM_FAN)
        self.maxima = np.maximum.reduceat(self.weights, self.starts, axis=0)


class Best:
    """The best k documents of each item so far: score, whether it has an id, id, row. ``least`` is what a score must reach."""

    def __init__(self, floors: np.ndarray, k: int) -> None:
        self.rows: list[list[tuple]] = [[] for _ in floors]
        self.least, self.k = np.maximum(floors, 1).astype(np.int64), k

    def add(self, item: int, score: int, doc_id: Any, row: int) -> None:
        held = self.rows[item]
        insort(held, (-score, doc_id is None, 0 if doc_id is None else doc_id, row))
        if len(held) > self.k:
            held.pop()
        if len(held) == self.k:
            self.least[item] = max(self.least[item], -held[-1][0])


def _search(items: Items, floors: np.ndarray, k: int, documents: int, words: int):
    """Rows of the index as the best k of each item among a task's documents."""
    rows_at_once = max(LEAF, CELLS // len(items.terms))

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        """Documents by terms: what one unit of weight adds to the score."""
        lists = batch.column("terms")
        sizes = np.diff(np.asarray(lists.offsets))
        m = np.array([100 - LENGTH + LENGTH * n * documents // words for n in batch.column("n").to_pylist()], np.int64)
        term, tf = np.asarray(lists.flatten()), np.asarray(batch.column("tfs").flatten())
        at = np.minimum(np.searchsorted(items.terms, term), len(items.terms) - 1)
        own = items.terms[at] == term
        row = np.repeat(np.arange(len(sizes)), sizes)[own]
        out = np.zeros((batch.num_rows, len(items.terms)), items.kind)
        out[row, at[own]] = SCALE * tf[own] // (UNIT * tf[own] + 8 * m[row])
        return out

    def searched(batch: pa.RecordBatch, best: Best) -> None:
        values = matrix(batch)
        top = items.weights.max(axis=0)
        leading = (values * top).argmax(axis=1)
        order = np.lexsort((-values[np.arange(len(values)), leading], leading))
        values = values[order]
        ids, rows = batch.column("doc_id").take(pa.array(order)), np.asarray(batch.column("row"))[order]
        leaves = np.arange(0, len(values), LEAF)
        leaf_max = np.maximum.reduceat(values, leaves, axis=0)
        nodes = np.arange(0, len(leaves), FAN)
        node_max = np.maximum.reduceat(leaf_max, nodes, axis=0)
        node_bounds = node_max @ items.maxima.T
        for node in np.argsort(-node_bounds.max(axis=1), kind="stable"):  # promising ones first: scores rise early
            weakest = np.minimum.reduceat(best.least, items.starts)
            groups = np.flatnonzero(node_bounds[node] >= weakest)
            if not len(groups):
                continue
            below = range(nodes[node], min(nodes[node] + FAN, len(leaves)))
            leaf_bounds = leaf_max[below.start : below.stop] @ items.maxima[groups].T
            for leaf, bounds in zip(below, leaf_bounds, strict=True):
                weakest = np.minimum.reduceat(best.least, items.starts)
                open_ = groups[bounds >= weakest[groups]]
                if not len(open_):
                    continue
                members = (items.starts[open_][:, None] + np.arange(ITEM_FAN)).ravel()
                members = members[members < len(items.numbers)]
                members = members[leaf_max[leaf] @ items.weights[members].T >= best.least[members]]
                first = leaves[leaf]
                scores = (values[first : first + LEAF] @ items.weights[members].T).astype(np.int64)
                for doc, item in np.argwhere(scores >= best.least[members]).tolist():
                    number, score = int(members[item]), int(scores[doc, item])
                    if score >= best.least[number]:
                        best.add(number, score, ids[first + doc].as_py(), int(rows[first + doc]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = Best(floors, k), None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for start in range(0, batch.num_rows, rows_at_once):
                searched(batch.slice(start, rows_at_once), best)
        if kind is not None:
            found = [(items.numbers[i], None if no_id else doc_id, -low, row) for i, held in enumerate(best.rows) for low, no_id, doc_id, row in held]
            item, doc_id, score, row = zip(*found, strict=True) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc_id, kind), pa.array(score, pa.int64()), pa.array(row, pa.int64())], ["item", "doc_id", "score", "row"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best k of each item out of the tasks' best, with their rank. Spark keeps k of each task before it deals them out."""
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(items: Iterable) -> Iterator[list[tuple[int, dict[int, int]]]]:
    held: list[tuple[int, dict[int, int]]] = []
    terms: set[int] = set()
    for r in items:
        weights = {t["id"]: t["weight"] for t in r["weights"]}
        if held and (len(held) == BLOCK_ITEMS or len(terms | weights.keys()) > BLOCK_TERMS):
            yield held
            held, terms = [], set()
        held.append((r["item"], weights))
        terms |= weights.keys()
    if held:
        yield held


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's best ``k`` documents (doc_id, text) with a score above 0.

    Terms, weights and scores are as in the module's fixed values: a term weighs
    floor(1000 ln((2 N + 2) / (2 df + 1))), and a document's score sums weight times
    10^9 tf div (1000 tf + 8 m) over the item's terms, repeats included, in whole numbers. Equal
    scores go by doc_id, null last, then by row. Every row of ``items`` (item_id, text) is an item and
    every row of ``docs`` a document of its own, whatever its id; null texts have no terms. Items that
    no document scores for have no rows. Columns of other names are not read.

    Items are searched in blocks, one pass over the index for each; a block's items, not all, are on
    the driver at a time. A first pass over one in SEED documents finds scores to start from.
    """
    spark = docs.sparkSession
    numbered = saved(items.select(F.monotonically_increasing_id().alias("item"), "item_id", term_list(F.col("text")).alias("terms")))
    wanted = numbered.select("item", F.explode("terms").alias("term")).groupBy("item", "term").agg(F.count("*").alias("n"))
    vocabulary = saved(wanted.select("term").distinct().withColumn("id", F.monotonically_increasing_id()))
    index = saved(_index(docs, vocabulary))
    size = index.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    documents, words = size["documents"], size["words"]
    df = index.select(F.explode("terms").alias("id")).groupBy("id").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = wanted.join(vocabulary, "term").join(df, "id").select("item", "id", (weight * F.col("n")).alias("weight")).where("weight > 0")
    rows = saved(weighted.groupBy("item").agg(F.collect_list(F.struct("id", "weight")).alias("weights")))
    kind = StructType([*StructType.fromDDL("item long").fields, docs.select("doc_id").schema["doc_id"], *StructType.fromDDL("score long, row long").fields])
    out = spark.createDataFrame([], StructType([*kind.fields, *StructType.fromDDL("rank int").fields]))
    for held in _blocks(rows.orderBy("item").toLocalIterator()):
        block = Items(held)
        first = index.where(F.pmod(F.xxhash64("row"), F.lit(SEED)) == 0).mapInArrow(_search(block, np.zeros(len(held)), k, documents, words), kind)
        kth = dict(_best(first, k).where(F.col("rank") == k).select("item", "score").collect())  # at most one row for each item of the block
        floors = np.array([kth.get(number, 0) for number in block.numbers])
        out = out.unionByName(saved(_best(index.mapInArrow(_search(block, floors, k, documents, words), kind), k)))
    discard(index)
    return out.join(numbered.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
