"""Operator 3: join of texts by the Jaccard similarity of their word n-grams.

Parity sketches. A set of n-grams is hashed into a row of blocks; each n-gram changes one block by
exclusive or, in 64 bits that name it and in one bit of a smaller row. Two sets whose symmetric
difference is d differ in at most d blocks (and in at most d bits: the Hamming distance bounds the
symmetric difference from below). Sets of similar size share a size band, all sketches of a band
have the same number of blocks, and that number exceeds the greatest difference that the similarity
allows, so two similar sets agree in a whole block (pigeonhole). Joining on (band, block, value)
therefore misses no pair, and as the value names the block's members, sets that have none of them
in common do not meet. Where no difference is allowed between sets of a size, only equal ones link.

A set of size s in a band of D blocks has partners that agree with it in at least D - d(s) blocks,
so it may leave out the first D - d(s) - 1 blocks of an order that all sets of the band share: of the
agreeing blocks, the last one in that order stays on both sides. The order is by set bits, so empty
and nearly empty blocks, which many sets share, are left out first. Two sets whose last agreeing
block is empty are found under another seed, named by the block. At low similarities small sets
would mostly have empty blocks; each of their members is a block of its own.

Candidates are first compared by a second sketch, one of several bits for each member of the sets:
a pair whose sketches differ in more bits than similar sets of these sizes can is no pair. What is
left is verified on the sets.

Equal sets are one class and only one representative of each is joined. See linking.py for how sets
that share a key are compared.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.linking import linked
from runloom.llm.tables import by_row, discard, keep_ids, own_ids, saved, text_bytes

#: Sketches of a set that has empty blocks under one seed after the other.
DEEPEST = 8
#: A comparing sketch has MARK_BITS to twice that for each member of a set, up to MOST_BITS in all.
MARK_BITS, MOST_BITS = 4, 1 << 15
_WORDS_KEPT = 200_000
_ODD = 0x9E3779B97F4A7C15


class _WordHash(dict):
    """Word to 64-bit hash; forgets all when it has grown."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, n: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text, A-Z lower-cased."""
    words = (text or b"").lower().split()  # of bytes, both are ASCII only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)], np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    last = len(words) - n + 1
    total, factor = np.zeros(last, np.uint64), 1
    for i in range(n):
        factor = factor * 0xD6E8FEB86659FD93 % 2**64
        total += codes[i : i + last] * np.uint64(factor)
    return np.unique(_mix(total))


class Threshold:
    """Similarity num/den in whole numbers."""

    def __init__(self, num: int, den: int):
        if not 0 < num <= den:
            raise ValueError("the similarity must be above 0 and at most 1")
        self.num, self.den, self.edges, self._blocks = num, den, [1], {}

    def band(self, size: int) -> int:
        """Size band: a band ends where the largest partner of its smallest size's largest partner does, so partners are at most one band apart."""
        while self.edges[-1] <= size:
            self.edges.append(self.partner(self.partner(self.edges[-1])) + 1)
        return bisect_right(self.edges, size) - 1

    def top(self, band: int) -> int:
        """Largest size of a band whose smaller ones have been asked for."""
        return self.partner(self.partner(self.edges[band]))

    def blocks(self, band: int) -> int:
        """Blocks of a band's sketches: a few more than the greatest difference, or as many as it takes for hardly any set to keep an empty one; 0 if none will do."""
        if band not in self._blocks:
            top, low = self.top(band), self.edges[band]
            sizes = {max(1, low * self.num // self.den), low, top}
            tried = [self.difference(top, top) * 11 // 10 + 1]
            while tried[-1] < 3 * top + 3:
                tried.append(tried[-1] * 5 // 4 + 1)

            def kept_empty(blocks: int) -> float:
                empty = ((blocks * math.exp(-s / blocks), self.difference(s, min(self.partner(s), top)) + 1) for s in sizes)
                return max(need * max(0.0, e + math.sqrt(e) - blocks + need) for e, need in empty)

            self._blocks[band] = next((b for b in tried if kept_empty(b) < 0.5), 0)
        return self._blocks[band]

    def partner(self, size: int) -> int:
        """Size of the largest partner."""
        return size * self.den // self.num

    def difference(self, a: int, b: int) -> int:
        """Greatest symmetric difference of similar sets of these sizes."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)


def _block_keys(grams: np.ndarray, blocks: int, need: int, seed: int, depth: int = 0) -> list[int]:
    """Keys of the last ``need`` blocks of a sketch. For an empty block, which tells nothing, keys of the set's sketch under another seed stand in."""
    spread = _mix(grams + np.uint64(seed))
    block = (spread % np.uint64(blocks)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    sketch, whole, at = np.zeros(blocks, np.uint64), np.zeros(blocks, np.uint64), block[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    sketch[at[first]] = np.bitwise_xor.reduceat((np.uint64(1) << (spread >> np.uint64(58)))[order], first)
    whole[at[first]] = np.bitwise_xor.reduceat(grams[order], first)
    kept = np.lexsort((np.bitwise_count(sketch), whole != 0))[-need:]
    names = _mix(np.uint64(seed) ^ (kept + 1).astype(np.uint64) * np.uint64(_ODD))
    full = whole[kept] != 0
    keys = _mix(whole[kept] ^ names)[full | (depth == DEEPEST)].tolist()
    for name in names[~full].tolist() if depth < DEEPEST else ():
        keys += _block_keys(grams, blocks, need, name, depth + 1)
    return keys


def band_keys(grams: np.ndarray, t: Threshold) -> list[int]:
    """Keys of the blocks that a set is joined on, over its size bands; none where its size links with equal sets only.

    A set is at home in the band of its size and a guest in the next one if it may have a partner there.
    """
    size, keys = len(grams), []
    if not size:
        return keys
    for band in range(t.band(size), t.band(t.partner(size)) + 1):
        top = t.top(band)
        if apart := t.difference(size, min(t.partner(size), top)):
            seed, blocks = band * _ODD % 2**64, t.blocks(band)
            keys += _block_keys(grams, blocks, apart + 1, seed) if blocks else _mix(grams ^ np.uint64(seed)).tolist()
    return keys


def parity(grams: np.ndarray, band: int, top: int) -> np.ndarray:
    """The comparing sketch of a band: bit i tells whether an odd number of members fall on i. Larger sets share MOST_BITS bits, which only weakens the bound."""
    bits = min(max(64, MARK_BITS << top.bit_length()), MOST_BITS)
    spread = _mix(grams ^ np.uint64(~band * _ODD % 2**64)) % np.uint64(bits)
    return np.packbits((np.bincount(spread.astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


_MADE = "doc_id long, n_shingles long, high long, low long, keys array<long>"
_SETS = "id long, n long, band int, sketch array<long>, above array<long>, folded array<long>, grams binary"
#: Longs that a sketch is folded to.
FOLD = 8


def _named(kinds: str) -> list[str]:
    return [c.split()[0] for c in kinds.split(", ")]


def _classes(n: int, t: Threshold):
    """A row for each text: size and digest of its set, and its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHash()
        for batch in batches:
            numbers, keys = [], []
            for text in batch.column("text"):
                grams = shingle_set(text.as_py(), n, hashes)
                digest = xxhash.xxh128_digest(grams.tobytes())
                numbers.append((len(grams), *(int.from_bytes(half, "big", signed=True) for half in (digest[:8], digest[8:]))))
                keys.append(np.array(band_keys(grams, t), np.uint64).view(np.int64))
            columns = zip(*numbers, strict=True) if numbers else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), _lists(keys)], _named(_MADE))

    return run


def _folded(sketch: np.ndarray) -> np.ndarray:
    """A sketch whose bits are gathered in FOLD longs by exclusive or: it differs from another in no more bits than before."""
    whole = np.zeros(max(FOLD, len(sketch)), np.int64)  # lengths are powers of two
    whole[: len(sketch)] = sketch
    return np.bitwise_xor.reduce(whole.reshape(-1, FOLD), axis=0)


def _sets(n: int, t: Threshold):
    """A row for each text: its set, and sketches for its home band and, if it is a guest there, the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHash()
        for batch in batches:
            for part in range(0, len(batch), 500):
                rows = batch.slice(part, 500)
                sizes, bands, sketches, above, held = [], [], [], [], []
                for text in rows.column("text"):
                    grams = shingle_set(text.as_py(), n, hashes)
                    size = max(1, len(grams))
                    band = t.band(size)
                    sizes.append(len(grams))
                    bands.append(band)
                    sketches.append(parity(grams, band, t.top(band)))
                    above.append(parity(grams, band + 1, t.top(band + 1)) if t.band(t.partner(size)) > band else np.empty(0, np.int64))
                    held.append(grams.tobytes())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(bands, pa.int32()), _lists(sketches), _lists(above), _lists([np.concatenate([_folded(x), _folded(y)]) for x, y in zip(sketches, above, strict=True)]), pa.array(held, pa.binary())], _named(_SETS))

    return run


def _similar(t: Threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch.column("grams_a"), batch.column("grams_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                kept.append(t.den * both >= t.num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def _near(t: Threshold):
    """Whether two marks' sketches differ in no more bits than similar sets of their sizes can. Folded ones tell most pairs apart at less cost."""

    def near(x: str, y: str) -> Column:
        x, y = F.col(x), F.col(y)
        x_low, y_low = x["band"] < y["band"], y["band"] < x["band"]
        most = (x["n"] + y["n"]) * (t.den - t.num)
        folds = [F.when(x_low, x["folded"][FOLD + i]).otherwise(x["folded"][i]).bitwiseXOR(F.when(y_low, y["folded"][FOLD + i]).otherwise(y["folded"][i])) for i in range(FOLD)]
        bits_x, bits_y = F.when(x_low, x["above"]).otherwise(x["sketch"]), F.when(y_low, y["above"]).otherwise(y["sketch"])
        distance = F.aggregate(F.zip_with(bits_x, bits_y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0).cast("long"), lambda total, bits: total + bits)
        return (sum(map(F.bit_count, folds), F.lit(0)).cast("long") * (t.den + t.num) <= most) & (distance * (t.den + t.num) <= most)

    return near


def ngram_jaccard_components(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text; more columns are ignored).

    Two documents link when den * |intersection| >= num * |union| of their sets of word n-grams;
    component_id is the smallest doc_id reachable by links. A text of fewer words is one n-gram. A
    text without words (or null) has an empty set, links with nothing and is its own component.
    Every row is a document of its own, whatever its doc_id: rows that share one are compared by
    their own texts, and rows without one link others too; component_id is null where no row of the
    component has an id. An empty table gives none. Ids that are missing or repeated cost one more
    table of the texts, as rows are then numbered.
    """
    t, docs = Threshold(num, den), docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if own_ids(docs):
        return _components(docs, n, t)
    rows = by_row(docs)
    found = saved(_components(rows.select(F.col("row").alias("doc_id"), "text"), n, t))
    placed = rows.select("row", "doc_id").join(found.select(F.col("doc_id").alias("row"), "n_shingles", F.col("component_id").alias("group")), "row")
    named = placed.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return placed.join(named, "group").select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, n: int, t: Threshold) -> DataFrame:
    """The same for documents of which each has a doc_id of its own."""
    made = saved(docs.select("doc_id", text_bytes()).mapInArrow(_classes(n, t), _MADE))
    members = made.select("doc_id", "n_shingles", "high", "low")
    classes = saved(members.where("n_shingles > 0").groupBy("high", "low").agg(F.min("doc_id").alias("id")))
    reps = made.join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    kept: list[DataFrame] = []

    def nodes(shared: DataFrame) -> DataFrame:
        """Sets and sketches of the ids that share keys, written once."""
        held = keep_ids(docs, shared.select(F.col("id").alias("doc_id")), "doc_id").select("doc_id", text_bytes())
        kept.append(saved(held.mapInArrow(_sets(n, t), _SETS)))
        return kept[0].select("id", "n", F.struct("n", "band", "sketch", "above", "folded").alias("mark"))

    def verifier(_: DataFrame):
        a, b = (kept[0].select(F.col("id").alias(x), F.col("grams").alias(f"grams_{x}")) for x in "ab")
        return lambda pairs: saved(pairs.join(a, "a").join(b, "b").mapInArrow(_similar(t), "a long, b long"))

    fits = lambda x, y: F.least(x, y) * F.lit(t.den) >= F.greatest(x, y) * F.lit(t.num)
    found = linked(reps.select(F.explode("keys").alias("key"), F.col("doc_id").alias("id")), nodes, fits, _near(t), verifier)
    discard(*kept)

    labels = classes.join(found, "id", "left").select("high", "low", F.coalesce("component", "id").alias("component"))
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return members.join(labels, ["high", "low"], "left").select("doc_id", "n_shingles", own.alias("component_id"))


