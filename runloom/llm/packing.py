"""Operator 12: best-fit packing of whole documents into sequences of a fixed number of tokens.

Documents are tokenized where they lie and leave as narrow rows of pieces. There are only as many
different lengths as a sequence has tokens, so the packing is worked out over the numbers of pieces
of each length, whatever the size of the corpus: combinations of lengths that exactly fill a
sequence are found by hashing sums of one, two and three lengths and are taken as often as their
pieces last; what is left goes by best fit, longest first. Pieces are then numbered within their
length, and the number names the sequence and the place.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window as W

from runloom.llm.tables import SENT_ROWS, saved

LIMIT = 2048
#: Ends each document.
END = 0
#: Texts are handled in slices of about so many bytes.
SLICE = 8 << 20
#: White space of any kind before a space: there, parts of a text cut at spaces would get other ids than the text has.
SPACES = r"[\x09-\x0D\x{85}\p{Z}]"

Slots = list[tuple[int, int]]


class Encoder:
    """Ids of texts by a byte-level tokenizer, each part between spaces encoded once and remembered, up to ``most`` parts."""

    def __init__(self, path: str, most: int = 1 << 20, longest: int = 64) -> None:
        from tokenizers import Tokenizer

        self.model, self.most, self.longest = Tokenizer.from_file(path), most, longest
        added = {i: len(token.content.encode()) for i, token in self.model.get_added_tokens_decoder().items()}
        vocabulary = self.model.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.width[i] = added.get(i) or len(token)  # a character of the vocabulary is a byte of the text
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts = [0]

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        first = len(self.starts) - 1
        self.starts.extend((self.used + np.cumsum(sizes)).tolist())
        self.used += len(ids)
        return range(first, first + len(sizes))

    def _learn(self, parts: list[str], joined: bool) -> range:
        """Slots of new parts. Parts that begin with a space and end without one may be encoded as one text, as ids end where they do."""
        if joined:
            ids = np.array(self.whole(["".join(parts)])[0], np.uint32)
            ends, cuts = np.cumsum(self.width[ids]), np.cumsum([len(p.encode()) for p in parts])
            at = np.searchsorted(ends, cuts)
            if len(ids) and at[-1] < len(ends) and (ends[at] == cuts).all():
                return self._add(ids, np.diff(at, prepend=-1))
        each = self.whole(parts)
        return self._add(np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each], np.int64))

    def slots_of(self, parts: list[str], joined: bool) -> np.ndarray:
        out = np.fromiter((self.slots.get(p, -1) for p in parts), np.int64, len(parts))
        new = np.flatnonzero(out < 0)
        for start in range(0, len(new), 16384):
            chunk = new[start : start + 16384]
            texts = [parts[i] for i in chunk]
            found = self._learn(texts, joined)
            out[chunk] = found
            self.slots.update((p, s) for p, s in zip(texts, found, strict=True) if len(p) <= self.longest)
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null is empty."""
        if len(self.slots) > self.most or self.used > 16 * self.most:
            self.clear()
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, SPACES + " ")
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        odd_rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
        for i in odd_rows.tolist():
            out[i] = np.array(self.whole([texts[i].as_py()])[0], np.uint32)
        rows = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
        if not len(rows):
            return out
        cut = pc.split_pattern(texts.take(pa.array(rows)) if len(odd_rows) else texts, " ")
        offsets = np.asarray(cut.offsets)
        offsets = offsets - offsets[0]
        coded = cut.flatten().dictionary_encode()
        known = coded.dictionary
        ends_in_space = pc.or_(pc.match_substring_regex(known, SPACES + "$"), pc.equal(known, "")).to_numpy(zero_copy_only=False)
        slots = np.zeros(len(known), np.int64)
        for joined, where in ((True, np.flatnonzero(~ends_in_space)), (False, np.flatnonzero(ends_in_space))):
            slots[where] = self.slots_of([" " + p for p in known.take(pa.array(where)).to_pylist()], joined)
        at = slots[np.asarray(coded.indices)]
        at[offsets[:-1]] = self.slots_of(cut.flatten().take(pa.array(offsets[:-1])).to_pylist(), False)  # a text's first part has no space before it
        starts = np.array(self.starts)
        sizes = (starts[1:] - starts[:-1])[at]
        before = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.ids[np.repeat(starts[at] - before[:-1], sizes) + np.arange(before[-1])]
        bounds = before[offsets]
        for i, a, b in zip(rows.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            out[i] = flat[a:b]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + SLICE, side="right")))
        yield start, end
        start = end


def _pieces(path: str, limit: int):
    """Batches of (doc_id, text) as pieces, the pieces of a length numbered within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [0] * (limit + 1)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            for start, end in _slices(texts):
                rows: list[tuple[int, int, int, int, int, int]] = []
                for row, ids in enumerate(encoder(path).encode(texts.slice(start, end - start)), start):
                    own = np.append(ids, np.uint32(END)).astype("<u4")
                    at, length = 0, (len(own) - 1) % limit + 1  # the first piece takes what full ones leave
                    piece = 0
                    while at < len(own):
                        rows.append((row, piece, at, length, crc32(own[at : at + length].tobytes()), seen[length]))
                        seen[length] += 1
                        at, length, piece = at + length, limit, piece + 1
                row, piece, at, length, crc, nth = zip(*rows, strict=True)
                ids = batch.column("doc_id").take(pa.array(row))
                rest = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (at, length, crc, nth))]
                yield pa.RecordBatch.from_arrays([ids, *rest], ["doc_id", "piece", "start", "length", "ids_crc32", "nth"])

    return run


class Sums:
    """Which lengths have pieces left, and how many pairs of such lengths have each sum."""

    def __init__(self, left: np.ndarray) -> None:
        self.left, self.live = left, left > 0
        self.pairs = np.zeros(len(left), np.int64)
        for a in np.flatnonzero(self.live):
            self._count(int(a), self.live[: a + 1], 1)

    def _count(self, a: int, others: np.ndarray, by: int) -> None:
        others = np.flatnonzero(others)
        sums = a + others
        self.pairs[sums[sums < len(self.pairs)]] += by

    def combination(self, gap: int, base: int, size: int) -> list[int] | None:
        """``size`` (1 to 3) lengths that sum up to ``gap`` and have pieces left besides one of ``base``, the longest first."""

        def lasts(found: list[int]) -> bool:
            return all(self.left[x] >= n for x, n in Counter([base, *found]).items())

        if size == 1:
            return [gap] if gap and lasts([gap]) else None
        if size == 2:
            return next(([a, gap - a] for a in self._halves(gap) if lasts([a, gap - a])), None)
        thirds = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
        for c in thirds[self.live[thirds] & (self.pairs[gap - thirds] > 0)].tolist():
            for a in self._halves(gap - c):
                if a <= c and lasts([c, a, gap - c - a]):
                    return [c, a, gap - c - a]
        return None

    def _halves(self, total: int) -> list[int]:
        if total < 2 or self.pairs[total] <= 0:
            return []
        a = np.arange(total - 1, (total + 1) // 2 - 1, -1)
        return a[self.live[a] & self.live[total - a]].tolist()

    def take(self, lengths: list[int]) -> int:
        """As many sequences of these lengths as there are pieces for."""
        need = Counter(lengths)
        times = min(int(self.left[x]) // n for x, n in need.items())
        for x, n in need.items():
            self.left[x] -= times * n
            if not self.left[x]:
                self._count(x, self.live, -1)
                self.live[x] = False
        return times


def packing_plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, Slots]]:
    """The plan with fewest sequences of those that fill exactly with up to three, two or one lengths: pairs and triples may use up what others need to be filled nearly."""
    return min((exact_plan(counts, limit, most) for most in (3, 2, 1)), key=lambda plan: sum(times for times, _ in plan))


def exact_plan(counts: dict[int, int], limit: int = LIMIT, most: int = 3) -> list[tuple[int, Slots]]:
    """Sequences for so many pieces of each length: (how many, [(length, pieces of it in each), ...]).

    Single lengths that fill another's sequence to the last token are looked up first, then pairs, then
    triples, so that no pair takes what would fill a sequence alone; each of the ``most`` rounds begins with the longest
    length. A combination is taken until one of its lengths runs out, so there are not many more
    combinations than lengths. Pieces without one go where they leave the smallest gap, or begin a
    sequence of their own.
    """
    left = np.zeros(limit + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    sums, plan = Sums(left), []
    if left[limit]:
        plan.append((sums.take([limit]), [(limit, 1)]))
    for size in range(1, most + 1):
        for length in range(limit - 1, 0, -1):
            while left[length] and (found := sums.combination(limit - length, length, size)):
                plan.append((sums.take([length, *found]), sorted(Counter([length, *found]).items(), reverse=True)))
    return plan + best_fit({length: int(left[length]) for length in np.flatnonzero(left).tolist()}, limit)


def best_fit(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[int, Slots]]:
    """Best fit, longest first, over numbers of pieces: sequences alike are filled together."""
    open_: dict[int, list[tuple[int, Slots]]] = defaultdict(list)
    gaps: list[int] = []

    def put(gap: int, times: int, slots: Slots) -> None:
        if times:
            if not open_[gap]:
                insort(gaps, gap)
            open_[gap].append((times, slots))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(gaps, length)
            gap = gaps[at] if at < len(gaps) else limit
            times, slots = open_[gap].pop() if at < len(gaps) else (n, [])
            if at < len(gaps) and not open_[gap]:
                gaps.pop(at)
            each = gap // length
            full = min(times, n // each)
            put(gap - each * length, full, [*slots, (length, each)])
            n, times = n - full * each, times - full
            if times and n:  # fewer than fill one more
                put(gap - n * length, 1, [*slots, (length, n)])
                n, times = 0, times - 1
            if slots:
                put(gap, times, slots)
    return [made for gap in gaps for made in open_[gap]]


def _places(plan: Iterable[tuple[int, Slots]]) -> list[tuple[int, int, int, int, int, int]]:
    """length, from, to (numbers of its pieces), each (pieces of it in a sequence), sequence (of the first) and offset."""
    out, used, sequence = [], Counter(), 0
    for times, slots in plan:
        offset = 0
        for length, each in slots:
            out.append((length, used[length], used[length] + times * each, each, sequence, offset))
            used[length] += times * each
            offset += length * each
        sequence += times
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document.

    A document is its text's ids (null: none) and END. One longer than ``limit`` is cut into pieces of
    ``limit``, the first of which may be shorter; no other is cut. Every row is a document of its own,
    so rows that share a doc_id, or have none, are all packed; columns beside doc_id and text are not
    read. ``tokenizer`` is the path of a byte-level tokenizer's file on every machine. An empty table
    gives no rows.

    To the driver goes one number for each length, and back to the tasks go the places of the plan:
    each length has at most a few, however many pieces there are.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    numbers = StructType.fromDDL("piece int, start long, length long, ids_crc32 long, nth long")
    kind = StructType([docs.select("doc_id").schema["doc_id"], *numbers.fields])
    made = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, limit), kind)
    pieces = saved(made.withColumn("part", F.spark_partition_id()))
    counts = saved(pieces.groupBy("part", "length").agg((F.max("nth") + 1).alias("n")))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")
    earlier = counts.select("part", "length", before.alias("before"))
    few = counts.count() <= SENT_ROWS
    numbered = pieces.join(F.broadcast(earlier) if few else earlier, ["part", "length"]).withColumn("number", F.col("before") + F.col("nth"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row for each length up to the limit
    columns = ("length", "from", "to", "each", "sequence", "place")
    places = spark.createDataFrame(_places(packing_plan(total, limit)), StructType([StructField(c, LongType()) for c in columns]))
    at = F.col("number") - F.col("from")
    found = numbered.join(F.broadcast(places), "length").where((F.col("number") >= F.col("from")) & (F.col("number") < F.col("to")))
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(at / F.col("each"))).alias("sequence_id"),
        (F.col("place") + at % F.col("each") * F.col("length")).alias("offset"),
    )
