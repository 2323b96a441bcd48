"""Operator 6: near-duplicate lines by MinHash.

A line is lower-cased and its white space collapsed; its set is all its character shingles. In a long
line, one hash of each shingle falls into one of BINS bins and the least hash of a bin is one
component of the signature; an empty bin borrows from the next full one. A short line has too few
shingles for that, so each component is the least value of a hash of its own. A line not much shorter
than a long one has the keys of both, so two lines that can be alike always share a form. Lines that agree in
all ROWS components of a band are candidates. Their numbers of shingles and a sketch rule most of those
out that are not alike, and an exact comparison of their shingle sets decides. The sketch has the
parity of the number of shingles in each of SKETCH buckets, so two sketches differ in no more bits
than their sets differ in shingles, and no pair is lost by it. Links are joined to components by
distributed union-find, and the first line of a component, by document and place, stays.

Texts are read three times rather than written again with all that is known of their lines: for band
keys, for the places of lines, and, by place, for the texts of those lines that share a band with another.

A pair of similarity s is a candidate with the probability 1 - (1 - s ** ROWS) ** BANDS: 0.99 at 0.8,
0.9998 at 0.9. Equal lines are one class from the start, whatever their number. A line's name has 128
bits of a hash. Bands and links use half of it; of different lines that have this half in common,
one is compared with others and the rest stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.linking import linked
from runloom.llm.tables import SENT_ROWS, discard, keep_ids, saved

SHINGLE, ROWS, BANDS, BINS = 5, 5, 12, 64
#: Bits of a sketch.
SKETCH = 1024
WORDS = SKETCH // 64
_BITS = [f"bits{i}" for i in range(WORDS)]
#: Lines with fewer distinct shingles are short.
SHORT = 3 * BINS
#: Lines that are hashed together, at most 2048, and characters of such lines, whose numbers stay in a core's cache; a longer line is hashed in pieces.
_SLICE, _CHARS = 2000, 1 << 16
_NONE = np.uint64(2**64 - 1)
#: The largest number of shingles that goes with a key; more count as so many.
NUMBER = 0xFFFF
#: Ranges of keys, a power of two, and how many keys a task packs together, about.
RANGES, PACKED = 1 << 13, 1 << 20
_PRIME = np.uint64(0x100000001B3)


_LOW = np.uint64(2**53 - 1)
#: Bits of a 53-bit hash below those that are its bin, and below those that are its bucket of a sketch.
_BELOW_BIN, _BELOW_BUCKET = (np.uint64(53 - (n.bit_length() - 1)) for n in (BINS, SKETCH))
#: Bits of a character in the exact comparison, and where the number of the pair begins; the lowest bit is the side.
_LETTER = 10
_PAIR = np.uint64(_LETTER * SHINGLE + 1)


def normal_line(line: str) -> str:
    return " ".join(line.lower().split())


def normal_lines(text: str | None) -> list[str]:
    """normal_line() of every line. White space other than the blank is not printable, so most lines need not be split."""
    lines = (bare := (text or "").lower()).split("\n")
    if bare[:1] != " " != bare[-1:] and not any(x in bare for x in ("  ", "\n ", " \n")) and "".join(lines).isprintable():  # no line of the text
        return lines
    return [x if x.isprintable() and "  " not in x and x[:1] != " " != x[-1:] else " ".join(x.split()) for x in lines]


def line_name(line: str) -> bytes:
    """128 bits that name a normalised line."""
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def _halves(names: list[bytes]) -> tuple[pa.Array, pa.Array]:
    """id and low, 64 bits each, of names."""
    both = np.frombuffer(b"".join(names), ">i8").astype(np.int64).reshape(-1, 2)
    return pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_SALTS = _mix(np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _windows(codes: np.ndarray, size: int) -> np.ndarray:
    """A polynomial hash of every window of ``size`` codes, by doubling."""
    powers, width, out, out_width = [codes], 1, None, 0
    while width <= size:
        held = powers[-1]
        if size & width:
            n = len(codes) - out_width - width + 1
            out = held if out is None else out[:n] * np.uint64(pow(int(_PRIME), width, 2**64)) + held[out_width : out_width + n]
            out_width += width
        n = len(codes) - 2 * width + 1
        if 2 * width <= size:
            powers.append(held[:n] * np.uint64(pow(int(_PRIME), width, 2**64)) + held[width : width + n] if n > 0 else held[:0])
        width *= 2
    return out


def _hashed(lines: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all lines, and how many each line has. A line shorter than a shingle is one shingle."""
    padded = [line.ljust(size, "\0") for line in lines]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    ends, whole = np.cumsum(lengths), np.ones(len(codes), bool)
    for i in range(1, size):  # windows that reach over a line's end
        whole[ends - i] = False
    return _mix(_windows(codes, size)[whole[: len(codes) - size + 1]]), lengths - size + 1


def _distinct(lines: list[str], size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of each line: 53 bits of a hash, the line's number in the bits above them, in order. A line of more than _CHARS characters comes alone."""
    if len(lines) == 1 and len(lines[0]) > _CHARS:
        return _pieced(lines[0], size)
    keys, counts = _hashed(lines, size)
    keys >>= np.uint64(11)
    keys |= np.repeat(np.arange(len(lines), dtype=np.uint64) << np.uint64(53), counts)
    keys.sort()
    return keys[_begins(keys)]


def _begins(x: np.ndarray) -> np.ndarray:
    """Where values of ``x``, in order, occur first."""
    out = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=out[1:])
    return out


def _pieced(line: str, size: int = SHINGLE) -> np.ndarray:
    """_distinct() of one line, piece by piece."""
    found, piece = np.empty(0, np.uint64), 4 * _CHARS
    for at in range(0, len(line) - size + 1, piece):
        found = np.union1d(found, _hashed([line[at : at + piece + size - 1]], size)[0] >> np.uint64(11))
    return found


def signatures(keys: np.ndarray, which: np.ndarray, short: bool) -> np.ndarray:
    """A row of BINS hashes for each of the lines ``which``, out of _distinct(), in the form of short or long lines."""
    counts = _sizes(keys)
    if len(which) < len(counts):
        wanted = np.zeros(len(counts), bool)
        wanted[which] = True
        keys, counts = keys[np.repeat(wanted, counts)], counts[which]
    if short:
        hashes, out = keys & _LOW, np.full((len(which), BINS), _NONE)
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        salted = np.empty_like(hashes)
        for i in range(ROWS * BANDS):
            np.bitwise_xor(hashes, _SALTS[i], out=salted)
            salted *= np.uint64(0xD6E8FEB86659FD93)
            out[:, i] = np.minimum.reduceat(salted, starts)
        return out
    least = keys[_begins(keys >> _BELOW_BIN)]  # a hash's upper bits are its bin, so the least of each bin comes first in it
    bins = np.full(len(which) * BINS, _NONE)
    rows = np.searchsorted(which, (least >> np.uint64(53)).view(np.int64))
    bins[rows * BINS + (least >> _BELOW_BIN & np.uint64(BINS - 1)).view(np.int64)] = least & ((np.uint64(1) << _BELOW_BIN) - np.uint64(1))
    return _filled(bins.reshape(-1, BINS))


def _filled(signature: np.ndarray) -> np.ndarray:
    """Empty bins take the value of the next full bin, changed by the distance."""
    n = signature.shape[1]
    rows = np.flatnonzero((signature == _NONE).any(axis=1))
    part = signature[rows]
    full = part != _NONE
    place = np.where(np.concatenate([full, full], axis=1), np.arange(2 * n), 4 * n)
    nearest = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :n]
    signature[rows] = np.take_along_axis(part, nearest % n, axis=1) + (nearest - np.arange(n)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return signature


def sketches(lines: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The number of distinct shingles of each line, and a row of 64-bit words with its sketch."""
    return _parities(len(lines), _distinct(lines, size))


def _parities(n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and sketches out of distinct shingles, each with its line in the upper bits. A hash's upper bits are its bucket, so buckets are runs."""
    buckets = keys >> _BELOW_BUCKET
    starts = np.flatnonzero(_begins(buckets))
    odd = np.zeros(n * SKETCH, np.uint8)
    odd[buckets[starts].view(np.int64)] = np.diff(starts, append=len(keys)) & 1
    return _sizes(keys), np.packbits(odd.reshape(n, SKETCH), axis=1).view(np.int64)


def band_keys(lines: list[str], num: int = 4, den: int = 5) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of lines and a row of BANDS keys for each, for both forms. Lines of similarity num/den have sizes of no smaller ratio, so they share a form."""
    keys = _distinct(lines)
    yield from _forms(keys, _sizes(keys), num, den)


def _sizes(keys: np.ndarray) -> np.ndarray:
    """The number of distinct shingles of each line, out of _distinct()."""
    return np.diff(np.searchsorted(keys, np.arange(int(keys[-1] >> np.uint64(53)) + 1, dtype=np.uint64) << np.uint64(53)), append=len(keys))


def _forms(keys: np.ndarray, sizes: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for short, which in ((True, np.flatnonzero(sizes < SHORT)), (False, np.flatnonzero(den * sizes >= num * SHORT))):
        if len(which):
            yield which, _banded(signatures(keys, which, short))


def _banded(signature: np.ndarray) -> np.ndarray:
    n = len(signature)
    parts = signature[:, : ROWS * BANDS].reshape(n, BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)).copy()
    for i in range(ROWS):
        keys = _mix(keys * _PRIME ^ parts[:, :, i])
    return keys.view(np.int64)


def _fresh(batch: pa.RecordBatch) -> Iterator[tuple[list[str], list[bytes]]]:
    """Lines of a batch, each once, and their names; as many together as may be hashed together."""
    seen: set[bytes] = set()
    lines, names, chars = [], [], 0
    for text in batch.column("text"):
        for line in normal_lines(text.as_py()):
            if line and (name := line_name(line)) not in seen:
                seen.add(name)
                if lines and (len(lines) >= _SLICE or chars + len(line) > _CHARS):
                    yield lines, names
                    lines, names, chars = [], [], 0
                lines.append(line)
                names.append(name)
                chars += len(line)
    if lines:
        yield lines, names


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, place and name of each line with words."""
    for batch in batches:
        docs, places, names = [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            for place, line in enumerate(normal_lines(text.as_py())):
                if line:
                    docs.append(doc)
                    places.append(place)
                    names.append(line_name(line))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(places, pa.int32()), *_halves(names)], ["doc_id", "place", "id", "low"])


def _keys(num: int, den: int):
    """id, number of shingles and band keys of each line, once for each batch that has it; in two rows if it has both forms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lines, names in _fresh(batch):
                ids, found = _halves(names)[0], _distinct(lines)
                sizes = _sizes(found)
                for which, keys in _forms(found, sizes, num, den):
                    ends = pa.array(np.arange(len(which) + 1) * BANDS, pa.int32())
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), pa.array(sizes[which].astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], ["id", "n", "keys"])

    return run


def _meeting(num: int, den: int):
    """Key and id of rows (at, id), in order of ``at``, that have a row of another line beside them with the same key and a number of shingles that num/den allows.

    ``at`` is the key, less its lowest 16 bits, and the number there, at most NUMBER. One row is held over from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, joined = [np.empty(0, np.int64)] * 2, False
        for batch in batches:
            at, id_ = (np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(held, ("at", "id"), strict=True))
            if not len(at):
                continue
            new = np.concatenate([[True], (at[1:] != at[:-1]) | (id_[1:] != id_[:-1])])
            at, id_ = at[new], id_[new]
            n = at & NUMBER
            meets = ((at[1:] ^ at[:-1]) <= NUMBER) & ((at[1:] ^ at[:-1]) >= 0) & (den * n[:-1] >= num * n[1:])
            keep = np.concatenate([[joined], meets]) | np.concatenate([meets, [False]])
            held, joined, keep[-1] = [at[-1:], id_[-1:]], bool(keep[-1]), False
            yield pa.RecordBatch.from_arrays([pa.array(at[keep] & ~NUMBER), pa.array(id_[keep])], ["key", "id"])
        if joined:
            yield pa.RecordBatch.from_arrays([pa.array(held[0] & ~NUMBER), pa.array(held[1])], ["key", "id"])

    return run


def _ranges(num: int, den: int):
    """Rows (at, id) of _meeting() for all keys of lines, packed by ranges of ``at``: a packed row costs hardly more to shuffle and sort than one key would."""

    def packed(at: list[np.ndarray], ids: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.stack([np.concatenate(at), np.concatenate(ids)], axis=1)
        rows = rows[np.argsort(rows[:, 0])]
        ranges = rows[:, 0] >> 64 - (RANGES.bit_length() - 1)
        starts = np.flatnonzero(_begins(ranges))
        ends = pa.py_buffer((np.append(starts, len(rows)) * rows.itemsize * 2).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(ranges[starts].astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(starts), [None, ends, pa.py_buffer(rows)])], ["range", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, count = [], [], 0
        for batch in _keys(num, den)(batches):
            keys = batch.column("keys").flatten().to_numpy().reshape(-1, BANDS)
            held.append((keys & ~NUMBER | np.minimum(batch.column("n").to_numpy(), NUMBER).astype(np.int64)[:, None]).ravel())
            ids.append(np.repeat(batch.column("id").to_numpy(), BANDS))
            count += keys.size
            if count >= PACKED:
                yield packed(held, ids)
                held, ids, count = [], [], 0
        if count:
            yield packed(held, ids)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (at, id) of each range, in order of ``at``, out of packed rows in order of their ranges. Repeated ones are left out as they pile up."""

    def in_order(parts: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(parts)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        return rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))]

    def batch(parts: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in in_order(parts).T], ["at", "id"])

    held, count, last = [], 0, None
    for packed in batches:
        for range_, rows in zip(packed.column("range").to_pylist(), packed.column("rows"), strict=True):
            if held and range_ != last:
                yield batch(held)
                held, count = [], 0
            elif count > 4 * PACKED and count > 2 * len(held[0]):
                held = [in_order(held)]
                count = len(held[0])
            held.append(np.frombuffer(rows.as_buffer(), np.int64).reshape(-1, 2))
            count, last = count + len(held[-1]), range_
    if held:
        yield batch(held)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Name and text, number of shingles and sketch of the lines at ``places`` of each text that have these ``ids``."""
    for batch in batches:
        lines, names, chars = [], [], 0
        for text, places, ids in zip(batch.column("text"), batch.column("places").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            found = normal_lines(text.as_py())
            for place, id_ in zip(places, ids, strict=True):
                # another row of the same doc_id may have another line there
                if place < len(found) and int.from_bytes((name := line_name(line := found[place]))[:8], "big", signed=True) == id_:
                    if lines and (len(lines) >= _SLICE or chars + len(line) > _CHARS):
                        yield _sketched(lines, names)
                        lines, names, chars = [], [], 0
                    lines.append(line)
                    names.append(name)
                    chars += len(line)
        if lines:
            yield _sketched(lines, names)


def _sketched(lines: list[str], names: list[bytes]) -> pa.RecordBatch:
    counts, bits = sketches(lines)
    columns = [*_halves(names), pa.array(lines, pa.string()), pa.array(counts.astype(np.int32)), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(WORDS))]
    return pa.RecordBatch.from_arrays(columns, ["id", "low", "line", "n", *_BITS])


def shingles(line: str, size: int = SHINGLE) -> set[str]:
    return {line[i : i + size] for i in range(max(1, len(line) - size + 1))}


def _alike(pairs: list[tuple[str, str]], num: int, den: int) -> np.ndarray:
    """Which pairs of lines have a similarity of num/den, by whole shingles: 10 bits for each character, if there are no more kinds of them, else by sets."""
    padded = [line.ljust(SHINGLE, "\n") for pair in pairs for line in pair]  # no line has a line feed
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    used = np.zeros(int(codes.max()) + 1, bool)
    used[codes] = True
    if np.count_nonzero(used) > 1 << _LETTER:
        return np.array([den * (both := len((x := shingles(a)) & (y := shingles(b)))) >= num * (len(x) + len(y) - both) for a, b in pairs], bool)
    letters = (np.cumsum(used) - 1).astype(np.uint64)[codes]
    lengths = np.fromiter(map(len, padded), np.int64, len(padded))
    ends, whole, n = np.cumsum(lengths), np.ones(len(codes), bool), len(codes) - SHINGLE + 1
    keys = letters[:n]
    for i in range(1, SHINGLE):
        whole[ends - i] = False
        keys = keys << np.uint64(_LETTER) | letters[i : n + i]
    side = np.arange(len(padded), dtype=np.uint64)
    keys = keys[whole[:n]] << np.uint64(1) | np.repeat((side >> np.uint64(1)) << _PAIR | side & np.uint64(1), lengths - SHINGLE + 1)
    keys.sort()
    keys = keys[_begins(keys)]
    first = np.arange(len(pairs), dtype=np.uint64) << _PAIR
    sizes = np.diff(np.searchsorted(keys, first), append=len(keys))
    both = np.bincount((keys[~_begins(keys >> np.uint64(1))] >> _PAIR).view(np.int64), minlength=len(pairs))
    return den * both >= num * (sizes - both)


def _similar(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, part, chars = [np.zeros(0, bool)], [], 0
            for pair in zip(batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist(), strict=True):
                if part and (len(part) >= _SLICE or chars + len(pair[0]) + len(pair[1]) > _CHARS):
                    kept.append(_alike(part, num, den))
                    part, chars = [], 0
                part.append(pair)
                chars += len(pair[0]) + len(pair[1])
            if part:
                kept.append(_alike(part, num, den))
            yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(kept)))

    return run


def _plausible(num: int, den: int):
    """Which pairs of numbers of shingles, and of sketches, can belong to lines of a similarity of num/den."""

    def fits(x: str, y: str) -> Column:
        return den * F.least(x, y).cast("long") >= num * F.greatest(x, y).cast("long")

    def near(x: str, y: str) -> Column:
        apart = sum((F.bit_count(F.col(x)[b].bitwiseXOR(F.col(y)[b])) for b in _BITS), F.lit(0)).cast("long")
        return fits(f"{x}.n", f"{y}.n") & ((den + num) * apart <= (den - num) * (F.col(f"{x}.n") + F.col(f"{y}.n")).cast("long"))

    return fits, near


def _verifier(num: int, den: int):
    """Exact comparison of pairs. Lines that share a band with some line grow faster than the input, the pairs that sketches leave do not: only texts of these travel, if their ids can be sent."""

    def of(nodes: DataFrame):
        def verified(pairs: DataFrame) -> DataFrame:
            ends = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()
            held = keep_ids(nodes.select("id", "line"), ends, "id")
            a, b = (held.select(F.col("id").alias(x), F.col("line").alias(f"line_{x}")) for x in "ab")
            return saved(pairs.join(a, "a").join(b, "b").mapInArrow(_similar(num, den), "a long, b long"))

        return verified

    return of


def _sent(df: DataFrame, ids: DataFrame) -> DataFrame:
    """One side of a join, that is sent to all tasks if the written table ``ids`` that it is made of is short."""
    return F.broadcast(df) if ids.limit(SENT_ROWS + 1).count() <= SENT_ROWS else df


def _dropped(docs: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, place, id and low (the line's name) of every line with words of ``docs``, and of those that are not the first of their class: two written tables."""
    kept: list[DataFrame] = []
    where = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "place")

    def nodes(ids: DataFrame) -> DataFrame:
        """Texts and sketches of the lines that share a band; one line for each id. They are read where one of their places is."""
        kept.append(places := saved(docs.mapInArrow(_places, "doc_id long, place int, id long, low long")))
        one = keep_ids(places, ids, "id").groupBy("id").agg(F.min(F.struct("low", where.alias("at"))).alias("one"))
        picks = one.groupBy(F.col("one.at.doc_id").alias("_id")).agg(F.collect_list(F.struct(F.col("one.at.place").alias("place"), "id")).alias("picks"))
        at = _sent(picks.select("_id", F.col("picks.place").alias("places"), F.col("picks.id").alias("ids")), ids)
        texts = docs.join(at, F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "places", "ids")
        marked = saved(texts.mapInArrow(_marked, "id long, low long, line string, n int, " + ", ".join(f"{b} long" for b in _BITS)))
        if marked.count() > ids.count():  # equal rows of a doc_id
            marked, twice = saved(marked.groupBy("id").agg(F.min(F.struct("low", "line", "n", *_BITS)).alias("one")).select("id", "one.*")), marked
            discard(twice)
        kept.append(marked)
        return marked.select("id", "n", F.struct("n", *_BITS).alias("mark"))

    packed = docs.select("text").mapInArrow(_ranges(num, den), "range int, rows binary")
    keyed = packed.repartition("range").sortWithinPartitions("range").mapInArrow(lambda rows: _meeting(num, den)(_unpacked(rows)), "key long, id long")
    found = linked(keyed, nodes, *_plausible(num, den), lambda _: _verifier(num, den)(kept[1]))  # texts stay in the first table of lines

    places, marked = kept
    named = found.join(marked.select("id", "low"), "id")  # only these lines of their ids have links
    several = places.groupBy("id", "low").agg(F.count("*").alias("n")).where("n > 1").select("id", "low")
    classes = saved(several.join(named, ["id", "low"], "full").select("id", "low", F.coalesce("component", "id").alias("class"), F.when(F.col("component").isNull(), F.col("low")).alias("own")))
    lines = saved(places.join(_sent(classes, classes), ["id", "low"]))
    stays = saved(lines.groupBy("class", "own").agg(F.min(where).alias("stays")))
    of = stays.select(F.col("class").alias("_class"), F.col("own").alias("_own"), "stays")
    later = lines.join(_sent(of, stays), F.col("class").eqNullSafe(F.col("_class")) & F.col("own").eqNullSafe(F.col("_own"))).where(~where.eqNullSafe(F.col("stays")))
    dropped = saved(later.select("doc_id", "place", "id", "low"))
    discard(lines, stays, classes, found, marked)
    return places, dropped


def line_classes(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, place (from 0), id, low (the line's name) and kept of every line with words of ``docs``: a written table."""
    places, dropped = _dropped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), num, den)
    gone = dropped.distinct().select(F.col("doc_id").alias("_id"), F.col("place").alias("_place"), F.col("id").alias("_line"), F.col("low").alias("_low"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("place") == F.col("_place")) & (F.col("id") == F.col("_line")) & (F.col("low") == F.col("_low"))
    out = saved(places.join(gone, same, "left").select("doc_id", "place", "id", "low", F.col("_place").isNull().alias("kept")))
    discard(places, dropped)
    return out


def dedup_lines(docs: DataFrame, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_lines, n_kept and dropped (places of dropped lines, from 0) of every doc_id of ``docs`` (doc_id, text; others are ignored).

    Of lines linked by a similarity of num/den or more of their shingle sets, directly or through
    others, the first by doc_id and place stays. Lines without words are neither counted nor dropped.
    Null and empty texts have no lines. Repeated rows of a doc_id are one document: a place is kept
    if its line is. Rows without doc_id come last and form one document. An empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    places, dropped = _dropped(docs, num, den)
    rows = saved(docs.groupBy("doc_id").agg(F.count("*").alias("rows")))
    if not rows.where("rows > 1").isEmpty():  # a place that several rows have is dropped if the lines of all are
        places = places.groupBy("doc_id", "place").agg(F.count("*").alias("n"))
        gone = dropped.groupBy(F.col("doc_id").alias("_id"), F.col("place").alias("_place")).agg(F.count("*").alias("_n"))
        dropped = places.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("place") == F.col("_place")) & (F.col("n") == F.col("_n")))
    lines = places.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("n_lines"))
    lost = dropped.groupBy(F.col("doc_id").alias("_lost")).agg(F.array_sort(F.collect_list("place")).alias("dropped"))
    of = rows.select("doc_id").join(lines, F.col("doc_id").eqNullSafe(F.col("_id")), "left").join(lost, F.col("doc_id").eqNullSafe(F.col("_lost")), "left")
    n_lines, places_lost = F.coalesce("n_lines", F.lit(0).cast("long")), F.coalesce("dropped", F.array().cast("array<int>"))
    return of.select("doc_id", n_lines.alias("n_lines"), (n_lines - F.size(places_lost)).alias("n_kept"), places_lost.alias("dropped"))


def without_lines(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` with their texts less the dropped places of dedup_lines()."""
    at = dropped.select(F.col("doc_id").alias("_id"), F.col("dropped").alias("_dropped"))
    held = docs.join(at, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left")
    kept = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(~F.array_contains("_dropped", i), x)), lambda x: x.isNotNull())
    return held.withColumn("text", F.when(F.size("_dropped") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))).select(*docs.columns)
