"""Operator 8 (native): a reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows get global numbers 0 to N-1: an order by hash buckets, rows numbered within their bucket after
the rows of all earlier buckets. The order depends on the rows alone, not on partitions or files.
The permutation works on pairs (number div b, number mod b) of the smallest grid a x b that holds N
numbers; rounds add a keyed hash of one half to the other, and cycle walking repeats it until the
result is below N. Shard and slot are the remainder and quotient of the permuted number by the
number of shards, so shard sizes differ by one at most and slots have no gaps. Both can be computed
from a row number alone, and back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from runloom.llm.tables import saved

#: Buckets of the numbering, at least, and rows that a bucket has on average, at most.
BUCKETS, BUCKET_ROWS = 4096, 100_000
ROUNDS = 6


def numbered(rows: DataFrame, order: list[str], n: int, name: str = "row_number") -> DataFrame:
    """The ``n`` ``rows`` with a global number from 0: by hash bucket of the ``order`` columns, then by these columns. Ties get any order."""
    held = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(max(BUCKETS, -(-n // BUCKET_ROWS)))))
    before = held.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(W.orderBy("_bucket")) - F.col("_n")).select("_bucket", "_before")
    within = F.row_number().over(W.partitionBy("_bucket").orderBy(*order)) - 1
    # one narrow row a bucket: 300,000 at 3e10 rows
    return held.withColumn("_within", within).join(F.broadcast(before), "_bucket").withColumn(name, F.col("_before") + F.col("_within")).drop("_bucket", "_before", "_within")


def _grid(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _once(x: Column, n: int, seed: int, back: bool) -> Column:
    """All rounds over the grid. Even rounds move the row of the grid, odd ones its column."""
    a, b = _grid(n)
    sign = -1 if back else 1

    def step(s: Column, k: Column) -> Column:
        left = F.pmod(s["left"] + sign * F.pmod(F.xxhash64(s["right"], k, F.lit(seed)), F.lit(a)), F.lit(a))
        right = F.pmod(s["right"] + sign * F.pmod(F.xxhash64(s["left"], k, F.lit(seed)), F.lit(b)), F.lit(b))
        even = k % 2 == 0
        return F.struct(F.when(even, left).otherwise(s["left"]).alias("left"), F.when(even, s["right"]).otherwise(right).alias("right"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    start = F.struct(((x - x % b) / b).cast("long").alias("left"), (x % b).cast("long").alias("right"))
    return F.aggregate(rounds, start, step, lambda s: s["left"] * b + s["right"])


def permuted(number: Column, n: int, seed: int = 0, back: bool = False) -> Column:
    """Place of a row number (0 to n-1) in the shuffle of n rows; with ``back``, the row number of a place."""
    a, b = _grid(n)
    place = _once(number.cast("long"), n, seed, back)
    if extra := min(a * b - n, 48):  # a step leaves the n numbers with odds of 1 to the square root of n
        place = F.aggregate(F.sequence(F.lit(1), F.lit(extra)), place, lambda at, _: F.when(at < n, at).otherwise(_once(at, n, seed, back)))
    return F.when(place < n, place).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long"))


def located(place: Column, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a place."""
    return (place % shards).cast("int"), ((place - place % shards) / shards).cast("long")


def shard(rows: DataFrame, order: list[str], shards: int = 8, seed: int = 0) -> DataFrame:
    """``rows`` with shard and slot, by the law of equal row counts: counts differ by one at most, slots run from 0 without gaps.

    ``order`` names the columns that tell rows apart (nulls are values like others); rows equal in
    all of them are dealt in any order. Fewer rows than shards leave shards empty, no rows give none.
    Columns named shard, slot or row_number are replaced.
    """
    n = rows.count()
    shard_, slot = located(F.col("_place"), shards)
    placed = numbered(rows.drop("shard", "slot", "row_number"), order, n).withColumn("_place", permuted(F.col("row_number"), max(n, 1), seed))
    return placed.withColumns({"shard": shard_, "slot": slot}).drop("_place", "row_number")


def shard_documents(docs: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs`` (doc_id, text; others are ignored).

    size is the number of UTF-8 bytes plus one; a null text has no bytes. Texts are read once and not shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    narrow = saved(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    out = shard(narrow, ["doc_id", "size", "text_crc32"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
