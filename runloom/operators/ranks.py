"""Numbers over all rows without bringing them into one task, and the first rows of each key."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from runloom.sources.scratch import saved

#: monotonically_increasing_id() counts rows of a partition in this many bits.
_BITS = 33


def numbered(df: DataFrame, order: Sequence[Column], name: str = "number") -> DataFrame:
    """``df`` with the place of each row, from 1, in an order that ties no two rows.

    Ranges of rows are dealt out and sorted; a row's number is its place in its range and the rows of
    earlier ranges. One count for each range passes through the driver.
    """
    dealt = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _BITS)
    counts = sorted(tuple(r) for r in dealt.groupBy(part.alias("part")).count().collect())
    starts = list(accumulate((n for _, n in counts), initial=0))[:-1]
    before = df.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(counts, starts, strict=True)], "_part long, _before long")
    held = dealt.withColumn("_part", part).join(F.broadcast(before), "_part")  # a row for each range
    return held.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1)) + 1).select(*df.columns, name)


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key. Spark keeps ``n`` of each task before it deals them out, so a key with most of the rows is no task's work."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
