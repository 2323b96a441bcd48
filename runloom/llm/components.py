"""Connected components by alternating stars, as joins and aggregates over the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.tables import discard, saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Every vertex hands its larger neighbours over to the smallest vertex it knows."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex hands its smaller neighbours over to the smallest of them. Edges point from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (a, b), a written table: component is the smallest id reachable.

    Each round is two shuffles of the edges and ends in a written table; the number of rounds grows
    with the logarithm of the longest path. Null ends and self loops are ignored; repeated edges
    count once; an empty table has no components. Only a count and a checksum reach the driver.
    """
    e = saved(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(e)
    while mark[0]:
        before, e = e, saved(_small_star(_large_star(e)))
        discard(before)
        new = _mark(e)
        if new == mark:
            break
        mark = new
    roots = e.select("v").distinct()
    found = saved(e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots.select(F.col("v").alias("id"), F.col("v").alias("component"))))
    discard(e)
    return found
