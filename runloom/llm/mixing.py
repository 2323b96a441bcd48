"""Operator 10 (native): mixing sources to target weights by a low-discrepancy schedule.

Slots 0, 1, 2, ... of the mix take points of a golden-ratio sequence; the point's place in the
cumulative weights names the slot's source, so after any number of slots each source has had its
share within a few slots. Slots are ranked per source. Each source's documents are shuffled and cut
into blocks of equal numbers of words (a block may begin and end within a document), and a slot
takes the block of its rank; ranks beyond the last block begin the source again, twice at most.

Ranks and word positions are running sums. Both are taken in two steps, within chunks of bounded
size and over the chunks' totals, so that a source with a third of all rows is not one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from runloom.llm.tables import WORD, saved

#: Consecutive Fibonacci numbers: slot n has the point (n * LOW mod HIGH) / HIGH.
LOW, HIGH = 701408733, 1134903170
WEIGHTS = (3.0, 1.0, 2.0)
#: A block has as many words as fit PARTS times in its source's target, up to BLOCK.
BLOCK, PARTS = 256, 512
CHUNKS = 1024
CHUNK_SLOTS = 16384


def targets(sizes: DataFrame, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, weight and target of every source of ``sizes`` (source, size).

    Sources by code point, null last, weigh WEIGHTS in turn. They share ``budget`` times all words by
    weight; a target stops at ``most`` times its source's size and the excess is shared by weight
    among the others, until none is above. That ends at one level of target per weight: with sources
    ordered by limit per weight, those that stop come first, and the level is what they leave over
    the weights that remain. Windows run over one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn % len(WEIGHTS) + 1).cast("int"))
    limit = most * F.col("source_size")
    held = by_source.withColumn("weight", weight).withColumn("full", limit / F.col("weight"))
    order = W.orderBy("full", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(0))
    left = budget * F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    # the first source whose limit the level does not reach sets the level for itself and all after it
    open_ = held.withColumn("own", level).withColumn("level", F.min(F.when(F.col("own") < F.col("full"), F.struct("full", "own"))).over(everything)["own"])
    target = F.least(limit, F.coalesce(F.col("level") * F.col("weight"), limit))
    return open_.select("source", "source_size", "weight", target.alias("target"))


def _running(rows: DataFrame, value: str, group: list[str], chunk: str, order: list[str | Column], name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the earlier rows of their group, by chunk and then by ``order``."""
    totals = rows.groupBy(*group, chunk).agg(F.sum(value).alias("_sum"))
    earlier = totals.withColumn("_before", F.sum("_sum").over(W.partitionBy(*group).orderBy(chunk)) - F.col("_sum")).drop("_sum")
    keys = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*group, chunk)]
    within = F.sum(value).over(W.partitionBy(*group, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col(value)
    joined = rows.withColumn("_within", within).alias("x").join(earlier.alias("y"), keys)
    return joined.select("x.*", (F.col("_before") + F.col("_within")).alias(name)).drop("_within")


def blocks(sizes: DataFrame, plan: DataFrame, key: list[str], seed: int) -> DataFrame:
    """A row for each block that a document has words in: source_no, block, the key columns, words, begin (position in the source)."""
    held = sizes.where("size > 0").withColumn("_order", F.xxhash64(F.lit(seed), *key)).withColumn("_chunk", F.pmod("_order", F.lit(CHUNKS)))
    at = plan.select("source", "source_no", "block_words")
    dealt = held.alias("d").join(at.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).select("d.*", "source_no", "block_words")
    dealt = _running(dealt, "size", ["source_no"], "_chunk", ["_order", *key], "begin")
    end, width = F.col("begin") + F.col("size"), F.col("block_words")
    cut = dealt.withColumn("block", F.explode(F.sequence(F.expr("begin div block_words"), F.expr("(begin + size - 1) div block_words"))))
    words = F.least(end, (F.col("block") + 1) * width) - F.greatest("begin", F.col("block") * width)
    return cut.select("source_no", "block", *key, words.alias("words"), F.greatest("begin", F.col("block") * width).alias("begin"))


def schedule(plan: DataFrame) -> DataFrame:
    """slot, source_no and rank of every slot. ``plan`` has one row per source; the mix has as many slots as the targets have blocks."""
    spark = plan.sparkSession
    whole = W.orderBy("source_no")
    share = plan.withColumn("_slots", F.col("target") / F.col("block_words"))
    upper = F.sum("_slots").over(whole) / F.sum("_slots").over(W.partitionBy(F.lit(0)))
    share = share.withColumn("upper", upper).select("source_no", "upper", "_slots")
    n = share.agg(F.sum("_slots")).first()[0] or 0.0
    # the cumulative weights are cut into cells; a cell names the sources that reach into it
    cells = 1 << 11
    low = F.coalesce(F.lag("upper").over(whole), F.lit(0.0))
    bounds = share.withColumn("lower", low).withColumn("cell", F.explode(F.sequence(F.floor(F.col("lower") * cells), F.floor(F.col("upper") * cells)))).select("source_no", "lower", "upper", "cell")
    point = F.pmod(F.pmod("slot", F.lit(HIGH)) * LOW, F.lit(HIGH)) / HIGH
    slots = spark.range(round(n)).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("cell", F.floor(F.col("point") * cells))
    named = slots.join(bounds, "cell").where((F.col("point") >= F.col("lower")) & (F.col("point") < F.col("upper")))
    one = named.select("slot", "source_no", F.lit(1).alias("_one"), F.expr(f"slot div {CHUNK_SLOTS}").alias("_chunk"))
    return _running(one, "_one", ["source_no"], "_chunk", ["slot"], "rank").select("slot", "source_no", "rank")


def sized(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs`` with size, the number of words of the text (null: 0), instead of the text."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.select("doc_id", "source", words.alias("size"), *keep)


def planned(sizes: DataFrame, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """targets() with a number for each source, its block_words and its number of blocks; written, as three steps read it."""
    words = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.col("target") / PARTS))).cast("long")
    numbered = targets(sizes, budget, most).withColumn("source_no", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    return saved(numbered.withColumn("block_words", words).withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long")))


def mix(sizes: DataFrame, plan: DataFrame, key: list[str], most: int = 2, seed: int = 0) -> DataFrame:
    """The mix: slot, the key columns, begin (orders the documents of a slot) and words taken, for every document of every slot."""
    takes = schedule(plan).join(plan.select("source_no", "n_blocks"), "source_no").where(F.col("rank") < most * F.col("n_blocks"))
    takes = takes.select("slot", "source_no", (F.col("rank") % F.col("n_blocks")).alias("block"))
    return takes.join(blocks(sizes, plan, key, seed), ["source_no", "block"]).drop("source_no", "block")


def mix_documents(docs: DataFrame, budget: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``docs`` (doc_id, text, source; others are ignored).

    taken is the number of words that the mix takes from the row, repeats counted: at most ``most``
    times its size. Rows without words take no part and have taken 0; a source without words has
    target 0. A null source is a source. Repeated rows are dealt one by one, in any order among themselves.
    """
    sizes = saved(sized(docs, F.xxhash64("text").alias("_text")))
    plan = planned(sizes, budget, float(most))
    key = ["doc_id", "source", "_text", "_copy"]
    copies = sizes.withColumn("_copy", F.row_number().over(W.partitionBy("doc_id", "source", "_text").orderBy("size")))
    sizes = saved(copies)
    taken = mix(sizes, plan, key, most, seed).groupBy(*key).agg(F.sum("words").alias("taken"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in key]
    out = sizes.alias("d").join(taken.alias("t"), same, "left").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
    return out.select("d.doc_id", "d.size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
