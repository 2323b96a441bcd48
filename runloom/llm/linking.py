"""From shared keys to components, without all pairs of a key.

Nodes that share a key are candidates. Comparing all pairs of a key would be quadratic in a group of
near copies, so the nodes of a key are first compared with its hub alone, the node with the most
company over all its keys (in a group of variants, the one in their middle). The links found give
components. Nodes outside of their hub's component choose a hub among themselves and are compared
with that, and so on for HUBS hubs. Only nodes that are then still outside of the first hub's
component meet the other nodes of the key, and a mark of each node, such as a sketch, rules out
within the join those pairs that cannot be linked. Every pair that shares a key has then been
compared or is known to be connected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from runloom.llm.components import components
from runloom.llm.tables import discard, keep_ids, saved

#: Hubs of a key, one after the other; more of them leave fewer nodes to meet all others.
HUBS = 2


def linked(keyed: DataFrame, nodes: Callable[[DataFrame], DataFrame], fits: Callable[[str, str], Column], near: Callable[[str, str], Column], verifier: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(id, component) of the nodes that have links, a written table; component is the smallest id of it.

    ``keyed``: rows (key, id); repeated ones cost time and change nothing. They may have n as well: then a row
    whose n fits neither of its neighbours in the key, by n, has nothing to link with there and is left out at once
    (``fits`` must then hold between two n if it holds for one of them and an n beyond the other). ``nodes`` gives, for the ids that
    share keys, a table (id, n, mark), unique by id; it is read more than once, and from its ids if it is not written. ``fits`` and ``near`` take two columns of n or
    mark and tell which pairs of nodes can be linked at all. ``verifier`` takes these nodes and gives a
    function that tells, of a written table of distinct pairs (a, b), a < b, those that are links.
    """
    by_key = W.partitionBy("key")
    several = keyed.withColumns({"least": F.min("id").over(by_key), "most": F.max("id").over(by_key)}).where("least < most")
    held = several.select("key", "id").distinct()
    if "n" in keyed.columns:
        by_n = by_key.orderBy("n", "id")
        beside = several.select("key", "id", "n").distinct().withColumns({"below": F.lag("n").over(by_n), "above": F.lead("n").over(by_n)})
        held = beside.where((F.col("below").isNotNull() & fits("below", "n")) | (F.col("above").isNotNull() & fits("n", "above"))).select("key", "id").distinct()
    shared = saved(held.withColumn("company", F.count("*").over(by_key)))
    weight = saved(shared.groupBy("id").agg(F.sum("company").alias("weight")))
    marked = nodes(weight.select("id"))
    held = shared.select("key", "id").join(weight.join(marked.select("id", "n"), "id"), "id")
    rows = saved(held.withColumn("hub", F.max(F.struct("weight", "id", "n")).over(by_key)).select("key", "id", "n", "weight", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")))
    discard(shared)  # nodes may still be read from ids
    verified = verifier(marked)

    def links(pairs: DataFrame) -> DataFrame:
        """The links among pairs (x, y). Only marks of these travel, if their ids can be sent."""
        once = distinct(pairs)
        ends = once.select(F.col("a").alias("id")).unionAll(once.select("b")).distinct()
        held = keep_ids(marked.select("id", "mark"), ends, "id")
        a, b = (held.select(F.col("id").alias(x), F.col("mark").alias(f"mark_{x}")) for x in "ab")
        plausible = saved(once.join(a, "a").join(b, "b").where(near("mark_a", "mark_b")).select("a", "b"))
        discard(once)
        return near_links(plausible)

    def distinct(pairs: DataFrame) -> DataFrame:
        return saved(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())

    def near_links(plausible: DataFrame) -> DataFrame:
        found = verified(plausible)
        discard(plausible)
        return found

    def placed(open_: DataFrame, found: DataFrame) -> DataFrame:
        """Those rows of keys that have nodes outside of their hub's component, with root (the component) and outside. Components only grow, so a key that had none has none."""
        root = F.coalesce("component", "id")
        at = open_.select("key", "id", "n", "weight", "hub").join(found, "id", "left").select("key", "id", "n", "weight", "hub", root.alias("root"))
        at = at.withColumn("outside", F.col("root") != F.max(F.when(F.col("id") == F.col("hub"), F.col("root"))).over(by_key))
        return saved(at.withColumn("open", F.max("outside").over(by_key)).where("open").drop("open"))

    def done() -> DataFrame:
        discard(open_, weight)
        return found

    open_, found = rows, components(links(rows.where((F.col("id") != F.col("hub")) & fits("n", "hub_n")).select(F.col("id").alias("x"), F.col("hub").alias("y"))))
    for _ in range(1, HUBS):
        before, open_ = open_, placed(open_, found)
        discard(before)
        if open_.isEmpty():
            return done()
        next_ = open_.where("outside").withColumn("next", F.max(F.struct("weight", "id", "n", "root")).over(by_key))
        met = next_.where(F.col("root") != F.col("next.root")).where(fits("n", "next.n")).select(F.col("id").alias("x"), F.col("next.id").alias("y"))
        found = _with(found, links(met))

    before, open_ = open_, placed(open_, found)
    discard(before)
    if open_.isEmpty():
        return done()
    full = open_.select("key", "id", "n", "root", "outside").join(marked.select("id", "mark"), "id")
    x, y = (side.select("key", *(F.col(c).alias(f"{name}_{c}") for c in ("id", "n", "root", "outside", "mark"))) for side, name in ((full.where("outside"), "x"), (full, "y")))
    once = ~F.col("y_outside") | (F.col("x_id") < F.col("y_id"))
    met = x.join(y, "key").where((F.col("x_root") != F.col("y_root")) & once & fits("x_n", "y_n") & near("x_mark", "y_mark"))
    found = _with(found, near_links(distinct(met.select(F.col("x_id").alias("x"), F.col("y_id").alias("y")))))
    return done()


def _with(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components of what is connected already and more links."""
    if links.isEmpty():
        discard(links)
        return found
    ends = links
    for end in "ab":
        ends = ends.join(found.select(F.col("id").alias(end), F.col("component").alias(f"known_{end}")), end, "left")
    ends = saved(ends)
    roots = components(ends.select(*(F.coalesce(f"known_{end}", end).alias(end) for end in "ab")))  # of components as wholes
    new = ends.where("known_a is null").select(F.col("a").alias("id")).unionAll(ends.where("known_b is null").select("b")).distinct()
    merged = roots.select(F.col("id").alias("component"), F.col("component").alias("least"))
    before = found.unionAll(new.select("id", F.col("id").alias("component")))
    out = saved(before.join(merged, "component", "left").select("id", F.coalesce("least", "component").alias("component")))
    discard(found, links, ends, roots)
    return out
