"""Graphs of rules, cells and tables: levels, cycles, components (DV2, DV3, DV14-DV16, DV28, SL7, SET8)."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import forget, lookup, settled

#: Tables of levels that are kept apart before they are written as one.
MOST_PARTS = 16


def _met(table: DataFrame) -> DataFrame:
    """A table of an iteration that may be as large as the graph: joined by merging, as it would go through the driver in each round as long as its file is small enough for a broadcast."""
    return table.hint("merge")


def levels(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """DV2, DV3: (node, level): leaves are 0, an aggregate is one above its highest source. edges: (node, source). Nodes on or
    above a cycle have a null level. A round settles a whole level and drops the edges from it, so that the next one reads only what is left: the rounds are the graph's depth. rounds, where given, is the
    depth that the caller expects at most; a graph that is deeper is an error, never cut."""
    e = settled(edges.where("node IS NOT NULL AND source IS NOT NULL").select("node", "source"))
    waiting = settled(e.select("node").distinct())
    known = settled(e.join(_met(waiting.select(F.col("node").alias("source"), F.lit(1).alias("_t"))), "source", "left"))
    forget(e)
    leaves = known.where("_t IS NULL").select(F.col("source").alias("node")).distinct().withColumn("level", F.lit(0))
    placed, left = [], known.where("_t = 1").select("node", "source")
    for k in itertools.count(1):
        # left: edges from sources that are not placed; whose edges are all gone is placed
        stuck = settled(left.select("node").distinct())
        new = settled(waiting.join(_met(stuck), "node", "left_anti"))
        forget(waiting)
        waiting = stuck
        if new.isEmpty():
            break
        if rounds is not None and k > rounds:
            raise RuntimeError(f"the graph is deeper than {rounds} levels")
        placed.append(new.withColumn("level", F.lit(k)))
        before, left = left, settled(left.join(_met(new.withColumnRenamed("node", "source")), "source", "left_anti"))
        forget(before)
        if len(placed) > MOST_PARTS:
            placed = [settled(functools.reduce(DataFrame.unionByName, placed))]
    return functools.reduce(DataFrame.unionByName, placed, leaves).unionByName(waiting.withColumn("level", F.lit(None).cast("int")))


def cyclic(edges: DataFrame) -> DataFrame:
    """DV28: nodes that no order places."""
    return levels(edges).where("level IS NULL").select("node")


def _followed(steps: DataFrame, there: DataFrame, p: str = "p", how: str = "inner") -> DataFrame:
    """steps with q: where the node that column p names points to in there (u, p). Both are settled. Nodes that a thousandth of all steps name are looked up by broadcast."""
    held = steps.groupBy(p).agg(F.count("*").alias("_n"))
    to = settled(held.join(_met(there.select(F.col("u").alias(p), F.col("p").alias("q"))), p))
    return lookup(steps, to, p, "_n", steps.count(), how).drop("_n")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """DV14, DV15: (node, component): the smallest node that edges connect it to, for each node of an edge between two nodes.

    Contraction: each node points to its smallest neighbour. Two nodes that point at each other are the only cycle that this can make, and the smaller one is the least of all nodes that lead there: it is their root, found
    by following pointers of pointers, on tables of nodes. Edges are told between roots, those within one go; the nodes with an edge are halved at least by a round, in dense graphs almost all edges go in the first.
    A round shuffles the edges once for each end. Self-loops and nulls are left out."""
    e = settled(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v"))
    found = None
    while size := e.count():
        near = settled(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.min("v").alias("p"), F.count("*").alias("n")))
        root = settled(_followed(near, near).select("u", F.when((F.col("q") == F.col("u")) & (F.col("u") < F.col("p")), F.col("u")).otherwise(F.col("p")).alias("p"), "n"))
        forget(near)
        while True:
            before, root = root, settled(_followed(root, root).select("u", F.col("q").alias("p"), "n", (F.col("p") != F.col("q")).alias("moved")))
            forget(before)
            if root.where("moved").isEmpty():
                break
        end = lambda c: root.select(F.col("u").alias(c), F.col("p").alias(f"_{c}"), F.col("n").alias(f"_n{c}"))  # noqa: B023, E731
        half = settled(lookup(e, end("u"), "u", "_nu", size, "inner").select("_u", "v"))
        whole = lookup(half, end("v"), "v", "_nv", size, "inner").where("_u != _v")
        before, e = e, settled(whole.select(F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v")).distinct())
        forget(before, half)
        if found is None:
            found = root.select(F.col("u").alias("node"), F.col("p").alias("component"))
        else:
            found = settled(_followed(found, root, "component", "left").select("node", F.coalesce("q", "component").alias("component")))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")) if found is None else found


def strong_components(edges: DataFrame) -> DataFrame:
    """DV3, DV28: (node, component) of the nodes that lie on cycles of (node, source) edges: the smallest node of those that reach each other.

    Nodes that no cycle goes through are peeled off at both ends first. Of the rest each takes the smallest node that it can be reached from (colours spread until they stand), and within a colour those that also reach it
    back are its component; they go, and what is left is coloured again. All components of a pass are found at once."""
    e = settled(edges.where("node IS NOT NULL AND source IS NOT NULL").select("node", "source").distinct())
    loops = e.where("node = source").select("node").distinct()
    for _ in range(2):  # above a cycle, then below one
        stuck = settled(levels(e).where("level IS NULL").select("node"))
        e = settled(e.join(_met(stuck), "node", "left_semi").join(_met(stuck.withColumnRenamed("node", "source")), "source", "left_semi").select(F.col("source").alias("node"), F.col("node").alias("source")))
    out = None
    while not e.isEmpty():
        colour = settled(e.select("node").union(e.select("source")).distinct().withColumn("c", F.col("node")))
        while True:  # along an edge from node to source
            spread = e.join(_met(colour), "node").select(F.col("source").alias("node"), "c").unionByName(colour).groupBy("node").agg(F.min("c").alias("c"))
            before, colour = colour, settled(spread)
            same = colour.join(_met(before.withColumnRenamed("c", "b")), "node").where("b != c").isEmpty()
            forget(before)
            if same:
                break
        inside = settled(e.join(_met(colour), "node").join(_met(colour.select(F.col("node").alias("source"), F.col("c").alias("d"))), "source").where("c = d").select("node", "source", "c"))
        found = front = settled(colour.where("node = c").select("node", "c"))
        while True:  # back along edges
            more = inside.join(_met(front.select(F.col("node").alias("source"), "c")), ["source", "c"]).select("node", "c").distinct().join(_met(found), ["node", "c"], "left_anti")
            front = settled(more)
            if front.isEmpty():
                break
            found = settled(found.unionByName(front))
        part = found.select("node", F.col("c").alias("component"))
        out = part if out is None else out.unionByName(part)
        gone = found.select("node")
        e = settled(e.join(_met(gone), "node", "left_anti").join(_met(gone.withColumnRenamed("node", "source")), "source", "left_anti").select("node", "source"))
    if out is None:
        return loops.withColumn("component", F.col("node"))
    sizes = out.groupBy("component").agg(F.count("*").alias("n"))
    # a lone node between two cycles is none, unless it hangs on itself
    some = out.join(_met(sizes.where("n > 1").select("component")), "component", "left_semi").select("node", "component")
    return some.unionByName(loops.join(_met(some), "node", "left_anti").withColumn("component", F.col("node")))


def dirty(parts: DataFrame, violated: DataFrame, most: int = 20_000) -> DataFrame:
    """DV16: (component, nodes, dirty, deferred): components with any violated node; those above the size cap are deferred."""
    j = parts.join(violated.select("node").distinct().withColumn("_v", F.lit(1)), "node", "left")
    return j.groupBy("component").agg(F.count("*").alias("nodes"), F.bool_or(F.col("_v").isNotNull()).alias("dirty")).withColumn("deferred", F.col("dirty") & (F.col("nodes") > most))


def dag_report(definitions: DataFrame) -> DataFrame:
    """DV28, SET8: counts over (code, target, source): leaves, aggregates that feed others (intermediate) or not (pure), cells with
    several definitions, and of those how many with differing sources."""
    targets = definitions.select("target").distinct()
    sources = definitions.select(F.col("source").alias("target")).distinct()
    leaves = sources.join(targets, "target", "left_anti").agg(F.count("*").alias("leaves"))
    mixed = targets.join(sources, "target", "left_semi").agg(F.count("*").alias("intermediate"))
    pure = targets.join(sources, "target", "left_anti").agg(F.count("*").alias("pure"))
    by_code = definitions.groupBy("target", "code").agg(F.array_sort(F.collect_set("source")).alias("s"))
    multi = by_code.groupBy("target").agg(F.count("*").alias("n"), F.count_distinct("s").alias("d")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("multi_defined"), F.count(F.when(F.col("d") > 1, 1)).alias("differing"))
    return leaves.select("leaves", mixed.scalar().alias("intermediate"), pure.scalar().alias("pure"), multi.select("multi_defined").scalar().alias("multi_defined"), multi.select("differing").scalar().alias("differing"))


def canonical(definitions: DataFrame) -> DataFrame:
    """SL7: of each target's definitions the single-table one, then that with the fewest sources, then the first code."""
    d = definitions.groupBy("target", "code").agg(F.bool_or("is_cross").alias("is_cross"), F.count_distinct("source").alias("n_sources"))
    return d.groupBy("target").agg(F.min_by("code", F.struct("is_cross", "n_sources", "code")).alias("code"))
