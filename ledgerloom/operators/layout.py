"""Table layouts: inherited aspects, datapoints, cell resolution, grids (SRC12-SRC14, JN4, JN14-JN16, PRJ15, PRJ16, SL3, CT4).

A position table has (tbl, axis x|y|z, ord, code, concept, dims map, open_dim). Precedence of merged aspects is one rule
everywhere: z before row (y) before column (x), the later wins; for the concept likewise where it has one.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import cell_key, merge_aspects
from ..session import settled

_NONE = "map<string,string>"


def _dims(name: str):
    return F.coalesce(F.col(name), F.create_map().cast(_NONE))


def inherited(nodes: DataFrame) -> DataFrame:
    """SRC13: nodes (tbl, node, parent, concept, dims) with concept and dims inherited from their ancestors, a child's own winning.

    Trees are a few levels deep: a join for each level, and all rows of a level at once, until a level is empty. Nodes that hang on
    themselves have no root and no rows."""
    level = settled(nodes.where("parent IS NULL").select("tbl", "node", "concept", _dims("dims").alias("dims"), F.lit(0).alias("depth")))
    out = level
    children = nodes.where("parent IS NOT NULL").select("tbl", "node", "parent", F.col("concept").alias("own"), _dims("dims").alias("own_dims"))
    for k in itertools.count(1):
        up = level.select("tbl", F.col("node").alias("parent"), "concept", "dims")
        level = settled(children.join(up, ["tbl", "parent"]).select("tbl", "node", F.coalesce("own", "concept").alias("concept"), merge_aspects(F.col("dims"), F.col("own_dims")).alias("dims"), F.lit(k).alias("depth")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def nodes_of(links: DataFrame) -> DataFrame:
    """SRC13: (path, label, id, open, abstract, concept, dims, open_dim) of a layout's nodes from linkbase rows."""
    r = links.where("kind = 'resource' AND tag IN ('ruleNode', 'aspectNode')")
    under = lambda key: F.transform(F.filter("parts", lambda p: p["text"].startswith(f"{key}:")), lambda p: F.substring(p["text"], len(key) + 2, 1 << 20))
    pairs = F.transform(under("aspect"), lambda t: F.struct(F.substring_index(t, "=", 1).alias("key"), F.substring(t, F.locate("=", t) + 1, 1 << 20).alias("value")))
    last = F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"])))
    open_dim = F.get(F.transform(F.filter("parts", lambda p: p["tag"] == "dimensionAspect"), lambda p: F.substring_index(p["text"], "aspectNode:", -1)), F.lit(0))
    abstract = F.coalesce(F.try_element_at("attributes", F.lit("abstract")), F.lit("false")) == "true"
    return r.select("path", "label", F.coalesce("id", "label").alias("id"), (F.col("tag") == "aspectNode").alias("open"), abstract.alias("abstract"), F.get(under("concept"), F.lit(0)).alias("concept"), last.alias("dims"), open_dim.alias("open_dim"))


def walked(links: DataFrame) -> DataFrame:
    """SRC13: (path, axis, breakdown, open, abstract, id, concept, dims, open_dim, place) of all nodes of layouts, aspects inherited from the nodes above.

    place is the way from the table to the node, in the arcs' order: sorted by it, a tree stands in pre-order. A level of all trees of all layouts is one join; a node that hangs on itself is
    reached once on a way."""
    arc = lambda tag: links.where((F.col("kind") == "arc") & (F.col("tag") == tag)).select("path", "source", "target", F.coalesce("ord", F.lit(0.0)).alias("ord"), F.try_element_at("attributes", F.lit("axis")).alias("axis"))
    nodes = settled(nodes_of(links))
    breakdowns = arc("tableBreakdownArc").select("path", "axis", F.col("target").alias("source"), F.struct("ord", F.col("target").alias("label")).alias("breakdown"))
    step = F.struct("ord", F.col("target").alias("label"))
    level = arc("breakdownTreeArc").drop("axis").join(breakdowns, ["path", "source"]).select("path", "axis", "breakdown", F.array(F.col("breakdown"), step).alias("place"), F.col("target").alias("label"), F.lit(None).cast("string").alias("from_concept"), F.create_map().cast(_NONE).alias("from_dims"))
    below = settled(arc("definitionNodeSubtreeArc").select("path", F.col("source").alias("label"), step.alias("step"), F.col("target").alias("child")))
    out = None
    while True:
        here = level.join(nodes, ["path", "label"])
        level = settled(here.withColumn("concept", F.coalesce("concept", "from_concept")).withColumn("dims", merge_aspects(F.col("from_dims"), F.col("dims"))).drop("from_concept", "from_dims"))
        if out is not None and level.isEmpty():
            break
        out = level if out is None else out.unionByName(level)
        down = level.join(below, ["path", "label"]).where(~F.exists("place", lambda p: p["label"] == F.col("child")))
        level = down.select("path", "axis", "breakdown", F.concat("place", F.array("step")).alias("place"), F.col("child").alias("label"), F.col("concept").alias("from_concept"), F.col("dims").alias("from_dims"))
    return out.drop("label")


def positions(links: DataFrame, codes: DataFrame | None = None, multiplied: bool = True) -> DataFrame:
    """SRC13, SRC12: the position table that `datapoints`, `resolve` and grids want, from the linkbase rows of layouts: (tbl, axis, ord, code, concept, dims, open_dim).

    A position is a node that isn't abstract and has a concept, a dimension or a code; an aspect node is an open one. Several breakdowns of an axis are multiplied, the later one's aspects winning and codes joined by a comma, or
    stand one after the other. codes: (tbl, node, code). A table is named by its id after `_t`, else by its file."""
    named = links.where("kind = 'resource' AND tag = 'table'").groupBy("path").agg(F.min(F.regexp_replace("id", "^.*?_t", "")).alias("_id"))
    w = walked(links).join(named, "path", "left").withColumn("tbl", F.coalesce("_id", F.upper(F.regexp_extract("path", r"([^/]+?)(-rend)?\.xml$", 1))))
    if codes is not None:
        w = w.join(codes.select("tbl", F.col("node").alias("id"), "code"), ["tbl", "id"], "left")
    else:
        w = w.withColumn("code", F.lit(None).cast("string"))
    w = settled(w.where(F.col("open") | (~F.col("abstract") & (F.col("concept").isNotNull() | (F.size("dims") > 0) | F.col("code").isNotNull()))).select("tbl", "axis", "breakdown", "open", "code", "concept", "dims", "open_dim", F.array("place").alias("place")))
    closed, opened = w.where("NOT open"), w.where("open")
    if multiplied:
        closed = _multiplied(closed)
    rows = closed.drop("breakdown", "open").withColumn("open_dim", F.lit(None).cast("string")).unionByName(opened.drop("breakdown", "open").withColumn("open_dim", F.coalesce("open_dim", F.lit(""))))
    order = Window.partitionBy("tbl", "axis").orderBy("place")
    return rows.select("tbl", "axis", F.row_number().over(order).alias("ord"), "code", "concept", "dims", "open_dim")


def _multiplied(closed: DataFrame) -> DataFrame:
    """Every combination of an axis' breakdowns; a round for each breakdown that an axis has at most."""
    number = F.dense_rank().over(Window.partitionBy("tbl", "axis").orderBy("breakdown"))
    parts = settled(closed.withColumn("nth", number))
    most = parts.agg(F.max("nth")).first()[0] or 1
    out = parts.where("nth = 1").drop("nth")
    for k in range(2, most + 1):
        more = parts.where(F.col("nth") == k).select("tbl", "axis", *[F.col(c).alias(f"_{c}") for c in ("code", "concept", "dims", "place")])
        out = out.join(more, ["tbl", "axis"], "left")
        out = out.withColumns({
            "code": F.nullif(F.concat_ws(",", "code", "_code"), F.lit("")), "concept": F.coalesce("_concept", "concept"), "dims": merge_aspects(F.col("dims"), _dims("_dims")),
            "place": F.concat("place", F.coalesce("_place", F.array().cast(out.schema["place"].dataType))),
        }).drop("_code", "_concept", "_dims", "_place")
    return out


def datapoints(positions: DataFrame) -> DataFrame:
    """JN15: every combination of a table's closed positions over its axes, with concept and merged dims; needs a concept; each cell key once per table (the first by place)."""
    axis = lambda a: positions.where((F.col("axis") == a) & F.col("open_dim").isNull()).select("tbl", F.col("ord").alias(f"o_{a}"), F.col("code").alias(f"c_{a}"), F.col("concept").alias(f"m_{a}"), F.col("dims").alias(f"d_{a}"))
    # tables are joined on their code: a cartesian product within one table, never across
    p = axis("y").join(axis("x"), "tbl", "full").join(axis("z"), "tbl", "full")
    dims = merge_aspects(merge_aspects(_dims("d_z"), _dims("d_y")), _dims("d_x"))
    p = p.select("tbl", *[F.col(f"c_{a}").alias(a2) for a, a2 in (("y", "r"), ("x", "c"), ("z", "z"))], F.coalesce("m_x", "m_y", "m_z").alias("concept"), dims.alias("dims"), "o_z", "o_y", "o_x")
    p = p.where("concept IS NOT NULL").withColumn("key", cell_key(F.col("concept"), F.col("dims")))
    first = p.groupBy("tbl", "key").agg(F.min(F.struct(*[F.coalesce(f"o_{a}", F.lit(-1)).alias(f"o_{a}") for a in "zyx"], "r", "c", "z", "concept", F.map_entries("dims").alias("d"))).alias("p"))
    return first.select("tbl", "key", "p.r", "p.c", "p.z", "p.concept", F.map_from_entries("p.d").alias("dims"), "p.o_z", "p.o_y", "p.o_x")


def resolve(terms: DataFrame, positions: DataFrame) -> DataFrame:
    """JN4: terms (tbl, r, c, z, ...) with the concept and dims of their cell. A code that the layout lacks resolves to nothing
    and the term drops out; an axis that the term leaves open adds nothing. `unresolved` gives those that dropped out."""
    t = terms.withColumn("_id", F.monotonically_increasing_id())
    for axis, code in (("z", "z"), ("y", "r"), ("x", "c")):
        p = positions.where(F.col("axis") == axis).select(F.col("tbl").alias("_t"), F.col("code").alias("_c"), F.col("concept").alias(f"_m{axis}"), F.col("dims").alias(f"_d{axis}"), F.lit(True).alias(f"_f{axis}"))
        t = t.join(p, (F.col("tbl") == F.col("_t")) & (F.col(code) == F.col("_c")), "left").drop("_t", "_c")
        t = t.where(F.col(code).isNull() | F.col(f"_f{axis}"))
    dims = merge_aspects(merge_aspects(_dims("_dz"), _dims("_dy")), _dims("_dx"))
    out = t.withColumn("concept", F.coalesce("_mx", "_my", "_mz")).withColumn("dims", dims).where("concept IS NOT NULL")
    return out.drop("_id", *[f"_{k}{a}" for k in "mdf" for a in "xyz"])


def unresolved(terms: DataFrame, positions: DataFrame) -> DataFrame:
    """Terms with a code that their table's layout lacks."""
    out = None
    for axis, code in (("z", "z"), ("y", "r"), ("x", "c")):
        known = positions.where(F.col("axis") == axis).select("tbl", F.col("code").alias(code))
        bad = terms.where(F.col(code).isNotNull()).join(known, ["tbl", code], "left_anti").select(*terms.columns)
        out = bad if out is None else out.unionByName(bad)
    return out.distinct()


def with_labels(points: DataFrame, metrics: DataFrame, members: DataFrame) -> DataFrame:
    """PRJ15, PRJ16: datapoints with their metric's label and datatype, and the labels of the members in dim order, joined by ' · '."""
    p = points.withColumn("_id", F.monotonically_increasing_id())
    m = p.select("_id", F.explode(F.map_entries("dims")).alias("e")).select("_id", F.col("e.key").alias("dim"), F.col("e.value").alias("member"))
    named = m.join(members.select("member", F.col("label").alias("_l")), "member", "left").groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("dim", F.coalesce("_l", "member").alias("l")))).alias("_ls"))
    out = p.join(metrics.select("concept", F.col("label").alias("_m"), "datatype"), "concept", "left").join(named, "_id", "left")
    label = F.concat_ws(" · ", F.coalesce("_m", "concept"), F.array_join(F.transform("_ls", lambda x: x["l"]), " · "))
    return out.withColumn("label", label).drop("_id", "_ls", "_m")


def page(rows: DataFrame, order: list, number: int = 1, size: int = 50) -> DataFrame:
    """SL1-SL3: page `number` (from 1) of at most 500 rows, with the total; order has to be total."""
    size = max(1, min(size, 500))
    total = rows.agg(F.count("*").alias("total"))
    some = rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)
    return some.withColumn("total", total.scalar())
