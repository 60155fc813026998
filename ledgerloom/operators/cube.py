"""Dimensional validity, member hierarchies and marginal totals (EV6-EV11, JN17, EXI1, EXI2, SRC7-SRC9, SRC22, SRC23, FLT12, AG13, SET6, SET7, SET9, CT9, GN7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bounded, forget, settled


def specs(primaries: DataFrame, dims: DataFrame) -> DataFrame:
    """Hypercubes as (tbl, spec, concept, allowed map dim -> members, typed array of dims). primaries: (tbl, spec, concept);
    dims: (tbl, spec, dim, member, typed) with a row for each member, member null for a typed dimension."""
    d = dims.groupBy("tbl", "spec", "dim").agg(F.max("typed").alias("typed"), F.array_sort(F.collect_set("member")).alias("members"))
    maps = d.groupBy("tbl", "spec").agg(F.map_from_entries(F.collect_list(F.struct("dim", "members"))).alias("allowed"), F.collect_list(F.when(F.col("typed"), F.col("dim"))).alias("typed"))
    return primaries.join(maps, ["tbl", "spec"], "left")


def admission(facts: DataFrame, cubes: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """EV6, EV7, JN17: facts (fact_id, concept, dims) with verdict valid, invalid or metric-not-primary, over all tables.

    A closed cube admits a fact if each of its dimensions is in the cube with an allowed member (any value for a typed
    one), and each of the cube's dimensions is on the fact, or explicit with an allowed default. Cubes are catalogue rows and broadcast."""
    known = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]).cast("map<string,string>") if defaults else F.create_map().cast("map<string,string>")
    typed = lambda d: F.coalesce(F.array_contains("typed", d), F.lit(False))
    member = lambda d, m: F.coalesce(F.array_contains(F.try_element_at("allowed", d), m), F.lit(False))
    ours = F.forall(F.map_entries("dims"), lambda e: typed(e["key"]) | member(e["key"], e["value"]))
    theirs = F.forall(F.map_keys("allowed"), lambda d: F.array_contains(F.map_keys("dims"), d) | (~typed(d) & member(d, F.try_element_at(known, d))))
    fits = F.coalesce(ours & F.coalesce(theirs, F.lit(True)), F.lit(False))
    seen = facts.join(bounded(cubes), "concept", "left").groupBy("fact_id").agg(F.bool_or(fits & F.col("spec").isNotNull()).alias("fits"), F.bool_or(F.col("spec").isNotNull()).alias("primary"))
    return seen.select("fact_id", F.when(F.col("fits"), "valid").when(F.col("primary"), "invalid").otherwise("metric-not-primary").alias("verdict"))


def admission_by_members(facts: DataFrame, primaries: DataFrame, dims: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """EV6, EV7, JN17: `admission` for dimensions of many members: members are joined, not looked up in arrays, so that a fact costs a row for each of its dimensions however many members these have.
    primaries and dims as `specs` wants them; each key in defaults has one default."""
    known = dims.sparkSession.createDataFrame(sorted(defaults.items()), "dim string, _default string")
    each = dims.join(bounded(known), "dim", "left").groupBy("tbl", "spec", "dim").agg(F.max("typed").alias("typed"), F.coalesce(F.bool_or(F.col("member") == F.col("_default")), F.lit(False)).alias("absent"))
    names = lambda keep: F.collect_list(F.when(keep, F.col("dim")))
    shape = each.groupBy("tbl", "spec").agg(names(F.lit(True)).alias("_all"), names(F.col("typed")).alias("_typed"), names(F.col("absent") & ~F.col("typed")).alias("_free"))
    cubes = primaries.join(shape, ["tbl", "spec"], "left").withColumn("_cube", F.lit(True))
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    keys = F.map_keys("dims")
    within = (F.size(F.array_except(keys, some("_all"))) == 0) & (F.size(F.array_except(F.array_except(some("_all"), some("_free")), keys)) == 0)
    explicit = F.map_filter("dims", lambda k, _: ~F.array_contains(some("_typed"), k))
    pairs = settled(facts.select("fact_id", "concept", "dims").join(bounded(cubes), "concept", "left").select("fact_id", "tbl", "spec", F.col("_cube").isNotNull().alias("primary"), (F.col("_cube").isNotNull() & within).alias("within"), explicit.alias("e")))
    held = pairs.where(F.col("within") & (F.size("e") > 0)).select("fact_id", "tbl", "spec", F.size("e").alias("need"), F.explode(F.map_entries("e")).alias("m")).select("fact_id", "tbl", "spec", "need", F.col("m.key").alias("dim"), F.col("m.value").alias("member"))
    members = dims.where("member IS NOT NULL AND NOT typed").select("tbl", "spec", "dim", "member").distinct()
    fits = held.join(members, ["tbl", "spec", "dim", "member"], "left_semi").groupBy("fact_id", "tbl", "spec", "need").agg(F.count("*").alias("n")).where("n = need").select("fact_id").distinct().withColumn("_fits", F.lit(True))
    seen = pairs.groupBy("fact_id").agg(F.bool_or("primary").alias("primary"), F.bool_or(F.col("within") & (F.size("e") == 0)).alias("plain")).join(fits, "fact_id", "left")
    return seen.select("fact_id", F.when(F.col("_fits").isNotNull() | F.col("plain"), "valid").when(F.col("primary"), "invalid").otherwise("metric-not-primary").alias("verdict"))


def valid_cells(points: DataFrame, cubes: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """EV8, CT9: datapoints (tbl, key, concept, dims) that a cube of their own table admits; tables without any cube keep all."""
    with_cube = cubes.select("tbl").distinct()
    p = points.withColumn("fact_id", F.concat_ws("\u0001", "tbl", "key"))
    ruled = p.join(with_cube, "tbl", "left_semi")
    own = ruled.withColumn("concept", F.concat_ws("\u0001", "tbl", "concept"))
    ok = admission(own, cubes.withColumn("concept", F.concat_ws("\u0001", "tbl", "concept")), defaults).where("verdict = 'valid'").select("fact_id")
    return ruled.join(ok, "fact_id", "left_semi").unionByName(p.join(with_cube, "tbl", "left_anti")).drop("fact_id")


def prune(facts: DataFrame, bad: DataFrame, on: list[str]) -> DataFrame:
    """EV11, EXI1, EXI2, SNK6: facts without those whose key is in bad."""
    return facts.join(bad.select(*on).distinct(), on, "left_anti")


def exempt(cells: DataFrame, allowed: DataFrame, key: str = "key", synthetic: str = "synth") -> DataFrame:
    """FLT12: cells that are allowed, and synthesized ones whatever they are."""
    ok = allowed.select(key, F.lit(True).alias("_ok")).distinct()
    return cells.join(ok, key, "left").where(F.col("_ok") | F.col(synthetic)).drop("_ok")


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """EV9, EV10, SRC7: (start, node) for all nodes that (parent, child) edges reach from start. Pairs that are known do not go on, so
    cycles end, and the rounds go on until nothing new is reached."""
    front = starts.select("start", F.col("start").alias("node"))
    arcs = edges.select(F.col("parent").alias("node"), "child")
    seen = None
    while True:
        nxt = front.join(arcs, "node").select("start", F.col("child").alias("node")).distinct()
        if seen is not None:
            nxt = nxt.join(seen, ["start", "node"], "left_anti")
        nxt = settled(nxt)
        if nxt.isEmpty():
            break
        old = seen, front
        seen, front = nxt if seen is None else settled(seen.unionByName(nxt)), nxt
        forget(*old)
    return starts.select("start", F.col("start").alias("node")).limit(0) if seen is None else seen


def role_members(arcs: DataFrame, starts: DataFrame) -> DataFrame:
    """EV9, SRC23: (tbl, role, id, member): the ids that domain-member arcs (tbl, role, from_id, to_id, target_role) reach from each start (tbl, role, id).

    What is reached is a pair of id and role: an arc with a target role goes on in that role, and only there. So an id may be passed in one role and end in another, and cycles end at
    a pair that is known."""
    state = lambda role, i: F.struct("tbl", F.col(role).alias("role"), F.col(i).alias("id"))
    steps = arcs.withColumn("next_role", F.coalesce("target_role", "role")).select(state("role", "from_id").alias("parent"), state("next_role", "to_id").alias("child"))
    found = reachable(steps, starts.select(state("role", "id").alias("start")).distinct())
    return found.select("start.tbl", "start.role", "start.id", F.col("node.id").alias("member")).distinct()


def cube_specs(arcs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """SRC23, EV6: the hypercubes that `admission` wants, from dimensional arcs; see cube_rows."""
    return specs(*cube_rows(arcs, names))


def cube_rows(arcs: DataFrame, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC23, EV6: the hypercubes of dimensional arcs (tbl, role, kind, from_id, to_id, target_role), one for each role that has an `all` arc: primaries (tbl, spec, concept) and dims (tbl, spec, dim, member, typed).

    Its primaries are the arc's source and that one's members; its dimensions are those of the hypercubes that the arc leads to, with the members of their domains (a domain's head is none). Each kind of arc may
    lead to another role. A dimension without members takes any value (typed). names: (id, name), for ids that are called otherwise in facts; others go by what follows `#`."""
    kind = lambda k: arcs.where(F.col("kind") == k).withColumn("next_role", F.coalesce("target_role", "role"))
    members = arcs.where("kind = 'domain-member'")
    tops = settled(kind("all").select("tbl", F.col("role").alias("spec"), F.col("from_id").alias("top"), F.col("to_id").alias("cube"), "next_role").distinct())
    dims = kind("hypercube-dimension").select("tbl", F.col("role").alias("next_role"), F.col("from_id").alias("cube"), F.col("to_id").alias("dim"), F.col("next_role").alias("dim_role"))
    dims = tops.select("tbl", "spec", "cube", "next_role").join(dims, ["tbl", "cube", "next_role"]).select("tbl", "spec", "dim", "dim_role").distinct()
    domains = kind("dimension-domain").select("tbl", F.col("role").alias("dim_role"), F.col("from_id").alias("dim"), F.col("to_id").alias("id"), F.col("next_role").alias("role"))
    dims = settled(dims.join(domains, ["tbl", "dim", "dim_role"], "left").select("tbl", "spec", "dim", "role", "id").distinct())
    starts = dims.where("id IS NOT NULL").select("tbl", "role", "id").unionByName(tops.select("tbl", F.col("spec").alias("role"), F.col("top").alias("id")))
    reached = settled(role_members(members, starts.distinct()))

    def name(column: str):
        return F.substring_index(column, "#", -1)

    def called(rows: DataFrame, column: str, to: str) -> DataFrame:
        if names is None:
            return rows.withColumn(to, name(column))
        return rows.join(bounded(names.select(F.col("id").alias(column), F.col("name").alias("_n"))), column, "left").withColumn(to, F.coalesce("_n", name(column))).drop("_n")

    own = tops.select("tbl", "spec", F.col("top").alias("p"))
    below = tops.select("tbl", "spec", F.col("top").alias("id"), F.col("spec").alias("role")).join(reached, ["tbl", "role", "id"]).select("tbl", "spec", F.col("member").alias("p"))
    primaries = called(own.unionByName(below), "p", "concept").select("tbl", "spec", "concept").distinct()
    allowed = dims.join(reached.withColumnRenamed("member", "m"), ["tbl", "role", "id"], "left").select("tbl", "spec", F.col("dim").alias("d"), "m")
    allowed = called(called(allowed, "d", "dim"), "m", "member").select("tbl", "spec", "dim", "member").distinct()
    typed = allowed.groupBy("tbl", "spec", "dim").agg(F.count("member").alias("n")).select("tbl", "spec", "dim", (F.col("n") == 0).alias("typed"))
    return primaries, allowed.join(typed, ["tbl", "spec", "dim"])


def descendants(edges: DataFrame, starts: DataFrame, leaves_only: bool = False) -> DataFrame:
    """EV10: descendants without the start; only those that are no parent themselves if asked."""
    found = reachable(edges, starts)
    return found.join(edges.select(F.col("parent").alias("node")).distinct(), "node", "left_anti").select("start", "node") if leaves_only else found


def usable_members(edges: DataFrame, heads: DataFrame) -> DataFrame:
    """SRC7, SRC8: descendants of a head along edges (parent, child, usable): unusable ones are passed through but not given."""
    usable = edges.groupBy(F.col("child").alias("node")).agg(F.bool_or("usable").alias("usable"))
    return reachable(edges, heads).join(usable, "node").where("usable").select("start", "node")


def hierarchy(arcs: DataFrame) -> DataFrame:
    """SRC22, SET7: (domain, parent, child, weight, kind) without self-loops and duplicates, and whether any of a parent's arcs is complete."""
    a = arcs.where("parent != child").dropDuplicates(["domain", "parent", "child"])
    return a.join(a.groupBy("domain", "parent").agg(F.bool_or(F.col("kind") == "complete").alias("complete")), ["domain", "parent"])


def leaf_weights(arcs: DataFrame) -> DataFrame:
    """AG13, SRC22: (domain, ancestor, leaf, weight) of hierarchy arcs (domain, parent, child, weight): the product of weights on the way down, summed over all ways. A leaf has itself with weight 1.

    It is the sparse closure of the arcs, a join for each level; members on or above a cycle have no total and no rows."""
    from .graph import levels

    a = settled(arcs.where("parent != child").groupBy("domain", "parent", "child").agg(F.first("weight").cast("double").alias("weight")))
    state = lambda m: F.struct("domain", F.col(m).alias("m"))
    placed = settled(levels(a.select(state("parent").alias("node"), state("child").alias("source"))).where("level IS NOT NULL").select("node.domain", F.col("node.m").alias("member"), "level"))
    sound = settled(a.join(placed.select("domain", F.col("member").alias("parent")), ["domain", "parent"], "left_semi"))
    leaves = settled(placed.where("level = 0").select("domain", F.col("member").alias("ancestor"), F.col("member").alias("leaf"), F.lit(1.0).alias("weight")))
    out, front = leaves, leaves
    top = placed.agg(F.max("level")).first()[0] or 0
    for k in range(1, top + 1):
        # a member of level k has its children below k: their weights are there
        here = sound.join(placed.where(F.col("level") == k).select("domain", F.col("member").alias("parent")), ["domain", "parent"], "left_semi").withColumnRenamed("weight", "w")
        below = out.select("domain", F.col("ancestor").alias("child"), "leaf", "weight")
        front = settled(here.join(below, ["domain", "child"]).groupBy("domain", F.col("parent").alias("ancestor"), "leaf").agg(F.sum(F.col("w") * F.col("weight")).alias("weight")))
        out = out.unionByName(front)
    return out


def weighted_totals(leaves: DataFrame, weights: DataFrame, by: list[str], member: str = "member", value: str = "value") -> DataFrame:
    """AG13: the totals of all members of all levels over leaf facts (domain, member, value, and the columns `by`): one join and one aggregate."""
    w = weights.select("domain", F.col("leaf").alias(member), "ancestor", "weight")
    g = leaves.join(w, ["domain", member]).groupBy("domain", F.col("ancestor").alias(member), *by)
    return g.agg(F.sum((F.col("weight") * F.col(value)).cast("decimal(38,6)")).cast("double").alias(value))


def breakdown_verdicts(totals: DataFrame, reported: DataFrame, kinds: DataFrame, by: list[str], tolerance: float = 0.5) -> DataFrame:
    """SRC22, AG13: reported totals (domain, member, value, by) held against their parts': a complete breakdown asks for equality, a partial one that the total is at least its parts, a superset at most. kinds: (domain, member, kind)."""
    j = reported.join(totals.withColumnRenamed("value", "parts"), ["domain", "member", *by]).join(kinds, ["domain", "member"])
    gap = F.col("value") - F.col("parts")
    return j.withColumn("ok", F.when(F.col("kind") == "complete", F.abs(gap) <= tolerance).when(F.col("kind") == "partial", gap >= -tolerance).otherwise(gap <= tolerance))


def marginals(leaves: DataFrame, dims: list[str], value: str, default: str = "x0") -> DataFrame:
    """AG13: totals over every set of dimensions, the default member for those that are summed over. One CUBE: one shuffle."""
    g = leaves.cube(*dims).agg(F.sum(value).alias(value))
    return g.select(*[F.coalesce(d, F.lit(default)).alias(d) for d in dims], value)


def members_within(details: DataFrame, hierarchy_members: DataFrame) -> DataFrame:
    """SET6: for each group (id, members) whether all are in the hierarchy (id, members)."""
    return details.join(hierarchy_members.withColumnRenamed("members", "_h"), "id", "left").select("id", (F.size(F.array_except("members", F.coalesce("_h", F.array().cast("array<string>")))) == 0).alias("within"))


def first_valid(candidates: DataFrame, cubes: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """GN7: of each open row's candidate members (row_id, ord, fact_id, concept, dims) the first that a cube admits."""
    ok = admission(candidates, cubes, defaults).where("verdict = 'valid'")
    return candidates.join(ok.select("fact_id"), "fact_id", "left_semi").groupBy("row_id").agg(F.min_by("fact_id", F.struct("ord", "fact_id")).alias("fact_id"))


def same_validity(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET9: keys that only one of two extractions holds valid."""
    return a.select("key").exceptAll(b.select("key")).withColumn("only_in", F.lit("a")).unionByName(b.select("key").exceptAll(a.select("key")).withColumn("only_in", F.lit("b")))
