"""Cycles, closures over roles, weighted hierarchies, layouts from links and handing down, against brute force on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import keys as K
from ledgerloom.operators import cube, derive, graph, layout
from ledgerloom.sources import package


def reach(edges):
    nodes = {x for e in edges for x in e}
    below = {n: {b for a, b in edges if a == n} for n in nodes}
    for _ in nodes:
        below = {n: below[n] | {y for x in below[n] for y in below[x]} for n in nodes}
    return below


def test_strong_components_against_reachability(spark):
    rng = random.Random(5)
    edges = {(f"n{rng.randint(0, 24):02}", f"n{rng.randint(0, 24):02}") for _ in range(38)} | {("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("loop", "loop"), ("d", "loop")}
    below = reach(edges)
    want = {n: min(m for m in below[n] if n in below[m]) for n in below if n in below[n]}
    got = {r.node: r.component for r in graph.strong_components(spark.createDataFrame(list(edges), "node string, source string")).collect()}
    assert got == want and len(set(want.values())) > 2
    assert graph.strong_components(spark.createDataFrame([("a", "b"), ("b", "c")], "node string, source string")).collect() == []


def test_cyclic_definitions_settle_or_say_so(spark):
    rows = [("x", "y", -0.25, 1.0), ("x", "one", -3.0, 1.0), ("y", "x", -0.25, 1.0), ("y", "one", -3.0, 1.0), ("sum", "x", -1.0, 1.0), ("sum", "y", -1.0, 1.0), ("p", "q", -2.0, 1.0), ("q", "p", -2.0, 1.0), ("q", "sum", -1.0, 1.0)]
    v = derive.derive_with_cycles(spark.createDataFrame([("one", 1.0), ("x", 100.0)], "key string, value double"), spark.createDataFrame(rows, "target string, source string, coef double, target_coef double"), rounds=25)
    got = {r.key: r for r in v.collect()}
    assert got["x"].value == pytest.approx(4) and got["y"].value == pytest.approx(4) and got["sum"].value == pytest.approx(8)
    assert got["x"].cycle == got["y"].cycle == "x" and got["sum"].cycle is None and got["x"].moved <= 1e-8 < got["p"].moved and got["q"].cycle == "p"


def test_roles_switch_and_cycles_end(spark):
    arcs = [("T", "a", "h", "m1", None), ("T", "a", "m1", "m2", "b"), ("T", "a", "m2", "wrong", None), ("T", "b", "m2", "m3", None), ("T", "b", "m3", "m1", "a"), ("T", "b", "m1", "deep", None), ("U", "a", "m1", "other table", None)]
    df = spark.createDataFrame(arcs, "tbl string, role string, from_id string, to_id string, target_role string")
    got = cube.role_members(df, spark.createDataFrame([("T", "a", "h"), ("T", "b", "m1")], "tbl string, role string, id string")).collect()
    found = {}
    for r in got:
        found.setdefault((r.role, r.id), set()).add(r.member)
    assert found == {("a", "h"): {"m1", "m2", "m3"}, ("b", "m1"): {"deep"}}


def test_cubes_from_a_linkbase(spark):
    """Target roles on each kind of arc, a typed dimension, names of ids, and a role without an `all` arc, which is no cube."""
    loc = "".join(f'<link:loc xlink:type="locator" xlink:href="s.xsd#{x}" xlink:label="{x}"/>' for x in ("top", "m1", "hyp", "A", "B", "dom", "x0", "x1", "x2"))
    arc = lambda kind, a, b, more="": f'<link:arc xlink:type="arc" xlink:arcrole="http://xbrl.org/int/dim/arcrole/{kind}" xlink:from="{a}" xlink:to="{b}" {more}/>'
    link = lambda role, *arcs: f'<link:definitionLink xlink:type="extended" xlink:role="{role}">{loc}{"".join(arcs)}</link:definitionLink>'
    body = link("cube", arc("all", "top", "hyp"), arc("domain-member", "top", "m1"), arc("hypercube-dimension", "hyp", "A", 'xbrldt:targetRole="dims"'), arc("hypercube-dimension", "hyp", "B"))
    body += link("dims", arc("dimension-domain", "A", "dom", 'xbrldt:targetRole="members"'), arc("dimension-default", "A", "x0")) + link("members", arc("domain-member", "dom", "x0"), arc("domain-member", "dom", "x1", 'usable="false"'), arc("domain-member", "x1", "x2"))
    text = f'<link:linkbase xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:xbrldt="http://xbrl.org/2005/xbrldt">{body}</link:linkbase>'
    arcs = package.definition_arcs(package.links_of(spark.createDataFrame([("d.xml", bytearray(text.encode()))], "path string, content binary")))
    assert [(r.dim, r.member) for r in package.dimension_defaults(arcs).collect()] == [("s.xsd#A", "s.xsd#x0")]
    names = spark.createDataFrame([("s.xsd#x2", "d:renamed")], "id string, name string")
    specs = cube.cube_specs(arcs.withColumn("tbl", F.lit("T")), names).collect()
    assert sorted(r.concept for r in specs) == ["m1", "top"]
    assert all(r.allowed == {"A": ["d:renamed", "x0", "x1"], "B": []} and r.typed == ["B"] for r in specs)


def test_weights_along_all_ways(spark):
    arcs = [("D", "t", "a", 1.0), ("D", "t", "b", -1.0), ("D", "a", "l1", 0.5), ("D", "a", "l2", 1.0), ("D", "b", "l2", 2.0), ("D", "t", "l3", 3.0), ("D", "t", "l3", 3.0), ("D", "a", "a", 9.0), ("E", "p", "q", 1.0), ("E", "q", "p", 1.0), ("E", "r", "p", 1.0), ("E", "s", "l1", 7.0)]
    w = {(r.domain, r.ancestor, r.leaf): r.weight for r in cube.leaf_weights(spark.createDataFrame(arcs, "domain string, parent string, child string, weight double")).collect()}
    own = {("D", x, x): 1.0 for x in ("l1", "l2", "l3")} | {("E", "l1", "l1"): 1.0}
    assert w == own | {("D", "a", "l1"): 0.5, ("D", "a", "l2"): 1.0, ("D", "b", "l2"): 2.0, ("D", "t", "l1"): 0.5, ("D", "t", "l2"): -1.0, ("D", "t", "l3"): 3.0, ("E", "s", "l1"): 7.0}


def test_totals_are_handed_down_to_the_unit(spark):
    tree = [("r", "a", 1), ("r", "b", 2), ("r", "c", 3), ("a", "a1", 1), ("a", "a2", 2), ("c", "c1", 1), ("loop", "loop", 1)]
    weights = [("a", 2.4), ("b", -5.0), ("c", 1.0), ("a1", 0.0)]
    v = derive.distribute_down(spark.createDataFrame(tree, "parent string, child string, ord int"), spark.createDataFrame(weights, "key string, value double"), spark.createDataFrame([("r", 11), ("loop", 3)], "key string, total int"))
    got = {r.key: (r.assigned, r.depth) for r in v.collect()}
    assert got == {"r": (11, 0), "loop": (3, 0), "a": (8, 1), "b": (0, 1), "c": (3, 1), "a1": (4, 2), "a2": (4, 2), "c1": (3, 2)}


def test_layouts_of_breakdowns(spark):
    """Breakdowns of an axis multiplied or one after the other, the order of arcs, and a code on a node without aspects."""
    node = lambda label, inside="", more="": f'<t:ruleNode xlink:type="resource" xlink:label="{label}" id="{label}" {more}>{inside}</t:ruleNode>'
    link = lambda tag, a, b, more: f'<t:{tag} xlink:type="arc" xlink:arcrole="x" xlink:from="{a}" xlink:to="{b}" {more}/>'
    member = '<f:explicitDimension dimension="d:A"><f:member><f:qname>d:m</f:qname></f:member></f:explicitDimension>'
    body = link("tableBreakdownArc", "t", "b1", 'axis="y" order="1"') + link("tableBreakdownArc", "t", "b2", 'axis="y" order="2"') + link("breakdownTreeArc", "b1", "top", 'order="1"') + link("breakdownTreeArc", "b2", "one", 'order="1"')
    body += node("top", "<f:concept><f:qname>d:c</f:qname></f:concept>", 'abstract="true"') + node("late") + node("early", member) + node("one", "<f:concept><f:qname>d:over</f:qname></f:concept>") + node("bare")
    body += link("definitionNodeSubtreeArc", "top", "late", 'order="2"') + link("definitionNodeSubtreeArc", "top", "early", 'order="1"') + link("breakdownTreeArc", "b2", "bare", 'order="2"')
    text = f'<l:linkbase xmlns:l="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:t="http://xbrl.org/2014/table" xmlns:f="http://xbrl.org/2008/formula" xmlns:d="urn:d"><l:gen xlink:type="extended" xlink:role="r">{body}</l:gen></l:linkbase>'
    links = package.links_of(spark.createDataFrame([("p/tab1-rend.xml", bytearray(text.encode()))], "path string, content binary"))
    codes = spark.createDataFrame([("TAB1", "bare", "0099"), ("TAB1", "early", "0010")], "tbl string, node string, code string")
    said = lambda df: [(r.ord, r.code, r.concept, r.dims) for r in df.withColumn("dims", K.dim_key(F.col("dims"))).orderBy("ord").collect()]
    apart = said(layout.positions(links, codes, multiplied=False))
    assert apart == [(1, "0010", "{urn:d}c", "{urn:d}A={urn:d}m"), (2, None, "{urn:d}c", ""), (3, None, "{urn:d}over", ""), (4, "0099", None, "")]
    both = said(layout.positions(links, codes))
    assert both == [(1, "0010", "{urn:d}over", "{urn:d}A={urn:d}m"), (2, "0010,0099", "{urn:d}c", "{urn:d}A={urn:d}m"), (3, None, "{urn:d}over", ""), (4, "0099", "{urn:d}c", "")]


def test_hrefs_are_resolved_from_their_file(spark):
    rows = [("p/q/a.xml", "b.xsd#x", "p/q/b.xsd#x"), ("p/q/a.xml", "../b.xsd#x", "p/b.xsd#x"), ("p/q/a.xml", "./../q/./b.xsd", "p/q/b.xsd"), ("p/q/a.xml", "http://w.x/y/b.xsd#z", "w.x/y/b.xsd#z"), ("p/q/a.xml", "#own", "p/q/a.xml#own"), ("a.xml", "../../b#c", "b#c")]
    got = spark.createDataFrame(rows, "path string, href string, want string").select(package.resolved(F.col("href"), F.col("path")).alias("r"), "want").collect()
    assert all(r.r == r.want for r in got)


def test_hierarchies_from_calculation_arcs(spark):
    loc = "".join(f'<link:loc xlink:type="locator" xlink:href="mem.xsd#x_MC_{m}" xlink:label="l{m}"/>' for m in ("t", "a", "b"))
    arc = lambda b, kind, more="": f'<link:calculationArc xlink:type="arc" xlink:arcrole="http://x/arcrole/{kind}" xlink:from="lt" xlink:to="l{b}" {more}/>'
    text = f'<link:linkbase xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink"><link:calculationLink xlink:type="extended" xlink:role="r">{loc}{arc("a", "complete-breakdown", "weight=\'-1\'")}{arc("b", "superset-breakdown")}{arc("b", "other")}</link:calculationLink></link:linkbase>'
    arcs = package.hierarchy_arcs(package.links_of(spark.createDataFrame([("dict/dom/mc/hier-cal.xml", bytearray(text.encode()))], "path string, content binary")))
    assert sorted(tuple(r) for r in arcs.collect()) == [("mc", "t", "a", -1.0, "complete"), ("mc", "t", "b", 1.0, "superset")]


def test_open_rows_are_made_where_a_cube_admits_them(spark):
    """A typed and an explicit open dimension over two columns and two layers; the first member that is admitted; a table with closed rows."""
    from ledgerloom.operators import workflows

    positions = [("O", "x", 1, "m1", {}, None), ("O", "x", 2, "m2", {}, None), ("O", "z", 1, None, {"Z": "z1"}, None), ("O", "z", 2, None, {"Z": "z2"}, None), ("O", "y", 1, None, {}, "T"), ("O", "y", 2, None, {}, "E"), ("C", "x", 1, "m1", {}, None), ("C", "y", 1, None, {"A": "a"}, None), ("C", "y", 2, None, {}, "E")]
    p = spark.createDataFrame(positions, "tbl string, axis string, ord int, concept string, dims map<string,string>, open_dim string").withColumn("code", F.lit(None).cast("string"))
    members = spark.createDataFrame([("E", 1, "none"), ("E", 2, "e2"), ("E", 3, "e3")], "dim string, ord int, member string")
    typed = spark.createDataFrame([("T", "xs:date")], "dim string, type string")
    cubes = cube.specs(spark.createDataFrame([("O", "s", "m1")], "tbl string, spec string, concept string"), spark.createDataFrame([("O", "s", "T", None, True), ("O", "s", "E", "e2", False), ("O", "s", "E", "e3", False), ("O", "s", "Z", "z1", False), ("O", "s", "Z", "z2", False)], "tbl string, spec string, dim string, member string, typed boolean"))
    got = workflows.open_rows(p, cubes, members, typed, {})
    assert sorted((r.tbl, r.key, r.synthetic) for r in got.collect()) == [("O", f"m1|E=e2,T=2024-12-31,Z={z}", True) for z in ("z1", "z2")]


def test_admission_by_members_is_admission(spark):
    rng = random.Random(9)
    primaries = [(f"T{s % 2}", f"s{s}", f"m{m}") for s in range(5) for m in range(4) if rng.random() < 0.6]
    dims = [(f"T{s % 2}", f"s{s}", d, m, False) for s in range(4) for d in "AB" if rng.random() < 0.8 for m in ("x0", "x1", "x2") if rng.random() < 0.7] + [(f"T{s % 2}", f"s{s}", "T", None, True) for s in (0, 3)]
    facts = [(i, f"m{rng.randint(0, 5)}", {d: rng.choice(["x0", "x1", "x2", "x9"]) for d in "ABT" if rng.random() < 0.5}) for i in range(300)]
    p = spark.createDataFrame(primaries, "tbl string, spec string, concept string")
    d = spark.createDataFrame(dims, "tbl string, spec string, dim string, member string, typed boolean")
    f = spark.createDataFrame(facts, "fact_id int, concept string, dims map<string,string>")
    told = lambda df: {r.fact_id: r.verdict for r in df.collect()}
    one, two = told(cube.admission(f, cube.specs(p, d), {"A": "x0"})), told(cube.admission_by_members(f, p, d, {"A": "x0"}))
    assert one == two and len(set(one.values())) == 3
    assert told(cube.admission_by_members(f, p.limit(0), d.limit(0), {})) == {i: "metric-not-primary" for i in range(300)}


def test_levels_send_no_table_through_the_driver(spark):
    from ledgerloom.operators import graph

    found = graph.levels(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "x")], "node string, source string"))
    assert {r.node: r.level for r in found.collect()} == {"a": 2, "b": 1, "c": 0, "x": None}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
