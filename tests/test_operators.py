"""Operators on small facts, layouts, graphs and equations."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import keys as K
from ledgerloom.functions import values as V
from ledgerloom.operators import binding, catalog, cube, derive, evaluate, generate, graph, layout, solve

MAP = "map<string,string>"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_names(spark):
    spaces = F.create_map(F.lit("e"), F.lit("http://x"), F.lit(""), F.lit("http://d"))
    assert one(spark, K.clark(F.lit("e:m1"), spaces)) == "{http://x}m1"
    assert one(spark, K.clark(F.lit("m1"), spaces)) == "{http://d}m1"
    assert one(spark, K.clark(F.lit("q:m1"), spaces)) == "q:m1"
    assert one(spark, K.local_name(F.lit("{http://x}own_own_ab_m1"), ("own_", "ab_"))) == "m1"
    assert one(spark, K.qualified_member(F.lit("own_CU:x1"), ("own_",))) == "CU:x1"
    assert one(spark, K.template_of(F.lit("C01.00.01.02"))) == "C01.00.01" and one(spark, K.template_of(F.lit("C01.00"))) == "C01.00"
    assert one(spark, K.table_refs(F.lit("{t: C01.00, r: 1} = {t: F02.00} + {t: C01.00}"))) == ["C01.00", "F02.00"]
    assert one(spark, K.url_to_path(F.lit("http://a.b/c.xsd"), "root/")) == "root/a.b/c.xsd"
    assert one(spark, K.compare_text(F.lit("  A \n b "))) == "a b"


def test_keys_drop_defaults_and_sort(spark):
    dims = F.create_map(*[F.lit(x) for x in ("SEG", "B", "REG", "x0", "RFL", "A")])
    assert one(spark, K.dim_key(dims, F.create_map(F.lit("REG"), F.lit("x0")))) == "RFL=A,SEG=B"
    assert one(spark, K.cell_key(F.lit("m"), F.create_map().cast(MAP))) == "m|"
    assert one(spark, K.merge_aspects(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")), F.create_map(F.lit("b"), F.lit("2")))) == {"a": "1", "b": "2"}


def test_values(spark):
    assert one(spark, V.num(F.lit("x"))) == 0.0 and one(spark, V.num_list(F.array(F.lit(1.0), F.lit(None), F.lit(2.0)))) == 3.0
    assert one(spark, V.round_to_decimals(F.lit(2500.0), F.lit(-3))) == 2000.0 and one(spark, V.round_to_decimals(F.lit(3500.0), F.lit(-3))) == 4000.0
    assert one(spark, V.half_ulp(F.lit(-3))) == 500.0 and one(spark, V.half_ulp(F.lit(None).cast("int"))) == 0.5
    assert one(spark, V.formatted(F.lit(2.5), F.lit("INTEGER"))) == "2" and one(spark, V.formatted(F.lit(2.5), F.lit("PERCENTAGE"))) == "2.5000"
    assert one(spark, V.coerced(F.lit("1.0")) == V.coerced(F.lit("1"))) and not one(spark, V.coerced(F.lit("true")) == V.coerced(F.lit("1")))
    assert one(spark, V.flat(F.array(F.array(F.lit(1), F.lit(None)), F.array(F.lit(2))))) == [1, 2]


def test_inherited_aspects(spark):
    nodes = spark.createDataFrame([("T", "a", None, "m1", {"d": "1"}), ("T", "b", "a", None, {"e": "2"}), ("T", "c", "b", "m2", {"d": "9"})], "tbl string, node string, parent string, concept string, dims map<string,string>")
    got = {r.node: (r.concept, r.dims, r.depth) for r in layout.inherited(nodes).collect()}
    assert got == {"a": ("m1", {"d": "1"}, 0), "b": ("m1", {"d": "1", "e": "2"}, 1), "c": ("m2", {"d": "9", "e": "2"}, 2)}


def test_unresolved_terms_and_labels(spark):
    from tests.layouts import positions

    p = positions(spark)
    terms = spark.createDataFrame([("T1", "0010", "0010", None), ("T1", "9999", "0010", None)], "tbl string, r string, c string, z string")
    assert [r.r for r in layout.unresolved(terms, p).collect()] == ["9999"] and layout.resolve(terms, p).count() == 1
    labelled = layout.with_labels(layout.resolve(terms, p), spark.createDataFrame([("mA", "Amount", "MONETARY")], "concept string, label string, datatype string"), spark.createDataFrame([("BUILDING", "Building")], "member string, label string"))
    assert labelled.first().label == "Amount · Building"


def test_bind_equals_open_pairing_on_closed_tables(spark):
    facts = spark.createDataFrame([("m", {"A": "1"}, 5.0), ("n", {"A": "1"}, 5.0), ("m", {"A": "2"}, 1.0)], "concept string, dims map<string,string>, value double")
    terms = spark.createDataFrame([("r", "i", 1.0, "m", {"A": "1"}), ("r", "i", -1.0, "n", {"A": "1"})], "code string, inst string, coef double, concept string, dims map<string,string>")
    assert [(r.signature, r.residual, r.ok) for r in binding.open_check(terms, facts).collect()] == [("", 0.0, True)]
    lone = binding.lone_targets(terms, facts).first()
    assert (lone.target_key, lone.derived) == ("A=1", 5.0)


def test_empty_filter_wants_presence(spark):
    facts = spark.createDataFrame([("m", {"A": "1"}, 1.0), ("m", {}, 2.0)], "concept string, dims map<string,string>, value double")
    flt = spark.createDataFrame([("r", "v", "m", "A", [])], "rule string, var string, concept string, dim string, allowed array<string>")
    assert [r.value for r in binding.candidates(facts, flt, {"A": "x0"}).collect()] == [1.0]


def test_log_fixes(spark):
    facts = spark.createDataFrame([(10, "t", 9.0), (11, "s", 4.0), (12, "s", 3.0)], "src_line int, concept string, value double")
    lines = spark.createDataFrame([("r", [10, 11, 12])], "rule string, lines array<int>")
    assert binding.log_fixes(lines, facts, spark.createDataFrame([("r", "t")], "rule string, concept string")).first()[1:] == (10, 7.0)


def test_additive_verdicts(spark):
    terms = spark.createDataFrame([("r", 1, "lhs", 1.0, "a"), ("r", 1, "rhs", 1.0, "b"), ("r", 1, "rhs", 2.0, "c"), ("r", 2, "lhs", 1.0, "a"), ("r", 2, "rhs", 1.0, "b")], "code string, inst int, side string, coef double, key string")
    facts = spark.createDataFrame([("a", 2500.0, -3), ("b", 1000.0, 0)], "key string, value double, decimals int")
    v = {r.inst: (r.lhs, r.rhs, r.tol, r.any_absent, r.ok) for r in evaluate.additive_verdicts(terms, facts).collect()}
    assert v == {1: (2500.0, 1000.0, 500.5, True, False), 2: (2500.0, 1000.0, 500.5, False, False)}
    r = evaluate.rule_rollup(evaluate.additive_verdicts(terms, facts)).first()
    assert (r.instances, r.failing, r.with_absent, r.examples) == (2, 2, 1, ["1", "2"])


def test_typed_dimensions_must_be_present(spark):
    cubes = cube.specs(spark.createDataFrame([("T", 1, "m")], "tbl string, spec int, concept string"), spark.createDataFrame([("T", 1, "D", "x0", False), ("T", 1, "D", "x1", False), ("T", 1, "K", None, True)], "tbl string, spec int, dim string, member string, typed boolean"))
    facts = spark.createDataFrame([(1, "m", {"K": "any"}), (2, "m", {}), (3, "m", {"K": "k", "D": "x2"}), (4, "m", {"K": "k", "Z": "x1"}), (5, "q", {"K": "k"})], "fact_id int, concept string, dims map<string,string>")
    got = {r.fact_id: r.verdict for r in cube.admission(facts, cubes, {"D": "x0"}).collect()}
    assert got == {1: "valid", 2: "invalid", 3: "invalid", 4: "invalid", 5: "metric-not-primary"}


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "parent string, child string")
    got = cube.reachable(e, spark.createDataFrame([("a",)], "start string"))
    assert sorted(r.node for r in got.collect()) == ["a", "b", "c", "d"]
    u = e.withColumn("usable", F.col("child") != "b")
    assert sorted(r.node for r in cube.usable_members(u, spark.createDataFrame([("a",)], "start string")).collect()) == ["a", "c", "d"]


def test_levels_and_components_against_brute_force(spark):
    rng = random.Random(1)
    dag = [(f"n{b}", f"n{a}") for b in range(25) for a in range(b) if rng.random() < 0.08]
    sources = {}
    for n, s in dag:
        sources.setdefault(n, set()).add(s)
    level = lambda n: 1 + max(map(level, sources[n])) if n in sources else 0
    got = {r.node: r.level for r in graph.levels(spark.createDataFrame(dag, "node string, source string")).collect()}
    assert got == {n: level(n) for n in {x for e in dag for x in e}}
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)]
    root = list(range(80))
    for _ in range(80):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: root[x] for e in edges if e[0] != e[1] for x in e}


def test_exact_solver_holds_or_reports(spark):
    rows = [(1, "e1", "a", 1.0, 10.0, 3.0, False), (1, "e1", "b", 1.0, 10.0, 4.0, False), (1, "e2", "b", 1.0, 6.0, 4.0, False), (2, "f1", "c", 1.0, 1.0, 0.0, False), (2, "f2", "c", 1.0, 2.0, 0.0, False), (3, "g1", "d", 1.0, 0.1, 0.0, False), (3, "g1", "e", 1.0, 0.1, 0.3, True)]
    t = spark.createDataFrame(rows, "component int, eq string, key string, coef double, rhs double, start double, fixed boolean")
    got = {r.key: (r.value, r.consistent) for r in solve.solve(t).collect()}
    assert got == {"a": (4.0, True), "b": (6.0, True), "c": (0.0, False), "d": (-0.2, True), "e": (0.3, True)}
    near = {r.key: r.value for r in solve.solve(t, "least_squares").collect()}
    assert abs(near["c"] - 1.5) < 1e-9
    up = {r.key: (r.value, r.consistent) for r in solve.solve(t.where("component = 1"), "non_negative").collect()}
    assert abs(up["a"][0] - 4) < 1e-5 and up["a"][1]
    held = solve.residuals(t.where("component = 1"), solve.solve(t.where("component = 1")))
    assert held.where("abs(residual) > 1e-9").count() == 0
    assert solve.solve(t, most=0).where("consistent IS NOT NULL").count() == 0


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(weights=st.lists(st.integers(0, 50), min_size=1, max_size=6), total=st.integers(0, 500))
def test_distribution_is_exact(spark, weights, total):
    parts = spark.createDataFrame([(1, i, float(w), total) for i, w in enumerate(weights)], "g int, i int, w double, total int")
    got = [r.assigned for r in derive.distribute(parts, ["g"], "w", "total", ["i"]).orderBy("i").collect()]
    assert sum(got) == total and all(a >= 0 for a in got)
    if sum(weights):
        assert all(abs(a - total * w / sum(weights)) <= 1 + 1e-6 for a, w in zip(got, weights, strict=True))


def test_repairs(spark):
    free = spark.createDataFrame([(1, 10.0, 4.0, False, 0), (1, 10.0, 0.0, True, 1), (1, 10.0, 0.0, True, 2)], "g int, total double, v double, free boolean, i int")
    assert [r.assigned for r in derive.absorb(free, ["g"], "total", "v", "free", ["i"]).orderBy("i").collect()] == [4.0, 6.0, 0.0]
    d = spark.createDataFrame([("2024-05-01", "2024-01-01"), ("2024-01-01", "2024-02-01")], "s string, e string").select(F.to_date("s").alias("s"), F.to_date("e").alias("e"))
    assert [tuple(map(str, r)) for r in derive.order_dates(d, "s", "e", "2000-01-01", "2099-01-01").collect()] == [("2000-01-01", "2099-01-01"), ("2024-01-01", "2024-02-01")]
    plans = spark.createDataFrame([("p", "t", 1.0), ("p", "a", -1.0), ("p", "b", -1.0)], "code string, key string, coef double")
    values = spark.createDataFrame([("t", 10.0), ("a", 3.0), ("b", 4.0)], "key string, value double")
    fixed = {r.key: r.value for r in derive.cross_table(plans, values, spark.createDataFrame([("t", 5), ("a", 1), ("b", 2)], "key string, incidence int")).collect()}
    assert fixed == {"t": 10.0, "a": 6.0, "b": 4.0}
    guarded = derive.derive_guarded(spark.createDataFrame([("k", 1.0), ("j", 1.0)], "key string, value double"), spark.createDataFrame([("k", 2600.0, -3), ("j", 7.0, 0)], "key string, new double, decimals int"), F.col("key") == "k")
    assert {r.key: r.value for r in guarded.collect()} == {"k": 3000.0, "j": 1.0}


def test_generation_is_seeded_and_typed(spark):
    d = spark.range(50).select(F.col("id").cast("string").alias("k"))
    for kind in ("MONETARY", "DECIMAL", "PERCENTAGE", "INTEGER", "BOOLEAN", "DATE"):
        v = d.select(generate.value_of(F.lit(kind), F.col("k"), "s").alias("v"))
        assert v.where(~V.is_valid_text(F.lit(kind), F.col("v"))).count() == 0 and v.collect() == d.select(generate.value_of(F.lit(kind), F.col("k"), "s").alias("v")).collect()
    facts = spark.createDataFrame([("m", "k1", "12", "uGBP"), ("s", "k2", "words", None), ("e", "k3", "d:x1", None), ("e", "k4", "d:x2", None), ("n", "k5", None, None)], "concept string, dim_key string, value string, unit string")
    out = {r.dim_key: r.value for r in generate.clone(facts, spark.createDataFrame([("m", "INTEGER")], "concept string, datatype string"), "s").collect()}
    assert out["k2"] == "words" and out["k5"] is None and out["k1"].isdigit() and out["k3"] in ("d:x1", "d:x2")


def test_catalogue(spark):
    rows = spark.createDataFrame([("C01.00.01",), ("C01.00.02",), ("C010.00",), ("D02.00",)], "tbl string")
    hit = catalog.in_template_scope(rows, spark.createDataFrame([("C01.00",), ("D02.00",)], "template string"))
    assert sorted(r.tbl for r in hit.collect()) == ["C01.00.01", "C01.00.02", "D02.00"]
    parts = [spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), spark.createDataFrame([("a", 2)], "k string, v int")]
    assert {r.k: r.v for r in catalog.merge_fragments(parts, ["k"]).collect()} == {"a": 2, "b": 1}
    assert {r.k: r.v for r in catalog.merge_fragments(parts, ["k"], last_wins=False).collect()} == {"a": 1, "b": 1}
    points = spark.createDataFrame([("T", "m|", "m", {})], "tbl string, key string, concept string, dims map<string,string>")
    facts = spark.createDataFrame([("m", {"O": "r1"}, 1.0), ("m", {"O": "r2"}, 2.0)], "concept string, dims map<string,string>, value double")
    assert sorted((r.open[0].value, r.value) for r in catalog.open_rows(points, facts, ["O"]).collect()) == [("r1", 1.0), ("r2", 2.0)]
    assert catalog.mode_of(spark.createDataFrame([("x",), ("y",), ("y",)], "d string"), "d").first().d == "y"
