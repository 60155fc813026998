"""Formula linkbases to bindings, and the jobs."""

from pyspark.sql import functions as F

from ledgerloom.operators import binding, workflows
from ledgerloom.sources import formula, package

FORMULA = """<linkbase xmlns="http://www.xbrl.org/2003/linkbase" xmlns:m="http://m" xmlns:d="http://d" xmlns:x="http://x" xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:gen="http://xbrl.org/2008/generic" xmlns:va="http://xbrl.org/2008/assertion/value" xmlns:v="http://xbrl.org/2008/variable" xmlns:cf="http://xbrl.org/2008/filter/concept" xmlns:df="http://xbrl.org/2008/filter/dimension">
<gen:link xlink:type="extended" xlink:role="http://r/1">
<va:valueAssertion xlink:type="resource" xlink:label="rule" id="v1" test="$t = sum($s)"/>
<v:factVariable xlink:type="resource" xlink:label="vt"/><v:factVariable xlink:type="resource" xlink:label="vs" bindAsSequence="true" fallbackValue="0"/>
<v:variableArc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2008/variable-set" xlink:from="rule" xlink:to="vt" name="t"/><v:variableArc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2008/variable-set" xlink:from="rule" xlink:to="vs" name="s"/>
<cf:conceptName xlink:type="resource" xlink:label="c1"><cf:concept><cf:qname>m:a</cf:qname></cf:concept></cf:conceptName>
<df:explicitDimension xlink:type="resource" xlink:label="d1"><df:dimension><df:qname>d:REG</df:qname></df:dimension><df:member><df:qname>x:W</df:qname></df:member></df:explicitDimension>
<df:explicitDimension xlink:type="resource" xlink:label="d2"><df:dimension><df:qname>d:REG</df:qname></df:dimension><df:member><df:qname>x:A</df:qname></df:member><df:member><df:qname>x:B</df:qname></df:member></df:explicitDimension>
<v:variableFilterArc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2008/variable-set-filter" xlink:from="rule" xlink:to="c1"/>
<v:variableFilterArc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2008/variable-filter" xlink:from="vt" xlink:to="d1"/><v:variableFilterArc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2008/variable-filter" xlink:from="vs" xlink:to="d2"/>
</gen:link></linkbase>"""


def test_formula_rules_bind(spark, tmp_path):
    (tmp_path / "f.xml").write_text(FORMULA)
    links = package.linkbases(spark, str(tmp_path))
    assert [(r.rule, r.test, r.severity) for r in formula.lean_rules(links).collect()] == [("v1", "$t = sum($s)", "error")]
    assert sorted((r.var, r.fallback, r.sequence) for r in formula.variables(links).collect()) == [("s", "0", True), ("t", None, False)]
    rows = formula.binding_filters(links)
    assert sorted((r["var"], r.concept, r.dim, r.allowed) for r in rows.collect()) == [("s", "{http://m}a", "{http://d}REG", ["{http://x}A", "{http://x}B"]), ("t", "{http://m}a", "{http://d}REG", ["{http://x}W"])]
    fact = lambda reg, seg, v: ("{http://m}a", {"{http://d}REG": f"{{http://x}}{reg}", "SEG": seg}, v)
    facts = spark.createDataFrame([fact("W", "1", 5.0), fact("A", "1", 2.0), fact("B", "1", 3.0), fact("A", "2", 9.0)], "concept string, dims map<string,string>, value double")
    b = {r.group_key: (r.sums, r["values"]) for r in binding.bind(facts, rows, {}).collect()}
    assert b == {"SEG=1": ({"t": 5.0, "s": 5.0}, {"t": [5.0], "s": [2.0, 3.0]}), "SEG=2": ({"s": 9.0}, {"s": [9.0]})}


BOOLEAN = """<linkbase xmlns="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:gen="http://xbrl.org/2008/generic" xmlns:va="http://xbrl.org/2008/assertion/value" xmlns:v="http://xbrl.org/2008/variable" xmlns:cf="http://xbrl.org/2008/filter/concept" xmlns:df="http://xbrl.org/2008/filter/dimension" xmlns:bf="http://xbrl.org/2008/filter/boolean" xmlns:m="http://m" xmlns:d="http://d" xmlns:x="http://x">
<gen:link xlink:type="extended" xlink:role="http://r/2">
<va:valueAssertion xlink:type="resource" xlink:label="rule" id="v2" test="$p >= $q - count($q) + 1"/>
<v:factVariable xlink:type="resource" xlink:label="vp"/><v:factVariable xlink:type="resource" xlink:label="vq" bindAsSequence="true"/>
<v:variableArc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2008/variable-set" xlink:from="rule" xlink:to="vp" name="p"/><v:variableArc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2008/variable-set" xlink:from="rule" xlink:to="vq" name="q"/>
<cf:conceptName xlink:type="resource" xlink:label="c1"><cf:concept><cf:qname>m:a</cf:qname></cf:concept></cf:conceptName>
<df:explicitDimension xlink:type="resource" xlink:label="w"><df:dimension><df:qname>d:REG</df:qname></df:dimension><df:member><df:qname>x:W</df:qname></df:member></df:explicitDimension>
<df:explicitDimension xlink:type="resource" xlink:label="b"><df:dimension><df:qname>d:REG</df:qname></df:dimension><df:member><df:qname>x:B</df:qname></df:member></df:explicitDimension>
<bf:orFilter xlink:type="resource" xlink:label="either"/>
<bf:booleanFilterArc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2010/boolean-filter" xlink:from="either" xlink:to="w"/><bf:booleanFilterArc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2010/boolean-filter" xlink:from="either" xlink:to="b"/>
<v:variableFilterArc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2008/variable-set-filter" xlink:from="rule" xlink:to="c1"/>
<v:variableFilterArc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2008/variable-filter" xlink:from="vp" xlink:to="w"/><v:variableFilterArc xlink:type="arc" xlink:arcrole="http://xbrl.org/arcrole/2008/variable-filter" complement="true" xlink:from="vq" xlink:to="either"/>
</gen:link></linkbase>"""


def test_formula_rules_to_verdicts(spark, tmp_path):
    """From linkbases and an instance to verdicts: sequences, fallbacks, complements, boolean filters, full names."""
    from ledgerloom.sources import instance_xml

    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "f.xml").write_text(FORMULA)
    (tmp_path / "rules" / "g.xml").write_text(BOOLEAN)
    rules = formula.rules(package.linkbases(spark, str(tmp_path / "rules")))
    assert [r.id for r in rules] == ["v1", "v2"] and [v.sequence for v in rules[0].variables] == [True, False]
    rows = [("W", "1", "5"), ("A", "1", "2"), ("B", "1", "3"), ("A", "2", "9"), ("W", "3", "0"), ("W", "4", "7"), ("C", "4", "8"), ("C", "1", "4")]
    contexts = [{"id": f"c{i}", "dims": {"d:REG": f"x:{r}", "d:SEG": f"x:s{s}"}} for i, (r, s, _) in enumerate(rows)]
    facts = [{"concept": "m:a", "ctx_id": f"c{i}", "value": v} for i, (_, _, v) in enumerate(rows)]
    instance_xml.write_instance(str(tmp_path / "i.xbrl"), contexts, facts, "X", "2024-12-31", {"m": "http://m", "d": "http://d", "x": "http://x"})
    read = instance_xml.read_instances(spark, str(tmp_path / "i.xbrl")).withColumnRenamed("value_raw", "value")
    table = binding.rule_table(spark, rules)
    got = {(r.rule, r.group_key.partition("{http://x}s")[2][:1]): r.ok for r in binding.rule_verdicts(binding.bind_rules(read, table, {}), table).collect()}
    # v1: $t = sum($s) over A and B, 0 where there are none; no $t, no verdict. v2: $p >= all but W and B, less their number, plus 1
    assert got == {("v1", "1"): True, ("v1", "2"): None, ("v1", "3"): True, ("v1", "4"): False, ("v2", "1"): True, ("v2", "2"): None, ("v2", "3"): False, ("v2", "4"): False}


def test_boolean_filters(spark):
    tree = ("or", [("and", ["a", ("not", "b")]), "c"])
    row = spark.createDataFrame([(True, True, False), (True, False, False), (False, True, True)], "a boolean, b boolean, c boolean")
    assert [r[0] for r in row.select(formula.boolean_filter(tree, F.col)).collect()] == [False, True, True]


def test_dictionary_from_schemas(spark):
    rows = [("m1", "monetaryItemType", "xbrli:item", "instant", "debit", None, "p"), ("m2", "decimalItemType", "xbrli:item", "instant", None, None, "p"), ("h", "stringItemType", "xbrli:item", "instant", None, True, "p"), ("d", "stringItemType", "xbrldt:dimensionItem", "instant", None, None, "p")]
    c = formula.concepts(spark.createDataFrame(rows, "name string, type string, substitutionGroup string, periodType string, balance string, abstract boolean, prefix string"))
    assert sorted((r.qname, r.datatype, r.needs_refine) for r in c.collect()) == [("p:m1", "MONETARY", False), ("p:m2", "DECIMAL", True)]
    e = formula.enumerations(spark.createDataFrame([("m", "D", "top")], "metric string, domain string, head string"), spark.createDataFrame([("D", "top", "a", True), ("D", "a", "b", False), ("D", "b", "c", True), ("E", "top", "z", True)], "domain string, parent string, child string, usable boolean"))
    assert sorted(r.member for r in e.collect()) == ["a", "c"]


def test_jobs(spark):
    from ledgerloom.operators.cube import specs
    from tests.layouts import positions

    sel = workflows.module_selection(positions(spark), spark.createDataFrame([("M", "T2"), ("N", "T1")], "module string, tbl string"), "M")
    assert [(r.tbl, r.key) for r in sel.collect()] == [("T2", "mA|RFL=N,SEG=BUILDING")]
    facts = spark.createDataFrame([(0, "m", {"D": "1"}, {"K": "a"}, "5", 0), (1, "m", {"D": "1"}, {"K": "a"}, "6", 0), (2, "m", {}, {}, "text", None)], "fact_id long, concept string, dims map<string,string>, typed map<string,string>, value_raw string, decimals int")
    assert [tuple(r) for r in workflows.upload(facts).collect()] == [("m|D=1,K=typed:a", 5.0, 0, 2)]
    cubes = specs(spark.createDataFrame([("T", 1, "m")], "tbl string, spec int, concept string"), spark.createDataFrame([("T", 1, "D", "t", False), ("T", 1, "D", "a", False), ("T", 1, "D", "b", False)], "tbl string, spec int, dim string, member string, typed boolean"))
    cells = spark.createDataFrame([("T", f"m|D={x}", "m", {"D": x}) for x in ("t", "a", "b", "zz")], "tbl string, key string, concept string, dims map<string,string>")
    derivations = spark.createDataFrame([("m|D=t", "m|D=a", -1.0, 1.0), ("m|D=t", "m|D=b", -1.0, 1.0)], "target string, source string, coef double, target_coef double")
    metrics = spark.createDataFrame([("m", "MONETARY")], "concept string, datatype string")
    none = spark.createDataFrame([], "key string")
    made = {r.key: float(r.value) for r in workflows.generate_valid(cells, metrics, cubes, {}, derivations, none, "s").collect()}
    assert set(made) == {"m|D=t", "m|D=a", "m|D=b"} and made["m|D=t"] == made["m|D=a"] + made["m|D=b"]
    terms = spark.createDataFrame([("r", 1, "lhs", 1.0, "m|D=t"), ("r", 1, "rhs", 1.0, "m|D=a"), ("r", 1, "rhs", 1.0, "m|D=b")], "code string, inst int, side string, coef double, key string")
    judged = spark.createDataFrame([(i, k, "m", {"D": k[-1]}, v, 0) for i, (k, v) in enumerate([("m|D=t", 9.0), ("m|D=a", 1.0), ("m|D=b", 2.0)])] + [(9, "m|D=q", "m", {"D": "q"}, 1.0, 0)], "fact_id int, key string, concept string, dims map<string,string>, value double, decimals int")
    report = workflows.validate(judged, terms, cubes, {})
    assert {r.verdict: r.n for r in report.dimensional.collect()} == {"valid": 3, "invalid": 1} and [r.ok for r in report.rules.collect()] == [False] and report.facts.count() == 3
    state, counts = workflows.solve_job(judged.select("key", "value", "decimals"), terms, derivations)
    assert counts == [1, 0] and {r.key: r.value for r in state.collect()}["m|D=t"] == 3.0
    eq = spark.createDataFrame([("e1", "t", 1.0), ("e1", "a", -1.0), ("e1", "b", -1.0), ("e2", "u", 1.0), ("e2", "t", -1.0), ("e2", "c", -1.0)], "code string, key string, coef double")
    v = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 4.0)], "key string, value double")
    got = {r.key: r.value for r in workflows.greedy(eq, v, spark.createDataFrame([("t", "e1"), ("u", "e2")], "key string, code string")).collect()}
    assert got["t"] == 3.0 and got["u"] == 7.0
