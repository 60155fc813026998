"""Instances, linkbases, packages, logs and the streaming extension."""

import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import instance_xml, logs, package
from ledgerloom.streaming import revalidate, windowed_counts

SPACES = {"m": "http://m", "d": "http://d", "x": "http://x", "t": "http://t"}


def write(path):
    contexts = [{"id": "c1", "dims": {"d:REG": "x:EU"}}, {"id": "c2", "dims": {}, "typed": {"d:KEY": ("t:id", "A&1")}}]
    facts = [{"concept": "m:m1", "ctx_id": "c1", "unit": "uGBP", "decimals": -3, "value": "1000"}, {"concept": "m:m2", "ctx_id": "c2", "value": "tea & <cake>"}, {"concept": "m:m1", "ctx_id": "gone", "value": "5"}]
    instance_xml.write_instance(str(path), contexts, facts, "LEI0", "2024-12-31", SPACES)


def test_instance_round_trip(spark, tmp_path):
    write(tmp_path / "a.xml")
    write(tmp_path / "b.xbrl")
    assert (tmp_path / "a.xml").read_bytes()[:3] == b"\xef\xbb\xbf"
    f = instance_xml.read_instances(spark, str(tmp_path))
    rows = {(r.file, r.fact_id): r for r in f.collect()}
    assert len(rows) == 6
    first, second, third = (rows["a.xml", i] for i in range(3))
    assert (first.concept, first.dims, first.unit, first.decimals, first.value_num, first.period) == ("{http://m}m1", {"{http://d}REG": "{http://x}EU"}, "uGBP", -3, 1000.0, "2024-12-31")
    assert (second.typed, second.value_raw, second.dim_key, second.value_num) == ({"{http://d}KEY": "A&1"}, "tea & <cake>", "{http://d}KEY=typed:A&1", None)
    assert third.dims == {} and third.value_num == 5.0
    p = instance_xml.profile(f).first()
    assert (p.facts, p.metrics, p.most_dims, p.nil_facts) == (6, 2, 1, 0)
    edited = instance_xml.apply_edits(f, spark.createDataFrame([(0, "7"), (99, "8")], "fact_id long, value_raw string"))
    assert {r.value_raw for r in edited.where("fact_id = 0").collect()} == {"7"}


def test_build_deduplicates(spark):
    cells = spark.createDataFrame([("m", {"D": "x0"}, "1"), ("m", {}, "2"), ("m", {"D": "x1"}, ""), ("q", {}, "3")], "concept string, dims map<string,string>, value string")
    metrics = spark.createDataFrame([("m", "MONETARY", "instant"), ("q", "PERCENTAGE", "instant")], "concept string, datatype string, period_type string")
    contexts, facts = instance_xml.build(cells, metrics, {"D": "x0"})
    assert contexts.count() == 1 and {(r.concept, r.unit, r.decimals, r.value) for r in facts.collect()} == {("m", "uGBP", -3, "1"), ("q", "uPURE", 4, "3")}


LINKBASE = """<linkbase xmlns="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:d="http://xbrl.org/2005/xbrldt">
<definitionLink xlink:type="extended" xlink:role="http://r/1">
<loc xlink:type="locator" xlink:href="a.xsd#m1" xlink:label="l1"/><loc xlink:type="locator" xlink:href="h.xsd#hyp" xlink:label="l2"/>
<definitionArc xlink:type="arc" xlink:arcrole="http://xbrl.org/int/dim/arcrole/all" xlink:from="l1" xlink:to="l2" d:targetRole="http://r/2" order="1"/></definitionLink>
<genLink xlink:type="extended" xlink:role="http://r/3"><loc xlink:type="locator" xlink:href="t.xml#n1" xlink:label="k1"/><label xlink:type="resource" xlink:label="k2">0010</label><arc xlink:type="arc" xlink:from="k1" xlink:to="k2" xlink:arcrole="http://x/element-label"/></genLink>
</linkbase>"""


def test_linkbases(spark, tmp_path):
    (tmp_path / "def.xml").write_text(LINKBASE)
    links = package.linkbases(spark, str(tmp_path))
    arc = package.hypercube_arcs(links).first()
    assert (arc.role, arc.kind, arc.from_id, arc.to_id, arc.target_role) == ("http://r/1", "all", "a.xsd#m1", "h.xsd#hyp", "http://r/2")
    codes = package.node_codes(links, "any").collect()
    assert ("n1", "0010") in {(r.node, r.code) for r in codes}


def test_package_files(spark, tmp_path):
    (tmp_path / "fws" / "fwa" / "tab").mkdir(parents=True)
    (tmp_path / "fws" / "fwa" / "tab" / "c01.00-rend.xml").write_text("<x/>")
    (tmp_path / "fws" / "fwa" / "mod1.xsd").write_text('<s><import schemaLocation="../tab/c01.00/c01.00.xsd"/><import schemaLocation="../tab/c02.00/c02.00.xsd"/></s>')
    (tmp_path / "taxonomyPackage.xml").write_text('<p><e href="http://h/fws/fwa/mod1.xsd"/><e href="http://h/fws/fwb/m.xsd"/><e href="http://h/fws/fwa/m2.xsd"/></p>')
    assert [(r.code, r.framework) for r in package.list_tables(spark, str(tmp_path)).collect()] == [("C01.00", "fwa")]
    assert sorted((r.module, r.tbl) for r in package.module_index(spark, str(tmp_path)).collect()) == [("mod1", "C01.00"), ("mod1", "C02.00")]
    assert {r.framework: r.n for r in package.entry_points(spark, str(tmp_path)).collect()} == {"fwa": 2, "fwb": 1}
    z = tmp_path / "p.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("in/a.txt", "x")
    to = package.extract(str(z), str(tmp_path / "cache"))
    assert package.extract(str(z), str(tmp_path / "cache")) == to
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("../out.txt", "x")
    with pytest.raises(ValueError):
        package.extract(str(z), str(tmp_path / "cache"))
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    assert package.cached(spark, f"{tmp_path}/kept", make).count() == package.cached(spark, f"{tmp_path}/kept", make).count() == 3 and calls == [1]


def test_rules_and_dictionary(spark):
    rows = spark.createDataFrame([("v1", "{t: A01.00} = 1", " ", "scope({t: A01.00, r: 1})", "error", "B02.00", "", "yes", "No")], "code string, expression string, simplified string, scope string, severity string, T1 string, T2 string, include string, deactivated string")
    r = package.workbook_rules(rows).first()
    assert (r.tables, r.include, r.deactivated) == (["B02.00", "A01.00"], True, False) and r.expression.endswith("scope({t: A01.00, r: 1})")
    d = spark.createDataFrame([("a", 1, "first"), ("a", 2, "last")], "code string, row int, label string")
    assert package.dictionary(d, "metric").first().label == "first" and package.dictionary(d, "domain").first().label == "last"
    m = package.module_rules(spark.createDataFrame([("v", "T1"), ("v", "T2")], "code string, tbl string"), spark.createDataFrame([("v", "label", "verbose", "b"), ("v", "error", "plain", "c"), ("v", "error", "verbose", "a")], "code string, origin string, role string, message string"))
    assert m.first()[:] == ("v", ["T1", "T2"], "a")
    assert package.kind_of_workbook(["Metrics", "Dimensions", "Domains"]) == "dpm_dictionary" and package.kind_of_workbook(["C 01.00"]) == "annotated_templates" and package.kind_of_workbook(["x"]) == "unknown"
    cells = spark.createDataFrame([("s", 0, 3, "Metrics"), ("s", 1, 1, "0010"), ("s", 1, 3, "m1"), ("s", 2, 1, "0020"), ("s", 2, 3, "m2"), ("s", 2, 2, "0001")], "sheet string, row int, col int, value string")
    assert sorted((r.code, r.metric) for r in package.sheet_datapoints(cells).collect()) == [("0010", "m1"), ("0020", "m2")]


def test_families_take_the_first_pattern(spark):
    d = spark.createDataFrame([(["B1", "A1"],), (["Z"],)], "tables array<string>")
    assert [r[0] for r in d.select(logs.family(F.col("tables"), [("a", "^A"), ("b", "^B")])).collect()] == ["a", "other"]


def test_stream_revalidates_what_it_touches(spark, tmp_path):
    terms = spark.createDataFrame([("r1", "i", "lhs", 1.0, "a"), ("r1", "i", "rhs", 1.0, "b"), ("r2", "i", "lhs", 1.0, "c")], "code string, inst string, side string, coef double, key string")
    schema = "key string, value double, decimals int, at long"
    for rows in ([("a", 9.0, 0, 1), ("a", 5.0, 0, 2)], [("b", 5.0, 0, 3)], [("b", 7.0, None, 4), ("z", 1.0, 0, 5)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        verdicts = revalidate(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), terms).writeStream.outputMode("update")
        # a restarted query goes on from its state
        keep = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{tmp_path}/verdicts")
        verdicts.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    v = {r.batch: (r.code, r.lhs, r.rhs, r.tol, r.any_absent, r.ok) for r in spark.read.parquet(f"{tmp_path}/verdicts").collect()}
    assert v == {0: ("r1", 5.0, 0.0, 0.5, True, False), 1: ("r1", 5.0, 5.0, 1.0, False, True), 2: ("r1", 5.0, 7.0, 1.0, False, False)}


def test_windowed_counts(spark):
    e = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:10:00", "a", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.n, r.total) for r in windowed_counts(e).collect()) == [(1, 4.0), (2, 3.0)]


def test_a_package_is_unpacked_once(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("a/t.xml", "<t/>")
        z.writestr("a/", "")
    cache = str(tmp_path / "cache")
    first, second = (package.ingest(spark, str(tmp_path / "p.zip"), cache) for _ in range(2))
    assert first[0] == second[0] and len(first[0]) == 64
    assert [(r.path, bytes(r.content)) for r in second[1].collect()] == [("a/t.xml", b"<t/>")]
    assert package.ingest_all(spark.createDataFrame([], "path string, content binary"), str(tmp_path / "none")).count() == 0
