"""Queries over files: linkbases, schemas, workbooks and packages whose texts Spark's tasks write from the tables, with the DuckDB SQL of the same result.

The files grow with the tables: one for each brand and size of parts, nation or order date; what is read from them goes through the sources that read files of a store.
"""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import keys as K
from .operators import cube, layout
from .queries import ORACLE, query, written_instances
from .session import TEXTS_A_TASK, dealt, settled, shared_dir
from .sources import formula, instance_xml, package, star, workbook

# functions go to the workers by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LINKBASE = (
    '<link:linkbase xmlns:link="http://www.xbrl.org/2003/linkbase" xmlns:xlink="http://www.w3.org/1999/xlink" xmlns:xbrldt="http://xbrl.org/2005/xbrldt" xmlns:gen="http://xbrl.org/2008/generic" '
    'xmlns:table="http://xbrl.org/2014/table" xmlns:formula="http://xbrl.org/2008/formula" xmlns:m="m" xmlns:d="d" xmlns:x="x">'
)


def text(*parts) -> Column:
    """Pieces of text and columns, one after the other."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def files(pieces: DataFrame, head: str, foot: str) -> DataFrame:
    """(path, content) as a binary scan gives them, from pieces (path, piece); a file's pieces are sorted."""
    whole = F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list("piece")), ""), F.lit(foot))
    return pieces.groupBy("path").agg(whole.cast("binary").alias("content"))


def locator(name: Column, href: str = "s.xsd#") -> Column:
    return text('<link:loc xlink:type="locator" xlink:href="', href, name, '" xlink:label="l_', name, '"/>')


def arc(kind: str, source: Column, target: Column, more: Column | str = "") -> Column:
    return text(f'<link:arc xlink:type="arc" xlink:arcrole="http://xbrl.org/int/dim/arcrole/{kind}" xlink:from="l_', source, '" xlink:to="l_', target, '"', more, "/>")


# Hypercubes


def cube_arcs(spark, d) -> DataFrame:
    """(tbl, role, kind, from_id, to_id, target_role): a cube for each region. Its customers hang on nations in the role `geo`; odd nations' arcs switch to another role, where their customers are; in `geo` they have
    decoys. Every tenth customer leads back to its nation."""
    c = star.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = star.table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    r = star.table(spark, d, "region").select("r_regionkey")
    i = lambda k, column: text(f"g.xsd#{k}", F.col(column))
    role_of = F.when(F.col("n_nationkey") % 2 == 1, text("nat", F.col("n_nationkey") % 3))
    row = lambda df, role, kind, a, b, to=F.lit(None): df.select(F.lit("T").alias("tbl"), role.alias("role"), F.lit(kind).alias("kind"), a.alias("from_id"), b.alias("to_id"), to.cast("string").alias("target_role"))
    geo, spec = F.lit("geo"), text("cube", F.col("r_regionkey"))
    cn = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    odd = F.col("n_nationkey") % 2 == 1
    return (
        row(r, spec, "all", i("TOTAL", "r_regionkey"), text("h.xsd#hyp"))
        .unionByName(row(r, spec, "hypercube-dimension", text("h.xsd#hyp"), text("h.xsd#CUST"), F.lit("dims")))
        .unionByName(row(r, spec, "hypercube-dimension", text("h.xsd#hyp"), text("h.xsd#ST")))
        .unionByName(row(r.where("r_regionkey % 2 = 0"), spec, "hypercube-dimension", text("h.xsd#hyp"), text("h.xsd#PRIO")))
        .unionByName(row(r.limit(1), F.lit("dims"), "dimension-domain", text("h.xsd#CUST"), text("g.xsd#W"), F.lit("geo")))
        .unionByName(row(r, spec, "dimension-domain", text("h.xsd#ST"), text("g.xsd#STS"), F.when(F.col("r_regionkey") < 3, "all states").otherwise("few states")))
        .unionByName(row(r.limit(1).select(F.explode(F.lit(["F", "O"])).alias("s")), F.lit("all states"), "domain-member", text("g.xsd#STS"), text("g.xsd#", F.col("s"))))
        .unionByName(row(r.limit(1), F.lit("few states"), "domain-member", text("g.xsd#STS"), text("g.xsd#F")))
        .unionByName(row(r.where("r_regionkey != 1"), geo, "domain-member", text("g.xsd#W"), i("R", "r_regionkey")))
        .unionByName(row(n, geo, "domain-member", i("R", "n_regionkey"), i("N", "n_nationkey"), role_of))
        .unionByName(row(cn, F.coalesce(role_of, geo), "domain-member", i("N", "n_nationkey"), i("C", "c_custkey")))
        .unionByName(row(n.where(odd), geo, "domain-member", i("N", "n_nationkey"), i("DECOY", "n_nationkey")))
        .unionByName(row(cn.where("c_custkey % 10 = 0"), F.coalesce(role_of, geo), "domain-member", i("C", "c_custkey"), i("N", "n_nationkey")))
    )


_CUBE_ARCS = """a(role, src, dst, target) AS (SELECT 'geo', 'W', 'R' || r_regionkey, NULL FROM region WHERE r_regionkey != 1
 UNION ALL SELECT 'geo', 'R' || n_regionkey, 'N' || n_nationkey, CASE WHEN n_nationkey % 2 = 1 THEN 'nat' || n_nationkey % 3 END FROM nation
 UNION ALL SELECT CASE WHEN n_nationkey % 2 = 1 THEN 'nat' || n_nationkey % 3 ELSE 'geo' END, 'N' || n_nationkey, 'C' || c_custkey, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT 'geo', 'N' || n_nationkey, 'DECOY' || n_nationkey, NULL FROM nation WHERE n_nationkey % 2 = 1
 UNION ALL SELECT CASE WHEN n_nationkey % 2 = 1 THEN 'nat' || n_nationkey % 3 ELSE 'geo' END, 'C' || c_custkey, 'N' || n_nationkey, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 10 = 0),
w(role, id) AS (SELECT 'geo', 'W' UNION SELECT coalesce(a.target, a.role), a.dst FROM w JOIN a ON a.role = w.role AND a.src = w.id)"""


@query(f"WITH RECURSIVE {_CUBE_ARCS} SELECT DISTINCT id AS member FROM w WHERE id != 'W'")
def q_role_closure(spark, d):
    """EV9: the members below the world over (id, role): target roles switch, decoys of the role that was left are not reached, cycles end."""
    arcs = cube_arcs(spark, d).where("kind = 'domain-member'")
    start = spark.createDataFrame([("T", "geo", "g.xsd#W")], "tbl string, role string, id string")
    return cube.role_members(arcs, start).select(F.substring_index("member", "#", -1).alias("member"))


@query(f"""WITH RECURSIVE {_CUBE_ARCS}, m AS (SELECT DISTINCT id FROM w WHERE id != 'W'),
f AS (SELECT o_orderkey, o_custkey % 6 AS top, 'C' || (o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 1000000 ELSE 0 END) AS cust, CASE o_orderstatus WHEN 'P' THEN 'F' ELSE o_orderstatus END AS st, o_orderpriority < '3' AS prio FROM orders)
SELECT top, CASE WHEN top = 5 THEN 'metric-not-primary' WHEN cust IN (SELECT id FROM m) AND (top < 3 OR st = 'F') AND prio = (top % 2 = 0) THEN 'valid' ELSE 'invalid' END AS verdict, count(*) AS n FROM f GROUP BY 1, 2""")
def q_cube_from_arcs(spark, d):
    """SRC23, EV6, EV9, JN17: facts of all orders against cubes that come from dimensional arcs: roles that switch, a typed dimension, a default member."""
    o = star.table(spark, d, "orders")
    cust = text("C", F.col("o_custkey") + F.when(F.col("o_orderkey") % 11 == 0, 1_000_000).otherwise(0))
    state = F.when(F.col("o_orderstatus") == "P", "F").otherwise(F.col("o_orderstatus"))
    dims = F.map_filter(F.create_map(F.lit("CUST"), cust, F.lit("ST"), F.when(state != "O", state), F.lit("PRIO"), F.when(F.col("o_orderpriority") < "3", F.col("o_orderpriority"))), lambda _, v: v.isNotNull())
    facts = o.select(F.col("o_orderkey").alias("fact_id"), text("TOTAL", F.col("o_custkey") % 6).alias("concept"), dims.alias("dims"), (F.col("o_custkey") % 6).alias("top"))
    v = cube.admission_by_members(facts, *map(settled, cube.cube_rows(cube_arcs(spark, d))), {"ST": "O"})
    return facts.select("fact_id", "top").join(v, "fact_id").groupBy("top", "verdict").agg(F.count("*").alias("n"))


# Layouts


def layout_files(spark, d) -> DataFrame:
    """(path, content) of a layout for each brand and size: the parts as rows below an abstract node, two column breakdowns, an open layer; and of the labels with their codes."""
    p = star.table(spark, d, "part").select("p_partkey", "p_size", F.regexp_replace("p_brand", "[^0-9]", "").alias("b"))
    name, k = text("b", F.col("b"), ".", F.col("p_size")), F.col("p_partkey")
    dims = F.when(k % 2 == 0, '<formula:explicitDimension dimension="d:BASE"><formula:member><formula:qname>x:own</formula:qname></formula:member></formula:explicitDimension>').otherwise("")
    rows = p.select(
        text("p/fws/f/tab/", name, "-rend.xml").alias("path"),
        text('<table:ruleNode xlink:type="resource" xlink:label="n', k, '" id="n', k, '"', F.when(k % 5 == 0, ' abstract="true"').otherwise(""), "><formula:concept><formula:qname>m:p", k, "</formula:qname></formula:concept>", dims, "</table:ruleNode>",
             '<table:definitionNodeSubtreeArc xlink:type="arc" xlink:arcrole="t" xlink:from="top" xlink:to="n', k, '" order="', k % 7, '"/>').alias("piece"),
    )
    table = p.select(text("p/fws/f/tab/", name, "-rend.xml").alias("path"), text('<table:table xlink:type="resource" xlink:label="t" id="x_t', F.upper(name), '"/>').alias("piece")).distinct()
    member = lambda dim, m: f'<formula:explicitDimension dimension="d:{dim}"><formula:member><formula:qname>x:{m}</formula:qname></formula:member></formula:explicitDimension>'
    node = lambda label, inside="", more="": f'<table:ruleNode xlink:type="resource" xlink:label="{label}" id="{label}"{more}>{inside}</table:ruleNode>'
    link = lambda tag, a, b, more: f'<table:{tag} xlink:type="arc" xlink:arcrole="t" xlink:from="{a}" xlink:to="{b}" {more}/>'
    fixed = (
        link("tableBreakdownArc", "t", "by", 'axis="y" order="1"') + link("tableBreakdownArc", "t", "bx", 'axis="x" order="2"') + link("tableBreakdownArc", "t", "bw", 'axis="x" order="3"') + link("tableBreakdownArc", "t", "bz", 'axis="z" order="4"')
        + link("breakdownTreeArc", "by", "top", 'order="1"') + link("breakdownTreeArc", "bx", "rx", 'order="1"') + link("breakdownTreeArc", "bw", "rw", 'order="1"') + link("breakdownTreeArc", "bz", "az", 'order="1"')
        + node("top", member("BASE", "all"), ' abstract="true"') + node("rx", more=' abstract="true"') + node("rw", member("W", "w0")) + node("xa", member("FLAG", "A")) + node("xr", member("FLAG", "R")) + node("w1", member("W", "w1"))
        + link("definitionNodeSubtreeArc", "rx", "xr", 'order="2"') + link("definitionNodeSubtreeArc", "rx", "xa", 'order="1"') + link("definitionNodeSubtreeArc", "rw", "w1", 'order="1"') + link("definitionNodeSubtreeArc", "w1", "rw", 'order="1"')
        + '<table:aspectNode xlink:type="resource" xlink:label="az"><table:dimensionAspect>d:OPEN</table:dimensionAspect></table:aspectNode>'
    )
    rend = files(rows.unionByName(table), f'{_LINKBASE}<gen:link xlink:type="extended" xlink:role="r">', f"{fixed}</gen:link></link:linkbase>")
    label = p.select(
        text("p/fws/f/tab/", name, "-lab-codes.xml").alias("path"),
        text('<link:loc xlink:type="locator" xlink:href="r.xml#n', k, '" xlink:label="l', k, '"/><link:label xlink:type="resource" xlink:label="c', k, '">', F.lpad(k.cast("string"), 8, "0"), '</link:label><link:arc xlink:type="arc" xlink:arcrole="a" xlink:from="l', k, '" xlink:to="c', k, '"/>').alias("piece"),
    )
    return rend.unionByName(files(label, f'{_LINKBASE}<gen:link xlink:type="extended" xlink:role="r">', "</gen:link></link:linkbase>"))


def layout_positions(spark, d) -> DataFrame:
    links = settled(package.links_of(layout_files(spark, d)))
    codes = package.node_codes(links.where("path LIKE '%-lab-codes.xml'"), "code").select(F.upper(F.regexp_extract("path", "([^/]+)-lab-codes.xml$", 1)).alias("tbl"), "node", "code")
    return settled(layout.positions(links.where("path LIKE '%-rend.xml'"), codes))


_LAYOUT_SQL = """p AS (SELECT p_partkey AS k, 'B' || regexp_replace(p_brand, '[^0-9]', '', 'g') || '.' || p_size AS tbl FROM part),
y AS (SELECT tbl, 'y' AS axis, row_number() OVER (PARTITION BY tbl ORDER BY k % 7, 'n' || k) AS ord, lpad(k::VARCHAR, 8, '0') AS code, '{m}p' || k AS concept, '{d}BASE={x}' || CASE WHEN k % 2 = 0 THEN 'own' ELSE 'all' END AS dims, NULL AS open_dim FROM p WHERE k % 5 != 0),
x AS (SELECT tbl, 'x' AS axis, ord, NULL AS code, NULL AS concept, dims, NULL AS open_dim FROM (SELECT DISTINCT tbl FROM p), (VALUES (1, '{d}FLAG={x}A,{d}W={x}w0'), (2, '{d}FLAG={x}A,{d}W={x}w1'), (3, '{d}FLAG={x}R,{d}W={x}w0'), (4, '{d}FLAG={x}R,{d}W={x}w1')) v(ord, dims)),
z AS (SELECT DISTINCT tbl, 'z' AS axis, 1 AS ord, NULL AS code, NULL AS concept, '' AS dims, '{d}OPEN' AS open_dim FROM p)"""


@query(f"WITH {_LAYOUT_SQL} SELECT tbl, axis, ord::INT AS ord, code, concept, dims, open_dim FROM (SELECT * FROM y UNION ALL SELECT * FROM x UNION ALL SELECT * FROM z)")
def q_layout_positions(spark, d):
    """SRC12, SRC13: from layout files to positions in layout order: inherited aspects, own ones over them, abstract nodes, breakdowns of an axis multiplied, an open layer, a node that hangs on itself."""
    return layout_positions(spark, d).select("tbl", "axis", "ord", "code", "concept", K.dim_key(F.col("dims")).alias("dims"), "open_dim")


@query(f"WITH {_LAYOUT_SQL} SELECT y.tbl, y.code AS r, y.concept || '|' || y.dims || ',' || x.dims AS key, y.ord::INT AS o_y, x.ord::INT AS o_x FROM y JOIN x USING (tbl)")
def q_datapoints(spark, d):
    """JN15, SRC13, PRJ6: every combination of rows and columns of all layouts, aspects merged."""
    return layout.datapoints(layout_positions(spark, d)).select("tbl", "r", "key", "o_y", "o_x")


# Package files


@query("SELECT 'n' || p_partkey AS node, lpad(p_partkey::VARCHAR, 8, '0') AS code FROM part")
def q_node_codes(spark, d):
    """SRC12: the nodes of all layouts to their codes by locator, arc and label."""
    links = settled(package.links_of(layout_files(spark, d).where("path LIKE '%-lab-codes.xml'")))
    return package.node_codes(links, "code").select("node", "code")


@query("SELECT 'domain-member' AS kind, 's.xsd#b' || regexp_replace(p_brand, '[^0-9]', '', 'g') AS from_id, 's.xsd#p' || p_partkey AS to_id, CASE WHEN p_partkey % 2 = 0 THEN 'other' || p_size END AS target_role FROM part")
def q_hypercube_arcs(spark, d):
    """SRC23: dimensional arcs by full href, of a file for each brand."""
    p = star.table(spark, d, "part").select("p_partkey", "p_size", text("b", F.regexp_replace("p_brand", "[^0-9]", "")).alias("b"))
    k = text("p", F.col("p_partkey"))
    more = F.when(F.col("p_partkey") % 2 == 0, text(' xbrldt:targetRole="other', F.col("p_size"), '"')).otherwise("")
    pieces = p.select(text(F.col("b"), ".xml").alias("path"), text(locator(k), arc("domain-member", F.col("b"), k, more)).alias("piece")).unionByName(p.select(text(F.col("b"), ".xml").alias("path"), locator(F.col("b")).alias("piece")).distinct())
    made = files(pieces, f'{_LINKBASE}<link:definitionLink xlink:type="extended" xlink:role="r">', "</link:definitionLink></link:linkbase>")
    return package.hypercube_arcs(package.links_of(made)).select("kind", "from_id", "to_id", "target_role")


@query("SELECT 'T' || p_partkey AS code, 'fw' || p_size AS framework FROM part WHERE p_partkey % 3 != 0")
def q_list_tables(spark, d):
    """SRC11: layout files to table codes; other files are none."""
    k = F.col("p_partkey")
    paths = star.table(spark, d, "part").select(text("p/fws/fw", F.col("p_size"), "/tab/t", k, F.when(k % 3 == 0, "-lab.xml").otherwise("-rend.xml")).alias("path"))
    return package.table_codes(paths).select("code", "framework")


@query("SELECT 'm' || p_size AS module, 'T' || p_partkey AS tbl FROM part")
def q_module_index(spark, d):
    """SRC14: the tables that modules' schemas import, a schema for each size."""
    p = star.table(spark, d, "part").select(text("p/mod/m", F.col("p_size"), ".xsd").alias("path"), text('<xs:import schemaLocation="../../tab/t', F.col("p_partkey"), "/t", F.col("p_partkey"), '.xsd"/>').alias("piece"))
    return package.module_imports(files(p, "<s>", "</s>"))


@query("SELECT 'fw' || p_size AS framework, count(*) AS n FROM part GROUP BY 1")
def q_entry_points(spark, d):
    """SRC24: entry points of package manifests by framework, a manifest for each brand."""
    p = star.table(spark, d, "part").select(text(F.col("p_brand"), "/META-INF/taxonomyPackage.xml").alias("path"), text('<entryPointDocument href="http://a.b/fws/fw', F.col("p_size"), "/mod/m", F.col("p_partkey"), '.xsd"/>').alias("piece"))
    return package.entry_frameworks(files(p, "<p>", "</p>"))


def _zipped(batches):
    import io
    import zipfile

    import pyarrow as pa

    for b in batches:
        made = []
        for names in b.column("names").to_pylist():
            out = io.BytesIO()
            with zipfile.ZipFile(out, "w") as z:
                for n in names:
                    z.writestr(zipfile.ZipInfo(n), f"<t>{n}</t>")
            made.append(out.getvalue())
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(made, pa.binary())], names=["path", "content"])


@query("SELECT 'T' || p_partkey AS code, 'fw' || p_size AS framework, 1::BIGINT AS packages, '<t>fws/fw' || p_size || '/tab/t' || p_partkey || '-rend.xml</t>' AS content FROM part")
def q_package_ingest(spark, d):
    """CT1, SNK8: packages, one for each brand and each twice, by their digests: equal ones are one, and what the cache has is not unpacked again."""
    p = star.table(spark, d, "part").select("p_brand", text("fws/fw", F.col("p_size"), "/tab/t", F.col("p_partkey"), "-rend.xml").alias("name"))
    named = p.groupBy(F.col("p_brand").alias("path")).agg(F.array_sort(F.collect_list("name")).alias("names"))
    zips = settled(named.unionByName(named.withColumn("path", text("copy of ", F.col("path")))).mapInArrow(_zipped, "path string, content binary"))
    cache = f"{shared_dir(spark)}/packages-{uuid.uuid4().hex}"
    package.ingest_all(zips.where("length(path) % 2 = 0"), cache)
    found = package.ingest_all(zips, cache)
    n = found.groupBy("path").agg(F.count("*").alias("packages"), F.max(F.col("content").cast("string")).alias("content"))
    codes = package.table_codes(n.withColumn("path", text("p/", F.col("path"))))
    return codes.join(n.withColumn("path", text("p/", F.col("path"))), "path").select("code", "framework", "packages", "content")


def _sheet(rows: DataFrame, path: Column, row: Column, columns: list[Column], sheet: str) -> DataFrame:
    """(path, sheet, row, col, value) of a table's rows."""
    places = F.explode(F.array(*[F.struct(F.lit(i).alias("col"), c.cast("string").alias("value")) for i, c in enumerate(columns)]))
    return rows.select(path.alias("path"), F.lit(sheet).alias("sheet"), row.cast("int").alias("row"), places.alias("p")).select("path", "sheet", "row", "p.*")


@query("SELECT p_brand AS path, 'dpm_dictionary' AS kind, p_partkey::VARCHAR AS code, p_name AS label, 'MONETARY' AS datatype FROM part")
def q_workbook_dictionary(spark, d):
    """SRC4, SRC28: the metrics of dictionary workbooks, one for each brand: the first row of a code stays."""
    p = star.table(spark, d, "part").select("p_partkey", "p_brand", "p_name")
    path, k = F.col("p_brand"), F.col("p_partkey")
    books = p.select("p_brand").distinct()
    head = _sheet(books, path, F.lit(0), [F.lit("a title")], "Metrics").unionByName(_sheet(books, path, F.lit(1), [F.lit("Code"), F.lit("Label"), F.lit("Datatype")], "Metrics"))
    cells = head.unionByName(_sheet(p, path, k * 2 + 2, [k, F.col("p_name"), F.lit("MONETARY")], "Metrics")).unionByName(_sheet(p, path, k * 2 + 3, [k, F.lit("later"), F.lit("STRING")], "Metrics"))
    cells = cells.unionByName(_sheet(books, path, F.lit(0), [F.lit("Code")], "Dimensions")).unionByName(_sheet(books, path, F.lit(0), [F.lit("Code")], "Domains"))
    read = settled(workbook.cells(workbook.files_of(cells)))
    found = workbook.records(read.where("sheet = 'Metrics'"), {"code": "Code", "label": "Label", "datatype": "Datatype"}, ["Code", "Label"])
    first = package.dictionary(found.select(text(F.col("path"), "|", F.col("code")).alias("code"), "row", "path", F.col("code").alias("own"), "label", "datatype"), "metric")
    return first.drop("code").withColumnRenamed("own", "code").join(workbook.kinds(read), "path").select("path", "kind", "code", "label", "datatype")


@query("SELECT 'v' || p_partkey AS code, '{t: A01.00, r: ' || p_size || '} = 2 scope({t: A01.00})' AS expression, CASE WHEN p_partkey % 2 = 0 THEN 'A01.00,B02.00' ELSE 'A01.00' END AS tables, p_partkey % 3 = 0 AS deactivated FROM part")
def q_workbook_rules(spark, d):
    """SRC15, SRC16: rule rows of workbooks, one for each brand: the simplified expression first, the scope appended, tables of columns and text."""
    p = star.table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    path, k = F.col("p_brand"), F.col("p_partkey")
    names = ["ID", "T1", "T2", "Expression", "Simplified", "Scope", "Include", "Deactivated", "Severity"]
    cells = _sheet(p.select("p_brand").distinct(), path, F.lit(0), [F.lit(n) for n in names], "Rules")
    said = text("{t: A01.00, r: ", F.col("p_size"), "} = ")
    row = [text("v", k), F.when(k % 2 == 0, "B02.00").otherwise(""), F.lit(""), text(said, "1 + 1"), text(said, "2"), F.lit("scope({t: A01.00})"), F.lit("yes"), F.when(k % 3 == 0, "Y").otherwise("no"), F.lit("error")]
    read = settled(workbook.cells(workbook.files_of(cells.unionByName(_sheet(p, path, k + 1, row, "Rules")))))
    found = workbook.records(read, {"code": "ID", "T1": "T1", "T2": "T2", "expression": "Expression", "simplified": "Simplified", "scope": "Scope", "include": "Include", "deactivated": "Deactivated", "severity": "Severity"}, ["ID", "Expression"])
    r = package.workbook_rules(found)
    return r.select("code", "expression", F.array_join(F.array_sort("tables"), ",").alias("tables"), "deactivated")


# Schemas


def schema_files(spark, d) -> DataFrame:
    """(path, content): a schema of metrics for each brand (one in three of an enumeration), one of members for each region, and a definition linkbase of the members, all with relative or absolute hrefs."""
    p = star.table(spark, d, "part").select("p_partkey", "p_size", F.regexp_replace("p_brand", "[^0-9]", "").alias("b"))
    k = F.col("p_partkey")
    kind = F.element_at(F.lit(["xbrli:monetaryItemType", "enum:enumerationItemType", "num:percentItemType"]), (k % 3 + 1).cast("int"))
    extra = F.when(k % 3 == 1, text(' enum:domain="x:R', k % 5, '" enum:linkrole="geo" enum:headUsable="', F.when(k % 2 == 0, "true").otherwise("false"), '"')).otherwise("")
    metric = text('<xs:element name="m', k, '" id="id_m', k, '" type="', kind, '" substitutionGroup="xbrli:item" xbrli:periodType="', F.when(k % 4 == 0, "duration").otherwise("instant"), '"', F.when(k % 7 == 0, ' abstract="true"').otherwise(""), extra, "/>")
    head = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:xbrli="http://www.xbrl.org/2003/instance" xmlns:enum="http://xbrl.org/2014/extensible-enumerations" xmlns:m="urn:m" xmlns:x="urn:x" targetNamespace="urn:'
    metrics = files(p.select(text("a.b/met/b", F.col("b"), ".xsd").alias("path"), metric.alias("piece")), head + 'm">', "</xs:schema>")
    n, r = star.table(spark, d, "nation"), star.table(spark, d, "region")
    element = lambda name: text('<xs:element name="', name, '" id="id_', name, '" substitutionGroup="xbrli:item" type="nonnum:domainItemType"/>')
    region, nation = text("R", F.col("n_regionkey")), text("N", F.col("n_nationkey"))
    members = n.select(text("a.b/dom/r", F.col("n_regionkey"), "/mem.xsd").alias("path"), element(nation).alias("piece")).unionByName(r.select(text("a.b/dom/r", F.col("r_regionkey"), "/mem.xsd").alias("path"), element(text("R", F.col("r_regionkey"))).alias("piece")))
    far = F.when(F.col("n_nationkey") % 2 == 0, text("http://a.b/dom/r", F.col("n_regionkey"), "/mem.xsd#id_")).otherwise(text("./../r", F.col("n_regionkey"), "/mem.xsd#id_"))
    loc = lambda label, href: text('<link:loc xlink:type="locator" xlink:href="', href, '" xlink:label="l_', label, '"/>')
    path = text("a.b/dom/r", F.col("n_regionkey"), "/def.xml")
    pieces = n.select(path.alias("path"), text(loc(nation, text(far, nation)), arc("domain-member", region, nation, F.when(F.col("n_nationkey") % 4 == 0, ' usable="false"').otherwise(""))).alias("piece"))
    pieces = pieces.unionByName(n.select(path.alias("path"), loc(region, text("mem.xsd#id_", region)).alias("piece")).distinct())
    links = files(pieces, f'{_LINKBASE}<link:definitionLink xlink:type="extended" xlink:role="geo">', "</link:definitionLink></link:linkbase>")
    return metrics.unionByName(files(members, head + 'x">', "</xs:schema>")).unionByName(links)


@query("""SELECT 'm:m' || p_partkey AS qname, (['MONETARY', 'ENUMERATION', 'PERCENTAGE'])[p_partkey % 3 + 1] AS datatype, CASE WHEN p_partkey % 4 = 0 THEN 'duration' ELSE 'instant' END AS period_type,
 CASE WHEN p_partkey % 3 = 1 THEN (SELECT count(*) FROM nation WHERE n_regionkey = p_partkey % 5 AND n_nationkey % 4 != 0) + (p_partkey % 2 = 0)::INT ELSE 0 END::BIGINT AS allowed FROM part WHERE p_partkey % 7 != 0""")
def q_schema_files(spark, d):
    """SRC5-SRC8, SRC12, PRJ19: from schemas and linkbases alone to the dictionary's metrics, their datatypes and the values that their enumerations allow: hrefs resolved, unusable members passed over."""
    made = settled(schema_files(spark, d))
    declared = settled(package.declarations(made.where("path LIKE '%.xsd'")))
    arcs = package.arcs_by_name(package.definition_arcs(package.links_of(made.where("path LIKE '%.xml'"))), package.href_index(declared), "qname")
    metrics = formula.concepts(declared.where("prefix = 'm'"))
    allowed = package.enumeration_members(declared, arcs).groupBy(F.col("metric").alias("qname")).agg(F.count("*").alias("allowed"))
    return metrics.join(allowed, "qname", "left").select("qname", "datatype", "period_type", F.coalesce("allowed", F.lit(0).cast("long")).alias("allowed"))


# Instances in splits


@query(ORACLE["q_instances"])
def q_large_instances(spark, d):
    """SRC1, JN1: what q_instances reads, by splits of files: contexts and facts as two streams of rows, joined."""
    facts = instance_xml.read_large_instances(spark, written_instances(spark, d), "*.txt")
    up = facts.withColumn("module", F.regexp_extract("file", r"file=([^/]+)", 1))
    return up.groupBy("module").agg(F.count("value_num").alias("facts"), F.count_distinct("ctx_id").alias("contexts"), F.sum(F.col("value_raw").cast("decimal(28,2)")).cast("double").alias("total"), F.max(F.size("dims") + F.size("typed")).alias("most_dims"), F.count_distinct(F.element_at("typed", "{http://d}YR")).alias("years"))


# Rules of modules


def module_files(spark, d) -> DataFrame:
    """(path, content): a module schema for each brand, an assertion set for each of its sizes, a rule file for each part, and beside it an error file or a label file."""
    p = star.table(spark, d, "part").select("p_partkey", "p_size", F.regexp_replace("p_brand", "[^0-9]", "").alias("b"))
    k, b, n = F.col("p_partkey"), F.col("b"), F.col("p_size")
    loc = lambda href, label: text('<link:loc xlink:type="locator" xlink:href="', href, '" xlink:label="', label, '"/>')
    extended = f'{_LINKBASE}<gen:link xlink:type="extended" xlink:role="r">'
    modules = files(p.select(text("p/mod/m", b, ".xsd").alias("path"), text('<link:linkbaseRef xlink:href="../val/aset-', b, "-", n, '.xml"/>').alias("piece")).distinct(), "<xs>", "</xs>")
    aset = text("p/val/aset-", b, "-", n, ".xml").alias("path")
    pieces = p.select(aset, text(loc(text("vr-v", k, ".xml#v", k), text("v", k)), loc(text("../tab/t/t", n, "-rend.xml"), "t"), F.when(n % 2 == 0, loc(text("../tab/u/u", b, "-rend.xml"), "u")).otherwise("")).alias("piece"))
    sets = files(pieces, extended, "</gen:link></link:linkbase>")
    severity = text('<gen:arc xlink:type="arc" xlink:arcrole="http://x/assertion-unsatisfied-severity" xlink:from="a" xlink:to="s"/>', loc(text("sev.xml#", F.when(k % 3 == 0, "WARNING").otherwise("ERROR")), "s"))
    rules = files(p.select(text("p/val/vr-v", k, ".xml").alias("path"), text('<va:valueAssertion xlink:type="resource" xlink:label="a" id="v', k, '" test="$a = ', n, '"/>', severity).alias("piece")), extended.replace("<link:linkbase ", '<link:linkbase xmlns:va="urn:va" '), "</gen:link></link:linkbase>")
    message = lambda role, said: text(f'<gen:message xlink:type="resource" xlink:label="m{role}" xlink:role="http://x/{role}">', said, "</gen:message>")
    beside = p.select(F.explode(F.when(k % 2 == 0, F.array(F.lit("err"), F.lit("lab"))).otherwise(F.array(F.lit("lab")))).alias("f"), k)
    told = files(beside.select(text("p/val/vr-v", k, "-", F.col("f"), "-en.xml").alias("path"), text(message("terseMessage", text("a short ", k)), message("message", text(F.col("f"), " {{$a}} of ", k))).alias("piece")), extended, "</gen:link></link:linkbase>")
    return modules.unionByName(sets).unionByName(rules).unionByName(told)


@query("""SELECT 'm' || regexp_replace(p_brand, '[^0-9]', '', 'g') AS module, 'v' || p_partkey AS code, CASE WHEN p_partkey % 3 = 0 THEN 'warning' ELSE 'error' END AS severity, '$a = ' || p_size AS test,
 'T' || p_size || CASE WHEN p_size % 2 = 0 THEN ',U' || regexp_replace(p_brand, '[^0-9]', '', 'g') ELSE '' END AS tables, CASE WHEN p_partkey % 2 = 0 THEN 'err' ELSE 'lab' END || ' {$a} of ' || p_partkey AS message FROM part""")
def q_module_rule_files(spark, d):
    """SRC19-SRC21: from the files of modules, assertion sets, rules and messages to each module's rules with their tables, severities and messages."""
    made = settled(module_files(spark, d))
    rules = package.rules_of_modules(made.where("path LIKE '%.xsd'"), settled(package.links_of(dealt(made.where("path LIKE '%.xml'"), "path", each=TEXTS_A_TASK))))
    return rules.select("module", "code", "severity", "test", F.array_join("tables", ",").alias("tables"), "message")
