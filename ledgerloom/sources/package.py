"""Dictionaries, layouts, rules and hierarchies as tables (SRC4-SRC6, SRC9-SRC24, SRC28, CT1, SNK8).

Linkbases are read as arcs: one row for each locator, resource and arc of a file; every operator after that is a join.
"""

from __future__ import annotations

import hashlib
import io
import os
import sys
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import table_refs
from ..session import settled

# functions go to the workers by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_L = "{http://www.w3.org/1999/xlink}"
LINKS = "path string, role string, kind string, tag string, id string, label string, source string, target string, arcrole string, ord double, href string, text string, attributes map<string,string>, parts array<struct<tag:string,text:string>>"

_LINK_KINDS = [*[pa.string()] * 9, pa.float64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.struct([("tag", pa.string()), ("text", pa.string())]))]
LINK_COLUMNS = ["path", "role", "kind", "tag", "id", "label", "source", "target", "arcrole", "ord", "href", "text", "attributes", "parts"]


#: Rows of linkbases that a task holds before it hands them on.
MOST_ROWS = 2_000


def _rows(path: str, content: bytes) -> Iterator[tuple]:
    """The rows of a file, one at a time: what stands below an extended link goes when its row is made, so that a file of any size takes what its text takes."""
    spaces, above, outer = {}, [], []

    def full(y) -> str:
        """An element's text; a name (an element `qname` or `dimensionAspect`) with its namespace in place of its prefix."""
        text = (y.text or "").strip()
        return named(text) if y.tag.endswith(("}qname", "}dimensionAspect")) else text

    def named(text: str) -> str:
        prefix, colon, local = text.rpartition(":")
        return f"{{{spaces[prefix]}}}{local}" if prefix in spaces else text

    for event, x in ElementTree.iterparse(io.BytesIO(content), ("start-ns", "start", "end")):
        if event == "start-ns":
            spaces[x[0]] = x[1]
            continue
        if event == "start":
            above.append(x)
            if x.get(f"{_L}type") == "extended":
                outer.append(x)
            continue
        above.pop()
        if outer and outer[-1] is x:
            outer.pop()
        link = above[-1] if above else None
        if link is not None and link.get(f"{_L}type") == "extended":
            plain = {k.rpartition("}")[2]: v for k, v in x.attrib.items() if not k.startswith(_L)}
            if x.get(f"{_L}role"):
                plain["xlink:role"] = x.get(f"{_L}role")
            text, parts, order = (x.text or "").strip(), [], plain.get("order")
            if len(x):
                text = "".join(x.itertext()).strip()
                over = {c: e for e in x.iter() for c in e}
                parts = [{"tag": y.tag.rpartition("}")[2], "text": f"{over[y].tag.rpartition('}')[2]}:{full(y)}"} for y in x.iter() if y is not x and len(y) == 0]
                # a member that an attribute gives its dimension: the aspect of a layout's node
                parts += [{"tag": y.tag.rpartition("}")[2], "text": f"aspect:{named(y.get('dimension'))}={full(q)}"} for y in x.iter() if y.get("dimension") for q in y.iter() if len(q) == 0 and q is not y]
            yield (path, link.get(f"{_L}role"), x.get(f"{_L}type") or "other", x.tag.rpartition("}")[2], x.get("id"), x.get(f"{_L}label"), x.get(f"{_L}from"), x.get(f"{_L}to"), x.get(f"{_L}arcrole"), float(order) if order else None,
                   x.get(f"{_L}href"), text, list(plain.items()), parts)
        # an element within an outer link's child is still to be read with that child
        if link is not None and (not outer or outer[0] is link):
            link.remove(x)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), _LINK_KINDS, strict=True)], names=LINK_COLUMNS)

    rows = []
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            for row in _rows(path.as_py(), content.as_py()):
                rows.append(row)
                if len(rows) >= MOST_ROWS:
                    yield batch_of(rows)
                    rows = []
    if rows:
        yield batch_of(rows)


def linkbases(spark: SparkSession, path: str, pattern: str = "*.xml") -> DataFrame:
    """SRC12, SRC13, SRC18, SRC19, SRC23: all locators, resources and arcs of the linkbase files below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return links_of(files)


def links_of(files: DataFrame) -> DataFrame:
    """The same of files (path, content)."""
    return files.select("path", "content").mapInArrow(_links, LINKS)


def node_codes(links: DataFrame, role: str) -> DataFrame:
    """SRC12: node id to its code: locator (by label) - arc - label resource of the role."""
    loc = links.where("kind = 'locator'").select("path", F.col("label").alias("source"), F.substring_index("href", "#", -1).alias("node"))
    arc = links.where("kind = 'arc'").select("path", "source", "target")
    res = links.where("kind = 'resource'").where(F.element_at("attributes", "role") == role if role == "plain" else F.lit(True)).select("path", F.col("label").alias("target"), F.col("text").alias("code"))
    return loc.join(arc, ["path", "source"]).join(res, ["path", "target"]).select("path", "node", "code")


def definition_arcs(links: DataFrame) -> DataFrame:
    """SRC9, SRC23: (path, role, kind, from_id, to_id, target_role, usable) of the dimensional arcs, by full href, dimension defaults included."""
    loc = links.where("kind = 'locator'").select("path", "role", "label", F.col("href").alias("h"))
    said = lambda k: F.try_element_at("attributes", F.lit(k))
    arc = links.where("kind = 'arc'").select("path", "role", "source", "target", F.substring_index("arcrole", "/", -1).alias("kind"), said("targetRole").alias("target_role"), (F.coalesce(said("usable"), F.lit("true")) != "false").alias("usable"))
    arc = arc.where(F.col("kind").isin("all", "hypercube-dimension", "dimension-domain", "domain-member", "dimension-default"))
    a = arc.join(loc.withColumnsRenamed({"label": "source", "h": "from_id"}), ["path", "role", "source"]).join(loc.withColumnsRenamed({"label": "target", "h": "to_id"}), ["path", "role", "target"])
    return a.select("path", "role", "kind", "from_id", "to_id", "target_role", "usable")


def hypercube_arcs(links: DataFrame) -> DataFrame:
    """SRC23: (role, kind, from_id, to_id, target_role) of the arcs that make hypercubes."""
    return definition_arcs(links).where("kind != 'dimension-default'").select("role", "kind", "from_id", "to_id", "target_role")


_SCHEMA_ROWS = (
    "path string, namespace string, prefix string, id string, name string, type string, substitutionGroup string, periodType string, balance string, abstract boolean, "
    "domain string, linkrole string, head_usable boolean, typed_domain string"
)


def _declarations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SCHEMA_ROWS.split(", ")]
    kinds = [pa.bool_() if x.endswith("boolean") else pa.string() for x in _SCHEMA_ROWS.split(", ")]
    xs, xbrli, enum, dt = "{http://www.w3.org/2001/XMLSchema}", "{http://www.xbrl.org/2003/instance}", "{http://xbrl.org/2014/extensible-enumerations}", "{http://xbrl.org/2005/xbrldt}"
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows, spaces, target = [], {}, None
            for event, x in ElementTree.iterparse(io.BytesIO(content.as_py()), ("start-ns", "start", "end")):
                if event == "start-ns":
                    spaces.setdefault(x[1], x[0])
                elif event == "start":
                    target = target or (x.get("targetNamespace") if x.tag == f"{xs}schema" else None)
                elif x.tag == f"{xs}element" and x.get("name"):
                    usable = x.get(f"{enum}headUsable")
                    rows.append((path, target, spaces.get(target), x.get("id"), x.get("name"), x.get("type"), x.get("substitutionGroup"), x.get(f"{xbrli}periodType"), x.get(f"{xbrli}balance"), x.get("abstract") == "true",
                                 x.get(f"{enum}domain"), x.get(f"{enum}linkrole"), None if usable is None else usable == "true", x.get(f"{dt}typedDomainRef")))
                    x.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)


def declarations(files: DataFrame) -> DataFrame:
    """SRC5: the elements that schemas (path, content) declare, streamed by tasks: what `formula.concepts` wants, their namespace, and what extensible enumerations and typed dimensions say."""
    return files.select("path", "content").mapInArrow(_declarations, _SCHEMA_ROWS)


def resolved(href: Column, path: Column) -> Column:
    """SRC12, PRJ19: an href of the file at path as `path#id` from the root of the package: addresses without their scheme, others from the file's folder, `..` and `.` followed."""
    folder = F.regexp_replace(path, "[^/]*$", "")
    whole = F.when(href.rlike("^https?://"), F.regexp_replace(href, "^https?://", "")).when(href.startswith("#"), F.concat(path, href)).otherwise(F.concat(folder, href))
    file, fragment = F.substring_index(whole, "#", 1), F.when(whole.contains("#"), F.concat(F.lit("#"), F.substring_index(whole, "#", -1))).otherwise("")
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    parts = F.aggregate(F.split(file, "/"), F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", up(acc)).when((x == ".") | (x == ""), acc).otherwise(F.concat(acc, F.array(x))))
    return F.concat(F.array_join(parts, "/"), fragment)


def href_index(declared: DataFrame) -> DataFrame:
    """SRC5: (id, name, qname): declarations by `path#id`: Clark and prefixed names."""
    at = declared.where("id IS NOT NULL").select(resolved(F.concat(F.lit("#"), F.col("id")), F.col("path")).alias("id"), F.concat(F.lit("{"), "namespace", F.lit("}"), "name").alias("name"), F.concat_ws(":", "prefix", "name").alias("qname"))
    return at.dropDuplicates(["id"])


def arcs_by_name(arcs: DataFrame, index: DataFrame, column: str = "name") -> DataFrame:
    """definition_arcs whose ends have their names in place of hrefs; an end that no schema declares keeps its resolved href."""
    for end in ("from_id", "to_id"):
        known = index.select(F.col("id").alias("_h"), F.col(column).alias("_n"))
        arcs = arcs.withColumn("_h", resolved(F.col(end), F.col("path"))).join(known, "_h", "left").withColumn(end, F.coalesce("_n", "_h")).drop("_h", "_n")
    return arcs


def enumeration_members(declared: DataFrame, arcs: DataFrame) -> DataFrame:
    """SRC7, SRC8: (metric, member) by prefixed names: the usable members below the head that a metric's declaration names (domain, linkrole), the head too where it may be used. arcs: named definition arcs."""
    from ..operators.cube import role_members

    spec = settled(declared.where("domain IS NOT NULL").select(F.concat_ws(":", "prefix", "name").alias("metric"), "domain", "linkrole", F.coalesce("head_usable", F.lit(False)).alias("head_usable")))
    edges = arcs.where("kind = 'domain-member'").withColumn("tbl", F.lit(""))
    starts = spec.select(F.lit("").alias("tbl"), F.col("linkrole").alias("role"), F.col("domain").alias("id")).distinct()
    usable = edges.groupBy(F.col("to_id").alias("member")).agg(F.bool_or("usable").alias("u"))
    below = role_members(edges, starts).join(usable, "member").where("u").select(F.col("role").alias("linkrole"), F.col("id").alias("domain"), "member")
    return spec.join(below, ["linkrole", "domain"]).select("metric", "member").unionByName(spec.where("head_usable").select("metric", F.col("domain").alias("member"))).distinct()


def dimension_defaults(arcs: DataFrame) -> DataFrame:
    """SRC9: (dim, member) by href from definition_arcs. Of several, that of the greatest path stays: the last host wins."""
    found = arcs.where("kind = 'dimension-default'")
    return found.groupBy(F.col("from_id").alias("dim")).agg(F.max_by("to_id", F.struct("path", "role", "to_id")).alias("member"))


def _scan(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, content) of the files below path whose names fit."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def table_codes(files: DataFrame, suffix: str = "-rend.xml") -> DataFrame:
    """SRC11: (code, framework, path) of layout files (path)."""
    code = F.upper(F.regexp_extract("path", rf"([^/]+){suffix}$".replace(".", r"\."), 1))
    return files.select(code.alias("code"), F.regexp_extract("path", r"/fws/([^/]+)/", 1).alias("framework"), "path").where("code != ''")


def list_tables(spark: SparkSession, path: str, suffix: str = "-rend.xml") -> DataFrame:
    """SRC11: the same of all layout files below path, sorted. Only their names are read."""
    return table_codes(_scan(spark, path, f"*{suffix}").select("path"), suffix).orderBy("code", "path")


def module_imports(files: DataFrame) -> DataFrame:
    """SRC14: (module, tbl): tables that module schemas (path, content) import."""
    imports = F.regexp_extract_all(F.col("content").cast("string"), F.lit(r'schemaLocation="[^"]*/tab/([^/"]+)/'), F.lit(1))
    return files.select(F.regexp_extract("path", r"([^/]+)\.xsd$", 1).alias("module"), F.explode(F.array_distinct(imports)).alias("t")).select("module", F.upper("t").alias("tbl"))


def module_index(spark: SparkSession, path: str, pattern: str = "*.xsd") -> DataFrame:
    """SRC14: the same of all schemas below path."""
    return module_imports(_scan(spark, path, pattern))


def entry_frameworks(files: DataFrame) -> DataFrame:
    """SRC24: (framework, n) from the hrefs of package manifests (path, content)."""
    hrefs = F.explode(F.regexp_extract_all(F.col("content").cast("string"), F.lit(r'href="([^"]+)"'), F.lit(1)))
    return files.select(hrefs.alias("href")).groupBy(F.regexp_extract("href", r"/fws/([^/]+)/", 1).alias("framework")).agg(F.count("*").alias("n"))


def entry_points(spark: SparkSession, path: str) -> DataFrame:
    """SRC24: the same of all manifests below path."""
    return entry_frameworks(_scan(spark, path, "*taxonomyPackage.xml"))


def datatype_of(item_type: Column) -> Column:
    """SRC6: datatype of an item type's name, in this order of precedence."""
    t = F.lower(item_type)
    first = [("monetary", "MONETARY"), ("percent", "PERCENTAGE"), ("boolean", "BOOLEAN"), ("date", "DATE"), ("integer", "INTEGER"), ("qname", "ENUMERATION"), ("enumeration", "ENUMERATION"), ("decimal", "DECIMAL"), ("pure", "DECIMAL"), ("double", "DECIMAL"), ("float", "DECIMAL")]
    out = None
    for word, kind in first:
        out = F.when(t.contains(word), kind) if out is None else out.when(t.contains(word), kind)
    return out.otherwise("STRING")


def needs_refine(item_type: Column) -> Column:
    """SRC6: types that do not tell decimals from percentages."""
    return datatype_of(item_type) == "DECIMAL"


def dictionary(rows: DataFrame, kind: str) -> DataFrame:
    """SRC4: of equal codes the first row by `row` stays for metrics and members, the last for dimensions and domains."""
    pick = F.min_by if kind in ("metric", "member") else F.max_by
    rest = [c for c in rows.columns if c not in ("code", "row")]
    return rows.groupBy("code").agg(pick(F.struct(*rest), "row").alias("r")).select("code", "r.*")


def two_hosts(first: DataFrame, second: DataFrame, key: str, last_wins: bool) -> DataFrame:
    """SRC9: definitions from two hosts: the last host's (defaults) or the first host's (members) stays."""
    both = first.withColumn("_h", F.lit(0)).unionByName(second.withColumn("_h", F.lit(1)))
    rest = [c for c in first.columns if c != key]
    pick = F.max_by if last_wins else F.min_by
    return both.groupBy(key).agg(pick(F.struct(*rest), "_h").alias("r")).select(key, "r.*")


def workbook_rules(rows: DataFrame) -> DataFrame:
    """SRC15, SRC16: rule rows with columns T1..T5, expression, simplified, scope and yes/no flags as rules: the simplified
    expression preferred, the scope appended, tables from the columns and from the expression."""
    names = [c for c in (f"T{i}" for i in range(1, 6)) if c in rows.columns]
    flag = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))).isin("yes", "y", "true", "1")
    text = F.concat_ws(" ", F.coalesce(F.nullif(F.trim("simplified"), F.lit("")), "expression"), F.nullif(F.trim("scope"), F.lit("")))
    tables = F.array_distinct(F.concat(F.array_compact(F.array(*[F.nullif(F.trim(c), F.lit("")) for c in names])), table_refs(text)))
    return rows.select("code", text.alias("expression"), "scope", "severity", tables.alias("tables"), flag("include").alias("include"), flag("deactivated").alias("deactivated"))


def module_rules(assertions: DataFrame, messages: DataFrame) -> DataFrame:
    """SRC20, SRC21: rules of a module (code, tbl) with united tables and the message: an error file's before a label file's, verbose roles first."""
    best = messages.groupBy("code").agg(F.min_by("message", F.struct(F.when(F.col("origin") == "error", 0).otherwise(1), F.when(F.col("role").contains("verbose"), 0).otherwise(1), "message")).alias("message"))
    return assertions.groupBy("code").agg(F.array_sort(F.collect_set("tbl")).alias("tables")).join(best, "code", "left")


def assertion_sets(links: DataFrame) -> DataFrame:
    """SRC20: (path, tbl, rules): the tables whose layouts an assertion set's locators name, each with each rule file that they name (resolved)."""
    at = links.where("kind = 'locator'").select("path", resolved(F.col("href"), F.col("path")).alias("h")).withColumn("h", F.substring_index("h", "#", 1))
    tables = at.where("h LIKE '%-rend.xml'").select("path", F.upper(F.regexp_extract("h", "([^/]+)-rend.xml$", 1)).alias("tbl")).distinct()
    rules = at.where(F.col("h").rlike(r"/vr-[^/]+\.xml$") | F.col("h").rlike(r"^vr-[^/]+\.xml$")).select("path", F.col("h").alias("rules")).distinct()
    return tables.join(rules, "path")


def module_sets(files: DataFrame) -> DataFrame:
    """SRC20: (module, path): the assertion sets that module schemas (path, content) refer to."""
    refs = F.regexp_extract_all(F.col("content").cast("string"), F.lit(r'href="([^"]*aset[^"]*[.]xml)"'), F.lit(1))
    found = files.select(F.regexp_extract("path", r"([^/]+)\.xsd$", 1).alias("module"), "path", F.explode(F.array_distinct(refs)).alias("h"))
    return found.select("module", resolved(F.col("h"), F.col("path")).alias("path"))


def messages(links: DataFrame) -> DataFrame:
    """SRC21: (rules, message, origin, role): the messages of rule files from the error and label files that lie beside them; doubled braces are single ones."""
    said = links.where("kind = 'resource' AND tag = 'message' AND text != ''")
    file = r"^(.*)-(err|lab)-[a-z]+[.]xml$"
    text = F.replace(F.replace("text", F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    origin = F.when(F.regexp_extract("path", file, 2) == "err", "error").otherwise("label")
    role = F.coalesce(F.try_element_at("attributes", F.lit("xlink:role")), F.lit(""))
    # the plain message comes before a terse one
    return said.where(F.col("path").rlike(file)).select(F.concat(F.regexp_extract("path", file, 1), F.lit(".xml")).alias("rules"), text.alias("message"), origin.alias("origin"), F.when(role.endswith("/message"), "verbose").otherwise("terse").alias("role"))


def rules_of_modules(schemas: DataFrame, links: DataFrame) -> DataFrame:
    """SRC19-SRC21: (module, code, severity, test, tables, message) of the rules that modules enforce, from the files alone: module schemas (path, content) to assertion sets, those to rule files and tables; a rule's tables
    are those of all of its sets, its message an error file's before a label file's."""
    from .formula import lean_rules

    sets = module_sets(schemas).join(assertion_sets(links), "path").select("module", "tbl", "rules").distinct()
    rules = lean_rules(links).select(resolved(F.concat(F.lit("#"), F.lit("x")), F.col("path")).alias("rules"), F.col("rule").alias("code"), "severity", "test").withColumn("rules", F.substring_index("rules", "#", 1))
    best = messages(links).groupBy("rules").agg(F.min_by("message", F.struct(F.when(F.col("origin") == "error", 0).otherwise(1), F.when(F.col("role") == "verbose", 0).otherwise(1), "message")).alias("message"))
    of = sets.join(rules, "rules").join(best, "rules", "left")
    return of.groupBy("module", "code").agg(F.min("severity").alias("severity"), F.min("test").alias("test"), F.array_sort(F.collect_set("tbl")).alias("tables"), F.min("message").alias("message"))


def hierarchy_arcs(links: DataFrame) -> DataFrame:
    """SRC22: (domain, parent, child, weight, kind) of member hierarchies: calculation arcs of breakdowns that are complete, partial or a superset. A member goes by what follows the last `_` of its id, a domain by the file's folder."""
    loc = links.where("kind = 'locator'").select("path", "role", "label", F.substring_index(F.substring_index("href", "#", -1), "_", -1).alias("m"))
    kind = F.regexp_extract("arcrole", "/(complete|partial|superset)-breakdown$", 1)
    arc = links.where("kind = 'arc'").select("path", "role", "source", "target", kind.alias("kind"), F.coalesce(F.try_element_at("attributes", F.lit("weight")).try_cast("double"), F.lit(1.0)).alias("weight")).where("kind != ''")
    a = arc.join(loc.withColumnsRenamed({"label": "source", "m": "parent"}), ["path", "role", "source"]).join(loc.withColumnsRenamed({"label": "target", "m": "child"}), ["path", "role", "target"])
    domain = F.element_at(F.split("path", "/"), -2)
    return a.withColumn("domain", domain).select("domain", "parent", "child", "weight", "kind").distinct()


def sheet_datapoints(cells: DataFrame) -> DataFrame:
    """SRC17: datapoints of annotated sheets from raw cells (sheet, row, col, value): the header row has "Metrics", a data row's code stands in the first
    of the first ten columns that has two or more four-digit codes."""
    header = cells.where(F.trim("value") == "Metrics").groupBy("sheet").agg(F.min("row").alias("h"), F.min("col").alias("metric_col"))
    coded = cells.where(F.col("value").rlike("^[0-9]{4}$") & (F.col("col") < 10)).groupBy("sheet", "col").agg(F.count("*").alias("n")).where("n >= 2").groupBy("sheet").agg(F.min("col").alias("code_col"))
    at = cells.join(header, "sheet").join(coded, "sheet").where("row > h")
    code = at.where("col = code_col").where(F.col("value").rlike("^[0-9]{4}$")).select("sheet", "row", F.col("value").alias("code"))
    metric = at.where("col = metric_col").where("value IS NOT NULL").select("sheet", "row", F.col("value").alias("metric"))
    return code.join(metric, ["sheet", "row"])


def kind_of_workbook(sheets: list[str]) -> str:
    """SRC28: by its sheets."""
    names = {s.strip().lower() for s in sheets}
    if {"metrics", "dimensions", "domains"} <= names:
        return "dpm_dictionary"
    return "annotated_templates" if any(s[:1].isalpha() and any(c.isdigit() for c in s) and "." in s for s in names) else "unknown"


def _unzipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for digest, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                for name in z.namelist():
                    if not name.endswith("/"):
                        yield pa.RecordBatch.from_arrays([pa.array([digest]), pa.array([name]), pa.array([z.read(name)], pa.binary())], names=["package", "path", "content"])


def ingest_all(packages: DataFrame, cache: str) -> DataFrame:
    """CT1, SNK8: the files (package, path, content) of packages (path, content): package is the SHA-256 of the zip. cache is a table of a folder for each digest, in any store; only packages that it lacks are unpacked, a worker one
    at a time, and added. Equal packages are one."""
    spark = packages.sparkSession
    told = settled(packages.select(F.sha2("content", 256).alias("package"), F.col("path").alias("_at")).groupBy("package").agg(F.min("_at").alias("_at")))
    try:
        known = spark.read.schema(_FILES).parquet(cache).select("package").distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    new = told if known is None else settled(told.join(known, "package", "left_anti"))
    if not new.isEmpty():
        zips = packages.withColumn("_at", F.col("path")).join(new, "_at").select("package", "content")
        zips.mapInArrow(_unzipped, _FILES).write.mode("append").partitionBy("package").parquet(cache)
    elif known is None:
        return spark.createDataFrame([], _FILES)
    return spark.read.schema(_FILES).parquet(cache).join(told.select("package"), "package", "left_semi")


_FILES = "package string, path string, content binary"


def ingest(spark: SparkSession, package: str, cache: str) -> tuple[str, DataFrame]:
    """CT1: the digest of one package in any store, and its files (path, content)."""
    zipped = spark.read.format("binaryFile").load(package).select("path", "content")
    files = ingest_all(zipped, cache)
    return zipped.select(F.sha2("content", 256)).first()[0], files.select("path", "content")


def extract(package: str, cache: str) -> str:
    """The same into a local folder, for tools that want one: named by the package's digest, extracted only if new, and nothing outside of it."""
    digest = hashlib.sha256()
    with open(package, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    to = os.path.join(cache, digest.hexdigest())
    if not os.path.isdir(to):
        part = f"{to}.part"
        with zipfile.ZipFile(package) as z:
            for name in z.namelist():
                if not os.path.realpath(os.path.join(part, name)).startswith(os.path.realpath(part) + os.sep):
                    raise ValueError(f"{name!r} leaves the package's folder")
            z.extractall(part)
        os.rename(part, to)
    return to


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """SNK8: a table kept as Parquet under a path that its inputs name; made once."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
