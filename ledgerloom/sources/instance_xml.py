"""XML instances as a Python data source, and their writer (SRC1-SRC3, JN1, SNK1-SNK3, SNK5, CT7).

Files are read by Spark's own binary scan, so they may lie in any store that it reads, and written by its tasks.
"""

from __future__ import annotations

import io
import sys
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import dim_key, template_of
from ..operators.catalog import module_groups
from ..session import bounded, settled

# functions go to the workers by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "file string, fact_id long, concept string, ctx_id string, dims map<string,string>, typed map<string,string>, period string, unit string, decimals int, value_raw string"
_X, _D, _F = "{http://www.xbrl.org/2003/instance}", "{http://xbrl.org/2006/xbrldi}", "{http://www.eurofiling.info/xbrl/ext/filing-indicators}"


def _qname(text: str, spaces: dict[str, str]) -> str:
    prefix, colon, local = (text or "").strip().rpartition(":")
    return f"{{{spaces[prefix]}}}{local}" if prefix in spaces else (text or "").strip()


def read_file(content: bytes) -> Iterator[tuple]:
    """Facts of one instance. It is streamed: elements are dropped when read. Contexts may come after facts, so facts wait for theirs as small tuples."""
    spaces: dict[str, str] = {}
    contexts: dict[str, tuple[dict, dict, str]] = {}
    facts, depth = [], 0
    for event, x in ElementTree.iterparse(io.BytesIO(content), ("start", "end", "start-ns")):
        if event == "start-ns":
            spaces[x[0]] = x[1]
            continue
        if event == "start":
            depth += 1
            continue
        depth -= 1
        if depth != 1:
            continue
        if x.tag == f"{_X}context":
            dims = {_qname(m.get("dimension"), spaces): _qname(m.text, spaces) for m in x.iter(f"{_D}explicitMember")}
            typed = {_qname(m.get("dimension"), spaces): (m[0].text or "").strip() if len(m) else "" for m in x.iter(f"{_D}typedMember")}
            period = next((p.text for t in ("instant", "endDate") for p in x.iter(f"{_X}{t}")), None)
            contexts[x.get("id")] = (dims, typed, period)
        elif x.get("contextRef") is not None and not x.tag.startswith(_F):
            d = x.get("decimals")
            nil = x.get("{http://www.w3.org/2001/XMLSchema-instance}nil") in ("true", "1")
            facts.append((x.tag, x.get("contextRef"), x.get("unitRef"), int(d) if d and d.lstrip("-").isdigit() else None, None if nil else (x.text or "").strip()))
        x.clear()
    for i, (concept, ref, unit, decimals, value) in enumerate(facts):
        dims, typed, period = contexts.get(ref, ({}, {}, None))  # JN1: a fact without its context has no dimensions
        yield i, concept, ref, list(dims.items()), list(typed.items()), period, unit, decimals, value


_KINDS = [pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.int32(), pa.string()]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows, more = read_file(content.as_py()), True
            while more:
                part = list(islice(rows, 50_000))
                more = len(part) == 50_000
                columns = zip(*part, strict=True) if part else ([] for _ in _KINDS)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), *[pa.array(c, kind) for c, kind in zip(columns, _KINDS, strict=True)]], names=[x.split()[0] for x in SCHEMA.split(", ")])


def read_instances(spark: SparkSession, path: str, pattern: str = "*.{xml,xbrl}") -> DataFrame:
    """SRC1: facts with their key and number, of a file or of all files below a folder, wherever Spark can read it. A file is one row of a binary
    scan: files are spread over tasks, and a task holds one at a time. file is the path below the folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    base = path.rstrip("/").rpartition("/")[2]
    name = F.coalesce(F.nullif(F.substring_index("path", f"/{base}/", -1), F.col("path")), F.substring_index("path", "/", -1))
    f = files.select(name.alias("path"), "content").mapInArrow(_read, SCHEMA)
    every = F.map_concat("dims", F.transform_values("typed", lambda _, v: F.concat(F.lit("typed:"), v)))
    return f.withColumn("dim_key", dim_key(every)).withColumn("value_num", F.col("value_raw").try_cast("double"))


def _forward(rows: DataFrame, value: str, out: str) -> DataFrame:
    """rows (file, block, at, ...) with the last non-null `value` at or before each row of its file. Within a block by a window; what a block begins with comes from the blocks before, a row for each block."""
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.where(F.col(value).isNotNull()).groupBy("file", "block").agg(F.max_by(value, "at").alias("_end"))
    blocks = rows.select("file", "block").distinct().join(ends, ["file", "block"], "left")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("file", "block", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    return rows.withColumn("_own", F.last(value, ignorenulls=True).over(inside)).join(carried, ["file", "block"]).withColumn(out, F.coalesce("_own", "_carried")).drop("_own", "_carried")


def _plain(text: Column) -> Column:
    """Text without the five named entities of XML."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))


def read_large_instances(spark: SparkSession, path: str, pattern: str = "*.{xml,xbrl}") -> DataFrame:
    """SRC1, JN1: what read_instances gives, of files of any size: a file is read by as many tasks as it has splits, and contexts and facts are two streams of rows that are joined.

    Files are text whose records end at `</`: such a record holds the start tag and the text of one element without children, and the start tags around it. Facts are the records whose tag has a contextRef; a
    context's dimensions and dates are the records after its start, found by the records' order (split, then place). For files in UTF-8 without CDATA sections, numeric entities, or comments and attributes that hold tags; others go to
    read_instances."""
    raw = spark.read.option("lineSep", "</").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path)
    base = path.rstrip("/").rpartition("/")[2]
    name = lambda c: F.coalesce(F.nullif(F.substring_index(c, f"/{base}/", -1), F.col(c)), F.substring_index(c, "/", -1))
    r = raw.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("x"))
    r = settled(r.withColumn("file", name("_path")).drop("_path"))
    # prefixes: of the start tags that declare some
    declared = F.regexp_extract_all("x", F.lit(r'xmlns:([\w.-]+)\s*=\s*("[^"]*"|\'[^\']*\')'), F.lit(0))
    spaces = r.where(F.col("x").contains("xmlns:")).select("file", F.explode(declared).alias("d")).select("file", F.regexp_extract("d", r"xmlns:([\w.-]+)", 1).alias("p"), F.regexp_extract("d", r"""["']([^"']*)["']""", 1).alias("u"))
    spaces = spaces.groupBy("file").agg(F.map_from_entries(F.collect_set(F.struct("p", "u"))).alias("spaces"))
    leaf = r"<([^\s<>/!?]+)((?:\s(?:[^<>]*[^<>/])?)?)>([^<]*)$"
    part = lambda i: F.regexp_extract("x", leaf, i)
    said = lambda column, key: F.nullif(F.regexp_extract(column, rf"""(?:^|\s)(?:[\w.-]+:)?{key}\s*=\s*["']([^"']*)["']""", 1), F.lit(""))
    context = F.nullif(F.regexp_extract("x", r"""<(?:[\w.-]+:)?context\s[^<>]*?\bid\s*=\s*["']([^"']*)["']""", 1), F.lit(""))
    full = lambda q: F.when(F.try_element_at("spaces", F.substring_index(q, ":", 1)).isNotNull() & q.contains(":"), F.concat(F.lit("{"), F.try_element_at("spaces", F.substring_index(q, ":", 1)), F.lit("}"), F.substring_index(q, ":", -1))).otherwise(q)
    local = lambda tag: F.substring_index(tag, ":", -1)

    inside = _forward(r.withColumn("_c", context), "_c", "ctx_id").where("ctx_id IS NOT NULL")
    typed = F.regexp_extract("x", r"""<(?:[\w.-]+:)?typedMember\s[^<>]*dimension\s*=\s*["']([^"']*)["'][^<>]*>\s*<[^<>]*>[^<]*$""", 1)
    inside = inside.select("file", "ctx_id", local(part(1)).alias("tag"), said(part(2), "dimension").alias("dim"), F.nullif(typed, F.lit("")).alias("typed_dim"), _plain(part(3)).alias("text"), part(2).contains("contextRef").alias("fact"))
    inside = inside.where(~F.col("fact") & (F.col("tag").isin("explicitMember", "instant", "endDate") | F.col("typed_dim").isNotNull())).join(F.broadcast(spaces), "file", "left")
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    contexts = inside.groupBy("file", "ctx_id").agg(
        F.map_from_entries(F.collect_set(F.when(F.col("tag") == "explicitMember", pair(full(F.col("dim")), full(F.col("text")))))).alias("dims"),
        F.map_from_entries(F.collect_set(F.when(F.col("typed_dim").isNotNull(), pair(full(F.col("typed_dim")), F.col("text"))))).alias("typed"),
        F.coalesce(F.max(F.when(F.col("tag") == "instant", F.col("text"))), F.max(F.when(F.col("tag") == "endDate", F.col("text")))).alias("period"),
    )

    empty = F.regexp_extract_all("x", F.lit(r"<[^\s<>/!?]+\s[^<>]*contextRef[^<>]*/>"), F.lit(0))
    own = F.when(part(2).contains("contextRef"), F.array(F.regexp_extract("x", leaf, 0))).otherwise(F.array().cast("array<string>"))
    found = r.select("file", "block", "at", F.posexplode(F.concat(empty, own)).alias("nth", "e"))
    tag = F.regexp_extract("e", r"^<([^\s<>/]+)", 1)
    attributes = F.regexp_extract("e", r"^<[^\s<>/]+([^<>]*)", 1)
    found = found.withColumn("tag", tag).withColumn("attributes", attributes).join(F.broadcast(spaces), "file", "left").withColumn("concept", full(F.col("tag"))).where(~F.col("concept").startswith(_F))
    counts = found.groupBy("file", "block").agg(F.count("*").alias("n"))
    skip = counts.select("file", "block", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("skip"))
    number = F.row_number().over(Window.partitionBy("file", "block").orderBy("at", "nth")) - 1
    facts = found.withColumn("_n", number).join(skip, ["file", "block"])
    decimals = said("attributes", "decimals")
    nil = F.coalesce(said("attributes", "nil").isin("true", "1"), F.lit(False))
    facts = facts.select(
        "file", (F.col("_n") + F.col("skip")).cast("long").alias("fact_id"), "concept", said("attributes", "contextRef").alias("ctx_id"), said("attributes", "unitRef").alias("unit"),
        F.when(decimals.rlike("^-*[0-9]+$"), decimals.try_cast("int")).alias("decimals"), F.when(~nil, _plain(F.coalesce(F.nullif(F.regexp_extract("e", r">([^<]*)$", 1), F.lit("")), F.lit("")))).alias("value_raw"),
    )
    none = F.create_map().cast("map<string,string>")
    f = facts.join(contexts, ["file", "ctx_id"], "left").withColumns({"dims": F.coalesce("dims", none), "typed": F.coalesce("typed", none)})
    every = F.map_concat("dims", F.transform_values("typed", lambda _, v: F.concat(F.lit("typed:"), v)))
    return f.select(*[x.split()[0] for x in SCHEMA.split(", ")]).withColumn("dim_key", dim_key(every)).withColumn("value_num", F.col("value_raw").try_cast("double"))


def profile(facts: DataFrame) -> DataFrame:
    """SRC2, AG8: counts of facts, contexts, metrics, units, nil facts and the most dimensions of a fact."""
    return facts.agg(
        F.count("*").alias("facts"), F.count_distinct("ctx_id").alias("contexts"), F.count_distinct("concept").alias("metrics"), F.count_distinct("unit").alias("units"), F.count(F.when(F.col("value_raw").isNull(), 1)).alias("nil_facts"), F.max(F.size("dims") + F.size("typed")).alias("most_dims")
    )


_DECIMALS, _UNITS = {"MONETARY": -3, "DECIMAL": 2, "PERCENTAGE": 4, "INTEGER": 0}, {"MONETARY": "uGBP", "DECIMAL": "uPURE", "PERCENTAGE": "uPURE", "INTEGER": "uPURE"}


def build(cells: DataFrame, metrics: DataFrame, defaults: dict[str, str], order: list[str] | None = None, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """SNK2: (contexts, facts) of cells (concept, dims, value): empty values skipped, contexts by period type and dims without defaults,
    of facts with the same concept and context the first by `order` (columns of cells that place them) kept, unit and decimals by datatype. by: columns of an instance, which has contexts and facts of its own."""
    by = by or []
    known = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]).cast("map<string,string>") if defaults else F.create_map().cast("map<string,string>")
    c = cells.where("value IS NOT NULL AND value != ''").join(bounded(metrics.select("concept", "datatype", "period_type")), "concept", "left")
    kept = F.map_filter("dims", lambda d, m: ~m.eqNullSafe(F.try_element_at(known, d)))
    c = c.withColumn("kept", kept).withColumn("period_type", F.coalesce("period_type", F.lit("instant"))).withColumn("ctx_key", F.concat_ws("|", "period_type", dim_key(F.col("kept"))))
    c = c.withColumn("ctx_id", F.concat(F.lit("c"), F.substring(F.md5(F.col("ctx_key").cast("binary")), 1, 12)))
    first = F.min(F.struct(*(order or []), "value", "datatype")).alias("f")
    facts = c.groupBy(*by, "concept", "ctx_id").agg(first).select(*by, "concept", "ctx_id", "f.*")
    said = lambda table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("datatype"))
    contexts = c.groupBy(*by, "ctx_key", "ctx_id").agg(F.first("period_type").alias("period_type"), F.first(F.array_sort(F.map_entries("kept"))).alias("dims"))
    return contexts, facts.select(*by, "concept", "ctx_id", said(_UNITS).alias("unit"), said(_DECIMALS).alias("decimals"), "value", *(order or []))


def instance_lines(cells: DataFrame, metrics: DataFrame, module_tables: DataFrame, defaults: dict[str, str], typed: dict[str, str], entity: str, date: str, namespaces: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """SNK1-SNK4: (file, part, ord, line) of an instance for each module, and the cells that no module has. cells: (tbl, ord, concept, dims, value) with prefixed names;
    a table goes to its first module; filing indicators name the templates of an instance's tables. typed: dimension to the element of its values."""
    mine, unmapped = module_groups(cells, module_tables)
    c = mine.withColumnRenamed("module", "file").where("value IS NOT NULL AND value != ''")
    contexts, facts = build(c, metrics, defaults, ["ord"], ["file"])
    kind = F.create_map(*[F.lit(x) for kv in typed.items() for x in kv]).cast("map<string,string>") if typed else F.create_map().cast("map<string,string>")
    safe = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    element = lambda e: F.try_element_at(kind, e["key"])
    explicit = lambda e: say('<xbrldi:explicitMember dimension="', e["key"], '">', safe(e["value"]), "</xbrldi:explicitMember>")
    of_type = lambda e: say('<xbrldi:typedMember dimension="', e["key"], '"><', element(e), ">", safe(e["value"]), "</", element(e), "></xbrldi:typedMember>")
    members = F.array_join(F.transform("dims", lambda e: F.when(element(e).isNotNull(), of_type(e)).otherwise(explicit(e))), "")
    scenario = F.when(F.size("dims") > 0, say("<xbrli:scenario>", members, "</xbrli:scenario>")).otherwise("")
    period = F.when(F.col("period_type") == "duration", f"<xbrli:startDate>{date[:4]}-01-01</xbrli:startDate><xbrli:endDate>{date}</xbrli:endDate>").otherwise(f"<xbrli:instant>{date}</xbrli:instant>")
    who = f'<xbrli:entity><xbrli:identifier scheme="http://standards.iso.org/iso/17442">{escape(entity)}</xbrli:identifier></xbrli:entity><xbrli:period>'
    spaces = {"xbrli": _X[1:-1], "xbrldi": _D[1:-1], "find": _F[1:-1]} | namespaces
    head = '\ufeff<?xml version="1.0" encoding="utf-8"?>\n<xbrli:xbrl' + "".join(f" xmlns:{p}={quoteattr(u)}" for p, u in spaces.items()) + ">"
    units = '<xbrli:unit id="uPURE"><xbrli:measure>xbrli:pure</xbrli:measure></xbrli:unit><xbrli:unit id="uGBP"><xbrli:measure>iso4217:GBP</xbrli:measure></xbrli:unit>'
    plain = f'<xbrli:context id="cFI">{who}<xbrli:instant>{date}</xbrli:instant></xbrli:period></xbrli:context>'
    files = c.select("file").distinct()
    fixed = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit("").alias("ord"), F.lit(x).alias("line")) for p, x in ((0, head), (1, units), (1, plain), (3, "<find:fIndicators>"), (5, "</find:fIndicators>"), (7, "</xbrli:xbrl>"))]))
    lines = files.select("file", fixed.alias("x")).select("file", "x.*")
    lines = lines.unionByName(contexts.select("file", F.lit(2).alias("part"), F.col("ctx_key").alias("ord"), say('<xbrli:context id="', F.col("ctx_id"), f'">{who}', period, "</xbrli:period>", scenario, "</xbrli:context>").alias("line")))
    templates = c.select("file", template_of(F.col("tbl")).alias("ord")).distinct()
    lines = lines.unionByName(templates.select("file", F.lit(4).alias("part"), "ord", say('<find:filingIndicator contextRef="cFI">', safe(F.col("ord")), "</find:filingIndicator>").alias("line")))
    more = F.coalesce(say(' unitRef="', F.col("unit"), '" decimals="', F.col("decimals").cast("string"), '"'), F.lit(""))
    each = facts.select("file", F.lit(6).alias("part"), F.lpad(F.col("ord").cast("string"), 20, "0").alias("ord"), say("<", F.col("concept"), ' contextRef="', F.col("ctx_id"), '"', more, ">", safe(F.col("value")), "</", F.col("concept"), ">").alias("line"))
    return lines.unionByName(each), unmapped


def write_instances(lines: DataFrame, path: str) -> None:
    """SNK1: one file for each instance, below path/file=<instance>/, written by the tasks; UTF-8 with byte order mark and declaration."""
    lines.repartition("file").sortWithinPartitions("file", "part", "ord").select("file", F.col("line").alias("value")).write.partitionBy("file").text(path)


def write_instance(path: str, contexts: list[dict], facts: list[dict], entity: str, period: str, namespaces: dict[str, str]) -> None:
    """SNK1: one instance file, UTF-8 with byte order mark and declaration. An instance is a filing of bounded size; its rows come
    collected. Contexts: id, dims {prefix:dim: prefix:member}, typed {prefix:dim: (element, text)}."""
    spaces = {"xbrli": _X[1:-1], "xbrldi": _D[1:-1]} | namespaces
    with open(path, "w", encoding="utf-8-sig") as out:
        out.write('<?xml version="1.0" encoding="utf-8"?>\n<xbrli:xbrl' + "".join(f" xmlns:{p}={quoteattr(u)}" for p, u in spaces.items()) + ">\n")
        for c in contexts:
            members = "".join(f"<xbrldi:explicitMember dimension={quoteattr(d)}>{escape(m)}</xbrldi:explicitMember>" for d, m in sorted(c.get("dims", {}).items()))
            members += "".join(f"<xbrldi:typedMember dimension={quoteattr(d)}><{e}>{escape(v)}</{e}></xbrldi:typedMember>" for d, (e, v) in sorted(c.get("typed", {}).items()))
            scenario = f"<xbrli:scenario>{members}</xbrli:scenario>" if members else ""
            out.write(f'<xbrli:context id={quoteattr(c["id"])}><xbrli:entity><xbrli:identifier scheme="http://standards.iso.org/iso/17442">{escape(entity)}</xbrli:identifier></xbrli:entity><xbrli:period><xbrli:instant>{period}</xbrli:instant></xbrli:period>{scenario}</xbrli:context>\n')
        for f in facts:
            more = "".join(f" {k}={quoteattr(str(f[v]))}" for k, v in (("unitRef", "unit"), ("decimals", "decimals")) if f.get(v) is not None)
            out.write(f"<{f['concept']} contextRef={quoteattr(f['ctx_id'])}{more}>{escape(f['value'])}</{f['concept']}>\n")
        out.write("</xbrli:xbrl>\n")


def apply_edits(facts: DataFrame, edits: DataFrame, key: str = "fact_id") -> DataFrame:
    """SNK5: edited values by fact; edits of unknown facts are ignored."""
    return facts.join(edits.select(key, F.col("value_raw").alias("_e")), key, "left").withColumn("value_raw", F.coalesce("_e", "value_raw")).drop("_e")
