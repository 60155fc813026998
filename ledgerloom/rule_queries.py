"""Queries over catalogues of rules, definitions and terms that Spark derives from the tables: as many rules as there are parts, as many definitions and terms as there are order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .file_queries import _LAYOUT_SQL, layout_positions, text
from .functions import keys as K
from .functions import values as V
from .operators import catalog, constraints, cube, derive, evaluate, graph, layout, repair
from .plans import compiler
from .queries import query
from .session import settled
from .sources import package, star

_KINDS = ["MONETARY", "INTEGER", "DATE", "BOOLEAN", "STRING", "DECIMAL", "PERCENTAGE"]


@query("""WITH t AS (SELECT p_partkey, (['MONETARY', 'INTEGER', 'DATE', 'BOOLEAN', 'STRING', 'DECIMAL', 'PERCENTAGE'])[p_partkey % 7 + 1] AS datatype,
 CASE p_size % 8 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN p_partkey || '.5e2' WHEN 2 THEN '20' || lpad((p_partkey % 100)::VARCHAR, 2, '0') || '-02-' || lpad((p_partkey % 32)::VARCHAR, 2, '0') WHEN 3 THEN 'x' || p_partkey WHEN 4 THEN (['true', 'no', '0', ''])[p_partkey % 4 + 1]
 WHEN 5 THEN '-.' || p_partkey WHEN 6 THEN '29/02/2024' END AS txt FROM part)
SELECT p_partkey, datatype, coalesce(txt IS NULL OR txt = '' OR CASE WHEN datatype IN ('MONETARY', 'DECIMAL', 'PERCENTAGE') THEN regexp_full_match(txt, '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?') WHEN datatype = 'INTEGER' THEN regexp_full_match(txt, '[+-]?[0-9]+')
 WHEN datatype = 'DATE' THEN regexp_full_match(txt, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(txt AS DATE) IS NOT NULL WHEN datatype = 'BOOLEAN' THEN txt IN ('true', 'false', '0', '1') ELSE true END, false) AS ok FROM t""")
def q_type_check(spark, d):
    """FLT13, FLT14: texts of many forms against the datatypes of their cells."""
    k, two = F.col("p_partkey"), lambda x: F.lpad(x.cast("string"), 2, "0")
    said = F.when(F.col("p_size") % 8 == 0, k.cast("string")).when(F.col("p_size") % 8 == 1, text(k, ".5e2")).when(F.col("p_size") % 8 == 2, text("20", two(k % 100), "-02-", two(k % 32))).when(F.col("p_size") % 8 == 3, text("x", k))
    said = said.when(F.col("p_size") % 8 == 4, F.get(F.lit(["true", "no", "0", ""]), (k % 4).cast("int"))).when(F.col("p_size") % 8 == 5, text("-.", k)).when(F.col("p_size") % 8 == 6, "29/02/2024")
    kind = F.get(F.lit(_KINDS), (k % 7).cast("int"))
    return star.table(spark, d, "part").select("p_partkey", kind.alias("datatype"), V.is_valid_text(kind, said).alias("ok"))


@query("SELECT p_partkey, p_partkey || 'x' || names[p_partkey % 11 + 1] AS t, kinds[p_partkey % 11 + 1] AS datatype, kinds[p_partkey % 11 + 1] = 'DECIMAL' AS refine FROM part, (SELECT ['monetaryItemType', 'percentItemType', 'QNameItemType', 'decimalItemType', 'doubleItemType', 'floatItemType', 'pureItemType', 'booleanItemType', 'dateItemType', 'integerItemType', 'stringItemType'] AS names, ['MONETARY', 'PERCENTAGE', 'ENUMERATION', 'DECIMAL', 'DECIMAL', 'DECIMAL', 'DECIMAL', 'BOOLEAN', 'DATE', 'INTEGER', 'STRING'] AS kinds)")
def q_item_types(spark, d):
    """SRC6: item types to datatypes, and which of them are to be refined."""
    names = ["monetaryItemType", "percentItemType", "QNameItemType", "decimalItemType", "doubleItemType", "floatItemType", "pureItemType", "booleanItemType", "dateItemType", "integerItemType", "stringItemType"]
    t = text(F.col("p_partkey"), "x", F.get(F.lit(names), (F.col("p_partkey") % 11).cast("int")))
    return star.table(spark, d, "part").select("p_partkey", t.alias("t"), package.datatype_of(t).alias("datatype"), package.needs_refine(t).alias("refine"))


@query("SELECT l_orderkey AS code, sum(abs(l_linenumber * 2 - 5) * CASE WHEN l_returnflag = 'N' THEN 0.5 ELSE 0.5 * pow(10, l_linenumber - 1) END)::DOUBLE AS tol FROM lineitem GROUP BY 1")
def q_tolerance(spark, d):
    """PRJ11, PRJ12: an equation's tolerance: its coefficients times half a unit in the last place of each cell."""
    t = star.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("code"), (F.col("l_linenumber") * 2 - 5).alias("coef"), F.when(F.col("l_returnflag") != "N", 1 - F.col("l_linenumber")).alias("dec"))
    return t.groupBy("code").agg(F.sum(F.abs("coef") * V.half_ulp(F.col("dec"))).alias("tol"))


# Rules over cells


def cell_rules(spark, d) -> DataFrame:
    """(code, expression, scope, tables, deactivated): a workbook rule for each part, of five forms; its cells are those of the part's layout."""
    p = star.table(spark, d, "part").select("p_partkey", "p_size", text("B", F.regexp_replace("p_brand", "[^0-9]", ""), ".", F.col("p_size")).alias("t"))
    k, t, r = F.col("p_partkey"), F.col("t"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")
    form = (
        F.when(k % 5 == 0, text("{t: ", t, ", r: ", r, "} i= isum({t: ", t, ", r: 90000001; 90000002})"))
        .when(k % 5 == 1, text("{t: ", t, ", r: ", r, "} i<= ", F.col("p_size"), " * {t: ", t, ", r: 90000001} i+ {t: OTHER, r: ", r, "}"))
        .when(k % 5 == 2, text("iabs({r: ", r, ", c: 0010}) i- ", F.col("p_size"), " i<= 2 * iabs({r: 90000001, c: 0010})"))
        .when(k % 5 == 3, text("{t: ", t, ", r: ", r, ", c: 0010} i> 3 * {t: ", t, ", r: ", r, ", c: 0020}"))
        .otherwise(text("{r: ", r, "} i= imax({r: 1}, 0)"))
    )
    scope = F.when(k % 5 == 0, text("scope({t: ", t, ", c: 0010; 0020, z: 0001; 0002})")).when(k % 5 == 2, text("scope({t: ", t, "})")).otherwise("")
    tables = F.when(k % 5 == 1, F.array(t, F.lit("OTHER"))).otherwise(F.array(t))
    return p.select(text("v", k).alias("code"), form.alias("expression"), scope.alias("scope"), tables.alias("tables"), (k % 7 == 0).alias("deactivated"))


_CELL_RULES = """p AS (SELECT p_partkey AS k, p_size AS n, 'B' || regexp_replace(p_brand, '[^0-9]', '', 'g') || '.' || p_size AS t, lpad(p_partkey::VARCHAR, 8, '0') AS r FROM part),
cells AS (SELECT k, t, 'v' || k AS code, '=' AS kind, 0.0::DOUBLE AS rhs, '-/' || cc || '/' || zz AS inst, coef::DOUBLE AS coef, t AS tbl, rr AS r, cc AS c, zz AS z, false AS bar FROM (SELECT *, unnest([r, '90000001', '90000002']) AS rr, unnest([1, -1, -1]) AS coef FROM p WHERE k % 5 = 0), (VALUES ('0010'), ('0020')) c(cc), (VALUES ('0001'), ('0002')) z(zz)
 UNION ALL SELECT k, t, 'v' || k, '<=', 0.0, '-/-/-', coef, tbl, rr, NULL, NULL, false FROM (SELECT k, t, unnest([1.0, -n, -1.0]) AS coef, unnest([t, t, 'OTHER']) AS tbl, unnest([r, '90000001', r]) AS rr FROM p WHERE k % 5 = 1)
 UNION ALL SELECT k, t, 'v' || k, '<=', CASE WHEN bar THEN 0 ELSE n END, CASE WHEN bar THEN '-/-/-' ELSE '-/-/-' END, coef, t, rr, '0010', NULL, bar FROM (SELECT k, n, t, unnest([1.0, -2.0, -1.0, -1.0]) AS coef, unnest([r, '90000001', r, '90000001']) AS rr, unnest([false, false, true, true]) AS bar FROM p WHERE k % 5 = 2)
 UNION ALL SELECT k, t, 'v' || k, '<=', 0.0, '-/-/-', coef, t, r, cc, NULL, false FROM (SELECT k, t, r, unnest([-1.0, 3.0]) AS coef, unnest(['0010', '0020']) AS cc FROM p WHERE k % 5 = 3))"""


@query(f"WITH {_CELL_RULES} SELECT code, kind, rhs, inst, coef, tbl, r, coalesce(c, '-') AS c, coalesce(z, '-') AS z FROM cells WHERE NOT bar")
def q_scope_expand(spark, d):
    """JN16, RC2-RC7, RC17: the terms of as many rules as there are parts, for each cell of each scope instance; rules that aren't linear have none."""
    terms = compiler.terms_of(cell_rules(spark, d)).where("NOT bar")
    return terms.select("code", "kind", "rhs", "inst", "coef", "tbl", "r", F.coalesce("c", F.lit("-")).alias("c"), F.coalesce("z", F.lit("-")).alias("z"))


@query(f"WITH {_LAYOUT_SQL}, p5 AS (SELECT p_partkey AS k, p_size AS n, 'B' || regexp_replace(p_brand, '[^0-9]', '', 'g') || '.' || p_size AS tbl, lpad(p_partkey::VARCHAR, 8, '0') AS r FROM part WHERE p_partkey % 5 = 1) SELECT 'v' || p5.k AS code, '-/-/-' AS inst, 1.0::DOUBLE AS coef, y.concept, y.dims AS dim_key FROM p5 JOIN y ON y.tbl = p5.tbl AND y.code = p5.r")
def q_cell_resolve(spark, d):
    """JN4: codes of rules' cells to the concepts and dimensions of layouts; the terms of codes and tables that no layout has drop out."""
    r = layout.resolve(compiler.terms_of(cell_rules(spark, d)).where("NOT bar AND c IS NULL").drop("bar"), layout_positions(spark, d))
    return r.select("code", "inst", "coef", "concept", K.dim_key(F.col("dims")).alias("dim_key"))


@query(f"""WITH {_CELL_RULES}, ours AS (SELECT DISTINCT t FROM p WHERE n % 2 = 0 UNION SELECT 'OTHER'), a AS (SELECT * FROM cells WHERE kind = '<=' AND k % 7 != 0 AND t IN (SELECT t FROM ours))
SELECT code, kind, rhs, CASE WHEN bar THEN inst || '/bar/' || r || '/' || c ELSE inst END AS inst, coef, tbl, r, coalesce(c, '-') AS c FROM a""")
def q_at_most_rows(spark, d):
    """RC18, RC19: `<=` rows of rules across tables and within one, of the tables with an even size; bars of absolute values say that what is inside is at least 0; equalities, rules of other tables and those that are switched off give none."""
    rules = cell_rules(spark, d)
    ours = star.table(spark, d, "part").where("p_size % 2 = 0").select(text("B", F.regexp_replace("p_brand", "[^0-9]", ""), ".", F.col("p_size")).alias("tbl")).unionByName(spark.range(1).select(F.lit("OTHER").alias("tbl")))
    rows = constraints.at_most_rows(rules, ours, across=True).unionByName(constraints.at_most_rows(rules, ours))
    return rows.select("code", "kind", "rhs", "inst", "coef", "tbl", "r", F.coalesce("c", F.lit("-")).alias("c"))


@query("""SELECT 'v' || p_partkey AS code, p_partkey % 5 = 0 AS guarded, CASE p_partkey % 5 WHEN 0 THEN 't' || p_partkey END AS target, CASE p_partkey % 5 WHEN 0 THEN 's' || p_partkey END AS parts, CASE p_partkey % 5 WHEN 1 THEN 'x' || p_partkey ELSE '' END AS absent,
 CASE p_partkey % 5 WHEN 2 THEN 'c' || p_partkey || ' >= ' || p_size END AS bound, CASE p_partkey % 5 WHEN 0 THEN '=' WHEN 1 THEN NULL WHEN 2 THEN '<=' WHEN 3 THEN '<=' ELSE '!=' END AS op, p_partkey % 5 IN (1, 4) AS nonlinear FROM part""")
def q_rule_forms(spark, d):
    """RC1, RC8-RC12, RC20, FLT7: what is read off rule texts by tasks: guard, derivation target, parts of a sum, absent variables, bound (turned round), comparison, also by a function's name."""
    k, n = F.col("p_partkey"), F.col("p_size")
    form = F.when(k % 5 == 0, text("if $g = 1 then sum($s", k, ") = $t", k)).when(k % 5 == 1, text("empty($x", k, ")")).when(k % 5 == 2, text(n, " <= $c", k)).when(k % 5 == 3, text("numeric-less-equal-than($a, $b", k, ")")).otherwise(text("$a != max($b", k, ")"))
    f = compiler.forms(star.table(spark, d, "part").select(text("v", k).alias("code"), form.alias("expression")), "a")
    return f.select("code", "guarded", "target", "parts", F.array_join("absent", ",").alias("absent"), "bound", "op", "nonlinear")


@query("""SELECT CASE p_partkey % 9 WHEN 0 THEN 'linear' WHEN 1 THEN 'conditional' WHEN 2 THEN 'power' WHEN 3 THEN 'minmax' WHEN 4 THEN 'product' WHEN 5 THEN 'ratio' WHEN 6 THEN 'existence' WHEN 7 THEN 'inequality' ELSE 'constant' END AS why, count(*) AS n, sum(CASE WHEN p_partkey % 9 = 8 THEN p_size END)::DOUBLE AS totals FROM part GROUP BY 1""")
def q_nonlinear(spark, d):
    """FLT7, RC14, RC16: rules that no linear form has, by why; and what cells that add up to a constant add up to."""
    k, n = F.col("p_partkey"), F.col("p_size")
    cases = [
        text("{r: ", k, "} i= {r: 1} i+ ", n, " * {r: 2}"), text("if {r: 1} i> 0 then {r: ", k, "} i= {r: 2} i* {r: 3}"), text("{r: ", k, "} i= exp({r: 1}, 1, 2)"), text("{r: ", k, "} i= imax({r: 1}, 0)"),
        text("{r: ", k, "} i= {r: 1} i* {r: 2}"), text("{r: ", k, "} i= {r: 1} / {r: 2}"), text("isNull({r: ", k, "})"), text("{r: ", k, "} i<= {r: 1} i* {r: 2}"), text("{r: ", k, "} i+ {r: 1} i= ", n),
    ]
    rules = star.table(spark, d, "part").select(k.cast("string").alias("code"), F.get(F.array(*cases), (k % 9).cast("int")).alias("expression"))
    f = compiler.forms(rules, "b").join(rules, "code")
    kept = F.when(F.col("nonlinear") | F.col("total").isNotNull(), catalog.unhandled_class(F.col("expression"))).otherwise("linear")
    return f.groupBy(kept.alias("why")).agg(F.count("*").alias("n"), F.sum("total").alias("totals"))


@query("""WITH t AS (SELECT 'r' || p_partkey AS code, 'T' || p_size AS tbl FROM part UNION SELECT 'r' || p_partkey, 'U' || p_partkey % 13 FROM part WHERE p_partkey % 2 = 0) SELECT tbl, string_agg(code, ',' ORDER BY code) AS rules, count(*) AS n FROM t GROUP BY 1""")
def q_reverse_index(spark, d):
    """JN10, JN11: the rules of each table, from the tables of each rule."""
    k = F.col("p_partkey")
    tables = F.array_compact(F.array(text("T", F.col("p_size")), F.when(k % 2 == 0, text("U", k % 13))))
    return catalog.reverse_index(star.table(spark, d, "part").select(text("r", k).alias("code"), tables.alias("tables"))).select("tbl", F.array_join("rules", ",").alias("rules"), F.size("rules").cast("long").alias("n"))


@query(f"WITH {_LAYOUT_SQL}, u AS (SELECT y.concept, y.dims || ',' || x.dims AS dims FROM y JOIN x USING (tbl) WHERE split_part(y.tbl, '.', 2)::INT % 2 = 0), d AS (SELECT unnest(str_split(dims, ',')) AS pair FROM u) SELECT 'metric' AS kind, concept AS code FROM u UNION SELECT 'dimension', split_part(pair, '=', 1) FROM d UNION SELECT 'member', split_part(pair, '=', 2) FROM d")
def q_scope_codes(spark, d):
    """AG10, AG11: the metrics, dimensions and members that tables of an even size use."""
    positions = layout_positions(spark, d)
    scope = positions.select("tbl").distinct().where("CAST(substring_index(tbl, '.', -1) AS INT) % 2 = 0")
    return catalog.used_codes(scope, layout.datapoints(positions))


# Graphs of definitions


_CHAINS = """e AS (SELECT 'p' || a.p_partkey AS node, 'p' || b.p_partkey AS source FROM part a JOIN part b ON b.p_partkey = CASE WHEN a.p_partkey % 10 < 9 THEN a.p_partkey + 1 WHEN a.p_partkey // 10 % 3 = 0 THEN a.p_partkey - 9 WHEN a.p_partkey // 10 % 3 = 1 THEN a.p_partkey - 19 END)"""


@query(f"WITH RECURSIVE {_CHAINS}, w(node, here, n) AS (SELECT node, source, 1 FROM e UNION ALL SELECT w.node, e.source, n + 1 FROM w JOIN e ON e.node = w.here WHERE n < 40) SELECT DISTINCT node FROM w WHERE n = 40")
def q_cycles(spark, d):
    """DV3, DV28: nodes on a cycle or above one, of chains of ten parts: a third of them closed, a third ending in a closed one."""
    return graph.cyclic(chains(spark, d))


def chains(spark, d) -> DataFrame:
    """(node, source): each part with the next one of its ten."""
    k = F.col("p_partkey")
    group = F.floor(k / 10) % 3
    parts = star.table(spark, d, "part").select(k)
    source = F.when(k % 10 < 9, k + 1).when(group == 0, k - 9).when(group == 1, k - 19)
    return parts.withColumn("to", source).join(parts.select(k.alias("to")), "to").select(text("p", k).alias("node"), text("p", F.col("to")).alias("source"))


_DEFS = "d AS (SELECT 'c' || l_linenumber % 3 AS code, 't' || l_orderkey AS target, CASE WHEN l_partkey % 7 = 0 THEN 't' || l_partkey ELSE 'p' || l_partkey END AS source, l_linenumber % 2 = 1 AS is_cross FROM lineitem WHERE l_partkey % 7 != 0 OR l_partkey < l_orderkey)"


def definitions(spark, d) -> DataFrame:
    """(code, target, source, is_cross): up to three definitions of each order from its lines' parts; some sources are orders themselves."""
    line = star.table(spark, d, "lineitem").where("l_partkey % 7 != 0 OR l_partkey < l_orderkey")
    return line.select(text("c", F.col("l_linenumber") % 3).alias("code"), text("t", F.col("l_orderkey")).alias("target"), text(F.when(F.col("l_partkey") % 7 == 0, "t").otherwise("p"), F.col("l_partkey")).alias("source"), (F.col("l_linenumber") % 2 == 1).alias("is_cross"))


@query(f"""WITH {_DEFS}, b AS (SELECT target, code, string_agg(DISTINCT source, ',' ORDER BY source) AS s FROM d GROUP BY 1, 2) SELECT (SELECT count(DISTINCT source) FROM d WHERE source NOT IN (SELECT target FROM d)) AS leaves,
 (SELECT count(DISTINCT target) FROM d WHERE target IN (SELECT source FROM d)) AS intermediate, (SELECT count(DISTINCT target) FROM d WHERE target NOT IN (SELECT source FROM d)) AS pure,
 (SELECT count(*) FROM (SELECT target FROM b GROUP BY 1 HAVING count(*) > 1)) AS multi_defined, (SELECT count(*) FROM (SELECT target FROM b GROUP BY 1 HAVING count(DISTINCT s) > 1)) AS differing""")
def q_dag_report(spark, d):
    """DV28, SET8: leaves, aggregates that feed others or not, cells with several definitions."""
    return graph.dag_report(definitions(spark, d))


@query(f"WITH {_DEFS} SELECT target, code FROM (SELECT target, code, row_number() OVER (PARTITION BY target ORDER BY bool_or(is_cross), count(DISTINCT source), code) AS k FROM d GROUP BY 1, 2) WHERE k = 1")
def q_canonical_def(spark, d):
    """SL7: of an order's definitions the single-table one, then that with the fewest sources."""
    return graph.canonical(definitions(spark, d))


@query("""WITH t AS (SELECT 'e' || l_orderkey AS code, 'p' || l_partkey AS k, sum(l_linenumber - 4) AS coef FROM lineitem GROUP BY 1, 2 HAVING abs(sum(l_linenumber - 4)) > 1e-9), i AS (SELECT k, count(DISTINCT code) AS incidence FROM t GROUP BY 1)
 SELECT code, k AS cheapest, incidence FROM (SELECT code, k, incidence, row_number() OVER (PARTITION BY code ORDER BY incidence, k) AS n FROM t JOIN i USING (k)) WHERE n = 1""")
def q_incidence(spark, d):
    """AG1, AG12, SL6: coefficients added up for each cell, the equations that touch it, and each equation's cell that the fewest others touch."""
    t = star.table(spark, d, "lineitem").select(text("e", F.col("l_orderkey")).alias("code"), text("p", F.col("l_partkey")).alias("key"), (F.col("l_linenumber") - 4).cast("double").alias("coef"), F.lit("-").alias("inst"))
    t = evaluate.coefficients(t)
    return catalog.cheapest(t, F.lit(False)).join(catalog.incidence(t), "key").select("code", F.col("key").alias("cheapest"), "incidence")


# Repair in rounds


@query("""WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2), f AS (SELECT o, n, min(least(v, 40000)) OVER (PARTITION BY o ORDER BY n DESC) AS v FROM l), t AS (SELECT o, sum(v::DECIMAL(18,2)) AS v FROM f GROUP BY 1)
 SELECT 'l' || o || '.' || n AS key, v::DOUBLE AS value FROM f UNION ALL SELECT 't' || o, v::DOUBLE FROM t UNION ALL SELECT 'c' || o_custkey, sum(v)::DOUBLE FROM t JOIN orders ON o = o_orderkey GROUP BY o_custkey""")
def q_repair_rounds(spark, d):
    """DV1, DV5-DV7, DV30, CT11: lines of an order are to grow and not to pass a bound; where they don't, they are moved, and orders' and customers' totals follow. A round judges what the one before has touched."""
    line = star.first_wins(star.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), ["l_orderkey", "l_linenumber"], ["l_extendedprice"])
    key = lambda n: text("l", F.col("l_orderkey"), ".", n)
    lines = settled(line.select("l_orderkey", "l_linenumber", key(F.col("l_linenumber")).alias("key"), F.col("l_extendedprice").alias("value")))
    orders = settled(star.table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi"))
    total, whole = text("t", F.col("l_orderkey")), text("c", F.col("o_custkey"))
    cells = lines.select("key", "value").unionByName(orders.select(text("t", F.col("o_orderkey")).alias("key"), F.lit(0.0).alias("value"))).unionByName(orders.select(whole.alias("key"), F.lit(0.0).alias("value")).distinct()).withColumn("decimals", F.lit(2))
    term = lambda df, target, source: df.select(target.alias("target"), source.alias("source"), F.lit(-1.0).alias("coef"), F.lit(1.0).alias("target_coef"))
    sums = term(lines, total, F.col("key")).unionByName(term(orders, whole, text("t", F.col("o_orderkey"))))
    bounds = lines.select(text("b", F.col("key")).alias("rule"), "key", F.lit("<=").alias("op"), F.lit(40_000.0).alias("bound"))
    follow = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    pairs = lines.select(text("p", F.col("key")).alias("rule"), F.col("key").alias("left_key"), F.lead("key").over(follow).alias("right_key"), F.lit(False).alias("strict")).where("right_key IS NOT NULL")
    return repair.repair(cells, sums, bounds, pairs).cells.select("key", "value")


@query(f"WITH {_CHAINS}, g AS (SELECT p_partkey // 10 AS g, min('p' || p_partkey) AS component FROM part WHERE p_partkey // 10 % 3 = 0 GROUP BY 1 HAVING count(*) = 10) SELECT 'p' || p_partkey AS node, component FROM part JOIN g ON p_partkey // 10 = g.g")
def q_strong_components(spark, d):
    """DV3, DV28: the chains of parts that are closed, each named by its smallest node; what leads into one is none."""
    return graph.strong_components(chains(spark, d))


@query("SELECT 'p' || p_partkey AS key, 2.0::DOUBLE AS value FROM part WHERE p_partkey // 10 % 3 = 0 AND p_partkey // 10 IN (SELECT p_partkey // 10 FROM part GROUP BY 1 HAVING count(*) = 10)")
def q_derive_cycles(spark, d):
    """DV3, DV4: each part of a closed chain is an eighth of the next one and 1.75: all settle at 2, whatever they start with."""
    e = chains(spark, d)
    one = e.select("node").distinct().select(F.col("node").alias("target"), F.lit("one").alias("source"), F.lit(-1.75).alias("coef"), F.lit(1.0).alias("target_coef"))
    eighth = e.select(F.col("node").alias("target"), "source", F.lit(-0.125).alias("coef"), F.lit(1.0).alias("target_coef"))
    start = star.table(spark, d, "part").select(text("p", F.col("p_partkey")).alias("key"), F.col("p_retailprice").alias("value")).unionByName(spark.range(1).select(F.lit("one").alias("key"), F.lit(1.0).alias("value")))
    v = derive.derive_with_cycles(start, eighth.unionByName(one))
    return v.where("cycle IS NOT NULL").select("key", F.round("value", 6).alias("value"))


_TREE = """e AS (SELECT 'W' AS parent, 'R' || r_regionkey AS child, 1.0 AS w FROM region UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN -1.0 ELSE 1.0 END FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 0.5 ELSE 1.0 END FROM customer)"""


def geography(spark, d) -> DataFrame:
    """(domain, parent, child, weight): world, regions, nations, customers."""
    r, n, c = (star.table(spark, d, t) for t in ("region", "nation", "customer"))
    row = lambda df, parent, child, weight: df.select(F.lit("GEO").alias("domain"), parent.alias("parent"), child.alias("child"), weight.cast("double").alias("weight"))
    return (
        row(r, F.lit("W"), text("R", F.col("r_regionkey")), F.lit(1))
        .unionByName(row(n, text("R", F.col("n_regionkey")), text("N", F.col("n_nationkey")), F.when(F.col("n_nationkey") % 5 == 0, -1).otherwise(1)))
        .unionByName(row(c, text("N", F.col("c_nationkey")), text("C", F.col("c_custkey")), F.when(F.col("c_custkey") % 7 == 0, 0.5).otherwise(1)))
    )


@query(f"""WITH RECURSIVE {_TREE}, t(top, at_, w) AS (SELECT parent, parent, 1.0::DOUBLE FROM e GROUP BY 1 UNION ALL SELECT top, child, t.w * e.w FROM t JOIN e ON e.parent = t.at_),
f AS (SELECT 'C' || o_custkey AS m, o_orderstatus AS s, sum(o_totalprice::DECIMAL(18,2)) AS v FROM orders GROUP BY 1, 2),
a AS (SELECT top AS member, s AS status, sum((t.w * v::DOUBLE)::DECIMAL(38,6)) AS parts FROM t JOIN f ON m = t.at_ GROUP BY 1, 2), k AS (SELECT member, status, parts, CASE WHEN member = 'W' THEN 'complete' WHEN member[1] = 'R' THEN 'partial' ELSE 'superset' END AS kind FROM a)
SELECT member, status, kind, round(parts, 2)::DOUBLE AS parts, CASE kind WHEN 'complete' THEN abs(1) <= 0.5 WHEN 'partial' THEN 1 >= -0.5 ELSE 1 <= 0.5 END AS ok FROM k""")
def q_weighted_totals(spark, d):
    """AG13, SRC22: totals of a hierarchy of three levels with weights, of all members at once, and reported ones (a unit too much) held against them by the kind of their breakdown."""
    leaves = star.table(spark, d, "orders").groupBy(text("C", F.col("o_custkey")).alias("member"), F.col("o_orderstatus").alias("status")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value")).withColumn("domain", F.lit("GEO"))
    totals = cube.weighted_totals(leaves, cube.leaf_weights(geography(spark, d)), ["status"]).where("member NOT LIKE 'C%'")
    kinds = totals.select("domain", "member").distinct().withColumn("kind", F.when(F.col("member") == "W", "complete").when(F.col("member").startswith("R"), "partial").otherwise("superset"))
    v = cube.breakdown_verdicts(totals, totals.withColumn("value", F.col("value") + 1), kinds, ["status"])
    return v.select("member", "status", "kind", F.round("parts", 2).alias("parts"), "ok")


@query("""WITH w AS (SELECT c_custkey AS c, c_nationkey AS n, n_regionkey AS r, greatest(round_even(c_acctbal, 0), 0)::BIGINT AS w FROM customer JOIN nation ON c_nationkey = n_nationkey),
rt AS (SELECT n_regionkey AS r, 1000003 + 17 * n_regionkey AS total FROM nation GROUP BY 1), nw AS (SELECT r, n, n * 10 + 1 AS w FROM (SELECT DISTINCT n_regionkey AS r, n_nationkey AS n FROM nation)),
nf AS (SELECT r, n, total, (total * w) // sum(w) OVER (PARTITION BY r) AS f, row_number() OVER (PARTITION BY r ORDER BY n) AS k FROM nw JOIN rt USING (r)),
na AS (SELECT n, r, (f + (k <= total - sum(f) OVER (PARTITION BY r))::INT)::BIGINT AS a FROM nf),
cf AS (SELECT c, n, a, CASE WHEN sum(w) OVER (PARTITION BY n) > 0 THEN (a * w) // sum(w) OVER (PARTITION BY n) ELSE a // count(*) OVER (PARTITION BY n) END AS f, row_number() OVER (PARTITION BY n ORDER BY c) AS k FROM w JOIN na USING (n)),
ca AS (SELECT c, (f + (k <= a - sum(f) OVER (PARTITION BY n))::INT)::BIGINT AS a FROM cf)
SELECT 'R' || r AS key, total::BIGINT AS assigned, 0 AS depth FROM rt UNION ALL SELECT 'N' || n, a, 1 FROM na UNION ALL SELECT 'C' || c, a, 2 FROM ca""")
def q_distribute_down(spark, d):
    """DV25: whole totals of regions handed down to nations and customers, each level adding up to the unit."""
    n, c = star.table(spark, d, "nation"), star.table(spark, d, "customer")
    tree = n.select(text("R", F.col("n_regionkey")).alias("parent"), text("N", F.col("n_nationkey")).alias("child"), F.col("n_nationkey").cast("long").alias("ord")).unionByName(c.select(text("N", F.col("c_nationkey")).alias("parent"), text("C", F.col("c_custkey")).alias("child"), F.col("c_custkey").alias("ord")))
    weights = n.select(text("N", F.col("n_nationkey")).alias("key"), (F.col("n_nationkey") * 10 + 1).cast("double").alias("value")).unionByName(c.select(text("C", F.col("c_custkey")).alias("key"), F.col("c_acctbal").alias("value")))
    roots = n.select("n_regionkey").distinct().select(text("R", F.col("n_regionkey")).alias("key"), (F.col("n_regionkey") * 17 + 1_000_003).alias("total"))
    return derive.distribute_down(tree, weights, roots)
