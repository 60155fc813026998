"""Search, scope, reconciliation, diffs (CT2-CT8, CT13, CT14, FLT10, FLT11, FLT16, JN7, JN10-JN14, JN19, SET1-SET5, AG7-AG12, AG18, RC13-RC15, SRC10, SRC14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import template_of
from .layout import page


def search(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """FLT10, FLT11: rows with the text in any of the columns, in any case."""
    test = F.lit(not text)
    for c in columns:
        test = test | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(text.lower()))
    return rows.where(test)


def in_template_scope(rows: DataFrame, indicators: DataFrame) -> DataFrame:
    """FLT16: rows (tbl) that a filing indicator (template) equals or is a dotted prefix of: an equi-join on each of the code's prefixes."""
    parts = F.split("tbl", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    hit = rows.select("tbl", F.explode(prefixes).alias("template")).distinct().join(indicators, "template", "left_semi").select("tbl").distinct()
    return rows.join(hit, "tbl", "left_semi")


def reverse_index(rules: DataFrame) -> DataFrame:
    """JN10: table to its rules, sorted."""
    return rules.select("code", F.explode("tables").alias("tbl")).groupBy("tbl").agg(F.array_sort(F.collect_set("code")).alias("rules"))


def class_counts(templates: DataFrame, rules: DataFrame, classes: list[str]) -> DataFrame:
    """JN11, CT13: each template's rules by class."""
    e = rules.select("klass", F.explode("tables").alias("tbl")).withColumn("template", template_of(F.col("tbl")))
    return templates.join(e, "template", "left").groupBy("template").agg(*[F.count(F.when(F.col("klass") == k, 1)).alias(k) for k in classes])


def primary_module(module_tables: DataFrame) -> DataFrame:
    """JN19: for each table the module with the most tables, the first by name of equal ones."""
    sizes = module_tables.groupBy("module").agg(F.count_distinct("tbl").alias("n"))
    best = module_tables.join(sizes, "module").groupBy("tbl").agg(F.min_by("module", F.struct(-F.col("n"), "module")).alias("module"))
    return best


def module_groups(selection: DataFrame, module_tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK3, JN13: selected tables with their first module, and those that no module has."""
    first = module_tables.groupBy("tbl").agg(F.min("module").alias("module"))
    return selection.join(first, "tbl"), selection.join(first, "tbl", "left_anti")


def of_module(rows: DataFrame, module_tables: DataFrame, module: str) -> DataFrame:
    """JN14: rows (tbl) of a module's tables."""
    return rows.join(module_tables.where(F.col("module") == module).select("tbl").distinct(), "tbl", "left_semi")


def browse(rules: DataFrame, module: str, text: str, columns: list[str], order: list, number: int = 1, size: int = 50) -> DataFrame:
    """CT6, SL2: a page of the rules (modules array, columns) of a module in which a text stands, with the total."""
    return page(search(rules.where(F.array_contains("modules", module)), text, columns), order, number, size)


def used_codes(scope: DataFrame, points: DataFrame) -> DataFrame:
    """AG10, AG11: distinct (kind, code) that the tables in scope use: metrics, dimensions and members."""
    p = points.join(scope.select("tbl").distinct(), "tbl", "left_semi")
    pairs = p.select(F.explode(F.map_entries("dims")).alias("e"))
    parts = [p.select(F.lit("metric").alias("kind"), F.col("concept").alias("code")), pairs.select(F.lit("dimension"), F.col("e.key")), pairs.select(F.lit("member"), F.col("e.value"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


def scope_tree(module_tables: DataFrame) -> DataFrame:
    """CT5: (framework, module, tables)."""
    return module_tables.groupBy("framework", "module").agg(F.count_distinct("tbl").alias("tables"))


def reconcile(a: DataFrame, b: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """JN12, SET4: each key's bucket: only_a, only_b, same or different."""
    x, y = a.select(key, *[F.col(c).alias(f"_a_{c}") for c in compare], F.lit(True).alias("_a")), b.select(key, *[F.col(c).alias(f"_b_{c}") for c in compare], F.lit(True).alias("_b"))
    same = F.lit(True)
    for c in compare:
        same = same & F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    bucket = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(same, "same").otherwise("different")
    return x.join(y, key, "full").select(key, bucket.alias("bucket"))


def merge_models(schema: DataFrame, workbook: DataFrame, key: str = "code") -> DataFrame:
    """CT3: the schema says what exists; the workbook refines the datatype only where that is flagged, and fills blank labels."""
    w = workbook.select(key, F.col("datatype").alias("_d"), F.col("label").alias("_l"))
    j = schema.join(w, key, "left")
    return j.withColumn("datatype", F.when(F.col("needs_refine"), F.coalesce("_d", "datatype")).otherwise(F.col("datatype"))).withColumn("label", F.coalesce(F.nullif("label", F.lit("")), "_l")).drop("_d", "_l")


def merge_fragments(parts: list[DataFrame], key: list[str], last_wins: bool = True) -> DataFrame:
    """SRC10: fragments united; of equal keys the last (or the first) fragment's row stays."""
    every = None
    for i, p in enumerate(parts):
        p = p.withColumn("_at", F.lit(i))
        every = p if every is None else every.unionByName(p, allowMissingColumns=True)
    order = F.col("_at").desc() if last_wins else F.col("_at")
    ties = [F.col(c) for c in every.columns if c != "_at" and dict(every.dtypes)[c] not in ("void",) and not dict(every.dtypes)[c].startswith("map")]
    return every.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(order, *ties))).where("_n = 1").drop("_n", "_at")


def redeclared(members: DataFrame) -> DataFrame:
    """SET5: member keys under more than one prefix."""
    return members.groupBy("member").agg(F.count_distinct("prefix").alias("prefixes")).where("prefixes > 1")


def regression(base: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """SET1-SET3: what was fixed (in base only) and what regressed (in new only)."""
    b, n = base.select(*on).distinct(), new.select(*on).distinct()
    return b.join(n, on, "left_anti").withColumn("change", F.lit("fixed")).unionByName(n.join(b, on, "left_anti").withColumn("change", F.lit("regressed")))


def histogram(rows: DataFrame, by: Column | str) -> DataFrame:
    """AG7, SL4: counts by a value, largest first."""
    return rows.groupBy((F.col(by) if isinstance(by, str) else by).alias("bucket")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bucket")


def mode_of(rows: DataFrame, column: str) -> DataFrame:
    """AG18: the most frequent value, the first of equal ones."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(1)


def incidence(terms: DataFrame) -> DataFrame:
    """AG12: equations that touch a cell."""
    return terms.groupBy("key").agg(F.count_distinct("code").alias("incidence"))


def cheapest(terms: DataFrame, preferred: Column) -> DataFrame:
    """SL6: each equation's cell of least incidence; preferred ones first among equals, then by key."""
    return terms.join(incidence(terms), "key").groupBy("code").agg(F.min_by("key", F.struct("incidence", (~preferred).cast("int"), "key")).alias("key"))


def rule_class(expression: Column) -> Column:
    """RC13: format, existence, inequality, an equality by shape or other, with a prefix for conditional rules. An order between two sides is an inequality unless something is also equal; `!=` is an equality's."""
    bare = F.trim(F.regexp_replace(expression, r"(?i)^\s*if\b.*?\bthen\b", ""))
    equal = F.regexp_replace(bare, "<=|>=|!=", "").contains("=") | bare.contains("!=")
    kind = (
        F.when(bare.rlike(r"\b(matches|isMatch)\s*\("), "format")
        .when(bare.rlike(r"(?i)\b(isnull|empty)\s*\("), "existence")
        .when(bare.rlike("[<>]") & ~equal, "inequality")
        .when(~equal, "other")
        .when(bare.rlike(r"\bi?(max|min)\s*\("), "equality-minmax")
        .when(bare.rlike(r"[*/]"), "equality-scaled")
        .when(bare.rlike(r"\bi?sum\s*\(|[+]|\}\s*i?-"), "equality-additivity")
        .otherwise("equality-simple")
    )
    return F.when(expression.rlike(r"(?i)^\s*if\b"), F.concat(F.lit("conditional/"), kind)).otherwise(kind)


def unhandled_class(expression: Column) -> Column:
    """RC14: why a rule is not one of the additive ones: empty, existence, conditional, power, minmax, inequality, constant (cells on one side only), product, ratio or other."""
    e = F.coalesce(expression, F.lit(""))
    sides = F.split(F.regexp_replace(e, r"i?=", "="), "=", 2)
    return (
        F.when(F.trim(e) == "", "empty")
        .when(e.rlike(r"(?i)\bisnull\b"), "existence")
        .when(e.rlike(r"(?i)^\s*if\b|\bthen\b"), "conditional")
        .when(e.rlike(r"\bexp\s*\("), "power")
        .when(e.rlike(r"\bi?(max|min)\s*\("), "minmax")
        .when(e.rlike(r"[<>]|!="), "inequality")
        .when(F.get(sides, F.lit(0)).contains("{") != F.coalesce(F.get(sides, F.lit(1)), F.lit("")).contains("{"), "constant")
        .when(e.rlike(r"\}\s*i?\*\s*i?\{"), "product")
        .when(e.rlike(r"\}\s*i?/\s*i?\{"), "ratio")
        .otherwise("other")
    )


def rule_shape(expression: Column) -> Column:
    """RC15: variables as $V, cells as {C}, numbers as N, white space collapsed."""
    s = F.regexp_replace(expression, r"\$[A-Za-z_][\w.-]*", r"\$V")
    s = F.regexp_replace(s, r"\{[^}]*\}", "{C}")
    s = F.regexp_replace(s, r"\b[0-9]+(\.[0-9]+)?\b", "N")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def table_summary(points: DataFrame) -> DataFrame:
    """AG9, CT4: for each framework its tables and datapoints."""
    return points.groupBy("framework").agg(F.count_distinct("tbl").alias("tables"), F.count("*").alias("datapoints"))


def grid_values(points: DataFrame, facts: DataFrame) -> DataFrame:
    """JN7, CT4: datapoints with the instance's values by cell key."""
    return points.join(facts.select("key", "value"), "key", "left")


def open_rows(points: DataFrame, facts: DataFrame, open_dims: list[str]) -> DataFrame:
    """CT8: a table's closed datapoints repeated for each tuple of open dimensions that the instance has for one of its metrics, with values.
    facts: (concept, dims, value)."""
    names = F.array(*[F.lit(d) for d in open_dims])
    opened = F.map_filter("dims", lambda d, _: F.array_contains(names, d))
    entries = lambda m: F.array_sort(F.map_entries(m))
    f = facts.select("concept", entries(opened).alias("open"), entries(F.map_filter("dims", lambda d, _: ~F.array_contains(names, d))).alias("closed"), "value").where(F.size("open") == len(open_dims))
    tuples = f.join(points.select("tbl", "concept").distinct(), "concept").select("tbl", "open").distinct()
    grid = points.select("tbl", "key", "concept", entries(F.col("dims")).alias("closed")).join(tuples, "tbl")
    return grid.join(f.select("concept", "closed", "open", "value"), ["concept", "closed", "open"], "left")


def sweep(verdicts: DataFrame) -> DataFrame:
    """CT14: for each module its instances, failures and share that holds."""
    return verdicts.groupBy("module").agg(F.count("*").alias("instances"), F.count(F.when(~F.col("ok"), 1)).alias("failing")).withColumn("held", 1 - F.col("failing") / F.col("instances"))
