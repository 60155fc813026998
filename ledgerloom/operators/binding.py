"""Binding of rule variables and open cells to facts (FLT1, FLT2, FLT6, JN2, JN3, JN6, JN8, JN9, EV4, EV5).

facts: (concept, dims map, value, ...). filters: (rule, var, concept, dim, allowed array) - a row for each dimension filter, dim null
for a variable that only names a concept; an empty allowed array asks for the dimension's presence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import dim_key
from ..plans import shapes
from ..session import TEXTS_A_TASK, bounded, dealt, settled
from ..sources.formula import Rule


def merged_filters(filters: DataFrame) -> DataFrame:
    """FLT2: filters of the same variable and dimension united."""
    f = filters.select("rule", "var", "concept", "dim", F.explode_outer("allowed").alias("m"))
    return f.groupBy("rule", "var", "concept", "dim").agg(F.sort_array(F.collect_set("m")).alias("allowed"))


def selectors(filters: DataFrame) -> DataFrame:
    """(rule, var, concept, wants map dim -> allowed): one row for each variable and concept."""
    f = merged_filters(filters)
    pairs = F.collect_list(F.when(F.col("dim").isNotNull(), F.struct("dim", "allowed")))
    return f.groupBy("rule", "var", "concept").agg(F.map_from_entries(pairs).alias("wants"))


def candidates(facts: DataFrame, filters: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """FLT1, JN2: facts that fit a variable: equal concept, and for each filter an allowed member, the default where the dimension is absent."""
    known = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]).cast("map<string,string>") if defaults else F.create_map().cast("map<string,string>")
    effective = lambda d: F.coalesce(F.try_element_at("dims", d), F.try_element_at(known, d))
    fits = F.forall(F.map_entries("wants"), lambda e: F.when(F.size(e["value"]) == 0, F.try_element_at("dims", e["key"]).isNotNull()).otherwise(F.coalesce(F.array_contains(e["value"], effective(e["key"])), F.lit(False))))
    return facts.join(bounded(selectors(filters)), "concept").where(fits)


def _grouped(c: DataFrame, with_values: bool) -> DataFrame:
    """(rule, group_key, sums, counts and, if asked, values by variable) of candidates (rule, group_key, var, value)."""
    each = c.groupBy("rule", "group_key", "var").agg(F.sum("value").alias("s"), F.count("*").alias("n"), *([F.sort_array(F.collect_list("value")).alias("vs")] if with_values else []))
    of = lambda column: F.map_from_entries(F.collect_list(F.struct("var", column)))
    return each.groupBy("rule", "group_key").agg(of("s").alias("sums"), of("n").alias("counts"), *([of("vs").alias("values")] if with_values else []))


def bind(facts: DataFrame, filters: DataFrame, defaults: dict[str, str], with_values: bool = True) -> DataFrame:
    """JN3: for each rule and each key of the dimensions that none of its variables pins, the facts by variable.

    All variables' candidates go through one shuffle: a tagged union grouped by the key, not a join for each variable. Gives
    (rule, group_key, sums, counts, values: maps by variable). Sums and counts are partial aggregates; the sorted values are arrays as long as a
    group has facts, and only made if asked for."""
    pinned = filters.where("dim IS NOT NULL").groupBy("rule").agg(F.collect_set("dim").alias("pinned"))
    c = candidates(facts, filters, defaults).join(bounded(pinned), "rule", "left")
    free = F.map_filter("dims", lambda d, _: ~F.coalesce(F.array_contains("pinned", d), F.lit(False)))
    return _grouped(c.withColumn("group_key", dim_key(free)), with_values)


def rule_table(spark: SparkSession, rules: list[Rule] | DataFrame) -> DataFrame:
    """Rules, as objects or as rows (shapes.RULES), made ready for binding once: parsed by tasks and settled."""
    rows = shapes.rule_rows(spark, rules) if isinstance(rules, list) else rules
    return settled(shapes.prepared(dealt(rows, "rule", each=TEXTS_A_TASK)))


def bind_rules(facts: DataFrame, rules: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """JN3, FLT2, FLT3: (rule, group_key, summaries: map slot -> summary, unsure) of a rule_table. facts: (concept, dims, value text, perhaps typed and period).

    Facts meet variables by concept (a variable that no concept limits sees all facts), then by the conditions in the variable's row: the plan is
    the same for any number of rules. Groups are the explicit and typed dimensions that no variable's own filters name, and the period; dimensions that the whole set filters stay
    grouping ones. Where a filter is not known, facts that hang on it are not bound, and their group is unsure."""
    none = F.create_map().cast("map<string,string>")
    known = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]).cast("map<string,string>") if defaults else none
    f = facts.select("concept", "dims", "value", *[(F.col(c) if c in facts.columns else empty).alias(c) for c, empty in (("typed", none), ("period", F.lit(None).cast("string")))])
    wanted = rules.where("shape IS NOT NULL").select("rule", "pinned", F.explode("variables").alias("v")).select("rule", "pinned", "v.*")
    hit = f.join(bounded(wanted.where("concepts IS NOT NULL").withColumn("concept", F.explode("concepts")).drop("concepts")), "concept")
    anywhere = wanted.where("concepts IS NULL").drop("concepts")
    if anywhere.limit(1).count():
        hit = hit.unionByName(f.withColumn("_all", F.lit(1)).join(bounded(anywhere.withColumn("_all", F.lit(1))), "_all").drop("_all"))
    hit = hit.withColumn("_sure", shapes.fits(F.col("concept"), F.col("dims"), F.coalesce("typed", none), known)).where("_sure IS NULL OR _sure")
    free = lambda m: F.map_filter(m, lambda d, _: ~F.array_contains("pinned", d))
    typed = F.transform_values(F.coalesce("typed", none), lambda _, v: F.concat(F.lit("typed:"), v))
    key = F.concat_ws("|", dim_key(F.map_concat(free("dims"), free(typed))), "period")
    hit = hit.select("rule", "slot", key.alias("group_key"), F.when(F.col("_sure"), F.col("value")).alias("value"), "_sure")
    each = hit.groupBy("rule", "group_key", "slot").agg(*shapes.summary(F.col("value")), F.max(F.col("_sure").isNull()).alias("unsure"), F.count("_sure").alias("bound"))
    summaries = F.map_from_entries(F.collect_list(F.when(F.col("bound") > 0, F.struct("slot", F.struct("n", "total", "high", "low", "first").cast(shapes.SUMMARY)))))
    return each.groupBy("rule", "group_key").agg(summaries.alias("summaries"), F.max("unsure").alias("unsure"))


def rule_verdicts(bound: DataFrame, rules: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """EV4: (rule, group_key, ok, judged) of bound rules: one test for each shape of the rule_table, whatever the number of rules.

    A variable without a fact takes its fallback; a sequence without any is empty. A rule whose test needs a variable that has neither
    is not asserted (ok is null), unless all the test asks is whether it is absent; so is a rule whose condition does not hold and that has no else. Where filters that are not
    known leave open what is bound, nothing is judged."""
    about = shapes.seen(rules)
    found = [r[0] for r in about.select("shape").distinct().orderBy("shape").collect()]
    groups = bound.join(bounded(about), "rule")
    if len(found) > shapes.SHAPES_A_PASS:
        groups = settled(groups)  # each pass reads it
    return shapes.tested(groups, found, tolerance).select("rule", "group_key", F.when(~F.col("unsure"), F.col("ok")).alias("ok"), (~F.col("unsure")).alias("judged"))


def open_pairs(terms: DataFrame, facts: DataFrame) -> DataFrame:
    """JN6: closed cells (code, inst, coef, concept, dims) with the facts whose dims contain theirs, and `signature`: the key of
    the facts' other dims. Grouped by (code, inst, signature), cells of open tables pair up; a closed table has the empty signature only.

    Cells pin few different sets of dimensions (shapes). A fact is cut to each shape that its concept has, and joins cells on concept, shape and
    pinned key: it meets the cells that it fits and no others."""
    names = F.array_join(F.array_sort(F.map_keys("dims")), ",")
    t = terms.select("code", "inst", "coef", "concept", names.alias("shape"), dim_key(F.col("dims")).alias("pinned_key"), F.map_keys("dims").alias("pinned"))
    shapes = terms.select("concept", names.alias("shape"), F.array_sort(F.map_keys("dims")).alias("of")).distinct()
    f = facts.select("concept", "dims", "value").join(bounded(shapes), "concept")
    within = F.map_filter("dims", lambda d, _: F.array_contains("of", d))
    f = f.where(F.size(within) == F.size("of")).withColumn("pinned_key", dim_key(within)).withColumn("signature", dim_key(F.map_filter("dims", lambda d, _: ~F.array_contains("of", d))))
    return t.join(f.drop("of"), ["concept", "shape", "pinned_key"]).drop("shape", "pinned_key")


def open_check(terms: DataFrame, facts: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """EV5: sum of coef * value for each (code, inst, signature) that occurs, against 0."""
    sums = open_pairs(terms, facts).groupBy("code", "inst", "signature").agg(F.sum(F.col("coef") * F.col("value")).alias("residual"), F.count("*").alias("n_facts"))
    return sums.withColumn("ok", F.abs("residual") <= tolerance)


def lone_targets(terms: DataFrame, facts: DataFrame) -> DataFrame:
    """JN8: where a rule instance has exactly one target fact (coef > 0) in a signature, the sum of its other side."""
    p = open_pairs(terms, facts).withColumn("target", F.col("coef") > 0)
    g = p.groupBy("code", "inst", "signature").agg(
        F.count(F.when(F.col("target"), 1)).alias("n_targets"), F.max(F.when(F.col("target"), dim_key(F.col("dims")))).alias("target_key"), F.sum(F.when(~F.col("target"), -F.col("coef") * F.col("value"))).alias("derived")
    )
    return g.where("n_targets = 1").drop("n_targets")


def log_fixes(lines: DataFrame, facts: DataFrame, targets: DataFrame) -> DataFrame:
    """JN9, DV22: reported bindings (rule, line array) joined to facts by source line; where exactly one of them is the rule's target
    concept (targets: rule, concept), it becomes the sum of the others."""
    n = lines.agg(F.sum(F.size("lines"))).first()[0] or 0
    e = dealt(lines.withColumn("hit", F.monotonically_increasing_id()).select("rule", "hit", F.explode("lines").alias("src_line")), "src_line", n)
    j = e.join(facts.select("src_line", "concept", "value"), "src_line").join(bounded(targets.withColumnRenamed("concept", "t")), "rule")
    g = dealt(j, "hit", n).groupBy("rule", "hit").agg(F.count(F.when(F.col("concept") == F.col("t"), 1)).alias("n"), F.max(F.when(F.col("concept") == F.col("t"), F.col("src_line"))).alias("src_line"), F.sum(F.when(F.col("concept") != F.col("t"), F.col("value"))).alias("fixed"))
    return g.where("n = 1 AND fixed IS NOT NULL").select("rule", "src_line", "fixed")


def numeric_only(facts: DataFrame) -> DataFrame:
    """FLT6: facts that declare a precision or a unit."""
    return facts.where("decimals IS NOT NULL OR unit IS NOT NULL")
