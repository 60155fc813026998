"""Derivation of totals, repairs and distribution (DV1, DV4-DV7, DV17-DV26, DV29, DV30, GN8, SET8)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import cell_key, merge_aspects
from ..functions.values import round_to_decimals
from ..session import forget, numbered, settled, with_group
from .graph import levels, strong_components


def derive_levels(values: DataFrame, terms: DataFrame, overwrite: bool = True) -> DataFrame:
    """DV4: totals bottom-up. values (key, value); terms (target, source, coef, target_coef): target_coef * target + sum coef * source = 0.
    Absent sources are 0. With overwrite=False what is present stays (DV24). Cyclic targets are left alone. Gives (key, value, level)."""
    where = settled(levels(terms.select(F.col("target").alias("node"), "source")).where("level IS NOT NULL"))
    top = where.agg(F.max("level")).first()[0] or 0
    now = settled(values.select("key", "value").withColumn("level", F.lit(0)))
    for k in range(1, top + 1):
        t = terms.join(where.where(F.col("level") == k).select(F.col("node").alias("target")), "target", "left_semi")
        if not overwrite:
            t = t.join(now.select(F.col("key").alias("target")), "target", "left_anti")
        v = t.join(now.select(F.col("key").alias("source"), "value"), "source", "left").groupBy("target").agg((-F.sum(F.col("coef") * F.coalesce("value", F.lit(0.0))) / F.first("target_coef")).alias("value"))
        new = v.select(F.col("target").alias("key"), "value").withColumn("level", F.lit(k))
        before, now = now, settled(now.join(new, "key", "left_anti").unionByName(new))
        forget(before)
    return now


def derive_with_cycles(values: DataFrame, terms: DataFrame, rounds: int = 50, tolerance: float = 1e-9) -> DataFrame:
    """DV3, DV4: derive_levels for definitions with cycles: (key, value, level, cycle, moved). Groups that define each other are one node of the order; their cells are set again and again
    from each other, all groups of a level at once, until none moves by more than the tolerance (of its largest cell) or the rounds are over. cycle names a cell's group; moved is how far a cell of it
    last moved: more than the tolerance says that the group has no fixed point that this finds."""
    met = lambda table: table.hint("merge")  # as large as the cells: nothing of it goes through the driver
    groups = settled(strong_components(terms.select(F.col("target").alias("node"), "source")))
    of = lambda column: groups.select(F.col("node").alias(column), F.col("component").alias(f"_{column}"))
    named = terms.join(met(of("target")), "target", "left").join(met(of("source")), "source", "left")
    named = settled(named.withColumn("group", F.coalesce("_target", "target")).withColumn("below", F.coalesce("_source", "source")))
    where = levels(named.where("group != below").select(F.col("group").alias("node"), F.col("below").alias("source")))
    t = settled(named.join(met(where.withColumnRenamed("node", "group")), "group", "left").select("target", "source", "coef", "target_coef", F.coalesce("level", F.lit(0)).alias("level"), F.col("_target").alias("cycle")))
    top = t.agg(F.max("level")).first()[0]
    none = F.lit(None)
    now = settled(values.select("key", "value", F.lit(0).alias("level"), none.cast(groups.schema["component"].dataType).alias("cycle"), none.cast("double").alias("moved")))

    def derived(some: DataFrame, k: int) -> DataFrame:
        v = some.join(met(now.select(F.col("key").alias("source"), "value")), "source", "left").groupBy("target")
        v = v.agg((-F.sum(F.col("coef") * F.coalesce("value", F.lit(0.0))) / F.first("target_coef")).alias("value"), F.max("cycle").alias("cycle"))
        old = now.select(F.col("key").alias("target"), F.col("value").alias("_old"))
        return v.join(met(old), "target", "left").select(F.col("target").alias("key"), "value", F.lit(k).alias("level"), "cycle", F.when(F.col("cycle").isNotNull(), F.abs(F.col("value") - F.coalesce("_old", F.lit(0.0)))).alias("moved"))

    for k in range(0 if top is None else top + 1):
        here = settled(t.where(F.col("level") == k))
        for some, times in ((here.where("cycle IS NULL"), 1), (here.where("cycle IS NOT NULL"), rounds)):
            if some.isEmpty():
                continue
            for _ in range(times):
                new = settled(derived(some, k))
                before, now = now, settled(now.join(met(new.select("key")), "key", "left_anti").unionByName(new))
                forget(before)
                still = new.where(F.col("moved") > tolerance * F.greatest(F.lit(1.0), F.abs("value")))
                if times > 1 and still.isEmpty():
                    break
            if times > 1:  # a group rests when none of its cells moves
                last = new.groupBy("cycle").agg(F.max("moved").alias("_m"))
                before, now = now, settled(now.join(met(last), "cycle", "left").select("key", "value", "level", "cycle", F.coalesce("_m", "moved").alias("moved")))
                forget(before)
    return now


def distribute_down(tree: DataFrame, weights: DataFrame, totals: DataFrame) -> DataFrame:
    """DV25: (key, assigned, depth): whole totals (key, total) of roots handed down a tree (parent, child, ord) level by level, in proportion to weights (key, value: rounded, of at least 0), so that every
    parent's children add up to it to the unit. ord places the children of a parent; a child has one parent. What hangs on itself is handed nothing."""
    level = settled(totals.select("key", F.col("total").cast("long").alias("assigned"), F.lit(0).alias("depth")))
    w = settled(tree.join(weights.select(F.col("key").alias("child"), F.greatest(F.bround("value"), F.lit(0.0)).cast("long").alias("w")), "child", "left").select("parent", "child", "ord", F.coalesce("w", F.lit(0)).cast("long").alias("w")))
    out, k = level, 0
    while True:
        k += 1
        parts = w.join(level.select(F.col("key").alias("parent"), F.col("assigned").alias("total")), "parent").join(out.select(F.col("key").alias("child")), "child", "left_anti")
        parts = settled(parts)
        if parts.isEmpty():
            return out
        shared = distribute(parts, ["parent"], "w", "total", ["ord", "child"])
        level = settled(shared.select(F.col("child").alias("key"), "assigned", F.lit(k).alias("depth")))
        out = out.unionByName(level)


def derive_guarded(values: DataFrame, derived: DataFrame, guard: Column) -> DataFrame:
    """DV5: derived values (key, new, decimals) are taken, rounded to their decimals, where the guard holds."""
    j = values.join(derived, "key", "left")
    return j.withColumn("value", F.when(F.col("new").isNotNull() & F.coalesce(guard, F.lit(True)), round_to_decimals(F.col("new"), F.col("decimals"))).otherwise(F.col("value"))).drop("new")


def clamp(value: Column, op: str, bound: float, slack: Column) -> Column:
    """DV7: a value that violates a constant bound moves to it, plus or minus the slack."""
    return {
        ">=": F.when(value < bound, bound + slack).otherwise(value),
        ">": F.when(value <= bound, bound + slack + 1).otherwise(value),
        "<=": F.when(value > bound, bound - slack).otherwise(value),
        "<": F.when(value >= bound, bound - slack - 1).otherwise(value),
        "=": F.lit(bound),
    }[op]


def nudge(pairs: DataFrame, leaves: DataFrame, step: float = 1000.0) -> DataFrame:
    """DV6: for violated left <= right rows (rule, left_key, left, right_key, right, strict): the leaf to move (left first) and its new
    value; where rules want different values for a leaf, the first rule decides. All at once, so no order matters."""
    leaf = leaves.select("key", F.lit(True).alias("_leaf")).distinct()
    v = pairs.where((F.col("left") > F.col("right")) | (F.col("strict") & (F.col("left") == F.col("right"))))
    v = v.join(leaf.withColumnsRenamed({"key": "left_key", "_leaf": "_l"}), "left_key", "left").join(leaf.withColumnsRenamed({"key": "right_key", "_leaf": "_r"}), "right_key", "left")
    return moved_apart(v, F.col("_l"), F.col("_r"), step)


def moved_apart(pairs: DataFrame, left_leaf: Column, right_leaf: Column, step: float = 1000.0, more: tuple[str, ...] = ()) -> DataFrame:
    """The moves of `nudge` for violated pairs of which it is known which ends are leaves: (key, value, rule). more: what else to tell of the moved cell, from columns left_<name> and right_<name>."""
    gap = F.when(F.col("strict"), step).otherwise(0.0)
    side = lambda name: F.when(left_leaf, F.col(f"left_{name}")).when(right_leaf, F.col(f"right_{name}"))
    moved = pairs.select("rule", side("key").alias("key"), F.when(left_leaf, F.col("right") - gap).otherwise(F.col("left") + gap).alias("value"), *[side(m).alias(m) for m in more]).where("key IS NOT NULL")
    return moved.groupBy("key").agg(F.min_by("value", "rule").alias("value"), F.min("rule").alias("rule"), *[F.max(m).alias(m) for m in more])


def one_hot(groups: DataFrame, by: list[str], order: list[str], total: Column) -> DataFrame:
    """DV19: cells of a constant sum: the first gets the constant, the others 0. order has to be total."""
    first = groups.groupBy(*by).agg(F.min(F.struct(*order)).alias("_first"))
    out = with_group(groups, first, by)
    return out.withColumn("assigned", F.when(F.struct(*order) == F.col("_first"), total).otherwise(0.0)).drop("_first")


def distribute(parts: DataFrame, by: list[str], weight: str, total: str, order: list[str]) -> DataFrame:
    """DV25: a whole total over parts in proportion to their weights: floors, and the rest one by one to the first parts. All-zero
    weights count as equal. Sums are aggregates and places are counted over ranges of a group, so that a group may be of any size. order has to be total."""
    sums = parts.groupBy(*by).agg(F.sum(weight).alias("_w"), F.count("*").alias("_c"))
    p = with_group(parts, sums, by)
    by_weight = F.floor(F.col(total).cast("double") * F.col(weight).cast("double") / F.col("_w").cast("double"))
    p = settled(p.withColumn("_share", F.when(F.col("_w") > 0, by_weight).otherwise(F.floor(F.col(total) / F.col("_c"))).cast("long")))
    rest = p.groupBy(*by).agg((F.max(total) - F.sum("_share")).alias("_rest"))
    placed = with_group(numbered(p, by, order, "_place"), rest, by)
    return placed.withColumn("assigned", (F.col("_share") + (F.col("_place") <= F.col("_rest")).cast("long")).cast("long")).select(*parts.columns, "assigned")


def absorb(parts: DataFrame, by: list[str], total: str, value: str, free: str, order: list[str]) -> DataFrame:
    """DV26: a total's gap over its determined parts goes to the first free part, if the gap isn't negative; other free parts are 0."""
    held = F.sum(F.when(~F.col(free), F.col(value)).otherwise(0.0))
    groups = parts.groupBy(*by).agg((F.max(total) - held).alias("_gap"), F.min(F.when(F.col(free), F.struct(*order))).alias("_first"))
    p = with_group(parts, groups, by)
    takes = F.coalesce(F.struct(*order) == F.col("_first"), F.lit(False)) & (F.col("_gap") >= 0)
    return p.withColumn("assigned", F.when(~F.col(free), F.col(value)).when(takes, F.col("_gap")).otherwise(0.0)).drop("_gap", "_first")


def order_dates(rows: DataFrame, start: str, end: str, early: str, late: str) -> DataFrame:
    """DV29: where a start lies after its end, fixed dates far apart."""
    bad = F.col(start) > F.col(end)
    return rows.withColumns({start: F.when(bad, F.lit(early).cast("date")).otherwise(F.col(start)), end: F.when(bad, F.lit(late).cast("date")).otherwise(F.col(end))})


def cross_table(plans: DataFrame, values: DataFrame, incidence: DataFrame, rounds: int = 5) -> DataFrame:
    """DV17, AG12, SL6: cross-table plans (code, key, coef; sum coef * value = 0): each round every violated plan picks its cheapest cell by
    (incidence, key), sets it so that the plan holds unless it would be negative, and the plans' picks for a cell are settled by the
    first code; a round that does not lower the number of violated plans is not taken."""
    now = settled(values.select("key", "value"))

    def state(v: DataFrame) -> DataFrame:
        return plans.join(v, "key", "left").groupBy("code").agg(F.sum(F.col("coef") * F.coalesce("value", F.lit(0.0))).alias("residual"))

    bad = state(now).where("abs(residual) > 0.5").count()
    for _ in range(rounds):
        if not bad:
            break
        r = state(now).where("abs(residual) > 0.5")
        pick = plans.join(incidence, "key", "left").groupBy("code").agg(F.min_by(F.struct("key", "coef"), F.struct(F.coalesce("incidence", F.lit(0)), "key")).alias("p"))
        new = r.join(pick, "code").join(now.withColumnRenamed("key", "k"), F.col("p.key") == F.col("k"), "left")
        new = new.select("code", F.col("p.key").alias("key"), (F.coalesce("value", F.lit(0.0)) - F.col("residual") / F.col("p.coef")).alias("new")).where("new >= 0").groupBy("key").agg(F.min_by("new", "code").alias("new"))
        tried = settled(now.join(new, "key", "full").select("key", F.coalesce("new", "value").alias("value")))
        left = state(tried).where("abs(residual) > 0.5").count()
        if left >= bad:
            break
        now, bad = tried, left
    return now


def sinks(values: DataFrame, terms: DataFrame, owned: DataFrame) -> DataFrame:
    """DV18, DV21: lone totals of cross-table rules (target, source, coef, target_coef) that are present and that no single-table rule owns, set to what their sources
    say; all else stays. values: (key, value). A total that owned (key) names is protected, and so is one whose sources are not all there."""
    open_ = terms.join(values.select(F.col("key").alias("target")), "target", "left_semi").join(owned.select(F.col("key").alias("target")), "target", "left_anti")
    j = open_.join(values.select(F.col("key").alias("source"), "value"), "source", "left")
    new = j.groupBy("target").agg(F.bool_and(F.col("value").isNotNull()).alias("all"), (-F.sum(F.col("coef") * F.col("value")) / F.max("target_coef")).alias("new")).where("all")
    return values.join(new.select(F.col("target").alias("key"), "new"), "key", "left").select("key", F.coalesce("new", "value").alias("value"))


def absent_totals(values: DataFrame, terms: DataFrame, inject: dict[str, str], admitted: DataFrame) -> DataFrame:
    """DV23: (key, concept, dims, value) of totals that are absent: terms (target, concept, source, coef, target_coef) and values (key, concept, dims, value). A total's dims are
    those that its sources agree on, with the injected ones; it is made only if admitted (key) has its key, so that no fact is made that no cube holds."""
    absent = terms.join(values.select(F.col("key").alias("target")), "target", "left_anti")
    j = absent.join(values.select(F.col("key").alias("source"), "dims", "value"), "source")
    pairs = j.select("target", F.explode(F.map_entries("dims")).alias("e")).groupBy("target", "e").agg(F.count("*").alias("n"))
    of = j.groupBy("target").agg(F.first("concept").alias("concept"), F.count("*").alias("parts"), (-F.sum(F.col("coef") * F.col("value")) / F.max("target_coef")).alias("value"))
    shared = pairs.join(of.select("target", "parts"), "target").where("n = parts").groupBy("target").agg(F.map_from_entries(F.collect_list("e")).alias("shared"))
    more = F.create_map(*[F.lit(x) for kv in sorted(inject.items()) for x in kv]).cast("map<string,string>") if inject else F.create_map().cast("map<string,string>")
    made = of.join(shared, "target", "left").withColumn("dims", merge_aspects(F.coalesce("shared", F.create_map().cast("map<string,string>")), more))
    made = made.withColumn("key", cell_key(F.col("concept"), F.col("dims")))
    return made.join(admitted.select("key").distinct(), "key", "left_semi").select("key", "concept", "dims", "value")


def until_clean(state: DataFrame, repair: Callable[[DataFrame], DataFrame], violations: Callable[[DataFrame], DataFrame], rounds: int = 6) -> tuple[DataFrame, list[int]]:
    """DV1, DV30: check, repair and check again until nothing is violated, nothing improves or the rounds are over; the best state and the counts."""
    counts = [violations(state).count()]
    while counts[-1] and len(counts) <= rounds:
        tried = settled(repair(state))
        n = violations(tried).count()
        if n >= counts[-1]:
            break
        state = tried
        counts.append(n)
    return state, counts
