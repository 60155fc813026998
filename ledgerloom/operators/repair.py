"""Repair of values in semi-naive rounds (DV1, DV5-DV7, DV30, EXI1, CT11): after the first, a round looks only at what the round before has changed.

cells: (key, value, decimals), each key once. derivations: (target, source, coef, target_coef): target_coef * target + sum coef * source = 0, targets rounded to their decimals.
bounds: (rule, key, op, bound). pairs: (rule, left_key, right_key, strict): left <= right, or left < right. A leaf is a cell that no derivation has as its target; only leaves are moved, derived cells follow.

Bounds and pairs carry the values that their cells came in with; what changes is a table laid over the cells. A round finds the constraints that changed keys touch by semi-joins, reads changed values from the table of
changes and takes nothing else from the cells. Totals on which no constraint lies are derived once, at the end. Tables of changes are settled, so that Spark broadcasts them where they are small: then a round scans and shuffles only what it touches.

Edge cases: an absent cell counts as 0 where it is a source, and a constraint with one is not judged; a null value is an absent cell; cyclic targets are left alone; several rules that want to move a cell: bounds before pairs, then the first
rule; nothing to repair: one round; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import round_to_decimals
from ..session import forget, settled
from . import derive
from .graph import levels

#: Rounds whose constraints are kept apart before their verdicts are written as one table.
MOST_KEPT = 16


class _Round:
    """What a round has judged, and of that what fails; counted when asked for."""

    def __init__(self, number: int, judged: tuple[DataFrame, DataFrame], bad: DataFrame, moved: int):
        self.number, self.judged, self.bad, self.moved, self.derived = number, judged, bad, moved, 0
        self._counts = None

    def rules(self) -> DataFrame:
        return self.judged[0].select("rule").unionByName(self.judged[1].select("rule"))

    def verdicts(self) -> DataFrame:
        """(rule, last): the round and whether the rule fails. The first one judges all, so only its failing rules are told."""
        told = self.bad.select("rule", F.struct(F.lit(self.number).alias("round"), F.lit(True).alias("fails")).alias("last"))
        return told if self.number == 1 else told.unionByName(self.rules().select("rule", F.struct(F.lit(self.number).alias("round"), F.lit(False).alias("fails")).alias("last")))

    def told(self) -> dict[str, int]:
        if self._counts is None:
            self._counts = self.rules().distinct().count(), self.bad.select("rule").distinct().count()
        return {"judged": self._counts[0], "failing": self._counts[1], "moved": self.moved, "derived": self.derived}


@dataclass
class Repaired:
    """cells: (key, value, decimals) at the end; violated: (rule) that still fail; rounds: constraints judged, of them failing, cells moved and cells derived anew, of each round."""

    cells: DataFrame
    violated: DataFrame
    _rounds: list[_Round] = field(repr=False)

    @functools.cached_property
    def rounds(self) -> list[dict[str, int]]:
        return [r.told() for r in self._rounds]


class _Cells:
    """Cells (key, value, decimals), absent ones with a null value, with a settled table of changes over them."""

    def __init__(self, base: DataFrame):
        self.base = base.select("key", "value", "decimals")
        self.over = settled(self.base.select("key", "value").limit(0))

    def put(self, changed: DataFrame) -> None:
        """Take new values (key, value), a settled table."""
        before, self.over = self.over, settled(self.over.join(changed.select("key"), "key", "left_anti").unionByName(changed.select("key", "value")))
        forget(before)

    def each(self) -> DataFrame:
        """All keys as they are now: (key, value, decimals, there)."""
        over = self.over.select("key", F.col("value").alias("_v"), F.lit(True).alias("_o"))
        return self.base.join(over, "key", "left").select("key", F.when(F.col("_o"), F.col("_v")).otherwise(F.col("value")).alias("value"), "decimals", (F.col("_o").isNotNull() | F.col("value").isNotNull()).alias("there"))

    def all(self) -> DataFrame:
        return self.each().where("there").drop("there")


def _derived(leaves: _Cells, totals: _Cells, terms: DataFrame, first: int, last: int, changed: DataFrame | None) -> tuple[DataFrame | None, int]:
    """Derive anew, level by level, the targets that changed keys reach (all, if None); the keys that changed in all, and the number of derived ones."""
    n = 0
    for k in range(first, last + 1):
        hit = terms.where(F.col("level") == k)
        if changed is not None:
            reached = hit.join(changed.select(F.col("key").alias("source")), "source", "left_semi").select("target").distinct()
            hit = hit.join(reached, "target", "left_semi")
        # the lowest level has leaves only as its sources
        now = leaves.all() if k == 1 else leaves.all().unionByName(totals.all())
        v = now.select(F.col("key").alias("source"), "value").join(hit, "source", "right").groupBy(F.col("target").alias("key"))
        v = v.agg((-F.sum((F.col("coef") * F.coalesce("value", F.lit(0.0))).cast("decimal(38,10)")).cast("double") / F.max("target_coef")).alias("_new"))
        v = v.join(totals.each(), "key").withColumn("_new", round_to_decimals(F.col("_new"), F.col("decimals")))
        moved = settled(v.where(~F.col("_new").eqNullSafe(F.col("value"))).select("key", F.col("_new").alias("value")))
        totals.put(moved)
        n += moved.count()
        if changed is not None:
            changed = changed.unionByName(moved.select("key"))
    return changed, n


def _holds(value: Column, op: Column, bound: Column) -> Column:
    return F.when(op == ">=", value >= bound).when(op == ">", value > bound).when(op == "<=", value <= bound).when(op == "<", value < bound).otherwise(value == bound)


def _inside(op: Column, bound: Column, unit: Column) -> Column:
    """The nearest value within a bound: a unit of the cell's precision beyond a strict one."""
    return F.when(op == ">", bound + unit).when(op == "<", bound - unit).otherwise(bound)


def repair(cells: DataFrame, derivations: DataFrame, bounds: DataFrame, pairs: DataFrame, most: int | None = None, step: float = 1000.0) -> Repaired:
    """DV1, DV30: derive totals, judge bounds and pairs, move leaves, derive and judge what that touches, until no leaf moves. most: rounds at most, if any; what then still fails is in `violated`. step: how far a strict pair is set apart."""
    d = settled(derivations.where("target IS NOT NULL AND source IS NOT NULL"))
    targets = levels(d.select(F.col("target").alias("node"), "source")).where("level IS NULL OR level > 0").select(F.col("node").alias("key"), "level", F.lit(True).alias("target"))
    terms = settled(d.join(targets.where("level IS NOT NULL").select(F.col("key").alias("target"), "level"), "target"))
    top = terms.agg(F.max("level")).first()[0] or 0
    present = cells.where("value IS NOT NULL").select("key", F.col("value").cast("double").alias("value"), "decimals")
    known = settled(present.join(targets, "key", "full"))
    leaves, totals = _Cells(known.where("target IS NULL")), _Cells(known.where("target"))
    leaf = F.col("target").isNull().alias("leaf")
    bounds = settled(bounds.select("rule", "key", "op", F.col("bound").cast("double").alias("bound")).join(known, "key", "left").select("rule", "key", "op", "bound", "value", "decimals", leaf, "level"))
    end = lambda side: known.select(F.col("key").alias(f"{side}_key"), F.col("value").alias(side), F.col("decimals").alias(f"{side}_decimals"), F.col("target").alias(f"{side}_target"), F.col("level").alias(f"{side}_level"))
    pairs = settled(pairs.select("rule", "left_key", "right_key", "strict").join(end("left"), "left_key", "left").join(end("right"), "right_key", "left"))
    # before the end only those levels are derived on which constraints lie; what lies above follows once
    seen = max(bounds.agg(F.max("level")).first()[0] or 0, pairs.agg(F.greatest(F.max("left_level"), F.max("right_level"))).first()[0] or 0)
    unit = F.pow(F.lit(10.0), -F.coalesce("decimals", F.lit(0)).cast("double"))

    _derived(leaves, totals, terms, 1, seen, None)
    touched, told, old = None, [], []
    while most is None or len(told) < most:
        b, p = bounds, pairs
        if touched is not None:
            touched = settled(touched.distinct())
            b = settled(b.join(touched, "key", "left_semi"))
            of = lambda side: touched.select(F.col("key").alias(f"{side}_key"), F.lit(True).alias(f"_{side}"))  # noqa: B023, E731
            p = settled(p.join(of("left"), "left_key", "left").join(of("right"), "right_key", "left").where("_left OR _right").drop("_left", "_right"))
        over = leaves.over.unionByName(totals.over).select("key", F.col("value").alias("_v"), F.lit(True).alias("_o"))
        now = lambda rows, key, value: rows.join(over.withColumnRenamed("key", key), key, "left").withColumn(value, F.when(F.col("_o"), F.col("_v")).otherwise(F.col(value))).drop("_v", "_o")  # noqa: B023, E731
        bad_b = now(b, "key", "value").where(~_holds(F.col("value"), F.col("op"), F.col("bound")))
        bad_p = now(now(p, "left_key", "left"), "right_key", "right").where((F.col("left") > F.col("right")) | (F.col("strict") & (F.col("left") == F.col("right"))))
        bad = settled(bad_b.drop("level").unionByName(bad_p.drop("left_level", "right_level"), allowMissingColumns=True))
        by_bound = bad.where("leaf").groupBy("key").agg(F.min_by(_inside(F.col("op"), F.col("bound"), unit), "rule").alias("_new"), F.max("value").alias("value"), F.max("decimals").alias("decimals"))
        # the moved cell's own value and precision come with the pair
        apart = bad.where("left_key IS NOT NULL").withColumns({"left_was": F.col("left"), "right_was": F.col("right")})
        apart = derive.moved_apart(apart, F.col("left_target").isNull(), F.col("right_target").isNull(), step, ("was", "decimals"))
        by_pair = apart.join(by_bound.select("key"), "key", "left_anti").select("key", F.col("value").alias("_new"), F.col("was").alias("value"), "decimals")
        new = by_bound.unionByName(by_pair).withColumn("_new", round_to_decimals(F.col("_new"), F.col("decimals")))
        moved = settled(new).where(~F.col("_new").eqNullSafe(F.col("value"))).select("key", F.col("_new").alias("value"))
        told.append(_Round(len(told) + 1, (b, p), bad, moved.count()))
        old.append(told[-1].verdicts())
        if not told[-1].moved:
            break
        leaves.put(moved)
        forget(touched)
        touched, told[-1].derived = _derived(leaves, totals, terms, 1, seen, moved.select("key"))
        if len(old) > MOST_KEPT:
            old = [settled(_last(old))]
            for r in told[-MOST_KEPT - 1 :]:
                r.told()
                forget(r.bad, *(() if r.number == 1 else r.judged))
    above = _derived(leaves, totals, terms, seen + 1, top, None)[1]
    if told:
        told[-1].derived += above
    violated = _last(old).where("last.fails").select("rule") if old else bounds.select("rule").limit(0)
    return Repaired(leaves.all().unionByName(totals.all()), violated, told)


def _last(verdicts: list[DataFrame]) -> DataFrame:
    """(rule, last): of each rule the latest round that tells of it, failing before holding."""
    return functools.reduce(DataFrame.unionByName, verdicts).groupBy("rule").agg(F.max("last").alias("last"))
