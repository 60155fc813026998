"""Linear `<=` rows and date orders that rules imply, for the solvers (RC18, RC19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import compiler
from ..session import bounded, settled


def at_most_rows(rules: DataFrame, tables: DataFrame, across: bool = False) -> DataFrame:
    """RC19, RC18: (code, inst, kind, rhs, coef, tbl, r, c, z): terms of the rules' comparisons as sum coef * x <= rhs for each scope instance. rules: (code, expression, scope, tables array, deactivated);
    those of one of the tables (tbl), or with across those of several that all are among them. Bars of absolute values are dropped, and say so by a row of
    their own for each cell inside: -x <= 0."""
    active = rules.where(~F.coalesce("deactivated", F.lit(False)) & ((F.size(F.array_distinct("tables")) > 1) if across else (F.size(F.array_distinct("tables")) <= 1)))
    ours = tables.select(F.col("tbl").alias("_t")).distinct().withColumn("_ours", F.lit(True))
    used = active.select("code", F.explode_outer("tables").alias("_t")).join(bounded(ours), "_t", "left").groupBy("code").agg(F.bool_and(F.col("_t").isNull() | F.coalesce("_ours", F.lit(False))).alias("_in"))
    terms = compiler.terms_of(active.join(used.where("_in").select("code"), "code", "left_semi"))
    # of an equality its bars say nothing here; a bar's cell is a row of its own: its place is part of the instance
    judged = settled(terms)
    compared = judged.where("kind = '<=' AND NOT bar")
    bars = judged.where("bar").join(compared.select("code").distinct(), "code", "left_semi").withColumn("inst", F.concat_ws("/", "inst", F.lit("bar"), "r", "c", "z"))
    return compared.unionByName(bars).drop("bar")


def over_present(resolved: DataFrame, present: DataFrame) -> DataFrame:
    """RC18: rows (code, inst, kind, rhs, coef, key) over present cells (key) only: absent ones are 0 and drop out; coefficients of a cell add up."""
    kept = resolved.join(bounded(present.select("key").distinct()), "key", "left_semi")
    return kept.groupBy("code", "inst", "kind", "rhs", "key").agg(F.sum("coef").alias("coef")).where("abs(coef) > 1e-12")


def date_orders(resolved: DataFrame, metrics: DataFrame, early: str, late: str) -> DataFrame:
    """RC19: (key, day) of rows start <= end between two dates (code, inst, rhs, coef, concept, key): starts early, ends late. metrics: (concept, datatype)."""
    j = resolved.join(bounded(metrics.select("concept", "datatype")), "concept", "left")
    g = j.groupBy("code", "inst").agg(
        F.bool_and(F.coalesce(F.col("datatype") == "DATE", F.lit(False))).alias("dates"), F.count("*").alias("n"), F.max(F.when(F.col("coef") == 1, F.col("key"))).alias("start"), F.max(F.when(F.col("coef") == -1, F.col("key"))).alias("end")
    )
    pairs = g.where("dates AND n = 2 AND start IS NOT NULL AND end IS NOT NULL")
    both = pairs.select(F.explode(F.array(F.struct(F.col("start").alias("key"), F.lit(early).alias("day")), F.struct(F.col("end").alias("key"), F.lit(late).alias("day")))).alias("d"))
    return both.groupBy("d.key").agg(F.min("d.day").alias("day"))
