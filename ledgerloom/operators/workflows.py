"""Jobs that string operators together (CT7, CT10-CT12, DV8, GN6)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import cell_key, merge_aspects
from ..session import settled
from . import cube, derive, evaluate, generate, layout


@dataclass
class Report:
    """What a validation found: facts by dimensional verdict, rule verdicts, and the facts that were judged."""

    dimensional: DataFrame
    rules: DataFrame
    facts: DataFrame


def upload(facts: DataFrame) -> DataFrame:
    """CT7: an instance as (key, value, decimals, ...): typed dimensions merged with explicit ones, the first fact of a key kept, numbers only."""
    every = F.map_concat("dims", F.transform_values("typed", lambda _, v: F.concat(F.lit("typed:"), v)))
    k = facts.withColumn("key", cell_key(F.col("concept"), every)).withColumn("value", F.col("value_raw").try_cast("double")).where("value IS NOT NULL")
    return k.groupBy("key").agg(F.min(F.struct("fact_id", "value", "decimals")).alias("f"), F.count("*").alias("n_rows")).select("key", "f.value", "f.decimals", "n_rows")


def validate(facts: DataFrame, terms: DataFrame, cubes: DataFrame, defaults: dict[str, str]) -> Report:
    """CT10: dimensional admission, facts that no cube admits pruned, and the rules judged on the rest. facts: (fact_id, key, concept, dims, value, decimals)."""
    verdict = cube.admission(facts, cubes, defaults)
    kept = cube.prune(facts, verdict.where("verdict != 'valid'"), ["fact_id"])
    return Report(verdict.groupBy("verdict").agg(F.count("*").alias("n")), evaluate.additive_verdicts(terms, kept), kept)


def solve_job(values: DataFrame, terms: DataFrame, derivations: DataFrame, rounds: int = 6) -> tuple[DataFrame, list[int]]:
    """CT11: derive totals and judge again until no rule fails or nothing improves. values: (key, value, decimals)."""

    def repair(v: DataFrame) -> DataFrame:
        new = derive.derive_levels(v.select("key", "value"), derivations).select("key", "value")
        return new.join(v.select("key", "decimals"), "key", "left")

    return derive.until_clean(values, repair, lambda v: evaluate.additive_verdicts(terms, v).where(~F.col("ok")), rounds)


def greedy(terms: DataFrame, values: DataFrame, totals: DataFrame) -> DataFrame:
    """DV8: one derived cell for each equation (code, key, coef; sum coef * value = 0): its preferred total, else the cell that fewest equations
    touch; a total is derived by its own equation only. Derivation runs level by level, so order does not matter."""
    from .catalog import incidence

    own = totals.groupBy("key").agg(F.min("code").alias("owner"))
    t = terms.join(own, "key", "left").join(incidence(terms), "key")
    free = F.col("owner").isNull() | (F.col("owner") == F.col("code"))
    pick = t.where(free).groupBy("code").agg(F.min_by(F.struct("key", "coef"), F.struct((F.col("owner").isNull()).cast("int"), "incidence", "key")).alias("p"))
    once = pick.groupBy(F.col("p.key").alias("target")).agg(F.min("code").alias("code"), F.min_by("p.coef", "code").alias("target_coef"))
    d = terms.join(once, "code").where("key != target").select("target", F.col("key").alias("source"), "coef", "target_coef")
    return derive.derive_levels(values, d)


def module_selection(positions: DataFrame, module_tables: DataFrame, module: str) -> DataFrame:
    """GN6: all datapoints of a module's tables."""
    mine = module_tables.where(F.col("module") == module).select("tbl").distinct()
    return layout.datapoints(positions.join(mine, "tbl", "left_semi"))


def open_rows(positions: DataFrame, cubes: DataFrame, members: DataFrame, typed: DataFrame, defaults: dict[str, str], date: str = "2024-12-31") -> DataFrame:
    """GN7: (tbl, key, concept, dims, synthetic) of tables whose rows are open: one row for each column and layer. An open typed dimension takes a value of its element's type (typed: dim, type), an
    explicit one the first of its members (dim, ord, member) with which a cube of the facts' concept admits the cell; where none does, there is no row. cubes as `admission` wants them; tables that have closed rows are left alone."""
    rows = positions.where("axis = 'y'")
    closed = rows.where("open_dim IS NULL").select("tbl").distinct()
    opened = settled(rows.where("open_dim IS NOT NULL").join(closed, "tbl", "left_anti").select("tbl", F.col("open_dim").alias("dim")).distinct())
    kind = F.lower(F.substring_index("type", ":", -1))
    said = F.when(kind == "date", date).when(kind == "datetime", f"{date}T00:00:00").when(kind == "gyear", date[:4]).when(kind == "gyearmonth", date[:7]).when(kind == "boolean", "true").otherwise("1")
    fixed = opened.join(typed, "dim").select("tbl", "dim", F.lit(0).alias("ord"), said.alias("member"))
    choice = settled(fixed.unionByName(opened.join(typed, "dim", "left_anti").join(members.select("dim", "ord", "member"), "dim").select("tbl", "dim", "ord", "member")))
    cells = layout.datapoints(positions.where("axis != 'y'").join(opened.select("tbl").distinct(), "tbl", "left_semi")).select("tbl", F.col("key").alias("row_id"), "concept", "dims")
    # the candidates of a cell: every combination of its dimensions' members, the first by their order
    cells = cells.withColumns({"ords": F.array().cast("array<int>"), "open": F.create_map().cast("map<string,string>")})
    number = F.dense_rank().over(Window.partitionBy("tbl").orderBy("dim"))
    dims = settled(choice.withColumn("nth", number))
    most = dims.agg(F.max("nth")).first()[0] or 0
    of = opened.groupBy("tbl").agg(F.count("*").alias("wanted"))
    for k in range(1, most + 1):
        nth = dims.where(F.col("nth") == k).select("tbl", F.col("dim").alias("_d"), F.col("ord").alias("_o"), F.col("member").alias("_m"))
        some = cells.join(nth, "tbl", "left")
        more = F.map_concat("open", F.create_map("_d", "_m"))
        cells = some.withColumn("open", F.when(F.col("_d").isNotNull(), more).otherwise(F.col("open"))).withColumn("ords", F.concat("ords", F.array(F.coalesce("_o", F.lit(0)).cast("int")))).drop("_d", "_o", "_m")
    full = cells.join(of, "tbl").where(F.size("open") == F.col("wanted")).withColumn("dims", merge_aspects(F.col("dims"), F.col("open")))
    full = settled(full.withColumn("key", cell_key(F.col("concept"), F.col("dims"))).withColumn("fact_id", F.concat_ws("\u0001", "tbl", "key")).withColumn("row", F.concat_ws("\u0001", "tbl", "row_id")))
    first = cube.first_valid(full.select(F.col("row").alias("row_id"), F.col("ords").alias("ord"), "fact_id", "concept", "dims"), cubes, defaults)
    return full.join(first.select("fact_id"), "fact_id", "left_semi").select("tbl", "key", "concept", "dims", F.lit(True).alias("synthetic"))


def generate_valid(points: DataFrame, metrics: DataFrame, cubes: DataFrame, defaults: dict[str, str], derivations: DataFrame, forbidden: DataFrame, seed: str) -> DataFrame:
    """CT12: (key, value text) of a module: cells that a cube admits and no rule forbids get seeded values by datatype, and totals
    follow from their parts, so that additive rules hold by construction."""
    cells = cube.prune(cube.valid_cells(points, cubes, defaults), forbidden, ["key"]).dropDuplicates(["key"]).join(metrics.select("concept", "datatype"), "concept", "left")
    made = cells.withColumn("value", generate.value_of(F.coalesce("datatype", F.lit("STRING")), F.col("key"), seed))
    numbers = made.select("key", F.col("value").try_cast("double").alias("value")).where("value IS NOT NULL")
    present = derivations.join(made.select(F.col("key").alias("target")), "target", "left_semi")
    derived = derive.derive_levels(numbers, present).where("level > 0").select("key", F.col("value").alias("rule_value"))
    return generate.override(made, derived).select("key", "datatype", "value")
