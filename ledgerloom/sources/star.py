"""Facts from the star-schema tables (SRC3, §7.4 of the survey): the views that queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(REG, SEG, RFL, LST, YR, qty, ext): sums of lines by their dimensions, exact decimals."""
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customer, nation, region = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    geo = customer.join(nation.join(region, nation.n_regionkey == region.r_regionkey), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("r_name").alias("REG"), F.col("c_mktsegment").alias("SEG"))
    placed = orders.select("o_orderkey", "o_custkey").join(geo, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "REG", "SEG")
    # lines are summed up by order first: the join then moves a row for each order and not for each line
    per = line.groupBy("l_orderkey", F.col("l_returnflag").alias("RFL"), F.col("l_linestatus").alias("LST"), F.year("l_shipdate").alias("YR")).agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("e")
    )
    return per.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("REG", "SEG", "RFL", "LST", "YR").agg(F.sum("q").cast("decimal(28,2)").alias("qty"), F.sum("e").cast("decimal(28,2)").alias("ext"))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(concept, dims, value): leaves unpivoted to QTY and EXT facts."""
    dims = F.create_map(*[x for d in ("REG", "SEG", "RFL", "LST") for x in (F.lit(d), F.col(d))], F.lit("YR"), F.col("YR").cast("string"))
    both = F.explode(F.array(F.struct(F.lit("QTY").alias("concept"), F.col("qty").alias("value")), F.struct(F.lit("EXT").alias("concept"), F.col("ext").alias("value"))))
    return leaf(spark, sf_dir).select(dims.alias("dims"), both.alias("f")).select("f.concept", "dims", F.col("f.value").cast("double").alias("value"))


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """SRC3, SL8: the first row of each key by a total order, with the number of rows that the key has. One aggregate, no window sort."""
    rest = [c for c in rows.columns if c not in key]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("f")
    return rows.groupBy(*key).agg(first, F.count("*").alias("n_rows")).select(*key, *[F.col(f"f.{c}").alias(c) for c in rest], "n_rows")


def numeric(rows: DataFrame, column: str) -> DataFrame:
    """SRC3: rows whose text is a number, with value_num; a byte order mark does not count."""
    return rows.withColumn("value_num", F.regexp_replace(F.trim(F.col(column)), "^﻿", "").try_cast("double")).where("value_num IS NOT NULL")
