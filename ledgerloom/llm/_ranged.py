"""Running and whole aggregates of groups of any size: what windows give, with a group's rows spread over many tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import scratch

#: Aggregate, and what puts two partial results together.
KINDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "xor": (F.bit_xor, lambda a, b: F.coalesce(a, F.lit(0)).bitwiseXOR(F.coalesce(b, F.lit(0)))),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
}


def over_ranges(rows: DataFrame, by: list[str], order: list[str | Column], running: dict[str, tuple[Column, str]] | None = None, total: dict[str, tuple[Column, str]] | None = None) -> DataFrame:
    """rows with, for each entry (name: value, kind) of running, its aggregate over the group's rows up to this one in this order, which has to be total but for rows
    that are alike; and for each entry of total over all of the group. Groups are rows of equal, non-null `by`.

    Rows are dealt into ranges of (by, order), so a large group has many. Windows work within a range; what they lack is added from the sums of the other ranges of the
    group. Only the first and the last group of a range can have others, so there are at most two such sums for each range: they are broadcast."""
    running, total = running or {}, total or {}
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    values = {f"_v_{name}": value for name, (value, _) in [*running.items(), *total.items()]}
    dealt = scratch(rows.withColumns(values).repartitionByRange(parts, *by, *keys).withColumn("_range", F.spark_partition_id()))
    outer = dealt.groupBy("_range").agg(F.min(F.struct(*by)).alias("_low"), F.max(F.struct(*by)).alias("_high"))
    pieces = dealt.join(F.broadcast(outer), "_range").where((F.struct(*by) == F.col("_low")) | (F.struct(*by) == F.col("_high")))
    pieces = pieces.groupBy("_range", *by).agg(*[KINDS[kind][0](f"_v_{name}").alias(f"_p_{name}") for name, (_, kind) in [*running.items(), *total.items()]])
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        F.col("_range").alias("_range_of"), *[F.col(c).alias(f"_by_{c}") for c in by], F.count("*").over(group).alias("_pieces"),
        *[KINDS[kind][0](f"_p_{name}").over(earlier).alias(f"_o_{name}") for name, (_, kind) in running.items()], *[KINDS[kind][0](f"_p_{name}").over(group).alias(f"_o_{name}") for name, (_, kind) in total.items()],
    )
    others = F.broadcast(scratch(pieces.where("_pieces > 1")))
    inside = Window.partitionBy("_range", *by)
    so_far = inside.orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    seen = dealt.withColumns({f"_w_{name}": KINDS[kind][0](f"_v_{name}").over(so_far) for name, (_, kind) in running.items()})
    seen = seen.withColumns({f"_w_{name}": KINDS[kind][0](f"_v_{name}").over(inside) for name, (_, kind) in total.items()})
    on = reduce(Column.__and__, [F.col(c) == F.col(f"_by_{c}") for c in by], F.col("_range") == F.col("_range_of"))
    found = seen.join(others, on, "left")
    both = {name: KINDS[kind][1](F.col(f"_w_{name}"), F.col(f"_o_{name}")) for name, (_, kind) in running.items()}
    both |= {name: F.when(F.col("_pieces").isNull(), F.col(f"_w_{name}")).otherwise(F.col(f"_o_{name}")) for name in total}
    return found.select(*rows.columns, *[value.alias(name) for name, value in both.items()])
