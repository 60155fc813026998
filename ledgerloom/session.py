"""Sessions, and tables that are settled between the rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes as JSON text, of a catalogue (rules, cubes, members) that may be broadcast.
MOST_BROADCAST, MOST_BYTES = 200_000, 64 << 20
#: Rows that a task of a table that `dealt` deals reads, on average.
ROWS_A_TASK = 250_000
#: The same where Python parses or solves each row.
TEXTS_A_TASK = 5_000
#: A group holding at least this share of all rows is hot; there are at most 1 / HOT_SHARE such groups.
HOT_SHARE = 0.001


def session(cores: int | str = "*", partitions: int | None = None) -> SparkSession:
    """A local session with the settings that results rely on."""
    b = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.sql.adaptive.enabled", "true")
    return (b.config("spark.sql.shuffle.partitions", str(partitions)) if partitions else b).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may go without, and gets one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined():
            if spark.sparkContext.master.partition("[")[0] != "local":
                raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get()
    return where.rstrip("/")


def _path(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def settled(df: DataFrame) -> DataFrame:
    """The table written to the folder that all executors share and read back: lineage is cut, lost executors cost nothing, df is computed
    once. The files go when `forget` is told so, and when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _path(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete the files of settled tables that nothing reads any more."""
    for table in tables:
        path = None if table is None else table.__dict__.pop("_settled_at", None)
        if path:
            files, at = _path(table.sparkSession, path)
            files.delete(at, True)


def bounded(catalogue: DataFrame, most: int = MOST_BROADCAST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A catalogue table marked for broadcast if it has at most so many rows and bytes; otherwise as it is, for a shuffled join."""
    rows, size = catalogue.limit(most + 1).agg(F.count("*"), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return F.broadcast(catalogue) if rows <= most and size <= most_bytes else catalogue


def dealt(rows: DataFrame, by: str, n: int | None = None, each: int = ROWS_A_TASK) -> DataFrame:
    """rows dealt by a column into as many partitions as their number (n, or counted: pass a table) asks for, `each` to a task. Narrow rows compress so well that partitions
    that are packed by their bytes may hold millions of them, with all that a task then sorts or aggregates at once."""
    return rows.repartition((rows.count() if n is None else n) // each + 1, by)


def lookup(left: DataFrame, right: DataFrame, key: str, count: str, total: int, how: str = "left") -> DataFrame:
    """left join right on key, where right has a row for each key and the number of left rows that carry it.

    Keys of at least HOT_SHARE of all rows (and 1,000), of which there can be 1 / HOT_SHARE at most, are broadcast; no other key
    holds more rows than that, so the shuffled join is even. left is read twice and right three times: pass tables, not plans."""
    floor = max(1000, int(total * HOT_SHARE))
    hot = F.broadcast(right.where(F.col(count) >= floor))
    if total < floor or right.where(F.col(count) >= floor).limit(1).count() == 0:
        return left.join(right.hint("merge"), key, how)
    rest = left.join(hot.select(key), key, "left_anti").join(right.where(F.col(count) < floor).hint("merge"), key, how)
    return left.join(hot, key).select(*rest.columns).unionByName(rest)


def with_group(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of their group (a row for each of groups, keyed by `by`, nulls too). The rows' side of the join may be split where a group is large."""
    on = [F.col(f"_r.{c}").eqNullSafe(F.col(f"_g.{c}")) for c in by]
    more = [c for c in groups.columns if c not in by]
    return rows.alias("_r").join(groups.alias("_g"), on).select(*[F.col(f"_r.{c}").alias(c) for c in rows.columns], *[F.col(f"_g.{c}").alias(c) for c in more])


def numbered(rows: DataFrame, by: list[str], order: list[Column | str], name: str = "place") -> DataFrame:
    """rows with their place (from 1) within `by` in this order, which has to be total. A group may be of any size: rows are dealt into ranges
    of (by, order), numbered within each range, and ranges of the same group are added up."""
    spark = rows.sparkSession
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    from pyspark.sql import Window

    dealt = settled(rows.repartitionByRange(n, *by, *keys).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    inside = dealt.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*keys)))
    on = [F.col(f"_i.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in [*by, "_range"]]
    joined = inside.alias("_i").join(before.alias("_b"), on)
    return joined.select(*[F.col(f"_i.{c}").alias(c) for c in rows.columns], (F.col("_b._before") + F.col("_i._in")).alias(name))


def summed_before(rows: DataFrame, by: str, order: list[str], amount: str, name: str = "before") -> DataFrame:
    """rows with the sum of the amounts that come before theirs within `by` in this order, which has to be total. A group may be of any size: rows are dealt into ranges
    of (by, order) by their number, summed within each range, and ranges of the same group are added up."""
    from pyspark.sql import Window

    rows = settled(rows)
    dealt = settled(rows.repartitionByRange(rows.count() // ROWS_A_TASK + 1, by, *order).withColumn("_range", F.spark_partition_id()))
    forget(rows)
    sums = dealt.groupBy(by, "_range").agg(F.sum(amount).alias("_n"))
    earlier = sums.select(by, "_range", F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    inside = dealt.withColumn("_in", F.coalesce(F.sum(amount).over(Window.partitionBy(by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return inside.join(F.broadcast(earlier) if earlier.count() <= MOST_BROADCAST else earlier, [by, "_range"]).withColumn(name, F.col("_before") + F.col("_in")).drop("_before", "_in", "_range")
