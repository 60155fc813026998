"""What the text operators share: scratch tables, word handling, and rows through Arrow batches with their id columns untouched."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import forget, lookup, settled, shared_dir

__all__ = ["WS", "forget", "in_batches", "lookup", "one_spaced", "scratch", "shared_dir", "ship", "smallest", "tasks_for", "whole", "word_count"]

#: One white-space character as every contract here defines it.
WS = r"[\x20\x09-\x0D]"
#: Matches only what changes when runs of white space become one space.
_WS_CHANGES = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"
#: A table written to the shared folder and read back.
scratch = settled


def ship(module: str) -> None:
    """Send the module's functions to Python workers by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def in_batches(rows: DataFrame, make: Callable[[], Callable[[list], tuple[list, list]]], text: str, schema: str, keep: list[str]) -> DataFrame:
    """For each row of rows its `keep` columns as they are, and what a worker's function makes of its text.

    make() is called once for each task and gives a function from a batch's texts (str or None) to (row, values): for each row of
    the result the place of its text in the batch, and a list for each column of schema. Kept columns never leave Arrow, so ids of any size and null ids stay what they are."""
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            at, columns = work(batch.column(len(keep)).to_pylist())
            taken = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*taken, *columns], names=[*keep, *names])

    names = [part.split()[0] for part in schema.split(", ")]
    return rows.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{kept}, {schema}")


def whole(text: Column | str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def one_spaced(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, _WS_CHANGES, " ")


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space."""
    t = F.trim(one_spaced(text))
    return F.when(t == "", F.lit(0).cast("long")).otherwise((F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long"))


def smallest(ids: DataFrame, most: int, seed: int, key: str = "doc_id") -> DataFrame:
    """At most `most` rows of ids: those with the smallest seeded hashes of their key, the same on each run and in each partitioning. Only
    hashes that can be among them (twice as many are expected below the cut) are sorted."""
    share = min(1.0, 2 * most / max(ids.count(), 1))
    hashed = ids.withColumn("_h", F.xxhash64(F.lit(seed), key))
    if share < 1:
        hashed = hashed.where(F.col("_h") < int(-(2**63) + share * 2**64))
    return hashed.orderBy("_h", key).limit(most).drop("_h")


def tasks_for(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for so many rows, `each` in one, at least the session's own number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))
