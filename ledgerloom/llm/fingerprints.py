"""Threshold-scaled document sketches.

A document's fingerprint holds every 64-bit hash of its 5-word shingles below a fixed fraction of the hash range, and the
smallest hash, so that no text with words is without one. As the threshold is the same for all documents, fingerprints of parts merge by union (`merged`), and
the share of a small document's hashes that a large one holds estimates containment, however unequal the two are.

`likeness` is the estimated containment of the smaller in the larger set (0 to 1).

`with_next` puts each document beside the next one by descending key: the rows are dealt into ranges of the key, each
range sorted once with the one row of the range below that its last row needs; the last range also gets the greatest key.
Text crosses the network once, and fingerprints are made after that: they never cross it.

DataFrame operations only. Edge cases: null text counts as empty; a text without words has an empty fingerprint, whose
likeness to an empty one is 1 and to any other 0; a text of fewer than five words is one shingle; a very long text is one array of its hashes in one task; null keys come after all
others; repeated keys are ordered by text, and repeated rows follow each other; a single row is next to itself; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import one_spaced, whole

SHINGLE = 5
#: 1 / FRACTION of the hash range is kept.
FRACTION = 8
#: Rows that one range of keys is planned for, ranges at most, and sampled keys for each of them.
ROWS_A_RANGE, MOST_RANGES, KEYS_A_RANGE = 1_000, 65_536, 6


def fingerprint(text: Column, shingle: int = SHINGLE, fraction: int = FRACTION) -> Column:
    """Sorted array of the hashes kept of a text."""
    words = F.filter(F.split(F.lower(one_spaced(text)), " "), lambda w: w != "")
    below = -(2**63) + 2**64 // fraction

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - shingle, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(shingle)]))

    def kept(h: Column) -> Column:
        return F.array_sort(F.array_distinct(F.concat(F.filter(h, lambda x: x < below), F.array(F.array_min(h)))))

    # transform over an array of one binds a value once, where a plain reference would evaluate it again in each step
    bound = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    none = F.array().cast("array<bigint>")
    return bound(words, lambda w: F.when(F.size(w) == 0, none).otherwise(bound(hashes(w), kept)))


def merged(parts: Column, fraction: int = FRACTION) -> Column:
    """The fingerprint of the union of the shingle sets whose fingerprints are in an array (of the same fraction)."""
    every = F.array_distinct(F.flatten(parts))
    return F.array_sort(F.array_distinct(F.concat(F.filter(every, lambda x: x < -(2**63) + 2**64 // fraction), F.when(F.size(every) > 0, F.array(F.array_min(every))).otherwise(F.array().cast("array<bigint>")))))


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    smaller = F.least(F.size(a), F.size(b))
    both_empty = (F.size(a) == 0) & (F.size(b) == 0)
    return F.when(both_empty, 1.0).when(smaller == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / smaller)


def _ranges(keys: DataFrame) -> tuple[list[list[int]], int | None]:
    """Bounds of the key ranges, in groups, and the greatest key. Bounds only deal out rows: they come from a sample."""
    rows, top = keys.agg(F.count("k"), F.max("k")).first()
    n = min(MOST_RANGES, rows // ROWS_A_RANGE + 1)
    if n == 1:
        return [], top
    share = n * KEYS_A_RANGE / rows
    sample = sorted(r[0] for r in (keys.sample(share, 7) if share < 0.7 else keys).where("k IS NOT NULL").distinct().limit(2 * n * KEYS_A_RANGE).collect())
    bounds = sorted({sample[len(sample) * i // n] for i in range(1, n)} - {top}) if sample else []
    each = max(1, int(len(bounds) ** 0.5))
    return [bounds[i : i + each] for i in range(0, len(bounds), each)], top


def _range_of(key: Column, groups: list[list[int]]) -> Column:
    """Number of bounds below the key; null keys are in range 0."""
    if not groups:
        return F.lit(0)
    each = len(groups[0])
    firsts = F.lit([g[0] for g in groups])
    inner = F.array(*[F.lit(g) for g in groups])
    below = lambda a: F.size(F.filter(a, lambda b: b < key))
    block = F.greatest(below(firsts) - 1, F.lit(0))
    return F.when(key.isNull(), 0).otherwise(block * each + below(F.get(inner, block)))


def with_next(rows: DataFrame, key: str, columns: list[str], add: dict[str, Column] | None = None) -> DataFrame:
    """rows with next_<column> of the row that follows by descending key; the first row follows the last.

    add: columns that are computed where a row has arrived, so that they are not shuffled."""
    groups, top = _ranges(rows.select(F.col(key).cast("long").alias("k")))
    k = F.col(key)
    at = _range_of(k, groups)
    bounds = [b for g in groups for b in g]
    places = [
        F.struct(at.alias("range"), F.lit(0).alias("guest")),
        # a bound is the greatest key of its range: the last row of the range above looks at it
        F.when(k.isin(bounds), F.struct((at + 1).alias("range"), F.lit(1).alias("guest"))),
        F.when(k.eqNullSafe(F.lit(top)), F.struct(F.lit(0).alias("range"), F.lit(2).alias("guest"))),
    ]
    guest = F.array_compact(F.array(*places))
    dealt = rows.withColumn("_g", F.explode(guest)).select(*rows.columns, F.col("_g.range").alias("_range"), F.col("_g.guest").alias("_guest"))
    order = Window.partitionBy("_range").orderBy("_guest", F.col(key).desc_nulls_last(), *[F.col(c) for c in columns if c in rows.columns])
    dealt = dealt.repartition("_range").withColumns(add or {})
    dealt = dealt.select(*rows.columns, *(add or {}), "_guest", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return dealt.where("_guest = 0").drop("_guest")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    d = with_next(docs, "doc_id", ["text", "fp"], {"fp": fingerprint(F.col("text"))})
    n = F.length("text")
    cut = F.expr("CAST(floor(length(text) / 3) AS INT)")
    d = d.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - CAST(floor(length(text) / 3) AS INT))"), F.left(F.coalesce("next_text", F.lit("")), cut)))
    d = d.select("doc_id", "n_chars", "fp", "next_fp", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("efp"))
    return d.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
