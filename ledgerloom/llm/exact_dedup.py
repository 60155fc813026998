"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch of documents is reduced to digests, which are dealt by the index's own buckets and
anti-joined to it by a sort-merge join: only the batch moves, the index is read bucket by bucket where it lies. What is new is appended, a sorted file for
each bucket; `compact` merges the files of many batches to one for each bucket again. DataFrame operations only.

Edge cases: null text counts as empty; empty texts are equal to each other; a very long text is hashed where it is read and never moves for its digest; rows
that repeat a doc_id with the same text are all kept rows of their group and are collapsed by `drop_copies`; rows that share a doc_id and not their text are told
apart; a null doc_id loses to any other id, and a group with null ids only has a null keep_id and keeps its rows (`drop_copies`: one of them); extra
columns are carried through, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import forget, lookup, one_spaced, scratch, whole

#: Digests that one bucket of a new index is planned for, and buckets at least.
ROWS_A_BUCKET, LEAST_BUCKETS = 2_000_000, 8
#: Files of a bucket from which an append merges them.
MOST_FILES = 16


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with white space made even, as lowercase hex."""
    return F.sha2(one_spaced(text).cast("binary"), 256)


class DigestIndex:
    """A table (digest, keep_id), bucketed and sorted by digest. Give a name to keep it across sessions' batches, and the documents that it
    is to hold in the end, which set its number of buckets when it is made."""

    def __init__(self, spark: SparkSession, name: str | None = None, expected: int = 0, buckets: int | None = None):
        self.spark, self.name = spark, name or f"digest_index_{uuid.uuid4().hex}"
        self._recover()
        if not spark.catalog.tableExists(self.name):
            self.buckets = buckets or max(LEAST_BUCKETS, -(-expected // ROWS_A_BUCKET))
            self._write(spark.createDataFrame([], "digest string, keep_id long"), self.name, "errorifexists")
        else:
            said = {r[0].strip(): r[1] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {self.name}").collect()}
            self.buckets = int(said["Num Buckets"])

    def _write(self, rows: DataFrame, name: str, mode: str) -> None:
        rows.write.mode(mode).format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def dealt(self, groups: DataFrame) -> DataFrame:
        """Rows with a digest, dealt as the index's buckets are."""
        return groups.repartition(self.buckets, "digest")

    def absent(self, groups: DataFrame) -> DataFrame:
        """The digests of groups that the index does not hold. Neither side of the join is shuffled again."""
        return self.dealt(groups).join(self.table().hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Add (digest, keep_id) rows; a batch goes in once, as the anti-join leaves nothing of a repeated one."""
        new = scratch(self.absent(groups.select("digest", "keep_id")))  # read before it is written to
        self._write(self.dealt(new), self.name, "append")
        forget(new)
        if len(self.table().inputFiles()) > MOST_FILES * self.buckets:
            self.compact()

    def compact(self) -> None:
        """One sorted file for each bucket. The merged table is written whole before the index's name passes to it; a driver that is lost at any step leaves
        an index, which the next one to open it puts in order."""
        merged, before = self._beside()
        # a new column, as rows of a table that lies in these buckets would not be dealt, only its files
        rows = self.table().select(F.concat("digest", F.lit("")).alias("digest"), "keep_id")
        self._write(self.dealt(rows), merged, "errorifexists")
        self.spark.sql(f"ALTER TABLE {self.name} RENAME TO {before}")
        self.spark.sql(f"ALTER TABLE {merged} RENAME TO {self.name}")
        self.spark.sql(f"DROP TABLE {before}")

    def _beside(self) -> tuple[str, str]:
        """The names of the merged table that is to come, and of the one that it takes the place of."""
        return f"{self.name}_merged", f"{self.name}_before"

    def _recover(self) -> None:
        """What a lost compaction left: without an index of this name the one before it is the index; a merged table may be half written."""
        merged, before = self._beside()
        there = self.spark.catalog.tableExists
        if there(before) and not there(self.name):
            self.spark.sql(f"ALTER TABLE {before} RENAME TO {self.name}")
        for name in (merged, before):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def dedup(docs: DataFrame, index: DigestIndex | None = None, text: str = "text", key: str = "doc_id", also: list[str] | None = None, batches: int = 1) -> DataFrame:
    """For each row of docs: doc_id, digest, keep_id (of the row that stays, from this call or an earlier one),
    group_size (rows of this call with the text), kept, and the columns `also`. The index then holds the texts. Without an index, one is made
    for this call and dropped after it.

    batches: into so many ranges of ascending ids docs are dealt; each is anti-joined to what the index holds of those before and appended."""
    spark, also = docs.sparkSession, also or []
    digests = scratch(docs.select(F.col(key).cast("long").alias("doc_id"), *also, text_digest(whole(text)).alias("digest")))
    rows = digests.count()
    lasting = index is not None
    index = index or DigestIndex(spark, expected=rows)
    groups = scratch(digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    if batches == 1:
        index.append(groups)
    else:
        cuts = digests.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).first()[0] or []
        at = sum(((F.col("doc_id") > c).cast("int") for c in cuts), F.lit(0))
        part = F.when(F.col("doc_id").isNull(), batches - 1).otherwise(at)  # null ids lose to any other: they come last
        for k in range(batches):
            index.append(digests.where(part == k).groupBy("digest").agg(F.min("doc_id").alias("keep_id")))
    verdicts = scratch(index.dealt(groups.drop("keep_id")).join(index.table().hint("merge"), "digest", "left"))
    if not lasting:
        index.drop()
    out = lookup(digests, verdicts, "digest", "group_size", rows)
    return out.select("doc_id", *also, "digest", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def drop_copies(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """The rows of docs that stay, with their own columns; once where rows repeat id and text.

    Decisions come back to the rows by id and a hash of the text, so rows that share an id are told apart; by a shuffled join at every size: what a
    broadcast would save on small inputs, large ones could not keep."""
    mine = "exact_text_hash"
    while mine in docs.columns:
        mine += "_"
    even = F.xxhash64(one_spaced(whole("text")))
    hashed = docs.withColumn(mine, even)
    stay = scratch(dedup(hashed, index, also=[mine]).where("kept").groupBy("doc_id", mine).agg(F.count("*").alias("n")))
    some, none = stay.where("doc_id IS NOT NULL"), stay.where("doc_id IS NULL")
    kept = hashed.join(some.select("doc_id", mine).hint("merge"), ["doc_id", mine], "left_semi")
    if some.where("n > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", mine])
    if none.limit(1).count():  # groups of null ids only: one row of each
        kept = kept.unionByName(hashed.where("doc_id IS NULL").join(none.select(mine), mine, "left_semi").dropDuplicates([mine]))
    return kept.select(*docs.columns)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs, batches=2).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
