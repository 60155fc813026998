"""Secret scan with corpus-wide ownership frequency.

Three kinds of base spans (assign, access, hex) are found by pattern. Besides, every long token of letters and digits with many different
characters is a candidate, such as a bare key that no `token =` announces. The values of all candidates are hashed and counted over the corpus by distinct
owners and distinct repositories, and ownership decides: a value that many owners carry is a copied example, one that belongs to a single owner
looks live, however many copies of its text that owner has. Repositories decide only where no owner is known: few look live. Base spans stay
whatever their counts; of the other candidates, the live-looking ones are added as spans of kind `live`. The counts come out with each finding.

DataFrame operations only. Offsets come from the lengths of what split() leaves between matches, in code points, by a running sum over a
text's matches, so a text costs in proportion to its matches. Counting is by partial aggregates over distinct (value, owner) and (value, repository)
pairs, so that an example with a third of all rows does not meet in one task. Values are hashed when they are found: no table that is written
holds one; `findings` gives spans, from which a caller with the texts can cut them out.

Edge cases: null text counts as empty; empty text has no spans; repeated rows are scanned alike and count once as a repository
when they share the id; a null owner or repository counts as no owner; findings of a row are sorted by start and kind, which no two share; a very long text
is scanned once for each pattern, and its matches are rows of their own; null and repeated ids come out as they are; kept columns may have any name but `findings`; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import lookup, scratch, whole

ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}+"  # the same spans as all runs of [0-9a-f] of which those under 24 are dropped
BLOB = r"[A-Za-z0-9+/_-]{16,}+={0,2}"
#: Different characters that a bare candidate has at least, besides a letter and a digit.
DISTINCT = 6
#: A value of at most so many owners looks live; one without a known owner if it has at most so many repositories.
LIVE_OWNERS, LIVE_REPOSITORIES = 1, 3
KINDS = ("assign", "access", "hex", "live")


def _matches(text: Column, pattern: str, kind: int, rough: str, value: Callable[[Column], Column], passes: Callable[[Column], Column]) -> Column:
    """Array of (kind, gap, length, hash, ok) of all matches of a pattern, with the code points between a match and the one before."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)  # one more than matches, as no match is empty
    each = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("match"))
    told = F.transform(
        each, lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("length"), F.xxhash64(value(x["match"])).alias("hash"), passes(x["match"]).alias("ok"))
    )
    return F.when(text.rlike(rough), told).otherwise(F.array().cast("array<struct<kind:int,gap:int,length:int,hash:bigint,ok:boolean>>"))


def _assigned(match: Column) -> Column:
    return F.regexp_extract(match, f"^{ASSIGN}$", 1)


def _mixed(match: Column) -> Column:
    return match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(match, ""))) >= DISTINCT)


def _all_matches(text: Column) -> Column:
    itself = lambda m: m
    return F.concat(
        _matches(text, ASSIGN, 0, r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", _assigned, lambda m: F.length(_assigned(m)) >= 6),
        _matches(text, ACCESS, 1, "AKIA", itself, lambda m: F.length(m) >= 20),
        _matches(text, HEX, 2, HEX, itself, lambda m: F.lit(True)),
        _matches(text, BLOB, 3, BLOB, itself, _mixed),
    )


def candidates(rows: DataFrame) -> DataFrame:
    """(row, owner, repo, kind, start, end, hash) of each candidate. rows: (row, owner, repo, matches)."""
    each = rows.where(F.size("matches") > 0).select("row", "owner", "repo", F.posexplode("matches").alias("at", "m")).select("row", "owner", "repo", "at", "m.*")
    # a row's matches come together as the row itself did; there are no more of them than its text holds
    so_far = F.sum(F.col("gap") + F.col("length")).over(Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    placed = each.withColumn("end", so_far).withColumn("start", F.col("end") - F.col("length"))
    return placed.where("ok").select("row", "owner", "repo", "kind", "start", "end", "hash")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories, uses) of each candidate value: counted as distinct pairs, partially aggregated before each shuffle."""
    uses = found.groupBy("hash").agg(F.count("*").alias("uses"))
    owners = found.where("owner IS NOT NULL").select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    repos = found.where("repo IS NOT NULL").select("hash", "repo").distinct().groupBy("hash").agg(F.count("*").alias("repositories"))
    return uses.join(owners, "hash", "left").join(repos, "hash", "left").fillna(0, ["owners", "repositories"])


def scan(docs: DataFrame, text: str = "text", owner: str = "source", repo: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), live_owners: int = LIVE_OWNERS, live_repositories: int = LIVE_REPOSITORIES) -> DataFrame:
    """For each row: the `keep` columns and findings, an array of (start, kind_no, end, owners, repositories, live) by start and kind."""
    if "findings" in keep:
        raise ValueError("a kept column is called findings")
    kept = [F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo"), _all_matches(whole(text)).alias("matches"))
    rows = scratch(rows.withColumn("row", F.monotonically_increasing_id()))
    each = scratch(candidates(rows))
    counted = lookup(each.select("row", "kind", "start", "end", "hash"), scratch(ownership(each)), "hash", "uses", each.count())
    live = F.when(F.col("owners") > 0, F.col("owners") <= live_owners).otherwise(F.col("repositories") <= live_repositories)
    finding = F.struct("start", F.col("kind").alias("kind_no"), "end", "owners", "repositories", live.alias("live"))
    findings = counted.groupBy("row").agg(F.sort_array(F.collect_list(finding)).alias("findings"))
    base = F.filter("findings", lambda x: x["kind_no"] < 3)
    apart = lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    findings = findings.select("row", F.filter("findings", lambda x: (x["kind_no"] < 3) | (x["live"] & apart(x))).alias("findings"))
    empty = F.array().cast(findings.schema["findings"].dataType)
    out = rows.drop("owner", "repo", "matches").join(findings.hint("merge"), "row", "left").withColumn("findings", F.coalesce("findings", empty))
    return out.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "findings")


def _said(findings: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", F.element_at(names, x["kind_no"] + 1), x["start"], x["end"])), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    base = F.filter("findings", lambda x: x["kind_no"] < 3)
    of_kind = lambda i: lambda x: x["kind_no"] == i
    count = lambda test: F.size(F.filter("findings", test)).cast("long")
    return found.select(
        "doc_id",
        *[count(of_kind(i)).alias(f"n_{kind}") for i, kind in enumerate(KINDS)],
        F.sha2(_said(base).cast("binary"), 256).alias("base_sha256"),
        _said(F.col("findings")).alias("spans"),
        count(lambda x: x["live"]).alias("n_live_looking"),
        count(lambda x: ~x["live"]).alias("n_copied"),
    )
