"""URL filter: explicit rules, and for urls without one the trust and distrust that hosts get through the link graph.

Hosts are nodes; an edge holds the links from pages of one host to absolute urls of another. Trust is a personalised PageRank
that restarts at the hosts of allowed pages and follows links; distrust restarts at the hosts of blocked pages and follows links backwards:
who links to blocked hosts is suspect. The rank of hosts without an edge onward restarts at the seeds, so trust and distrust both add up to 1 and can be compared. Both are
iterated in DataFrames until no host's rank still moves by more than a small part of itself, however far
from the seeds it is, and each host is blocked if its distrust exceeds its trust by a factor. A host without either is allowed.

Free style; DataFrame operations throughout, so that hosts, edges and ranks stay distributed. Links are reduced to host pairs with
counts before any join, so a host with a third of all pages is a row like any other; pages get their host's verdict by a
join that broadcasts the few hot hosts and shuffles the others.

Edge cases: a null url or one without `://` has an empty host and path, fits no rule and is allowed; null or empty html has no links;
links of a host to itself are no edges; repeated rows count as pages of their own; very long html is read once for its links, which are counted by host pair before they move;
ties of two rules cannot occur, as the longest fits and equal ones are the same rule, and equal trust and distrust allow; no seeds or no links leave the ranks at the seeds; an
empty table gives an empty result; null ids come out as they are; extra columns are left out.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import forget, lookup, scratch, whole

#: (verdict, host/path): fixed by the contract of the query.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
DAMPING = 0.85
#: The rank that any host is still to get, as a part of what it has, when the iteration ends.
ENOUGH = 1e-4
#: A host is blocked if its distrust is more than so many times its trust.
FACTOR = 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Links with a host: href="scheme://host..." or href="//host...".
_LINK = r"""(?i)href\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(whole(url), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(whole(url), _URL, 2)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(rule, rule_verdict, rule_host, rule_path) from (verdict, 'host/path') pairs."""
    rows = [(text, verdict, text.partition("/")[0], f"/{text.partition('/')[2]}") for verdict, text in rules]
    return spark.createDataFrame(rows, "rule string, rule_verdict string, rule_host string, rule_path string")


def match_rules(pages: DataFrame, rules: DataFrame, most_broadcast: int = 100_000) -> DataFrame:
    """pages (with host, path) and the longest rule that fits, its verdict; null where none does.

    A rule fits a host that ends in the rule's labels: pages are joined on each suffix of their host."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    if rules.count() <= most_broadcast:
        # one row for each rule host: rules are few, so pages need no shuffle and no row of theirs is repeated
        by_host = rules.groupBy("rule_host").agg(F.collect_list(F.struct(F.length("rule").alias("length"), "rule", "rule_verdict", "rule_path")).alias("rs"))
        table = by_host.agg(F.map_from_entries(F.collect_list(F.struct("rule_host", "rs"))).alias("_rules"))
        fits = F.filter(F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at("_rules", s), F.array().cast(by_host.schema["rs"].dataType)))), lambda r: F.col("path").startswith(r["rule_path"]))
        best = F.array_max(fits)
        return pages.withColumn("_rules", table.scalar()).withColumn("_best", best).withColumn("rule", F.col("_best.rule")).withColumn("rule_verdict", F.col("_best.rule_verdict")).drop("_best", "_rules")
    # many rules: a page is joined on each host suffix and each path prefix of a length that rules have, so that a key holds one rule
    keyed = scratch(pages.withColumn("_row", F.monotonically_increasing_id()))
    lengths = rules.agg(F.array_sort(F.collect_set(F.length("rule_path")))).first()[0]
    tried = keyed.select("_row", "path", F.explode(suffixes).alias("rule_host")).join(rules.select("rule_host").distinct(), "rule_host", "left_semi")
    prefixes = F.filter(F.transform(F.lit(lengths), lambda n: F.substring("path", F.lit(1), n)), lambda p: F.length(p) > 0)
    tried = tried.select("_row", "rule_host", F.explode(F.array_distinct(prefixes)).alias("rule_path")).join(rules, ["rule_host", "rule_path"])
    best = tried.groupBy("_row").agg(F.max(F.struct(F.length("rule").alias("length"), "rule", "rule_verdict")).alias("_best"))
    return keyed.join(best, "_row", "left").withColumn("rule", F.col("_best.rule")).withColumn("rule_verdict", F.col("_best.rule_verdict")).drop("_best", "_row")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts."""
    links = pages.where(F.col("html").rlike(_LINK)).select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("link"))
    target = F.translate(F.regexp_extract("link", r"//([^/?#]*)", 1), _UPPER, _LOWER)
    return links.select("src", target.alias("dst")).where("src != dst AND src != '' AND dst != ''").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int | None = None, enough: float = ENOUGH) -> DataFrame:
    """(host, rank), ranks adding up to 1: PageRank that restarts at seeds (host, weight; weights sum up to 1) and follows edges (src, dst, links).

    The rank that is still moving is kept apart from what has been settled, so that a round touches only hosts that it reaches. What moves
    at a host without edges onward goes back to the seeds. A host that a round reaches first has moved by all of its rank, so the rounds go on to the farthest host; after
    that the moving mass shrinks by the damping. rounds, where given, ends the iteration earlier."""
    flow = edges.join(edges.groupBy("src").agg(F.sum("links").alias("out")), "src").select("src", "dst", (F.col("links") / F.col("out")).alias("share"))
    flow = scratch(flow)
    sources = scratch(flow.select(F.col("src").alias("host")).distinct())
    moving = scratch(seeds.select("host", (F.col("weight") * (1 - damping)).alias("rank")))
    settled = moving
    if flow.limit(1).count() == 0:
        return seeds.select("host", F.col("weight").cast("double").alias("rank"))
    for _ in itertools.count() if rounds is None else range(rounds):
        onward = moving.join(flow, F.col("host") == F.col("src")).select(F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank"))
        stuck = moving.join(sources, "host", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
        if stuck:
            onward = onward.unionByName(seeds.select("host", (F.col("weight") * (stuck * damping)).alias("rank")))
        before, moving = moving, scratch(onward.groupBy("host").agg(F.sum("rank").alias("rank")))
        both = settled.select("host", "rank", F.lit(0.0).alias("moved")).unionByName(moving.select("host", "rank", F.col("rank").alias("moved")))
        older, settled = settled, scratch(both.groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("moved").alias("moved")))
        forget(before, older)
        if settled.where(F.col("moved") > F.col("rank") * (enough * (1 - damping))).limit(1).count() == 0:
            break
    return settled.select("host", "rank")


def judge(pages: DataFrame, rules: DataFrame, factor: float = FACTOR) -> DataFrame:
    """page_id, url, host, path, rule, verdict, trust and distrust of each row of pages (page_id, url, html)."""
    named = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = match_rules(named.drop("html"), rules)
    ruled = scratch(ruled)
    edges = scratch(host_edges(named.select("host", "html")))
    hosts = scratch(
        ruled.groupBy("host").agg(
            F.count("*").alias("pages"),
            F.count(F.when(F.col("rule_verdict") == "allow", 1)).alias("allowed"),
            F.count(F.when(F.col("rule_verdict") == "block", 1)).alias("blocked"),
        )
    )
    total, allowed, blocked = hosts.agg(F.coalesce(F.sum("pages"), F.lit(0)), F.sum("allowed"), F.sum("blocked")).first()

    def ranks(column: str, n: int | None, along: DataFrame, name: str) -> DataFrame:
        if not n:
            return hosts.select("host", F.lit(0.0).alias(name)).limit(0)
        return propagate(hosts.where((F.col(column) > 0) & (F.col("host") != "")).select("host", (F.col(column) / n).alias("weight")), along).withColumnRenamed("rank", name)

    trust = ranks("allowed", allowed, edges, "trust")
    distrust = ranks("blocked", blocked, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "links"), "distrust")
    scored = hosts.select("host", "pages").join(trust, "host", "left").join(distrust, "host", "left").fillna(0.0, ["trust", "distrust"])
    scored = scratch(scored.withColumn("host_verdict", F.when(F.col("distrust") > F.col("trust") * factor, "block").otherwise("allow")))
    out = lookup(ruled, scored, "host", "pages", total)
    return out.withColumn("verdict", F.coalesce("rule_verdict", "host_verdict")).drop("rule_verdict", "host_verdict", "pages")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge(pages, rule_table(spark)).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")
