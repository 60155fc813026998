"""How filters interact: what each order of a set of filters keeps, removes and removes again.

The orders form a trie of permutations. It is walked depth first: each node holds the rows that survive the filters on its path, written to
the shared folder and read by the next filters. What survives doesn't depend on the order, so paths with the same set of filters share one node
(`memo`): n filters have 2^n - 1 nodes, not n!. On each edge, removals are counted on the rows that are there. One aggregate over all nodes counts every
edge for each part; the n! orders are then read off those counts.

Texts are read once: a node's rows hold a part, and a flag for each filter and mark. Sums are pre-aggregated by part, so a part of any size is spread over all tasks. Equal texts are found by
digest; digests that many rows share are looked up by broadcast.

Edge cases: null text counts as empty; a null source is the part ''; texts without words fail A and not B; a very long text is measured where it is read; rows that
repeat a doc_id are counted each, and are no copies of each other unless a smaller id has the text; a null doc_id is smaller than none, has no label and no smaller one; of repeated labels of an id one of 1 is enough, others don't
count; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import forget, lookup, one_spaced, scratch, whole

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: n! orders are listed for each part.
MOST_FILTERS = 7
#: Rows of flags, of a few bytes each, that one task filters.
ROWS_A_TASK = 500_000


def survivors(rows: DataFrame, filters: list[str]) -> dict[int, DataFrame]:
    """The rows left after each set of filters but the whole one. filters: boolean columns, true where a row fails. Sets are bit masks."""
    everything = (1 << len(filters)) - 1
    memo: dict[int, DataFrame] = {}
    start = scratch(rows)
    tasks = -(-start.count() // ROWS_A_TASK) or 1

    def visit(state: int, left: DataFrame) -> None:
        memo[state] = left
        for i, name in enumerate(filters):
            after = state | 1 << i
            if after not in memo and after != everything:
                visit(after, scratch(left.where(~F.col(name)).coalesce(tasks)))

    visit(0, start)
    return memo


def edges(rows: DataFrame, filters: list[str], part: str, marks: list[str]) -> DataFrame:
    """For each part, set of filters (state) and further filter (its number): n rows before it, removed rows, and removed_<mark> of those with a mark."""
    nodes = survivors(rows.select(part, *filters, *marks), filters)
    all_rows = None
    for state, left in nodes.items():
        tagged = left.withColumn("state", F.lit(state))
        all_rows = tagged if all_rows is None else all_rows.unionByName(tagged)
    count = lambda c: F.count_if(c).alias
    sums = [F.count("*").alias("n")]
    for f in filters:
        sums += [count(F.col(f))(f"{f}_removed"), *[count(F.col(f) & F.col(m))(f"{f}_removed_{m}") for m in marks]]
    counted = all_rows.groupBy(part, "state").agg(*sums)
    out = [F.when(F.col("state").bitwiseAND(1 << i) == 0, F.struct(F.lit(i).alias("filter"), F.col(f"{f}_removed").alias("removed"), *[F.col(f"{f}_removed_{m}").alias(f"removed_{m}") for m in marks])) for i, f in enumerate(filters)]
    found = scratch(counted.select(part, "state", "n", F.explode(F.array_compact(F.array(*out))).alias("e")).select(part, "state", "n", "e.*"))
    forget(*nodes.values())
    return found


def audit(rows: DataFrame, filters: list[str], part: str, marks: list[str]) -> DataFrame:
    """For each part, order of the filters (named by letters in the order given) and step: kept, removed, redundant, unique_fails, lost_<mark>, shapley."""
    n = len(filters)
    if n > MOST_FILTERS:
        raise ValueError(f"{n} filters have too many orders")
    spark, everything = rows.sparkSession, (1 << n) - 1
    found = edges(rows, filters, part, marks)
    size = F.bit_count("state")
    orders_with = F.element_at(F.lit([factorial(k) * factorial(n - 1 - k) for k in range(n)]), size + 1)  # orders that begin with the state's filters and go on with this one
    alone = F.col("state") == F.lit(everything) - F.pow(F.lit(2), F.col("filter")).cast("int")
    of_filter = found.groupBy(part, "filter").agg(
        F.sum(F.col("removed") * orders_with).alias("shapley"),
        F.sum(F.when(F.col("state") == 0, F.col("removed"))).alias("fails"),
        F.coalesce(F.sum(F.when(alone, F.col("removed"))), F.lit(0)).alias("unique_fails"),
        F.map_from_entries(F.collect_list(F.struct("state", F.struct("n", "removed", *[f"removed_{m}" for m in marks])))).alias("at"),
    )
    steps = []
    for order in permutations(range(n)):
        name, state = "".join(LETTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            steps.append((name, step, i, state))
            state |= 1 << i
    plan = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter int, state int"))
    seen = of_filter.join(plan, "filter").withColumn("now", F.try_element_at("at", "state"))  # null: no row of the part is left
    of = lambda c: F.coalesce(F.col(f"now.{c}"), F.lit(0).cast("long"))
    return seen.select(
        part, "filter_order", "step", (of("n") - of("removed")).alias("kept"), of("removed").alias("removed"), (F.col("fails") - of("removed")).alias("redundant"), "unique_fails",
        *[of(f"removed_{m}").alias(f"lost_{m}") for m in marks], "shapley",
    )


def measured(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, the flags A to E of filters that a document fails, and whether it is labelled good or toxic."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), whole("text").alias("text"))
    words = F.filter(F.split(one_spaced(F.col("text")), " "), lambda w: w != "")
    sizes = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")))  # bound once
    upper = F.length("text") - F.length(F.translate("text", LETTERS, ""))
    d = d.select(
        "doc_id", "part", F.get(sizes, F.lit(0)).alias("s"), (F.lit(100) * upper > F.lit(5) * F.length("text")).alias("C"), F.rlike("text", F.lit("[#$%&*|]")).alias("D"),
        F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
    )
    d = scratch(d.select("doc_id", "part", (F.col("s.words") < 50).alias("A"), (F.lit(100) * F.col("s.distinct") < F.lit(65) * F.col("s.words")).alias("B"), "C", "D", "digest"))
    copies = scratch(d.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    d = lookup(d, copies, "digest", "n", d.count())
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(m) for c, m in (("quality", "good"), ("toxic", "toxic"))])
    flag = lambda c: F.coalesce(c, F.lit(False))
    return d.join(marks, "doc_id", "left").select("part", "A", "B", "C", "D", flag(F.col("doc_id") > F.col("first")).alias("E"), flag(F.col("good")).alias("good"), flag(F.col("toxic")).alias("toxic"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = measured(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = audit(flags, list("ABCDE"), "part", ["good", "toxic"])
    return found.withColumnsRenamed({"lost_good": "good_lost", "lost_toxic": "toxic_lost"})


OP12_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (SELECT doc_id, part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
  100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM w),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY 1),
g AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS fails, count(*) AS n, count(*) FILTER (WHERE good) AS ng, count(*) FILTER (WHERE toxic) AS nt FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
o AS (SELECT v1.l || v2.l || v3.l || v4.l || v5.l AS filter_order FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v1(l), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v2(l), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v3(l),
  (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v4(l), (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v5(l) WHERE len(list_distinct([v1.l, v2.l, v3.l, v4.l, v5.l])) = 5),
s AS (SELECT filter_order, step, (1 << (ascii(filter_order[step]) - 65)) AS mine, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::BIGINT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, mine, coalesce(sum(n) FILTER (WHERE fails & (before | mine) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE fails & before = 0 AND fails & mine > 0), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE fails & before > 0 AND fails & mine > 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails = mine), 0) AS unique_fails,
  coalesce(sum(ng) FILTER (WHERE fails & before = 0 AND fails & mine > 0), 0) AS good_lost, coalesce(sum(nt) FILTER (WHERE fails & before = 0 AND fails & mine > 0), 0) AS toxic_lost FROM g, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, mine))::BIGINT AS shapley FROM r
"""
