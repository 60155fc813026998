"""Near-duplicate detection: MinHash with tensored banding, candidates verified on full shingle sets.

Two small collections of SUBKEYS sub-keys each are made of ROWS minhashes a sub-key; a table's key is a pair of one sub-key from
either collection. So SUBKEYS * SUBKEYS tables with keys of 2 * ROWS minhashes cost 2 * SUBKEYS * ROWS minhashes, about the
square root of what independent tables would. Two documents of Jaccard similarity s meet in some table with probability
(1 - (1 - s^ROWS)^SUBKEYS)^2: 0.9999 at 0.85.

1. One pass over the text makes a set size, a digest of the set and the minhashes. Documents of equal sets are one class from there on.
2. Sub-keys that a single class has are dropped, the rest paired to keys. In each bucket all classes are tied to a hub chosen
   by a hash of class and key (a row for each member, never pairs within the bucket); ties whose minhashes agree in
   too few places are dropped. Tied classes form clusters.
3. A cluster is dealt into blocks of at most about BLOCK classes and MOST_HASHES hashes. First each block is compared in itself and with the cluster's first block:
   each set moves once or twice, however large the cluster. A group yields a star for each of its connected parts. Classes that are not connected to the first
   block's largest part (the rest) are then compared with all of the cluster, in pairs of a
   block of the rest and a block of all. So a group of n near copies of one text costs n, and only a cluster with a rest of r classes costs
   r / BLOCK times n more. Components of the stars are the result.

Free style (Arrow batches). Edge cases: a null or empty text, or one without words, has an empty set and links with nothing; so does
a row with a null id, whose component is null; ids of any size come out as they are; rows that share an id but not their set are judged
apart, each by its own text; repeated rows are a class; a very long text is one set, held once in a task, and makes a block of its own; an
empty table gives an empty result; extra columns are left out by `near_duplicates` and carried through by `keep_one`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ._base import forget, in_batches, lookup, scratch, ship, tasks_for, whole
from ._words import odd_numbers, shingles, word_hasher

ship(__name__)

SHINGLE = 5
SUBKEYS, ROWS = 8, 2
#: Of 2 * SUBKEYS * ROWS = 32 minhashes, ties agree in as many; pairs of similarity 0.8 fall short once in 10,000 ties.
AGREE = 17
#: Classes and hashes of a block, as planned from a cluster's sums.
BLOCK, MOST_HASHES = 512, 1 << 20
#: Class ids that may be broadcast: 8 bytes each.
MOST_BROADCAST = 500_000


def _set_of(words: np.ndarray) -> np.ndarray:
    return np.unique(shingles(words, SHINGLE))


def _sketches():
    """Of texts: set size, digest of the set, minhashes."""
    import xxhash

    hashes, n = word_hasher(), 2 * SUBKEYS * ROWS
    times, plus = odd_numbers(n, 101), odd_numbers(n, 202)

    def work(texts: list) -> tuple[list, list]:
        sizes, digests, mins = [], [], []
        for text in texts:
            s = _set_of(hashes(text))
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
            mins.append(np.array([(s * a + b).min() for a, b in zip(times, plus, strict=True)], np.uint64).view(np.int64) if len(s) else None)
        return list(range(len(texts))), [pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(mins, pa.list_(pa.int64()))]

    return work


def _sets():
    """The set of each text and its digest."""
    import xxhash

    hashes = word_hasher()

    def work(texts: list) -> tuple[list, list]:
        sets = [_set_of(hashes(text)) for text in texts]
        return list(range(len(texts))), [pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], pa.string()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]

    return work


def linked(a: int, b: int, both: np.ndarray | int, percent: int):
    """The contract's test on set sizes and intersection."""
    return 100 * both >= percent * (a + b - both)


def _link_matrix(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of all pairs of a group are linked."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        link = np.zeros((2, 2), bool)
        link[0, 1] = link[1, 0] = linked(sizes[0], sizes[1], len(np.intersect1d(*sets, assume_unique=True)), percent)
        return link
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.r_[True, flat[1:] != flat[:-1]]
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    both = np.zeros((n, n), np.float32)
    if len(column):
        column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
        width = 2048
        cuts = np.searchsorted(column, np.arange(0, column[-1] + width + 1, width))
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            x = np.zeros((n, width), np.float32)
            x[owner[lo:hi], column[lo:hi] - k * width] = 1
            both += x @ x.T  # whole numbers below 2^24: exact
    return linked(sizes[:, None], sizes[None, :], both.astype(np.int64), percent)


def _parts(link: np.ndarray, among: np.ndarray) -> list[list[int]]:
    """The connected parts of places `among` (a mask), each with its smallest place first."""
    out, left = [], among.copy()
    for i in np.flatnonzero(among):
        if left[i]:
            left[i], part, todo = False, [int(i)], [int(i)]
            while todo:
                near = np.flatnonzero(link[todo.pop()] & left)
                left[near] = False
                todo += near.tolist()
                part += near.tolist()
            out.append(part)
    return out


def _stars(nodes: list[int], sets: list[np.ndarray], pivot: list[bool] | None, percent: int) -> list[tuple[int, int, bool]]:
    """(center, node, rest) of a group, its nodes being sorted: a star for each connected part, so that links of all pairs come as a row for each node.

    In a block of a large cluster, pivot says which nodes are of the cluster's first block. The largest part that these form by themselves is the
    same in each block's group; what is connected to it is done, all else is rest and has a row even if it stands alone."""
    if pivot is None:
        parts = _parts(_link_matrix(sets, percent), np.ones(len(nodes), bool)) if len(nodes) > 1 else []
        return [(nodes[part[0]], nodes[i], False) for part in parts for i in part[1:]]
    link = _link_matrix(sets, percent) if len(nodes) > 1 else np.zeros((1, 1), bool)
    main = max(_parts(link, np.array(pivot, bool)), key=len, default=[None])
    out = []
    for part in _parts(link, np.ones(len(nodes), bool)):
        done = main[0] in part
        center = main[0] if done else part[0]
        out += [(nodes[center], nodes[i], not done) for i in part if not done or i != center]
    return out


def _link_groups(percent: int, blocks: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by group and node; a group is complete when the next begins. It has two blocks at most."""

        def told(rows: list) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["a", "b", "rest", "large"]).astype({"a": "int64", "b": "int64", "rest": "bool", "large": "bool"})

        def group() -> list[tuple[int, int, bool, bool]]:
            large = blocks and many > 1
            return [(*row, large) for row in _stars(nodes, sets, pivot if large else None, percent)] if nodes else []

        key, nodes, sets, pivot, many = None, [], [], [], 1
        found: list[tuple[int, int, bool, bool]] = []
        for batch in batches:
            for at, node, own, n_blocks, hashes in zip(zip(batch["cluster"], batch["g"], batch["h"], strict=True), batch["node"], batch["own"], batch["blocks"], batch["hashes"], strict=True):
                if at != key:
                    found += group()
                    key, nodes, sets, pivot, many = at, [], [], [], n_blocks
                if node not in nodes[-1:]:  # a class that is in both blocks of the group
                    nodes.append(node)
                    sets.append(np.asarray(hashes, np.int64))
                    pivot.append(own == 0)
            yield told(found)
            found = []
        yield told(group())

    return run


def _links(groups: DataFrame, rows: int, percent: int, blocks: bool) -> DataFrame:
    """(a, b, rest, large): the stars of each group (cluster, g, h) of (node, own, blocks, hashes) rows."""
    dealt = groups.repartition(tasks_for(groups.sparkSession, rows, 20_000), "cluster", "g", "h").sortWithinPartitions("cluster", "g", "h", "node")
    return dealt.select("cluster", "g", "h", "node", "own", "blocks", "hashes").mapInPandas(_link_groups(percent, blocks), "a long, b long, rest boolean, large boolean")


def _linked_nodes(sets: DataFrame, n: int, percent: int) -> DataFrame:
    """(node, component) of all links within clusters. sets: (node, cluster, blocks, own, hashes)."""
    # the first block goes to all others of its cluster, so that one round brings most of a large group of copies together
    first = F.when(F.col("own") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    found = scratch(_links(sets.withColumn("g", F.explode(first)).withColumn("h", F.lit(-1)), 2 * n, percent, True))
    star = lambda e: e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    small, large = star(found.where("NOT large")), found.where("large")
    if large.limit(1).count() == 0:
        return small
    rest = scratch(large.groupBy(F.col("b").alias("node")).agg(F.bool_and("rest").alias("rest")).where("rest").select("node"))
    n_rest = rest.count()
    if not n_rest:
        one = scratch(large.where("NOT rest").select("a", "b").distinct())  # a cluster each: its smallest node is its component
        least = one.groupBy("a").agg(F.min("b").alias("least"))
        named = one.join(least.hint("merge"), "a").withColumn("component", F.least("a", "least"))
        return small.unionByName(named.select(F.col("b").alias("node"), "component")).unionByName(named.select(F.col("a").alias("node"), "component").distinct())
    # the rest in blocks of its own, against all blocks of its cluster
    blocks = sets.where("blocks > 1")
    alone = scratch(blocks.join(rest.hint("merge"), "node", "left_semi"))
    weight = alone.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    parts = alone.join(weight.hint("merge"), "cluster").withColumn("g", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("parts")).cast("int"))
    as_rest = parts.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    as_all = blocks.join(weight.hint("merge"), "cluster").withColumn("h", F.col("own")).withColumn("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["cluster", "g", "h", "node", "own", "blocks", "hashes"]
    more = _links(as_rest.select(*columns).unionByName(as_all.select(*columns)), n + n_rest, percent, False)
    return small.unionByName(components(large.select("a", "b").unionByName(more.select("a", "b"))))


def _clusters(reps: DataFrame) -> DataFrame:
    """(node, component): classes (node, mins) tied through buckets."""
    half = SUBKEYS * ROWS
    sub = lambda side, i: F.struct(F.lit(side).alias("side"), F.xxhash64(F.lit(side * SUBKEYS + i), *[F.get("mins", F.lit(side * half + i * ROWS + r)) for r in range(ROWS)]).alias("sub"))
    subs = reps.select("node", F.explode(F.array(*[sub(s, i) for s in (0, 1) for i in range(SUBKEYS)])).alias("s")).select("node", "s.side", "s.sub")
    common = subs.groupBy("sub").agg(F.count("*").alias("n")).where("n > 1").select("sub")
    subs = subs.join(common.hint("merge"), "sub", "left_semi")
    pick = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("sub")))
    paired = subs.groupBy("node").agg(pick(0).alias("x"), pick(1).alias("y"))
    members = paired.select("node", F.explode("x").alias("x"), "y").select("node", "x", F.explode("y").alias("y")).select("node", F.xxhash64("x", "y").alias("key"))
    members = scratch(members)
    hubs = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key").alias("order"), F.col("node").alias("hub"))).alias("h"), F.count("*").alias("n")).where("n > 1").select("key", "h.hub")
    ties = members.join(hubs.hint("merge"), "key").where("node != hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    m = reps.select("node", "mins")
    ties = ties.join(m.withColumnsRenamed({"node": "a", "mins": "ma"}), "a").join(m.withColumnsRenamed({"node": "b", "mins": "mb"}), "b")
    agree = sum(((F.get("ma", F.lit(i)) == F.get("mb", F.lit(i))).cast("int") for i in range(2 * half)), F.lit(0))
    return components(ties.where(agree >= AGREE).select("a", "b"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 80, also: list[str] | None = None) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id, kept, and the columns `also`. Linked: 100 * intersection >= percent * union."""
    also = also or []
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), *also, F.col(text).alias("text"))
    sketched = scratch(in_batches(rows, _sketches, "text", "n_shingles long, digest string, mins array<bigint>", ["doc_id", *also]))
    some = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = some.groupBy("digest").agg(F.min(F.struct("doc_id", "mins")).alias("r"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"))
    classes = scratch(classes.select("digest", F.col("r.doc_id").alias("rep"), F.col("r.mins").alias("mins"), "copies", "n_shingles"))
    # a class goes by its smallest id, so a component's smallest node is its id; numbers instead if an id stands for several texts
    apart = classes.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() == 0
    classes = classes.withColumn("node", F.col("rep")) if apart else scratch(classes.withColumn("node", F.monotonically_increasing_id()))
    clusters = scratch(_clusters(classes).withColumnRenamed("component", "cluster"))
    members = scratch(classes.select("node", "digest", "rep", "n_shingles").join(clusters, "node"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / MOST_HASHES)).cast("int")
    sizes = members.groupBy("cluster").agg(blocks.alias("blocks"), F.count("*").alias("n"))
    n = members.count()
    placed = lookup(members, scratch(sizes), "cluster", "n", n, "inner").select("node", "digest", "rep", "cluster", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))
    placed = scratch(placed)
    # the text of one row of each class: that with the class's id, and among rows of that id that with its digest
    ids = placed.select(F.col("rep").alias("doc_id"), F.lit(True).alias("wanted"))
    texts = rows.join(F.broadcast(ids) if n <= MOST_BROADCAST else ids, "doc_id", "left_semi")
    found = in_batches(texts, _sets, "text", "digest string, hashes array<bigint>", ["doc_id"]).withColumnRenamed("doc_id", "rep")
    one = placed.hint("merge") if n > MOST_BROADCAST else F.broadcast(placed)
    sets = scratch(found.join(one, ["rep", "digest"]).select("node", "cluster", "blocks", "own", "hashes"))
    roots = _linked_nodes(sets, n, percent)
    known = classes.select("node", "digest", "rep", "copies").join(roots.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    if not apart:
        known = scratch(known)
        least = known.groupBy("component").agg(F.min("rep").alias("least"))
        known = known.join(least.hint("merge"), "component").withColumn("component", F.col("least"))
    verdicts = scratch(known.select("digest", "copies", F.col("component").alias("component_id")))
    forget(members, placed, sets)
    out = lookup(sketched.select("doc_id", *also, "n_shingles", "digest"), verdicts, "digest", "copies", sketched.count())
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    out = out.select("doc_id", *also, "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs that stay: of each group those of the smallest doc_id, once where rows repeat id and text; all rows without an id.

    Decisions come back to the rows by id and a hash of the text, so rows that share an id are told apart."""
    mine = "near_text_hash"
    while mine in docs.columns:
        mine += "_"
    hashed = docs.withColumn(mine, F.xxhash64(whole("text")))
    found = near_duplicates(hashed, percent=percent, also=[mine])
    stay = scratch(found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id", mine).agg(F.count("*").alias("n")))
    kept = hashed.join(stay.select("doc_id", mine).hint("merge"), ["doc_id", mine], "left_semi")
    if stay.where("n > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", mine])
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, percent=85)


def _oracle(hops: int = 16) -> str:
    """The same by an inverted index of all shingles, in DuckDB: every pair that shares a shingle is compared, links are followed so many hops."""
    low = f"translate(coalesce(text, ''), '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')"
    rounds = "".join(f", c{k} AS MATERIALIZED (SELECT x AS id, min(c) AS c FROM n JOIN c{k - 1} ON y = id GROUP BY 1)" for k in range(1, hops + 1))
    return f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array({low}, '[\x20\x09-\x0D]+'), lambda x: x != '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM w WHERE len(w) > 0)),
z AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
n AS MATERIALIZED (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l UNION ALL SELECT doc_id, doc_id FROM w), c0 AS MATERIALIZED (SELECT doc_id AS id, doc_id AS c FROM w){rounds}
SELECT w.doc_id, coalesce(z.n, 0) AS n_shingles, c AS component_id, w.doc_id = c AS kept FROM w LEFT JOIN z USING (doc_id) JOIN c{hops} ON id = w.doc_id
"""


OP9_SQL = _oracle()
