"""The trie of conversation prefixes: what conversations share, node by node.

A node is a distinct sequence of first turns. Of the conversations that begin with it, its members, the smallest owns it; what a conversation owns is a suffix of its path. So a node is (owner, depth), and its subtree
is made of its members' own suffixes: a subtree's sums are sums over members. For each member and depth, tokens from there on minus those that the member owns, and a flag where it owns
its last turn and no other goes on from it; one group-by over (owner, depth) adds them up. No node ever looks at its descendants.

Prefixes are compared by two 64-bit sums (xor) of hashes of (place, SHA-256 of the turn): equal prefixes have equal sums, and of n different ones two agree with a probability of n^2 / 2^129. Sums, owners and
suffixes are running and whole aggregates over ranges (`_ranged`), so one conversation, first turn or prefix may hold any share of all rows. Texts are read once: only
their digests and word counts move.

`ends_sha256` hashes a list in order, so a node's list has one task; ids reach it sorted, in strings of ID_CHUNK, and are hashed as they come.

Edge cases: null role or text counts as empty; a null turn comes first; turns of the same number are ordered by role and SHA-256 of the text, repeated rows are
repeated turns; rows without conv_id are left out; a conversation without turns left is a member of the root only; a very long text is hashed where it is read; an empty table has no
node, not even a root; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import lookup, scratch, ship, whole, word_count
from ._ranged import over_ranges

ship(__name__)

#: Ids that one string of a list of ids holds.
ID_CHUNK = 1000
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), digest of role and text, words."""
    role, text = whole(F.col("role")), whole(F.col("text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.sha2(text.cast("binary"), 256).alias("digest"), word_count(text).alias("words"),
    )
    rows = scratch(rows)  # ranges are found from a first look at their keys: texts are read once
    placed = over_ranges(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "digest"], running={"place": (F.lit(1), "sum")})
    return placed.select("conv_id", "place", F.sha2(F.concat_ws(":", F.length("role"), "role", "digest").cast("binary"), 256).alias("digest"), "words")


def sequences(placed: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """conv_id, depth, digest, words of conversations, with a row of depth 0 for each.

    heads: (conv_id, head, from_conv): conversations whose first `head` turns are those of another one (as many as it has), before their own after as many."""
    total = scratch(placed)
    convs = total.groupBy("conv_id").agg(F.count("*").alias("n"))
    root = lambda c: c.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("words"))
    if heads is None:
        return total.withColumnRenamed("place", "depth").unionByName(root(convs))
    most = heads.agg(F.max("head")).first()[0] or 0
    lent = total.join(heads.select(F.col("from_conv").alias("conv_id")).distinct(), "conv_id", "left_semi").where(F.col("place") <= most)
    lent = lent.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "digest", "words"))).alias("first")).withColumnRenamed("conv_id", "from_conv")
    none = F.array().cast(lent.schema["first"].dataType)
    plan = scratch(convs.join(heads, "conv_id", "left").join(lent, "from_conv", "left").select("conv_id", "n", F.coalesce("head", F.lit(0)).alias("head"), F.coalesce(F.expr("slice(first, 1, head)"), none).alias("taken")))
    own = lookup(total, plan.select("conv_id", "n", "head", F.size("taken").alias("got")), "conv_id", "n", total.count(), "inner").where("place > head")
    own = own.select("conv_id", (F.col("place") - F.col("head") + F.col("got")).alias("depth"), "digest", "words")
    borrowed = plan.select("conv_id", F.explode("taken").alias("t")).select("conv_id", F.col("t.place").alias("depth"), "t.digest", "t.words")
    return own.unionByName(borrowed).unionByName(root(plan))


def trie(seqs: DataFrame) -> DataFrame:
    """A row for each node of the trie over (conv_id, depth, digest, words): conv_id (its owner), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    of_turn = lambda seed: F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(seed), "depth", "digest"))
    paths = over_ranges(
        seqs, ["conv_id"], ["depth"], running={"x1": (of_turn(1), "xor"), "x2": (of_turn(2), "xor"), "said": (F.col("words"), "sum")},
        total={"all_words": (F.col("words"), "sum"), "last": (F.col("depth"), "max")},
    )
    paths = paths.select("conv_id", "depth", "x1", "x2", (F.col("all_words") - F.col("said") + F.col("words")).alias("on"), (F.col("depth") == F.col("last")).alias("ends"))
    one = F.lit(1)
    known = over_ranges(paths, ["depth", "x1", "x2"], ["conv_id"], total={"owner": (F.col("conv_id"), "min"), "n_convs": (one, "sum"), "n_ends": (F.col("ends").cast("long"), "sum")})
    mine = F.col("owner") == F.col("conv_id")
    leaf = mine & F.col("ends") & (F.col("n_ends") == F.col("n_convs"))
    known = over_ranges(
        known.select("conv_id", "depth", "owner", "on", "ends", "n_ends", "n_convs"), ["conv_id"], ["depth"],
        total={"owns_from": (F.when(mine, F.col("depth")), "min"), "owned": (F.when(mine, F.col("on")).otherwise(0), "max"), "leaf": (leaf.cast("long"), "max"), "above": (F.when(~mine, F.struct("depth", "owner")), "max")},
    )
    known = scratch(known)
    parent = F.when(mine & (F.col("depth") > F.col("owns_from")), F.col("conv_id")).when(mine, F.col("above.owner"))
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    nodes = known.groupBy(F.col("owner").alias("conv_id"), "depth").agg(
        F.max(parent).alias("parent_conv_id"), F.count("*").alias("n_convs"), total((~F.col("ends") & (F.col("owns_from") <= F.col("depth") + 1)).cast("long"), "n_children"), total(F.col("leaf"), "n_leaves"),
        total(F.col("on") - F.least("on", "owned"), "saved_tokens"), F.max("n_ends").alias("n_ends"), F.min(F.when(F.col("ends"), known.conv_id)).alias("end"),
    )
    lists = list_digests(known.where("ends AND n_ends > 1").select("owner", "depth", "conv_id")).withColumnsRenamed({"owner": "conv_id", "sha256": "of_list"})
    digest = F.when(F.col("n_ends") == 0, EMPTY_SHA256).when(F.col("n_ends") == 1, F.sha2(F.col("end").cast("string").cast("binary"), 256)).otherwise(F.col("of_list"))
    return nodes.join(lists, ["conv_id", "depth"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256"))


def _by_node(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], int | str]]:
    for b in batches:
        yield from zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column(2).to_pylist(), strict=True)


def _to_batches(rows: Iterator[tuple[int, int, int, str]], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ID_CHUNK:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names=names)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of at most ID_CHUNK sorted ids of a node each, with the first of them."""

    def made() -> Iterator[tuple[int, int, int, str]]:
        node, ids = None, []
        for at, i in _by_node(batches):
            if ids and (at != node or len(ids) == ID_CHUNK):
                yield (*node, ids[0], ",".join(map(str, ids)))
                ids = []
            node = at
            ids.append(i)
        if ids:
            yield (*node, ids[0], ",".join(map(str, ids)))

    yield from _to_batches(made(), ["owner", "depth", "first", "ids"], [pa.int64(), pa.int64(), pa.int64(), pa.string()])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's strings, joined by commas, which come in order."""

    def made() -> Iterator[tuple[int, int, str]]:
        node, sha = None, None
        for at, ids in _by_node(batches):
            if at == node:
                sha.update(b",")
            else:
                if node is not None:
                    yield (*node, sha.hexdigest())
                node, sha = at, hashlib.sha256()
            sha.update(ids.encode())
        if node is not None:
            yield (*node, sha.hexdigest())

    yield from _to_batches(made(), ["owner", "depth", "sha256"], [pa.int64(), pa.int64(), pa.string()])


def list_digests(ends: DataFrame) -> DataFrame:
    """owner, depth, sha256 of the node's conv_ids in order. The ids of a large node are made into strings by many tasks."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["owner", "depth", "conv_id"]
    strings = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_chunks, "owner long, depth long, first long, ids string")
    dealt = strings.repartition(parts, "owner", "depth").sortWithinPartitions("owner", "depth", "first")
    return dealt.select("owner", "depth", "ids").mapInArrow(_hashed, "owner long, depth long, sha256 string")


def lent_heads(conv: Column) -> list[Column]:
    """head and from_conv of the query's rebuilt conversations."""
    return [(F.crc32(conv.cast("string").cast("binary")) % 4).cast("int").alias("head"), (conv - conv % 20).alias("from_conv")]


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = scratch(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    heads = placed.select("conv_id").distinct().select("conv_id", *lent_heads(F.col("conv_id")))
    return trie(sequences(placed, heads))


OP11_SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS place,
  coalesce(role, '') || chr(1) || sha256(coalesce(text, '')) AS said, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_transform(str_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b:
  list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1))), 4294967295::BIGINT), 4294967295) % 4 AS head FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT h.conv_id, t.place AS depth, t.said, t.words FROM h JOIN t ON t.conv_id = h.base AND t.place <= h.head),
g AS (SELECT h.conv_id, h.head, count(b.depth) AS got FROM h LEFT JOIN b USING (conv_id) GROUP BY 1, 2),
s AS (SELECT * FROM b UNION ALL SELECT conv_id, place - head + got, said, words FROM t JOIN g USING (conv_id) WHERE place > head UNION ALL SELECT conv_id, 0, '', 0 FROM g),
p AS (SELECT conv_id, depth, words, string_agg(said, chr(2)) OVER (PARTITION BY conv_id ORDER BY depth) AS path, max(depth) OVER (PARTITION BY conv_id) AS last FROM s),
n AS (SELECT path, depth, min(conv_id) AS owner, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = last), '')) AS ends_sha256 FROM p GROUP BY 1, 2),
u AS (SELECT n.owner, n.depth, up.owner AS parent, n.path FROM n JOIN p ON p.conv_id = n.owner AND p.depth = n.depth - 1 JOIN n up ON up.path = p.path AND up.depth = p.depth),
k AS (SELECT parent AS owner, depth - 1 AS depth, count(*) AS n_children FROM u GROUP BY 1, 2),
c AS (SELECT n.owner, n.depth, n.n_convs, n.words, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (owner, depth)),
a AS (SELECT n.owner, n.depth, count(*) FILTER (WHERE c.n_children = 0) AS n_leaves, sum((c.n_convs - 1) * c.words) AS saved_tokens FROM c JOIN p ON p.conv_id = c.owner AND p.depth <= c.depth JOIN n ON n.path = p.path AND n.depth = p.depth GROUP BY 1, 2)
SELECT n.owner AS conv_id, n.depth::BIGINT AS depth, u.parent AS parent_conv_id, n.n_convs, c.n_children, a.n_leaves, a.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN c USING (owner, depth) JOIN a USING (owner, depth) LEFT JOIN u USING (owner, depth)
"""
