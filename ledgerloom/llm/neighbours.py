"""Nearest neighbours by inner product through multi-index hashing.

Vectors become binary codes: centred (which changes no query's order), given one more coordinate that makes their lengths equal (so that a small angle to a query is a large product), rotated
by matrices learned on a bounded sample to lie near the corners of a cube (iterative quantisation), and reduced to signs. Codes longer than the vectors come from several rotations.

A code is split into substrings. Codes within a Hamming radius R of a query agree with it, in at least one substring, up to that substring's share of R (pigeonhole), so the index holds
each row under each of its substrings, in shards by the substring's first bits, and a query goes to the shards whose bits are near enough. There, all codes within R are found, each under the first substring that
qualifies; the real vectors of those are compared in double precision, and a shard gives each query its nearest, without those below what the sample already has (which can't be among the nearest of all). R is what holds the true neighbours of TRIALS queries, which are searched exactly
in one pass, with a probability of HELD. Queries that find fewer than they are to have are searched again with a larger R, up to all bits, so that each gets as many as there are.

The number of substrings is the cheapest for R and the numbers of rows and queries: more substrings probe fewer codes, and hold each row more often. Shards are cut into blocks of
rows and of queries of bounded size, by hash: neither a large shard nor one that many queries probe meets in one task. Near-isotropic vectors have their neighbours at a large R, where all shards have to be
probed; neighbours that are near cost little.

Edge cases: vectors that are null, zero or hold a null or non-finite component take no part, nor do rows without an id and vectors of another length than the commonest (the shortest of equally
common ones); rows that repeat an id are one candidate with the best of their products, and not their own neighbours; equal products go to the smaller id; fewer candidates than asked for are all returned; an
empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import forget, scratch, ship, smallest

ship(__name__)

BITS = 256
#: Rows of the sample, bytes of it at most (as 32-bit numbers), and rounds of learning rotations on it.
SAMPLE, SAMPLE_BYTES, ROUNDS = 8_192, 16 << 20, 20
#: Queries that are searched exactly to choose the radius, and the share of their neighbours that it has to hold.
TRIALS, HELD = 64, 0.975
#: Substrings that a code may be split into.
SPLITS = (2, 4, 8, 16)
#: Rows that a shard is planned for, bits of a shard's name at most, and rows and queries of one block at most (about).
ROWS_A_SHARD, MOST_NAME_BITS, ROWS_A_BLOCK, QUERIES_A_BLOCK = 1_024, 12, 4_096, 4_096
#: What moving a row costs, in comparisons of codes.
MOVE = 400
#: Queries that are compared with a block at a time.
AT_ONCE = 64


class Rotations:
    """Codes of rows and of queries, learned on a sample of rows (n x d)."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, seed: int = 5):
        n, d = sample.shape
        self.mean = sample.mean(0)
        centred = sample - self.mean
        self.longest = (centred**2).sum(1).max()
        lifted = self._lift(centred)
        width = min(d + 1, bits)
        _, axes = np.linalg.eigh(lifted.T @ lifted)
        axes = axes[:, ::-1][:, :width]
        flat = lifted @ axes
        flat /= np.maximum(np.sqrt((flat**2).sum(1, keepdims=True)), 1e-300)
        rng, parts = np.random.default_rng(seed), []
        for _ in range(-(-bits // width)):
            turn, _ = np.linalg.qr(rng.normal(size=(width, width)))
            for _ in range(ROUNDS):
                u, _, vt = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
                turn = (u @ vt).T
            parts.append(axes @ turn)
        self.planes = np.hstack(parts)[:, :bits]

    def _lift(self, centred: np.ndarray) -> np.ndarray:
        return np.hstack([centred, np.sqrt(np.maximum(self.longest - (centred**2).sum(1, keepdims=True), 0))])

    def codes(self, x: np.ndarray, queries: bool) -> np.ndarray:
        """n x bits / 8 bytes."""
        lifted = np.hstack([x, np.zeros((len(x), 1))]) if queries else self._lift(x - self.mean)
        return np.packbits(lifted @ self.planes >= 0, axis=1)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _bytes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def valid(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id, vector of the rows that take part."""
    v = F.col("vector")
    out = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = out.where(~odd & F.exists(v, lambda x: x != 0))
    sizes = out.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return out.where(F.size(v) == (sizes.d if sizes else 0))


def coded(rows: DataFrame, model: Rotations) -> DataFrame:
    """id, vector, code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                codes = model.codes(_matrix(b.column(1)), False)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "vector", "code"])

    return rows.select("id", "vector").mapInArrow(run, f"id long, vector {rows.schema['vector'].dataType.simpleString()}, code binary")


def asked(rows: DataFrame, model: Rotations, sample: tuple[np.ndarray, np.ndarray], nearest: int) -> DataFrame:
    """id, vector, code of queries, and `least`: the product that so many other rows of the sample (ids, vectors) reach, a little less for rounding. No worse row is among the nearest."""
    ids, first = np.unique(sample[0], return_index=True)
    x = sample[1][first]
    longest = np.sqrt((x**2).sum(1).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = _matrix(b.column(1))
                score = np.where(b.column(0).to_numpy()[:, None] == ids[None, :], -np.inf, q @ x.T)
                least = np.partition(score, -nearest, axis=1)[:, -nearest] if len(ids) >= nearest else np.full(len(q), -np.inf)
                least = least - 1e-9 * longest * np.sqrt((q**2).sum(1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in model.codes(q, True)], pa.binary()), pa.array(least)], names=["id", "vector", "code", "least"])

    return rows.select("id", "vector").mapInArrow(run, f"id long, vector {rows.schema['vector'].dataType.simpleString()}, code binary, least double")


def _products(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Inner products of pairs, added up in the order of components. q, x: components x rows."""
    total = np.zeros(len(qi))
    for a, b in zip(q, x, strict=True):
        total += a[qi] * b[xi]
    return total


def _nearest(qi: np.ndarray, ids: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of each query's best pairs."""
    order = np.lexsort((ids, -score, qi))
    q = qi[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    return order[np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) < most]


def radius(index: DataFrame, trials: DataFrame, nearest: int, held: float = HELD) -> int:
    """Hamming distance that holds this share of the true neighbours of the trials (a bounded number of coded queries)."""
    some = trials.toArrow()
    if not some.num_rows:
        return 0
    ids, q, codes = some["id"].to_numpy(), _matrix(some["vector"]), _bytes(some["code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_by = [np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, int)]
        for b in batches:
            if not b.num_rows:
                continue
            x, own = _matrix(b.column(1)), b.column(0).to_numpy()
            score = np.where(ids[:, None] == own[None, :], -np.inf, q @ x.T)
            take = np.argpartition(-score, min(nearest, len(own)) - 1, axis=1)[:, :nearest]
            qi = np.repeat(np.arange(len(ids)), take.shape[1])
            xi = take.ravel()
            other = score[qi, xi] > -np.inf
            qi, xi = qi[other], xi[other]
            away = np.bitwise_count(codes[qi] ^ _bytes(b.column(2))[xi]).sum(1, dtype=int)
            held_by = [np.concatenate(p) for p in zip(held_by, [qi, own[xi], score[qi, xi], away], strict=True)]
            best = _nearest(held_by[0], held_by[1], held_by[2], nearest)
            held_by = [p[best] for p in held_by]
        yield pa.RecordBatch.from_arrays([pa.array(held_by[0], pa.int32()), pa.array(held_by[2], pa.float64()), pa.array(held_by[3], pa.int32())], names=["q", "score", "away"])

    best = Window.partitionBy("q").orderBy(F.desc("score"), "away")
    seen = index.mapInArrow(run, "q int, score double, away int").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest)
    return int(np.ceil(np.quantile([r.away for r in seen.select("away").collect()] or [0], held)))


def shares(r: int, parts: int) -> list[int]:
    """The distance up to which each substring is probed (-1: not at all): a code within r is within one of them."""
    each, more = divmod(r, parts)
    return [each if j <= more else each - 1 for j in range(parts)]


def split(r: int, rows: int, queries: int, bits: int = BITS) -> tuple[int, int]:
    """The number of substrings, and the bits that name a shard."""
    name = max(0, min(MOST_NAME_BITS, int(log2(max(rows, 1) / ROWS_A_SHARD)) if rows > ROWS_A_SHARD else 0))

    def cost(parts: int) -> float:
        probed = [sum(comb(name, i) for i in range(min(s, name) + 1)) / 2**name for s in shares(r, parts) if s >= 0]
        return queries * rows * sum(probed) + MOVE * (rows * len(probed) + queries * 2**name * sum(probed))

    return min((p for p in SPLITS if bits // p >= 16), key=cost), name


def _finder(r: int, parts: int, bits: int, nearest: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """For a block of rows and one of queries in a shard of substring j: each query's best rows of those within r that no earlier substring finds."""
    most = shares(r, parts)
    unit = {16: np.uint16, 32: np.uint32}.get(bits // parts, np.uint64)

    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        j = key[0].as_py()
        ids, own_ids = rows["id"].to_numpy(), queries["id"].to_numpy()
        found = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if len(ids) and len(own_ids):
            least = queries["least"].to_numpy()
            x, q = np.ascontiguousarray(_matrix(rows["vector"]).T), np.ascontiguousarray(_matrix(queries["vector"]).T)
            xc, qc = (np.ascontiguousarray(_bytes(t["code"]).view(unit).T) for t in (rows, queries))
            each = len(xc) // parts
            for start in range(0, len(own_ids), AT_ONCE):
                own = slice(start, start + AT_ONCE)
                total, fits = 0, True
                for part in range(parts):
                    away = sum(np.bitwise_count(qc[u, own, None] ^ xc[u, None, :]) for u in range(part * each, (part + 1) * each))
                    total = total + away.astype(np.uint16)
                    if part < j:
                        fits = fits & (away > most[part]) if most[part] >= 0 else fits
                    elif part == j:
                        fits = fits & (away <= most[part])
                qi, xi = np.nonzero(fits & (total <= r) & (own_ids[own, None] != ids[None, :]))
                qi += start
                score = _products(q, x, qi, xi)
                some = score >= least[qi]
                qi, xi, score = qi[some], xi[some], score[some]
                best = _nearest(qi, ids[xi], score, nearest)
                for to, what in zip(found, (own_ids[qi[best]], ids[xi[best]], score[best]), strict=True):
                    to.append(what)
        return pa.table([pa.array(np.concatenate(f)) for f in found], names=["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, r: int, nearest: int, n_rows: int, n_queries: int, bits: int = BITS, splits: tuple[int, int] | None = None) -> DataFrame:
    """query_id, vec_id, score: the nearest of the rows whose codes are within r of the query's, for each query and more than once where several blocks have some. index: id, vector, code; queries: also least."""
    parts, name = splits or split(r, n_rows, n_queries, bits)
    most, each = shares(r, parts), bits // parts // 8
    named = lambda j: F.shiftright(F.conv(F.hex(F.substring("code", j * each + 1, 2)), 16, 10).cast("int"), 16 - name)
    probed = [j for j in range(parts) if most[j] >= 0]
    at = lambda df: df.withColumn("at", F.explode(F.array(*[F.struct(F.lit(j).alias("j"), named(j).alias("shard"), F.lit(most[j]).alias("near")) for j in probed]))).select(*df.columns, "at.*")
    held = at(index).drop("near")
    sent = at(queries).withColumn("shard", F.explode(F.filter(F.sequence(F.lit(0), F.lit(2**name - 1)), lambda s: F.bit_count(s.bitwiseXOR(F.col("shard"))) <= F.col("near")))).drop("near")
    blocks = lambda df, size, to: df.groupBy("j", "shard").agg(F.ceil(F.count("*") / size).cast("int").alias(to))
    # a row for each shard: at most 16 * 2^MOST_NAME_BITS
    both = F.broadcast(scratch(blocks(held, ROWS_A_BLOCK, "n_rows").join(blocks(sent, QUERIES_A_BLOCK, "n_asked"), ["j", "shard"])))
    own = lambda n: F.pmod(F.xxhash64("id", "j"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    key = ["j", "shard", "row_block", "ask_block"]
    held = held.join(both, ["j", "shard"]).withColumn("row_block", own("n_rows")).withColumn("ask_block", every("n_asked")).select(*key, "id", "vector", "code")
    sent = sent.join(both, ["j", "shard"]).withColumn("ask_block", own("n_asked")).withColumn("row_block", every("n_rows")).select(*key, "id", "vector", "code", "least")
    return held.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(_finder(r, parts, bits, nearest), "query_id long, vec_id long, score double")


def neighbours(rows: DataFrame, key: str, vector: str, is_query: Column, nearest: int, held: float = HELD) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest rows found for each row that is_query (an expression on `id`)."""
    spark = rows.sparkSession
    taken = scratch(valid(rows, key, vector))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_rows, n_queries = taken.count(), taken.where(is_query).count()
    enough = min(nearest, taken.select("id").distinct().limit(nearest + 1).count() - 1)
    if not n_queries or enough < 1:
        return empty
    width = taken.select(F.size("vector")).first()[0]
    some = smallest(taken, max(1, min(SAMPLE, SAMPLE_BYTES // (4 * width))), 3, "id").select("id", "vector").toArrow()
    sample = some["id"].to_numpy(), _matrix(some["vector"])
    model = Rotations(sample[1])
    index, left = scratch(coded(taken, model)), scratch(asked(taken.where(is_query), model, sample, nearest))
    r = max(1, radius(index, smallest(left, TRIALS, 4, "id"), nearest, held))
    forget(taken)
    out = None
    while True:
        near = search(index, left, r, nearest, n_rows, n_queries).repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = scratch(near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest).select(*empty.columns))
        full = ranked.where(F.col("rank") == enough).select(F.col("query_id").alias("id"))
        short = scratch(left.join(full, "id", "left_anti"))
        n_queries = short.count()
        done = r >= BITS or not n_queries
        part = ranked if done else ranked.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi")
        out = part if out is None else out.unionByName(part)
        if done:
            return out
        left, r = short, min(BITS, r + BITS // 8)


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", F.col("id") % 20 == 0, 20)
