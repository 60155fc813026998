"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots, each a block of BLOCK_WORDS words of one source. Slot i gets the golden-ratio point
frac((i + 1/2) / phi), which falls into one source's stretch of the cumulative targets, so every stretch of the schedule
holds the sources in nearly their target shares. A source's documents are shuffled by a seeded hash of their id, laid end to
end and cut into blocks of equal words; its k-th slot takes block k modulo the number of blocks. A source has as many slots as its target needs: those that the
points give it beyond are left out, the few that they give it too few are appended, and its last slot is cut to what the target needs, so a source's words come out as
its target, rounded. Its blocks are all taken once before any is taken twice.

What is taken of a document follows from the targets; when it is taken follows from the schedule. `mix` gives both: the words, the slot in which the
document comes first and in how many slots it comes. `mixed_documents` gives the documents in the order of their slots.

Prefix sums run within (source, chunk), chunks being ranges of the shuffle hash, so that a source with a third of all rows
spreads over many tasks. What has a row for each source only (weights, water filling) runs in one window; sources are a
catalogue and not data, and each has a row of a few bytes there.

DataFrame operations only. Edge cases: a null text has size 0; documents of size 0 are taken 0 times and have no slot; a very long text covers many blocks, a row for each; a null source is a
source of its own, sorted last; null ids share a place in the shuffle, ordered by size, and repeated ids and rows are documents of their own; an empty table gives an empty mix; extra columns
are left out of the result by `mix` and carried through by `mixed_documents`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import scratch, tasks_for, whole, word_count

BLOCK_WORDS = 1024
ROWS_A_CHUNK = 5_000
SEED = 20240229
_PHI_STEP = 0.6180339887498949  # 1 / golden ratio


def _name(source: Column) -> Column:
    """A source's key: never null, null apart from any text."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(src, n_docs, source_size, weight, target) from (src, n, size) rows: weights go round by code point of the source, null last;
    targets sum up to share of all words, by weight, but stop at most times the source's size, and the excess is reshared by weight."""
    src = sizes.groupBy("src").agg(F.sum("n").alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = Window.orderBy((F.col("src") == "n").cast("int"), F.col("src"))  # 's...' by code point, 'n' (null) last
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    src = src.withColumn("cap", F.col("source_size") * most).withColumn("_at", F.col("cap") / F.col("weight"))
    # water filling: sources in the order in which a rising level reaches their cap; those before the level hold their cap
    up = Window.orderBy("_at", "src")
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    src = src.withColumn("_left", F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    src = src.withColumn("_level", F.col("_left") / F.sum("weight").over(after))
    src = src.withColumn("_stop", F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_at", "src", "_level"))).over(everything))
    full = F.col("_stop").isNull() | (F.struct("_at", "src") < F.struct(F.col("_stop._at"), F.col("_stop.src")))
    return src.withColumn("target", F.when(full, F.col("cap")).otherwise(F.col("weight") * F.col("_stop._level"))).select("src", "n_docs", "source_size", "weight", "target")


def schedule(spark: SparkSession, targets: DataFrame, block: int = BLOCK_WORDS, step: float = _PHI_STEP) -> DataFrame:
    """The mix in order: (slot, src, rank, block, words). Needs (src, source_size, target) rows. step: between points, modulo 1."""
    t = targets.where("source_size > 0").withColumn("words", F.round("target").cast("long")).where("words > 0")
    t = t.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    t = t.withColumn("rest", F.col("words") % F.col("source_size"))
    t = t.withColumn("slots", (F.expr("words div source_size") * F.col("blocks") + F.ceil(F.col("rest") / block)).cast("long"))
    total = t.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    if not total:
        return spark.createDataFrame([], "slot long, src string, rank long, block long, words long")
    line = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_end", F.sum("slots").over(line))  # whole numbers first: neighbours then share their bound exactly
    t = t.withColumn("_lo", (F.col("_end") - F.col("slots")) / F.lit(float(total))).withColumn("_hi", F.col("_end") / F.lit(float(total)))
    # points fall into cells of the unit interval; a cell knows the sources that it meets, so that the lookup is an equi-join
    cells = 4096
    parts = t.withColumn("cell", F.explode(F.sequence(F.floor(F.col("_lo") * cells).cast("int"), F.least(F.floor(F.col("_hi") * cells).cast("int"), F.lit(cells - 1))))).select("cell", "_lo", "_hi", "src", "slots")
    n_cells = parts.count()
    points = spark.range(0, total, 1, tasks_for(spark, total, 2_000_000)).select(F.col("id").alias("slot"), F.expr(f"pmod((id + 0.5D) * {step!r}D, 1D)").alias("_u"))
    points = points.withColumn("cell", F.floor(F.col("_u") * cells).cast("int"))
    if n_cells <= 100_000:  # a proven bound on what is broadcast: sources and cells, not data
        parts = F.broadcast(parts)
    hit = scratch(points.join(parts, "cell").where("_u >= _lo AND _u < _hi").select("slot", "src"))
    # a slot's rank in its source: prefix sums over runs of the schedule, so that no source has to fit into a task
    run = (F.col("slot") / 100_000).cast("long")
    runs = hit.groupBy("src", run.alias("_run")).agg(F.count("*").alias("_n"))
    runs = runs.withColumn("_before", F.sum("_n").over(Window.partitionBy("src").orderBy("_run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    ranked = hit.withColumn("_run", run).withColumn("_in", F.row_number().over(Window.partitionBy("src", "_run").orderBy("slot")) - 1)
    ranked = ranked.join(runs.drop("_n"), ["src", "_run"]).select("slot", "src", (F.col("_before") + F.col("_in")).alias("rank"))
    got = hit.groupBy("src").agg(F.count("*").alias("_got"))
    more = t.join(got, "src", "left").fillna(0, ["_got"]).where("_got < slots").select("src", F.explode(F.sequence(F.col("_got"), F.col("slots") - 1)).alias("rank"))
    more = more.select((F.lit(total) + F.col("rank")).alias("slot"), "src", F.col("rank").cast("long").alias("rank"))
    few = t.select("src", "slots", "blocks", "rest", "source_size")
    every = ranked.unionByName(more).join(F.broadcast(few) if n_cells <= 100_000 else few, "src").where("rank < slots")
    every = every.withColumn("block", F.col("rank") % F.col("blocks"))
    length = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    full = (F.col("slots") - F.ceil(F.col("rest") / block)).cast("long")  # slots of whole passes
    last = F.least(length, F.col("rest") - F.col("block") * block)
    return every.withColumn("words", F.when(F.col("rank") < full, length).otherwise(last).cast("long")).select("slot", "src", "rank", "block", "words")


def _positions(docs: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Documents with `at`: the words of their source that come before them in its shuffled order."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    chunks = targets.select("src", F.greatest(F.ceil(F.col("n_docs") / ROWS_A_CHUNK), F.lit(1)).cast("long").alias("_chunks"))
    few = targets.count() <= 100_000
    d = docs.join(F.broadcast(chunks) if few else chunks, "src").withColumn("_h", h)
    d = d.withColumn("_chunk", F.pmod(F.shiftrightunsigned("_h", 20), F.col("_chunks")))
    sums = d.groupBy("src", "_chunk").agg(F.sum("size").alias("_sum"))
    sums = sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("src").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).drop("_sum")
    inside = Window.partitionBy("src", "_chunk").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_in", F.sum("size").over(inside) - F.col("size"))
    return d.join(sums, ["src", "_chunk"]).withColumn("at", F.col("_before") + F.col("_in")).drop("_chunk", "_chunks", "_h", "_before", "_in")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS, seed: int = SEED, step: float = _PHI_STEP, also: list[str] | None = None
) -> DataFrame:
    """For each row of docs: doc_id, size, source_size, target, taken, first_slot (null if nothing is taken), n_slots, and the columns `also`."""
    spark, also = docs.sparkSession, also or []
    sizes = scratch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *also, _name(F.col("source")).alias("src"), word_count(whole("text")).alias("size")))
    targets = scratch(source_targets(sizes.groupBy("src").agg(F.count("*").alias("n"), F.sum("size").alias("size")), weights, share, most))
    placed = scratch(_positions(sizes, targets, seed).withColumn("_row", F.monotonically_increasing_id()))
    slots = schedule(spark, targets, block, step)
    # a block is taken whole some times and its beginning once more at most: at most ceil(most) entries, as it comes once in each pass over its source
    takes = slots.groupBy("src", "block").agg(F.collect_list(F.struct("slot", "words")).alias("_takes"))
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"at div {block}L"), F.expr(f"(at + size - 1) div {block}L"))))
    pieces = pieces.withColumn("_from", F.greatest(F.col("at") - F.col("block") * block, F.lit(0))).withColumn("_to", F.least(F.col("at") + F.col("size") - F.col("block") * block, F.lit(block)))
    pieces = pieces.join(takes.hint("shuffle_hash"), ["src", "block"])
    got = F.aggregate("_takes", F.lit(0).cast("long"), lambda a, t: a + F.greatest(F.least(t["words"], F.col("_to")) - F.col("_from"), F.lit(0)))
    hits = F.filter("_takes", lambda t: t["words"] > F.col("_from"))
    taken = pieces.groupBy("_row").agg(F.sum(got).alias("taken"), F.min(F.array_min(F.transform(hits, lambda t: t["slot"]))).alias("first_slot"), F.sum(F.size(hits)).alias("n_slots"))
    few = targets.select("src", "source_size", "target")
    out = placed.join(taken, "_row", "left").join(F.broadcast(few) if targets.count() <= 100_000 else few, "src")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), *also)


def mixed_documents(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mix as rows of docs, in the order of the schedule: a document comes as often as its words are taken, what is left over of a whole number of times
    counting as the chance (by a seeded hash of id and text) of once more. Repeats come half a round later each.

    Decisions come back to the rows by id and a hash of the text, so rows that share an id are told apart; rows that repeat both come as often each as all of them are taken together, shared out."""
    names = {}
    for name in ("mixed_text_hash", "mixed_at", "mixed_times", "mixed_first", "mixed_rows"):
        names[name] = name
        while names[name] in docs.columns:
            names[name] += "_"
    mine, at, times, first, rows = names.values()
    hashed = docs.withColumn(mine, F.xxhash64(whole("text")))
    found = mix(hashed, seed=seed, also=[mine], **options)
    share = F.sum("taken") / F.greatest(F.sum("size"), F.lit(1))
    chance = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", mine), F.lit(1 << 30)) / F.lit(float(1 << 30))
    told = found.groupBy("doc_id", mine).agg(share.alias("_share"), F.min("first_slot").alias(first))
    told = scratch(told.withColumn(times, F.floor(F.col("_share") + chance).cast("int")).where(F.col(times) > 0).select("doc_id", mine, times, first))
    rounds = told.agg(F.coalesce(F.max(first), F.lit(0))).first()[0] + 1
    keyed = told.withColumnsRenamed({"doc_id": f"{mine}_id", mine: f"{mine}_of"})
    out = hashed.join(keyed.hint("merge"), hashed["doc_id"].eqNullSafe(keyed[f"{mine}_id"]) & (hashed[mine] == keyed[f"{mine}_of"]))
    places = F.transform(F.sequence(F.lit(0), F.col(times) - 1), lambda k: F.col(first) + k * (rounds // 2))
    spread = out.select(*docs.columns, F.explode(places).alias(at))
    return spread.repartitionByRange(at).sortWithinPartitions(at).select(*docs.columns)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
