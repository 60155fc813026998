"""Prefix tries, filter orders and nearest neighbours against brute force, with nulls, ties, repeated rows, long texts, empty tables and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import _ranged, filter_audit, neighbours, prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_aggregates_over_ranges(spark):
    """One group of more than half of all rows, others of one row each and of a few."""
    rng = random.Random(3)
    rows = [(g, i, rng.randint(-9, 9)) for g, n in [(5, 400), *((k, 1 + k % 3) for k in range(10, 120))] for i in range(n)]
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(5)
    v = F.col("v")
    got = _ranged.over_ranges(df, ["g"], ["i"], running={"s": (v, "sum"), "x": (F.xxhash64("v"), "xor"), "low": (v, "min")}, total={"all": (v, "sum"), "high": (v, "max"), "at": (F.struct("v", "i"), "max")}).collect()
    hashes = {r.v: r.h for r in df.select("v", F.xxhash64("v").alias("h")).distinct().collect()}
    assert len(got) == len(rows)
    by = {g: [r for r in rows if r[0] == g] for g in {r[0] for r in rows}}
    for r in got:
        seen, mine = [x[2] for x in by[r.g][: r.i + 1]], [x[2] for x in by[r.g]]
        x = 0
        for value in seen:
            x ^= hashes[value]
        assert (r.s, r.x, r.low, r["all"], r.high) == (sum(seen), x, min(seen), sum(mine), max(mine))
        assert tuple(r["at"]) == max((x[2], x[1]) for x in by[r.g])


TURNS = "conv_id long, turn long, role string, text string, depth int, owner string, n int"


def talks():
    """Conversations that share prefixes, whole copies of others, ones with null turns, roles and texts, a very long one, and one that lends its turns to all."""
    rng = random.Random(11)
    said = ["hello there", None, "", "a b  c\td", "long " * 400, "ünï cödé", "x"]
    out = []
    for c in [*range(60), 100, 119, 131]:
        if c % 7 == 3:
            continue
        like = rng.choice([c, c - c % 20, 0, 5])
        r2 = random.Random(like)
        for t in range(r2.choice([1, 2, 3, 4, 6])):
            out.append((c, t, r2.choice(["user", "assistant", None]), r2.choice(said), 1, "o", 2))
    out += [(7, None, "system", "first of all", 0, "o", 0), (7, None, None, None, 0, "o", 0), (41, 0, "user", "x", 0, "o", 0), (41, 0, "user", "x", 0, "o", 0), (None, 1, "user", "lost", 0, "o", 0)]
    out += [(200, t, "user", f"turn {t % 3}", 0, "o", 0) for t in range(300)]
    return out


def rebuilt(rows):
    own = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, x) for *_, r, _, x in sorted(v)] for c, v in own.items()}
    heads = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: heads[c]] + own[c][heads[c] :] for c in own}


def trie_by_hand(seqs):
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    nodes = {}
    for path, m in members.items():
        below = [q for q in members if q[: len(path)] == path]
        kids = [q for q in below if len(q) == len(path) + 1]
        ends = sorted(c for c in m if len(seqs[c]) == len(path))
        leaves = sum(not any(len(q) == len(b) + 1 and q[: len(b)] == b for q in below) for b in below)
        saved = sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in below if q)
        nodes[min(m), len(path)] = (min(members[path[:-1]]) if path else None, len(m), len(kids), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return nodes


def as_nodes(df):
    rows = df.collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def test_trie_against_brute_force(spark, tmp_path):
    spark.createDataFrame(talks(), TURNS).repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = as_nodes(prefix_trie.op11_prefix_trie(spark, str(tmp_path)))
    assert got == trie_by_hand(rebuilt(talks()))


def test_trie_of_many_copies_without_heads(spark):
    """A list of ids longer than one string, and no lent turns."""
    rows = [(c, t, "user", f"t{t}", 0, "", 0) for c in range(2500) for t in range(2)] + [(9999, 0, "user", "t0", 0, "", 0)]
    df = spark.createDataFrame(rows, TURNS).repartition(6)
    got = as_nodes(prefix_trie.trie(prefix_trie.sequences(prefix_trie.turns(df))))
    ids = hashlib.sha256(",".join(map(str, range(2500))).encode()).hexdigest()
    nothing = hashlib.sha256(b"").hexdigest()
    assert got == {(0, 0): (None, 2501, 1, 1, 2500 + 2499, nothing), (0, 1): (0, 2501, 1, 1, 2500 + 2499, hashlib.sha256(b"9999").hexdigest()), (0, 2): (0, 2500, 0, 1, 2499, ids)}


def test_trie_of_nothing(spark, tmp_path):
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/a/conversations.parquet")
    assert prefix_trie.op11_prefix_trie(spark, f"{tmp_path}/a").collect() == []
    spark.createDataFrame([(None, 1, "user", "x", 0, "", 0)], TURNS).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert prefix_trie.op11_prefix_trie(spark, f"{tmp_path}/b").collect() == []


DOCS = "doc_id long, text string, lang string, source string, n_chars long, state int, removed long, good boolean"


def papers():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t\n", "A" * 30, "few words", "$ " * 60, "same text of five words"] * 2 + ["BIG " * 80, "x" * 30_000, " ".join(vocabulary) * 20]
    texts += [" ".join(rng.choices(vocabulary[: rng.choice([20, 300])], k=rng.choice([10, 49, 50, 60, 120]))) + rng.choice(["", " $", " ABCDEFGHIJKLMNOPQRSTUVWXYZ", "\x1c|"]) for _ in range(60)]
    texts += texts[20:40]
    rows = [(i, t, "en", [None, "s1", "s2", ""][i % 4], 0, 1, 1, True) for i, t in enumerate(texts)]
    return rows + [rows[30], (None, texts[25], "en", "s1", 0, 1, 1, True), (None, texts[25], "en", "s2", 0, 1, 1, True)]


def test_orders_against_brute_force(spark, tmp_path):
    rows = papers()
    rng = random.Random(6)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, 2])) for i in range(0, 80, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = filter_audit.op12_filter_audit(spark, str(tmp_path)).collect()
    fails, good, toxic = [], [], []
    for i, text, _, source, *_ in rows:
        t = text or ""
        w = WORD.findall(t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows)
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": copy}
        fails.append((source or "", {k for k, v in bad.items() if v}))
        good.append(i is not None and any(j == i and q == 1 for j, q, _ in labels))
        toxic.append(i is not None and any(j == i and x == 1 for j, _, x in labels))
    want, shapley = {}, {}
    for part in {p for p, _ in fails}:
        for order in itertools.permutations("ABCDE"):
            left = [k for k, (p, _) in enumerate(fails) if p == part]
            everyone = list(left)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if f in fails[k][1]]
                left = [k for k in left if f not in fails[k][1]]
                all_fail = sum(f in fails[k][1] for k in everyone)
                want[part, "".join(order), step] = [len(left), len(gone), all_fail - len(gone), sum(fails[k][1] == {f} for k in everyone), sum(good[k] for k in gone), sum(toxic[k] for k in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] for r in got}
    assert len(got) == len(found) and found == want
    assert all(r.shapley == shapley[r.part, r.filter_order[r.step - 1]] for r in got)


def test_sets_of_filters_share_their_survivors(spark):
    df = spark.createDataFrame([(i, "p", i % 2 == 0, i % 3 == 0, i % 5 == 0) for i in range(30)], "id int, part string, x boolean, y boolean, z boolean")
    nodes = filter_audit.survivors(df, ["x", "y", "z"])
    assert sorted(nodes) == list(range(7))  # 2^3 - 1 tables for 3! orders
    for state, left in nodes.items():
        assert {r.id for r in left.collect()} == {i for i in range(30) if not any(state >> k & 1 and i % (2, 3, 5)[k] == 0 for k in range(3))}
    with pytest.raises(ValueError):
        filter_audit.audit(df, list("abcdefgh"), "part", [])


def test_orders_of_nothing(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert filter_audit.op12_filter_audit(spark, str(tmp_path)).collect() == []


VECTORS = "vec_id long, embedding array<float>, label int, id long, code string, score double"


def test_every_code_within_a_radius_is_found_once(spark):
    """Pigeonhole probing against all pairs of codes, for each number of substrings and for shards of several blocks."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8)).round(3)
    x[100:200] = x[0] + 0.05 * rng.normal(size=(100, 8)).round(3)
    model = neighbours.Rotations(x)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<double>")
    index, asked = neighbours.coded(df, model).cache(), neighbours.asked(df.where("id % 6 = 0"), model, (np.arange(5), x[:5]), 300).cache()
    rows, queries = model.codes(x, False), model.codes(x, True)
    away = np.bitwise_count(queries[:, None] ^ rows[None]).sum(2, dtype=int)
    for r, parts, name in [(20, 2, 0), (40, 4, 3), (33, 8, 2), (17, 16, 4), (3, 16, 1), (256, 4, 2)]:
        got = neighbours.search(index, asked, r, 300, 300, 50, splits=(parts, name)).collect()
        pairs = [(g.query_id, g.vec_id) for g in got]
        assert len(set(pairs)) == len(pairs)
        assert set(pairs) == {(q, v) for q in range(0, 300, 6) for v in range(300) if q != v and away[q, v] <= r}, (r, parts)
        assert all(abs(g.score - float(x[g.query_id] @ x[g.vec_id])) < 1e-12 for g in got)


def test_shares_hold_every_split_of_the_radius():
    for r, parts in [(5, 2), (7, 4), (16, 16), (3, 4), (0, 2)]:
        most = neighbours.shares(r, parts)
        for parted in itertools.product(range(r + 1), repeat=parts) if parts < 5 else [[1] * 16, [0] * 15 + [16]]:
            if sum(parted) <= r:
                assert any(a <= b for a, b in zip(parted, most, strict=True))


def exact(rows, nearest, every):
    """Nearest by hand of the rows that take part."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 6 and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    found = {}
    for q, a in ok:
        if q % every == 0:
            best = {}
            for i, b in ok:
                if i != q:
                    best[i] = max(best.get(i, -1e99), sum(float(s) * float(t) for s, t in zip(a, b, strict=True)))
            for i, s in best.items():
                found.setdefault(q, {})[i] = max(s, found.get(q, {}).get(i, -1e99))
    return {q: sorted(((-s, i) for i, s in d.items()))[:nearest] for q, d in found.items()}


def test_neighbours_against_brute_force(spark, tmp_path):
    """Recall with the shipped parameters; clusters, vectors of very different lengths, copies, and rows that take no part."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    x = [(i, [float(np.float32(v)) for v in (centres[i % 12] + 0.2 * rng.normal(size=6)) * rng.choice([0.3, 1, 4])]) for i in range(600)]
    x += [(700 + i, x[40][1]) for i in range(60)]
    x += [(900, None), (920, [0.0] * 6), (940, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (960, [float("nan")] + [1.0] * 5), (980, [float("inf")] + [1.0] * 5), (1000, [1.0] * 5), (1020, []), (None, [1.0] * 6), x[20], (40, x[41][1])]
    df = spark.createDataFrame([(i, v, 0, -1, "c", 0.5) for i, v in x], VECTORS).repartition(5)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = neighbours.op13_nearest_neighbours(spark, str(tmp_path)).collect()
    want = exact(x, 20, 20)
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got.keys() == want.keys() and all(len(g) == 20 and g == sorted(g) for g in got.values())
    hits = [len({i for _, i in got[q]} & {i for _, i in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    scores = {q: dict((i, -s) for s, i in exact([y for y in x], 10_000, 20)[q]) for q in list(want)[:5]}
    assert all(abs(-s - scores[q][i]) < 1e-9 for q in scores for s, i in got[q])


def test_few_vectors_give_all_of_them(spark):
    make = lambda rows: neighbours.neighbours(spark.createDataFrame([(i, v, 0, 0, "", 0.0) for i, v in rows], VECTORS), "vec_id", "embedding", F.col("id") % 20 == 0, 20).orderBy("query_id", "rank").collect()
    few = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [-5.0, 0.0]), (20, [1.0, 0.0])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in make(few)]
    assert got == [(0, 1, 2, 1.0), (0, 2, 20, 1.0), (0, 3, 1, 0.0), (0, 4, 3, -5.0), (20, 1, 0, 1.0), (20, 2, 2, 1.0), (20, 3, 1, 0.0), (20, 4, 3, -5.0)]
    assert make([]) == [] and make([(0, [1.0])]) == [] and make([(1, [1.0]), (2, [1.0])]) == []


def test_near_neighbours_prune_shards():
    """Where neighbours are near, most of the index isn't probed."""
    parts, name = neighbours.split(20, 10_000_000, 500_000)
    assert parts == 16 and name == 12
    assert neighbours.split(105, 50_000, 2_500)[0] == 2
