"""The operators by their methods: ids untouched, planted cases, sequences, ownership, the index's plan, gradients, sketches, blocks, the pipeline on odd tables."""

import collections
import random
import re
import string

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import exact_dedup, fingerprints, license_scan, mixing, near_dedup, pii, piece_codec, quality, secrets, url_filter

BIG = 2**60
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def said(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_ids_come_out_as_they_are(spark):
    """Large ids beside a null one in the same batch."""
    notice = license_scan.TEMPLATES["mit-line"]
    rows = [(BIG + 1, f"mail ann@example.org {notice}"), (None, f"mail bob@example.org {notice}"), (BIG + 3, f"mail eve@example.org {notice} and more words of its own")]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    ids = {BIG + 1, None, BIG + 3}
    assert {r.doc_id for r in pii.find(d, None).collect()} == ids
    assert {r.doc_id for r in license_scan.scan(d).collect()} == ids
    near = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_duplicates(d).collect()}
    assert near == {BIG + 1: (BIG + 1, True), None: (None, True), BIG + 3: (BIG + 3, True)}
    text_ids = spark.createDataFrame([("a", notice), (None, notice)], "doc_id string, text string")
    assert {r.doc_id for r in license_scan.scan(text_ids).collect()} == {"a", None}


def test_field_finds_planted_mentions(spark):
    """Later mentions in another form are found (recall of 0.9 at least) with weights learnt from the documents, and other numbers are left alone."""
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows, planted = [], {}
    for i in range(400):
        rest, name, place = digits(8), f"{said(rng, 1)}.{said(rng, 1)}", said(rng, 30)
        phone, typo = f"+44 20 {rest[:4]} {rest[4:]}", "20" + rest[:3] + str((int(rest[3]) + 1) % 10) + rest[4:]
        kind = i % 4
        first = f"call {phone} or {name}@mail.example.org"
        later = [f"0{'20'} {rest[:4]} {rest[4:]}", f"{rest[:4]} {rest[4:]}", typo, name.title().replace(".", " ")][kind]
        rows.append((i, f"{first} {place} later {later} and {rng.randint(2, 9)} apples in {rng.randint(1900, 2020)}, {rng.randint(2, 9)} pears"))
        planted[i] = later
    rows += [(1000 + i, f"{said(rng, 20)} {rng.randint(10, 9999)} items, {rng.randint(1900, 2020)} {said(rng, 9)}") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    w = pii.train(d)
    found, false = 0, 0
    for r in pii.find(d, w).collect():
        text = rows[r.doc_id][1] if r.doc_id < 1000 else None
        linked = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("linked")]
        if text is None:
            false += len(linked)
            continue
        at = text.rindex(planted[r.doc_id])
        hit = [s for s in linked if s[0] < at + len(planted[r.doc_id]) and at < s[1]]
        found += bool(hit)
        false += len(linked) - len(hit)
    assert found >= 0.9 * len(planted) and false <= 0.01 * len(rows), (found, false)


def test_points_decide_the_order_of_the_mix(spark):
    rng = random.Random(2)
    d = spark.createDataFrame([(i, said(rng, rng.randint(5, 60)), "en", "abc"[i % 3], 0) for i in range(300)], SCHEMA)
    golden = {r.doc_id: (r.first_slot, r.taken) for r in mixing.mix(d, block=16).collect()}
    other = {r.doc_id: (r.first_slot, r.taken) for r in mixing.mix(d, block=16, step=0.25).collect()}
    assert {k: v[1] for k, v in golden.items()} == {k: v[1] for k, v in other.items()}  # what is taken follows from the targets
    assert sum(golden[k][0] != other[k][0] for k in golden) > 100  # when, from the points
    order = [r.doc_id for r in mixing.mixed_documents(d, block=16).collect()]
    assert set(order) <= set(golden)
    firsts = [golden[k][0] for k in dict.fromkeys(order)]
    assert firsts == sorted(firsts)  # documents come in the order of their slots
    t = spark.createDataFrame([("sa", 5000, 6000.0), ("sb", 4000, 3000.0)], "src string, source_size long, target double")
    gap = lambda step: max(abs(sum(r.src == "sa" for r in rows[: k + 1]) - 2 / 3 * (k + 1)) for rows in [sorted(mixing.schedule(spark, t, 10, step).collect())] for k in range(len(rows)))
    assert gap(mixing._PHI_STEP) < 3 < gap(0.001)  # the discrepancy of any beginning of the schedule


def test_ownership_is_counted_and_decides(spark):
    example, mine = "Ex4mple" + "Ke9Yz" * 4, "Qw8rTy" + "2uIoP" * 4
    rows = [(1, f"use {example}", "s1"), (2, f"use {example} twice {example}", "s2"), (3, f"use {example}", "s2"), (4, f"my {mine}", "s3"), (5, f"my {mine}", "s3"), (5, f"my {mine}", "s3")]
    found = secrets.candidates(spark.createDataFrame([(i, s, str(k), t) for i, (k, t, s) in enumerate(rows)], "row long, owner string, repo string, text string").withColumn("matches", secrets._all_matches(F.col("text"))))
    assert "value" not in found.columns and not [c for c, kind in found.dtypes if kind == "string" and c not in ("owner", "repo")]
    assert sorted((r.owners, r.repositories, r.uses) for r in secrets.ownership(found).collect()) == [(1, 2, 3), (2, 3, 4)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r.doc_id for r in got if any(f.kind_no == 3 for f in r.findings)) == [4, 5, 5]
    # many matches of one text, and a column of the same name as one of ours
    many = spark.createDataFrame([(7, ("0af" * 9 + " ") * 20_000, "s", 1)], "doc_id long, text string, source string, row int")
    one = secrets.scan(many, keep=("doc_id", "row")).first()
    assert len(one.findings) == 20_000 and [(f.start, f.end) for f in one.findings[:2]] == [(0, 27), (28, 55)] and one.findings[-1].end == 28 * 20_000 - 1
    with pytest.raises(ValueError, match="findings"):
        secrets.scan(many.withColumn("findings", F.lit(1)), keep=("findings",))


def test_index_is_read_by_bucket(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        before = {t.name for t in spark.catalog.listTables()}
        docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 300).alias("text"))
        index = exact_dedup.DigestIndex(spark, buckets=3)
        first = exact_dedup.dedup(docs.where("doc_id < 200"), index)
        assert first.where("kept").count() == 200 and index.table().count() == 200
        groups = docs.select(exact_dedup.text_digest(F.col("text")).alias("digest"), F.col("doc_id").alias("keep_id"))
        plan = index.absent(groups)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange") == 1  # the batch's own
        second = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup(docs.where("doc_id >= 200"), index).collect()}
        assert second[250] == (250, True) and second[350] == (50, False) and second[499] == (199, False) and index.table().count() == 300
        rows = sorted(map(tuple, index.table().collect()))
        index.compact()
        assert sorted(map(tuple, index.table().collect())) == rows and len(index.table().inputFiles()) == 3 and exact_dedup.DigestIndex(spark, index.name).buckets == 3
        index.drop()
        two = exact_dedup.dedup(docs, batches=3)
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in two.collect()} == {i: (i % 300, 1 + (i % 300 < 200), i < 300) for i in range(500)}
        assert {t.name for t in spark.catalog.listTables()} == before  # nothing is left of indexes made for a call
        shared = spark.createDataFrame([(1, "a", 7, 8), (1, "b", 7, 8), (1, "b ", 7, 8), (2, "a", 7, 8)], "doc_id long, text string, own_digest int, exact_text_hash int")
        kept = exact_dedup.drop_copies(shared)
        assert kept.columns == shared.columns and sorted((r.doc_id, r.text.strip(), r.own_digest, r.exact_text_hash) for r in kept.collect()) == [(1, "a", 7, 8), (1, "b", 7, 8), (1, "b", 7, 8)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_pieces_of_long_texts_and_null_keys(spark, monkeypatch):
    rng = random.Random(8)
    long = "".join(rng.choice(string.ascii_letters) for _ in range(30_000)) + " " + said(rng, 2000)
    d = spark.createDataFrame([(1, long), (None, "some plain words here " * 20), (2, long[:50])], "doc_id long, text string")
    whole = {r.doc_id: r.ids for r in piece_codec.encode(d).collect()}
    assert all(r.lossless for r in piece_codec.encode(d, check=True).collect())
    v = piece_codec.load()
    chunks = piece_codec.chunks_of(long)
    assert "".join(chunks) == long and max(map(len, chunks)) == piece_codec.LONGEST_CHUNK
    seeds = np.array([xxhash.xxh3_64_intdigest(b"k1", piece_codec.SEED)], np.uint64)
    monkeypatch.setattr(piece_codec, "CHARS_AT_ONCE", 5000)  # slices change nothing but memory
    assert piece_codec._encode(v, [long], seeds)[1].tolist() == whole[1]
    named = spark.createDataFrame([("None", "some plain words here " * 20)], "doc_id string, text string")
    assert piece_codec.encode(named).first().ids != whole[None]


def test_risk_has_its_gradient():
    rng = np.random.default_rng(1)
    p, u = rng.normal(1, 1, (40, 3)), rng.normal(0, 1, (60, 3))
    seen = set()
    for prior in (0.3, 0.95):
        for _ in range(12):
            w = rng.normal(0, 2, 4)
            value, gradient = quality.risk(w, p, u, prior, 0.01)
            step = np.array([(quality.risk(w + h, p, u, prior, 0.01)[0] - quality.risk(w - h, p, u, prior, 0.01)[0]) / 2e-6 for h in 1e-6 * np.eye(4)])
            assert np.allclose(step, gradient, atol=1e-5)
            zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            seen.add(negative < 0)
            want = -negative if negative < 0 else prior * np.logaddexp(0, -zp).mean() + negative + 0.005 * w[:-1] @ w[:-1]
            assert np.isclose(value, want)
    assert seen == {True, False}


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    """Chains and near copies in clusters of many blocks, against all pairs; rows that share an id are judged by their own text."""
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(w if rng.random() > 0.012 else f"e{rng.random()}" for w in base) for _ in range(40)]
    step = list(base)
    for k in range(25):  # each differs from the one before by a word: linked in a chain
        step[(7 * k) % 120] = f"s{k}"
        texts.append(" ".join(step))
    texts += [said(rng, 40) for _ in range(10)]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(d, percent=85).collect()} == {i: top(i) for i in range(len(texts))}
    both = spark.createDataFrame([(5, texts[0], 1), (5, texts[-1], 2), (3, texts[0] + " more", 3), (9, texts[-1], 4), (9, texts[-1], 4)], "doc_id long, text string, near_text_hash int")
    kept = near_dedup.keep_one(both)
    assert kept.columns == both.columns and sorted((r.doc_id, r.near_text_hash) for r in kept.collect()) == [(3, 3), (5, 2)]


def shingle_hashes(text):
    words = re.sub("[A-Z]", lambda m: m.group().lower(), text).split(" ")
    words = [w for w in words if w]

    def one(group):
        h = 42
        for w in group:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        return h - 2**64 if h >= 2**63 else h

    return {one(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def sketch(hashes):
    return sorted({h for h in hashes if h < -(2**63) + 2**64 // fingerprints.FRACTION} | ({min(hashes)} if hashes else set()))


def test_sketches_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    texts = ["", "One two", said(rng, 5), said(rng, 300), said(rng, 900)]
    texts += [texts[3] + " " + said(rng, 100), texts[3].upper(), texts[4][:2000]]
    rows = [(i * 7, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    likeness = lambda a, b: 1.0 if not a and not b else 0.0 if not a or not b else len(set(a) & set(b)) / min(len(a), len(b))
    order = sorted(dict(rows), reverse=True)
    for r in fingerprints.op10_document_fingerprints(spark, str(tmp_path)).collect():
        text, after = dict(rows)[r.doc_id], dict(rows)[order[(order.index(r.doc_id) + 1) % len(order)]]
        cut = len(text) // 3
        own, edited, other = (sketch(shingle_hashes(t)) for t in (text, text[: len(text) - cut] + after[:cut], after))
        say = lambda s: "".join(f"{h % 2**64:016x}" for h in s)
        assert (r.fingerprint, r.edited_fingerprint) == (say(own), say(edited))
        assert (r.near_edited, r.near_next) == (pytest.approx(likeness(own, edited)), pytest.approx(likeness(own, other)))
    parts = spark.createDataFrame([(texts[3], texts[4], "")], "a string, b string, c string").select(fingerprints.merged(F.array(*[fingerprints.fingerprint(F.col(c)) for c in "abc"]))).first()[0]
    assert parts == sketch(shingle_hashes(texts[3]) | shingle_hashes(texts[4]))


def test_scan_against_alignment_everywhere(spark):
    """Every template at every offset of short documents by full dynamic programming: what reaches the coverage is found, nothing else."""
    rng = random.Random(9)
    names = ["bsd-3-clause", "isc", "mit-line", "mpl-2.0-notice", "cc-by-4.0-line"]
    own = {n: license_scan.TEMPLATES[n] for n in names}
    own["no-words"] = " ... "
    index, hashes = license_scan.Index(own), license_scan._hasher()
    rows = []
    for i in range(60):
        words = own[names[i % 5]].split()
        for _ in range(rng.randint(0, 1 + len(words) // 4)):
            k = rng.randrange(len(words))
            words[k : k + 1] = [[], ["changed"], [words[k], "added"]][rng.randrange(3)]
        rows.append((i, said(rng, rng.randint(0, 30)) + " " + " ".join(words) + " " + said(rng, rng.randint(0, 30))))
    got = collections.defaultdict(dict)
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), own).collect():
        got[r.doc_id][r.license] = r.coverage
    for i, text in rows:
        words = hashes(text)
        for name in names:
            template = index.words[name]
            best = max(license_scan.align(template, words, o, license_scan._band(template))[0] for o in range(-len(template), len(words)))
            if best >= 0.8 * len(template):
                assert got[i].get(name, 0) == pytest.approx(best / len(template)), (i, name)
            else:
                assert name not in got[i]
    assert license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), {}).count() == 0


def test_rules_of_many_paths_and_no_links(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x/1", None), (2, "http://b.com/y", ""), (None, "http://c.org/", ""), (2, "http://b.com/y", "")], "page_id long, url string, html string")
    rules = url_filter.rule_table(spark, [("block", f"com/{c}") for c in "xyz"] + [("allow", "b.com/"), ("block", "b.com/yy")])
    out = url_filter.judge(pages, rules).collect()
    # the longer of com/y and b.com/ wins
    assert sorted((str(r.page_id), str(r.rule), r.verdict) for r in out) == [("1", "com/x", "block"), ("2", "b.com/", "allow"), ("2", "b.com/", "allow"), ("None", "None", "allow")]
    named = pages.select("page_id", url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    pick = lambda **k: sorted((str(r.page_id), str(r.rule)) for r in url_filter.match_rules(named, rules, **k).collect())
    assert pick() == pick(most_broadcast=0)
    none = url_filter.judge(pages, url_filter.rule_table(spark, [("block", "net/")])).collect()
    assert {r.verdict for r in none} == {"allow"} and {r.trust for r in none} == {0.0}


def test_pipeline_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    good = [said(rng, rng.randint(40, 90), "etaoinshrdl").capitalize() + "." for _ in range(60)]
    rows = [(i, t, "en", "abc"[i % 3], len(t)) for i, t in enumerate(good)]
    rows += [(100, None, None, None, None), (101, "", "en", "a", 0), (None, good[0], "en", "a", 1), (None, None, None, None, None), (102, good[1], "en", "b", 1), (1, good[1], "en", "b", 1), (103, good[2] + " tail", "en", "c", 1), (104, "x" * 40_000, "en", "a", 40_000)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 1, 0), (104, 0, 0)], "doc_id long, quality int, toxic int")
    clash = {c: F.lit(1) for c in ("score", "digest", "kept", "row", "mixed_at", "near_text_hash", "component_id", "ids")}
    for name, docs in (("odd", spark.createDataFrame(rows, SCHEMA).withColumns(clash)), ("empty", spark.createDataFrame([], SCHEMA))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    texts = collections.Counter(r.doc_id for r in out)
    assert all(r.lossless for r in out) and 102 not in texts and texts[5] >= 1 and not {101, 100} & set(texts)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    docs = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/odd")
        assert docs.columns[-len(clash) :] == list(clash)
