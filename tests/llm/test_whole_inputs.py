"""Operators on all of their input: far hosts, many copies, documents without base spans, short notices."""

import numpy as np

from ledgerloom.llm import exact_dedup, license_scan, pii, secrets, url_filter


def test_ranks_settle_on_rings_and_reach_far_hosts(spark):
    """With the parameters of the query: a ring that keeps its mass, and a chain of 24 hosts behind it."""
    edges = [("a", "b", 1), ("b", "a", 3), ("b", "h00", 1)] + [(f"h{i:02}", f"h{i + 1:02}", 2) for i in range(23)]
    names = sorted({x for e in edges for x in e[:2]})
    m = np.zeros((len(names), len(names)))
    for s, t, n in edges:
        m[names.index(t), names.index(s)] = n / sum(x for y, _, x in edges if y == s)
    m[:, names.index("h23")] = np.array(names) == "a"  # the last host leads nowhere: its rank restarts
    want = np.linalg.solve(np.eye(len(names)) - url_filter.DAMPING * m, (1 - url_filter.DAMPING) * (np.array(names) == "a"))
    got = {r.host: r["rank"] for r in url_filter.propagate(spark.createDataFrame([("a", 1.0)], "host string, weight double"), spark.createDataFrame(edges, "src string, dst string, links long")).collect()}
    assert sorted(got) == names and abs(sum(got.values()) - 1) < 1e-4
    assert all(abs(got[h] - w) <= url_filter.ENOUGH * w for h, w in zip(names, want, strict=True))


def test_copies_of_one_owner_stay_live(spark):
    """A value of one owner in six documents, exact and near copies, is live; one of two owners is not, nor is one of no owner in four documents."""
    mine, shared, lost = "Zx9" + "aB3" * 9, "Qy8" + "cD4" * 9, "Wv7" + "eF5" * 9
    rows = [(i, f"see {mine} here" + " again" * (i % 2), "s1") for i in range(6)] + [(10, f"a {shared}", "s1"), (11, f"a {shared}", "s2")] + [(20 + i, f"b {lost}", None) for i in range(4)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id for r in got if any(f.kind_no == 3 for f in r.findings)} == set(range(6))


def test_field_judges_documents_without_base_spans(spark):
    text = "ask for 4471-882-19 today and not 17 but 4471-882-19 again"
    w = np.zeros(pii.N_FEATURES + 2)
    w[0], w[-1] = 3.0, 1.0
    rows = [(1, text), (2, text + " or ann@mail.example.org"), (3, "no 4471-882-19 twice"), (4, "")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), w).collect()}
    assert [got[1].n_linked, got[2].n_linked, got[3].n_linked, got[4].n_linked] == [2, 2, 0, 0]
    assert got[1].spans == ",".join(f"linked:{i}:{i + 11}" for i in (text.index("4471"), text.rindex("4471")))


def test_short_notices_with_any_word_changed_are_found():
    index, hashes = license_scan.Index(license_scan.TEMPLATES), license_scan._hasher()
    found = lambda text: {m[0] for m in license_scan.matches(index, text, hashes(text), license_scan.MIN_COVERAGE)}
    assert found("see: Released under an MIT License, and so on") == {"mit-line"}
    for name, template in index.short.items():
        words = license_scan.TEMPLATES[name].split()
        for i in range(len(words)):
            text = "start " + " ".join([*words[:i], "changed", *words[i + 1 :]]) + " end"
            own = hashes(text)
            if license_scan.align(template, own, 1, 8)[0] >= license_scan.MIN_COVERAGE * len(template):
                assert found(text), (name, text)
    assert found("the under license mit " * 3) <= {"mit-line"} and not found("license " * 500)


def test_an_index_outlives_a_driver_lost_while_it_compacts(spark, monkeypatch):
    """Stopped before each of the steps in turn: the next one to open the index finds all digests, and compacts it."""
    rows = lambda i: sorted((r.digest, r.keep_id) for r in i.table().collect())
    for stop in range(3):
        index = exact_dedup.DigestIndex(spark, f"lost_{stop}", buckets=2)
        for k in range(3):
            index.append(spark.createDataFrame([(f"d{k}{j}", k) for j in range(4)], "digest string, keep_id long"))
        want, said = rows(index), []

        def sql(self, text, *a, run=type(spark).sql, said=said, stop=stop, **b):
            if text.startswith(("ALTER", "DROP TABLE lost")) and "IF EXISTS" not in text:
                said.append(text)
                if len(said) > stop:
                    raise RuntimeError("lost")
            return run(self, text, *a, **b)

        with monkeypatch.context() as m:
            m.setattr(type(spark), "sql", sql)
            try:
                index.compact()
            except RuntimeError:
                pass
        again = exact_dedup.DigestIndex(spark, f"lost_{stop}")
        assert len(said) == stop + 1 and rows(again) == want and again.buckets == 2
        again.compact()
        assert rows(again) == want and len(again.table().inputFiles()) <= 2
        assert [t.name for t in spark.catalog.listTables() if t.name.startswith(f"lost_{stop}")] == [f"lost_{stop}"]
        again.drop()
