"""Solvers against brute force, constraints from rules, workbook files."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import constraints, derive, evaluate, solve
from ledgerloom.session import bounded, numbered
from ledgerloom.sources import workbook

TERM = "component int, eq string, key string, coef double, rhs double, start double, fixed boolean, kind string"


def test_exact_on_a_hierarchy_of_many_cells():
    """A tree of 45,005 cells and 15,005 equations is one component."""
    rng = random.Random(1)
    level = [f"l{i}" for i in range(30_000)]
    start, terms, n = {k: float(rng.randint(0, 999)) for k in level}, [], 0
    while len(level) > 1:
        above = []
        for i in range(0, len(level), 3):
            terms.append((f"e{n:06}", f"t{n}", 1.0, 0.0, 0.0, False, "="))
            terms += [(f"e{n:06}", k, -1.0, 0.0, start.get(k, 0.0), k in start, "=") for k in level[i : i + 3]]
            above.append(f"t{n}")
            n += 1
        level = above
    s = solve.System(terms)
    x, consistent = s.exact()
    assert consistent and len(s.keys) > 45_000 and x[s.keys.index(level[0])] == sum(start.values())


def test_exact_against_dense_elimination():
    rng = np.random.default_rng(3)
    for _ in range(40):
        a = rng.integers(-3, 4, (4, 5)).astype(float)
        b = a @ rng.integers(-5, 6, 5) if rng.random() < 0.7 else rng.integers(-9, 10, 4).astype(float)
        s = solve.System([(f"e{i}", f"k{j}", a[i, j], float(b[i]), float(j), False, "=") for i in range(4) for j in range(5)])
        x, consistent = s.exact()
        rank = np.linalg.matrix_rank
        assert consistent == (rank(a) == rank(np.c_[a, b]))
        assert np.allclose(a @ x, b) if consistent else np.allclose(x, range(5))


def test_least_change_against_all_whole_points():
    rng = np.random.default_rng(0)
    for _ in range(25):
        a, start, inside = rng.integers(-1, 2, (2, 3)), rng.integers(0, 6, 3).astype(float), rng.integers(0, 6, 3)
        b = a @ inside
        terms = [(f"e{r}", f"k{i}", float(a[r, i]), float(b[r]), start[i], False, ("=", "<=")[r]) for r in range(2) for i in range(3)]
        best = min(np.abs(np.array(z) - start).sum() for z in itertools.product(range(12), repeat=3) if a[0] @ z == b[0] and a[1] @ z <= b[1])
        x, held = solve.System(terms).least_change()
        assert held and abs(np.abs(x - start).sum() - best) < 1e-4 and x.min() >= 0
        x, held = solve.System(terms).least_change(whole=True)
        assert held and (x == np.rint(x)).all()


def test_what_cannot_hold_is_reported():
    x, held = solve.System([("a", "x", 1.0, 5.0, 0.0, False, "="), ("b", "x", 1.0, 7.0, 0.0, False, "=")]).least_change()
    assert not held and 5 - 1e-6 <= x[0] <= 7 + 1e-6


def test_least_squares_against_dense_ones(spark):
    """Components of a few equations, more or fewer than cells, fixed cells, and what can't hold, all at once."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for comp in range(12):
        m, n = int(rng.integers(1, 4)), int(rng.integers(1, 5))
        a, b, start, fixed = rng.integers(-3, 4, (m, n)).astype(float), rng.integers(-9, 10, m).astype(float), rng.integers(-5, 6, n) * 100.0, rng.random(n) < 0.2
        rows += [(comp, f"e{i}", f"k{j}", float(a[i, j]), float(b[i]), float(start[j]), bool(fixed[j]), "=") for i in range(m) for j in range(n)]
        free = a[:, ~fixed]
        step = np.linalg.pinv(free) @ (b - a @ start) if free.size else np.zeros(0)
        x = start.copy()
        x[~fixed] += step
        ok = bool((np.abs(a @ x - b) <= 1e-6 * np.maximum(1, np.maximum(np.abs(b), np.abs(a * x).max(1)))).all())
        want |= {(comp, f"k{j}"): (x[j], ok) for j in range(n)}
    got = {(r.component, r.key): (r.value, r.consistent) for r in solve.solve(spark.createDataFrame(rows, TERM).repartition(3), "least_squares").collect()}
    assert got.keys() == want.keys() and {ok for _, ok in want.values()} == {True, False}
    for k, (x, ok) in want.items():
        assert got[k][0] == pytest.approx(x, abs=1e-6) and got[k][1] == ok, k


def test_solve_with_nulls_and_without_rows(spark):
    rows = [(1, "e", "a", 1.0, None, None, None, None), (1, "e", "b", -1.0, None, 4.0, True, "="), (2, "f", "c", None, 0.0, 2.0, False, "="), (3, "g", "d", 0.000001, 3.0, 0.0, False, "=")]
    t = spark.createDataFrame(rows, TERM)
    got = {(r.component, r.key): (r.value, r.consistent) for r in solve.solve(t).collect()}
    assert got == {(1, "a"): (4.0, True), (1, "b"): (4.0, True), (2, "c"): (2.0, True), (3, "d"): (3e6, True)}
    for method in ("exact", "least_squares", "non_negative", "whole"):
        assert solve.solve(t.limit(0), method).count() == 0


@pytest.mark.parametrize("n", [1, 50])
def test_numbers_of_a_group_over_many_ranges(spark, n):
    rows = spark.range(n).select((F.col("id") % 2 == 0).alias("g"), F.when(F.col("id") % 5 > 0, "x").alias("h"), F.col("id").alias("o")).repartition(3)
    got = numbered(rows, ["g", "h"], ["o"]).collect()
    want = {}
    for i in range(n):
        want.setdefault((i % 2 == 0, "x" if i % 5 else None), []).append(i)
    assert {(r.g, r.h, r.o): r.place for r in got} == {(*k, o): j for k, v in want.items() for j, o in enumerate(v, 1)}


def test_distribution_of_one_large_group(spark):
    parts = spark.range(999).select(F.lit(None).cast("int").alias("g"), "id", (F.col("id") % 7).cast("double").alias("w"), F.lit(10_000).alias("total"))
    got = derive.distribute(parts, ["g"], "w", "total", ["id"]).agg(F.sum("assigned"), F.count("*")).first()
    assert tuple(got) == (10_000, 999)


def test_rollup_keeps_few_examples(spark):
    v = spark.range(100).select(F.lit("r").alias("code"), F.col("id").alias("inst"), (F.col("id") % 2 == 0).alias("ok"), F.lit(False).alias("any_absent"))
    r = evaluate.rule_rollup(v).first()
    assert (r.instances, r.failing, r.with_absent, r.examples) == (100, 50, 0, ["1", "3", "5"])


def test_large_catalogues_are_not_broadcast(spark):
    wide = spark.range(10).select(F.repeat(F.lit("x"), 1000).alias("x"))
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    assert "strategy=broadcast" in plan(bounded(wide)) and "strategy=broadcast" not in plan(bounded(wide, most_bytes=5000)) and "strategy=broadcast" not in plan(bounded(wide, most=5))


def test_rows_over_present_cells(spark):
    resolved = spark.createDataFrame([("v", "i", "<=", 0.0, 1.0, "a"), ("v", "i", "<=", 0.0, -1.0, "b"), ("v", "i", "<=", 0.0, 2.0, "a"), ("w", "i", "<=", 0.0, 1.0, "a"), ("w", "i", "<=", 0.0, -1.0, "a")], "code string, inst string, kind string, rhs double, coef double, key string")
    got = {(r.code, r.key): r.coef for r in constraints.over_present(resolved, spark.createDataFrame([("a",)], "key string")).collect()}
    assert got == {("v", "a"): 3.0}


def test_workbook_cells(spark, tmp_path):
    (tmp_path / "b.xlsx").write_bytes(workbook.file_of({"C01.00": [["x & y", 5], [], ["", "late"]], "Notes": [["n"]]}))
    t = workbook.read_workbooks(spark, str(tmp_path))
    assert sorted((r.sheet, r.row, r.col, r.value) for r in t.collect()) == [("C01.00", 0, 0, "x & y"), ("C01.00", 0, 1, "5"), ("C01.00", 2, 1, "late"), ("Notes", 0, 0, "n")]
    assert [r.kind for r in workbook.kinds(t).collect()] == ["annotated_templates"]
    assert workbook.records(t, {"a": "nothing"}).count() == 0
