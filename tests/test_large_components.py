"""Equation systems by component, of any size: none is put off, and what DataFrames and merged cells find is as good as brute force and as the solver of one component."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import solve

TERM = "component int, eq string, key string, coef double, rhs double, start double, fixed boolean, kind string"
N = 60_000


def row_of(cells, eq, rhs, kind="=", coef=1.0):
    eq, rhs, coef = (c if not isinstance(c, (str, float)) else F.lit(c) for c in (eq, rhs, coef))
    return cells.select(F.lit(1).alias("component"), eq.alias("eq"), "key", coef.alias("coef"), rhs.alias("rhs"), "start", F.lit(False).alias("fixed"), F.lit(kind).alias("kind"))


@pytest.fixture(scope="module")
def cells(spark):
    return spark.range(N).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 50).cast("double").alias("start"), (F.col("id") % 2 == 0).alias("even")).cache()


@pytest.mark.parametrize("method", ["whole", "non_negative"])
@pytest.mark.parametrize("rows", [1, 3])
def test_least_change_of_a_large_component(spark, cells, method, rows):
    """60,000 cells with caps of 90 of their own that one row couples, or three: all, the even ones and (at most) the odd ones."""
    have = sum(i % 50 for i in range(N))
    terms = row_of(cells, "all", 1.5 * have).unionByName(row_of(cells, F.concat(F.lit("cap"), "key"), 90.0, "<="))
    if rows == 3:
        terms = terms.unionByName(row_of(cells.where("even"), "even", 24.0 * N / 2 + 1000)).unionByName(row_of(cells.where("NOT even"), "odd", 1e6, "<=", 0.5))
    s = solve.solve(terms, method).join(cells, "key")
    got = s.agg(F.count("*"), F.sum("value"), F.sum(F.abs(F.col("value") - F.col("start"))), F.max("value"), F.min("value"), F.bool_and("consistent"), F.count("consistent"), F.sum(F.when(F.col("even"), F.col("value"))), F.bool_and(F.col("value") == F.rint("value"))).first()
    assert (got[0], got[5], got[6]) == (N, True, N) and got[3] <= 90 + 1e-6 and got[4] >= 0
    assert got[1] == pytest.approx(1.5 * have, abs=1e-2) and got[2] == pytest.approx(0.5 * have, abs=1e-2)
    assert (rows == 1 or got[7] == pytest.approx(24.0 * N / 2 + 1000, abs=1e-2)) and (method == "non_negative" or got[8])


def test_what_a_large_component_cannot_hold(spark, cells):
    """Misses are as small as can be: every cell goes to its cap."""
    terms = row_of(cells, "all", 1e7).unionByName(row_of(cells, F.concat(F.lit("cap"), "key"), 90.0, "<=", 2.0))
    got = solve.solve(terms, "whole").agg(F.sum("value"), F.max("value"), F.bool_or("consistent"), F.count("consistent")).first()
    assert tuple(got) == (45.0 * N, 45.0, False, N)


def test_exact_values_of_a_large_component(spark, cells):
    """Cents of 60,000 cells add up exactly; of cells that stand in the same rows one is told by them."""
    cents = cells.withColumn("start", F.col("start") + 0.1)
    terms = row_of(cents, "all", 2e6).unionByName(row_of(cents.where("even"), "even", 1e6)).unionByName(row_of(cents.where("key = 'k1'"), "odd", 7.5))
    s = solve.solve(terms).join(cents, "key")
    got = s.agg(F.count("*"), F.count(F.when(F.col("value") != F.col("start"), 1)), F.sum(F.col("value").cast("decimal(18,1)")), F.sum(F.when(F.col("even"), F.col("value").cast("decimal(18,1)"))), F.bool_and("consistent"), F.count("consistent")).first()
    assert (got[0], got[1], float(got[2]), float(got[3]), got[4], got[5]) == (N, 3, 2e6, 1e6, True, N)
    # what differs by a ten millionth of a cent does not hold
    known = cents.select("*").withColumn("fixed", F.lit(True))
    sums = sum(i % 50 for i in range(N)) + N / 10
    for off, ok in ((0.0, True), (1e-9, False)):
        t = row_of(known, "all", sums + off).withColumn("fixed", F.lit(True)).unionByName(row_of(known, "again", sums).withColumn("fixed", F.lit(True)))
        assert solve.solve(t).agg(F.bool_and("consistent")).first()[0] == ok


def cost(terms, x):
    s = solve.System(terms)
    x = np.array([x[k] for k in s.keys])
    missed = [(kind, sum(c * x[i] for i, c in row.items()) - rhs) for kind, rhs, row in s.rows]
    return np.abs(x - s.start).sum() + solve.MISS * sum(max(g, 0.0) if kind == "<=" else abs(g) for kind, g in missed)


def systems(rng, n, whole):
    """Small components of 1 to 3 rows over 4 cells, two of them alike, with bounds of their own, some of which contradict."""
    out = {}
    for comp in range(n):
        m = int(rng.integers(1, 4))
        a = rng.integers(-1, 2, (m, 4)) if whole else rng.integers(-2, 3, (m, 4))
        a[:, 1] = a[:, 0]
        start = np.round(rng.integers(0, 12, 4) / (2 if rng.random() < 0.5 else 1), 2) - (rng.random() < 0.1)
        fixed = rng.random(4) < 0.1
        start = np.where(fixed, np.rint(start), start) if whole else start
        b = a @ np.where(fixed, start, rng.integers(0, 6, 4))
        kinds = ["=" if rng.random() < 0.7 else "<=" for _ in range(m)]
        terms = [(f"e{r}", f"k{i}", float(a[r, i]), float(b[r]), float(start[i]), bool(fixed[i]), kinds[r]) for r in range(m) for i in range(4)]
        for i in range(4):
            if rng.random() < 0.4:
                c = float(rng.choice([1, -1]))
                terms.append((f"o{i}", f"k{i}", c, c * float(rng.integers(0, 8)), float(start[i]), bool(fixed[i]), "<=" if rng.random() < 0.8 else "="))
        out[comp] = terms
    return out


@pytest.mark.parametrize("method", ["whole", "non_negative"])
def test_least_change_against_brute_force(spark, method):
    whole = method == "whole"
    found = systems(np.random.default_rng(11), 60, whole)
    s = solve.solve(spark.createDataFrame([(c, *t) for c, terms in found.items() for t in terms], TERM).repartition(3), method).collect()
    got = {}
    for r in s:
        got.setdefault(r.component, ({}, r.consistent))[0][r.key] = r.value
    seen = set()
    for comp, terms in found.items():
        x, ok = got[comp]
        system = solve.System(terms)
        assert ok == system.holds(np.array([x[k] for k in system.keys]))
        if whole:
            best = min(cost(terms, dict(zip(system.keys, z, strict=True))) for z in itertools.product(*[[s] if f else range(13) for s, f in zip(system.start, system.fixed, strict=True)]))
            assert all(v == round(v) for v in x.values())
        else:
            best = cost(terms, dict(zip(system.keys, system.least_change()[0], strict=True)))
        assert cost(terms, x) <= best + 1e-2, (comp, terms, x, best)
        seen.add(ok)
    assert seen == {True, False}


def test_exact_with_like_cells_against_one_component(spark):
    rng = np.random.default_rng(5)
    found = {}
    for comp in range(60):
        a = rng.integers(-2, 3, (3, 5)).astype(float)
        a[:, 3] = a[:, 1]
        b = a @ rng.integers(-5, 6, 5) if rng.random() < 0.7 else rng.integers(-9, 10, 3).astype(float)
        found[comp] = [(f"e{i}", f"k{j}", float(a[i, j]), float(b[i]), j / 10, bool(j == 4), "=") for i in range(3) for j in range(5)]
    got = {(r.component, r.key): (r.value, r.consistent) for r in solve.solve(spark.createDataFrame([(c, *t) for c, terms in found.items() for t in terms], TERM).repartition(3)).collect()}
    for comp, terms in found.items():
        s = solve.System(terms)
        x, ok = s.exact()
        mine = np.array([got[comp, k][0] for k in s.keys])
        assert {got[comp, k][1] for k in s.keys} == {ok} and (s.holds(mine, 1e-9) if ok else (mine == s.start).all()) and (not ok or s.holds(x, 1e-9))


def test_a_tree_of_small_sums_is_judged_as_it_holds():
    """Sums of which the least change leaves nothing hold to a millionth of a unit, not of the largest start."""
    level, terms, n = [(f"l{i}", float(v)) for i, v in enumerate(np.random.default_rng(1).integers(0, 999, 3000))], [], 0
    have = sum(v for _, v in level)
    while len(level) > 1:
        above = []
        for i in range(0, len(level), 3):
            terms.append((f"e{n:06}", f"t{n}", 1.0, 0.0, 0.0, False, "="))
            terms += [(f"e{n:06}", k, -1.0, 0.0, v, False, "=") for k, v in level[i : i + 3]]
            above.append((f"t{n}", 0.0))
            n += 1
        level = above
    s = solve.System(terms)
    x, held = s.least_change()
    assert held and np.abs(x - s.start).sum() == pytest.approx(have, abs=1e-3)
