"""Repair in rounds against a loop that judges everything each time."""

import random

import pytest

from ledgerloom.operators import graph, repair

CELL, TERM = "key string, value double, decimals int", "target string, source string, coef double, target_coef double"
BOUND, PAIR = "rule string, key string, op string, bound double", "rule string, left_key string, right_key string, strict boolean"


def by_hand(cells, terms, bounds, pairs, most):
    """The same semantics, all constraints in each round."""
    now = {k: v for k, v, _ in cells if v is not None}
    decimals = {k: d for k, v, d in cells if v is not None}
    sources, told = {}, []
    for t, s, c, tc in terms:
        sources.setdefault(t, []).append((s, c, tc))

    def level(t, path=()):
        if t not in sources:
            return 0
        return None if t in path else (None if None in (below := [level(s, (*path, t)) for s, _, _ in sources[t]]) else 1 + max(below))

    order = sorted((t for t in sources if level(t) is not None), key=level)

    def derive():
        for t in order:
            now[t] = round(-sum(c * now.get(s, 0.0) for s, c, _ in sources[t]) / sources[t][0][2], decimals.get(t, 2))

    def holds(op, v, b):
        return {">=": v >= b, ">": v > b, "<=": v <= b, "<": v < b}[op]

    derive()
    while most is None or len(told) < most:
        bad_b = sorted((r, k, op, b) for r, k, op, b in bounds if k in now and not holds(op, now[k], b))
        bad_p = sorted((r, a, b, s) for r, a, b, s in pairs if a in now and b in now and (now[a] > now[b] or (s and now[a] == now[b])))
        new = {}
        for _, k, op, b in bad_b:
            if k not in sources and k not in new:
                new[k] = b + {">": 10.0 ** -decimals[k], "<": -(10.0 ** -decimals[k])}.get(op, 0.0)
        bounded, by_pair = set(new), {}
        for _, a, b, s in bad_p:
            k, v = (a, now[b] - 1000.0 * s) if a not in sources else (b, now[a] + 1000.0 * s) if b not in sources else (None, None)
            if k is not None and k not in by_pair:
                by_pair[k] = v
        new |= {k: v for k, v in by_pair.items() if k not in bounded}
        new = {k: round(v, decimals[k]) for k, v in new.items()}
        moved = {k for k, v in new.items() if now[k] != v}
        told.append((len({r for r, *_ in bad_b} | {r for r, *_ in bad_p}), len(moved)))
        now.update(new)
        derive()
        if not moved:
            break
    failing = {r for r, k, op, b in bounds if k in now and not holds(op, now[k], b)} | {r for r, a, b, s in pairs if a in now and b in now and (now[a] > now[b] or (s and now[a] == now[b]))}
    return now, failing, told


@pytest.mark.parametrize("seed", [1])
def test_rounds_against_full_evaluation(spark, seed):
    rng = random.Random(seed)
    leaves = [f"l{i:02}" for i in range(40)]
    cells = [(k, float(rng.randint(0, 5000)) / 4, 2) for k in leaves] + [(f"t{i}", 0.0, 1) for i in range(8)] + [("u", 5.0, 0), ("gone", None, 2)]
    terms = [(f"t{i}", s, -1.0, 1.0) for i in range(8) for s in leaves[i * 5 : i * 5 + 5]] + [("u", f"t{i}", -0.5, 2.0) for i in range(8)] + [("x", "y", 1.0, 1.0), ("y", "x", 1.0, 1.0), ("v", "gone", -1.0, 1.0)]
    bounds = [(f"b{i}", k, rng.choice([">=", ">", "<=", "<"]), float(rng.randint(0, 900))) for i, k in enumerate(rng.sample(leaves, 12))] + [("bt", "t1", "<=", 10.0), ("bg", "gone", ">=", 1.0)]
    pairs = [(f"p{i}", a, b, rng.random() < 0.2) for i, (a, b) in enumerate(zip(leaves, leaves[1:], strict=False)) if i % 3] + [("pt", "t2", leaves[39], False), ("pu", leaves[0], "gone", False)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = repair.repair(make(cells, CELL), make(terms, TERM), make(bounds, BOUND), make(pairs, PAIR), most=3)
    now, failing, told = by_hand(cells, terms, bounds, pairs, 3)
    assert {r.key: r.value for r in got.cells.collect()} == pytest.approx(now)
    assert [(r["failing"] >= 0, r["moved"]) for r in got.rounds] == [(True, m) for _, m in told]
    if not told[-1][1]:
        assert {r.rule for r in got.violated.collect()} == failing


def test_later_rounds_touch_little(spark):
    """A chain of one hundred pairs, one of them broken at a time: the second round judges the neighbours only."""
    cells = [(f"k{i:03}", float(i), 0) for i in range(100)]
    cells[50] = ("k050", 60.0, 0)
    pairs = [(f"p{i:03}", f"k{i:03}", f"k{i + 1:03}", False) for i in range(99)]
    got = repair.repair(spark.createDataFrame(cells, CELL), spark.createDataFrame([], TERM), spark.createDataFrame([], BOUND), spark.createDataFrame(pairs, PAIR))
    assert got.rounds == [{"judged": 99, "failing": 1, "moved": 1, "derived": 0}, {"judged": 2, "failing": 0, "moved": 0, "derived": 0}]
    assert {r.key: r.value for r in got.cells.collect()}["k050"] == 51.0 and got.violated.isEmpty()


def test_nothing_to_repair(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    got = repair.repair(empty(CELL), empty(TERM), empty(BOUND), empty(PAIR))
    assert got.cells.isEmpty() and got.rounds == [{"judged": 0, "failing": 0, "moved": 0, "derived": 0}]


def test_totals_without_constraints_are_derived_once(spark, monkeypatch):
    """Two levels of totals above leaves that are moved in two rounds: no constraint lies on a total, so each level is derived once, of the leaves as they end."""
    cells = [("a", 9.0, 0), ("b", 5.0, 0), ("c", 1.0, 0), ("t", 0.0, 0), ("u", 0.0, 0)]
    terms = [("t", k, -1.0, 1.0) for k in "abc"] + [("u", "t", -2.0, 1.0)]
    derived, plain = [], repair._derived
    monkeypatch.setattr(repair, "_derived", lambda *a: (derived.extend(range(a[3], a[4] + 1)), plain(*a))[1])
    got = repair.repair(spark.createDataFrame(cells, CELL), spark.createDataFrame(terms, TERM), spark.createDataFrame([], BOUND), spark.createDataFrame([("p1", "a", "b", False), ("p2", "b", "c", False)], PAIR))
    assert {r.key: r.value for r in got.cells.collect()} == {"a": 1.0, "b": 1.0, "c": 1.0, "t": 3.0, "u": 6.0} and got.violated.isEmpty()
    assert derived == [1, 2]


def test_levels_read_what_is_left(spark, monkeypatch):
    """Two hundred leaves under three totals: past the lowest level no table of a round holds a leaf again."""
    sizes, plain = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: (out := plain(df), sizes.append(out.count()))[0])
    edges = [("t", f"l{i}") for i in range(200)] + [("u", "t"), ("v", "u"), ("x", "x")]
    got = {r.node: r.level for r in graph.levels(spark.createDataFrame(edges, "node string, source string")).collect()}
    assert got == {f"l{i}": 0 for i in range(200)} | {"t": 1, "u": 2, "v": 3, "x": None}
    assert max(sizes[3:]) <= 4
