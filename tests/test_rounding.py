"""Rounding against Python's own, which rounds the double's exact value; forms of codes and classes of rules."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import keys as K
from ledgerloom.functions import values as V
from ledgerloom.operators import catalog, solve
from ledgerloom.sources import package


def test_rounding_is_decided_on_the_double(spark):
    rng = random.Random(2)
    rows = [(1.115, 2), (2.675, 2), (0.125, 2), (0.375, 2), (-2.675, 2), (1.005, 2), (0.57, 2), (2.5, 0), (3.5, 0), (2500.0, -3), (3500.0, -3), (1e17 + 2, 2), (-0.005, 2), (5e-324, 3), (1.7e308, 1)]
    rows += [(rng.uniform(-1, 1) * 10 ** rng.randint(-3, 11), rng.randint(1, 6)) for _ in range(3000)]
    rows += [(rng.randint(-10**6, 10**6) / 10**4 + 0.5 / 10**k, k) for k in (1, 2, 3) for _ in range(1000)]
    got = spark.createDataFrame(rows, "v double, d int").select("v", "d", V.round_to_decimals(F.col("v"), F.col("d")).alias("r")).collect()
    for r in got:
        want = round(r.v, r.d) if r.d > 0 else round(r.v / 10**-r.d) * 10**-r.d
        assert r.r == want, (r.v, r.d)


def test_forms_of_codes_and_item_types(spark):
    codes = {"C01.00": True, "C01.00.01.02.03.04": True, "SR99.01": True, "LV501.00": True, "A1": False, "C01": False, "C1.00": False, "ABCD01.00": False, "C01.0": False}
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    assert {r.c: r.ok for r in df.select("c", K.is_table_code(F.col("c")).alias("ok")).collect()} == codes
    kinds = {"doubleItemType": ("DECIMAL", True), "floatItemType": ("DECIMAL", True), "pureItemType": ("DECIMAL", True), "monetaryItemType": ("MONETARY", False), "dateTimeItemType": ("DATE", False), "tokenItemType": ("STRING", False)}
    t = spark.createDataFrame([(k,) for k in kinds], "t string").select("t", package.datatype_of(F.col("t")).alias("d"), package.needs_refine(F.col("t")).alias("n"))
    assert {r.t: (r.d, r.n) for r in t.collect()} == kinds


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (catalog.rule_class, {"isMatch({c}, '^a')": "format", "{r: 1} != {r: 2}": "equality-simple", "{r: 1} i>= {r: 2}": "inequality", "{r: 1} i+ {r: 2}": "other", "if {r: 1} i> 0 then {r: 2} i= {r: 3} i* 2": "conditional/equality-scaled"}),
        (catalog.unhandled_class, {"  ": "empty", "isNull({r: 1})": "existence", "{r: 1} i<= {r: 2}": "inequality", "{r: 1} i+ {r: 2} i= 1": "constant", "{r: 1} i= {r: 2} i* {r: 3}": "product", "{r: 1} i= {r: 2} / {r: 3}": "ratio", "{r: 1} i= imax({r: 2}, 0)": "minmax", "{r: 1} i= {r: 2}": "other"}),
    ],
)
def test_classes_of_rules(spark, column, want):
    got = spark.createDataFrame([(e,) for e in want], "e string").select("e", column(F.col("e")).alias("k")).collect()
    assert {r.e: r.k for r in got} == want


def test_gaps_are_judged_against_what_is_added_up():
    """A feasible tree whose values reach a million, and one that is off by a thousandth of a small sum."""
    rng = random.Random(7)
    terms, level, n = [], [(f"l{i}", rng.uniform(0, 1e6)) for i in range(1200)], 0
    while len(level) > 1:
        above = []
        for i in range(0, len(level), 5):
            terms.append((f"e{n}", f"t{n}", 1.0, 0.0, 0.0, False, "="))
            terms += [(f"e{n}", k, -1.0, 0.0, v, False, "=") for k, v in level[i : i + 5]]
            above.append((f"t{n}", 0.0))
            n += 1
        level = above
    x, held = solve.System(terms).least_change()
    assert held and x.min() >= 0
    s = solve.System([("e", "a", 1.0, 0.0, 10.0, True, "="), ("e", "b", -1.0, 0.0, 9.99, True, "=")])
    assert not s.holds(s.start)
