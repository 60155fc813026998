"""Formula rules by shape against an evaluator of single rules written here; typed dimensions, united filters, filters that are not known."""

import itertools
import json
import random
from fractions import Fraction

import pytest

from ledgerloom.operators import binding
from ledgerloom.plans import language as L
from ledgerloom.plans import shapes
from ledgerloom.sources.formula import Rule, Variable

FACTS = "concept string, dims map<string,string>, typed map<string,string>, period string, value string"


def number(t):
    try:
        return float(t)
    except ValueError:
        return 0.0


def judged(rule, group):
    """The verdict of a rule on one group (variable -> texts of its facts), by walking the tree."""
    tree, about = L.parse_a(rule.test), {v.name: v for v in rule.variables}
    texts = {}
    for n, v in about.items():
        texts[n] = group[n] if n in group else None if v.fallback is None else [x.strip() for x in v.fallback.strip("() ").split(",") if x.strip()]
    absent = {x[1] for x in L.must_be_absent(tree) if x[0] == "var"}
    if any(texts[v] is None for v in L.variables(tree) if not about[v].sequence and v not in absent):
        return None
    many = lambda x: x[0] == "seq" or (x[0] == "var" and about[x[1]].sequence)

    def listed(args):
        out = []
        for x in args:
            got = listed(x[1]) if x[0] == "seq" else [number(t) for t in texts[x[1]] or []] if many(x) else [value(x)]
            out += [g for g in got if g is not None]
        return out

    def num(x):
        if many(x):
            return float(sum(Fraction(v) for v in listed([x])))
        v = value(x)
        return 0.0 if v is None else float(v)

    def text(x):
        return (sorted(texts[x[1]]) or [None])[0] if x[0] == "var" and texts[x[1]] is not None else None if x[0] == "var" else str(x[1]).lower() if x[0] == "bool" else x[1]

    def comparable(t):
        if t.lower() in ("true", "false"):
            return 0, t.lower()
        try:
            return 1, float(t)
        except ValueError:
            return 2, t

    def value(x):
        k = x[0]
        if k in ("num", "str", "bool"):
            return x[1]
        if k == "var":
            return float(sum(Fraction(number(t)) for t in texts[x[1]])) if texts[x[1]] else None
        if k == "neg":
            return -num(x[1])
        if k in "+-*/":
            a, b = num(x[1]), num(x[2])
            return a + b if k == "+" else a - b if k == "-" else a * b if k == "*" else a / b if b else 0.0
        if k in ("and", "or"):
            a, b = value(x[1]), value(x[2])
            stop = k == "or"
            return stop if stop in (a, b) else None if None in (a, b) else not stop
        if k == "if":
            return value(x[2]) if value(x[1]) else value(x[3]) if x[3] else None
        if k in ("=", "!=") and {x[1][0], x[2][0]} & {"str", "bool"}:
            a, b = text(x[1]), text(x[2])
            return None if None in (a, b) else (comparable(a) == comparable(b)) == (k == "=")
        if found := L.comparison(x):
            op, a, b = found[0], num(found[1]), num(found[2])
            return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        name, args = x[1], x[2]
        flat = listed(args) if name in ("sum", "max", "min", "count") else None
        if flat is not None:
            return float(sum(Fraction(v) for v in flat)) if name == "sum" else float(len(flat)) if name == "count" else (max if name == "max" else min)(flat, default=0.0)
        if name == "abs":
            return abs(num(args[0]))
        if name == "not":
            v = value(args[0])
            return None if v is None else not v
        if name == "empty":
            return not listed(args) if many(args[0]) else value(args[0]) is None
        a, b = num(args[0]), num(args[1])
        return {"numeric-add": a + b, "numeric-subtract": a - b, "numeric-multiply": a * b, "numeric-divide": a / b if b else 0.0}[name]

    return value(tree)


def bound(rule, facts):
    """Groups of a rule by hand: group key -> variable -> texts."""
    pinned, groups = {d for v in rule.variables for d in v.own}, {}
    for v in rule.variables:
        concepts, members = {c for t in v.tree[1] if t[0] == "concept" for c in t[1]}, {}
        for t in v.tree[1]:
            if t[0] == "member":
                members.setdefault(t[1], set()).update(t[2])
        for concept, dims, typed, period, text in facts:
            if concept in concepts and all(dims.get(d, "def" if d == "D" else None) in m for d, m in members.items()):
                key = (tuple(sorted((d, m) for d, m in dims.items() if d not in pinned)), tuple(sorted((d, m) for d, m in typed.items() if d not in pinned)), period)
                groups.setdefault(key, {}).setdefault(v.name, []).append(text)
    return groups


TESTS = [
    "$a >= $b", "$a = sum($s)", "if $a > 3 then $b > 1 else true()", "if $a > 3 then $b < 5", "$a + $b * 2 <= %d", "abs($a - $b) <= 2.5", "max($s, $a) - min($s) <= %d", "not(empty($a)) and $b >= %d", "empty($a)", "count($s) + count(($a, $b)) >= %d",
    "$a = 'true'", "$a != \"7\" or -$b < 0", "numeric-less-equal-than($a, numeric-add(sum(($s, $b)), %d))", "numeric-divide($a, $b) > 0.5", "sum($a, $b) != $s", "empty($s) or $s > %d",
]


@pytest.fixture(scope="module")
def world():
    rng = random.Random(1)
    facts = []
    for _ in range(400):
        dims = {d: rng.choice(ms) for d, ms in (("D", ["x", "y", "z"]), ("E", ["e1", "e2"])) if rng.random() < 0.8}
        typed = {"T": rng.choice(["1", "2"])} if rng.random() < 0.6 else {}
        facts.append((f"m{rng.randint(0, 4)}", dims, typed, rng.choice(["p1", "p2"]), rng.choice(["1", "2.5", "7", "-3", "true", "abc", "0.1", "0.2", "10", "1e3"])))
    rules = []
    for i in range(64):
        test = TESTS[i % len(TESTS)].replace("%d", str(i))
        variables = []
        for n in [v for v in "abs" if "$" + v in test]:
            common, own = [("concept", (f"m{i % 5}",))], [("member", "D", tuple(rng.sample(["x", "y", "z", "def"], rng.randint(1, 2))))]
            if i % 3 == 0:
                common.append(("member", "E", ("e1",)))
            if i % 6 == 0:
                own += [("member", "E", ("e2",)), ("concept", (f"m{(i + 1) % 5}",))]
            variables.append(Variable(n, ("and", [*common, *own]), frozenset(t[1] for t in own if t[0] == "member"), rng.choice([None, "0", "5", "()"]) if n != "s" else rng.choice([None, "(1, 2)"]), n == "s"))
        rules.append(Rule(f"r{i}", test, "error", tuple(variables)))
    return facts, rules


def key_text(key):
    dims, typed, period = key
    return dims, typed, period


def test_many_rules_against_single_evaluation(spark, world):
    from ledgerloom.functions.keys import dim_key
    from pyspark.sql import functions as F

    facts, rules = world
    df = spark.createDataFrame(facts, FACTS).repartition(3)
    table = binding.rule_table(spark, rules)
    assert table.select("shape").distinct().count() < len(rules) / 2
    got = {(r.rule, r.group_key): r.ok for r in binding.rule_verdicts(binding.bind_rules(df, table, {"D": "def"}), table).collect()}
    keys = {k for r in rules for k in bound(r, facts)}
    rows = [(i, dict(k[0]) | {d: f"typed:{v}" for d, v in k[1]}, k[2]) for i, k in enumerate(keys)]
    named = {r.i: r.k for r in spark.createDataFrame(rows, "i int, m map<string,string>, p string").select("i", F.concat_ws("|", dim_key(F.col("m")), "p").alias("k")).collect()}
    name = {k: named[i] for i, k in enumerate(keys)}
    want = {(r.id, name[k]): judged(r, g) for r in rules for k, g in bound(r, facts).items()}
    assert len(want) > 300 and len(set(want.values())) == 3
    assert got == want


def test_typed_rows_are_judged_apart(spark):
    facts = [("A", {}, {"row": "1"}, None, "1"), ("B", {}, {"row": "1"}, None, "1"), ("A", {}, {"row": "2"}, None, "2"), ("B", {}, {"row": "2"}, None, "3")]
    rule = Rule("r", "$a = $b", "error", tuple(Variable(n, ("and", [("concept", (n.upper(),)), ("has", "row")]), frozenset(), None, False) for n in "ab"))
    table = binding.rule_table(spark, [rule])
    got = binding.rule_verdicts(binding.bind_rules(spark.createDataFrame(facts, FACTS), table, {}), table).collect()
    assert sorted((r.group_key.rpartition("typed:")[2][:1], r.ok) for r in got) == [("1", True), ("2", False)]


def test_filters_that_are_not_known_leave_groups_open(spark):
    """Kleene's logic: false and unknown is false, true or unknown is true; what hangs on it is not judged."""
    facts = [("A", {"D": d}, {}, None, "1") for d in "xyz"]
    unknown, x, y = ("unknown",), ("member", "D", ("x",)), ("member", "D", ("y",))
    tree = ("and", [("concept", ("A",)), ("or", [x, ("and", [y, unknown])])])
    table = binding.rule_table(spark, [Rule("r", "$a = 1", "error", (Variable("a", tree, frozenset(), None, False),))])
    got = binding.rule_verdicts(binding.bind_rules(spark.createDataFrame(facts, FACTS), table, {}), table).collect()
    assert sorted((r.group_key[-2:-1] + r.group_key[-1:], r.ok, r.judged) for r in got if True)[0][1:] in ((True, True), (None, False))
    assert {("x" in r.group_key, r.ok, r.judged) for r in got} == {(True, True, True), (False, None, False)} and len(got) == 2


def test_rules_without_concepts_or_syntax(spark):
    facts = [("A", {"D": "x"}, {}, "p", "1"), ("B", {"D": "x"}, {}, "p", "2")]
    everything = Rule("all", "count($s) = 2", "error", (Variable("s", ("and", [("member", "D", ("x",))]), frozenset(), None, True),))
    broken = Rule("broken", "$a = ", "error", (Variable("a", ("and", [("concept", ("A",))]), frozenset(), None, False),))
    table = binding.rule_table(spark, [everything, broken])
    assert [(r.rule, r.error is None) for r in table.orderBy("rule").collect()] == [("all", True), ("broken", False)]
    assert [(r.rule, r.ok) for r in binding.rule_verdicts(binding.bind_rules(spark.createDataFrame(facts, FACTS), table, {}), table).collect()] == [("all", True)]
    empty = binding.rule_table(spark, [])
    assert binding.rule_verdicts(binding.bind_rules(spark.createDataFrame(facts, FACTS), empty, {}), empty).collect() == []


def test_shapes_share_a_tree():
    flags = {"x": False, "y": False, "z": True}
    one = shapes.shape_of("$x + 2 <= sum($z) and $x > 'a'", flags)
    two = shapes.shape_of("$y + 99 <= sum($z) and $y > \"b\"", flags)
    assert one[0] == two[0] and one[1:] == (["x", "z"], ["2.0", "a"]) and two[1:] == (["y", "z"], ["99.0", "b"])
    assert shapes.shape_of("$x > $x", flags)[0] != shapes.shape_of("$x > $y", flags)[0]


def test_alternatives_say_what_trees_say():
    """Every tree over three leaves and a complement, on every assignment."""
    leaf = {"a": ("member", "A", ("1",)), "b": ("has", "B"), "c": ("concept", ("C",))}
    a, b, c = leaf.values()
    trees = [("or", [("and", [a, ("not", b)]), c]), ("not", ("or", [a, ("and", [b, c])])), ("and", [("or", [a, b]), ("or", [b, c])]), ("not", ("not", a))]

    def holds(tree, true):
        if tree[0] == "not":
            return not holds(tree[1], true)
        if tree[0] in ("and", "or"):
            return (all if tree[0] == "and" else any)(holds(x, true) for x in tree[1])
        return tree[0] in true

    for tree in trees:
        parts = shapes.alternatives(json.loads(json.dumps(tree)))
        for n in range(4):
            for true in itertools.combinations(("member", "has", "concept"), n):
                assert holds(tree, true) == any(all((k in true) != negate for k, _, _, negate in p) for p in parts)
