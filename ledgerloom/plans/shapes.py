"""Formula rules as rows, and a compiled test for each shape (RC15, EV4, FLT1-FLT3).

A rule's shape is its test's tree with numbered variables and numbered constants. Thousands of rules have a few dozen shapes; only these become Columns. What tells rules of a
shape apart - constants, fallbacks, names, filters - stays in columns of a rule table, which facts and groups are joined to. Rules are parsed by tasks.

A test sees a variable as a summary: how many values, their sum, largest, smallest and first text. All functions of the language follow from that, so
no group of values is ever gathered in a list.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from . import language as L
from .compiler import _BINARY, _TESTS, _flat, _is_text, dispatched

# functions go to the workers by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(L)

#: A filter tree is JSON: ["and", [..]] ["or", [..]] ["not", x] ["concept", names] ["member", dim, names] ["has", dim] ["unknown"].
RULES = "rule string, test string, severity string, variables array<struct<name:string,fallback:string,sequence:boolean,tree:string,own:array<string>>>"
_CONDITION = "struct<kind:string,dim:string,names:array<string>,negate:boolean>"
PREPARED = (
    "rule string, severity string, shape string, error string, consts array<string>, fallbacks array<array<string>>, "
    f"variables array<struct<slot:int,concepts:array<string>,alternatives:array<array<{_CONDITION}>>>>, pinned array<string>"
)
SUMMARY = "struct<n:bigint,total:double,high:double,low:double,first:string>"
#: Shapes whose tests share a generated method.
SHAPES_A_PASS = 12


def rule_rows(spark: SparkSession, rules: list) -> DataFrame:
    """Rules (sources.formula.Rule) as a table."""
    rows = [(r.id, r.test, r.severity, [(v.name, v.fallback, v.sequence, json.dumps(v.tree), sorted(v.own)) for v in r.variables]) for r in rules]
    return spark.createDataFrame(rows, RULES)


def shape_of(test: str, sequences: dict[str, bool]) -> tuple[str, list[str], list[str]]:
    """The shape of a test as JSON, its variables in the order of their numbers, and its constants. sequences: the rule's variables, and whether each is a sequence."""
    tree, slots, consts = L.parse_a(test), list[str](), list[str]()

    def constant(kind: str, value) -> list:
        consts.append(str(value).lower() if kind == "bool" else str(value))
        return ["const", kind, len(consts) - 1]

    def cut(x):
        if x[0] in ("num", "str", "bool"):
            return constant(x[0], x[1])
        if x[0] == "var":
            if x[1] not in sequences:
                return ["none"]
            if x[1] not in slots:
                slots.append(x[1])
            return ["var", slots.index(x[1]), sequences[x[1]]]
        if x[0] == "call":
            return ["call", x[1], [cut(y) for y in x[2]]]
        if x[0] == "seq":
            return ["seq", [cut(y) for y in x[1]]]
        return [x[0], *[None if y is None else cut(y) for y in x[1:]]]

    cut_tree = cut(tree)
    absent = {x[1] for x in L.must_be_absent(tree) if x[0] == "var"}
    needed = [i for i, v in enumerate(slots) if not sequences[v] and v not in absent]
    return json.dumps([cut_tree, needed]), slots, consts


def alternatives(tree, negate: bool = False) -> list[list[tuple]]:
    """A filter tree as alternatives of conditions (kind, dim, names, negate) that hold together."""
    kind = tree[0]
    if kind == "not":
        return alternatives(tree[1], not negate)
    if kind in ("and", "or"):
        parts = [alternatives(x, negate) for x in tree[1]]
        if (kind == "or") != negate:
            return [a for p in parts for a in p]
        out: list[list[tuple]] = [[]]
        for p in parts:
            out = [[*a, *b] for a in out for b in p]
        return out
    dim, names = (tree[1], []) if kind == "has" else (None, list(tree[1])) if kind == "concept" else (tree[1], list(tree[2])) if kind == "member" else (None, [])
    return [[(kind, dim, names, negate)]]


def united(tree):
    """FLT2: of filters that stand side by side, those on one dimension, and those on the concept, are united: a variable's own members add to those of its whole set.
    Filters under a boolean one, and complements, keep to themselves."""
    if tree[0] != "and":
        return tree
    concepts, members, rest = list[str](), dict[str, list[str]](), []
    for x in tree[1]:
        if x[0] == "concept":
            concepts += x[1]
        elif x[0] == "member":
            members.setdefault(x[1], []).extend(x[2])
        else:
            rest.append(x)
    rest = [x for x in rest if x[0] != "has" or x[1] not in members]
    return ["and", [*([["concept", sorted(set(concepts))]] if concepts else []), *[["member", d, sorted(set(m))] for d, m in members.items()], *rest]]


def concepts_of(parts: list[list[tuple]]) -> list[str] | None:
    """Concepts to one of which the alternatives limit facts; None if they don't."""
    found: set[str] = set()
    for conditions in parts:
        known = [set(c[2]) for c in conditions if c[0] == "concept" and not c[3]]
        if not known:
            return None
        found |= set.intersection(*known)
    return sorted(found)


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    condition = pa.struct([("kind", pa.string()), ("dim", pa.string()), ("names", pa.list_(pa.string())), ("negate", pa.bool_())])
    variable = pa.struct([("slot", pa.int32()), ("concepts", pa.list_(pa.string())), ("alternatives", pa.list_(pa.list_(condition)))])
    kinds = [pa.string()] * 4 + [pa.list_(pa.string()), pa.list_(pa.list_(pa.string())), pa.list_(variable), pa.list_(pa.string())]
    for b in batches:
        rows = []
        for r in b.to_pylist():
            about = {v["name"]: v for v in r["variables"] or []}
            try:
                shape, slots, consts = shape_of(r["test"] or "", {n: bool(v["sequence"]) for n, v in about.items()})
                error = None
            except L.RuleSyntaxError as e:
                shape, slots, consts, error = None, [], [], str(e)
            slots += [n for n in about if n not in slots]
            back = lambda f: None if f is None else [x.strip() for x in f.strip("() ").split(",") if x.strip()]
            bound = []
            for i, name in enumerate(slots):
                parts = alternatives(united(json.loads(about[name]["tree"])))
                bound.append({"slot": i, "concepts": concepts_of(parts), "alternatives": [[dict(zip(("kind", "dim", "names", "negate"), c, strict=True)) for c in p] for p in parts]})
            rows.append((r["rule"], r["severity"], shape, error, consts, [back(about[n]["fallback"]) for n in slots], bound, sorted({d for v in about.values() for d in v["own"] or []})))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=["rule", "severity", "shape", "error", "consts", "fallbacks", "variables", "pinned"])


def prepared(rules: DataFrame) -> DataFrame:
    """Rules (RULES) with their shape, constants, fallbacks, and variables as alternatives of conditions. A test that is no expression has a null shape, and the reason in error."""
    return rules.mapInArrow(_prepared, PREPARED)


def fits(concept: Column, dims: Column, typed: Column, known: Column) -> Column:
    """FLT1, FLT3: whether a fact meets a variable's `alternatives`; null where that hangs on a filter that is not known. A dimension that is left out has its default member."""

    def meets(c: Column) -> Column:
        member = F.coalesce(F.try_element_at(dims, c["dim"]), F.try_element_at(known, c["dim"]))
        there = F.try_element_at(dims, c["dim"]).isNotNull() | F.try_element_at(typed, c["dim"]).isNotNull()
        holds = F.when(c["kind"] == "member", F.coalesce(F.array_contains(c["names"], member), F.lit(False))).when(c["kind"] == "has", there).when(c["kind"] == "concept", F.array_contains(c["names"], concept))
        return holds != c["negate"]  # an unknown filter is null

    return F.exists("alternatives", lambda a: F.forall(a, meets))


def summary(value: Column) -> list[Column]:
    """Aggregates of a variable's texts: n, total, high, low, first. Sums are exact decimals, but for what has no place there."""
    exact = value.try_cast("decimal(38,12)")
    total = F.coalesce(F.try_sum(exact).cast("double"), F.lit(0.0)) + F.coalesce(F.sum(F.when(exact.isNull(), V.num(value))), F.lit(0.0))
    return [F.count(value).alias("n"), total.alias("total"), F.max(F.when(value.isNotNull(), V.num(value))).alias("high"), F.min(F.when(value.isNotNull(), V.num(value))).alias("low"), F.min(value).alias("first")]


def _of_fallbacks() -> Column:
    """Summaries of the fallbacks, by slot."""
    numbers = lambda f: F.transform(f, lambda x: V.num(x))
    one = lambda f: F.when(f.isNotNull(), F.struct(F.size(f).cast("long").alias("n"), V.num_list(numbers(f)).alias("total"), F.array_max(numbers(f)).alias("high"), F.array_min(numbers(f)).alias("low"), F.get(f, F.lit(0)).alias("first")))
    return F.transform("fallbacks", one)


def seen(rules: DataFrame) -> DataFrame:
    """The table with `backs` in place of fallbacks and variables."""
    return rules.where("shape IS NOT NULL").select("rule", "severity", "shape", "consts", _of_fallbacks().alias("backs"))


def test_column(shape: str, tolerance: float) -> Column:
    """A shape's test over `slots` (an array of summaries) and `consts`: null where a variable that it needs is not there."""
    tree, needed = json.loads(shape)
    slot = lambda i: F.get("slots", F.lit(i))
    tol = F.lit(tolerance)
    many = lambda x: x[0] == "seq" or (x[0] == "var" and x[2])

    def value(x) -> Column:
        kind = x[0]
        if kind == "none":
            return F.lit(None).cast("double")
        if kind == "const":
            text = F.get("consts", F.lit(x[2]))
            return text.cast("double") if x[1] == "num" else text == "true" if x[1] == "bool" else text
        if kind == "var":
            return F.when(slot(x[1])["n"] > 0, slot(x[1])["total"])
        if kind == "neg":
            return -number(x[1])
        if kind in _BINARY:
            return _BINARY[kind](number(x[1]), number(x[2]))
        if kind in ("and", "or"):
            return value(x[1]) & value(x[2]) if kind == "and" else value(x[1]) | value(x[2])
        if kind == "if":
            return F.when(value(x[1]), value(x[2])).otherwise(F.lit(None) if x[3] is None else value(x[3]))
        if kind in _TESTS:
            if kind in ("=", "!=") and (_texts(x[1]) or _texts(x[2])):
                a, b = said(x[1]), said(x[2])
                same = F.when(a.isNotNull() & b.isNotNull(), V.coerced(a) == V.coerced(b))
                return same if kind == "=" else ~same
            return _TESTS[kind](number(x[1]), number(x[2]), tol)
        return called(x)

    def called(x) -> Column:
        name, args = x[1], x[2]
        if test := L.comparison((x[0], name, args)):
            return _TESTS[test[0]](number(test[1]), number(test[2]), tol)
        if name in ("sum", "isum"):
            return total(args)
        if name in ("abs", "iabs"):
            return F.abs(number(args[0]))
        if name in ("max", "imax", "min", "imin"):
            most = name.endswith("max")
            ends = [(slot(y[1])["high" if most else "low"] if many(y) else value(y)).cast("double") for y in _flat(args)]
            return F.coalesce((F.greatest if most else F.least)(*ends) if len(ends) > 1 else ends[0], F.lit(0.0)) if ends else F.lit(0.0)
        if name == "exp":
            return number(args[0])
        if name.startswith("numeric-"):
            return _BINARY[{"add": "+", "subtract": "-", "multiply": "*", "divide": "/"}[name[8:]]](number(args[0]), number(args[1]))
        if name == "count":
            return sum((count(y) for y in _flat(args)), F.lit(0)).cast("double")
        if name == "matches":
            return F.rlike(F.coalesce(said(args[0]), F.lit("")), said(args[1]))
        if name in ("empty", "isNull"):
            return count(args[0]) == 0 if many(args[0]) else value(args[0]).isNull()
        if name == "not":
            return ~value(args[0])
        if name == "QName":
            return F.concat(F.lit("{"), value(args[0]), F.lit("}"), value(args[1]))
        raise L.RuleSyntaxError(f"no column for {x!r}")

    def total(args: list) -> Column:
        return sum((number(y) for y in _flat(args)), F.lit(0.0))

    def count(x) -> Column:
        if x[0] == "seq":
            return sum((count(y) for y in _flat([x])), F.lit(0))
        return F.coalesce(slot(x[1])["n"], F.lit(0)) if many(x) else value(x).isNotNull().cast("int")

    def number(x) -> Column:
        if x[0] == "seq":
            return total([x])
        return F.coalesce(slot(x[1])["total"] if many(x) else value(x), F.lit(0.0))

    def said(x) -> Column:
        return slot(x[1])["first"] if x[0] == "var" else F.get("consts", F.lit(x[2])) if x[0] == "const" else value(x).cast("string")

    there = F.lit(True)
    for i in needed:
        there = there & slot(i).isNotNull()
    return F.when(there, value(tree).cast("boolean"))


def _texts(x) -> bool:
    return _is_text(x) or (x[0] == "const" and x[1] != "num")


def tested(groups: DataFrame, shapes: list[str], tolerance: float) -> DataFrame:
    """groups (shape, consts, backs, summaries, ...) with ok: the verdict of each one's shape. A pass over the groups for every SHAPES_A_PASS shapes: each group is in one."""
    slots = F.transform("backs", lambda b, i: F.coalesce(F.try_element_at("summaries", i), b))
    out = None
    for start in range(0, len(shapes), SHAPES_A_PASS):
        some = shapes[start : start + SHAPES_A_PASS]
        mine = groups.where(F.col("shape").isin(some)) if len(shapes) > SHAPES_A_PASS else groups
        number = F.array_position(F.lit(some), F.col("shape")) - 1
        part = mine.withColumn("slots", slots).withColumn("ok", dispatched([test_column(s, tolerance) for s in some], number)).drop("slots")
        out = part if out is None else out.unionByName(part)
    return groups.withColumn("ok", F.lit(None).cast("boolean")) if out is None else out
