"""Trees as Column expressions, and rules as term tables (FA*, FB*, FLT8, FLT9, RC5, RC17, JN16)."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from . import language as L

# functions go to the workers by value: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(L)

_BINARY = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": V.safe_divide}
_TESTS = {"<=": lambda a, b, t: a <= b + t, "<": lambda a, b, t: a < b + t, ">=": lambda a, b, t: a >= b - t, ">": lambda a, b, t: a > b - t, "=": lambda a, b, t: F.abs(a - b) <= t, "!=": lambda a, b, t: F.abs(a - b) > t}


def to_column(tree, leaf: Callable[[object], Column], tolerance: float | Column = 0.0, language: str = "a", word: Callable[[object], Column] | None = None, sequences: frozenset[str] = frozenset()) -> Column:
    """The tree as a Column. leaf gives a variable's or cell's number, for the variables in sequences an array of numbers; word gives its text, by which
    it is compared with texts, names and truth values (without it, the number's own text). Absent values are 0 in arithmetic, a sequence is its sum there. `exp` is a
    tolerance wrapper in language a and a rational power in language b. With a tolerance, comparisons of numbers allow for it."""
    tol = F.lit(tolerance) if isinstance(tolerance, float) else tolerance
    again = lambda x: to_column(x, leaf, tolerance, language, word, sequences)
    many = lambda x: x[0] == "seq" or (x[0] == "var" and x[1] in sequences)
    kind = tree[0]

    def listed(args: list) -> Column:
        """All numbers of the arguments in one array; FA6, PRJ9."""
        return V.flat(F.array(*[again(x) if many(x) else F.array(again(x).cast("double")) for x in _flat(args)]))

    def number(x) -> Column:
        return V.num_list(again(x)) if many(x) else F.coalesce(again(x), F.lit(0.0))

    def said(x) -> Column:
        """The text by which x compares; FA2, PRJ8."""
        if x[0] in ("var", "cell") and word:
            return word(x)
        return again(x).cast("string")

    if kind in ("num", "str", "bool"):
        return F.lit(tree[1])
    if kind in ("var", "cell"):
        return leaf(tree)
    if kind == "seq":
        return listed(tree[1])
    if kind == "neg":
        return -number(tree[1])
    if kind in _BINARY:
        return _BINARY[kind](number(tree[1]), number(tree[2]))
    if kind in ("and", "or"):
        a, b = again(tree[1]), again(tree[2])
        return a & b if kind == "and" else a | b
    if kind == "if":
        # without an else, a rule is only asserted where its condition holds
        return F.when(again(tree[1]), again(tree[2])).otherwise(again(tree[3]) if tree[3] is not None else F.lit(None))
    if kind in _TESTS:
        if kind in ("=", "!=") and (_is_text(tree[1]) or _is_text(tree[2])):
            a, b = said(tree[1]), said(tree[2])
            same = F.when(a.isNotNull() & b.isNotNull(), V.coerced(a) == V.coerced(b))  # what is absent can't be compared
            return same if kind == "=" else ~same
        return _TESTS[kind](number(tree[1]), number(tree[2]), tol)
    if kind == "call":
        name, args = tree[1], tree[2]
        if test := L.comparison(tree):
            return _TESTS[test[0]](number(test[1]), number(test[2]), tol)
        if name in ("sum", "isum"):
            return V.num_list(listed(args)) if any(map(many, args)) else sum((number(x) for x in args), F.lit(0.0))
        if name in ("abs", "iabs"):
            return F.abs(number(args[0]))
        if name in ("max", "imax"):
            return V.biggest(listed(args)) if language == "a" else (V.imax(*[again(x) for x in _flat(args)]) if len(_flat(args)) > 1 else number(_flat(args)[0]))
        if name in ("min", "imin"):
            return V.smallest(listed(args)) if language == "a" else (V.imin(*[again(x) for x in _flat(args)]) if len(_flat(args)) > 1 else number(_flat(args)[0]))
        if name == "exp":
            return number(args[0]) if language == "a" else V.rational_power(number(args[0]), args[1][1], args[2][1])
        if name.startswith("numeric-"):
            return _BINARY[{"add": "+", "subtract": "-", "multiply": "*", "divide": "/"}[name[8:]]](number(args[0]), number(args[1]))
        if name == "count":
            return V.length_of(listed(args)).cast("double")
        if name == "matches":
            return V.matches(said(args[0]), args[1][1])
        if name in ("empty", "isNull"):
            return V.length_of(again(args[0])) == 0 if many(args[0]) else again(args[0]).isNull()
        if name == "not":
            return ~again(args[0])
        if name == "QName":
            return F.concat(F.lit("{"), again(args[0]), F.lit("}"), again(args[1]))
    raise L.RuleSyntaxError(f"no column for {tree!r}")


def _is_text(tree) -> bool:
    return tree[0] in ("str", "bool") or (tree[0] == "call" and tree[1] == "QName")


def dispatched(cases: list[Column], number: Column) -> Column:
    """The case that a row's number (from 0) names, found by halves: of a thousand rules ten comparisons for each row, in one pass over the rows."""

    def part(lo: int, hi: int) -> Column:
        if hi - lo == 1:
            return cases[lo]
        mid = (lo + hi) // 2
        return F.when(number < mid, part(lo, mid)).otherwise(part(mid, hi))

    return part(0, len(cases))


def _flat(args: list) -> list:
    return [y for x in args for y in (x[1] if x[0] == "seq" else [x])]


def guard(condition, leaf: Callable[[object], Column], tolerance: float = 0.5, language: str = "b") -> Column:
    """FLT8, FLT9: whether a rule's condition holds; true without one, or where it can't be evaluated."""
    if condition is None:
        return F.lit(True)
    return F.coalesce(to_column(condition, leaf, tolerance, language), F.lit(True))


_TERMS = "code string, kind string, rhs double, coef double, tbl string, r string, c string, z string, sr array<string>, sc array<string>, sz array<string>, bar boolean"
_TERM_KINDS = [pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.string(), *[pa.list_(pa.string())] * 3, pa.bool_()]


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each single cell of the linear rules (code, expression, scope): those of the comparison, and (bar) those inside absolute values."""
    for b in batches:
        rows = []
        for code, text, scope in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
            _, core = L.unwrap(L.parse_b(text or ""))
            if not (found := L.constraint(core)):
                continue
            at = L.parse_scope(scope or "") or L.Cell()
            inside = dict.fromkeys(cell for n in L.walk(core) if isinstance(n, tuple) and n[0] == "call" and n[1] in ("abs", "iabs") for cell in L.cells(n))
            cells = [(found[0], found[2], coef, cell, False) for (_, cell), coef in found[1].items()] + [("<=", 0.0, -1.0, cell, True) for cell in inside]
            rows += [(code, kind, rhs, coef, cell.t or at.t, r, c, z, list(at.r), list(at.c), list(at.z), bar) for kind, rhs, coef, cell, bar in cells for r, c, z in cell.places()]
        names = [x.split()[0] for x in _TERMS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), _TERM_KINDS, strict=True)], names=names)


def terms_of(rules: DataFrame) -> DataFrame:
    """RC5, RC17, JN16: (code, kind, rhs, inst, coef, tbl, r, c, z, bar) of linear rules (code, expression, scope), a row for each single cell of each scope instance; with bar, of cells inside absolute values (-x <= 0).

    Rules are parsed by tasks, and the explode over the scope's rows, columns and layers is Spark's. What a term leaves open (row, column, layer, table) it takes from the scope's instance."""
    terms = rules.select("code", "expression", F.coalesce("scope", F.lit("")).alias("scope")).mapInArrow(_terms, _TERMS)
    for axis in "rcz":
        terms = terms.select("*", F.explode_outer(f"s{axis}").alias(f"i{axis}"))
    inst = F.concat_ws("/", F.coalesce("ir", F.lit("-")), F.coalesce("ic", F.lit("-")), F.coalesce("iz", F.lit("-")))
    return terms.select("code", "kind", "rhs", inst.alias("inst"), "coef", "tbl", *[F.coalesce(axis, f"i{axis}").alias(axis) for axis in "rcz"], "bar")


def rule_terms(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """The same of rules with code and expression, perhaps scope, without the bars."""
    rows = [(r["code"], r["expression"], r.get("scope")) for r in rules]
    return terms_of(spark.createDataFrame(rows, "code string, expression string, scope string")).where("NOT bar").drop("bar")


FORMS = "code string, guarded boolean, target string, parts string, absent array<string>, bound string, op string, total double, nonlinear boolean"


def _forms(dialect: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.float64(), pa.bool_()]
        said = lambda leaf: leaf[1] if leaf[0] == "var" else "/".join(",".join(x) for x in (leaf[1].r, leaf[1].c, leaf[1].z))
        for b in batches:
            rows = []
            for code, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tree = L.parse_a(text) if dialect == "a" else L.parse_b(text)
                condition, core = L.unwrap(tree)
                target, parts, bound, test, total = L.derivation(core), L.aggregate_equality(core), L.const_bound(core), L.comparison(core), L.constant_sum(core)
                rows.append((code, condition is not None, said(target[0]) if target else None, parts[1] if parts else None, [said(x) for x in L.must_be_absent(tree) if x[0] in ("var", "cell")], f"{bound[0]} {bound[1]} {bound[2]:g}" if bound else None, test[0] if test else None, total[1] if total else None, L.is_nonlinear(tree)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=[x.split()[0] for x in FORMS.split(", ")])

    return run


def forms(rules: DataFrame, dialect: str) -> DataFrame:
    """RC8-RC12, RC16, RC20, FLT7: what is read off the texts of rules (code, expression), by tasks: guarded, derivation target (of a cell: row/column/layer), parts of a sum, absent ones, bound by a constant, comparison, constant sum."""
    return rules.select("code", "expression").mapInArrow(_forms(dialect), FORMS)
