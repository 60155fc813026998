"""Both rule languages: parsing, what is read off trees, and their Columns."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import compiler
from ledgerloom.plans import language as L


def test_precedence_and_sign():
    assert L.parse_a("$a - 5") == ("-", ("var", "a"), ("num", 5.0))
    assert L.parse_a("$a -5") == ("-", ("var", "a"), ("num", 5.0))
    assert L.parse_a("$a + $b * 2 >= 3 and $c = 1 or not($d)")[0] == "or"
    assert L.parse_a("fn:sum(($a, $b))")[1] == "sum"


@pytest.mark.parametrize("text", ["$a +", "$a $b", "nosuch($a)", "{t: A", "$a = 1 2", "", "(1"])
def test_syntax_errors(text):
    with pytest.raises(L.RuleSyntaxError):
        L.parse_a(text)


def test_cells_and_scopes():
    cell = L.parse_cell("{t: C 01.00, r: 0010; 0020, c: 0010, z: 0001, seq: yes}")
    assert (cell.t, cell.r, cell.c, cell.z, cell.more) == ("C 01.00", ("0010", "0020"), ("0010",), ("0001",), (("seq", "yes"),))
    assert cell.places() == [("0010", "0010", "0001"), ("0020", "0010", "0001")]
    scope = L.parse_scope("scope((t: A, r: 1, c: 2), (t: B, r: 3, c: 2))")
    assert (scope.t, scope.r, scope.c) == ("A", ("1", "3"), ("2",))
    assert L.parse_scope("") is None


def test_linear_forms():
    kind, coefficients, rhs = L.constraint(L.parse_b("{r: 1} i= {r: 2} i* 12.5 i+ 3 i- (0.5 * {r: 3})"))
    assert kind == "=" and rhs == 3.0 and sorted(coefficients.values()) == [-12.5, 0.5, 1.0]
    kind, coefficients, rhs = L.constraint(L.parse_a("$a >= 2 * $b"))
    assert kind == "<=" and {k[1]: v for k, v in coefficients.items()} == {"a": -1.0, "b": 2.0}
    assert L.constraint(L.parse_b("{r: 1} = {r: 2} * {r: 3}")) is None
    assert L.constraint(L.parse_b("{r: 1} i<= iabs({r: 2})"))[0] == "<="
    assert L.constraint(L.parse_b("{r: 1} - {r: 1} = 0"))[1] == {}


def test_what_is_read_off_trees():
    assert L.const_bound(L.parse_a("0 <= $x")) == ("x", ">=", 0.0)
    assert L.const_bound(L.parse_a("numeric-less-than($x, 9)")) == ("x", "<", 9.0)
    assert L.aggregate_equality(L.parse_a("$t = sum($s)")) == ("t", "s")
    assert L.must_be_absent(L.parse_a("empty($v)")) == [("var", "v")]
    assert len(L.constant_sum(L.parse_b("{r: 1} i+ {r: 2} i= 1"))[0]) == 2
    assert L.constant_sum(L.parse_b("{r: 1} i+ 2 * {r: 2} i= 1")) is None
    assert L.is_nonlinear(L.parse_b("if {r: 1} != 0 then {r: 2} = imax({r: 3}, 1)")) and not L.is_nonlinear(L.parse_b("{r: 1} = {r: 2} + 1"))
    assert L.variables(L.parse_a("$a = 1 and $b = 2")) == ["a", "b"]
    assert L.unwrap(L.parse_b("if {r: 1} = 1 then {r: 2} = 3"))[0][0] == "="
    assert L.derivation(L.parse_a("$a + $b = $c"))[0] == ("var", "c")


@pytest.mark.parametrize(
    ("text", "language", "want"),
    [
        ("$a + $b * 2", "a", 14.0), ("$a / 0", "b", 0.0), ("numeric-divide($a, $b)", "a", 0.8), ("-$a", "b", -4.0), ("max(($a, $b))", "a", 5.0), ("imin($a, $n)", "b", 0.0), ("exp($a, 1, 2)", "a", 4.0),
        ("exp($a, 1, 2)", "b", 2.0), ("exp(-$a, 1, 2)", "b", 0.0), ("abs(-$b)", "a", 5.0), ("count(($a, $n))", "a", 1.0), ("sum($a, $b, $n)", "a", 9.0), ("if $a > 1 then $b else 0", "a", 5.0),
        ("$a = 4 and $b != 4", "a", True), ("$n = 0", "a", True), ("empty($n)", "a", True), ('matches($s, "^[0-9]{3}$")', "a", True), ("not($a = 4) or $b < 1", "a", False), ('$s = "123"', "a", True), ("numeric-equal($a, 4)", "a", True), ("true()", "a", True),
    ],
)
def test_columns(spark, text, language, want):
    row = spark.createDataFrame([(4.0, 5.0, None, "123")], "a double, b double, n double, s string")
    tree = (L.parse_a if language == "a" else L.parse_b)(text)
    assert row.select(compiler.to_column(tree, lambda leaf: F.col(leaf[1]), language=language)).first()[0] == want


def test_guard_defaults_to_true(spark):
    row = spark.createDataFrame([(None, 1)], "s string, k int")
    assert row.select(compiler.guard(L.parse_a('$s = "x"'), lambda leaf: F.col("s")), compiler.guard(None, None)).first()[:] == (True, True)


def test_rule_terms_expand_scopes(spark):
    t = compiler.rule_terms(spark, [{"code": "v", "expression": "{t: A, r: 1} = {t: B, r: 2; 3}", "scope": "scope({t: A, c: 5; 6, z: 7})"}, {"code": "nonlinear", "expression": "{r: 1} * {r: 2} = 3"}])
    rows = t.collect()
    assert len(rows) == 6 and {r.inst for r in rows} == {"-/5/7", "-/6/7"} and {(r.tbl, r.r, r.coef) for r in rows} == {("A", "1", 1.0), ("B", "2", -1.0), ("B", "3", -1.0)}
