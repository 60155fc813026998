"""Parsers of both rule languages into one tree, and what is read off the tree (RC1-RC4, RC6-RC16, RC20, FLT7).

A tree is nested tuples: ("num", float) ("str", text) ("var", name) ("cell", Cell) ("bool", value) ("seq", [..]) ("call", name, [..])
("neg", x) ("if", condition, then, else or None) and (operator, left, right). Both parsers demand the end of the input; a `-` is
always an operator; unknown functions are errors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import product


class RuleSyntaxError(ValueError):
    """The text is no expression of the language."""


@dataclass(frozen=True)
class Cell:
    """A reference {t, r, c, z...}; r, c and z may list several codes."""

    t: str | None = None
    r: tuple[str, ...] = ()
    c: tuple[str, ...] = ()
    z: tuple[str, ...] = ()
    more: tuple[tuple[str, str], ...] = field(default=())

    def places(self) -> list[tuple[str | None, str | None, str | None]]:
        """(r, c, z) of each single cell; an axis that is not given is None."""
        return list(product(self.r or (None,), self.c or (None,), self.z or (None,)))


_TOKEN = re.compile(
    r"""\s*(?:(?P<num>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<str>"[^"]*"|'[^']*')|(?P<var>\$[A-Za-z_][\w.-]*)|(?P<cell>\{[^}]*\})"""
    r"""|(?P<op>i?(?:<=|>=|!=)|i(?=[=<>+\-*/])[=<>+\-*/]|[=<>+\-*/(),])|(?P<name>[A-Za-z_][\w.-]*(?::[A-Za-z_][\w.-]*)?))"""
)
_COMPARE = ("<=", ">=", "!=", "<", ">", "=")
FUNCTIONS = {
    "sum", "isum", "abs", "iabs", "max", "imax", "min", "imin", "exp", "count", "matches", "empty", "not", "QName", "isNull",
    "numeric-add", "numeric-subtract", "numeric-multiply", "numeric-divide", "numeric-equal",
    "numeric-less-than", "numeric-less-equal-than", "numeric-greater-than", "numeric-greater-equal-than",
}


def parse_cell(text: str) -> Cell:
    """The inside of braces or of a scope clause: key: value, ..."""
    found: dict[str, str] = {}
    for part in re.split(r",(?=\s*[A-Za-z]+\s*:)", text.strip("{} ")):
        key, colon, value = part.partition(":")
        if not colon:
            raise RuleSyntaxError(f"cell part {part!r}")
        found[key.strip()] = value.strip()
    many = {k: tuple(x.strip() for x in found.pop(k, "").split(";") if x.strip()) for k in "rcz"}
    return Cell(found.pop("t", None), many["r"], many["c"], many["z"], tuple(sorted(found.items())))


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise RuleSyntaxError(f"at {at}: {text[at : at + 20]!r}")
        kind = m.lastgroup
        value = m[kind]
        out.append((kind, value[1:] if kind == "op" and value[0] == "i" else value))
        at = m.end()
    return out


class _Parser:
    """Precedence climbing over: or, and, comparison, sum, product, sign, atom."""

    def __init__(self, text: str, logic: bool):
        self.tokens, self.at, self.logic = _tokens(text), 0, logic

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise RuleSyntaxError(f"{value!r} expected at token {self.at}")

    def whole(self):
        tree = self.top()
        if self.at < len(self.tokens):
            raise RuleSyntaxError(f"left over: {self.tokens[self.at :]}")
        return tree

    def top(self):
        if self.take("if", "If"):
            condition = self.top()
            self.take("then")
            then = self.top()
            return ("if", condition, then, self.top() if self.take("else") else None)
        return self.either() if self.logic else self.compare()

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self):
        tree = self.compare()
        while self.take("and"):
            tree = ("and", tree, self.compare())
        return tree

    def compare(self):
        tree = self.sum()
        if op := self.take(*_COMPARE):
            tree = (op, tree, self.sum())
        return tree

    def sum(self):
        tree = self.product()
        while op := self.take("+", "-"):
            tree = (op, tree, self.product())
        return tree

    def product(self):
        tree = self.sign()
        while op := self.take("*", "/"):
            tree = (op, tree, self.sign())
        return tree

    def sign(self):
        return ("neg", self.sign()) if self.take("-") else self.atom()

    def atom(self):
        if self.at >= len(self.tokens):
            raise RuleSyntaxError("unexpected end")
        if self.peek("if"):
            return self.top()
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return ("num", float(value))
        if kind == "str":
            return ("str", value[1:-1])
        if kind == "var":
            return ("var", value[1:])
        if kind == "cell":
            return ("cell", parse_cell(value))
        if value == "(":
            items = [self.top()]
            while self.take(","):
                items.append(self.top())
            self.need(")")
            return items[0] if len(items) == 1 else ("seq", items)
        if kind == "name":
            name = value.rpartition(":")[2]
            if name in ("true", "false"):
                if self.take("("):
                    self.need(")")
                return ("bool", name == "true")
            if name not in FUNCTIONS:
                raise RuleSyntaxError(f"unknown function {name!r}")
            self.need("(")
            items = []
            while not self.take(")"):
                items.append(self.top())
                if not self.peek(")"):
                    self.need(",")
            return ("call", name, items)
        raise RuleSyntaxError(f"unexpected {value!r}")


def parse_a(text: str):
    """RC1: language A (variables, and / or, functions with a prefix)."""
    return _Parser(text, True).whole()


def parse_b(text: str):
    """RC2: language B (cells, i-prefixed operators, if without and / or)."""
    return _Parser(text, False).whole()


def parse_scope(text: str) -> Cell | None:
    """RC4: scope({...}) or scope((...), (...)): rows, columns and layers united, the first table kept."""
    parts = re.findall(r"\{([^}]*)\}", text or "") or re.findall(r"\(([^()]*)\)", text or "")
    if not parts:
        return None
    cells = [parse_cell(p) for p in parts]
    joined = {k: tuple(dict.fromkeys(x for cell in cells for x in getattr(cell, k))) for k in "rcz"}
    return Cell(cells[0].t, joined["r"], joined["c"], joined["z"])


def walk(tree):
    """Every node, from the top."""
    yield tree
    if isinstance(tree, tuple):
        for x in tree[1:]:
            if isinstance(x, tuple) and x and isinstance(x[0], str):
                yield from walk(x)
            elif isinstance(x, list):
                for y in x:
                    yield from walk(y)


def cells(tree) -> list[Cell]:
    return [n[1] for n in walk(tree) if isinstance(n, tuple) and n[0] == "cell"]


def variables(tree) -> list[str]:
    """All variables, on either side of and / or too."""
    return list(dict.fromkeys(n[1] for n in walk(tree) if isinstance(n, tuple) and n[0] == "var"))


def unwrap(tree):
    """RC9: (condition or None, core) of an if without else."""
    return (tree[1], tree[2]) if tree[0] == "if" else (None, tree)


def linear(tree) -> tuple[dict, float] | None:
    """RC6, RC3: {leaf: coefficient} and constant of a linear expression, or None. Leaves are cells and variables; a cell that lists
    several places is their sum; abs is dropped, as values are taken to be at least 0."""
    kind = tree[0]
    if kind == "num":
        return {}, tree[1]
    if kind in ("cell", "var"):
        return {tree: 1.0}, 0.0
    if kind == "neg":
        return _scaled(linear(tree[1]), -1.0)
    if kind == "seq":
        return _added([linear(x) for x in tree[1]])
    if kind == "call":
        if tree[1] in ("sum", "isum"):
            return _added([linear(x) for x in tree[2]])
        return linear(tree[2][0]) if tree[1] in ("abs", "iabs") and len(tree[2]) == 1 else None
    if kind in ("+", "-"):
        return _added([linear(tree[1]), _scaled(linear(tree[2]), 1.0 if kind == "+" else -1.0)])
    if kind in ("*", "/"):
        a, b = linear(tree[1]), linear(tree[2])
        if a is None or b is None:
            return None
        if not b[0]:
            return None if kind == "/" and not b[1] else _scaled(a, b[1] if kind == "*" else 1 / b[1])
        return _scaled(b, a[1]) if kind == "*" and not a[0] else None
    return None


def _scaled(x, k: float):
    return None if x is None else ({a: c * k for a, c in x[0].items()}, x[1] * k)


def _added(parts):
    if any(p is None for p in parts):
        return None
    total: dict = {}
    for p in parts:
        for a, c in p[0].items():
            total[a] = total.get(a, 0.0) + c
    return {a: c for a, c in total.items() if abs(c) > 1e-9}, sum(p[1] for p in parts)


def constraint(tree) -> tuple[str, dict, float] | None:
    """RC7: (`=` or `<=`, coefficients, right side) of a linear comparison, or None. A strict one counts as its closure."""
    if tree[0] not in _COMPARE or tree[0] == "!=":
        return None
    a, b = linear(tree[1]), linear(tree[2])
    if a is None or b is None:
        return None
    coefficients, constant = _added([a, _scaled(b, -1.0)])
    if tree[0] in (">", ">="):
        coefficients, constant = _scaled((coefficients, constant), -1.0)
    return "=" if tree[0] == "=" else "<=", coefficients, -constant + 0.0


def comparison(tree) -> tuple[str, object, object] | None:
    """RC20: (operator, left, right), infix or by a function's name."""
    named = {"numeric-equal": "=", "numeric-less-than": "<", "numeric-less-equal-than": "<=", "numeric-greater-than": ">", "numeric-greater-equal-than": ">="}
    if tree[0] in _COMPARE:
        return tree
    if tree[0] == "call" and tree[1] in named and len(tree[2]) == 2:
        return named[tree[1]], *tree[2]
    return None


def derivation(tree):
    """RC8: (target, right side) of an equality with a lone variable or cell on a side."""
    found = comparison(tree)
    if found and found[0] == "=":
        for target, rest in ((found[1], found[2]), (found[2], found[1])):
            if target[0] in ("var", "cell"):
                return target, rest
    return None


def const_bound(tree) -> tuple[str, str, float] | None:
    """RC10: (variable, operator, number), turned round if the number comes first."""
    found = comparison(tree)
    if not found:
        return None
    op, a, b = found
    if a[0] == "num":
        a, b, op = b, a, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
    return (a[1], op, b[1]) if a[0] == "var" and b[0] == "num" else None


def must_be_absent(tree) -> list:
    """RC11: the variables or cells of empty(...) and isNull(...)."""
    return [x for n in walk(tree) if isinstance(n, tuple) and n[0] == "call" and n[1] in ("empty", "isNull") for x in n[2]]


def aggregate_equality(tree) -> tuple[str, str] | None:
    """RC12: (total, parts) of $t = sum($s)."""
    found = derivation(tree)
    if found and found[0][0] == "var" and found[1][0] == "call" and found[1][1] in ("sum", "isum") and len(found[1][2]) == 1 and found[1][2][0][0] == "var":
        return found[0][1], found[1][2][0][1]
    return None


def constant_sum(tree) -> tuple[list[Cell], float] | None:
    """RC16: cells that add up to a number."""
    found = constraint(tree)
    if not found or found[0] != "=" or not found[2] or len(found[1]) < 2:
        return None
    ones = {round(c / next(iter(found[1].values())), 9) for c in found[1].values()}
    return ([leaf[1] for leaf in found[1]], found[2] / next(iter(found[1].values()))) if ones == {1.0} else None


def is_nonlinear(tree) -> bool:
    """FLT7."""
    found = comparison(unwrap(tree)[1])
    return any(linear(side) is None for side in (found[1:] if found else [tree]))
