"""Formulas over one variable, compiled to a Column.

Grammar: numbers (a comma may be the decimal mark), ``x``, + - * /, unary minus, parentheses,
and abs sqrt sin cos tan log exp in any case.  Whatever isn't defined (division by zero, root
of a negative, logarithm of zero or less) is missing, i.e. NULL; a missing input stays so.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS = ("abs", "sqrt", "sin", "cos", "tan", "log", "exp")
TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|([-+*/()]))")


class FormulaError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    """kind: 'num', 'x', 'neg', one of '+-*/', or a function's name."""

    kind: str
    args: tuple[Node, ...] = ()
    value: float = 0.0


def parse(text: str) -> Node:
    """The tree of a formula; any error rejects the whole of it.  An empty text stands for x."""
    text = text.replace(",", ".").strip() or "x"
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"unexpected character at {at}: {text!r}")
        if m[1]:
            value = float(m[1])
            if not math.isfinite(value):
                raise FormulaError(f"number out of range: {m[1]}")
            tokens.append(("num", value))
        elif m[2]:
            name = m[2].lower()
            if name != "x" and name not in FUNCTIONS:
                raise FormulaError(f"unknown name: {m[2]}")
            tokens.append(("name", name))
        else:
            tokens.append((m[3], None))
        at = m.end()
    tokens.append(("end", None))
    place = 0

    def peek():
        return tokens[place][0]

    def take(kind=None):
        nonlocal place
        if kind and tokens[place][0] != kind:
            raise FormulaError(f"expected {kind!r} in {text!r}")
        place += 1
        return tokens[place - 1]

    def sums():
        left = products()
        while peek() in "+-":
            left = Node(take()[0], (left, products()))
        return left

    def products():
        left = unary()
        while peek() in "*/":
            left = Node(take()[0], (left, unary()))
        return left

    def unary():
        if peek() == "-":
            take()
            return Node("neg", (unary(),))
        return atom()

    def atom():
        kind, value = take()
        if kind == "num":
            return Node("num", value=value)
        if kind == "name" and value == "x":
            return Node("x")
        if kind == "name":
            take("(")
            inner = sums()
            take(")")
            return Node(value, (inner,))
        if kind == "(":
            inner = sums()
            take(")")
            return inner
        raise FormulaError(f"unexpected {kind!r} in {text!r}")

    tree = sums()
    take("end")
    return tree


def evaluate(tree: Node, x: Column) -> Column:
    a = [evaluate(n, x) for n in tree.args]
    match tree.kind:
        case "num":
            return F.lit(tree.value)
        case "x":
            return x
        case "neg":
            return F.when(F.abs(a[0]) != float("inf"), -a[0])
        case "+":
            return a[0] + a[1]
        case "-":
            return a[0] - a[1]
        case "*":
            return a[0] * a[1]
        case "/":
            return F.when(a[1] != 0, F.try_divide(a[0], a[1]))
        case "sqrt":
            return F.when(a[0] >= 0, F.sqrt(a[0]))
        case "log":
            return F.when(a[0] > 0, F.log(a[0]))
    return getattr(F, tree.kind)(a[0])


def affine(tree: Node) -> tuple[float, float] | None:
    """(mul, add) if the formula is mul * x + add: products and quotients with constants only, and
    all numbers on the way finite."""
    out = _affine(tree)
    return out if out is not None and all(map(math.isfinite, out)) else None


def _affine(tree: Node) -> tuple[float, float] | None:
    a = [affine(n) for n in tree.args]
    if None in a:
        return None
    match tree.kind:
        case "num":
            return 0.0, tree.value
        case "x":
            return 1.0, 0.0
        case "neg":
            return -a[0][0], -a[0][1]
        case "+":
            return a[0][0] + a[1][0], a[0][1] + a[1][1]
        case "-":
            return a[0][0] - a[1][0], a[0][1] - a[1][1]
        case "*":
            (m, c), (n, d) = a
            return (m * d, c * d) if n == 0 else (n * c, d * c) if m == 0 else None
        case "/":
            (m, c), (n, d) = a
            return (m / d, c / d) if n == 0 and d != 0 else None
    if a[0][0] == 0:
        value = _constant(tree.kind, a[0][1])
        return None if value is None else (0.0, value)
    return None


def _constant(name: str, v: float) -> float | None:
    if name == "sqrt" and v < 0 or name == "log" and v <= 0:
        return None
    try:
        out = abs(v) if name == "abs" else getattr(math, name)(v)
    except (OverflowError, ValueError):
        return None
    return out if math.isfinite(out) else None


def compile_formula(text: str, x: Column) -> Column:
    """The formula's value; NaN counts as missing."""
    out = evaluate(parse(text), x)
    return F.when(~F.isnan(out), out)


def compose(outer_first: str | None, then: str | None, x: Column) -> Column:
    """The global formula first, then the channel's own; two affine ones become one, whose
    result is missing wherever it isn't finite."""
    formulas = [f for f in (outer_first, then) if f]
    if len(formulas) == 2 and all(affine(parse(f)) for f in formulas):
        (gm, ga), (lm, la) = (affine(parse(f)) for f in formulas)
        if math.isfinite(lm * gm) and math.isfinite(lm * ga + la):
            out = F.lit(lm * gm) * x + F.lit(lm * ga + la)
            return F.when(~F.isnan(out) & (F.abs(out) != float("inf")), out)
    for f in formulas:
        x = compile_formula(f, x)
    return x
