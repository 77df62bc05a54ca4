"""The scalar expression language of rates and parameters.

Grammar, tightest first: postfix ``!``; ``^`` and ``%`` (right, left); ``*`` and
``/``; ``+`` and ``-``; comparisons. Names are case-insensitive. A product sign
may be left out between a number or a closing parenthesis and what follows
(``4cos(0)``, ``(2)(2)``). A minus sign opens an expression only inside
parentheses. All arithmetic is in doubles; comparisons give 1 or 0. ``if`` takes
its condition as true from 1 on. ``log10`` is the logarithm to base 10 and
``x ^ n`` the power, for every n.

An expression evaluates on the driver (``value``, ``double``) or becomes a
Spark Column over columns named like its parameters (``column``); both follow
IEEE rules where Spark alone would give null or an error.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


class ExpressionError(ValueError):
    """The text is not an expression, or names an unknown parameter."""


#: name -> (precedence, right-associative)
BINARY = {"==": (0, False), "!=": (0, False), ">": (0, False), ">=": (0, False), "<": (0, False), "<=": (0, False), "+": (1, False), "-": (1, False), "*": (2, False), "/": (2, False), "%": (3, False), "^": (3, True)}
#: name -> number of arguments
CALLS = {**dict.fromkeys("cos sin tan cosh sinh tanh exp log log2 log10 ceil floor abs sqrt".split(), 1), "max": 2, "min": 2, "and": 2, "or": 2, "if": 3}
CONSTANTS = {"pi": math.pi, "e": math.e}
_TOKEN = re.compile(r"\d+\.?\d*|\.\d+|[a-z_]\w*|[<>=!]=|[-+*/%^!<>(),]")


def _quiet(f: Callable[..., float]) -> Callable[..., float]:
    """IEEE results where Python raises."""

    def run(*args: float) -> float:
        try:
            return f(*args)
        except OverflowError:
            return math.inf
        except ValueError:
            return math.nan

    return run


def _divide(a: float, b: float) -> float:
    if b:
        return a / b
    return math.nan if a == 0 or math.isnan(a) else math.copysign(math.inf, a) * math.copysign(1, b)


def _log(f: Callable[[float], float]) -> Callable[[float], float]:
    return _quiet(lambda x: -math.inf if x == 0 else f(x))


def _whole(f: Callable[[float], int]) -> Callable[[float], float]:
    return lambda x: float(f(x)) if math.isfinite(x) else x


def _power(a: float, b: float) -> float:
    try:
        return math.pow(a, b)
    except OverflowError:
        return math.inf
    except ValueError:
        return math.inf if a == 0 else math.nan


def _factorial(x: float) -> float:
    if math.isnan(x) or x < 0:
        return math.nan
    return float(math.factorial(int(x))) if x < 171 else math.inf


EVAL: dict[str, Callable[..., float]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": _divide, "^": _power,
    "%": _quiet(math.fmod), "!": _factorial,
    "==": lambda a, b: float(a == b), "!=": lambda a, b: float(a != b), ">": lambda a, b: float(a > b),
    ">=": lambda a, b: float(a >= b), "<": lambda a, b: float(a < b), "<=": lambda a, b: float(a <= b),
    "max": lambda a, b: b if a < b else a, "min": lambda a, b: b if b < a else a,
    "and": lambda a, b: float(bool(a) and bool(b)), "or": lambda a, b: float(bool(a) or bool(b)),
    "if": lambda p, a, b: a if p >= 1 else b,
    "log": _log(math.log), "log2": _log(math.log2), "log10": _log(math.log10),
    "ceil": _whole(math.ceil), "floor": _whole(math.floor), "abs": abs,
    **{x: _quiet(getattr(math, x)) for x in ("cos", "sin", "tan", "cosh", "sinh", "tanh", "exp", "sqrt")},
}


def _flag(p: Column) -> Column:
    return F.when(p, F.lit(1.0)).otherwise(F.lit(0.0))


def _c_divide(a: Column, b: Column) -> Column:
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def _c_mod(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(float("nan"))).otherwise(F.try_mod(a, b))


def _c_log(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(f(x))


def _c_factorial(x: Column) -> Column:
    # Spark's own factorial ends at 20; a product of doubles goes on to 170.
    steps = F.when((x >= 1) & (x < 171), F.sequence(F.lit(1), x.cast("int"))).otherwise(F.array().cast("array<int>"))
    product = F.aggregate(steps, F.lit(1.0), lambda a, k: a * k)
    return F.when(x.isNull(), F.lit(None).cast("double")).when((x < 0) | F.isnan(x), F.lit(float("nan"))).when(x >= 171, F.lit(float("inf"))).otherwise(product)


def _nan_safe(a: Column, b: Column, p: Column) -> Column:
    """p as IEEE compares: false if either side is not a number."""
    return _flag(p & ~F.isnan(a) & ~F.isnan(b))


COLUMN: dict[str, Callable[..., Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": _c_divide, "%": _c_mod, "^": F.pow, "!": _c_factorial,
    "==": lambda a, b: _nan_safe(a, b, a == b), "!=": lambda a, b: F.lit(1.0) - _nan_safe(a, b, a == b),
    ">": lambda a, b: _nan_safe(a, b, a > b), ">=": lambda a, b: _nan_safe(a, b, a >= b),
    "<": lambda a, b: _nan_safe(a, b, a < b), "<=": lambda a, b: _nan_safe(a, b, a <= b),
    "max": lambda a, b: F.when(_nan_safe(a, b, a < b) == 1, b).otherwise(a), "min": lambda a, b: F.when(_nan_safe(a, b, b < a) == 1, b).otherwise(a),
    "and": lambda a, b: _flag((a != 0) & (b != 0)), "or": lambda a, b: _flag((a != 0) | (b != 0)),
    "if": lambda p, a, b: F.when((p >= 1) & ~F.isnan(p), a).otherwise(b),
    "log": _c_log(F.ln), "log2": _c_log(F.log2), "log10": _c_log(F.log10),
    "ceil": lambda x: F.when(F.abs(x) < 2.0**52, F.ceil(x).cast("double")).otherwise(x), "floor": lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x),
    "abs": F.abs, "sqrt": F.sqrt, **{x: getattr(F, x) for x in ("cos", "sin", "tan", "cosh", "sinh", "tanh", "exp")},
}


@dataclass(frozen=True)
class Node:
    """A number (op is None), a parameter (op is 'param') or an operation."""

    op: str | None
    args: tuple[Node, ...] = ()
    number: float = 0.0
    name: str = ""


class _Parser:
    def __init__(self, text: str):
        self.source = text
        clean = re.sub(r"\s+", "", text).lower()
        self.tokens = _TOKEN.findall(clean)
        if "".join(self.tokens) != clean:
            raise ExpressionError(f"cannot read {text!r}")
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, want: str = "") -> str:
        token = self.peek()
        if not token or (want and token != want):
            raise ExpressionError(f"expected {want or 'more'} in {self.source!r}")
        self.at += 1
        return token

    def whole(self) -> Node:
        node = self.binary(0)
        if self.peek():
            raise ExpressionError(f"unexpected {self.peek()!r} in {self.source!r}")
        return node

    def binary(self, least: int) -> Node:
        left = self.postfix()
        while True:
            op, implied = self.peek(), False
            if op not in BINARY:
                # A product without its sign, after a number or a parenthesis.
                implied = bool(op) and (op == "(" or op[0].isalnum() or op[0] in "._") and self.closed
                if not implied:
                    return left
                op = "*"
            precedence, right = BINARY[op]
            if precedence < least:
                return left
            if not implied:
                self.at += 1
            left = Node(op, (left, self.binary(precedence + (not right))))

    def postfix(self) -> Node:
        node = self.primary()
        while self.peek() == "!":
            self.at += 1
            node = Node("!", (node,))
            self.closed = True
        return node

    def primary(self) -> Node:
        token = self.take()
        if token == "(":
            if self.peek() in ("-", "+"):  # a sign directly inside parentheses
                sign = self.take()
                inner = self.signed() if sign == "-" else self.binary(0)
            else:
                inner = self.binary(0)
            self.take(")")
            self.closed = True
            return inner
        if token[0].isdigit() or token[0] == ".":
            self.closed = True
            return Node(None, number=float(token))
        if token in CALLS and self.peek() == "(":
            return self.call(token)
        if token in CALLS:
            raise ExpressionError(f"{token} needs arguments in {self.source!r}")
        if token[0].isalpha() or token[0] == "_":
            self.closed = False
            if token in CONSTANTS:
                return Node(None, number=CONSTANTS[token])
            return Node("param", name=token)
        raise ExpressionError(f"unexpected {token!r} in {self.source!r}")

    def signed(self) -> Node:
        """What follows a leading minus: zero minus it."""
        node = Node("-", (Node(None), self.binary(2)))
        while self.peek() in BINARY:
            op = self.take()
            precedence, right = BINARY[op]
            node = Node(op, (node, self.binary(precedence + (not right))))
        return node

    def call(self, name: str) -> Node:
        self.take("(")
        args = []
        for k in range(CALLS[name]):
            if k:
                self.take(",")
            if self.peek() == "-":
                self.at += 1
                args.append(self.signed())
            else:
                args.append(self.binary(0))
        self.take(")")
        self.closed = True
        return Node(name, tuple(args))

    closed = False


class Expression:
    """A parsed expression. Equal expressions have equal postfix text."""

    def __init__(self, text: str | int | float = ""):
        self.text = repr(text) if isinstance(text, float) else str(text)
        self.node = fold(_Parser(self.text).whole() if self.text.strip() else Node(None)) if not (isinstance(text, int) and text < 0) else Node(None, number=float(text))

    @property
    def parameters(self) -> frozenset[str]:
        return _names(self.node)

    @property
    def static(self) -> bool:
        return self.node.op is None

    def double(self, values: Mapping[str, float] | None = None) -> float:
        given = {k.lower(): v for k, v in (values or {}).items()}

        def run(n: Node) -> float:
            if n.op is None:
                return n.number
            if n.op == "param":
                if n.name not in given:
                    raise ExpressionError(f"no parameter {n.name!r} for {self.text!r}")
                return float(given[n.name])
            return EVAL[n.op](*map(run, n.args))

        return run(self.node)

    def value(self, values: Mapping[str, float] | None = None) -> int:
        """The double, cut to a whole number."""
        found = self.double(values)
        if not math.isfinite(found):
            raise ExpressionError(f"{self.text!r} has no whole value")
        return int(found)

    def column(self, columns: Mapping[str, Column] | None = None) -> Column:
        """The expression over columns, by default those named like its parameters."""
        given = {k.lower(): v for k, v in (columns or {}).items()}

        def run(n: Node) -> Column:
            if n.op is None:
                return F.lit(n.number)
            if n.op == "param":
                return given.get(n.name, F.col(n.name)).cast("double")
            return COLUMN[n.op](*map(run, n.args))

        return run(self.node)

    def postfix(self) -> str:
        def run(n: Node) -> list[str]:
            return [_leaf(n)] if n.op in (None, "param") else [*(x for a in n.args for x in run(a)), n.op]

        return " ".join(run(self.node))

    def infix(self) -> str:
        def run(n: Node) -> str:
            if n.op in (None, "param"):
                return _leaf(n)
            args = [run(a) for a in n.args]
            if n.op == "!":
                return f"{args[0]}!"
            return f"({args[0]}{n.op}{args[1]})" if n.op in BINARY else f"{n.op}({','.join(args)})"

        return run(self.node)

    def reordered(self) -> Expression:
        """The expression with the numbers of every sum and product together."""
        out = Expression.__new__(Expression)
        out.text, out.node = self.text, fold(_gather(self.node))
        return out

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Expression) and self.postfix() == other.postfix()

    def __hash__(self) -> int:
        return hash(self.postfix())

    def __repr__(self) -> str:
        return f"Expression({self.text!r})"


def _leaf(n: Node) -> str:
    return n.name if n.op == "param" else f"{n.number:.17g}"


def _names(n: Node) -> frozenset[str]:
    return frozenset({n.name}) if n.op == "param" else frozenset().union(*map(_names, n.args))


def fold(n: Node) -> Node:
    """Operations on numbers only become numbers."""
    if n.op in (None, "param"):
        return n
    args = tuple(map(fold, n.args))
    return Node(None, number=EVAL[n.op](*(a.number for a in args))) if all(a.op is None for a in args) else Node(n.op, args)


def _gather(n: Node) -> Node:
    if n.op not in ("+", "*"):
        return Node(n.op, tuple(map(_gather, n.args)), n.number, n.name)
    flat, stack = [], [n]
    while stack:
        x = stack.pop()
        if x.op == n.op:
            stack += reversed(x.args)
        else:
            flat.append(_gather(x))
    numbers, rest = [x for x in flat if x.op is None], [x for x in flat if x.op is not None]
    ordered = numbers + rest
    out = ordered[0]
    for x in ordered[1:]:
        out = Node(n.op, (out, x))
    return out
