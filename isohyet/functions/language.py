"""The expression language: a Pratt parser from text to columns.

Statements are name = expression, parted by semicolons. Operators, from loose to tight: ?:,
comparisons (<=> gives -1, 0 or 1), + -, * /, ^ (to the right), unary minus. Missing operands make
results missing, but 0 times missing is 0.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from isohyet.operators.values import FUNCTIONS as VALUE_FUNCTIONS
from isohyet.operators.values import div0, mul0

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+(?:[eE][-+]?\d+)?)|([A-Za-z_]\w*)|(<=>|<=|>=|==|!=|[-+*/^<>?:=();,]))")
COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "<": lambda a, b: (a < b).cast("double"),
    ">": lambda a, b: (a > b).cast("double"),
    "<=": lambda a, b: (a <= b).cast("double"),
    ">=": lambda a, b: (a >= b).cast("double"),
    "==": lambda a, b: (a == b).cast("double"),
    "!=": lambda a, b: (a != b).cast("double"),
    "<=>": lambda a, b: F.when(a < b, -1.0).when(a > b, 1.0).when(a == b, 0.0),
}
ARITHMETIC = {"+": (3, lambda a, b: a + b), "-": (3, lambda a, b: a - b), "*": (4, mul0), "/": (4, div0)}


def _pandas(f: Callable[[float], float]) -> Callable[[Column], Column]:
    def run(v: Column) -> Column:
        @F.pandas_udf("double")
        def apply(x: pd.Series) -> pd.Series:
            return x.map(lambda a: f(a) if a is not None and math.isfinite(a) else np.nan).astype(float)

        return F.when(v.isNotNull(), apply(v))

    return run


def _gamma(x: float) -> float:
    return math.nan if x <= 0 and x == int(x) else math.gamma(x) if x < 171 else math.inf


FUNCTIONS: dict[str, Callable[[Column], Column]] = VALUE_FUNCTIONS | {
    "log": VALUE_FUNCTIONS["ln"],
    "floor": lambda v: F.floor(v).cast("double"),
    "ceil": lambda v: F.ceil(v).cast("double"),
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "asinh": F.asinh,
    "acosh": lambda v: F.when(v >= 1, F.acosh(v)),
    "atanh": lambda v: F.when(F.abs(v) < 1, F.atanh(v)),
    "erf": _pandas(math.erf),
    "gamma": _pandas(_gamma),
}


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at : at + 20]!r}")
        out.append(m[1] or m[2] or m[3])
        at = m.end()
    return out


class Parser:
    """variables: what a name stands for; names that were assigned before win."""

    def __init__(self, text: str, variables: Callable[[str], Column]) -> None:
        self.tokens, self.at, self.variables = tokens(text), 0, variables
        self.assigned: dict[str, Column] = {}

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, expected: str = "") -> str:
        token = self.peek()
        if not token or (expected and token != expected):
            raise ValueError(f"expected {expected or 'more'}, found {token or 'the end'}")
        self.at += 1
        return token

    def statements(self) -> dict[str, Column]:
        while self.peek():
            if self.peek() == ";":
                self.take()
                continue
            name = self.take()
            self.take("=")
            self.assigned[name] = self.ternary()
            if self.peek():
                self.take(";")
        return self.assigned

    def ternary(self) -> Column:
        condition = self.expression(1)
        if self.peek() != "?":
            return condition
        self.take("?")
        yes = self.ternary()
        self.take(":")
        no = self.ternary()
        return F.when(condition != 0, yes).when(condition == 0, no)

    def expression(self, power: int) -> Column:
        left = self.prefix()
        while True:
            token = self.peek()
            if token in COMPARE and power <= 2:
                self.take()
                left = COMPARE[token](left, self.expression(3))
            elif token in ARITHMETIC and power <= ARITHMETIC[token][0]:
                self.take()
                left = ARITHMETIC[token][1](left, self.expression(ARITHMETIC[token][0] + 1))
            elif token == "^" and power <= 6:
                self.take()
                left = F.pow(left, self.expression(6))
            else:
                return left

    def prefix(self) -> Column:
        token = self.take()
        if token == "-":
            return -self.expression(5)
        if token == "+":
            return self.expression(5)
        if token == "(":
            inner = self.ternary()
            self.take(")")
            return inner
        if token[0].isdigit() or token[0] == ".":
            return F.lit(float(token))
        if self.peek() == "(":
            if token not in FUNCTIONS:
                raise ValueError(f"no function is named {token}")
            self.take("(")
            inner = self.ternary()
            self.take(")")
            return FUNCTIONS[token](inner)
        if token in self.assigned:
            return self.assigned[token]
        return self.variables(token)


def names(text: str) -> tuple[list[str], list[str]]:
    """Names that are assigned, and names that are read before that."""
    out, reads, known = [], [], set()
    parts = tokens(text)
    for i, t in enumerate(parts):
        if re.fullmatch(r"[A-Za-z_]\w*", t):
            after = parts[i + 1] if i + 1 < len(parts) else ""
            if after == "=":
                continue
            if after != "(" and t not in known and t not in reads:
                reads.append(t)
        elif t == "=" and i:
            out.append(parts[i - 1])
        if t == ";":
            known |= set(out)
    return list(dict.fromkeys(out)), reads
