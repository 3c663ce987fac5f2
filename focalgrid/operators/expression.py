"""The selection language over features: words with ``*``, phrases, ``&``, ``|``, ``&~``, ``<``, ``>`` and brackets.

Operators have no precedence and group to the right; ``<`` and ``>`` (which means at least) hold for the list just
before them.  A word has letters, ``_``, ``-`` and ``*`` only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"(?P<word>[a-zA-Z_\-*]+)|(?P<number>[0-9.]+)|(?P<op>&~|[&|()<>])|(?P<skip>.)", re.S)


@dataclass(frozen=True)
class Leaf:
    feature: str


@dataclass(frozen=True)
class Node:
    op: str
    left: object
    right: object


def parse(text: str):
    """The tree of an expression; ValueError if it is none."""
    tokens = [(m.lastgroup, m.group()) for m in _TOKEN.finditer(text) if m.lastgroup != "skip"]
    at = 0

    def peek(*values: str) -> bool:
        return at < len(tokens) and tokens[at][0] == "op" and tokens[at][1] in values

    def take():
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"unexpected end of {text!r}")
        at += 1
        return tokens[at - 1]

    def expression():
        left = limited()
        if peek("&", "|", "&~"):
            return Node(take()[1], left, expression())
        return left

    def limited():
        if peek("("):
            take()
            left = expression()
            if take()[1] != ")":
                raise ValueError(f"missing bracket in {text!r}")
        else:
            words = []
            while at < len(tokens) and tokens[at][0] == "word":
                words.append(take()[1])
            if not words:
                raise ValueError(f"a feature is missing in {text!r}")
            left = Leaf(" ".join(words))
        while peek("<", ">"):
            op = take()[1]
            kind, value = take()
            if kind != "number":
                raise ValueError(f"a number is missing in {text!r}")
            left = Node(op, left, float(value))
        return left

    tree = expression()
    if at < len(tokens):
        raise ValueError(f"unexpected {tokens[at][1]!r} in {text!r}")
    return tree


def leaves(tree) -> list[str]:
    """The distinct features of a tree, in order."""
    if isinstance(tree, Leaf):
        return [tree.feature]
    found = leaves(tree.left) + (leaves(tree.right) if tree.op not in "<>" else [])
    return list(dict.fromkeys(found))


def _both(func: str, a: Column, b: Column) -> Column:
    return {"sum": a + b, "mean": (a + b) / 2, "max": F.greatest(a, b), "min": F.least(a, b)}[func]


def weigh(tree, columns: dict[str, Column], func: str) -> Column:
    """One column: a study's weight under the expression, null if it isn't selected."""
    if isinstance(tree, Leaf):
        return columns[tree.feature]
    a = weigh(tree.left, columns, func)
    if tree.op == "<":
        return F.when(a < tree.right, a)
    if tree.op == ">":
        return F.when(a >= tree.right, a)
    b = weigh(tree.right, columns, func)
    if tree.op == "&":
        return F.when(a.isNotNull() & b.isNotNull(), _both(func, a, b))
    if tree.op == "|":
        zero = F.lit(0.0)
        return F.when(a.isNotNull() | b.isNotNull(), _both(func, F.coalesce(a, zero), F.coalesce(b, zero)))
    return F.when(b.isNull(), a)
