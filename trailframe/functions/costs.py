"""Cost expressions of a profile, compiled to Columns over a map of tags (RTE-01); they are evaluated without Python workers.

A profile is text: ``assign name = expression`` in prefix form, in sections ``---context:name``; ``global`` ones are known
in all others, and ``#`` begins a comment. Values are 32-bit floats, 1 and 0 for true and false, and anything but 0 counts
as true. ``key=a|b`` asks whether a tag has one of these values (``key=`` that it is absent), ``v:key`` reads a tag as a number: NaN
where it is absent, 0 where it is no number. A row that divides by zero gets null. Constants are folded when the text
is compiled; a variable is evaluated once a row, however often it is used.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[()]|[^\s()]+")
OPERANDS = {"switch": 3, "if": 3, "or": 2, "and": 2, "xor": 2, "multiply": 2, "divide": 2, "add": 2, "sub": 2, "max": 2, "min": 2, "equal": 2, "greater": 2, "lesser": 2, "not": 1}


class ProfileError(ValueError):
    pass


def single(value: float) -> float:
    """The nearest 32-bit float."""
    return struct.unpack("f", struct.pack("f", value))[0]


@dataclass(frozen=True)
class Node:
    """An operator with its operands, or a leaf: a number, a variable, tag values or a tag's number."""

    kind: str
    of: tuple = ()
    value: object = None
    names: frozenset = field(default=frozenset(), compare=False)

    @property
    def number(self) -> float | None:
        return self.value if self.kind == "number" else None


def _number(value: float) -> Node:
    return Node("number", value=single(value))


def _folded(kind: str, of: tuple[Node, ...]) -> Node:
    """The operator on its operands, shortened where constants decide it."""
    known = [x.number for x in of]
    a, b = known[0], known[1] if len(known) > 1 else None
    if kind == "switch" and a is not None:
        return of[1] if a != 0 else of[2]
    if kind in ("or", "and") and (a is not None or b is not None):
        one, other = (of[0], of[1]) if a is not None else (of[1], of[0])
        # a constant that decides stands for itself, any other leaves the second operand as it is
        return one if (one.number != 0) == (kind == "or") else other
    if kind == "add" and (a == 0 or b == 0):
        return of[1] if a == 0 else of[0]
    if None in known:
        return Node(kind, of, names=frozenset().union(*(x.names for x in of)))
    if kind == "divide" and b == 0:
        raise ProfileError("division by zero")
    plain = {
        "xor": lambda: (a != 0) != (b != 0), "multiply": lambda: a * b, "divide": lambda: a / b, "add": lambda: a + b, "sub": lambda: a - b, "max": lambda: max(a, b), "min": lambda: min(a, b),
        "equal": lambda: a == b, "greater": lambda: a > b, "lesser": lambda: a < b, "not": lambda: a == 0,
    }
    return _number(float(plain[kind]()))


def parse(text: str, context: str, outside: tuple[str, ...] = ()) -> list[tuple[str, Node]]:
    """The assignments of one context after the global ones, in order; ``outside`` names what the caller gives, such as ``way:costfactor``."""
    tokens, here = [], True
    for line in text.splitlines():
        for token in TOKEN.findall(line.partition("#")[0]):
            if token.startswith("---context:"):
                here = token.partition(":")[2] in ("global", context)
            elif here:
                tokens.append(token)
    at, known, out = 0, dict.fromkeys(outside), []

    def take(expected: str | None = None) -> str:
        nonlocal at
        if at >= len(tokens):
            raise ProfileError("unexpected end of the profile")
        token = tokens[at]
        at += 1
        if expected is not None and token != expected:
            raise ProfileError(f"{token!r} where {expected!r} was expected")
        return token

    def expression() -> Node:
        token = take()
        if token == "(":
            inner = expression()
            take(")")
            return inner
        if token in OPERANDS:
            of = [expression()]
            for word in ("then", "else")[: OPERANDS[token] - 1] if token == "if" else (None,) * (OPERANDS[token] - 1):
                if word:
                    take(word)
                of.append(expression())
            return _folded("switch" if token == "if" else token, tuple(of))
        if token == "assign":
            raise ProfileError("assign within an expression")
        if "=" in token:
            key, _, values = token.partition("=")
            return Node("tag", value=(key, tuple(v for v in values.split("|") if v)))
        if token.startswith("v:"):
            return Node("value", value=token[2:])
        if token in known:
            constant = known[token]
            return constant if constant is not None and constant.number is not None else Node("variable", value=token, names=frozenset([token]))
        if token in ("true", "false"):
            return _number(float(token == "true"))
        try:
            return _number(float(token))
        except ValueError:
            raise ProfileError(f"unknown expression: {token}") from None

    while at < len(tokens):
        take("assign")
        name = take()
        if "=" in name or ":" in name:
            raise ProfileError(f"no name of a variable: {name}")
        if at < len(tokens) and tokens[at] == "=":
            take()
        known[name] = expression()
        out.append((name, known[name]))
    return out


def _may_be_nan(node: Node) -> bool:
    return node.kind in ("value", "variable") or any(map(_may_be_nan, node.of))


def _column(node: Node, tags: Column, variables: Mapping[str, Column]) -> Column:
    single_ = lambda c: c.cast("float")
    truth = lambda c: F.when(c, 1.0).otherwise(0.0).cast("float")
    if node.kind == "number":
        return single_(F.lit(node.value))
    if node.kind == "variable":
        return variables[node.value]
    if node.kind == "tag":
        key, values = node.value
        return truth(tags[key].isNull() if not values else F.coalesce(tags[key].isin(*values), F.lit(False)))
    if node.kind == "value":
        return F.when(tags[node.value].isNull(), F.lit(float("nan"))).otherwise(F.coalesce(tags[node.value].try_cast("float"), F.lit(0.0))).cast("float")
    of = [_column(x, tags, variables) for x in node.of]
    yes = [c != 0 for c in of]  # NaN counts as true
    if node.kind in ("equal", "greater", "lesser", "max", "min"):
        a, b = of
        # no comparison with NaN holds; Spark's would
        unlike = [F.isnan(c) for c, x in zip(of, node.of, strict=True) if _may_be_nan(x)]
        holds = {"equal": a == b, "greater": a > b, "lesser": a < b, "max": a > b, "min": a < b}[node.kind]
        for u in unlike:
            holds = holds & ~u
        return F.when(holds, a).otherwise(b) if node.kind in ("max", "min") else truth(holds)
    if node.kind == "switch":
        return F.when(yes[0], of[1]).otherwise(of[2])
    return {
        "or": lambda: truth(yes[0] | yes[1]), "and": lambda: truth(yes[0] & yes[1]), "xor": lambda: truth(yes[0] != yes[1]), "not": lambda: truth(~yes[0]),
        "add": lambda: single_(of[0] + of[1]), "sub": lambda: single_(of[0] - of[1]), "multiply": lambda: single_(of[0] * of[1]), "divide": lambda: single_(F.try_divide(of[0].cast("double"), of[1].cast("double"))),
    }[node.kind]()


def costs(ways: DataFrame, text: str, context: str, wanted: tuple[str, ...], tags: str = "tags", given: Mapping[str, Column] | None = None) -> DataFrame:
    """``ways`` with a float column for each wanted variable of the profile's context; what no wanted variable needs is not evaluated.

    ``given`` are values from outside, by name. A null map of tags counts as empty. A variable that is assigned again keeps
    its last value for what follows.
    """
    given = dict(given or {})
    assigned = parse(text, context, tuple(given))
    needed, steps = set(wanted), []
    for i in range(len(assigned) - 1, -1, -1):  # the last assignment of a needed name, and what it needs
        name, node = assigned[i]
        if name in needed:
            needed.discard(name)
            needed |= node.names
            steps.append((i, name, node))
    if missing := needed - set(given):
        raise ProfileError(f"not assigned: {', '.join(sorted(missing))}")
    temp = lambda i: f"__cost_{i}"
    variables = {k: v.cast("float") for k, v in given.items()}
    rows = ways.withColumn("__tags", F.coalesce(F.col(tags), F.create_map().cast("map<string,string>")))
    for i, name, node in reversed(steps):
        rows = rows.withColumn(temp(i), _column(node, F.col("__tags"), variables))
        variables[name] = F.col(temp(i))
    return rows.select(*[F.col(f"`{c}`") for c in ways.columns], *[variables[w].alias(w) for w in wanted])
