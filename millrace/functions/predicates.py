"""Predicates as values: built by hand or by the SQL front end, compiled to Spark columns.

Names are ``column`` or ``alias.column``. By default logic is SQL's, with three values. With ``two_valued`` every
leaf that meets a null is false before NOT, AND and OR see it, as in bitmap evaluation: NOT of a comparison with
null is then true.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = int | float | str
Resolver = Callable[[str], Column]

_SYMBOLS = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", ">": "__gt__", "<=": "__le__", ">=": "__ge__"}


def by_name(name: str) -> Column:
    return F.col(name)


class Predicate:
    def column(self, resolve: Resolver = by_name, two_valued: bool = False) -> Column:
        raise NotImplementedError

    def names(self) -> set[str]:
        raise NotImplementedError

    def pretty(self, depth: int = 0) -> str:
        """The tree as text, one node a line; equal text means an equal predicate."""
        raise NotImplementedError

    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)


class _Leaf(Predicate):
    def _test(self, resolve: Resolver) -> Column:
        raise NotImplementedError

    def column(self, resolve: Resolver = by_name, two_valued: bool = False) -> Column:
        c = self._test(resolve)
        return F.coalesce(c, F.lit(False)) if two_valued else c


@dataclass(frozen=True)
class Compare(_Leaf):
    """A column against a constant."""

    name: str
    op: str
    value: Value

    def __post_init__(self):
        if self.op not in _SYMBOLS:
            raise ValueError(f"unknown comparison {self.op}")

    def _test(self, resolve):
        return getattr(resolve(self.name), _SYMBOLS[self.op])(F.lit(self.value))

    def names(self):
        return {self.name}

    def pretty(self, depth=0):
        return f"{'  ' * depth}{self.name} {self.op} {self.value!r}"


@dataclass(frozen=True)
class Same(_Leaf):
    """Equality of two columns of one table."""

    left: str
    right: str

    def _test(self, resolve):
        return resolve(self.left) == resolve(self.right)

    def names(self):
        return {self.left, self.right}

    def pretty(self, depth=0):
        return f"{'  ' * depth}{self.left} = {self.right}"


@dataclass(frozen=True)
class Like(_Leaf):
    """LIKE without an escape character; ``negated`` is NOT LIKE, which never selects a null."""

    name: str
    pattern: str
    negated: bool = False

    def _test(self, resolve):
        c = resolve(self.name).like(self.pattern.replace("\\", "\\\\"))
        return ~c if self.negated else c

    def names(self):
        return {self.name}

    def pretty(self, depth=0):
        return f"{'  ' * depth}{self.name} {'NOT LIKE' if self.negated else 'LIKE'} {self.pattern!r}"


@dataclass(frozen=True)
class IsNull(Predicate):
    name: str
    negated: bool = False

    def column(self, resolve=by_name, two_valued=False):
        c = resolve(self.name)
        return c.isNotNull() if self.negated else c.isNull()

    def names(self):
        return {self.name}

    def pretty(self, depth=0):
        return f"{'  ' * depth}{self.name} IS {'NOT ' * self.negated}NULL"


@dataclass(frozen=True)
class Between(_Leaf):
    name: str
    low: Value
    high: Value

    def _test(self, resolve):
        return resolve(self.name).between(F.lit(self.low), F.lit(self.high))

    def names(self):
        return {self.name}

    def pretty(self, depth=0):
        return f"{'  ' * depth}{self.name} BETWEEN {self.low!r} AND {self.high!r}"


@dataclass(frozen=True)
class In(_Leaf):
    name: str
    values: tuple[Value, ...]

    def __post_init__(self):
        if not self.values or any(v is None for v in self.values):
            raise ValueError("IN needs constants other than null")

    def _test(self, resolve):
        return resolve(self.name).isin(list(self.values))

    def names(self):
        return {self.name}

    def pretty(self, depth=0):
        return f"{'  ' * depth}{self.name} IN {self.values!r}"


class _Many(Predicate):
    word, join = "", staticmethod(and_)

    def __init__(self, parts):
        flat = []
        for p in parts:
            flat += p.parts if type(p) is type(self) else [p]
        if not flat:
            raise ValueError(f"{self.word} of nothing")
        self.parts = tuple(flat)

    def __eq__(self, other):
        return type(self) is type(other) and self.parts == other.parts

    def __hash__(self):
        return hash((self.word, self.parts))

    def column(self, resolve=by_name, two_valued=False):
        return reduce(self.join, (p.column(resolve, two_valued) for p in self.parts))

    def names(self):
        return set().union(*(p.names() for p in self.parts))

    def pretty(self, depth=0):
        return "\n".join([f"{'  ' * depth}{self.word}", *(p.pretty(depth + 1) for p in self.parts)])


class And(_Many):
    word, join = "AND", staticmethod(and_)


class Or(_Many):
    word, join = "OR", staticmethod(or_)


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate

    def column(self, resolve=by_name, two_valued=False):
        return ~self.part.column(resolve, two_valued)

    def names(self):
        return self.part.names()

    def pretty(self, depth=0):
        return f"{'  ' * depth}NOT\n{self.part.pretty(depth + 1)}"


def all_of(parts: list[Predicate]) -> Predicate | None:
    return None if not parts else parts[0] if len(parts) == 1 else And(parts)
