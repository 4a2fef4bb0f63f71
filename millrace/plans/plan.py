"""Plans built node by node or read from EXPLAIN JSON, and their execution as DataFrames."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..operators.joins import equi_join
from .frontend import Query, SqlError, analyse, inner_name, project, scan


class PlanError(ValueError):
    """The plan is malformed or uses a node that is not supported."""


@dataclass(frozen=True)
class ScanNode:
    input: int
    outputs: tuple[int, ...]


@dataclass(frozen=True)
class JoinNode:
    """``keys`` are pairs of positions in the outputs of the children; outputs count the left child's columns first."""

    build_left: bool
    left: int
    right: int
    keys: tuple[tuple[int, int], ...]
    outputs: tuple[int, ...]


@dataclass
class Plan:
    inputs: list[DataFrame] = field(default_factory=list)
    nodes: list[ScanNode | JoinNode] = field(default_factory=list)
    root: int = -1

    def new_input(self, df: DataFrame) -> int:
        self.inputs.append(df)
        return len(self.inputs) - 1

    def new_scan(self, input_: int, outputs: list[int]) -> int:
        """A scan of chosen columns of an input, in the given order; becomes the root."""
        if not 0 <= input_ < len(self.inputs):
            raise PlanError(f"no input {input_}")
        width = len(self.inputs[input_].columns)
        if any(not 0 <= c < width for c in outputs):
            raise PlanError(f"input {input_} has {width} columns")
        return self._add(ScanNode(input_, tuple(outputs)))

    def new_join(self, build_left: bool, left: int, right: int, left_key: int | list[int], right_key: int | list[int], outputs: list[int]) -> int:
        """An inner join of two nodes; becomes the root."""
        a, b = ([k] if isinstance(k, int) else list(k) for k in (left_key, right_key))
        for node in (left, right):
            if not 0 <= node < len(self.nodes):
                raise PlanError(f"no node {node}")
        wide = len(self.nodes[left].outputs), len(self.nodes[right].outputs)
        if not a or len(a) != len(b) or any(not 0 <= x < wide[0] for x in a) or any(not 0 <= x < wide[1] for x in b):
            raise PlanError("keys are not columns of the children")
        if any(not 0 <= x < sum(wide) for x in outputs):
            raise PlanError("outputs are not columns of the children")
        return self._add(JoinNode(build_left, left, right, tuple(zip(a, b, strict=True)), tuple(outputs)))

    def _add(self, node: ScanNode | JoinNode) -> int:
        self.nodes.append(node)
        self.root = len(self.nodes) - 1
        return self.root


def execute(plan: Plan, strategy: str = "auto", observer=None) -> DataFrame:
    """The root's rows, in columns c0, c1, ...; build sides as the plan says, by hint.

    With the strategy "auto" a build side is hinted only where it is small enough to be broadcast; other joins are
    left to Catalyst, which sorts both sides and so needs none to fit in memory.

    ``observer``, a Telemetry, gets to see every join's sides and result.
    """
    if plan.root < 0:
        raise PlanError("the plan has no node")

    def make(at: int) -> DataFrame:
        node = plan.nodes[at]
        name = lambda k: f"n{at}_{k}"
        if isinstance(node, ScanNode):
            df = plan.inputs[node.input]
            return df.select(*(F.col(f"`{df.columns[c]}`").alias(name(k)) for k, c in enumerate(node.outputs)))
        left, right = make(node.left), make(node.right)
        if observer:
            left, right = observer.side(at, left, node.build_left), observer.side(at, right, not node.build_left)
        # a node used by both children gives both the same names
        right = right.toDF(*(f"r{at}_{c}" for c in right.columns))
        df = equi_join(left, right, [(left.columns[a], right.columns[b]) for a, b in node.keys], node.build_left, strategy)
        both = [*left.columns, *right.columns]
        df = df.select(*(F.col(both[c]).alias(name(k)) for k, c in enumerate(node.outputs)))
        return observer.result(at, df) if observer else df

    df = make(plan.root)
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


_THROUGH = {"Aggregate", "Gather"}
_SCANS = {"Seq Scan", "Index Only Scan"}


def from_explain(explain: dict, query: Query, catalog: Catalog, two_valued: bool = False) -> Plan:
    """A plan with the join order and build sides of an EXPLAIN tree.

    Aggregate and Gather pass through; a Hash Join has one Hash child, which is the side to build; scans name an
    alias of the query. All classes that cross a join are its keys.
    """
    plan = Plan()

    def children(node: dict, n: int) -> list[dict]:
        got = node.get("Plans", [])
        if len(got) != n:
            raise PlanError(f"{node.get('Node Type')} needs {n} children, has {len(got)}")
        return got

    def aliases(node: dict) -> set[str]:
        if node.get("Node Type") in _SCANS:
            alias = node.get("Alias")
            if alias is None:
                raise PlanError("a scan needs an alias")
            if alias not in query.tables:
                raise PlanError(f"unknown alias {alias}")
            return {alias}
        return set().union(*map(aliases, node.get("Plans", [])))

    def build(node: dict, needed: list[str]) -> int:
        kind = node.get("Node Type")
        if kind in _THROUGH:
            return build(children(node, 1)[0], needed)
        if kind in _SCANS:
            (alias,) = aliases(node)
            df = scan(query, alias, catalog, two_valued)
            return plan.new_scan(plan.new_input(df), [df.columns.index(inner_name(c)) for c in needed])
        if kind != "Hash Join":
            raise PlanError(f"not supported: {kind}")
        left, right = children(node, 2)
        hashed = [x.get("Node Type") == "Hash" for x in (left, right)]
        if sum(hashed) != 1:
            raise PlanError("a Hash Join needs exactly one Hash child")
        left, right = (children(x, 1)[0] if h else x for x, h in zip((left, right), hashed, strict=True))
        on = query.keys_between(a := aliases(left), b := aliases(right))
        if not on:
            raise PlanError(f"nothing joins {', '.join(sorted(a))} with {', '.join(sorted(b))}")
        ln = sorted({c for c in needed if c.split(".")[0] in a} | {x for x, _ in on})
        rn = sorted({c for c in needed if c.split(".")[0] in b} | {y for _, y in on})
        both = [*ln, *rn]
        left_at = build(left, ln)
        return plan.new_join(hashed[0], left_at, build(right, rn), [ln.index(x) for x, _ in on], [rn.index(y) for _, y in on], [both.index(c) for c in needed])

    tree = explain.get("Plan", explain)
    if (named := aliases(tree)) != set(query.tables):
        raise PlanError(f"the plan scans {', '.join(sorted(named))}; the query names {', '.join(sorted(query.tables))}")
    plan.root = build(tree, query.columns())
    return plan


def run_explain(text: str, explain: dict, catalog: Catalog, strategy: str = "auto", two_valued: bool = False, pipeline: bool = False, observer=None) -> DataFrame:
    """Runs a query text in the order of its EXPLAIN tree."""
    query = analyse(text, {n: df.columns for n, df in catalog.items()})
    df = execute(from_explain(explain, query, catalog, two_valued), strategy, observer)
    return project(query, df.toDF(*(inner_name(c) for c in query.columns())), pipeline, two_valued)


def load_workload(path: str) -> dict[str, tuple[str, dict]]:
    """Query text and EXPLAIN tree by name, from a JSON file with ``sql_directory``, ``names`` and ``plans``."""
    import os

    with open(path) as f:
        spec = json.load(f)
    if len(spec["names"]) != len(spec["plans"]):
        raise PlanError("names and plans differ in number")
    folder = os.path.join(os.path.dirname(path), spec["sql_directory"])
    out = {}
    for name, tree in zip(spec["names"], spec["plans"], strict=True):
        with open(os.path.join(folder, f"{name}.sql")) as f:
            out[name] = (f.read(), tree)
    return out


__all__ = ["JoinNode", "Plan", "PlanError", "ScanNode", "SqlError", "execute", "from_explain", "load_workload", "run_explain"]
