"""Queries of a workload, each held against Spark's own evaluation of its text."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from .catalog import Catalog
from .plans.frontend import analyse, run_sql
from .plans.plan import run_explain
from .telemetry import Telemetry
from .verify import Difference, compare


@dataclass(frozen=True)
class Run:
    ms: float
    rows: int
    wrong: str | None
    report: str | None


def run_one(text: str, tree: dict | None, catalog: Catalog, strategy: str = "auto", pipeline: bool = False, telemetry: bool = False) -> Run:
    """Runs a text, in the order of its plan if one is given, and holds it against Spark's own evaluation of the text.

    The result stays on the executors; only its count and a few differing rows come to the driver.
    """
    watch = Telemetry() if telemetry and tree else None
    began = time.perf_counter()
    df = run_explain(text, tree, catalog, strategy, pipeline=pipeline, observer=watch) if tree else run_sql(text, catalog, pipeline=pipeline)
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows = df.count()
        ms = (time.perf_counter() - began) * 1000
        wrong = None
        try:
            compare(df, plain(text, catalog, pipeline))
        except Difference as e:
            wrong = str(e)
        return Run(ms, rows, wrong, watch.report() if watch else None)
    finally:
        df.unpersist()


def plain(text: str, catalog: Catalog, pipeline: bool = False) -> DataFrame:
    """The text as Spark evaluates it; in pipeline mode the columns of the select list, without functions, over the joined rows."""
    catalog.views()
    if pipeline:
        query = analyse(text, {n: t.columns for n, t in catalog.items()})
        text = "SELECT " + ", ".join(o.column for o in query.outputs if o.column) + " " + text[slice(*query.span)]
    return next(iter(catalog.values())).sparkSession.sql(text.strip().rstrip(";"))
