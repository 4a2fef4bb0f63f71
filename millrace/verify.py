"""Comparison of results as bags of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Difference(AssertionError):
    """Two results differ; the message says in what."""


def compare(found: DataFrame, expected: DataFrame) -> int:
    """Checks column count, types and rows, each row as often; returns the number of rows. Distributed: nothing is collected but a few differing rows."""
    a, b = [f.dataType for f in found.schema.fields], [f.dataType for f in expected.schema.fields]
    if len(a) != len(b):
        raise Difference(f"{len(a)} columns, expected {len(b)}")
    if a != b:
        raise Difference(f"types {[x.simpleString() for x in a]}, expected {[x.simpleString() for x in b]}")
    names = [f"c{i}" for i in range(len(a))]
    both = found.toDF(*names).withColumn("side", F.lit(1)).unionByName(expected.toDF(*names).withColumn("side", F.lit(-1)))
    odd = both.groupBy(*names).agg(F.sum("side").alias("more")).where("more <> 0")
    if rows := odd.limit(5).collect():
        raise Difference("rows differ: " + "; ".join(f"{r['more']:+d} x {tuple(r)[:-1]}" for r in rows))
    return found.count()


def show(rows, limit: int = 20) -> str:
    """Rows as text: fields between bars, strings quoted and escaped, NULL for null."""
    escapes = str.maketrans({'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"})
    cell = lambda v: "NULL" if v is None else f'"{v.translate(escapes)}"' if isinstance(v, str) else str(v)
    return "\n".join("|".join(map(cell, r)) for r in rows[:limit])
