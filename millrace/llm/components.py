"""Connected components of a link table, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def components(links: DataFrame, folder: str, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node that has a link; ``component`` is the smallest node it reaches.

    Links of a node with itself, repeated links and links with a null end say nothing; an empty table gives no rows.

    Each step is written below ``folder`` and the one before it deleted; steps go on until one changes nothing. A hub's links stay rows of
    their own throughout: only minima are gathered by node, with partial aggregation before the shuffle.
    """
    edges = written(
        links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), f"{folder}/0"
    )
    mark, k = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        k += 1
        large = written(large, f"{folder}/{k}")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        k += 1
        edges = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{folder}/{k}")
        discard(links.sparkSession, folder, str(k - 2), str(k - 1))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
