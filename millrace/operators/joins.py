"""Equi joins with a chosen strategy and build side."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How the build side reaches the probe side. "auto" leaves all to Catalyst but a build side small enough to broadcast; the others are hints.
STRATEGIES = ("auto", "broadcast", "shuffle_hash", "merge", "shuffle_replicate_nl")
#: Largest estimated size of a side that "broadcast" still broadcasts, and of the smaller side that "shuffle_replicate_nl"
#: still copies to every partition; beyond it the join is a sort-merge join, which needs no side in memory.
BROADCAST_BYTES = 256 << 20
#: Rows of the right side that a left row meets at a time in `product_join`: few enough that a page of Parquet holds the
#: same stretch of them again and again, and a multiple of the eight values that it packs together.
STRETCH = 240
#: Rows of a result that a task of `product_join` makes, about.
TASK_ROWS = 1 << 25


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of the rows of ``df``; without access to it, too many to broadcast."""
    if not hasattr(df, "_jdf"):
        return 1 << 62
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _broadcast_threshold(df: DataFrame) -> int:
    """spark.sql.autoBroadcastJoinThreshold in bytes; -1 where broadcasts are off."""
    size, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold").lower()).groups()
    return int(size) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def equi_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], build_left: bool | None = None, strategy: str = "auto") -> DataFrame:
    """Inner join on equality of all key pairs; rows with a null key match nothing, duplicates all match.

    ``build_left`` says which side is built, where the strategy builds one; None leaves it to the strategy's
    own choice, the right side. Column names of the two sides must differ.
    """
    if not keys:
        raise ValueError("a join needs at least one pair of keys")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    for a, b in keys:
        if left.schema[a].dataType != right.schema[b].dataType and "string" in (left.schema[a].dataType.simpleString(), right.schema[b].dataType.simpleString()):
            raise TypeError(f"{a} and {b} can't be compared: {left.schema[a].dataType.simpleString()} and {right.schema[b].dataType.simpleString()}")
    build = left if build_left else right
    if strategy == "broadcast" and estimated_bytes(build) > BROADCAST_BYTES:
        strategy = "merge"
    if strategy == "shuffle_replicate_nl" and min(estimated_bytes(left), estimated_bytes(right)) > BROADCAST_BYTES:
        strategy = "merge"
    if strategy == "auto" and build_left is not None and estimated_bytes(build) <= _broadcast_threshold(build):
        strategy = "broadcast"
    if strategy != "auto":
        left, right = (left.hint(strategy), right) if build_left else (left, right.hint(strategy))
    on: Column | None = None
    for a, b in keys:
        eq = F.col(a) == F.col(b)
        on = eq if on is None else on & eq
    return left.join(right, on, "inner")


def product_join(left: DataFrame, right: DataFrame, key: tuple[str, str]) -> DataFrame:
    """The inner join of ``equi_join`` on one key, for sides whose keys repeat so often that the result dwarfs them.

    The rows are those of ``equi_join``, without the right side's key. They come ordered so that a column store keeps
    them in few bytes, and from as many tasks as the counted result needs, also where there are few keys: a task has one
    stretch of the left side's rows by key, and each stretch of a key's right rows goes past all of them in turn. The left
    side should be the one with more rows of a key. All columns must have types with an order.
    """
    names = [*left.columns, *(c for c in right.columns if c != key[1])]
    a, b = f"l{left.columns.index(key[0])}", f"r{right.columns.index(key[1])}"
    left, right = (df.toDF(*(f"{side}{i}" for i in range(len(df.columns)))) for side, df in (("l", left), ("r", right)))
    rest = [c for c in right.columns if c != b]
    right = right.where(F.col(b).isNotNull())
    counts = right.groupBy(F.col(b).alias("met")).agg(F.count("*").alias("many"))
    rows = equi_join(left.groupBy(a).agg(F.count("*").alias("n")), counts, [(a, "met")]).agg(F.sum(F.col("n") * F.col("many"))).first()[0] or 0
    tasks = 1 + max(rows // TASK_ROWS, min(rows >> 20, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    number = F.row_number().over(Window.partitionBy(b).orderBy(*(rest or [b])))
    stretches = right.withColumn("stretch", F.ceil(number / STRETCH)).groupBy(F.col(b).alias("k"), "stretch").agg(F.collect_list(F.struct(*(rest or [b]))).alias("rows"))

    dealt = equi_join(left, counts, [(a, "met")], strategy="broadcast").drop("met")
    dealt = dealt.repartitionByRange(tasks, a, *(c for c in left.columns if c != a))
    dealt = dealt.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("many") / STRETCH)))).drop("many")
    # Catalyst drops a sort right below a join; it stays below a generator, here one that makes one row of each.
    dealt = dealt.sortWithinPartitions(a, "turn").withColumn("turn", F.explode(F.array("turn")))
    joined = equi_join(dealt, stretches, [(a, "k"), ("turn", "stretch")], strategy="broadcast").select(*left.columns, F.inline("rows"))
    return (joined if rest else joined.drop(b)).toDF(*names)
