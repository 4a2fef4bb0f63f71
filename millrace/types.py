"""The four logical types and their Spark types."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import types as T


class LogicalType(IntEnum):
    """Numbers are those of the page files."""

    INT32 = 0
    INT64 = 1
    FP64 = 2
    VARCHAR = 3


SPARK = {LogicalType.INT32: T.IntegerType(), LogicalType.INT64: T.LongType(), LogicalType.FP64: T.DoubleType(), LogicalType.VARCHAR: T.StringType()}


def logical(data_type: T.DataType) -> LogicalType:
    for k, v in SPARK.items():
        if type(v) is type(data_type):
            return k
    raise TypeError(f"no logical type for {data_type.simpleString()}")


def schema(*columns: tuple[str, LogicalType]) -> T.StructType:
    return T.StructType([T.StructField(n, SPARK[t]) for n, t in columns])
