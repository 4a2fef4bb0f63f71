"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of text that one Python step holds as Python objects.
SLICE_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(name: str) -> Column:
    """The column's UTF-8 bytes; null stays null."""
    return F.col(name).cast("string").cast("binary")


def arrow_type(spark_type: str) -> pa.DataType:
    return {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
        "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
        "array<int>": pa.list_(pa.int32()),
    }[spark_type]


def spark_type(name: str) -> T.DataType:
    return {
        "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType(),
        "binary": T.BinaryType(), "array<long>": T.ArrayType(T.LongType()), "array<int>": T.ArrayType(T.IntegerType()),
    }[name]


def out_schema(id_col: str, id_type: T.DataType, fields: list[tuple[str, str]]) -> T.StructType:
    return T.StructType([T.StructField(id_col, id_type), *(T.StructField(n, spark_type(t)) for n, t in fields)])


#: What operators keep in a Python worker between tasks: functions that drop it, by operator.
KEPT: dict[str, Callable[[], None]] = {}


def make_room(own: str = "") -> None:
    """Drops what other operators' tasks have left in this worker, and hands freed memory back to the system."""
    import ctypes

    for name, drop in KEPT.items():
        if name != own:
            drop()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named c0, c1, .. by position, and the new names of ``names``.

    Whatever the caller's columns are called (dots, names an operator uses itself), none can clash after this.
    """
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), [f"c{df.columns.index(n)}" for n in names]


def with_row(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """Column ``row`` with all columns of ``df`` by position, and where ``names`` are in it.

    An operator that takes ``row`` as id and a field of it as text returns whole rows without a join.
    """
    df, inner = numbered(df, *names)
    return df.select(F.struct(*df.columns).alias("row")), [f"row.{c}" for c in inner]


def unpacked(df: DataFrame, columns: list[str], changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns that :func:`with_row` has put into ``row``, under their own names again; ``changed`` replaces some."""
    cols = [(changed or {}).get(c, F.col(f"row.c{i}")).alias(f"c{i}") for i, c in enumerate(columns)]
    return df.select(*cols).toDF(*columns)


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Callable[[pa.RecordBatch], list[bytes | None]]]:
    """The columns to send to Python, the id first, and a function that takes the UTF-8 texts from a batch.

    A text column inside the id column (``id_col.name``) is sent once.
    """
    if text_col.startswith(f"{id_col}."):
        name = text_col[len(id_col) + 1 :]
        return df.select(F.col(id_col).alias("__id")), lambda batch: batch.column(0).field(name).cast(pa.binary()).to_pylist()
    if {id_col, text_col} <= {*df.columns}:
        df, (id_col, text_col) = numbered(df, id_col, text_col)
    return df.select(F.col(id_col).alias("__id"), utf8(text_col).alias("__text")), lambda batch: batch.column(1).to_pylist()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most SLICE_ROWS rows, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def map_texts(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Callable], fields: list[tuple[str, str]]) -> DataFrame:
    """One output row for each input row: the id column and ``fields``.

    ``make`` runs once in each task and returns a function from a list of texts (UTF-8 or None) to a list of tuples,
    one for each text, in the order of ``fields``. Only the id and the text reach Python.
    """
    src, texts_of = id_and_text(df, id_col, text_col)
    types = [arrow_type(t) for _, t in fields]
    names = [id_col, *(n for n, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for part in slices(batches):
            step = step or make()
            cols = zip(*step(texts_of(part)), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, type=t) for c, t in zip(cols, types, strict=True))], names=names)

    return src.mapInArrow(run, out_schema(id_col, src.schema["__id"].dataType, fields))


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, the folder all executors share.

    Where the session names none, the warehouse folder stands in; on a cluster it must then be one that all executors see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/millrace-work"
        if not spark.sparkContext.master.startswith("local") and base.startswith(("/", "file:")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Deletes tables below ``folder`` that no later step reads."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows of ``df`` from a Parquet table at ``path``: cuts the lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Largest side that an operator broadcasts, in values of eight bytes. A larger side is joined by shuffle.
BROADCAST_VALUES = 4_000_000


def small(df: DataFrame, values: str | int = 1) -> DataFrame:
    """``df`` marked for broadcast if its rows hold few values; ``values`` counts those of a row. Reads ``df``, a written table."""
    total = df.agg(F.sum(F.expr(str(values)))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_VALUES else df


def release(spark: SparkSession) -> None:
    """Lets Spark's context cleaner drop the shuffle files of frames that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim_executors(spark: SparkSession) -> None:
    """Has the executors' JVMs collect their heaps and hand what is free back to the system, for Python workers to use.

    A task for each core reaches every idle executor; one that is missed only keeps its heap as it is.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')").alias("gc")).collect()


def least_hash(df: DataFrame, id_col: str, n: int, salt: str = "") -> DataFrame:
    """The ``n`` rows of least hash of their id, ties by id: a sample that depends on the ids alone.

    Rows are first cut by a hash bound that leaves about 2n of them, so that what is sorted does not grow with
    the number of partitions; the bound leaves fewer than n rows only where few ids repeat many rows.
    """
    h, total = F.xxhash64(F.concat(F.lit(salt), F.col(id_col).cast("string"))), df.count()
    if total > 4 * n:
        df = df.where(h < F.lit(-(1 << 63) + (1 << 64) * 2 * n // total))
    return df.orderBy(h, id_col).limit(n)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
