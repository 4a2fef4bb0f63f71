"""CSV tables: no header, backslash escapes inside double quotes, empty fields are null."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import Predicate
from .scratch import store_of


def read_csv(spark: SparkSession, path: str, schema: T.StructType, where: Predicate | None = None, header: bool = False, separator: str = ",", multi_line: bool = True) -> DataFrame:
    """Reads with a given schema; a value that doesn't fit its column fails the query.

    ``multi_line=False`` lets Spark split large files, for data without newlines inside quotes.
    """
    df = (
        spark.read.schema(schema).option("sep", separator).option("quote", '"').option("escape", "\\").option("multiLine", multi_line)
        .option("header", header).option("mode", "FAILFAST").option("nullValue", "").option("emptyValue", None).csv(path)
    )
    return df.where(where.column()) if where else df


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("quote", '"').option("escape", "\\").option("quoteAll", True).option("emptyValue", "").option("nullValue", "").csv(path)


class FilteredCache:
    """Scans kept by source, columns and predicate: in memory, or as Parquet below ``folder``.

    What lies below the folder is found again by later sessions; ``hits`` counts the scans that were not run. Tables
    read from files are known by the files' names, sizes and times, so a changed table is scanned anew; others by
    their plan, which only the same session repeats.
    """

    def __init__(self, folder: str | None = None):
        self.folder, self.kept, self.hits = folder, {}, 0

    @staticmethod
    def key(table: str, df: DataFrame, where: Predicate | None = None) -> str:
        if files := df.inputFiles():
            seen = df.select(F.xxhash64("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").alias("h")).distinct()
            source = f"{len(files)} {seen.agg(F.bit_xor('h')).first()[0]}"
        else:
            source = str(df.semanticHash())
        text = "\0".join([table, source, df.schema.json(), where.pretty() if where else ""])
        return f"{table}-{hashlib.sha256(text.encode()).hexdigest()[:32]}"

    def get(self, table: str, df: DataFrame, where: Predicate | None = None) -> DataFrame:
        """The rows of ``df`` that ``where`` keeps; ``df`` is a table as it is read, columns chosen or not."""
        key = self.key(table, df, where)
        if key in self.kept:
            self.hits += 1
            return self.kept[key]
        found = df.where(where.column()) if where else df
        if not self.folder:
            self.kept[key] = found.persist()
            return self.kept[key]
        path = f"{self.folder.rstrip('/')}/{key}.parquet"
        if self._complete(path):
            self.hits += 1
        else:
            found.write.mode("overwrite").parquet(path)
        self.kept[key] = df.sparkSession.read.schema(found.schema).parquet(path)
        return self.kept[key]

    @staticmethod
    def _complete(path: str) -> bool:
        """Whether a writer has committed the table."""
        from pyarrow import fs

        store, at = store_of(path)
        return store.get_file_info(f"{at}/_SUCCESS").type == fs.FileType.File

    def clear(self) -> None:
        """Forgets what this object keeps; tables below the folder stay."""
        for df in self.kept.values():
            df.unpersist()
        self.kept.clear()
