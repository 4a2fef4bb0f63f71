"""Folders for tables written on the way."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def store_of(uri: str):
    """The file system of a URI and the path in it; works for every store pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, or below the warehouse where the session names none (and the warehouse is shared)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/millrace-scratch"
        if not spark.sparkContext.master.startswith("local") and base.startswith(("/", "file:")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
