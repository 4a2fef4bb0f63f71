"""``python -m millrace run workload.json --tables DIR [name ..]``: runs a workload's queries in the order of their plans.

Each result is held against Spark's own evaluation of the query text. Exit status 1 if any differs.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .catalog import MOVIE_TABLES, Catalog
from .plans.frontend import analyse
from .plans.plan import load_workload
from .workload import run_one


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="millrace")
    p.add_argument("command", choices=["run"])
    p.add_argument("workload")
    p.add_argument("names", nargs="*")
    p.add_argument("--tables", required=True, help="folder of <table>.parquet, or of <table>.csv of the movie schema with --csv")
    p.add_argument("--csv", action="store_true")
    p.add_argument("--strategy", default="auto")
    p.add_argument("--pipeline", action="store_true", help="return joined rows instead of aggregates")
    p.add_argument("--sql", action="store_true", help="leave the join order to the engine")
    p.add_argument("--telemetry", action="store_true")
    p.add_argument("--times", help="file to write the milliseconds of each query to")
    a = p.parse_intermixed_args(argv)

    spark = spark or SparkSession.builder.appName("millrace").getOrCreate()
    work = load_workload(a.workload)
    if unknown := [n for n in a.names if n not in work]:
        p.error(f"no query named {', '.join(unknown)}")
    every = {n: df.columns for n, df in _catalog(spark, a, _names(spark, a)).items()}
    failed, total, times = 0, 0.0, []
    for name in a.names or work:
        text, tree = work[name]
        used = sorted({*analyse(text, every).tables.values()})
        r = run_one(text, None if a.sql else tree, _catalog(spark, a, used), a.strategy, a.pipeline, a.telemetry)
        total += r.ms
        times.append(f"{name} {r.ms:.0f}")
        failed += r.wrong is not None
        print(f"{name}: {r.ms:.0f} ms, {r.rows} rows, " + ("correct" if r.wrong is None else f"WRONG: {r.wrong}"))
        if r.report:
            print(r.report, file=sys.stderr)
    print(f"total: {total:.0f} ms")
    if a.times:
        with open(a.times, "w") as f:
            f.write("\n".join([*times, f"total {total:.0f}"]) + "\n")
    return int(failed > 0)


def _names(spark, a) -> list[str]:
    if a.csv:
        return list(MOVIE_TABLES)
    path = spark._jvm.org.apache.hadoop.fs.Path(a.tables)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return [n.removesuffix(".parquet") for n in (f.getPath().getName() for f in found) if n.endswith(".parquet")]


def _catalog(spark, a, names: list[str]) -> Catalog:
    return Catalog.movie_csv(spark, a.tables, names) if a.csv else Catalog.parquet(spark, a.tables, names)


if __name__ == "__main__":
    sys.exit(main())
