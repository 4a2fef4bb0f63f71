"""The engine's registered queries, each with the SQL it must agree with.

A text in the select-project-join grammar runs through the engine's own front end; entries in ``DERIVED`` build
their inputs as DataFrames first.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .functions.predicates import Compare, IsNull, Not, Predicate
from .operators.joins import STRATEGIES, equi_join, product_join
from .plans.frontend import run_sql
from .plans.plan import Plan, execute, run_explain
from .sources.csv import FilteredCache, read_csv, write_csv
from .sources.pages import read_pages, write_pages
from .sources.scratch import scratch
from .telemetry import Telemetry
from .verify import Difference, compare
from .workload import run_one

TABLES = ["region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents", "benchmark", "labels"]

SQL = {
    "scan_project": "SELECT n_name, n_nationkey FROM nation",
    "filter_int_eq": "SELECT p_partkey, p_size FROM part WHERE p_size = 15",
    "filter_int_neq": "SELECT p_partkey, p_size FROM part WHERE p_size != 15",
    "filter_int_lt_gt": "SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size < 15",
    "filter_int_le_ge": "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size <= 15",
    "filter_bigint_range": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 500 AND o_custkey < 900",
    "filter_fp64_range": "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0.0",
    "filter_str_eq": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT'",
    "filter_str_neq": "SELECT r_regionkey, r_name FROM region WHERE r_name != 'ASIA'",
    "filter_str_range": "SELECT n_nationkey, n_name FROM nation WHERE n_name > 'NATION_2' AND n_name <= 'NATION_7'",
    "filter_between_int": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 8",
    "filter_between_str": "SELECT p_partkey, p_brand FROM part WHERE p_brand BETWEEN 'Brand#1' AND 'Brand#15'",
    "filter_in_int": "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 2, 3)",
    "filter_in_str": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "filter_not_in": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')",
    "filter_like_prefix": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'blue%'",
    "filter_like_contains": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%widget%'",
    "filter_like_multi": "SELECT doc_id, n_chars FROM documents WHERE text LIKE '%the%and%'",
    "filter_like_underscore": "SELECT n_nationkey, n_name FROM nation WHERE n_name LIKE 'NATION__'",
    "filter_not_like": "SELECT p_partkey, p_name FROM part WHERE p_name NOT LIKE '%widget%'",
    "filter_nested_and_or": "SELECT p_partkey, p_type, p_size FROM part WHERE p_type = 'PROMO' OR (p_type = 'SMALL' AND p_size > 40)",
    "filter_same_table_columns": "SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_suppkey = l_linenumber",
    "join_int32_key": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey",
    "join_bigint_key": "SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT'",
    "join_string_key": "SELECT a.n_nationkey AS k1, b.n_regionkey AS k2, a.n_name FROM nation AS a, nation AS b WHERE a.n_name = b.n_name",
    "join_two_keys": "SELECT a.l_orderkey, a.l_linenumber, b.l_suppkey FROM lineitem AS a, lineitem AS b WHERE a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber",
    "join_duplicate_keys_bag": "SELECT a.n_name AS n1, b.n_name AS n2 FROM nation AS a, nation AS b WHERE a.n_regionkey = b.n_regionkey",
    "join_empty_build": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name = 'ATLANTIS'",
    "join_self_alias": "SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, o.o_orderkey FROM nation AS n1, nation AS n2, supplier AS s, customer AS c, orders AS o, lineitem AS l WHERE s.s_nationkey = n1.n_nationkey AND c.c_nationkey = n2.n_nationkey AND s.s_suppkey = l.l_suppkey AND o.o_orderkey = l.l_orderkey AND c.c_custkey = o.o_custkey AND n1.n_name = 'NATION_1' AND n2.n_name IN ('NATION_2', 'NATION_3')",
    "join_duplicate_output_column": "SELECT r_name AS a, r_name AS b, n_name FROM nation, region WHERE n_regionkey = r_regionkey",
    "join_transitive_clique": "SELECT d.doc_id, d.lang, l.quality, p.p_name FROM documents AS d, labels AS l, part AS p WHERE d.doc_id = l.doc_id AND l.doc_id = p.p_partkey AND d.doc_id = p.p_partkey AND l.toxic = 0",
    "agg_min_single": "SELECT MIN(c.c_name) AS first_customer FROM customer AS c, orders AS o WHERE c.c_custkey = o.o_custkey AND o.o_orderpriority = '5-LOW'",
    "agg_min_multi_type": "SELECT MIN(p.p_name) AS part_name, MIN(p.p_size) AS part_size, MIN(l.l_extendedprice) AS price, MIN(l.l_shipdate) AS shipdate FROM part AS p, lineitem AS l WHERE p.p_partkey = l.l_partkey AND p.p_type LIKE 'PROMO%'",
    "agg_min_empty_is_null": "SELECT MIN(r_name) AS m FROM nation, region WHERE n_regionkey = r_regionkey AND r_name = 'ATLANTIS'",
    "job_template_star5": "SELECT MIN(p.p_name) AS part_name, MIN(o.o_orderdate) AS first_date FROM part AS p, supplier AS s, lineitem AS l, orders AS o, nation AS n WHERE p.p_partkey = l.l_partkey AND s.s_suppkey = l.l_suppkey AND o.o_orderkey = l.l_orderkey AND n.n_nationkey = s.s_nationkey AND n.n_name = 'NATION_7' AND p.p_name NOT LIKE '%anvil%' AND (p.p_type LIKE 'PRO%' OR p.p_type LIKE 'SMALL')",
    "job_template_snowflake8": "SELECT MIN(c.c_name) AS customer, MIN(p.p_name) AS part, MIN(s.s_name) AS supplier FROM region AS r, nation AS n1, nation AS n2, customer AS c, orders AS o, lineitem AS l, supplier AS s, part AS p WHERE p.p_partkey = l.l_partkey AND s.s_suppkey = l.l_suppkey AND l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND c.c_nationkey = n1.n_nationkey AND n1.n_regionkey = r.r_regionkey AND s.s_nationkey = n2.n_nationkey AND r.r_name = 'AMERICA' AND p.p_type = 'ECONOMY' AND p.p_size BETWEEN 1 AND 20 AND o.o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "sql_distinct": "SELECT DISTINCT p.p_type, l.l_returnflag FROM part AS p, lineitem AS l WHERE p.p_partkey = l.l_partkey AND p.p_size < 10",
    "sql_group_by": "SELECT n.n_name, COUNT(*) AS n, MIN(o.o_totalprice) AS least, MAX(o.o_orderdate) AS last FROM nation AS n, customer AS c, orders AS o WHERE n.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey GROUP BY n.n_name",
    "sql_having": "SELECT c.c_mktsegment, o.o_orderpriority, COUNT(*) AS n FROM customer AS c, orders AS o WHERE c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment, o.o_orderpriority HAVING COUNT(*) > 10 AND NOT (c.c_mktsegment = 'BUILDING')",
    "sql_order_limit": "SELECT o.o_orderkey, o.o_totalprice, c.c_name FROM orders AS o, customer AS c WHERE o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC NULLS LAST, o.o_orderkey LIMIT 25",
}

_STATUS = "(SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS st FROM orders) v"
DERIVED_SQL = {
    "filter_is_null": f"SELECT o_orderkey, st FROM {_STATUS} WHERE st IS NULL",
    "filter_is_not_null": f"SELECT o_orderkey, st FROM {_STATUS} WHERE st IS NOT NULL",
    "filter_null_comparison_excludes": f"SELECT o_orderkey, st FROM {_STATUS} WHERE st != 'F'",
    "filter_not_two_valued": f"SELECT o_orderkey, st FROM {_STATUS} WHERE NOT COALESCE(st = 'F', FALSE)",
    "filter_not_sql": f"SELECT o_orderkey, st FROM {_STATUS} WHERE NOT (st = 'F')",
    "join_string_key_dups": "SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, 'NATION_' || CAST(c_nationkey AS VARCHAR) AS ck FROM customer) c, (SELECT s_suppkey, 'NATION_' || CAST(s_nationkey AS VARCHAR) AS sk FROM supplier) s WHERE ck = sk",
    "join_fp64_key": "SELECT l_orderkey, l_linenumber, p_partkey FROM lineitem, part WHERE l_quantity = p_retailprice - 880.0",
    "join_null_keys_drop": "SELECT n_name, r_name FROM (SELECT n_name, NULLIF(n_regionkey, 2) AS k FROM nation) n, (SELECT r_name, NULLIF(r_regionkey, 2) AS k2 FROM region) r WHERE n.k = r.k2",
    "join_negative_one_key": "SELECT n_name, r_name FROM (SELECT n_name, n_regionkey - 1 AS k FROM nation) n, (SELECT r_name, r_regionkey - 1 AS k2 FROM region) r WHERE n.k = r.k2",
    "agg_min_ignores_null": "SELECT MIN(NULLIF(o_orderpriority, '1-URGENT')) AS p FROM orders, customer WHERE o_custkey = c_custkey",
    "pipeline_no_agg": "SELECT p.p_name, o.o_orderkey FROM part AS p, lineitem AS l, orders AS o WHERE p.p_partkey = l.l_partkey AND l.l_orderkey = o.o_orderkey AND p.p_size = 1 AND o.o_orderstatus = 'P'",
    "plan_builder_join": "SELECT r_name AS c0, n_name AS c1, n_nationkey AS c2 FROM nation, region WHERE n_regionkey = r_regionkey",
    "plan_explain_bushy": "SELECT MIN(c.c_name) AS customer, MIN(s.s_name) AS supplier FROM orders AS o, customer AS c, lineitem AS l, supplier AS s WHERE o.o_custkey = c.c_custkey AND o.o_orderkey = l.l_orderkey AND l.l_suppkey = s.s_suppkey AND s.s_acctbal < 1000.0 AND c.c_mktsegment = 'BUILDING'",
    "source_csv_round_trip": "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer WHERE c_nationkey < 5",
    "source_pages_round_trip": "SELECT p_partkey, p_name, p_size, p_retailprice FROM part",
    "scan_cached_filter": "SELECT p_partkey, p_type FROM part WHERE p_type = 'PROMO' AND p_size > 25",
    "scan_cache_found_again": "SELECT p_partkey, p_type, CAST(1 AS BIGINT) AS hits FROM part WHERE p_type = 'PROMO' AND p_size > 25",
    "scan_cache_in_memory": "SELECT p_partkey, p_type, CAST(2 AS BIGINT) AS hits FROM part WHERE p_type = 'PROMO' AND p_size > 25",
    "catalog_views_csv": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name LIKE 'A%'",
    "workload_run": "SELECT 'star' AS name, CAST(1 AS BIGINT) AS n_rows, TRUE AS agrees UNION ALL SELECT 'joined', COUNT(*), TRUE FROM part, lineitem, orders WHERE p_partkey = l_partkey AND l_orderkey = o_orderkey AND p_size = 1 AND o_orderstatus = 'P'",
    "compare_bags": "SELECT 'same' AS what, CAST(COUNT(*) AS BIGINT) AS n FROM orders UNION ALL SELECT 'a row twice', CAST(-1 AS BIGINT) UNION ALL SELECT 'a type', CAST(-1 AS BIGINT)",
    "predicate_pretty": "SELECT 'OR' || chr(10) || '  p_size >= 3' || chr(10) || '  NOT' || chr(10) || '    p_size = 7' AS text",
    "telemetry_join_rows": "SELECT (SELECT COUNT(*) FROM nation) AS probe_rows, (SELECT COUNT(*) FROM region) AS build_rows, COUNT(*) AS out_rows FROM nation, region WHERE n_regionkey = r_regionkey",
}
#: Every strategy must give the bag of one join.
DERIVED_SQL |= {f"join_strategy_{s}": "SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND s_acctbal > 0.0" for s in STRATEGIES}

Query = Callable[[SparkSession, str], DataFrame]


def _catalog(spark: SparkSession, sf_dir: str, text: str = "") -> Catalog:
    return Catalog.parquet(spark, sf_dir, [t for t in TABLES if not text or re.search(rf"\b{t}\b", text.lower())])


def _spj(text: str) -> Query:
    return lambda spark, sf_dir: run_sql(text, _catalog(spark, sf_dir, text))


def _status(where: Predicate, two_valued: bool = False) -> Query:
    def run(spark, sf_dir):
        rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("st"))
        return rows.where(where.column(two_valued=two_valued))

    return run


def _string_dups(spark, sf_dir):
    t = _catalog(spark, sf_dir, "customer supplier")
    key = lambda c: F.concat(F.lit("NATION_"), F.col(c).cast("string"))
    c, s = t["customer"].select("c_custkey", key("c_nationkey").alias("ck")), t["supplier"].select("s_suppkey", key("s_nationkey").alias("sk"))
    return equi_join(c, s, [("ck", "sk")]).select("c_custkey", "s_suppkey")


def _fp64(spark, sf_dir):
    t = _catalog(spark, sf_dir, "lineitem part")
    part = t["part"].select("p_partkey", (F.col("p_retailprice") - 880.0).alias("k"))
    return product_join(t["lineitem"].select("l_orderkey", "l_linenumber", "l_quantity"), part, ("l_quantity", "k")).select("l_orderkey", "l_linenumber", "p_partkey")


def _regions(key: Callable[[str], "F.Column"]) -> Query:
    def run(spark, sf_dir):
        t = _catalog(spark, sf_dir, "nation region")
        n, r = t["nation"].select("n_name", key("n_regionkey").alias("k")), t["region"].select("r_name", key("r_regionkey").alias("k2"))
        return equi_join(n, r, [("k", "k2")]).select("n_name", "r_name")

    return run


def _min_null(spark, sf_dir):
    t = _catalog(spark, sf_dir, "orders customer")
    t["orders"] = t["orders"].select("o_custkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p"))
    return run_sql("SELECT MIN(o.p) AS p FROM orders AS o, customer AS c WHERE o.o_custkey = c.c_custkey", t)


def _pipeline(spark, sf_dir):
    text = "SELECT MIN(p.p_name) AS p_name, MIN(o.o_orderkey) AS o_orderkey " + DERIVED_SQL["pipeline_no_agg"][DERIVED_SQL["pipeline_no_agg"].index("FROM") :]
    return run_sql(text, _catalog(spark, sf_dir, text), pipeline=True)


def _builder(spark, sf_dir):
    t, plan = _catalog(spark, sf_dir, "nation region"), Plan()
    n = plan.new_scan(plan.new_input(t["nation"]), [0, 1, 2])
    r = plan.new_scan(plan.new_input(t["region"]), [0, 1])
    plan.new_join(False, n, r, 2, 0, [4, 1, 0])
    return execute(plan)


def _hash_join(left: dict, right: dict, build_left: bool) -> dict:
    wrap = lambda x: {"Node Type": "Hash", "Plans": [x]}
    return {"Node Type": "Hash Join", "Plans": [wrap(left) if build_left else left, right if build_left else wrap(right)]}


def _bushy(spark, sf_dir):
    scan = lambda a: {"Node Type": "Seq Scan", "Alias": a}
    text = DERIVED_SQL["plan_explain_bushy"]
    tree = _hash_join(_hash_join(scan("o"), scan("c"), False), _hash_join(scan("s"), scan("l"), True), True)
    return run_explain(text, {"Plan": {"Node Type": "Aggregate", "Plans": [{"Node Type": "Gather", "Plans": [tree]}]}}, _catalog(spark, sf_dir, text))


def _csv(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    write_csv(df, path := scratch(spark))
    return read_csv(spark, path, df.schema, Compare("c_nationkey", "<", 5), multi_line=False)


def _pages(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size", "p_retailprice")
    write_pages(df, path := scratch(spark)).collect()
    return read_pages(spark, path, df.columns)


def _cached(spark, sf_dir):
    where = Compare("p_type", "=", "PROMO") & Compare("p_size", ">", 25)
    return FilteredCache(scratch(spark)).get("part", spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type", "p_size"), where).select("p_partkey", "p_type")


def _cache_hits(on_disk: bool) -> Query:
    """A filtered scan taken three times; on disk the second and third by caches that know nothing of the first's session."""

    def run(spark, sf_dir):
        where = Compare("p_type", "=", "PROMO") & Compare("p_size", ">", 25)
        folder = scratch(spark) if on_disk else None
        cache = FilteredCache(folder)
        for again in range(2 if on_disk else 3):
            cache = FilteredCache(folder) if on_disk and again else cache
            found = cache.get("part", spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_type", "p_size"), where)
        return found.select("p_partkey", "p_type", F.lit(cache.hits).cast("long").alias("hits"))

    return run


def _csv_views(spark, sf_dir):
    made, folder = _catalog(spark, sf_dir, "nation region"), scratch(spark)
    for name, df in made.items():
        write_csv(df, f"{folder}/{name}.csv")
    Catalog({n: read_csv(spark, f"{folder}/{n}.csv", df.schema) for n, df in made.items()}).views()
    return spark.sql("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name LIKE 'A%'")


def _workload(spark, sf_dir):
    scan = lambda a: {"Node Type": "Seq Scan", "Alias": a}
    joined = "SELECT MIN(p.p_name) AS p_name FROM part AS p, lineitem AS l, orders AS o WHERE p.p_partkey = l.l_partkey AND l.l_orderkey = o.o_orderkey AND p.p_size = 1 AND o.o_orderstatus = 'P';"
    tree = {"Plan": _hash_join(_hash_join(scan("l"), scan("p"), False), scan("o"), True)}
    star = _hash_join(_hash_join(_hash_join(_hash_join(scan("s"), scan("n"), False), scan("l"), True), scan("p"), False), scan("o"), False)
    rows = []
    for name, text, plan, pipeline in (("star", SQL["job_template_star5"], {"Plan": star}, False), ("joined", joined, tree, True)):
        r = run_one(text, plan, _catalog(spark, sf_dir, text), pipeline=pipeline)
        rows.append((name, r.rows, r.wrong is None))
    return spark.createDataFrame(rows, "name string, n_rows long, agrees boolean")


def _compare(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")

    def found(other: DataFrame) -> int:
        try:
            return compare(orders, other)
        except Difference:
            return -1

    one = orders.orderBy("o_orderkey").limit(1)
    ways = (("same", orders.repartition(3)), ("a row twice", orders.unionByName(one)), ("a type", orders.withColumn("o_totalprice", F.col("o_totalprice").cast("float"))))
    return spark.createDataFrame([(what, found(df)) for what, df in ways], "what string, n long")


def _pretty(spark, sf_dir):
    where = Compare("p_size", ">=", 3) | Not(Compare("p_size", "=", 7))
    return spark.range(1).select(F.lit(where.pretty()).alias("text"))


def _strategy(strategy: str) -> Query:
    text = DERIVED_SQL[f"join_strategy_{strategy}"]
    return lambda spark, sf_dir: run_sql(text, _catalog(spark, sf_dir, text), strategy)


def _telemetry(spark, sf_dir):
    t, plan, watch = _catalog(spark, sf_dir, "nation region"), Plan(), Telemetry()
    n, r = plan.new_scan(plan.new_input(t["nation"]), [0, 2]), plan.new_scan(plan.new_input(t["region"]), [0])
    plan.new_join(False, n, r, 1, 0, [0, 2])
    execute(plan, observer=watch).write.format("noop").mode("overwrite").save()
    total = watch.totals()
    return spark.range(1).select(*(F.lit(x).cast("long").alias(k) for k, x in (("probe_rows", total.probe_rows), ("build_rows", total.build_rows), ("out_rows", total.out_rows))))


def queries() -> dict[str, Query]:
    return {name: _spj(text) for name, text in SQL.items()} | {
        "filter_is_null": _status(IsNull("st")),
        "filter_is_not_null": _status(IsNull("st", negated=True)),
        "filter_null_comparison_excludes": _status(Compare("st", "!=", "F")),
        "filter_not_two_valued": _status(Not(Compare("st", "=", "F")), two_valued=True),
        "filter_not_sql": _status(Not(Compare("st", "=", "F"))),
        "join_string_key_dups": _string_dups,
        "join_fp64_key": _fp64,
        "join_null_keys_drop": _regions(lambda c: F.nullif(F.col(c), F.lit(2))),
        "join_negative_one_key": _regions(lambda c: F.col(c) - 1),
        "agg_min_ignores_null": _min_null,
        "pipeline_no_agg": _pipeline,
        "plan_builder_join": _builder,
        "plan_explain_bushy": _bushy,
        "source_csv_round_trip": _csv,
        "source_pages_round_trip": _pages,
        "scan_cached_filter": _cached,
        "scan_cache_found_again": _cache_hits(True),
        "scan_cache_in_memory": _cache_hits(False),
        "catalog_views_csv": _csv_views,
        "workload_run": _workload,
        "compare_bags": _compare,
        "predicate_pretty": _pretty,
        "telemetry_join_rows": _telemetry,
    } | {f"join_strategy_{s}": _strategy(s) for s in STRATEGIES}


def oracle_sql() -> dict[str, str]:
    return SQL | DERIVED_SQL


