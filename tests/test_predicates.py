import itertools

import pytest
from pyspark.sql import functions as F

from millrace.functions.predicates import And, Between, Compare, In, IsNull, Like, Not, Or, Same, all_of

ROWS = [(i, None if v is None else v, s) for i, (v, s) in enumerate([(1, "a%b"), (2, "a_b"), (3, "a\\b"), (None, "x\ny"), (5, "é"), (-1, ""), (7, None)])]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id int, v int, s string").cache()


def ids(df, p, two_valued=False):
    return [r.id for r in df.where(p.column(two_valued=two_valued)).orderBy("id").collect()]


@pytest.mark.parametrize(
    "p, want",
    [
        (Compare("v", "=", 2), [1]), (Compare("v", "!=", 2), [0, 2, 4, 5, 6]), (Compare("v", "<", 3), [0, 1, 5]), (Compare("v", ">", 3), [4, 6]),
        (Compare("v", "<=", 3), [0, 1, 2, 5]), (Compare("v", ">=", 3), [2, 4, 6]), (Compare("v", "=", -1), [5]), (IsNull("v"), [3]),
        (IsNull("v", True), [0, 1, 2, 4, 5, 6]), (Between("v", 2, 5), [1, 2, 4]), (In("v", (1, 7, 9)), [0, 6]), (Not(In("v", (1, 7))), [1, 2, 4, 5]),
        (Like("s", "a_b"), [0, 1, 2]), (Like("s", "a%b"), [0, 1, 2]), (Like("s", "a\\b"), [2]), (Like("s", "x%y"), [3]), (Like("s", "_"), [4]),
        (Like("s", ""), [5]), (Like("s", "a%", True), [3, 4, 5]), (Compare("s", ">", "z"), [4]),
        (And([Compare("v", ">", 1), Compare("v", "<", 6)]), [1, 2, 4]), (Or([Compare("v", "=", 1), IsNull("s")]), [0, 6]),
    ],
)
def test_selects(df, p, want):
    assert ids(df, p) == want


def test_not_over_null(df):
    p = Not(Compare("v", "=", 2))
    assert ids(df, p) == [0, 2, 4, 5, 6]
    assert ids(df, p, two_valued=True) == [0, 2, 3, 4, 5, 6]
    assert ids(df, Like("s", "a%", True), two_valued=True) == [3, 4, 5]
    assert ids(df, Not(In("v", (1, 7))), two_valued=True) == [1, 2, 3, 4, 5]


def test_two_valued_logic_over_all_pairs(spark):
    values = [1, 2, None]
    rows = list(itertools.product(values, values))
    df = spark.createDataFrame(rows, "a int, b int")
    p = Not(And([Compare("a", "=", 1), Not(Compare("b", "=", 1))]))
    want = {(a, b) for a, b in rows if not (a == 1 and not b == 1)}
    assert {tuple(r) for r in df.where(p.column(two_valued=True)).collect()} == want
    assert {tuple(r) for r in df.where(p.column()).collect()} == {(1, 1), (2, 1), (2, 2), (2, None), (None, 1)}


def test_same_columns_and_names(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, None)], "x int, y int")
    p = Same("x", "y") & Compare("x", ">", 0) | ~IsNull("x")
    assert p.names() == {"x", "y"} and df.where(p.column()).count() == 2


def test_pretty_tells_predicates_apart():
    a, b = Compare("t.a", "=", 1), Like("t.s", "x%")
    assert And([a, b]).pretty() == "AND\n  t.a = 1\n  t.s LIKE 'x%'"
    assert And([And([a, b]), a]).pretty() == And([a, b, a]).pretty() and Or([a, b]).pretty() != And([a, b]).pretty()
    assert all_of([]) is None and all_of([a]) is a and all_of([a, b]) == And([a, b])


def test_rejects():
    for bad in (lambda: Compare("a", "~", 1), lambda: In("a", ()), lambda: In("a", (None,)), lambda: And([])):
        with pytest.raises(ValueError):
            bad()


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id"), F.col("id").cast("string").alias("s"), F.lit(1).alias("unused")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where(And([Compare("id", ">", 90), In("s", ("91", "95"))]).column()).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,90)" in plan and "In(s" in plan and "unused" not in plan and df.count() == 2
