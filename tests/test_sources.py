import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.predicates import Compare
from millrace.sources.csv import FilteredCache, read_csv, write_csv
from millrace.sources.pages import LONGEST, PAGE, read_column, read_file, read_pages, write_column, write_file, write_pages
from millrace.types import LogicalType, logical, schema

SCHEMA = schema(("i", LogicalType.INT32), ("s", LogicalType.VARCHAR), ("t", LogicalType.VARCHAR))


def test_csv_contract(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,"a\\"b","x\\\\y"\n2,"multi\nline",plain\\bs\n3,,""\n')
    rows = [tuple(r) for r in read_csv(spark, str(tmp_path / "a.csv"), SCHEMA).orderBy("i").collect()]
    assert rows == [(1, 'a"b', "x\\y"), (2, "multi\nline", "plain\\bs"), (3, None, None)]
    assert read_csv(spark, str(tmp_path / "a.csv"), SCHEMA, Compare("i", ">", 1)).count() == 2


def test_csv_bad_value_fails(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x1,a,b\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        read_csv(spark, str(tmp_path / "b.csv"), SCHEMA).collect()


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'q"', "a,b"), (2, "back\\slash", "new\nline"), (3, None, "é" * 5000)]
    write_csv(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "c"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "c"), SCHEMA).collect())) == rows


def test_filtered_cache(spark, tmp_path):
    df = spark.range(10)
    for cache in (FilteredCache(), FilteredCache(str(tmp_path))):
        a = cache.get("t", df, Compare("id", "<", 4))
        assert a is cache.get("t", df, Compare("id", "<", 4)) and a.count() == 4 and cache.get("t", df).count() == 10 and cache.hits == 1
        cache.clear()


def test_filtered_cache_is_found_again(spark, tmp_path):
    source, low = str(tmp_path / "t.parquet"), Compare("id", "<", 4)
    spark.range(10).withColumn("b", F.col("id") * 2).write.parquet(source)
    read = lambda: spark.read.parquet(source)
    first = FilteredCache(str(tmp_path / "cache"))
    assert first.get("t", read(), low).count() == 4 and first.hits == 0
    again = FilteredCache(str(tmp_path / "cache"))
    assert again.get("t", read(), low).count() == 4 and again.hits == 1
    assert again.get("t", read().select("id"), low).columns == ["id"] and again.hits == 1  # other columns
    assert again.get("u", read(), low).count() == 4 and again.get("t", read()).count() == 10 and again.hits == 1
    spark.range(3).withColumn("b", F.col("id")).write.mode("overwrite").parquet(source)
    spark.catalog.refreshByPath(source)
    changed = FilteredCache(str(tmp_path / "cache"))
    assert changed.get("t", read(), low).count() == 3 and changed.hits == 0
    other = str(tmp_path / "u.parquet")
    spark.range(2).withColumn("b", F.col("id")).write.parquet(other)
    assert changed.get("t", spark.read.parquet(other), low).count() == 2 and changed.hits == 0  # another source under the name
    (tmp_path / "cache" / f"{FilteredCache.key('t', read(), low)}.parquet" / "_SUCCESS").unlink()
    assert FilteredCache(str(tmp_path / "cache")).get("t", read(), low).count() == 3  # a write that was not finished


def columns(n, seed=1):
    r = random.Random(seed)
    maybe = lambda v: None if r.random() < 0.2 else v
    return [
        [maybe(r.choice([-1, 0, 2**31 - 1, -(2**31)])) for _ in range(n)], [maybe(r.randrange(-(2**63), 2**63)) for _ in range(n)],
        [maybe(r.random() * 1e9) for _ in range(n)], [maybe(r.choice(["", "é", "x" * 100, "y" * 2000])) for _ in range(n)],
    ]


def back(path):
    out = [list(c) for c in zip(*(r for b in read_file(path) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), strict=True)]
    return out


@pytest.mark.parametrize("n", [1, 7, 3000, 20000])
def test_pages_round_trip(tmp_path, n):
    cols, path = columns(n), str(tmp_path / "t.tbl")
    write_file(path, cols, list(LogicalType))
    assert back(path) == cols


def test_long_strings_stay_apart(tmp_path):
    values = ["a" * LONGEST, "b" * (LONGEST + 1), "c" * 20000, "d" * 20000, None, "é" * 9000, "end", "f" * 9000]
    write_file(str(tmp_path / "t.tbl"), [values], [LogicalType.VARCHAR])
    assert back(str(tmp_path / "t.tbl")) == [values]


def test_page_layout():
    write = lambda *a: b"".join(write_column(*a))
    page = write([5, None, -1], LogicalType.INT32)
    assert len(page) == PAGE and page[:4] == bytes([3, 0, 2, 0]) and page[4:12] == (5).to_bytes(4, "little") + b"\xff" * 4 and page[-1] == 0b101
    page = write([7], LogicalType.INT64)
    assert page[8:16] == (7).to_bytes(8, "little") and page[4:8] == b"\0" * 4
    page = write(["ab", None, "c"], LogicalType.VARCHAR)
    assert page[:4] == bytes([3, 0, 2, 0]) and page[4:8] == bytes([2, 0, 3, 0]) and page[8:11] == b"abc"


@pytest.mark.parametrize("seed", range(6))
def test_pages_are_filled(seed):
    """Every page holds as many of the rows as fit, whatever mix of nulls and sizes."""
    r = random.Random(seed)
    values = [None if r.random() < 0.3 else "x" * r.choice([0, 1, 50, 3000, 9000]) for _ in range(700)] + [None] * 70_000 * (seed == 0)
    pages = list(write_column(values, LogicalType.VARCHAR))
    assert [v for a in read_column(iter(map(memoryview, pages)), LogicalType.VARCHAR) for v in a.to_pylist()] == values
    at = 0
    for page in pages:
        rows = int.from_bytes(page[:2], "little")
        if rows == 0xFFFE:
            continue
        if rows == 0xFFFF:
            at += 1
            continue
        nxt = values[at + rows : at + rows + 1]
        some = [v for v in [*values[at : at + rows], *nxt] if v is not None]
        assert not nxt or len(nxt[0] or "") > LONGEST or 4 + sum(2 + len(v) for v in some) + (rows + 8) // 8 > PAGE or rows == 0xFFFD
        at += rows
    assert at == len(values)


@pytest.mark.parametrize("parts", [1, 2, 7, 50, 4000])
def test_a_file_in_parts(tmp_path, parts):
    n, path = 3000, str(tmp_path / "t.tbl")
    cols = columns(n, 5)
    cols[3] = [("z" * 20_000 if i % 97 == 0 else v) for i, v in enumerate(cols[3])]
    write_file(path, cols, list(LogicalType))
    got = [[list(c.to_pylist()) for c in b.columns] for k in range(parts) for b in read_file(path, batch=64, part=k, parts=parts)]
    assert [[v for b in got for v in b[c]] for c in range(4)] == cols


def test_large_files_are_split(spark, tmp_path, monkeypatch):
    from millrace.sources import pages

    write_file(str(tmp_path / "t.tbl"), columns(5000, 8), list(LogicalType))
    monkeypatch.setattr(pages, "SPLIT_BYTES", 100_000)
    reader = pages.PageSource({"path": str(tmp_path / "t.tbl")}).reader(schema(*zip("abcd", LogicalType, strict=True)))
    parts = reader.partitions()
    assert len(parts) > 3 and sum(b.num_rows for p in parts for b in reader.read(p)) == 5000


def test_sliced_arrays_are_written(tmp_path):
    import pyarrow as pa

    whole = pa.array(["a", None, "bcd", "é", None, "f" * 9000, "g"])
    write_file(str(tmp_path / "s.tbl"), [whole.slice(2, 4), pa.chunked_array([pa.array([1, None]), pa.array([3, 4])])], [LogicalType.VARCHAR, LogicalType.INT64])
    assert back(str(tmp_path / "s.tbl")) == [["bcd", "é", None, "f" * 9000], [1, None, 3, 4]]


def test_page_data_source(spark, tmp_path):
    cols = columns(5000, 3)
    df = spark.createDataFrame(list(zip(*cols, strict=True)), schema(*zip("abcd", LogicalType, strict=True))).repartition(3)
    listed = write_pages(df, str(tmp_path / "p"), rows_per_file=1000).collect()
    assert sum(r.n_rows for r in listed) == 5000 and len(listed) >= 5
    got = read_pages(spark, str(tmp_path / "p"), list("abcd"))
    assert got.schema == df.schema and got.exceptAll(df).count() == 0 and got.count() == 5000
    assert read_pages(spark, listed[0].path).columns == ["c0", "c1", "c2", "c3"]


def test_empty_and_wrong_files(spark, tmp_path):
    write_file(str(tmp_path / "e.tbl"), [[], []], [LogicalType.INT32, LogicalType.VARCHAR])
    assert read_pages(spark, str(tmp_path / "e.tbl")).count() == 0
    with pytest.raises(ValueError):
        write_file(str(tmp_path / "w.tbl"), [[1]] * 17, [LogicalType.INT32] * 17)
    with pytest.raises(TypeError):
        logical(T.DateType())
    with pytest.raises(Exception):
        read_pages(spark, str(tmp_path / "none.tbl")).collect()
