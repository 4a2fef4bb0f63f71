"""Page files: columns of 8 KiB pages behind a header block, as a Spark data source and a sink.

Layout. Header: rows and columns (unsigned 64 bits each), 16 types (32 bits each), 16 page counts (64 bits each),
filled up to one page; the columns' pages follow, column by column. A page starts with its row count and the count
of values that are not null (16 bits each) and ends with a bitmap of valid rows, low bit first. Numbers start at
their own size, four at least; strings have the end offset of each value (16 bits) from byte 4, then the
characters. A string over 8185 bytes takes pages of its own: row count 0xffff on the first, 0xfffe on the others,
then the length on that page, then its bytes.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..types import SPARK, LogicalType, logical
from .scratch import store_of

PAGE, MAX_COLUMNS, LONGEST = 8192, 16, 8185
#: Bytes of a file that one task reads.
SPLIT_BYTES = 64 << 20
_HEADER = struct.Struct(f"<QQ{MAX_COLUMNS}I{MAX_COLUMNS}Q")
_FIRST, _NEXT = 0xFFFF, 0xFFFE
_NUMPY = {LogicalType.INT32: "<i4", LogicalType.INT64: "<i8", LogicalType.FP64: "<f8"}
_ARROW = {LogicalType.INT32: pa.int32(), LogicalType.INT64: pa.int64(), LogicalType.FP64: pa.float64(), LogicalType.VARCHAR: pa.string()}


def read_column(pages: Iterator[memoryview], kind: LogicalType) -> Iterator[pa.Array]:
    """The values of a column, an array a page (a long string's pages together are one); one page is held at a time."""
    parts: list[bytes] = []
    for page in pages:
        rows, full = struct.unpack_from("<HH", page)
        if parts and rows != _NEXT:
            yield pa.array([b"".join(parts).decode()], pa.string())
            parts = []
        if rows in (_FIRST, _NEXT):
            if rows == _NEXT and not parts:
                raise ValueError("a string goes on that has not begun")
            parts.append(bytes(page[4 : 4 + full]))
            continue
        bitmap = page[PAGE - (rows + 7) // 8 :]
        valid = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=rows, bitorder="little").astype(bool)
        if int(valid.sum()) != full:
            raise ValueError("the bitmap and the count of values differ")
        if kind == LogicalType.VARCHAR:
            ends = np.zeros(rows + 1, np.int32)
            ends[1:][valid] = np.diff(np.frombuffer(page, "<u2", full, 4).astype(np.int32), prepend=0)
            data = page[4 + 2 * full : PAGE - len(bitmap)]
            array = pa.Array.from_buffers(pa.string(), rows, [pa.py_buffer(bytes(bitmap)), pa.py_buffer(np.cumsum(ends, dtype=np.int32)), pa.py_buffer(bytes(data))])
            array.validate(full=True)
        else:
            dtype = np.dtype(_NUMPY[kind])
            values = np.zeros(rows, dtype)
            values[valid] = np.frombuffer(page, dtype, full, max(4, dtype.itemsize))
            array = pa.array(values, _ARROW[kind], mask=~valid)
        yield array
    if parts:
        yield pa.array([b"".join(parts).decode()], pa.string())


def _in_rows(arrays: Iterator[pa.Array], kind: LogicalType) -> Callable[[int], pa.Array]:
    """A function that takes the next n values of a column."""
    held: list[pa.Array] = []

    def take(n: int) -> pa.Array:
        while (have := sum(map(len, held))) < n:
            held.append(next(arrays))
        whole = pa.concat_arrays(held) if len(held) > 1 else held[0] if held else pa.array([], _ARROW[kind])
        held[:] = [whole.slice(n)] if have > n else []
        return whole.slice(0, n)

    return take


def read_header(data: bytes) -> tuple[int, list[LogicalType], list[int]]:
    rows, n, *rest = _HEADER.unpack_from(data)
    if n > MAX_COLUMNS:
        raise ValueError(f"{n} columns in a page file")
    return rows, [LogicalType(t) for t in rest[:n]], rest[MAX_COLUMNS : MAX_COLUMNS + n]


def read_file(uri: str, batch: int = 8192, part: int = 0, parts: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows of a page file in batches, or one of ``parts`` stretches of them; pages are fetched as they are needed.

    Of pages before the stretch only the counts are read, those after it not at all.
    """
    fs, path = store_of(uri)
    with fs.open_input_file(path) as f:
        rows, kinds, counts = read_header(f.read(PAGE))
        starts = np.cumsum([1, *counts]).tolist()
    first, stop = rows * part // parts, rows * (part + 1) // parts

    def column(start: int, count: int, kind: LogicalType) -> Iterator[pa.Array]:
        begun: list[int] = []  # the row that the first page fetched begins with

        def pages() -> Iterator[memoryview]:
            at, end = 0, 0  # rows before the page, and after it; a string's further pages belong to its row
            with fs.open_input_file(path) as f:
                for k in range(start, start + count):
                    f.seek(k * PAGE)
                    head = f.read(4)
                    if len(head) != 4:
                        raise ValueError("the page file is cut short")
                    n = struct.unpack_from("<H", head)[0]
                    if n != _NEXT:
                        at, end = end, end + (1 if n == _FIRST else n)
                    if at >= stop:
                        return
                    if end > first:
                        begun.append(at)
                        page = head + f.read(PAGE - 4)
                        if len(page) != PAGE:
                            raise ValueError("the page file is cut short")
                        yield memoryview(page)

        for k, array in enumerate(read_column(pages(), kind)):
            yield array if k else array.slice(first - begun[0])

    columns = [_in_rows(column(s, c, k), k) for s, c, k in zip(starts, counts, kinds, strict=False)]
    for at in range(first, stop, batch):
        n = min(batch, stop - at)
        yield pa.RecordBatch.from_arrays([c(n) for c in columns], names=[f"c{i}" for i in range(len(kinds))])


def _as_array(values: list | pa.Array | pa.ChunkedArray, kind: LogicalType) -> pa.Array:
    """One array; strings with wide offsets, for a file's characters may pass two gigabytes."""
    wide = pa.large_string() if kind == LogicalType.VARCHAR else _ARROW[kind]
    if isinstance(values, list):
        return pa.array(values, wide)
    values = values.cast(wide)
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values


def write_column(values: list | pa.Array | pa.ChunkedArray, kind: LogicalType) -> Iterator[bytes]:
    """A column as pages. Values are laid out a page at a time from the running sums of their sizes."""
    array = _as_array(values, kind)
    valid = np.asarray(array.is_valid())
    before = np.concatenate([[0], np.cumsum(valid)])
    dense = array.drop_null()
    text = kind == LogicalType.VARCHAR
    if text:
        ends = np.frombuffer(dense.buffers()[1], np.int64)[dense.offset : dense.offset + len(dense) + 1] if len(dense) else np.zeros(1, np.int64)
        data, head = dense.buffers()[2] or b"", 4
        used = 2 * before + (ends - ends[0])[before]
        long = np.flatnonzero(valid)[np.diff(ends) > LONGEST]
    else:
        data, head = dense.to_numpy().astype(_NUMPY[kind]), max(4, np.dtype(_NUMPY[kind]).itemsize)
        used, long = np.dtype(_NUMPY[kind]).itemsize * before, np.zeros(0, np.int64)
    # rows i to j fit if head + size + ceil((j - i) / 8) <= PAGE
    bits = 8 * used + np.arange(len(used))
    i = 0
    for stop in [*long.tolist(), len(array)]:
        while i < stop:
            j = min(int(np.searchsorted(bits, bits[i] + 8 * (PAGE - head), side="right")) - 1, stop, i + _NEXT - 1)
            a, b = int(before[i]), int(before[j])
            page = bytearray(PAGE)
            struct.pack_into("<HH", page, 0, j - i, b - a)
            if text:
                body = (ends[a + 1 : b + 1] - ends[a]).astype("<u2").tobytes() + memoryview(data)[ends[a] : ends[b]].tobytes()
            else:
                body = data[a:b].tobytes()
            page[head : head + len(body)] = body
            bitmap = np.packbits(valid[i:j], bitorder="little").tobytes()
            page[PAGE - len(bitmap) :] = bitmap
            yield bytes(page)
            i = j
        if stop < len(array):
            a = int(before[stop])
            v = memoryview(data)[ends[a] : ends[a + 1]].tobytes()
            for k in range(0, len(v), PAGE - 4):
                part = v[k : k + PAGE - 4]
                yield (struct.pack("<HH", _NEXT if k else _FIRST, len(part)) + part).ljust(PAGE, b"\0")
            i = stop + 1


def write_file(uri: str, columns: list, kinds: list[LogicalType]) -> None:
    """A page file of columns given as lists or Arrow arrays of one length."""
    if not 0 < len(kinds) <= MAX_COLUMNS:
        raise ValueError(f"a page file has 1 to {MAX_COLUMNS} columns")
    data = [b"".join(write_column(c, k)) for c, k in zip(columns, kinds, strict=True)]
    pad = [0] * (MAX_COLUMNS - len(kinds))
    header = _HEADER.pack(len(columns[0]), len(kinds), *kinds, *pad, *(len(d) // PAGE for d in data), *pad)
    fs, path = store_of(uri)
    fs.create_dir(path.rpartition("/")[0] or ".", recursive=True)
    with fs.open_output_stream(path) as f:
        f.write(header.ljust(PAGE, b"\0"))
        for d in data:
            f.write(d)


class _FilePartition(InputPartition):
    def __init__(self, uri: str, part: int, parts: int):
        self.uri, self.part, self.parts = uri, part, parts


class _PageReader(DataSourceReader):
    """One task for each SPLIT_BYTES of a file. Values are cast to the declared schema by position."""

    def __init__(self, files: list[tuple[str, int]], schema: T.StructType):
        self.files, self.names = files, [f.name for f in schema.fields]

    def partitions(self):
        sized = [(u, max(1, -(-size // SPLIT_BYTES))) for u, size in self.files]
        return [_FilePartition(u, k, n) for u, n in sized for k in range(n)]

    def read(self, partition):
        for batch in read_file(partition.uri, part=partition.part, parts=partition.parts):
            yield batch.rename_columns(self.names)


def page_files(uri: str) -> list[tuple[str, int]]:
    """The page files at a path and their sizes: the file, or all ``.tbl`` files of a folder."""
    from pyarrow import fs as pafs

    fs, path = store_of(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == pafs.FileType.File:
        return [(uri, info.size)]
    found = sorted((x.base_name, x.size) for x in fs.get_file_info(pafs.FileSelector(path)) if x.base_name.endswith(".tbl"))
    return [(f"{uri.rstrip('/')}/{n}", size) for n, size in found]


class PageSource(DataSource):
    """``spark.read.format("pages").load(path)``; columns are c0, c1, .. unless option ``columns`` names them."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self):
        files = page_files(self.options["path"])
        if not files:
            raise ValueError("no page files and no schema given")
        fs, path = store_of(files[0][0])
        with fs.open_input_file(path) as f:
            _, kinds, _ = read_header(f.read(PAGE))
        names = [x for x in self.options.get("columns", "").split(",") if x] or [f"c{i}" for i in range(len(kinds))]
        if len(names) != len(kinds):
            raise ValueError(f"{len(names)} names for {len(kinds)} columns")
        return T.StructType([T.StructField(n, SPARK[k]) for n, k in zip(names, kinds, strict=True)])

    def reader(self, schema):
        return _PageReader(page_files(self.options["path"]), schema)


def read_pages(spark: SparkSession, uri: str, columns: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(PageSource)
    reader = spark.read.format("pages")
    if columns:
        reader = reader.option("columns", ",".join(columns))
    return reader.load(uri)


def write_pages(df: DataFrame, folder: str, rows_per_file: int = 500_000) -> DataFrame:
    """Writes page files below ``folder``; returns the listing (path, n_rows). Run the listing once, by an action."""
    kinds = [logical(f.dataType) for f in df.schema.fields]
    if not 0 < len(kinds) <= MAX_COLUMNS:
        raise ValueError(f"a page file has 1 to {MAX_COLUMNS} columns")

    def run(batches):
        held, n = [], 0

        def flush():
            path = f"{folder.rstrip('/')}/part-{uuid.uuid4().hex}.tbl"
            table = pa.Table.from_batches(held)
            write_file(path, table.columns, kinds)
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([table.num_rows], pa.int64())], names=["path", "n_rows"])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows_per_file - n)
                held.append(part)
                n += part.num_rows
                batch = batch.slice(part.num_rows)
                if n == rows_per_file:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    return df.mapInArrow(run, "path string, n_rows bigint")
