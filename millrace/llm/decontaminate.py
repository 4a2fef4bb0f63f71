"""Benchmark decontamination: an FM-index per shard of documents, searched backwards for test phrases."""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_VALUES, arrow_type, id_and_text, make_room, out_schema, table, utf8, work_dir, written
from .licenses import fold

#: Words of a window; bytes of benchmark text in one block of queries, on average; documents and words in one shard.
WINDOW, BLOCK_BYTES, SHARD_ROWS, SHARD_WORDS = 13, 2_000_000, 4096, 200_000
#: Every SAMPLE-th place is kept; rows of suffixes that are located at once.
SAMPLE, MANY = 16, 500_000
#: A shard is one row: row groups are closed by size, however few rows they have.
_SMALL_GROUPS = {"parquet.block.size": 8 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1}
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class BitRank:
    """A bit vector with the number of ones before any place."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, bits: np.ndarray) -> BitRank:
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, "<u8")
        words.view(np.uint8)[: len(packed)] = packed
        return cls(words)

    def rank(self, at: np.ndarray) -> np.ndarray:
        w = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Symbols by levels of bits, high bits first: rank of a symbol and access to a place by one step a level."""

    def __init__(self, levels: list[BitRank], zeros: list[int]):
        self.levels, self.zeros, self.bits = levels, zeros, len(levels)

    @classmethod
    def of(cls, symbols: np.ndarray, top: int) -> WaveletMatrix:
        levels, zeros, row = [], [], symbols
        for b in range(max(1, int(top).bit_length()) - 1, -1, -1):
            one = (row >> b) & 1 == 1
            levels.append(BitRank.of(one))
            zeros.append(int(len(row) - one.sum()))
            row = np.concatenate([row[~one], row[one]])
        return cls(levels, zeros)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        lo = np.zeros_like(at)
        for level, (v, z) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - level)) & 1 == 1
            r, s = v.rank(at), v.rank(lo)
            at, lo = np.where(one, z + r, at - r), np.where(one, z + s, lo - s)
        return at - lo

    def step(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before that place."""
        symbol, lo = np.zeros_like(at), np.zeros_like(at)
        for v, z in zip(self.levels, self.zeros, strict=True):
            one, r, s = v.get(at), v.rank(at), v.rank(lo)
            symbol = symbol * 2 + one
            at, lo = np.where(one, z + r, at - r), np.where(one, z + s, lo - s)
        return symbol, at - lo


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order; each zero is a separator of its own, in order of place, and the last symbol is one.

    By doubling: suffixes that the first k symbols tell apart are done; only groups that still agree are sorted by
    the rank of what follows. Words tell most suffixes apart after three or four of them.
    """
    n = len(text)
    stops = text == 0
    key = np.where(stops, np.cumsum(stops) - 1, text.astype(np.int64) + int(stops.sum()))
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)  # the first row of the suffix's group

    def groups(rows: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Sets the ranks of the suffixes in these rows; ``new`` marks where a group begins. Returns the rows still tied."""
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(rows)))
        rank[order[rows]] = np.repeat(rows[first], size)
        return rows[np.repeat(size, size) > 1]

    sorted_keys = key[order]
    rows = groups(np.arange(n), np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if n else np.zeros(0, np.int64)
    k = 1
    while len(rows):
        at = order[rows]
        own, after = rank[at], rank[at + k]
        by = np.lexsort((after, own))
        order[rows] = at[by]
        own, after = own[by], after[by]
        rows = groups(rows, np.concatenate([[True], (own[1:] != own[:-1]) | (after[1:] != after[:-1])]))
        k *= 2
    return order


class FmIndex:
    """Index of one shard's words: numbered words (from 1) with zeros between the documents and at the end."""

    def __init__(self, count: np.ndarray, bwt: WaveletMatrix, marked: BitRank, places: np.ndarray):
        self.count, self.bwt, self.marked, self.places = count, bwt, marked, places

    @classmethod
    def of(cls, text: np.ndarray, top: int) -> FmIndex:
        n = len(text)
        order = suffix_array(text)
        bwt = text[order - 1]  # the suffix at 0 gets the last symbol, a zero
        count = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        # positions are kept for every SAMPLE-th place and for each document's first word, which no step leads out of
        first = np.empty(n, bool)
        first[:1] = True
        first[1:] = text[:-1] == 0
        marked = (first | (np.arange(n) % SAMPLE == 0))[order]
        return cls(count, WaveletMatrix.of(bwt.astype(np.int64), top), BitRank.of(marked), order[marked])

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the suffixes that start with each pattern (one a line): pattern number, first row, end row."""
        which = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.count[-1], np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[which, j]
            lo, hi = self.count[c] + self.bwt.rank(c, lo), self.count[c] + self.bwt.rank(c, hi)
            found = lo < hi
            which, lo, hi = which[found], lo[found], hi[found]
        return which, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix rows: steps back to a kept place."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        at, todo = rows.copy(), np.arange(len(rows))
        while len(todo):
            kept = self.marked.get(at)
            done = todo[kept]
            out[done] = self.places[self.marked.rank(at[kept])] + steps[done]
            todo, at = todo[~kept], at[~kept]
            if len(todo):
                c, r = self.bwt.step(at)
                at = self.count[c] + r
                steps[todo] += 1
        return out


def in_order(items: set[str | None]) -> list[str | None]:
    """Items in order of their ids, those without one first."""
    return sorted(items, key=lambda x: (x is not None, x or ""))


class Phrases:
    """One block of test items: their words, windows by length as rows of word numbers, and the items of each window."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        vocab: dict[bytes, int] = {}
        found: dict[int, list[tuple[np.ndarray, int]]] = {}
        self.items = in_order({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.items)}
        for item, text in items:
            ids = np.array([vocab.setdefault(w, len(vocab)) for w in fold(text).split()], np.int32)
            if len(ids):
                n = min(window, len(ids))
                found.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(ids, n), number[item]))
        self.words = list(vocab)
        self.groups = []  # length, windows, and the items of window k: of[start[k] : start[k + 1]]
        for n, parts in sorted(found.items()):
            windows, which = np.unique(np.concatenate([w for w, _ in parts]), axis=0, return_inverse=True)
            of = np.concatenate([np.full(len(w), i) for w, i in parts])
            pairs = np.unique(np.stack([which.ravel(), of], 1), axis=0)
            self.groups.append((n, windows, np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1)), pairs[:, 1]))


class _Numbers(dict):
    """Numbers words from 1 as they are first met."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


class Shard:
    """The FM-index over all words of some texts, with its vocabulary and where each text starts."""

    def __init__(self, index: FmIndex, words: list[bytes], start: np.ndarray):
        self.index, self.words, self.start = index, words, start

    @classmethod
    def of(cls, texts: list[bytes | None]) -> Shard:
        vocab = _Numbers()
        ids = [np.fromiter(map(vocab.__getitem__, w), np.int64, len(w)) for w in (fold(t or b"").split() for t in texts)]
        start = np.cumsum([0, *(len(x) + 1 for x in ids)])  # one separator after each text
        text = np.zeros(int(start[-1]), np.int64)
        for at, x in zip(start.tolist(), ids, strict=False):
            text[at : at + len(x)] = x
        return cls(FmIndex.of(text, len(vocab)), list(vocab), start)

    def dump(self) -> bytes:
        x, out = self.index, io.BytesIO()
        levels = np.stack([v.words for v in x.bwt.levels])
        np.savez(out, count=x.count.astype(np.int32), levels=levels, zeros=x.bwt.zeros, marked=x.marked.words, places=x.places.astype(np.int32), words=np.frombuffer(b" ".join(self.words), np.uint8), start=self.start)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Shard:
        x = np.load(io.BytesIO(data), allow_pickle=False)
        bwt = WaveletMatrix([BitRank(v) for v in x["levels"]], x["zeros"].tolist())
        index = FmIndex(x["count"].astype(np.int64), bwt, BitRank(x["marked"]), x["places"].astype(np.int64))
        return cls(index, x["words"].tobytes().split(), x["start"])

    def find(self, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
        """Merged spans of words inside windows, as flat [first, end, first, end ..], and each (text, item) found once."""
        size = int(self.start[-1])
        delta, seen = np.zeros(size + 1, np.int64), [np.zeros((0, 2), np.int64)]
        own = {w: k for k, w in enumerate(self.words, 1)}
        number = np.fromiter((own.get(w, 0) for w in phrases.words), np.int64, len(phrases.words))
        for n, windows, first, of in phrases.groups:
            patterns = number[windows]
            there = np.flatnonzero((patterns > 0).all(1))
            which, lo, hi = self.index.search(patterns[there])
            which, hits = there[which], hi - lo
            done = 0
            while done < len(which):  # so many rows at once that memory stays bounded
                upto = max(done + 1, int(np.searchsorted(np.cumsum(hits[done:]), MANY)) + done)
                some = hits[done:upto]
                places = self.index.locate(_stretches(lo[done:upto], some))
                np.add.at(delta, places, 1)
                np.add.at(delta, places + n, -1)
                docs, w = np.searchsorted(self.start, places, side="right") - 1, np.repeat(which[done:upto], some)
                docs, w = np.unique(np.stack([docs, w], 1), axis=0).T
                k = first[w + 1] - first[w]
                seen.append(np.unique(np.stack([np.repeat(docs, k), of[_stretches(first[w], k)]], 1), axis=0))
                done = upto
        hit = np.concatenate([[0], np.cumsum(delta[:-1]) > 0, [0]]).astype(np.int8)
        pairs = np.unique(np.concatenate(seen), axis=0)
        return np.flatnonzero(np.diff(hit)), pairs[:, 0], [phrases.items[i] for i in pairs[:, 1].tolist()]


def _stretches(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all [lo, lo + size), one after another."""
    return np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def verdicts(start: np.ndarray, hits: list[tuple[np.ndarray, list[int], list[str | None]]]) -> list[tuple]:
    """(n_words, n_hit, items, spans) of each text of a shard, from what each block has found; spans in words of the text."""
    delta, items = np.zeros(int(start[-1]) + 1, np.int64), {}
    for spans, docs, of in hits:
        np.add.at(delta, spans[::2], 1)
        np.add.at(delta, spans[1::2], -1)
        for d, i in zip(docs, of, strict=True):
            items.setdefault(int(d), set()).add(i)
    hit = np.cumsum(delta) > 0
    out = []
    for i, (a, b) in enumerate(zip(start[:-1].tolist(), (start[1:] - 1).tolist(), strict=True)):
        if i in items:
            own = hit[a:b]
            spans = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]]).astype(np.int8))).tolist()
            out.append((b - a, int(own.sum()), in_order(items[i]), spans))
        else:
            out.append((b - a, 0, [], []))
    return out


def judge(texts: list[bytes | None], blocks: list[Phrases]) -> list[tuple]:
    """(n_words, n_hit, items, spans) of each text, as one shard."""
    shard = Shard.load(Shard.of(texts).dump())
    return verdicts(shard.start, [shard.find(block) for block in blocks])


def cut(text: bytes, spans: list[int]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    words = [m.span() for m in _WORD.finditer(fold(text))]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return b"".join([*out, text[at:]])


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, folder: str) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark's items with a text, in blocks of about BLOCK_BYTES: one block at a time comes to the driver."""
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), utf8(item_text).alias("t")).where("t IS NOT NULL")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    if n > 1:
        items.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n))).repartition("b").write.partitionBy("b").parquet(f"{folder}/blocks")
        items = benchmark.sparkSession.read.schema("i string, t binary, b bigint").parquet(f"{folder}/blocks")
    for k in range(n):
        rows = (items.where(F.col("b") == k) if n > 1 else items).select("i", "t").collect()
        yield [(r["i"], bytes(r["t"])) for r in rows]


def index_shards(docs: DataFrame, id_col: str, text_col: str, with_text: bool, path: str) -> DataFrame:
    """Writes the documents' shards: rows (shard, index, start, docs), docs an array of (id, and the text if asked for).

    A shard is up to SHARD_ROWS documents and about SHARD_WORDS words of one partition; the index covers every word.
    """
    src, texts_of = id_and_text(docs, id_col, text_col)
    one = [T.StructField("id", src.schema["__id"].dataType), *[T.StructField("text", T.BinaryType())] * with_text]
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("index", T.BinaryType()), T.StructField("start", T.ArrayType(T.LongType())), T.StructField("docs", T.ArrayType(T.StructType(one)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        make_room()
        number = TaskContext.get().partitionId() << 32

        def shard(ids: list[pa.Array], texts: list[bytes | None]) -> pa.RecordBatch:
            fields = [pa.concat_arrays(ids), *[pa.array(texts, pa.binary())] * with_text]
            rows = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pa.StructArray.from_arrays(fields, ["id", "text"][: len(fields)]))
            made = Shard.of(texts)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([made.dump()], pa.binary()), pa.array([made.start], pa.list_(pa.int64())), rows], names=["shard", "index", "start", "docs"])

        ids, texts, words = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids.append(part.column(0))
                texts += texts_of(part)
                words += sum(len(t or b"") for t in texts[-part.num_rows :]) // 6
                if len(texts) >= SHARD_ROWS or words >= SHARD_WORDS:
                    yield shard(ids, texts)
                    ids, texts, words, number = [], [], 0, number + 1
        if texts:
            yield shard(ids, texts)

    src.mapInArrow(run, schema).write.options(**_SMALL_GROUPS).parquet(path)
    return docs.sparkSession.read.schema(schema).parquet(path)


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text: str = "text", window: int = WINDOW, with_spans: bool = True, folder: str | None = None,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated and, if asked for, ``spans`` and ``cut_text``
    (the text without the spans; null where there are none).

    Every shard of documents is indexed once, over all its words, and the indexes are written. The benchmark then goes
    past them in blocks of about BLOCK_BYTES of text: one block at a time is on the driver and on the executors, and
    its hits are written before the next. Null and empty texts have no words and are clean; items without a text are
    left out, those without an id count as one item that the digest of ids leaves out; repeated items count once,
    repeated documents are judged each on their own. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or work_dir(spark)
    nested = text_col.startswith(f"{id_col}.")
    field = text_col[len(id_col) + 1 :]
    shards = index_shards(docs, id_col, text_col, with_spans and not nested, f"{folder}/shards")

    paths = []
    for block in _blocks(benchmark, item_col, item_text, folder):
        phrases = spark.sparkContext.broadcast(Phrases(block, window))

        def search(batches: Iterator[pa.RecordBatch], phrases=phrases) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    spans, of, items = Shard.load(batch.column(1)[k].as_py()).find(phrases.value)
                    if len(spans):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).slice(k, 1), *(pa.array([x], pa.list_(t)) for x, t in ((spans, pa.int64()), (of, pa.int64()), (items, pa.string())))],
                            names=["at", "spans", "of", "items"],
                        )

        hits = shards.select("shard", "index").mapInArrow(search, "at bigint, spans array<bigint>, of array<bigint>, items array<string>")
        paths.append(f"{folder}/hits{len(paths)}")
        written(hits, paths[-1])
        phrases.destroy()
    hits = spark.read.schema("at bigint, spans array<bigint>, of array<bigint>, items array<string>").parquet(*paths)
    each = hits.groupBy("at").agg(F.collect_list(F.struct("spans", "of", "items")).alias("hits"))
    if (hits.agg(F.sum(F.expr("1 + size(spans) + 4 * size(of)"))).first()[0] or 0) <= BROADCAST_VALUES:
        each = F.broadcast(each)

    fields = [("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("contaminated", "boolean")]
    fields += [("spans", "array<long>"), ("cut_text", "binary")] if with_spans else []
    types, names = [arrow_type(t) for _, t in fields], [id_col, *(n for n, _ in fields)]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        for batch in batches:
            for k in range(batch.num_rows):
                start = np.array(batch.column(0)[k].as_py(), np.int64)
                found = [(np.array(h["spans"], np.int64), h["of"], h["items"]) for h in batch.column(2)[k].as_py() or ()]
                docs = batch.column(1).slice(k, 1).flatten()
                ids, rows = docs.field(0), []
                for i, (n, hit, of, spans) in enumerate(verdicts(start, found)):
                    row = (n, hit, len(of), hashlib.sha256(",".join(x for x in of if x is not None).encode()).hexdigest(), hit > 0 and 20 * hit >= n)
                    if with_spans:
                        text = (ids.field(field)[i].cast(pa.binary()) if nested else docs.field(1)[i]).as_py() if spans else None
                        row = (*row, spans, cut(text, spans) if spans else None)
                    rows.append(row)
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, type=t) for c, t in zip(cols, types, strict=True))], names=names)

    id_type = shards.schema["docs"].dataType.elementType["id"].dataType
    both = shards.join(each, F.col("shard") == F.col("at"), "left").select("start", "docs", "hits")
    return both.mapInArrow(finish, out_schema(id_col, id_type, fields))


def op4(spark, sf_dir):
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), with_spans=False)


OP4_SQL = r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, list_slice(w, i, i + 12) AS win FROM b, range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(2, len(w) - 11) END) r(i)),
k AS (SELECT DISTINCT win, len(win) AS n FROM p),
d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win FROM d, (SELECT DISTINCT n FROM k) l, range(1, len(w) - n + 2) r(i)),
m AS (SELECT x.doc_id, x.i, x.n, x.win FROM x JOIN k ON x.win = k.win),
h AS (SELECT doc_id, COUNT(DISTINCT j) AS n_hit FROM m, range(m.i, m.i + m.n) r(j) GROUP BY doc_id),
t AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT m.doc_id, p.item FROM m JOIN p ON m.win = p.win) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit, CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items,
  sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
