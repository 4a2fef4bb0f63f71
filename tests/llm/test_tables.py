"""Operators that work across rows, against plain versions."""

import base64
import gzip
import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from millrace.llm import chat, common, components, decontaminate, linededup, setjoin, warc
from millrace.llm.common import work_dir

DIR = "/root/testdata/sf0.001"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def cut(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# near copies


def plain_set(t):
    w = cut(lower(t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_groups(rows):
    sets = [(i, plain_set(t)) for i, t in rows]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            up[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        low[find(k)] = min(i, low.get(find(k), i))
    return {i: (len(s), low[find(k)]) for k, (i, s) in enumerate(sets)}


def variants(r, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = r.choice("pqrst") + str(r.randrange(99))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_groups_random(spark, seed, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", [1024, 6][seed % 2])
    monkeypatch.setattr(setjoin, "CHUNK_ENTRIES", [1_500_000, 40][seed % 2])
    monkeypatch.setattr(setjoin, "MAX_ENTRIES", [2_000_000, 300][seed // 2])
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(200))
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(8):
        texts += variants(r, [word() for _ in range(r.choice([6, 8, 9, 20, 60]))], 14, r.choice([2, 4, 8]))
    texts += [" ".join([word() for _ in range(r.randrange(1, 25))] + passage + [word() for _ in range(r.randrange(1, 25))]) for _ in range(25)]
    texts += ["", None, " \n", "A b", "a B", "one", "x y z", *[texts[3]] * 5, texts[0].upper()]
    r.shuffle(texts)
    rows = list(enumerate(texts, 10))
    got = setjoin.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == plain_groups(rows) and len(got) == len(rows)


def test_block_links_find_all_components():
    r = np.random.default_rng(1)
    for _ in range(30):
        base = [r.choice(400, r.integers(1, 60), replace=False) for _ in range(5)]
        sets = [np.unique(np.where(r.random(len(b)) < 0.08, r.integers(0, 400, len(b)), b)).astype(np.uint64) for b in base for _ in range(12)]
        sets.sort(key=len)
        a, b = setjoin.Forest(len(sets)), setjoin.Forest(len(sets))
        for i, j in setjoin.block_links(sets):
            assert 4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j]))
            a.join(i, j)
        for i, j in itertools.combinations(range(len(sets)), 2):
            if 4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j])):
                b.join(i, j)
        assert [a.find(i) for i in range(len(sets))] == [b.find(i) for i in range(len(sets))]


def test_links_come_from_the_lists(spark, monkeypatch):
    """With small blocks the first pass leaves links out, and without the lists they are lost."""
    monkeypatch.setattr(setjoin, "BLOCK", 2)
    r = random.Random(11)
    base = [[f"{r.choice('abcdefgh')}{r.randrange(500)}" for _ in range(50)] for _ in range(6)]
    rows = list(enumerate(" ".join(w) for b in base for w in ([b, *[[*b[: 50 - k], *(f"z{k}{j}" for j in range(k))] for k in range(1, 9)]])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_groups(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in setjoin.similar_groups(df).collect()} == want
    none = "a bigint, ca bigint, na bigint, b bigint, cb bigint, nb bigint"
    monkeypatch.setattr(setjoin, "_candidates", lambda sets, parts: sets.sparkSession.createDataFrame([], none))
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in setjoin.similar_groups(df).collect()} != want


@pytest.mark.parametrize("seed", range(6))
def test_skip_pairs_against_all_pairs(seed, monkeypatch):
    monkeypatch.setattr(setjoin, "MANY", [2_000_000, 7][seed % 2])
    r = np.random.default_rng(seed)
    k = 120
    t, c, n, p = r.integers(0, 6, k).astype(np.uint64), r.integers(0, 12, k), r.integers(5, 40, k), r.integers(0, 12, k)
    g = np.where(t == 0, r.integers(0, 2, k), setjoin._ALONE)
    order = np.lexsort((p, c, n, t))
    t, c, n, p, g = (x[order] for x in (t, c, n, p, g))
    got = [(int(a), int(b)) for x, y in setjoin.skip_pairs(t, c, n, p, g) for a, b in zip(x, y, strict=True)]
    may = lambda a, b: 7 * min(n[a] - p[a], n[b] - p[b]) >= 3 * (n[a] + n[b]) and 3 * max(n[a], n[b]) <= 4 * min(n[a], n[b])
    pairs = [(a, b) for a, b in itertools.combinations(range(k), 2) if t[a] == t[b] and c[a] != c[b] and (g[a] == setjoin._ALONE or g[a] != g[b])]
    assert sorted(got) == [x for x in pairs if may(*x)] and 0 < len(got) < len(pairs)


@pytest.mark.parametrize("long", [2, 5])
def test_groups_with_split_lists(spark, long, monkeypatch):
    monkeypatch.setattr(setjoin, "LONG", long)
    monkeypatch.setattr(setjoin, "BLOCK", 2)
    r = random.Random(long)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join([*(f"q{r.randrange(60)}" for _ in range(r.randrange(1, 9))), *passage, *(f"q{r.randrange(60)}" for _ in range(r.randrange(1, 9)))])) for i in range(60)]
    got = setjoin.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == plain_groups(rows)


def test_groups_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(5, t), (5, t), (3, t + " x"), (None, t), (None, "alone here with five words"), (8, None), (None, None), (9, "w" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"r": F.lit(1), "n": F.lit(2), "component_id": F.lit("z"), "__id": F.lit(0), "id": F.lit(1), "a.b": F.lit(3)})
    got = sorted(map(tuple, setjoin.similar_groups(df).collect()), key=str)
    assert got == sorted([(5, 36, 3), (5, 36, 3), (3, 37, 3), (None, 36, 3), (None, 1, None), (8, 0, 8), (None, 0, None), (9, 1, 9)], key=str)
    assert setjoin.similar_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_groups_of_ids_with_several_sets(spark, seed):
    r = random.Random(seed)
    texts = []
    for _ in range(6):
        texts += variants(r, [f"{r.choice('abc')}{r.randrange(300)}" for _ in range(r.choice([8, 20, 60]))], 8, 4)
    rows = [(r.randrange(60), t) for t in texts] + [(70, "p q r s t u"), (75, "p q r s t u"), (75, "v w x y z"), (77, "v w x y z")]
    r.shuffle(rows)
    sets, up = [(i, plain_set(t)) for i, t in rows], {i: i for i, _ in rows}
    find = lambda x: x if up[x] == x else find(up[x])
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if 100 * len(x & y) >= 75 * len(x | y):
            a, b = sorted((find(a), find(b)))
            up[b] = a
    got = setjoin.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted((i, len(s), find(i)) for i, s in sets) and find(77) == 70


def test_components(spark, tmp_path):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(7, 7), (100, 101)]
    up = {}
    find = lambda x: x if up.get(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = components.components(spark.createDataFrame(edges, "a long, b long"), str(tmp_path / "c")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {x.node: x.component for x in got} == {x: find(x) for x in linked} and len(got) == len(linked)
    odd = spark.createDataFrame([(5, 5), (None, 3), (4, None), (None, None), (9, 8), (8, 9), (9, 8)], "a long, b long")
    assert sorted(map(tuple, components.components(odd, str(tmp_path / "o")).collect())) == [(8, 8), (9, 8)]
    assert components.components(spark.createDataFrame([], "a long, b long"), str(tmp_path / "d")).count() == 0


# line dedup


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_lines(rows, least=5, exact=1, copies=1):
    """Documents by id; a line goes if an earlier one of enough copies has its words or is near it."""
    lines = [(i, p, tuple(cut(x))) for i, t in sorted(rows, key=lambda x: x[0]) if t is not None for p, x in enumerate(t.split("\n"))]
    count = Counter(w for _, _, w in lines)
    same = lambda v, w: v == w and len(w) >= exact or min(len(v), len(w)) >= least and near(v, w)
    gone = {(i, p) for k, (i, p, w) in enumerate(lines) if any(count[v] >= copies and same(v, w) for _, _, v in lines[:k])}
    return {i: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in rows}


@pytest.mark.parametrize("seed, exact, copies", [(0, 1, 1), (1, 5, 1), (2, 1, 3), (3, 3, 2)])
def test_lines_random(spark, seed, exact, copies):
    r = random.Random(seed)
    pool = [[r.choice("abc") for _ in range(r.randrange(1, 12))] for _ in range(25)]

    def line():
        w = list(r.choice(pool))
        for _ in range(r.randrange(3)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randrange(2)] = [r.choice("abcd")] * r.randrange(2)
        return r.choice(["", " "]) + r.choice([" ", "\t", "  "]).join(w)

    rows = [(i, "\n".join(line() for _ in range(r.randrange(6)))) for i in range(60)]
    rows += [(100, "All rights reserved.\n\n \nOne"), (101, " All  rights reserved.\n\n \nOne two"), (102, "One")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = linededup.dedup_lines(df, exact_words=exact, least_copies=copies).collect()
    assert {x.doc_id: x.text for x in got} == plain_lines(rows, exact=exact, copies=copies)
    assert all(x.n_lines - x.n_removed == len(x.text.split("\n")) or x.text == "" for x in got)


CLASHES = ["__h", "__l", "__d", "__th", "__gone", "a.b", "d", "h1", "p", "h", "th", "odd", "goes", "row", "c0", "c1", "id", "n", "k1", "n_removed", "n_lines", "predicted", "a`b"]


def clashing(df):
    """Further columns whose names operators might use themselves; the values are their numbers."""
    return df.withColumns({n: F.lit(k) for k, n in enumerate(CLASHES)})


def test_lines_odd_rows(spark):
    a, b = "one two three four five", "one two three four six"
    rows = [(3, f"{a}\nshort\nnew\n{a}"), (1, f"{b}\nshort"), (2, None), (4, ""), (5, "\n\n"), (None, f"{a} x y z\nnew words in this line"), (6, f"new words in this line\n{'w ' * 3000}"), (6, f"new words in this line\n{'w ' * 3000}"), (7, "w " * 2999)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(2)
    out = linededup.dedup_lines(df)
    extra = [c for c in CLASHES if c not in ("n_lines", "n_removed")]
    assert out.columns == ["doc_id", "text", *extra, "n_lines", "n_removed"]
    assert all(tuple(x)[2:-2] == tuple(k for k, n in enumerate(CLASHES) if n in extra) for x in out.collect())
    got = sorted(((x.doc_id, x.text, x.n_lines, x.n_removed) for x in out.collect()), key=str)
    long = "w " * 3000
    want = [(3, "new", 4, 3), (1, f"{b}\nshort", 2, 0), (2, None, 0, 0), (4, "", 1, 0), (5, "\n\n", 3, 0), (None, f"{a} x y z\nnew words in this line", 2, 0), (6, long, 2, 1), (6, long, 2, 1), (7, "", 1, 1)]
    assert got == sorted(want, key=str)
    assert linededup.dedup_lines(df.limit(0)).count() == 0
    for bad in ({"min_words": 1}, {"exact_words": 0}, {"exact_words": 6}):
        with pytest.raises(ValueError):
            linededup.dedup_lines(df, **bad)


def test_edit_distance_column(spark):
    r = random.Random(5)
    pairs = [([r.choice("ab") for _ in range(r.randrange(1, 7))], [r.choice("ab") for _ in range(r.randrange(1, 7))]) for _ in range(400)]
    got = spark.createDataFrame(pairs, "x array<string>, y array<string>").select("x", "y", linededup.within_one_word(F.col("x"), F.col("y")).alias("ok")).collect()
    assert all(g.ok == near(g.x, g.y) for g in got)


def test_line_dedup_runs_no_python(spark):
    plan = linededup.dedup_lines(spark.read.parquet(f"{DIR}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# chats

CHATS = [
    (1, 0, "user", "hi"), (1, 1, "user", "again\x1b[\x1be"), (1, 3, "assistant", "yo\x1b;"), (1, 2, "assistant", "\x1b]"), (1, 300, "assistant", ""), (1, 4, "user", "x"), (1, 4, "user", "x"),
    (2, 0, None, None), (3, None, "user", "null turn"), (3, -5, "assistant", "\x1b"), (None, 0, "user", "no id"), (4, 0, "assistant", "</s>[INST] ok [/INST]"), (5, 1, "a\x1b|b", "é😀" * 30_000),
]


def plain_chat(rows):
    rows = sorted(((t is not None, t or 0, r or "", x or "") for _, t, r, x in rows))
    esc = lambda s: s.replace("\x1b", "\x1be")
    out = "".join(f"\x1b[{esc(role)}\x1b|" + "\x1b;".join(esc(x) for *_, x in g) + "\x1b]" for role, g in itertools.groupby(rows, key=lambda x: x[2]))
    return out, [(r, x) for *_, r, x in rows]


def test_chats(spark):
    df = clashing(spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumns({"b": F.lit(1), "c": F.lit(2), "formatted": F.lit(3), "t": F.lit(4)})).repartition(3)
    for bits, long in ((8, 4096), (1, 2), (8, 0)):
        out = chat.format_chats(df, chunk_bits=bits, long=long)
        want = {c: plain_chat([x for x in CHATS if x[0] == c]) for c in {x[0] for x in CHATS}}
        assert {r.conv_id: r.formatted for r in out.collect()} == {c: w[0] for c, w in want.items()}
        for r in chat.read_chats(out).collect():
            assert [tuple(t) for t in r.turns] == want[r.conv_id][1] and r.loss == [x for role, x in want[r.conv_id][1] if role == "assistant"]
    assert chat.format_chats(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, "")], "conv_id long, formatted string")
    assert [tuple(r) for r in chat.read_chats(odd).orderBy("conv_id").collect()] == [(1, None, None), (2, [], [])] and chat.read_chats(odd.limit(0)).count() == 0
    plan = chat.read_chats(out)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# web archives


def pages(spark):
    rows = [(1, "http://a/", "same"), (7, "http://b/ü x\r\n", "same"), (2, "u", None), (4, "u", ""), (3, None, "é\r\n\r\nWARC/1.1"), (9, "v", "y" * 300_000), (9, "v", "y" * 300_000), (None, "n", "same"), (11, "w", "y" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return rows, clashing(df).repartition(3)


def plain_pages(rows, least=0):
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        first = min((j for j, _, h in rows if j is not None and (h or "").encode() == b), default=None)
        again = i is not None and len(b) >= least and first < i
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_archives(spark, least, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 1000)
    rows, df = pages(spark)
    folder = work_dir(spark)
    mono = warc.write_archives(df, f"{folder}/m", least=least)
    out = warc.normalise(mono, f"{folder}/n")
    got = warc.read_archives(out).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain_pages(rows, least)
    html = {i: (h or "").encode() for i, _, h in rows if i is not None}
    assert all(bytes(r.payload) == html[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)
    for r in out.collect():
        path, index = (warc.opened(x)[1] for x in (r.path, r.index_path))
        data = open(path, "rb").read()
        entries = [json.loads(x) for x in open(index)]
        assert len(entries) == r.n_records and sum(e["length"] for e in entries) == len(data)
        for e in entries:
            z = zlib.decompressobj(31)
            one = z.decompress(data[e["offset"] : e["offset"] + e["length"]])
            assert z.eof and not z.unused_data and one.startswith(b"WARC/1.1\r\n") and e["id"].encode() in one and one.endswith(b"\r\n\r\n")
    for r in mono.collect():
        data = open(warc.opened(r.path)[1], "rb").read()
        z = zlib.decompressobj(31)
        z.decompress(data)
        assert z.eof and not z.unused_data  # one member for the whole file
    empty = warc.normalise(warc.write_archives(df.limit(0), f"{folder}/e"), f"{folder}/f")
    assert warc.read_archives(empty).count() == 0
    monkeypatch.setattr(common, "BROADCAST_VALUES", -1)
    joined = warc.read_archives(warc.normalise(warc.write_archives(df, f"{folder}/j", least=least), f"{folder}/k")).collect()
    assert sorted((tuple(r)[:5] for r in joined), key=str) == plain_pages(rows, least)


def test_archives_with_odd_lists(spark):
    folder = work_dir(spark)
    none = spark.createDataFrame([(None, 0)], "path string, n_records long")
    assert warc.normalise(none, f"{folder}/n").count() == 0 and warc.normalise(none.limit(0), f"{folder}/m").count() == 0
    fs, base = warc.opened(f"{folder}/empty.warc.gz")
    fs.create_dir(base.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(base, compression=None) as f:
        f.write(gzip.compress(b""))
    out = warc.normalise(spark.createDataFrame([(f"{folder}/empty.warc.gz", 0)], "path string, n_records long"), f"{folder}/e")
    assert [r.n_records for r in out.collect()] == [0] and warc.read_archives(out).count() == 0


def test_broken_archives():
    a = warc.make_record(1, "u", b"x", None)
    assert [d for _, d in warc.records(iter([a[:10], a[10:] + a]))] == [a, a]
    import io

    assert b"".join(warc.inflate(io.BytesIO(gzip.compress(a) + gzip.compress(a)))) == a + a
    with pytest.raises(ValueError):
        list(warc.records(iter([a[:-3]])))
    with pytest.raises(ValueError):
        list(warc.inflate(io.BytesIO(gzip.compress(a)[:-4])))
    with pytest.raises(ValueError):
        warc.parse_head(b"HTTP/1.1 200 OK")


def test_inflating_is_bounded():
    import io

    plain = b"x" * 50_000_000 + b"end"
    pieces = list(warc.inflate(io.BytesIO(gzip.compress(plain) + gzip.compress(b"") + gzip.compress(b"more"))))
    assert b"".join(pieces) == plain + b"more" and max(map(len, pieces)) <= warc.CHUNK
    assert list(warc.inflate(io.BytesIO(b""))) == [] and list(warc.inflate(io.BytesIO(gzip.compress(b"")))) == []
    with pytest.raises(ValueError):
        list(warc.inflate(io.BytesIO(gzip.compress(plain)[:-9])))
    text = b"\n".join(b"y" * n for n in (0, 3, 2_000_000, 1))
    assert list(warc.lines(io.BytesIO(text))) == text.split(b"\n") and list(warc.lines(io.BytesIO(text + b"\n"))) == text.split(b"\n")


# queries and pipeline


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n.startswith("op")])
def test_queries_agree_with_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for n in ("documents", "benchmark", "labels", "pages", "conversations"):
        c.execute(f"create view {n} as select * from '{DIR}/{n}.parquet'")
    got, want = entry.queries()[name](spark, DIR), c.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert set(names) == set(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))


def test_ten_operators_are_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()


def test_pipeline_stages(spark, tmp_path):
    """Each stage on its own input, against what the operator's plain version keeps; further columns pass through."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    footer = "\nAll rights reserved."
    extra = [(10_000, None, "en", "s", 0), (10_001, "", "en", "s", 0), (None, "some words without any id at all", "en", "s", 1), (3, None, None, None, None)]
    extra += [(20_000 + i, f"A river runs past the old mill number {i} and on to the sea. It is {i} miles long.{footer}", "en", "s", 1) for i in range(9)]
    docs = clashing(docs.unionByName(spark.createDataFrame(extra, docs.schema)))
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {(r.doc_id, r.text) for r in docs.collect()}
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / f"s{k}"))
        out = spark.read.parquet(str(tmp_path / f"s{k}"))
        got = out.collect()
        sizes.append(len(got))
        if k < 4:
            assert out.columns == columns and all(tuple(r)[5:] == tuple(range(len(CLASHES))) for r in got)
            after = {(r.doc_id, r.text) for r in got}
        rows = [x for x in before if x[0] is not None and x != (3, None)]
        if k == 0:
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
            assert after <= before and np.mean([(i in {x for x, _ in after}) == (q == 1) for i, q in labels.items()]) > 0.95
        elif k == 1:
            text = dict(rows)
            want = {(i, t) for i, t in plain_lines(rows, copies=7).items() if t == text[i] or (t or "").strip()}
            assert {x for x in after if x[0] is not None and x != (3, None)} == want
            assert sum(footer in (t or "") for _, t in after) < 9
        elif k == 2:
            assert {i for i, _ in after if i is not None} == {i for i, (_, c) in plain_groups(rows).items() if c == i}
            assert (None, "some words without any id at all") in after or (None, "some words without any id at all") not in before
        elif k == 3:
            own = [(r.doc_id, r.n_hit > 0, r.contaminated) for r in decontaminate.find_contamination(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).collect()]
            assert sorted(str(i) for i, _ in after) == sorted(str(i) for i, _, gone in own if not gone)
            assert all((i, t) in before for i, t in after if (i, False, False) in own)
        else:
            assert sorted((str(r.doc_id), r.decoded_sha256) for r in got) == sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in before)
        docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0]


def test_pipeline_stages_on_odd_tables(spark):
    """Empty tables, nulls and repeated rows through each stage on its own."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, None, None, None, None), (None, "x y", None, None, 1), (4, "x " * 30_000, "en", "s", 1), (4, "x " * 30_000, "en", "s", 1)], docs.schema)
    odd = clashing(odd)
    kept = {1: [1, 1, 2, 4, 4, None, None], 2: [1, 2, 4, None, None], 3: [1, 1, 2, 4, 4, None, None], 4: [1, 1, 2, 4, 4, None, None]}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        none = stage(spark, odd.limit(0), DIR)
        assert none.count() == 0 and (k == 4 or none.columns == odd.columns)
        got = sorted((r.doc_id for r in stage(spark, odd, DIR).collect()), key=lambda x: (x is None, x))
        assert k == 0 or got == kept[k], (k, got)


def test_large_lists_are_shuffled(spark, monkeypatch):
    """Beyond the bound of a broadcast the results are the same."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    ops = (setjoin.similar_groups, lambda d: linededup.dedup_lines(d).select("doc_id", "text", "n_removed"))
    small = [sorted(map(tuple, op(docs).collect())) for op in ops]
    monkeypatch.setattr(common, "BROADCAST_VALUES", -1)
    assert [sorted(map(tuple, op(docs).collect())) for op in ops] == small


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, DIR)
    assert 0 < out.count() <= 200 and corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_pipeline_drops_copies_with_short_lines(spark, tmp_path, monkeypatch):
    a, b = "one two three four five six\nAll rights reserved.", "seven eight nine ten eleven twelve\nOne"
    rows = [(7, a), (3, a), (9, a), (5, b), (None, b), (8, ""), (6, ""), (2, None)] + [(100 + i, a) for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in corpus_pipeline.STAGES if s[0] in ("line dedup", "n-gram Jaccard join")])
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(3, a), (5, b), (None, b), (8, ""), (6, ""), (2, None)], key=str)


def test_pipeline_leaves_no_repeated_line(spark):
    """Lines of fewer copies than LEAST_COPIES go too, exact and near ones, after the near copies are found."""
    r = random.Random(5)
    line = lambda n=40: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    twice, often, own = line(6), line(2), [line() for _ in range(12)]
    rows = [(i, f"{own[i]}\n{often}" if i < 4 else f"{own[i]}\n{twice}{' more' * (i - 4)}") for i in range(6)]
    shared = [line() for _ in range(9)]
    rows += [(6, "\n".join([*shared, own[6]])), (7, "\n".join([*shared, own[7]])), (8, f"{often}\n{twice}"), (None, own[0]), (9, None), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for stage in (corpus_pipeline.drop_repeated_lines, corpus_pipeline.keep_one_of_each_group):
        docs = stage(spark, docs, DIR)
    want = [(0, rows[0][1]), (1, own[1]), (2, own[2]), (3, own[3]), (4, rows[4][1]), (5, own[5]), (6, rows[6][1]), (None, own[0]), (9, None), (10, "")]
    assert sorted(map(tuple, docs.collect()), key=str) == sorted(want, key=str)


def test_encode_leaves_memory_to_python(spark):
    """Before the encoder's workers start, the JVM's heap is collected whole; decoded texts, which no one reads, stay in Python."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = [b for b in beans if b.getName() in ("G1 Old Generation", "PS MarkSweep", "MarkSweepCompact")]
    before = sum(b.getCollectionCount() for b in whole)
    docs = spark.createDataFrame([(1, "a plain text"), (2, None), (None, "")], "doc_id long, text string")
    out = corpus_pipeline.encode(spark, docs, DIR)
    assert sum(b.getCollectionCount() for b in whole) > before
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    assert "decoded#" not in out._jdf.queryExecution().analyzed().toString()
    text = b"a plain text"
    rows = {r.decoded_sha256 for r in out.collect()}
    assert rows == {hashlib.sha256(text).hexdigest(), hashlib.sha256(b"").hexdigest()}
