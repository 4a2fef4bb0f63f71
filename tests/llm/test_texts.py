"""Operators that map one text to one row, against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from millrace.llm import bpe, decontaminate, licenses, mil, quality, toxicity

DIR = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \t\r\n"), (4, "x" * 70_000), (5, "word " * 20_000), (6, "Grüße an alle <b> 你好 😀"), (6, "Grüße an alle <b> 你好 😀"), (None, "no id here\nno id here"), (7, "\x00\x1b[mit license")]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, with columns whose names clash with results."""
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"n_words": F.lit("x"), "score": F.lit(1), "__id": F.lit(2), "labels": F.lit("y"), "kept": F.lit(None).cast("int")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def same_for_empty_table(op, df):
    out = op(df.limit(0))
    assert out.count() == 0 and out.schema == op(df).schema


# quality rules


def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, dups = [], 0
    for line in (text or "").split("\n"):
        dups += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in lines
        lines.append(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    inside = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dups, len(inside), failed


def test_quality_base_counts(docs, odd, texts):
    crf = quality.fit_crf(docs, docs, sample=100)
    got = {r.doc_id: tuple(r)[1:7] for r in quality.quality_rules(docs, crf).collect()}
    assert got == {i: plain_base(t) for i, t in texts}
    rows = quality.quality_rules(odd, crf).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:7]) for r in rows) == sorted((str(i), *plain_base(t)) for i, t in ODD)
    assert not any(r.kept for r in rows if r.base_failed)
    same_for_empty_table(lambda d: quality.quality_rules(d, crf), odd)


def test_repeated_words_random():
    r = random.Random(1)
    for _ in range(200):
        words = [r.choice([b"a", b"b"]) for _ in range(r.randrange(60))]
        assert quality.repeated_words(words) == plain_base(" ".join(x.decode() for x in words))[4]


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(1)
    for n in range(1, 8):
        crf = quality.LineCrf(r.normal(size=(quality.N_FEATURES, 2)), r.normal(size=(2, 2)))
        lv = quality.levels(r.random((n, len(quality.BOUNDS))) * 10)
        emit = crf.w[lv].sum(1)
        cost = lambda y: sum(emit[i, k] for i, k in enumerate(y)) + sum(crf.t[a, b] for a, b in itertools.pairwise(y))  # noqa: E731, B023
        assert cost(crf.viterbi(lv)) == pytest.approx(max(map(cost, itertools.product((0, 1), repeat=n))))


def test_crf_marginals_and_verdicts(docs, spark):
    r = np.random.default_rng(2)
    emit, t = r.normal(size=(1, 4, 2)), r.normal(size=(2, 2))
    p, pair = quality.LineCrf._marginals(emit, t, np.ones((1, 4), bool))
    paths = list(itertools.product((0, 1), repeat=4))
    w = np.array([np.exp(sum(emit[0, i, k] for i, k in enumerate(y)) + sum(t[a, b] for a, b in itertools.pairwise(y))) for y in paths])
    w /= w.sum()
    for i in range(4):
        assert p[0, i, 1] == pytest.approx(sum(x for x, y in zip(w, paths, strict=True) if y[i]))
    assert pair.sum() == pytest.approx(3)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    kept = {r.doc_id: r.kept or r.n_words < 20 for r in quality.quality_rules(docs, quality.fit_crf(docs, docs, sample=100)).collect()}
    good = [kept[i] for i, q in labels.items() if q == 1]
    bad = [kept[i] for i, q in labels.items() if q == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.35 * len(bad)


# quality classifier and toxicity


def test_mil_gradient():
    r = np.random.default_rng(3)
    model = mil.AttentionMil.start(np.zeros(mil.N_INPUTS), np.ones(mil.N_INPUTS))
    x, first, y = r.normal(size=(7, mil.N_INPUTS)) / 8, np.array([0, 3, 4]), np.array([1.0, 0.0, 1.0])
    g = model.gradient(x, first, y, np.ones(3))

    def loss():
        s = model.forward(x, first)["s"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).sum()

    for k in model.p:
        at = tuple(r.integers(n) for n in model.p[k].shape)
        old = model.p[k][at]
        model.p[k][at] = old + 1e-5
        up = loss()
        model.p[k][at] = old - 1e-5
        down = loss()
        model.p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7), k


def test_mil_passages_are_batch_independent(texts):
    raw = [None, b"", *[t.encode() for _, t in texts[:30]]]
    x, first = mil.passages(raw, mil.Words())
    for i, t in enumerate(raw):
        alone, _ = mil.passages([t], mil.Words())
        end = first[i + 1] if i + 1 < len(raw) else len(x)
        assert np.allclose(x[first[i] : end], alone) and len(alone) == max(1, -(-len((t or b"").split()) // mil.PASSAGE))


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.mark.parametrize("query, label, mod, rest, least", [("op3_attention_mil", "quality", 4, 2, 0.985), ("op8_nnpu_toxicity", "toxic", 5, 0, 0.93)])
def test_held_out_scores(spark, query, label, mod, rest, least):
    folder = "/root/testdata/sf0.1"
    rows = entry.queries()[query](spark, folder).collect()
    assert len(rows) == 10_000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1 for r in rows)
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in y]
    assert auc(np.array([r.score for r in held]), np.array([y[r.doc_id] for r in held])) >= least


def test_classifiers_on_odd_rows(spark, odd, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, 0), (4, None, None), (None, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")
    for fit, score in ((mil.fit_mil, mil.score_quality), (toxicity.fit_toxicity, toxicity.score_toxicity)):
        for lab in (labels, labels.limit(0)):
            model = fit(odd, lab)
            rows = score(odd, model).collect()
            assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        same_for_empty_table(lambda d, s=score, m=model: s(d, m), odd)


def test_nnpu_finds_the_planted_word(spark):
    r = random.Random(4)
    text = lambda bad: " ".join([*(f"w{r.randrange(300)}" for _ in range(40)), *["vile"] * bad])
    rows = [(i, text(i % 10 == 0)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(0, 900)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, least_lift=4.0)
    assert b"vile" in model.vocab and len(model.vocab) < 20
    s = model.score([text(i % 2).encode() for i in range(200)])
    assert (s[1::2] >= 0.5).all() and (s[::2] < 0.5).all()
    assert len(toxicity.fit_toxicity(docs, labels, least_lift=4.0, max_features=1).vocab) == 1


def test_nnpu_steps_against_plain_loops():
    """The weights after a few steps, with and without the turned gradient, from the risk's definition and differences."""
    r, turned = random.Random(12), set()
    for prior, rate in ((0.1, 0.05), (0.8, 0.5)):
        pos, unl = ([sorted(r.sample(range(5), r.randrange(4))) for _ in range(n)] for n in (7, 11))
        got = toxicity.PuModel.fit([b"a", b"b", b"c", b"d", b"e"], pos, unl, prior, 6, rate, 1e-3)
        z = lambda w, t: w[5] + sum(w[f] for f in t)
        mean = lambda f, some: sum(f(t) for t in some) / len(some)
        plus = lambda w: prior * mean(lambda t: np.log1p(np.exp(-z(w, t))), pos)  # noqa: E731, B023
        minus = lambda w: mean(lambda t: np.log1p(np.exp(z(w, t))), unl) - prior * mean(lambda t: np.log1p(np.exp(z(w, t))), pos)  # noqa: E731, B023
        x = lambda t: np.array([*(float(f in t) for f in range(5)), 1.0])
        p = lambda w, t: 1 / (1 + np.exp(-z(w, t)))
        d_plus = lambda w: -prior * mean(lambda t: (1 - p(w, t)) * x(t), pos)  # noqa: E731, B023
        d_minus = lambda w: mean(lambda t: p(w, t) * x(t), unl) - prior * mean(lambda t: p(w, t) * x(t), pos)  # noqa: E731, B023
        w, m, v = np.array([0.0] * 5 + [np.log(prior / (1 - prior))]), 0.0, 0.0
        for step in range(1, 7):
            for f, d in ((plus, d_plus), (minus, d_minus)):
                assert np.allclose(d(w), [(f(w + e) - f(w - e)) / 2e-4 for e in np.eye(6) * 1e-4], atol=1e-6)
            g = d_plus(w) + d_minus(w) if minus(w) >= 0 else -d_minus(w)
            turned.add(bool(minus(w) < 0))
            g = g + 1e-3 * prior * np.append(w[:-1], 0)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        assert np.allclose([*got.weights, got.bias], w, atol=1e-9)
    assert turned == {True, False}


def test_feature_choice_against_plain_counts(spark):
    r = random.Random(5)
    sides = {k: [" ".join(r.choice(["alpha", "beta", "gamma", "delta"][: 2 + 2 * k]) for _ in range(4)) for _ in range(60)] for k in (0, 1)}
    rows = [(k, t) for k, some in sides.items() for t in some]
    count = Counter((f, k) for k, t in rows for f in toxicity.all_features(t.encode().split()))
    lift = {}
    for f in {f for f, _ in count}:
        a, b = count[f, 1], count[f, 0]
        base = (a + b + 1) / 122
        lift[f] = (a / 60 - b / 60) / np.sqrt(base * (1 - base) * (2 / 60))
    want = sorted((f for f in lift if abs(lift[f]) >= 3 and count[f, 0] + count[f, 1] >= 10), key=lambda f: (-abs(lift[f]), f))
    assert toxicity.choose_features(spark.createDataFrame(rows, "k int, x string"), 60, 60, 100, 10, 3.0) == want and want


def test_toxicity_scores_against_plain_sums(texts):
    r = random.Random(6)
    vocab = sorted({f for _, t in texts[:40] for f in toxicity.all_features(licenses.fold(t.encode()).split()) if r.random() < 0.1})
    model = toxicity.PuModel(vocab, np.array([r.uniform(-2, 2) for _ in vocab]), -0.5)
    some = [None, "", *(t for _, t in texts[:80])]
    for t, got in zip(some, model.score([x and x.encode() for x in some]), strict=True):
        has = set()
        for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")):
            b = w.encode()
            has |= {b, *(b"\x00" + b[:n] for n in (4, 5, 6) if len(b) > n)}
        z = -0.5 + sum(model.weights[model.vocab[f]] for f in has if f in model.vocab)
        assert got == pytest.approx(1 / (1 + np.exp(-z)))


def plain_mil(model, text):
    """The score of one text, passage by passage in plain Python."""
    words = (text or "").encode().split()
    cuts = [words[i : i + 64] for i in range(0, len(words), 64)] or [[]]
    h, e = [], []
    for cut in cuts:
        n, x = len(cut), [0.0] * mil.N_INPUTS
        for w in cut:
            x[zlib.crc32(w.lower().strip(b".,;:!?\"'()")) % mil.BUCKETS] += 1 / n
        x[: mil.BUCKETS] = [v**0.5 for v in x[: mil.BUCKETS]]
        for w in cut:
            chars, upper = len(w.decode()), sum(65 <= c <= 90 for c in w)
            symbols = sum(c in b"#*$%&|<>@^~=+\\/_" for c in w)
            values = (chars, chars * chars / 16, upper, upper > 1, symbols, symbols > 0, sum(48 <= c <= 57 for c in w), w[-1:] in b".,;:", w[-1:] in b"!?")
            for k, v in enumerate(values):
                x[mil.BUCKETS + k] += v / n
        x[-3:] = len(set(cut)) / n if n else 0, np.log1p(n), float(n > 0)
        x = (np.array(x) - model.mean) / model.scale
        h.append(np.tanh(x @ model.p["W"] + model.p["b"]))
        e.append(float((np.tanh(h[-1] @ model.p["V"]) / (1 + np.exp(-(h[-1] @ model.p["U"])))) @ model.p["w"]))
    a = np.exp(np.array(e) - max(e))
    z = sum(w * v for w, v in zip(a / a.sum(), h, strict=True))
    return 1 / (1 + np.exp(-float(z @ model.p["c"] + model.p["d"][0])))


def test_mil_scores_against_plain_loops(spark, texts, odd):
    model = mil.AttentionMil.start(np.full(mil.N_INPUTS, 0.1), np.full(mil.N_INPUTS, 0.5), seed=3)
    df = spark.createDataFrame([(i, t) for i, t in texts[:60]], "doc_id long, text string")
    for r, (_, t) in zip(mil.score_quality(df.coalesce(1), model).collect(), texts[:60], strict=True):
        assert r.score == pytest.approx(plain_mil(model, t), abs=1e-5) and r.predicted == (r.score >= 0.7)
    for r, (_, t) in zip(mil.score_quality(odd.coalesce(1), model).collect(), ODD, strict=True):
        assert r.score == pytest.approx(plain_mil(model, t), abs=1e-5)


def test_content_share_and_kept_against_all_labellings(spark, texts):
    """content_share and kept from the best of all labellings of a text's lines, found by trying each."""
    r = np.random.default_rng(9)
    crf = quality.LineCrf(r.normal(size=(quality.N_FEATURES, 2)), r.normal(size=(2, 2)))
    some = [(i, "\n".join((t or "").split("\n")[:9])) for i, t in [*texts[:50], *ODD]]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(some)], "doc_id long, text string")
    rows = {x.doc_id: x for x in quality.quality_rules(df, crf, content_share=0.4).collect()}
    for k, (_, t) in enumerate(some):
        lines = [x for x in t.encode().split(b"\n") if x.split()]
        emit = crf.w[quality.levels(quality.line_values(lines, [x.split() for x in lines]))].sum(1) if lines else np.zeros((0, 2))
        cost = lambda y: sum(emit[i, v] for i, v in enumerate(y)) + sum(crf.t[a, b] for a, b in itertools.pairwise(y))  # noqa: E731, B023
        best = max(itertools.product((0, 1), repeat=len(lines)), key=cost)
        n = len(t.split())
        share = sum(len(x.split()) for x, y in zip(lines, best, strict=True) if y == quality.CONTENT) / n if n else 0.0
        assert rows[k].content_share == pytest.approx(share) and rows[k].kept == (not rows[k].base_failed and share >= 0.4)


# decontamination


def plain_hits(texts, items, window):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for t in texts:
        w, hit, found = cut(t), set(), set()
        for item, q in ((i, cut(q)) for i, q in items):
            for k in range(max(1, len(q) - window + 1) if q else 0):
                z = q[k : k + window]
                for i in range(len(w) - len(z) + 1):
                    if w[i : i + len(z)] == z:
                        hit |= set(range(i, i + len(z)))
                        found.add(item)
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_fm_index_against_scan(seed):
    r = random.Random(seed)
    voc, window = ["a", "B", "é", "7", "dd"][: r.choice([2, 5])], r.choice([1, 2, 4])
    gen = lambda n: r.choice([" ", ", ", "-"]).join(r.choice(voc) for _ in range(n))
    items = [(str(i), gen(r.randrange(10))) for i in range(6)]
    docs = [None, "", *(gen(r.randrange(50)) for _ in range(10)), *(f"zz {q} yy {q}" for _, q in items)]
    blocks = [decontaminate.Phrases([(i, q.encode()) for i, q in part], window) for part in (items[:3], items[3:])]
    assert [x[:3] for x in decontaminate.judge([t and t.encode() for t in docs], blocks)] == plain_hits(docs, items, window)


def test_wavelet_matrix_and_suffix_array():
    r = np.random.default_rng(5)
    text = np.append(r.integers(0, 6, 400), 0)
    w = decontaminate.WaveletMatrix.of(text, 5)
    for at in (0, 1, 63, 64, 65, 200, 401):
        for c in range(6):
            assert w.rank(np.array([c]), np.array([at]))[0] == (text[:at] == c).sum()
    symbols, _ = w.step(np.arange(len(text)))
    assert (symbols == text).all()
    zeros = np.cumsum(text == 0)
    key = lambda i: [(0, zeros[k]) if text[k] == 0 else (1, text[k]) for k in range(i, len(text))]
    assert decontaminate.suffix_array(text).tolist() == sorted(range(len(text)), key=key)
    again = np.concatenate([np.tile(np.append(r.integers(1, 6, 90), 0), 5), np.ones(70, int), [0]])
    key2 = np.cumsum(again == 0)
    order = sorted(range(len(again)), key=lambda i: [(0, key2[k]) if again[k] == 0 else (1, again[k]) for k in range(i, len(again))])
    assert decontaminate.suffix_array(again).tolist() == order
    stored = decontaminate.Shard.load(decontaminate.Shard.of([b"a b a", None, b"", b"b c"]).dump())
    assert stored.words == [b"a", b"b", b"c"] and stored.start.tolist() == [0, 4, 5, 6, 9]


def test_contamination_operator(spark, odd, texts, docs, monkeypatch):
    bench = spark.createDataFrame([(1, "word word word"), (2, None), (3, ""), (4, "no id here"), (4, "no id here"), (None, "x")], "item_id long, text string")
    got = decontaminate.find_contamination(odd.coalesce(1), bench).collect()
    want = plain_hits([t for _, t in ODD], [("1", "word word word"), ("4", "no id here")], 13)
    assert [(r.n_words, r.n_hit, r.n_items) for r in got] == [(n, h, len(i)) for n, h, i in want]
    assert [r.items_sha256 for r in got] == [hashlib.sha256(",".join(i).encode()).hexdigest() for _, _, i in want]
    assert [r.contaminated for r in got] == [h > 0 and 20 * h >= n for n, h, _ in want] and got[7].cut_text.strip() == b"" and got[0].cut_text is None
    same_for_empty_table(lambda d: decontaminate.find_contamination(d, bench), odd)
    assert decontaminate.find_contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    real = spark.read.parquet(f"{DIR}/benchmark.parquet")
    one = decontaminate.find_contamination(docs, real).collect()
    assert [(r.n_words, r.n_hit, r.n_items) for r in sorted(one, key=lambda r: r.doc_id)] == [(n, h, len(i)) for n, h, i in plain_hits([t for _, t in sorted(texts)], [(str(r.item_id), r.text) for r in real.collect()], 13)]
    order = lambda rows: sorted(rows, key=lambda r: r.doc_id)
    largest, blocks = [], decontaminate._blocks
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(decontaminate, "SHARD_ROWS", 64)
    monkeypatch.setattr(decontaminate, "_blocks", lambda *a: (largest.append(sum(len(t) for _, t in b)) or b for b in blocks(*a)))
    assert order(decontaminate.find_contamination(docs, real).collect()) == order(one)
    total = sum(len((r.text or "").encode()) for r in real.collect())
    assert len(largest) > 5 and sum(largest) == total and max(largest) < total / 2
    assert decontaminate.cut(b"A b, c d. e", [1, 3]) == b"A  d. e"


# byte-level BPE


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as p
    import tiktoken

    path = p.path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.encoder(path, p.PATTERN)
    return enc, tiktoken.Encoding("plain", pat_str=p.PATTERN, mergeable_ranks=enc.fst.ranks, special_tokens={}), (path, p.PATTERN)


def ids(blob):
    return np.frombuffer(blob, "<u4").tolist()


def test_bpe_against_tiktoken(tokenizer, texts, monkeypatch):
    enc, plain, _ = tokenizer
    monkeypatch.setattr(enc.fst, "max_states", 2000)
    monkeypatch.setattr(enc, "max_pieces", 500)
    r = random.Random(6)
    chars = [chr(c) for c in [*range(32, 127), 9, 10, 13, 0xE9, 0x4E2D, 0x1F600, 0x301, 0xA0, 0x2028]]
    cases = [t for _, t in texts] + ["".join(r.choice(chars) for _ in range(r.randrange(40))) for _ in range(1500)]
    cases += [r.choice(["a", " ", "\n", "ab", "=", "eau", "é"]) * r.randrange(1, 3000) for _ in range(60)]
    cases += [b"".join(r.choice(enc.words) for _ in range(r.randrange(8))).decode("utf-8", "replace") for _ in range(1500)]
    for t in cases:
        blob = enc.encode(t)
        assert ids(blob) == plain.encode_ordinary(t) and enc.decode(blob) == t.encode()


def test_streaming_decode(tokenizer):
    enc, _, _ = tokenizer
    r = random.Random(7)
    for _ in range(1500):
        some = [r.randrange(len(enc.words)) for _ in range(r.randrange(8))]
        d = bpe.StreamDecoder(enc.words)
        got = "".join([*(d.feed([t]) for t in some), d.end()])
        assert got == b"".join(enc.words[t] for t in some).decode("utf-8", "replace")


@pytest.mark.parametrize("chunk", [1, 3, 4096])
def test_encoder_decodes_by_stream(tokenizer, monkeypatch, chunk):
    enc, _, _ = tokenizer
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    r = random.Random(9)
    part = [i for i, w in enumerate(enc.words) if w.decode("utf-8", "ignore").encode() != w]  # tokens that cut a character
    for _ in range(400):
        some = [r.choice(part) if r.random() < 0.4 else r.randrange(len(enc.words)) for _ in range(r.randrange(20))]
        assert enc.decode(np.array(some, "<u4").tobytes()) == b"".join(enc.words[t] for t in some).decode("utf-8", "replace").encode()


def test_bpe_operator(tokenizer, odd):
    _, plain, how = tokenizer
    rows = bpe.encode(odd, *how, with_digests=True).collect()
    for r, (i, t) in zip(rows, ODD, strict=True):
        assert (r.doc_id, ids(r.ids), r.n_tokens) == (i, plain.encode_ordinary(t or ""), len(plain.encode_ordinary(t or ""))) and r.decoded == (t or "").encode()
        assert r.ids_sha256 == hashlib.sha256(r.ids).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded).hexdigest()
    back = bpe.decode(bpe.encode(odd, *how), *how).collect()
    assert [r.text for r in back] == [t or "" for _, t in ODD]
    same_for_empty_table(lambda d: bpe.encode(d, *how), odd)


# license scans


def plain_license(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_license_base(docs, odd, texts, spark):
    assert {r.doc_id: tuple(r)[1:6] for r in licenses.scan_licenses(docs).collect()} == {i: plain_license(t) for i, t in texts}
    rows = licenses.scan_licenses(odd).collect()
    assert [tuple(r)[1:6] for r in rows] == [plain_license(t) for _, t in ODD] and all(0 <= r.score <= 1 for r in rows)
    same_for_empty_table(licenses.scan_licenses, odd)
    t = "MIT License mit license, cc by cc-by GNU General Public License"
    assert tuple(licenses.scan_licenses(spark.createDataFrame([(1, t)], "doc_id int, text string")).first())[1:6] == plain_license(t)


def expand(markup):
    """All wordings of a template with variables of up to two words of one kind."""
    tokens = re.findall(r"<<opt>>|<</opt>>|<<var:\d+>>|<<alt:[^>]*>>|[^<]+", markup)

    def seq(i):
        out = [""]
        while i < len(tokens) and tokens[i] != "<</opt>>":
            t = tokens[i]
            if t == "<<opt>>":
                inner, i = seq(i + 1)
                ways = ["", *inner]
            elif t.startswith("<<var"):
                ways = ["", "v", "v v"]
            elif t.startswith("<<alt"):
                ways = t[6:-2].split("|")
            else:
                ways = [t]
            out = [f"{a} {b}" for a in out for b in ways]
            i += 1
        return out, i

    return {" ".join(licenses.fold(x.encode()).decode().split()) for x in seq(0)[0]}


@pytest.mark.parametrize("markup", ["a <<opt>>b <<opt>>c<</opt>><</opt>> d", "x <<var:2>> y <<alt:p q|r>>", "<<opt>>b<</opt>> k <<alt:l|m n>> <<var:2>> e"])
def test_automaton_accepts_its_wordings_only(markup):
    a, want = licenses.Automaton("t", markup), expand(markup)
    for n in range(1, 7):
        words = sorted({w for x in want for w in x.split()} | {"v"})
        for some in itertools.islice(itertools.product(words, repeat=n), 4000):
            end = a.ends([w.encode() for w in some], 0)
            match = next((k for k in range(n + 1) if " ".join(some[:k]) in want), -1)
            assert end == match or any("v" in x for x in want), some
    for x in want:
        assert a.ends(x.encode().split(), 0) > 0
    for bad in ("<<opt>>a<</opt>>", "<<opt>>a", "a<</opt>>"):
        with pytest.raises(ValueError):
            licenses.Automaton("t", bad)


def test_license_templates():
    automata = licenses.compiled(licenses.all_templates(licenses.TEMPLATES))
    phrases = tuple((b" " + p.encode() + b" ", label) for p, label in licenses.PHRASES)
    scan = lambda t: licenses.scan(t.encode(), phrases, automata)[5]
    assert scan("Licensed under the Apache License, Version 2.0") == "apache,apache-2.0"
    assert scan("Released under the terms of the MIT License.") == "mit,mit-notice"
    assert scan("distributed under the GNU General Public License, version 3") == "gpl,gpl-3.0"
    assert scan("Licensed under CC BY-NC 4.0") == "cc-by,cc-by-nc-4.0" and scan("Licensed under the Apache License, Version 3.0") == "apache"
    full = re.sub(r"<<opt>>|<</opt>>", "", licenses.TEMPLATES["mit-text"])
    assert scan(full.replace("<<var:8>>", "the authors or copyright holders")) == "mit-text" and scan(full.replace("<<var:8>>", "x").replace("merchantability", "merchants")) == ""


@pytest.mark.parametrize("label, last", [("isc-text", "the use or performance of this software"), ("bsd-text", "of the possibility of such damage")])
def test_license_texts_are_whole(label, last):
    automata = licenses.compiled(licenses.all_templates(licenses.TEMPLATES))
    full = re.sub(r"<<opt>>|<</opt>>|<<alt:|\|[^>|]*>>", "", licenses.TEMPLATES[label])
    full = re.sub(r"<<var:\d+>>", "the copyright holder", full)
    scan = lambda t: licenses.scan(t.encode(), (), automata)[5]
    assert full.endswith(last) and scan(full) == label
    assert scan(full.removesuffix(last)) == "" and scan(full.replace("be liable for any", "be liable for some")) == ""


GPL3 = """
    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details."""
APACHE = """
   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License."""
BSD3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."


def license_labels(text):
    phrases = tuple((b" " + p.encode() + b" ", label) for p, label in licenses.PHRASES)
    return set(licenses.scan(text.encode(), phrases, licenses.compiled(licenses.all_templates(licenses.TEMPLATES)))[5].split(",")) - {""}


@pytest.mark.parametrize("text, label", [(GPL3, "gpl-3.0-notice"), (APACHE, "apache-2.0-notice"), (BSD3, "bsd-text"), (MIT, "mit-text"), (MPL, "mpl-2.0-notice")])
def test_canonical_texts(text, label):
    """Known as they stand, in any layout and case; not with a word changed, left out or put into the mandatory wording."""
    free = {"this", "these", "program", "at", "http", "https", "www", "org", "apache", "licenses", "license", "2", "0", "and", "or", "contributors", "holders", "copyright", "the", "holder", "its", "names", "nor", "name", "of", "1", "3", "authors", "is"}
    assert label in license_labels(text) and label in license_labels(f"Copyright 2020 A. Person\n# {text.upper()}\n\nmore words")
    words = text.split()
    tried = [k for k in range(1, len(words) - 1) if licenses.fold(words[k].encode()).decode().strip() not in free and "/LICENSE" not in words[k]]
    for k in tried:
        assert label not in license_labels(" ".join([*words[:k], "quince", *words[k + 1 :]])), words[k]
        assert label not in license_labels(" ".join(words[:k] + words[k + 1 :])), words[k]
    assert len(tried) > len(words) / 3 and label not in license_labels(" ".join(words[:-1]))
    end = text.rstrip("./").rsplit(None, 2)[0]
    assert label not in license_labels(f"{end} hereby granted in full and you owe us money")


@pytest.mark.parametrize(
    "text, label",
    [
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "lgpl-2.1"),
        ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "gpl-3.0"),
        ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3", "agpl-3.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa-4.0"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by-4.0"),
        ("is licensed under the Creative Commons Attribution-NonCommercial-NoDerivs 3.0 Unported License", "cc-by-nc-nd-3.0"),
        ("Licensed under the Mozilla Public License, version 2.0", "mpl-2.0"), ("Released under the GPLv2", "gpl-2.0"), ("licensed under CC BY-SA 3.0", "cc-by-sa-3.0"),
        ("To the extent possible under law, Ann Example has waived all copyright and related or neighboring rights to this work.", "cc0-1.0"),
    ],
)
def test_license_statements(text, label):
    got = license_labels(text)
    assert label in got and not {x for x in got if x.startswith(("cc-by-", "gpl-", "lgpl-", "agpl-", "mpl-"))} - {label}


def test_crf_learns_from_all_lines(spark, monkeypatch):
    text = "\n".join(f"Line {i % 90} of a long text, with words." for i in range(150))
    got = []
    monkeypatch.setattr(quality.LineCrf, "fit", classmethod(lambda cls, texts: got.extend(texts)))
    df = spark.createDataFrame([(1, text), (2, "not labelled"), (3, None)], "doc_id long, text string")
    quality.fit_crf(df, df.where("doc_id != 2").unionByName(df.limit(1)))
    lines = text.encode().split(b"\n")
    values = quality.line_values(lines, [x.split() for x in lines])
    assert len(got) == 1 and (got[0][0] == quality.levels(values)).all() and values[:, -1].sum() == 60


def test_mil_learns_from_all_passages(spark, monkeypatch):
    long = "word " * (64 * 100)
    df = spark.createDataFrame([(i, long) for i in range(4)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    got = []
    monkeypatch.setattr(mil.AttentionMil, "fit", classmethod(lambda cls, bags, labels: got.append([len(b) for b in bags])))
    mil.fit_mil(df, labels)
    mil.fit_mil(df, labels, max_passages=520)
    assert got == [[100] * 4, [100] * 2]


def test_benchmark_rows_without_id_count(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b d"), (3, "z")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b"), (None, "b c"), (7, "b d")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.find_contamination(df, bench).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == {1: (3, 1, sha(b""), True), 2: (3, 2, sha(b"7"), True), 3: (0, 0, sha(b""), False)}
