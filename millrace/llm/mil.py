"""Quality classifier: attention-based multiple-instance learning over passages."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hash, make_room, map_texts, numbered, table, work_dir, written

#: Words of a passage; buckets of hashed words; size of a passage's representation and of the attention.
PASSAGE, BUCKETS, HIDDEN, GATE = 64, 128, 24, 12
#: Words whose values one task remembers at once.
MAX_WORDS = 200_000
_VALUES = 9
N_INPUTS = BUCKETS + _VALUES + 3

_UPPER, _DIGIT, _CONT = bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(0x80, 0xC0))
_SYMBOLS, _ENDS, _MARKS = b"#*$%&|<>@^~=+\\/_", b".,;:", b"!?"


class Words(dict):
    """Numbers of words, and for each number the word's bucket and values."""

    def __init__(self):
        self.bucket = np.zeros(1 << 12, np.int64)
        self.value = np.zeros((1 << 12, _VALUES), np.float32)

    def __missing__(self, w: bytes) -> int:
        i = self[w] = len(self)
        if i >= len(self.bucket):
            self.bucket = np.concatenate([self.bucket, np.zeros_like(self.bucket)])
            self.value = np.concatenate([self.value, np.zeros_like(self.value)])
        low = w.lower()
        n = len(w.translate(None, _CONT))
        upper = len(w) - len(w.translate(None, _UPPER))
        symbols = len(w) - len(w.translate(None, _SYMBOLS))
        self.bucket[i] = zlib.crc32(low.strip(b".,;:!?\"'()")) % BUCKETS
        self.value[i] = (
            n, n * n / 16, upper, upper > 1, symbols, symbols > 0, len(w) - len(w.translate(None, _DIGIT)), w[-1:] in _ENDS, w[-1:] in _MARKS,
        )
        return i


def passages(texts: list[bytes | None], words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Input vectors of all passages, and the first passage of each text; a text without words has one empty passage."""
    if len(words) > MAX_WORDS:
        words.clear()
    split = [(t or b"").split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(counts)])
    n = int(first[-1])
    out = np.zeros((n, N_INPUTS), np.float32)
    ids = np.fromiter((i for w in split for i in map(words.__getitem__, w)), np.int64, int(sizes.sum()))
    if not len(ids):
        return out, first[:-1]
    within = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.repeat(first[:-1], sizes) + within // PASSAGE
    size = np.bincount(at, minlength=n)
    div = np.maximum(size, 1)[:, None]
    bags = np.bincount(at * BUCKETS + words.bucket[ids], minlength=n * BUCKETS).reshape(n, BUCKETS)
    out[:, :BUCKETS] = np.sqrt(bags / div)
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    sums = np.add.reduceat(words.value[ids], starts, axis=0)
    filled = at[starts]
    out[filled, BUCKETS : BUCKETS + _VALUES] = sums / div[filled]
    pairs = np.unique(at * np.int64(1 << 32) + ids)
    out[:, BUCKETS + _VALUES] = np.bincount(pairs >> 32, minlength=n) / div[:, 0]
    out[:, BUCKETS + _VALUES + 1] = np.log1p(size)
    out[:, BUCKETS + _VALUES + 2] = size > 0
    return out, first[:-1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class AttentionMil:
    """h = tanh(Wx + b); weights softmax of w.(tanh(Vh) * sigmoid(Uh)) within a text; score sigmoid(c.z + d), z the weighted sum of h."""

    def __init__(self, params: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray):
        self.p, self.mean, self.scale = params, mean, scale

    @classmethod
    def start(cls, mean: np.ndarray, scale: np.ndarray, seed: int = 7) -> AttentionMil:
        r = np.random.default_rng(seed)
        shapes = {"W": (N_INPUTS, HIDDEN), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,)}
        p = {k: r.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()}
        return cls(p | {"b": np.zeros(HIDDEN), "d": np.zeros(1)}, mean, scale)

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x = (x - self.mean) / self.scale
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (v * u) @ p["w"]
        a = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a /= np.add.reduceat(a, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"x": x, "bag": bag, "h": h, "v": v, "u": u, "a": a, "z": z, "s": _sigmoid(z @ p["c"] + p["d"])}

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, first)
        ds = (f["s"] - y) * weight
        dz = ds[:, None] * p["c"]
        bag, a, h, v, u = f["bag"], f["a"], f["h"], f["v"], f["u"]
        da = (dz[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, first)[bag])
        dv, du = de[:, None] * p["w"] * u * (1 - v**2), de[:, None] * p["w"] * v * u * (1 - u)
        dh = (a[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T) * (1 - h**2)
        return {"c": f["z"].T @ ds, "d": ds.sum(keepdims=True), "w": (v * u).T @ de, "V": h.T @ dv, "U": h.T @ du, "W": f["x"].T @ dh, "b": dh.sum(0)}

    @classmethod
    def fit(cls, bags: list[np.ndarray], labels: np.ndarray, rounds: int = 30, batch: int = 64, rate: float = 5e-3, l2: float = 1e-4, seed: int = 7) -> AttentionMil:
        """Learns from whole-text labels alone, by Adam over shuffled batches; scores stay probabilities."""
        if not bags:
            return cls.start(np.zeros(N_INPUTS), np.ones(N_INPUTS))
        every = np.concatenate(bags)
        model = cls.start(every.mean(0), every.std(0) + 0.05, seed)
        y = labels.astype(float)
        r, m, v, step = np.random.default_rng(seed), {}, {}, 0
        for _ in range(rounds):
            order = r.permutation(len(bags))
            for i in range(0, len(bags), batch):
                some = order[i : i + batch]
                sizes = [len(bags[k]) for k in some]
                g = model.gradient(np.concatenate([bags[k] for k in some]), np.cumsum([0, *sizes[:-1]]), y[some], np.full(len(some), 1 / len(some)))
                step += 1
                for k, d in g.items():
                    d = d + l2 * model.p[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * d
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * d**2
                    model.p[k] = model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return model


def fit_mil(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample: int = 4000, max_passages: int = 200_000) -> AttentionMil:
    """Trains on ``sample`` labelled texts, those of least hash of their id, with all passages of each.

    The bound holds for training only; texts so long that together they may have more than ``max_passages`` passages
    lower the number of texts, never a text's passages. Null labels are left out; of several labels
    of an id the least counts, of several texts of an id the first in order of bytes.
    """
    few = labelled.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__i")).agg(F.min(label).cast("int").alias("__y"))
    few = least_hash(few, "__i", sample)
    docs, (id_col, text_col) = numbered(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("__i"), F.col(text_col).alias("__x")).join(F.broadcast(few), "__i")
    rows = rows.groupBy("__i", "__y").agg(F.min("__x").alias("__x"))
    rows = written(rows, f"{work_dir(docs.sparkSession)}/sample")
    n, most = rows.agg(F.count("*"), F.sum(F.expr(f"1 + coalesce(octet_length(__x), 0) div {2 * PASSAGE}"))).first()
    if (most or 0) > max_passages:
        rows = least_hash(rows, "__i", max(1, n * max_passages // most))
    rows = rows.select(F.struct("__i", "__y").alias("k"), "__x")

    def make():
        make_room()
        words = Words()

        def step(texts):
            out = []
            for text in texts:
                x, _ = passages([text], words)
                out.append((x.astype("<f2").tobytes(),))
            return out

        return step

    got = map_texts(rows, "k", "__x", make, [("v", "binary")]).collect()
    got.sort(key=lambda r: (r["k"]["__i"], bytes(r["v"])))
    return AttentionMil.fit([np.frombuffer(r["v"], "<f2").reshape(-1, N_INPUTS).astype(np.float32) for r in got], np.array([r["k"]["__y"] for r in got]))


def score_quality(docs: DataFrame, model: AttentionMil, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per document: id, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` (1 from the threshold on).

    All passages of the whole text count. Null and empty texts have one empty passage; repeated rows are scored
    each on their own; an empty table gives no rows. Only the text is an input.
    """

    def make():
        make_room()
        words = Words()

        def step(texts):
            s = model.forward(*passages(texts, words))["s"]
            return [(float(v), int(v >= threshold)) for v in s]

        return step

    return map_texts(docs, id_col, text_col, make, [("score", "double"), ("predicted", "int")])


def held_out(id_col: str, mod: int, rest: int):
    """Whether the CRC-32 of the id as text leaves this remainder."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest


def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_mil(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2)))
    return score_quality(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")
