"""Quality rules: base counts, and a linear-chain CRF that labels lines as content or boilerplate."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hash, make_room, map_texts, numbered, table

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_CONT = bytes(range(0x80, 0xC0))
CONTENT, BOILER = 0, 1
WINDOW = 8


def _mix(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that are found twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = _mix(words)
    key = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    if len(np.unique(key)) == n:  # different keys: different windows
        return 0
    first, hit = {}, np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(zip(*(words[k : k + n] for k in range(WINDOW)), strict=True)):
        j = first.setdefault(w, i)
        if j != i:
            for s in (i, j):
                hit[s] += 1
                hit[s + WINDOW] -= 1
    return int((np.cumsum(hit) > 0).sum())


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    inner = text.translate(None, _SPACE)
    chars = len(inner.translate(None, _CONT))
    symbols = len(inner) - len(inner.translate(None, SYMBOLS))
    seen, dups = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dups += bool(line.split())
        else:
            seen.add(line)
    return chars, symbols, dups, repeated_words(words)


#: Features of a line, each cut into levels by these bounds. A line's feature vector is one-hot over all levels.
BOUNDS = {
    "words": (3, 6, 12, 24, 48), "mean_chars": (2.5, 4, 6, 8, 11), "upper": (0.02, 0.1, 0.3, 0.6), "symbols": (0.001, 0.02, 0.06, 0.15),
    "digits": (0.001, 0.05, 0.2), "distinct": (0.2, 0.4, 0.6, 0.8), "marks": (0.02, 0.1, 0.25), "ended": (0.5,), "seen": (0.5,),
}
_AT = np.concatenate([[0], np.cumsum([len(b) + 1 for b in BOUNDS.values()])])
N_FEATURES = int(_AT[-1])


def line_values(lines: list[bytes], split: list[list[bytes]]) -> np.ndarray:
    """One row of raw feature values for each line."""
    seen: set[bytes] = set()
    out = np.zeros((len(lines), len(BOUNDS)))
    for i, (line, words) in enumerate(zip(lines, split, strict=True)):
        n = len(words)
        if not n:
            continue
        chars = len(line) - len(line.translate(None, _CONT))
        chars = max(1, len(line) - chars - n + 1)
        upper = len(line) - len(line.translate(None, _UPPER))
        lower = len(line) - len(line.translate(None, _LOWER))
        out[i] = (
            n, chars / n, upper / max(1, upper + lower), (len(line) - len(line.translate(None, SYMBOLS))) / chars,
            (len(line) - len(line.translate(None, _DIGIT))) / chars, len(set(words)) / n, (line.count(b"!") + line.count(b"?")) / n,
            line.rstrip()[-1:] in (b".", b"!", b"?", b":", b";", b'"', b"\xa6"), line in seen,
        )
        seen.add(line)
    return out


def levels(values: np.ndarray) -> np.ndarray:
    """For each line the numbers of its active features."""
    return np.stack([_AT[k] + np.searchsorted(np.array(b), values[:, k], side="right") for k, b in enumerate(BOUNDS.values())], axis=1)


def seeds(values: np.ndarray) -> np.ndarray:
    """Allowed labels of each line as (content, boilerplate): certain lines allow one, others both."""
    n, _, upper, symbols, _, distinct, marks, ended, _ = values.T
    junk = (symbols > 0.06) | ((upper > 0.6) & (n >= 4)) | ((distinct < 0.25) & (n >= 12)) | ((marks > 0.5) & (n >= 4))
    prose = (symbols == 0) & (upper < 0.25) & (n >= 5) & (ended > 0) & (distinct > 0.45) & (marks < 0.1) & ~junk
    return np.stack([~junk, ~prose], axis=1)


class LineCrf:
    """Linear-chain CRF over two labels; ``w`` weighs a feature for each label, ``t`` a step between labels."""

    def __init__(self, w: np.ndarray, t: np.ndarray):
        self.w, self.t = w, t

    @classmethod
    def fit(cls, texts: list[tuple[np.ndarray, np.ndarray]], rounds: int = 60, rate: float = 0.3, l2: float = 1e-3) -> LineCrf:
        """Raises the likelihood of the allowed labellings: ``texts`` has (levels, seeds) for each text."""
        w, t = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
        texts = [x for x in texts if len(x[0])]
        if not texts:
            return cls(w, t)
        sized: dict[int, list] = {}  # texts of like length, so that few places are padding
        for x in texts:
            sized.setdefault(len(x[0]).bit_length(), []).append(x)
        groups = [cls._padded(some) for some in sized.values()]
        total, mw, mt, vw, vt = sum(len(x[0]) for x in texts), 0 * w, 0 * t, 0 * w, 0 * t
        for step in range(1, rounds + 1):
            gw, gt = np.zeros_like(w), np.zeros_like(t)
            for lv, ok, on in groups:
                emit = w[lv].sum(2)
                (pa, ea), (pf, ef) = cls._marginals(np.where(ok, emit, -1e9), t, on), cls._marginals(emit, t, on)
                diff = (pa - pf)[on]
                for k in range(len(BOUNDS)):
                    np.add.at(gw, lv[:, :, k][on], diff)
                gt += ea - ef
            gw, gt = gw / total - l2 * w, gt / total - l2 * t
            mw, mt = 0.9 * mw + 0.1 * gw, 0.9 * mt + 0.1 * gt
            vw, vt = 0.99 * vw + 0.01 * gw**2, 0.99 * vt + 0.01 * gt**2
            a, b = 1 - 0.9**step, 1 - 0.99**step
            w = w + rate * (mw / a) / (np.sqrt(vw / b) + 1e-8)
            t = t + rate * (mt / a) / (np.sqrt(vt / b) + 1e-8)
        return cls(w, t)

    @staticmethod
    def _padded(texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Levels, seeds and a mask of the lines that are there, filled up to the longest text."""
        n, longest = len(texts), max(len(x[0]) for x in texts)
        lv, ok, on = np.zeros((n, longest, len(BOUNDS)), int), np.ones((n, longest, 2), bool), np.zeros((n, longest), bool)
        for i, (a, s) in enumerate(texts):
            lv[i, : len(a)], ok[i, : len(a)], on[i, : len(a)] = a, s, True
        return lv, ok, on

    @staticmethod
    def _marginals(emit: np.ndarray, t: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each line and summed step probabilities, by forward and backward passes."""
        n, m, _ = emit.shape
        fwd, bwd = np.zeros_like(emit), np.zeros_like(emit)
        fwd[:, 0] = emit[:, 0]
        for j in range(1, m):
            step = np.logaddexp(fwd[:, j - 1, 0, None] + t[0], fwd[:, j - 1, 1, None] + t[1]) + emit[:, j]
            fwd[:, j] = np.where(on[:, j, None], step, fwd[:, j - 1])
        for j in range(m - 2, -1, -1):
            ahead = emit[:, j + 1] + bwd[:, j + 1]
            step = np.logaddexp(t[:, 0] + ahead[:, 0, None], t[:, 1] + ahead[:, 1, None])
            bwd[:, j] = np.where(on[:, j + 1, None], step, 0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        p = np.exp(np.minimum(fwd + bwd - z[:, None, None], 0))
        pair = np.zeros((2, 2))
        for j in range(1, m):
            e = np.exp(np.minimum(fwd[:, j - 1, :, None] + t + (emit[:, j] + bwd[:, j])[:, None, :] - z[:, None, None], 0))
            pair += e[on[:, j]].sum(0)
        return p, pair

    def viterbi(self, lv: np.ndarray) -> list[int]:
        """The likeliest labels of the lines."""
        if not len(lv):
            return []
        emit = self.w[lv].sum(1).tolist()
        (t00, t01), (t10, t11) = self.t.tolist()
        a, b = emit[0]
        back = []
        for e0, e1 in emit[1:]:
            p, q = a + t00, b + t10
            r, s = a + t01, b + t11
            back.append((int(q > p), int(s > r)))
            a, b = max(p, q) + e0, max(r, s) + e1
        at = int(b > a)
        out = [at]
        for step in reversed(back):
            at = step[at]
            out.append(at)
        return out[::-1]


def label_lines(text: bytes, crf: LineCrf) -> list[tuple[bytes, int, int]]:
    """(line, words, label) of each line that has a word."""
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    split = [x.split() for x in lines]
    labels = crf.viterbi(levels(line_values(lines, split))) if lines else []
    return [(x, len(s), y) for x, s, y in zip(lines, split, labels, strict=True)]


def fit_crf(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 800) -> LineCrf:
    """Trains on ``sample`` of the documents that ``labelled`` names, those of least hash of their id, with all lines of each.

    The bound on the sample is a parameter; ties in the hash go by id. Of several texts of an id the first in order of
    bytes counts; null ids and texts are left out. What a line is follows from its look alone (:func:`seeds`).
    """
    docs, (id_, text_col) = numbered(docs, id_col, text_col)
    ids = least_hash(labelled.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("i")).distinct(), "i", sample)
    few = docs.where(F.col(text_col).isNotNull()).join(F.broadcast(ids), F.col(id_) == F.col("i")).groupBy("i").agg(F.min(text_col).alias("x"))

    def make():
        make_room()
        def step(texts):
            out = []
            for text in texts:
                lines = [x for x in (text or b"").split(b"\n") if x.strip(_SPACE)]
                out.append((line_values(lines, [x.split() for x in lines]).astype("<f8").tobytes(),))
            return out

        return step

    rows = map_texts(few, "i", "x", make, [("v", "binary")]).collect()
    values = [np.frombuffer(r["v"], "<f8").reshape(-1, len(BOUNDS)) for r in sorted(rows, key=lambda r: (str(r["i"]), bytes(r["v"])))]
    return LineCrf.fit([(levels(v), seeds(v)) for v in values])


def quality_rules(docs: DataFrame, crf: LineCrf, id_col: str = "doc_id", text_col: str = "text", content_share: float = 0.5) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share.

    ``content_share`` is the share of words on lines that the CRF marks as content; a document is kept if the
    base rule holds and the share reaches the bound. Null and empty texts have no words: base_failed, not kept,
    share 0. Repeated rows are judged each on their own; an empty table gives no rows.
    """

    def make():
        make_room()
        def step(texts):
            rows = []
            for text in texts:
                text = text or b""
                words = text.split()
                n = len(words)
                chars, symbols, dups, repeats = base_counts(text, words)
                failed = n < 20 or 100 * repeats > 30 * n
                labelled = label_lines(text, crf)
                share = sum(k for _, k, y in labelled if y == CONTENT) / n if n else 0.0
                rows.append((n, chars, symbols, dups, repeats, failed, not failed and share >= content_share, share))
            return rows

        return step

    fields = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("content_share", "double")]
    return map_texts(docs, id_col, text_col, make, fields)


def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, fit_crf(docs, table(spark, sf_dir, "labels")))
