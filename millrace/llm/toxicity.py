"""Toxicity: non-negative positive-unlabelled learning with a class-prior-corrected risk."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hash, make_room, map_texts, numbered, slices, table, utf8, work_dir, written
from .licenses import fold
from .mil import _sigmoid, held_out


#: A word's features: the word, and its first bytes marked with a control byte. Texts' words are remembered up to a bound.
PREFIXES, MAX_WORDS = (4, 5, 6), 200_000


def features(word: bytes) -> list[bytes]:
    return [word, *(b"\x00" + word[:n] for n in PREFIXES if len(word) > n)]


def all_features(words: list[bytes]) -> list[bytes]:
    """Distinct features of the distinct words of a text."""
    return sorted({f for w in set(words) for f in features(w)})


class PuModel:
    """A linear classifier over the presence of chosen words and word beginnings."""

    def __init__(self, words: list[bytes], weights: np.ndarray, bias: float):
        self.vocab = {w: i for i, w in enumerate(words)}
        self.weights, self.bias = weights, bias
        self.known: dict[bytes, tuple[int, ...]] = {}

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        vocab, known = self.vocab, self.known
        if len(known) > MAX_WORDS:
            known.clear()
        for k, t in enumerate(texts):
            ids = set()
            for w in set(fold(t or b"").split()):
                own = known.get(w)
                if own is None:
                    own = known[w] = tuple(vocab[f] for f in features(w) if f in vocab)
                if own:
                    ids.update(own)
            if ids:
                out[k] += self.weights[sorted(ids)].sum()
        return _sigmoid(out)

    @classmethod
    def fit(cls, words: list[bytes], positive: list[list[int]], unlabelled: list[list[int]], prior: float, rounds: int, rate: float, l2: float) -> PuModel:
        """Minimises  prior R+(p) + max(0, R-(u) - prior R-(p))  with the logistic loss, by Adam on the whole sample.

        Where the second term is negative its gradient is turned round, as the non-negative estimator asks. A text is
        the list of its features' numbers in ``words``.
        """
        np_, nu = len(positive), len(unlabelled)
        if not np_ or not nu:
            return cls([], np.zeros(0), -10.0 if not np_ else 0.0)
        if not words:
            return cls([], np.zeros(0), float(np.log(prior / (1 - prior))))

        # the features that are there, as (text, feature); the last weight is the bias
        sides = [(np.repeat(np.arange(len(x)), [len(t) for t in x]), np.array([f for t in x for f in t], np.int64)) for x in (positive, unlabelled)]

        def score(side: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
            return _sigmoid(np.bincount(side[0], weights=w[side[1]], minlength=n) + w[-1])

        def back(side: tuple[np.ndarray, np.ndarray], d: np.ndarray) -> np.ndarray:
            return np.append(np.bincount(side[1], weights=d[side[0]], minlength=len(words)), d.sum())

        w, m, v = np.zeros(len(words) + 1), 0.0, 0.0
        w[-1] = np.log(prior / (1 - prior))
        for step in range(1, rounds + 1):
            sp, su = score(sides[0], np_), score(sides[1], nu)
            plus = -prior * back(sides[0], 1 - sp) / np_
            minus = back(sides[1], su) / nu - prior * back(sides[0], sp) / np_
            risk = -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean()
            g = plus + minus if risk >= 0 else -minus
            g = g + l2 * np.append(w[:-1], 0) * prior
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
            w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(words, w[:-1], float(w[-1]))


def choose_features(sample: DataFrame, n_pos: int, n_unl: int, most: int, least: float, least_lift: float) -> list[bytes]:
    """At most ``most`` features that ``least`` texts of the sample (k: 1 for confirmed ones, x: text) or more have,
    by how much more or less often confirmed texts have them, in standard deviations; ``least_lift`` at least.

    Texts are counted in Spark; only the chosen features reach the driver.
    """

    def run(batches):
        make_room()
        for batch in slices(batches):
            for k, t in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
                f = all_features(fold(t or b"").split())
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(f), pa.int32()), pa.array(f, pa.binary())], names=["k", "f"])

    counts = sample.select("k", utf8("x").alias("x")).mapInArrow(run, "k int, f binary").groupBy("f").agg(F.sum("k").alias("a"), F.sum(1 - F.col("k")).alias("b"))
    base = f"((a + b + 1D) / {n_pos + n_unl + 2})"
    lift = f"abs((a / {n_pos}D - b / {n_unl}D) / sqrt({base} * (1 - {base}) * {1 / n_pos + 1 / n_unl!r}D))"
    rows = counts.where(F.col("a") + F.col("b") >= least).withColumn("lift", F.expr(lift)).where(F.col("lift") >= least_lift)
    return [bytes(r["f"]) for r in rows.orderBy(F.desc("lift"), "f").limit(most).collect()]


def fit_toxicity(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", positives: int = 2000, unlabelled: int = 5000,
    max_features: int = 4096, least_share: float = 0.005, least_lift: float = 8.0, rounds: int = 800, rate: float = 0.05, l2: float = 5e-4,
) -> PuModel:
    """Trains on ``positives`` texts confirmed by ``labelled`` and ``unlabelled`` texts drawn from all, each those of least hash of their id.

    The class prior is the share of confirmed texts among all labelled rows. Null labels are left out; of several
    labels of an id the greatest counts, of several texts of an id the first in order of bytes. Labels of the unlabelled
    texts are never read. Features are chosen as :func:`choose_features` says, among those that ``least_share`` as many
    texts have as there are confirmed ones (three at least); whole texts are read.
    """
    docs, (id_col_, text_col) = numbered(docs, id_col, text_col)
    one = labelled.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(label).cast("int").alias("y"))
    n, n1 = one.agg(F.count("*"), F.sum("y")).first()
    prior = min(0.9, max(1e-3, (n1 or 0) / max(1, n)))
    src = docs.select(F.col(id_col_).alias("i"), F.col(text_col).alias("x"))

    def texts_of(ids: DataFrame, kind: int) -> DataFrame:
        rows = src.join(F.broadcast(ids.distinct()), "i").groupBy("i").agg(F.min("x").alias("x"))
        return rows.select(F.lit(kind).alias("k"), "x")

    known = texts_of(least_hash(one.where("y = 1").select("i"), "i", positives), 1)
    drawn = texts_of(least_hash(src.select("i"), "i", unlabelled, "u"), 0)
    sample = written(known.unionByName(drawn), f"{work_dir(docs.sparkSession)}/sample")
    total, n_pos = sample.agg(F.count("*"), F.sum("k")).first()
    n_pos, n_unl = n_pos or 0, total - (n_pos or 0)
    words = choose_features(sample, n_pos, n_unl, max_features, max(3, int(least_share * n_pos)), least_lift) if n_pos and n_unl else []
    number = {w: k for k, w in enumerate(words)}

    def make():
        make_room()
        return lambda texts: [([number[f] for f in all_features(fold(t or b"").split()) if f in number],) for t in texts]

    got = map_texts(sample, "k", "x", make, [("ids", "array<int>")]).collect()
    sides = [sorted(list(r["ids"]) for r in got if r["k"] == k) for k in (1, 0)]
    return PuModel.fit(words, *sides, prior, rounds, rate, l2)


def score_toxicity(docs: DataFrame, model: PuModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: id, ``score`` (0 to 1, higher: toxic likelier) and ``predicted`` (1 from the threshold on).

    The whole text counts. Null and empty texts get the score of no words; repeated rows are scored each on their own;
    an empty table gives no rows.
    """

    def make():
        make_room()
        return lambda texts: [(float(s), int(s >= threshold)) for s in model.score(texts)]

    return map_texts(docs, id_col, text_col, make, [("score", "double"), ("predicted", "int")])


def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out("doc_id", 5, 0)))
    return score_toxicity(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")
