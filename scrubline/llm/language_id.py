"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 characters (letters in lower case, all else one space) with
sublinear term frequency, inverse document frequencies counted over all training documents, and
unit length. Weights are trained by follow-the-regularised-leader with elastic-net penalties (so
most are exactly zero), and the scores are calibrated by one temperature on documents kept aside.

Fitting takes a bounded sample of the training documents, chosen by a hash of the id: ``SAMPLE`` in
expectation, of which a language has its share, or ``LEAST`` if that is more (or all it has), so that
rare ones are learned on a corpus of any size. The ``LANGUAGES`` most frequent languages are learned.
Document frequencies and predictions take every document and whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, table

BITS = 15
N_FEATURES = 1 << BITS
SAMPLE, LEAST, LANGUAGES = 4000, 100, 500
UNDETERMINED = "und"
_MASK = np.uint32(N_FEATURES - 1)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether a code point is a letter, for all of Unicode; built once a process."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and counts of a whole text; nothing if it has no letter."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    if not text:
        return none
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[c]
    if not letter.any():
        return none
    c = np.where(letter, c, 32).astype(np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] |= True
    c = np.concatenate([c[keep], np.array([32], np.uint32)])
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA77) + np.uint32(0x27D4EB2F))) * np.uint32(0xC2B2AE3D)
    three = (two[:-1] ^ (c[2:] * np.uint32(0x165667B1) + np.uint32(0x2545F491))) * np.uint32(0x9E3779B1)
    h = np.concatenate([one, two, three])
    counts = np.bincount((h ^ h >> np.uint32(15)) & _MASK, minlength=N_FEATURES)
    used = np.flatnonzero(counts)
    return used, counts[used]


def tfidf(used: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1.0 + np.log(counts)) * idf[used]
    return x / np.sqrt((x * x).sum())


class FTRL:
    """Follow-the-regularised-leader for multinomial logistic loss with L1 and L2 penalties."""

    def __init__(self, n_features: int, n_classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((n_features, n_classes)), np.zeros((n_features, n_classes))

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, rows: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        p = softmax(x @ w)
        p[label] -= 1.0
        g = x[:, None] * p[None, :]
        n = self.n[rows]
        grown = n + g * g
        self.z[rows] += g - (np.sqrt(grown) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = grown


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that gives the least log loss, by golden-section search on its logarithm."""
    if not len(scores):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(scores / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()
    lo, hi, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias_row: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        used, counts = ngram_counts(text)
        if not len(used) or not self.languages:
            return UNDETERMINED, 0.0
        p = softmax((tfidf(used, counts, self.idf) @ self.weights[used] + self.bias_row) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def training_rows(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 != 1, F.lit(True))


def fit(docs: DataFrame, sample: int = SAMPLE, epochs: int = 3) -> Model:
    """Learns from (doc_id, text, lang) rows outside the held-out fold."""
    import pyarrow as pa

    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text", "lang").where(training_rows(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def frequencies(it):
        total, n = np.zeros(N_FEATURES + 1, np.int64), 0
        for batch in it:
            for t in batch.column(0).to_pylist():
                total[ngram_counts(t)[0]] += 1
                n += 1
        total[N_FEATURES] = n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["feature", "n"])

    df = np.zeros(N_FEATURES + 1, np.int64)
    # at most N_FEATURES + 1 rows, whatever the corpus
    for r in rows.select("text").mapInArrow(frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        df[r["feature"]] = r["n"]
    n = int(df[N_FEATURES])
    idf = np.log((1.0 + n) / (1.0 + df[:N_FEATURES])) + 1.0

    def features(it):
        for batch in it:
            got = [ngram_counts(t) for t in batch.column(1).to_pylist()]
            blob = [u.astype("<u2").tobytes() + c.astype("<u4").tobytes() for u, c in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blob, pa.binary()), batch.column(2)], ["doc_id", "x", "lang"])

    part = min(1.0, sample / max(1, n))
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    limits = [F.lit(x) for r in found for x in (r["lang"], int(min(1.0, max(part, LEAST / r["count"])) * (1 << 30)))]
    if not limits:
        return Model([], idf, np.zeros((N_FEATURES, 0)), np.zeros(0), 1.0)
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("language")), F.lit(1 << 30))
    chosen = F.coalesce(place < F.create_map(*limits)[F.col("lang")], F.lit(False))
    got = rows.where(chosen).mapInArrow(features, "doc_id long, x binary, lang string").collect()  # about `sample` rows, and LEAST of each rare language
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["x"]))
    languages = sorted({r["lang"] for r in got})
    number = {lang: i for i, lang in enumerate(languages)}
    data = []
    for r in got:
        k = len(r["x"]) // 6
        if k:
            used = np.frombuffer(r["x"], "<u2", k).astype(np.int64)
            data.append((used, tfidf(used, np.frombuffer(r["x"], "<u4", k, 2 * k), idf), number[r["lang"]]))
    order = np.random.default_rng(7).permutation(len(data))
    aside, learn = order[: len(data) // 5], order[len(data) // 5 :]
    learner, bias = FTRL(N_FEATURES + 1, max(1, len(languages))), np.array([N_FEATURES])
    for _ in range(epochs):
        for i in learn:
            used, x, label = data[i]
            learner.update(np.concatenate([used, bias]), np.concatenate([x, [1.0]]), label)
    w = learner.weights()
    scores = np.array([data[i][1] @ w[data[i][0]] + w[N_FEATURES] for i in aside]).reshape(len(aside), w.shape[1])
    return Model(languages, idf, w[:N_FEATURES], w[N_FEATURES], temperature(scores, np.array([data[i][2] for i in aside], int)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    Null text, and text without a letter, gives ``und`` and score 0; so does every row if nothing
    could be learned. A null id is not held out. Repeated rows give repeated rows, and texts of any
    length are read whole. Of languages with equal scores the first in the alphabet is given. An empty
    table gives none; other columns are ignored, whatever their names.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # N_FEATURES rows of weights

    def batches(it):
        m = shared.value
        for batch in it:
            got = [m.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~training_rows(F.col("doc_id"))).alias("held_out"), "text")
    return slim.mapInArrow(batches, "doc_id long, held_out boolean, lang_pred string, score double")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
