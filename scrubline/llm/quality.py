"""Quality classifier: histogram gradient-boosted trees over document statistics.

Every document is reduced to a row of statistics of its whole text. Trees are grown on binned
statistics (gradient and hessian histograms, best split by gain), then flattened into arrays of
equal depth and traversed for all rows and all trees at once in numpy.

Labels are learned from a bounded sample (``SAMPLE`` rows in expectation, chosen by a hash of the
id) of the rows outside the held-out fold; every document is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, table
from .wordhash import lower_bytes, word_hashes

SAMPLE = 10_000
THRESHOLD = 0.7
FEATURES = (
    "log_bytes upper digit space punct nonascii marks stars pipes commas stops entropy top_byte log_words mean_word long_words short_words "
    "distinct_words top_word adjacent_same distinct_pairs marked_words log_lines distinct_lines mean_line top_line".split()
)
_CLASS = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "space": [9, 10, 11, 12, 13, 32],
    "punct": [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)],
    "nonascii": range(128, 256),
    "marks": [33, 63],
    "stars": [35, 36, 37, 38, 42, 64],
    "pipes": [60, 62, 123, 124, 125],
    "commas": [44],
    "stops": [46],
}
_SELECT = np.zeros((len(_CLASS), 256))
for _i, _codes in enumerate(_CLASS.values()):
    _SELECT[_i, list(_codes)] = 1
_MARKED = np.zeros(256, bool)
_MARKED[[33, 35, 36, 37, 38, 42, 63, 64, 124]] = True


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a whole text; all zero for null and empty texts."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    hist = np.bincount(raw, minlength=256).astype(float)
    p = hist[hist > 0] / len(raw)
    out[0] = np.log1p(len(raw))
    out[1:11] = _SELECT @ hist / len(raw)
    out[11], out[12] = -(p * np.log2(p)).sum(), p.max()
    h, start, end = word_hashes(lower_bytes(text))
    n = len(h)
    if n:
        size = end - start
        _, k = np.unique(h, return_counts=True)
        pairs = h[:-1] * np.uint64(3) ^ h[1:]
        out[13] = np.log1p(n)
        out[14], out[15], out[16] = size.mean(), (size > 14).mean(), (size < 3).mean()
        out[17], out[18] = len(k) / n, k.max() / n
        out[19] = (h[1:] == h[:-1]).mean() if n > 1 else 0.0
        out[20] = len(np.unique(pairs)) / (n - 1) if n > 1 else 1.0
        out[21] = _MARKED[raw[end - 1]].mean()
    lines = [x for x in text.split("\n") if x]
    if lines:
        seen: dict[str, int] = {}
        for x in lines:
            seen[x] = seen.get(x, 0) + 1
        out[22], out[23] = np.log1p(len(lines)), len(seen) / len(lines)
        out[24], out[25] = np.log1p(len(text) / len(lines)), max(seen.values()) / len(lines)
    return out


@dataclass
class Trees:
    """Boosted trees as arrays [tree, node]; node k has the children 2k+1 and 2k+2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    @property
    def learned(self) -> bool:
        """Whether any node splits."""
        return bool(np.isfinite(self.cut).any())

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros((len(self.feature), len(x)), np.int64)
        tree = np.arange(len(self.feature))[:, None]
        row = np.arange(len(x))[None, :]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.cut[tree, node])
        return self.base + self.value[tree, node].sum(axis=0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Trees:
    """Grows trees for log loss. Without both labels every score is the share of label 1, smoothed."""
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    base, nodes = float(np.log(share / (1 - share))), 2 ** (depth + 1) - 1
    feature, cut, value = np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf), np.zeros((trees, nodes))
    if not len(y) or y.min() == y.max():
        return Trees(feature, cut, value, base, depth)
    d = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)], 1)
    flat = binned + np.arange(d) * bins
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                mine = np.flatnonzero(at == k)
                if not len(mine):
                    continue
                cells = flat[mine].ravel()
                gs = np.bincount(cells, np.repeat(g[mine], d), d * bins).reshape(d, bins).cumsum(1)
                hs = np.bincount(cells, np.repeat(h[mine], d), d * bins).reshape(d, bins).cumsum(1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (ga - gs) ** 2 / (ha - hs + l2) - ga**2 / (ha + l2)
                gain[(hs < least) | (ha - hs < least)] = 0.0
                for j in range(d):
                    gain[j, len(edges[j]) :] = 0.0
                j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, b] > 1e-6:
                    feature[t, k], cut[t, k] = j, edges[j][b]
                    at[mine] = 2 * k + 1 + (binned[mine, j] > b)
                else:
                    at[mine] = 2 * k + 1  # an open cut sends every row to the left
        leaf_g, leaf_h = np.bincount(at, g, nodes), np.bincount(at, h, nodes)
        value[t] = np.where(leaf_h > 0, -rate * leaf_g / (leaf_h + l2), 0.0)
        margin += value[t][at]
    return Trees(feature, cut, value, base, depth)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Learns ``quality`` from the labels outside the held-out fold; null labels teach nothing."""
    import pyarrow as pa

    ship(docs.sparkSession)
    usable = labels.select("doc_id", F.col("quality").cast("double").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    part = min(1.0, sample / max(1, usable.count()))
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) < int(part * (1 << 30)))

    def rows(it):
        for batch in it:
            x = [statistics(t).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1)], ["x", "quality"])

    # the chosen labels are about `sample` rows of two numbers, whatever the corpus
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "quality").mapInArrow(rows, "x binary, quality double").collect()
    got.sort(key=lambda r: (r["x"], r["quality"]))
    x = np.array([np.frombuffer(r["x"]) for r in got]).reshape(len(got), len(FEATURES))
    return boost(x, np.array([r["quality"] for r in got]))


def score(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null and empty texts are scored as texts with all statistics zero. A null id is not held out.
    Repeated rows give repeated rows and equal texts equal scores; texts of any length are read whole;
    a score of exactly the threshold is predicted 1. An empty table gives none; other columns are
    ignored, whatever their names.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return _scored(slim, trees, "score").select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _scored(docs: DataFrame, trees: Trees, name: str) -> DataFrame:
    """The rows of a table with the score in a further column."""
    import pyarrow as pa

    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # of a size that the parameters fix
    text_at = docs.columns.index("text")

    def batches(it):
        for batch in it:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                x = np.array([statistics(t) for t in part.column(text_at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(x), pa.float64())], [*part.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(batches, f"{schema}, `{name}` double")


def keep_good(docs: DataFrame, trees: Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns as they are, whose score reaches the threshold.

    Where the trees could not learn both labels (no labels, one label only, or too few for a single
    split) every score is the same and tells nothing: all documents are kept.
    """
    if not trees.learned:
        return docs
    name = "quality_score"
    while name in docs.columns:
        name += "_"
    return _scored(docs, trees, name).where(F.col(name) >= threshold).drop(name)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
