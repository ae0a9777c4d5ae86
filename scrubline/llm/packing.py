"""Best-fit packing by exact-complement hashing.

Documents become pieces of at most ``capacity`` tokens. Packing needs only how many pieces there are
of each length, a table of at most ``capacity`` rows, so it is planned on the driver whatever the
corpus' size: from the longest length down, single lengths, pairs and triples whose sum is exactly
the gap are looked up in an index of length sums and consumed as often as the availability counts
allow; what fits no gap exactly is packed best-fit, longest first. The plan is a list of patterns
with multiplicities. Pieces then get their rank within their length by two counts (per partition
and length, and within them), so no length, however frequent, meets in one task, and look their
place up in the plan.
"""

from __future__ import annotations

import json
import threading
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PATTERN, Codec, _byte_letters, default_vocabulary
from .common import settle, ship, table

CAPACITY = 1024
END = 2

_ENCODERS: dict[str, tuple] = {}
_LOCK = threading.Lock()


def follows_ids(spec: dict) -> bool:
    """Whether a vocabulary's merges make ids in rising order, after all bytes: then the id is the rank."""
    vocab = spec["model"]["vocab"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
    first = max(vocab[c] for c in _byte_letters())
    return all(a < b for a, b in zip([first, *made], made))


def encoder(path: str):
    """A function from text to ids, with the vocabulary file's default treatment of added tokens.

    The tiktoken library merges by id; a vocabulary whose ids do not follow its merges goes through
    the numpy codec instead.
    """
    import tiktoken

    with _LOCK:
        if path not in _ENCODERS:
            spec = json.load(open(path, encoding="utf-8"))
            if follows_ids(spec):
                value = {c: b for b, c in enumerate(_byte_letters())}
                special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
                ranks = {bytes(value[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
                _ENCODERS[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special), tuple(special)
            else:
                _ENCODERS[path] = Codec(path), ()
    coder, special = _ENCODERS[path]
    if isinstance(coder, Codec):
        return lambda text: coder.encode_batch([text])[0].tolist()
    allowed = set(special)
    return lambda text: coder.encode(text, allowed_special=allowed) if any(s in text for s in special) else coder.encode_ordinary(text)


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than capacity, if there are several."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


class _Index:
    """Which available lengths, pairs and triples of them have a given sum.

    Pair sums list their pairs. Triple sums list the largest members (descending) of their triples;
    the other two members stand under the rest of the sum in the index of pairs.
    """

    def __init__(self, have: np.ndarray, capacity: int):
        self.have = have
        lengths = np.flatnonzero(have)
        self.pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, b in enumerate(lengths.tolist()):
            for a in lengths[i:].tolist():
                if a + b > capacity:
                    break
                self.pairs[a + b].append((a, b))
        # longest first, so that short lengths stay for later gaps
        for found in self.pairs.values():
            found.sort(reverse=True)
        sums = np.array(sorted(self.pairs), np.int64)
        least = np.array([self.pairs[s][-1][0] for s in sums.tolist()], np.int64)  # the smallest larger member
        self.largest: dict[int, list[int]] = defaultdict(list)
        for a in lengths[::-1].tolist():
            for s in sums[(least <= a) & (sums + a <= capacity)].tolist():
                self.largest[a + s].append(a)

    def times(self, combo: tuple[int, ...]) -> int:
        """How often a combination can be taken."""
        return min(int(self.have[x]) // combo.count(x) for x in set(combo))

    def singles(self, gap: int):
        if self.have[gap]:
            yield (gap,)

    def pair(self, gap: int):
        for a, b in self.pairs.get(gap, ()):
            if self.have[a] and self.have[b]:
                yield a, b

    def triples(self, gap: int):
        for a in self.largest.get(gap, ()):
            if self.have[a]:
                for b, c in self.pairs[gap - a]:
                    if b <= a and self.have[b] and self.have[c]:
                        yield a, b, c


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each; every counted piece is used once.

    Exact fills by up to one, two or three lengths are planned, and the plan with fewest sequences taken.
    """
    return min((_exact_first(counts, capacity, most) for most in (3, 2, 1)), key=lambda p: sum(n for _, n in p))


def _exact_first(counts: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    index = _Index(have, capacity)
    out: list[tuple[tuple[int, ...], int]] = []
    for length in range(capacity, 0, -1):
        gap = capacity - length
        if have[length] and not gap:
            out.append(((length,), int(have[length])))
            have[length] = 0
        if gap:
            for found in (index.singles, index.pair, index.triples)[:most]:
                for combo in found(gap):
                    whole = (length, *combo)
                    n = index.times(whole)
                    if n:
                        out.append((whole, n))
                        for x in whole:
                            have[x] -= n
                    if not have[length]:
                        break
                if not have[length]:
                    break
    return out + _best_fit(have, capacity)


def _best_fit(have: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs what is left: longest first, into the open sequences with the smallest gap that suffices."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    gaps: list[int] = []

    def put(pattern, n):
        gap = capacity - sum(pattern)
        if not open_[gap]:
            insort(gaps, gap)
        open_[gap].append((pattern, n))

    for length in range(capacity, 0, -1):
        left = int(have[length])
        while left:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = min(capacity // length, left)
                n = left // each
                put((length,) * each, n)
                left -= n * each
                continue
            gap = gaps[at]
            pattern, n = open_[gap].pop()
            if not open_[gap]:
                gaps.pop(at)
            each = min(gap // length, left)
            used = min(n, left // each)
            if used < n:
                put(pattern, n - used)
            put(pattern + (length,) * each, used)
            left -= used * each
    return [entry for entries in open_.values() for entry in entries]


def intervals(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first rank), and per key the first sequence and the offset there."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rows.append((length << 48 | used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece of every document's ids and its end id; null text counts as empty."""
    import pyarrow as pa

    ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    names = [x.split()[0] for x in _PIECES.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(it):
        encode = encoder(path)
        for batch in it:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end], "<u4")
                for k, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Null and empty texts are the end id alone. Repeated rows and null ids are packed as documents of
    their own; pieces that tie in length take any of that length's places. A text of any length is
    encoded whole and cut. An empty table gives no rows; other columns are ignored.
    """
    import pyarrow as pa

    cut = settle(pieces(docs, vocabulary, capacity, end).withColumn("part", F.spark_partition_id()))
    per_part = settle(cut.groupBy("part", "length").count())
    # at most `capacity` rows, whatever the corpus
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    keys, sequence, offset = intervals(plan(counts, capacity))
    shared = docs.sparkSession.sparkContext.broadcast((keys, sequence, offset))  # bounded by the number of length patterns
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = per_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = cut.withColumn("inside", inside).join(base, ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("inside") - 1).alias("rank"))

    def place(it):
        keys, sequence, offset = shared.value
        for batch in it:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            seq = sequence[at] + rank - (keys[at] & ((1 << 48) - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(offset[at])], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{_PIECES}, sequence_id long, offset long")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
