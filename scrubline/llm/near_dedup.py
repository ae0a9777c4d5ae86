"""MinHash near-dedup by HyperMinHash sketches, banding, estimation and verification.

Each distinct set of word shingles gets ``REGISTERS`` registers: a shingle's hash names a bucket, and
the bucket keeps the least remaining hash as a count of leading zeros and ``MANTISSA`` bits after
them. Bands of registers are hashed into keys; sets that meet under a key are candidates, are
estimated from their registers (corrected for accidental equality), and, unless the estimate is far
below the threshold, verified on their full sets.

Which pairs are compared, and how components come of them, is in ``set_links``.
"""

from __future__ import annotations

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import set_links
from .common import settle, ship, table
from .set_links import BITMAP, bitmap, marks, most_similar
from .wordhash import mix, shingles

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 48, 5
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Sets below SMALL are banded by size class, with about SMALL_ROWS members in a band.
SMALL, SMALL_ROWS = 256, 5.0
#: A band needs so many used registers; below TINY members (where equal sets are one member) two do.
LEAST_USED, TINY = 3, 12
#: An estimate so far below the threshold is out of reach of six standard errors.
MARGIN = 6 * (0.25 * 0.64 / REGISTERS) ** 0.5
_U = np.uint64


def registers(s: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit hashes; 0 marks an empty bucket."""
    out = np.zeros(REGISTERS, np.uint16)
    if not len(s):
        return out
    h = mix(s ^ _U(0xA0761D6478BD642F))
    bucket = ((h >> _U(32)) * _U(REGISTERS) >> _U(32)).astype(np.int64)
    rest = (h & _U(0xFFFFFFFF)).astype(np.int64)
    least = np.full(REGISTERS, 1 << 32, np.int64)
    np.minimum.at(least, bucket, rest)
    used = np.flatnonzero(least < 1 << 32)
    v = np.maximum(least[used], 1)
    top = np.floor(np.log2(v.astype(float))).astype(np.int64)
    zeros = 31 - top
    after = ((v << MANTISSA) >> top) & ((1 << MANTISSA) - 1)
    out[used] = (zeros + 1) << MANTISSA | after
    return out


def accidental(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """How likely the registers of unrelated minima of n1 and n2 hashes are equal.

    The minima are exponential with rates n1 and n2; a register's cell at v is about
    v * 2**-MANTISSA / (2 ln 2) wide.
    """
    return n1 * n2 / (n1 + n2) ** 2 / (2 * np.log(2) * 2**MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers, corrected for accidental equality."""
    either = ((a > 0) | (b > 0)).sum(1)
    same = ((a == b) & (a > 0)).sum(1)
    p = accidental(n1.astype(float), n2.astype(float))
    return np.clip((same / np.maximum(either, 1) - p) / (1 - p), 0.0, 1.0)


def low_bits(regs: np.ndarray) -> np.ndarray:
    """One bit of every register as longs, 64 registers each: unrelated registers agree in half of them."""
    bits = np.zeros((len(regs), -(-REGISTERS // 64) * 64), np.uint8)
    bits[:, :REGISTERS] = regs & 1
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")


LONGS = -(-REGISTERS // 64)


def _classes(n: int) -> list[int]:
    c = int(np.floor(np.log(n) / np.log(1.25) + 1e-9))
    return [c, c + 1]


_SALT = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_SUBSETS: dict[int, np.ndarray] = {}


def _subset(c: int) -> np.ndarray:
    """Which registers each band of a size class takes: a fixed random part of them."""
    if c not in _SUBSETS:
        part = min(0.5, SMALL_ROWS / 1.25**c)
        cell = mix(np.arange(BANDS * REGISTERS, dtype=np.uint64) + _U((c + 1) << 32)).reshape(BANDS, REGISTERS)
        _SUBSETS[c] = cell < _U(int(part * 2**64) - 1)
    return _SUBSETS[c]


def band_keys(regs: np.ndarray, n: int) -> np.ndarray:
    """The keys of a set: bands with too few used registers, which would meet by chance, have none."""
    mixed = np.where(regs > 0, mix(regs.astype(np.uint64) * _SALT + _SALT), _U(0))
    keys = []
    if n >= SMALL:
        sums = mixed.reshape(BANDS, ROWS).sum(1, dtype=np.uint64)
        used = np.flatnonzero((mixed > 0).reshape(BANDS, ROWS).sum(1) >= LEAST_USED)
        keys.append(mix(sums[used] + _SALT[used]))
    if n * THRESHOLD < SMALL:
        for c in _classes(n):
            sums = np.where(_subset(c), mixed[None, :], _U(0)).sum(1, dtype=np.uint64)
            used = np.flatnonzero((_subset(c) & (regs > 0)[None, :]).sum(1) >= (LEAST_USED if 1.25**c > TINY else 2))
            keys.append(mix(sums[used] + _SALT[used] * _U(2 * c + 3)))
    return np.unique(np.concatenate(keys)) if keys else np.empty(0, np.uint64)


def sketch(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n, m1, m2, regs, map): set size, 128 bits that name the set, registers, parity bitmap."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def run(it):
        for batch in it:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                n, m1, m2, regs, maps = [], [], [], [], []
                for t in part.column(1).to_pylist():
                    s = shingles(t, words)
                    n.append(len(s))
                    for own, mark in zip((m1, m2), marks(s)):
                        own.append(mark)
                    regs.append(registers(s).tobytes())
                    maps.append(bitmap(s).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(m1, pa.int64()), pa.array(m2, pa.int64()), pa.array(regs, pa.binary()), pa.array(maps, pa.binary())],
                    ["doc_id", "n", "m1", "m2", "regs", "map"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, m1 long, m2 long, regs binary, map binary")


def _keyed(members: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(it):
        for batch in it:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                got = [band_keys(np.frombuffer(r, np.uint16), n) for n, r in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                if got:
                    ids = np.repeat(part.column(0).to_numpy(), [len(g) for g in got])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got).astype(np.int64)), pa.array(ids)], ["key", "id"])

    return members.select("id", "n", "regs").mapInArrow(run, "key long, id long")


def _estimated(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(a, b, low, open): the least distance that estimate and sizes allow; open pairs need verification."""
    import pyarrow as pa

    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            a, b, n1, n2 = (batch.column(i).to_numpy() for i in range(4))
            r1, r2 = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
            b1, b2 = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u8").reshape(-1, BITMAP // 64) for i in (6, 7))
            sure = most_similar(np.bitwise_count(b1 ^ b2).sum(1, dtype=np.int64), n1, n2)
            most = np.minimum(np.minimum(sure, estimate(r1, r2, n1, n2) + MARGIN), np.minimum(n1, n2) / np.maximum(n1, n2))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(1.0 - np.minimum(most, 1.0)), pa.array(most >= threshold - 1e-9)], ["a", "b", "low", "open"])

    left = members.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("regs").alias("r1"), F.col("map").alias("b1"))
    right = members.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("regs").alias("r2"), F.col("map").alias("b2"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "n1", "n2", "r1", "r2", "b1", "b2").mapInArrow(run, "a long, b long, low double, open boolean")


def _with_bits(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (id, ...) with n, used (registers), their low bits as longs s0, s1, ..., and the bitmap as longs t0, t1, ..."""
    import pyarrow as pa

    names = [*(f"s{i}" for i in range(LONGS)), *(f"t{i}" for i in range(BITMAP // 64))]

    def run(it):
        for batch in it:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                maps = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<i8").reshape(-1, BITMAP // 64)
                longs = np.concatenate([low_bits(regs), maps], 1)
                columns = [pa.array(np.ascontiguousarray(longs[:, i])) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((regs > 0).sum(1).astype(np.int32)), *columns], ["id", "n", "used", *names])

    wanted = members.select("id", "n", "regs", "map").join(rows.select("id").distinct(), "id", "left_semi")
    return rows.join(wanted.mapInArrow(run, "id long, n long, used int, " + ", ".join(f"{x} long" for x in names)), "id")


def _plausible(x: str, y: str, threshold: float):
    """A join condition: whether sizes, bitmaps and low bits allow a link of two members.

    Sizes and bitmaps are exact bounds. The low bits are beyond six standard errors.
    """
    bits = [F.bit_count(F.col(f"{x}.s{i}").bitwiseXOR(F.col(f"{y}.s{i}"))) for i in range(LONGS)]
    k = F.greatest(f"{x}.used", f"{y}.used") / F.lit(threshold)
    p = (1 - threshold) / 2
    return set_links.sizes_and_maps(x, y, threshold) & (sum(bits[1:], bits[0]) <= k * p + 6 * F.sqrt(k * p * (1 - p)) + 3)


def _tested(pairs: DataFrame, docs: DataFrame, members: DataFrame, words: int, threshold: float) -> DataFrame:
    """(a, b, low, high, linked) of every given pair: bounds of its distance, and whether it is a link."""
    guess = settle(_estimated(pairs, members, threshold))
    sure = set_links.verified(guess.where("open"), docs, members, words, threshold)
    return guess.where("not open").select("a", "b", "low", F.lit(1.0).alias("high"), F.lit(False).alias("linked")).unionByName(sure)


def near_dedup(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Null and empty texts, and texts without words, have no shingles and link with nothing; a text of
    fewer words than a shingle is one shingle. Rows with a null id link with nothing, have a null
    component and are kept. Rows that share an id are one document: their links meet. Repeated rows
    give repeated rows and equal sets are linked; texts of any length are taken whole; an empty table
    gives none; other columns are ignored, whatever their names.
    """
    sketches = settle(sketch(docs, words))
    named = sketches.where("n > 0 and doc_id is not null")
    sets = set_links.members(named, F.first("regs").alias("regs"), F.first("map").alias("map"))
    bands = _keyed(sets.rows)
    groups = bands.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot <> last")
    comps = set_links.find_components(
        settle(bands.join(groups.select("key", "pivot"), "key")),
        lambda pairs: _tested(pairs, docs, sets.rows, words, threshold),
        lambda rows: _with_bits(rows, sets.rows),
        lambda x, y: _plausible(x, y, threshold),
        threshold,
        sets.links,
    )
    out = set_links.documents(sketches, sets, comps)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), words=2)
