"""Vector code compression: product codes from integer codebooks.

Vectors become integers, floor(256 * x), and are cut into equal parts. Each part position has a
codebook of at most ``ENTRIES`` entries, which starts with the vectors of the smallest ids. The
codebooks are broadcast. In each round Arrow batches compute all squared distances by the expansion
of the norm, |x|^2 - 2 x c + |c|^2, with matrix products of int64 that are exact, and take the first
least one; each task sums components and counts by entry, a grouped shuffle merges the sums, and the
driver divides: it sees one row per entry and part, whatever the number of vectors.

Components so large that a product would not fit int64 are computed with Python's integers, and
sums are kept in limbs, so they are exact as well.
"""

from __future__ import annotations

import hashlib

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, ship, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows that are measured at a time, and the bits of a limb of a sum.
BATCH, LIMB = 4096, 31
#: A label is hot if it has more than this part of all rows, so at most 1/HOT are.
HOT = 1 / 256


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite floats: int64 where all results fit, else Python's integers."""
    wide = values.astype(np.float64)
    if not wide.size or np.abs(wide).max() < 2.0**40:
        return np.floor(wide * SCALE).astype(np.int64)
    return np.array([int(x) * SCALE if abs(x) >= 2.0**53 else int(np.floor(x * SCALE)) for x in wide.ravel()], object).reshape(wide.shape)


def split(rows: np.ndarray, parts: int) -> np.ndarray:
    """Rows of integers as (row, part, component); where the parts do not come out even, zeros fill the last ones."""
    width = -(-rows.shape[1] // parts)
    out = np.zeros((len(rows), parts * width), rows.dtype)
    out[:, : rows.shape[1]] = rows
    return out.reshape(len(rows), parts, width)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) by row and part: x (row, part, component), book (entry, part, component); ties go to the lower entry."""
    largest = max([0, *(int(np.abs(a).max()) for a in (x, book) if a.size)])
    # a distance is at most width * (2 * largest)**2, and all parts are summed
    exact = 4 * x.shape[1] * max(1, x.shape[2]) * largest**2 < 2**62
    if not exact:
        x, book = x.astype(object), book.astype(object)
    elif x.dtype == object:
        x = x.astype(np.int64)
    entry = np.empty(x.shape[:2], np.int64)
    least = np.empty(x.shape[:2], x.dtype)
    for p in range(x.shape[1]):
        a, c = x[:, p, :], book[:, p, :]
        far = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)[None, :]
        entry[:, p] = far.argmin(1)
        least[:, p] = far[np.arange(len(a)), entry[:, p]]
    return entry, least


def _limbs(v: int) -> list[int]:
    """An integer by limbs of LIMB bits, lowest first; the highest has the sign."""
    out = []
    while not -(1 << LIMB) <= v < 1 << LIMB:
        out.append(v & ((1 << LIMB) - 1))
        v >>= LIMB
    return [*out, v]


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v): the rows whose vector is there and holds finite numbers only."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))


def _matrix(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of an Arrow list column that have ``width`` components, as integers, and which these are."""
    size = column.value_lengths().to_numpy()
    fits = np.flatnonzero(size == width)
    flat = column.flatten().to_numpy()
    if len(fits) == len(size):
        return integers(flat.reshape(len(size), width)), fits
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    return integers(flat[start[fits][:, None] + np.arange(width)[None, :]]), fits


def first_book(rows: DataFrame, parts: int, entries: int) -> tuple[np.ndarray, int]:
    """The codebooks to start with (entry, part, component), and the length of a vector, which is the first one's."""
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    first = rows.orderBy(*order).limit(1).select(F.size("v").alias("n")).collect()
    if not first:
        return np.zeros((0, parts, 0), np.int64), 0
    seeds = [r["v"] for r in rows.where(F.size("v") == first[0]["n"]).orderBy(*order).limit(entries).select("v").collect()]
    return split(integers(np.array(seeds, np.float64).reshape(len(seeds), -1)), parts), len(seeds[0])


def _sums(rows: DataFrame, book, width: int) -> DataFrame:
    """(cell, limb, n, s0, s1, ...): counts and sums of the components of all parts that are nearest to a cell, an entry of a part."""
    import pyarrow as pa

    ship(rows.sparkSession)
    entries, parts, part_width = book.value.shape
    names = [f"s{i}" for i in range(part_width)]

    def run(it):
        count = np.zeros(parts * entries, np.int64)
        total = np.zeros((parts * entries, part_width), np.int64)
        large: dict[tuple[int, int], list[int]] = {}
        for batch in it:
            for lo in range(0, batch.num_rows, BATCH):
                x, _ = _matrix(batch.column(0).slice(lo, BATCH), width)
                if not len(x):
                    continue
                x = split(x, parts)
                cell = nearest(x, book.value)[0] + np.arange(parts)[None, :] * entries
                count += np.bincount(cell.ravel(), minlength=len(count))
                if x.dtype == object:
                    for c, part in zip(cell.ravel().tolist(), x.reshape(-1, part_width).tolist()):
                        for i, v in enumerate(part):
                            for k, limb in enumerate(_limbs(v)):
                                large.setdefault((c, k), [0] * part_width)[i] += limb
                else:
                    np.add.at(total, cell.ravel(), x.reshape(-1, part_width))
        used = np.flatnonzero(count)
        columns = [np.concatenate([used, [c for c, _ in large]]), np.concatenate([np.zeros(len(used)), [k for _, k in large]]), np.concatenate([count[used], np.zeros(len(large))])]
        columns += [np.concatenate([total[used, i], np.array([s[i] for s in large.values()], np.int64)]) for i in range(part_width)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["cell", "limb", "n", *names])

    schema = "cell long, limb long, n long" + "".join(f", {s} long" for s in names)
    return rows.select("v").mapInArrow(run, schema).groupBy("cell", "limb").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names])


def _next_book(book: np.ndarray, sums: list) -> np.ndarray:
    """Every entry the floor of the mean of its parts; unused entries stay."""
    entries, parts, width = book.shape
    count, total = {}, {}
    for r in sums:
        c = r["cell"]
        count[c] = count.get(c, 0) + r["n"]
        old = total.get(c, [0] * width)
        total[c] = [old[i] + (r[f"s{i}"] << (LIMB * r["limb"])) for i in range(width)]
    out = book.astype(object)
    for c, n in count.items():
        out[c % entries, c // entries] = [t // n for t in total[c]]
    small = not out.size or max(abs(int(v)) for v in out.ravel()) < 1 << 62
    return out.astype(np.int64) if small else out


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, int]:
    """The codebooks after so many rounds, and the length of a vector."""
    book, width = first_book(rows, parts, entries)
    sc = rows.sparkSession.sparkContext
    for _ in range(rounds if book.size else 0):
        sent = sc.broadcast(book)
        book = _next_book(book, _sums(rows, sent, width).collect())
        sent.destroy()
    return book, width


def book_text(book: np.ndarray) -> str:
    """All components by part, entry and place."""
    return ",".join(str(int(v)) for v in book.transpose(1, 0, 2).ravel())


def encode(rows: DataFrame, book: np.ndarray, width: int) -> DataFrame:
    """(vec_id, label, code, error) of every row of (vec_id, label, v)."""
    import pyarrow as pa

    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(book)
    parts = book.shape[1]

    def run(it):
        for batch in it:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                x, fits = _matrix(part.column(2), width)
                code, error = [None] * part.num_rows, [None] * part.num_rows
                if len(fits) and len(sent.value):
                    entry, least = nearest(split(x, parts), sent.value)
                    for i, e, far in zip(fits.tolist(), entry.astype(np.uint8), least.sum(1).tolist()):
                        code[i], error[i] = e.tobytes().hex(), far if far < 1 << 63 else None
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256), one row per vector that can be coded.

    Rows whose vector is null or holds null or non-finite components go. Repeated rows and ids are
    rows like others; null ids come last where the first codebooks are taken; equal ids are ordered by
    their vectors. A vector's length is the first one's: rows of another length have a null code and
    error. A length that the parts do not divide is filled up with zeros. An error beyond 64 bits is
    null. An empty table gives none; other columns are ignored, whatever their names. ``entries`` is at
    most 256.
    """
    rows = kept(vectors, id_col, vector_col, label_col)
    book, width = codebooks(rows, parts, entries, rounds)
    coded = settle(encode(rows, book, width))
    by_label = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    # the at most 1/HOT hot labels meet their rows from a broadcast, all others by a join
    hot = by_label.where(F.col("n") > max(1.0, coded.count() * HOT)).select(F.col("label").alias("hot_label"), F.col("label_error").alias("hot_error"), F.lit(True).alias("hot"))
    marked = coded.join(F.broadcast(hot), coded["label"].eqNullSafe(hot["hot_label"]), "left")
    cold = marked.where("hot is null").select("vec_id", "label", "code", "error")
    totals = by_label.select(F.col("label").alias("l"), "label_error")
    cold = cold.join(totals, cold["label"].eqNullSafe(totals["l"])).select("vec_id", "code", "error", "label_error")
    out = marked.where("hot").select("vec_id", "code", "error", F.col("hot_error").alias("label_error")).unionByName(cold)
    return out.withColumn("codebooks_sha256", F.lit(hashlib.sha256(book_text(book).encode()).hexdigest()))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _round_sql(k: int, parts: int, entries: int) -> str:
    """SQL: assignment to the codebooks b{k}(part, entry, c), and the next ones."""
    return f"""a{k} AS MATERIALIZED (SELECT vec_id, part, d[1] AS far, d[2] AS entry FROM (
  SELECT x.vec_id, x.part, min([list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, b.entry]) AS d FROM x JOIN b{k} b USING (part) GROUP BY ALL))"""


def vector_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for unique ids and vectors of one length that the parts divide."""
    out = f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), x AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS c FROM k, range({parts}) r(part)
), s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {entries}
), b0 AS MATERIALIZED (SELECT part, entry, c FROM x JOIN s USING (vec_id))"""
    for i in range(rounds):
        out += f""", {_round_sql(i, parts, entries)}, m{i} AS (
  SELECT part, entry, list(mean ORDER BY pos) AS c FROM (
    SELECT part, entry, pos, (sum(v) // count(*) - CASE WHEN sum(v) % count(*) < 0 THEN 1 ELSE 0 END)::BIGINT AS mean
    FROM (SELECT a.part, a.entry, unnest(range(1, len(x.c) + 1)) AS pos, unnest(x.c)::HUGEINT AS v FROM a{i} a JOIN x USING (vec_id, part)) GROUP BY ALL) GROUP BY ALL
), b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN m{i} USING (part, entry))"""
    return (
        out
        + f""", {_round_sql(rounds, parts, entries)}, e AS (
  SELECT vec_id, lower(string_agg(printf('%02x', entry), '' ORDER BY part)) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY vec_id
), l AS (SELECT label, sum(error)::BIGINT AS label_error FROM e JOIN k USING (vec_id) GROUP BY label
), h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM b{rounds})
SELECT vec_id, code, error, label_error, h AS codebooks_sha256 FROM e JOIN k USING (vec_id) JOIN l ON l.label IS NOT DISTINCT FROM k.label, h"""
    )


OP13_SQL = vector_sql()
