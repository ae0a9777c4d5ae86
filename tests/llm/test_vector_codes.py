"""Vector codes against plain Python integers, and the SQL."""

import hashlib
import math
import os

import duckdb
import numpy as np
import pytest

from scrubline.llm import vector_codes as V

DATA = "/root/testdata/sf0.001"


def plain(rows, parts, entries, rounds):
    """Rows (vec_id, vector, label), coded one by one."""
    kept = [(i, [math.floor(256 * x) if abs(x) < 2**50 else 256 * int(x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    book = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]

    def assign():
        out = []
        for _, v, _ in kept:
            far = [[sum((x - y) ** 2 for x, y in zip(c, e)) for e in book[p]] for p, c in enumerate(cut(v))]
            out.append([(f.index(min(f)), min(f)) for f in far])
        return out

    for _ in range(rounds):
        got = assign()
        for p in range(parts):
            for e in range(len(book[p])):
                mine = [cut(v)[p] for (_, v, _), g in zip(kept, got) if g[p][0] == e]
                if mine:
                    book[p][e] = [sum(c) // len(c) for c in zip(*mine)]
    got = assign()
    error = [sum(far for _, far in g) for g in got]
    by = {}
    for (_, _, lab), e in zip(kept, error):
        by[lab] = by.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for p in book for e in p for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for e, _ in g), err, by[lab], sha) for (i, _, lab), g, err in zip(kept, got, error)), key=repr)


def coded(spark, rows, kind="float", **sizes):
    df = spark.createDataFrame([(i, v, lab, "c", 1) for i, v, lab in rows], f"vec_id long, embedding array<{kind}>, label int, code string, v int").repartition(3)
    out = V.vector_codes(df, **sizes)
    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in out.collect()), key=repr)


def test_equals_plain(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), int(i % 3) if i % 7 else None) for i in range(150)]
    rows += [(200, None, 1), (201, [None] + [0.0] * 7, 1), (202, [float("nan")] + [0.0] * 7, 1), (203, [float("inf")] + [0.0] * 7, 1), (None, [0.5] * 8, None), (7, rows[7][1], 0), (8, [-0.001] * 8, 2)]
    assert coded(spark, rows, parts=4, entries=16, rounds=2) == plain(rows, 4, 16, 2)


def test_ties_and_equal_rows(spark):
    rows = [(i, [float(i % 2)] * 4, 0) for i in range(40)]
    assert coded(spark, rows, parts=2, entries=8) == plain(rows, 2, 8, 2)


def test_few_rows_and_huge_components(spark):
    rows = [(1, [1e30, -1e30, 3.7, 2.0**60], 1), (2, [1e30, 1.0, -3.7, -(2.0**60)], 1), (3, [0.25, 1.0, -3.7, 2.0**60 + 2**20], None)]
    got, want = coded(spark, rows, "double", parts=2, entries=2), plain(rows, 2, 2, 2)
    fits = lambda x: x if x < 1 << 63 else None
    assert [(a, b, d[-1]) for a, b, *d in got] == [(a, b, d[-1]) for a, b, *d in want]
    assert [r[2] for r in got] == [fits(r[2]) for r in want]


def test_lengths(spark):
    rows = [(1, [1.0, 2.0, 3.0], 1), (2, [1.0, 2.0], 1), (3, [2.0, 2.0, 3.0], 1), (4, [], 2)]
    got = coded(spark, rows, parts=2, entries=2)
    assert [(r[0], r[1]) for r in got] == [(1, "0000"), (2, None), (3, "0100"), (4, None)]


def test_empty_tables(spark):
    assert coded(spark, []) == []
    assert coded(spark, [(1, None, 1)]) == []


def test_limbs():
    for v in (0, -1, 5, -(1 << 31), 1 << 31, -(1 << 200) - 7, (1 << 136) + 9):
        assert sum(x << (V.LIMB * k) for k, x in enumerate(V._limbs(v))) == v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({V.OP13_SQL})").fetchall())
    assert sorted(tuple(r) for r in V.op13_vector_codes(spark, DATA).select(*columns).collect()) == want
