"""Folds inside one row against plain Python, on empty, short and long arrays."""

import random

import pytest
from pyspark.sql import functions as F

from scrubline.functions import folds
from scrubline.operators import rewrite as W
from scrubline.operators.detect import findings

RNG = random.Random(5)
SIZES = [0, 1, 2, 3, 4, 5, 7, 8, 9, 31, 32, 33, 1000]


def test_running_totals_and_ranks(spark):
    rows = [([RNG.randint(-3, 9) for _ in range(n)], [RNG.choice(["a", "b", None]) for _ in range(n)]) for n in SIZES]
    df = spark.createDataFrame(rows, "v array<int>, g array<string>")
    out = df.select("v", "g", folds.scan(F.col("v"), lambda a, b: a + b).alias("sum"), folds.scan(F.col("v"), lambda a, b: F.greatest(a, b)).alias("top"), folds.ranks(F.col("g"), F.col("v")).alias("rank"))
    for r in out.collect():
        assert r["sum"] == [sum(r["v"][: i + 1]) for i in range(len(r["v"]))]
        assert r["top"] == [max(r["v"][: i + 1]) for i in range(len(r["v"]))]
        order = sorted(range(len(r["v"])), key=lambda i: (r["v"][i], i))
        seen, want = {}, [0] * len(order)
        for i in order:
            seen[r["g"][i]] = want[i] = seen.get(r["g"][i], 0) + 1
        assert r["rank"] == want


def test_chains_and_lookups(spark):
    rows = [([i + RNG.randint(1, 4) for i in range(n)], sorted(RNG.sample(range(3 * n + 1), n))) for n in SIZES]
    df = spark.createDataFrame(rows, "jumps array<int>, keys array<int>")
    of_keys = lambda k: F.transform(F.sequence(F.lit(-1), F.lit(200)), lambda x: F.struct(folds.below(k, x).alias("n"), folds.lookup(k, F.transform(k, lambda y: y * 2), x).alias("v")))
    for r in df.select("*", folds.chain(F.col("jumps")).alias("chain"), folds.let(F.col("keys"), of_keys).alias("found")).collect():
        want, i = [], 0
        while i < len(r["jumps"]):
            want.append(i)
            i = r["jumps"][i]
        assert r["chain"] == want
        for x, got in zip(range(-1, 201), r["found"]):
            assert got["n"] == sum(k < x for k in r["keys"])
            assert got["v"] == (2 * x if x in r["keys"] else None)


def test_pieces_of_texts(spark):
    text = "\ufeff" + "".join(RNG.choice("ab電😀é\n\0\ufeff") for _ in range(3000))
    borders = [0, 1, 2, 511, 512, 513, 1024, len(text) - 1, len(text)]
    every = [(a, b) for a in borders for b in borders if a <= b]
    rows = [(text, every), (text, every[: folds.FEW]), ("", [(0, 0)] * (folds.FEW + 1)), (text, [])]
    df = spark.createDataFrame(rows, "t string, s array<struct<a:int,b:int>>")
    for r in df.select("t", "s", folds.cut(F.col("t"), F.col("s"), lambda x, i, part: part(x["a"], x["b"])).alias("out")).collect():
        assert r["out"] == [r["t"][a:b] for a, b in r["s"]]


@pytest.mark.parametrize("n", [20, 3000])
def test_overlaps_that_never_end(spark, n):
    """Terms that overlap all along one text, so that no gap ever parts them."""
    text = "".join(RNG.choice(["ab", "ba", "aab"]) for _ in range(n))
    terms = ["ab", "ba", "aba", "bab"]
    docs = spark.createDataFrame([(1, text)], "source_id int, text string")
    got = [(r["start"], r["end"]) for r in findings(docs, "source_id", terms=terms).orderBy("start").collect()]
    found = []
    for k, t in enumerate(terms):
        at = text.find(t)
        while at >= 0:
            found.append((at, -(at + len(t)), k))
            at = text.find(t, at + len(t))
    want, last = [], 0
    for start, end, _ in sorted(found):
        if start >= last:
            want.append((start, -end))
            last = -end
    assert got == want


def test_a_document_of_very_many_findings(spark):
    n = 20_000
    text = " 😀 ".join(f"u{i % 7000}@example.com" for i in range(n))
    docs = spark.createDataFrame([("d", text), ("e", "mail a@example.com")], "source_id string, text string")
    none = F.lit(None).cast("string")
    chosen = findings(docs, "source_id").select("source_id", "finding_id", F.lit(1).alias("seq"), F.when(F.col("start") % 3 == 0, "delete").otherwise("tokenize").alias("action"), none.alias("token_label"), none.alias("replacement"), none.alias("reason"))
    out = W.sanitize(docs, chosen).select("*", W.rehydrate(F.col("sanitized_text"), F.col("tokens")).alias("back"))
    row = {r["source_id"]: r for r in out.collect()}["d"]
    at, k, want, back = 0, 0, [], []
    for i in range(n):
        mail = f"u{i % 7000}@example.com"
        k += at % 3 != 0
        want.append("[REMOVED]" if at % 3 == 0 else "【EMAIL-%02d】" % k)
        back.append("[REMOVED]" if at % 3 == 0 else mail)
        at += len(mail) + 3
    assert (row["status"], row["n_public"], row["n_tokens"]) == ("ok", n, k)
    assert row["sanitized_text"] == " 😀 ".join(want)
    assert row["back"] == " 😀 ".join(back)
