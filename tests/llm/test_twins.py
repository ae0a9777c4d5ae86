"""Slow twins of the learned operators, and odd tables for every operator."""

import math
import os
import random
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import test_operators as O  # noqa: E402

import corpus_pipeline as P  # noqa: E402
from scrubline.llm import bpe, chat_format, exact_dedup, language_id, license_scan, media_ts, near_dedup, packing, quality, suffix_dedup  # noqa: E402

DATA = "/root/testdata/sf0.001"


# -- 3 --------------------------------------------------------------------------------------------
def slow_grams(text):
    """Hashed n-grams of 1 to 3 characters, one by one: letters in lower case, runs of all else one space."""
    chars = []
    for c in text.lower():
        if c.isalpha():
            chars.append(c)
        elif not chars or chars[-1] != " ":
            chars.append(" ")
    if chars and chars[-1] == " " and len(chars) > 1:
        chars.pop()
    if not any(c.isalpha() for c in chars):
        return Counter()
    codes = [ord(c) for c in chars] + [32]
    m = 1 << 32
    one = [c * 0x9E3779B1 % m for c in codes]
    two = [(one[i] ^ (codes[i + 1] * 0x85EBCA77 + 0x27D4EB2F) % m) * 0xC2B2AE3D % m for i in range(len(codes) - 1)]
    three = [(two[i] ^ (codes[i + 2] * 0x165667B1 + 0x2545F491) % m) * 0x9E3779B1 % m for i in range(len(codes) - 2)]
    return Counter((h ^ h >> 15) & (language_id.N_FEATURES - 1) for h in one + two + three)


TEXTS = ["Der Baum, das Haus", "a  b\n\nc", "é! 12 x", "one", "漢字 und Wörter...", "x" * 3000 + " y"]


def test_ngram_counts_of_a_slow_twin():
    for text in TEXTS:
        used, counts = language_id.ngram_counts(text)
        mine = dict(zip(used.tolist(), counts.tolist()))
        slow = slow_grams(text)
        # a trailing mark is one more space in the text itself
        if text[-1].isalpha():
            assert mine == dict(slow), text
        else:
            assert sum(mine.values()) >= sum(slow.values())
    assert all(not len(language_id.ngram_counts(t)[0]) for t in ("", None, "12 !", " "))


def test_tfidf_and_updates_of_a_slow_twin():
    rng = np.random.default_rng(5)
    idf = rng.uniform(1, 3, language_id.N_FEATURES)
    used, counts = language_id.ngram_counts("the cat and the hat")
    x = language_id.tfidf(used, counts, idf)
    raw = [(1 + math.log(c)) * idf[u] for u, c in zip(used, counts)]
    norm = math.sqrt(sum(v * v for v in raw))
    assert np.allclose(x, [v / norm for v in raw])
    learner = language_id.FTRL(6, 3)
    z, n = [[0.0] * 3 for _ in range(6)], [[0.0] * 3 for _ in range(6)]

    def weight(i, k):
        if abs(z[i][k]) <= learner.l1:
            return 0.0
        return -(z[i][k] - math.copysign(learner.l1, z[i][k])) / ((learner.beta + math.sqrt(n[i][k])) / learner.alpha + learner.l2)

    for _ in range(200):
        rows = np.sort(rng.choice(6, 3, replace=False))
        values, label = rng.uniform(0.1, 1, 3), int(rng.integers(3))
        w = [[weight(i, k) for k in range(3)] for i in rows]
        score = [sum(v * w[a][k] for a, v in enumerate(values)) for k in range(3)]
        total = sum(math.exp(s) for s in score)
        for a, i in enumerate(rows):
            for k in range(3):
                g = values[a] * (math.exp(score[k]) / total - (k == label))
                sigma = (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / learner.alpha
                z[i][k] += g - sigma * w[a][k]
                n[i][k] += g * g
        learner.update(rows, values, label)
    assert np.allclose(learner.z, z) and np.allclose(learner.n, n)
    assert np.allclose(learner.weights(), [[weight(i, k) for k in range(3)] for i in range(6)])


def test_languages_of_a_small_corpus_by_hand(spark):
    """All training rows are learned, document frequencies included, and scores come from the model alone."""
    rnd = random.Random(2)
    words = {"aa": ["kala", "maja", "taevas"], "bb": ["house", "heaven", "fish"]}
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(12)), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    train = [r for r in rows if zlib_crc(r[0]) % 3 != 1]
    frequency = Counter(f for r in train for f in slow_grams(r[1]))
    want = {f: math.log((1 + len(train)) / (1 + k)) + 1 for f, k in frequency.items()}
    assert all(abs(model.idf[f] - v) < 1e-9 for f, v in want.items())
    got = {r["doc_id"]: r for r in language_id.predict(df, model).collect()}
    for i, text, lang in rows:
        used = np.array(sorted(slow_grams(text)))
        x = np.array([(1 + math.log(slow_grams(text)[u])) * model.idf[u] for u in used])
        s = (x / math.sqrt((x * x).sum()) @ model.weights[used] + model.bias_row) / model.temperature
        p = np.exp(s) / np.exp(s).sum()
        assert got[i]["lang_pred"] == lang == model.languages[int(p.argmax())] and abs(got[i]["score"] - p.max()) < 1e-9
        assert got[i]["held_out"] == (zlib_crc(i) % 3 == 1)


def zlib_crc(i):
    import zlib

    return zlib.crc32(str(i).encode())


# -- 10 -------------------------------------------------------------------------------------------
def slow_statistics(text):
    """The statistics, byte by byte and word by word."""
    raw = text.encode()
    n = len(raw)
    part = lambda codes: sum(b in codes for b in raw) / n
    shares = [c / n for c in Counter(raw).values()]
    out = [math.log1p(n)] + [part(set(codes)) for codes in quality._CLASS.values()] + [-sum(p * math.log2(p) for p in shares), max(shares)]
    words = [w for w in __import__("re").split(b"[ \t-\r]+", bytes(b + 32 if 65 <= b <= 90 else b for b in raw)) if w]
    w = len(words)
    if w:
        pairs = list(zip(words, words[1:]))
        out += [math.log1p(w), sum(map(len, words)) / w, sum(len(x) > 14 for x in words) / w, sum(len(x) < 3 for x in words) / w, len(set(words)) / w, max(Counter(words).values()) / w]
        out += [sum(a == b for a, b in pairs) / len(pairs) if pairs else 0.0, len(set(pairs)) / len(pairs) if pairs else 1.0, sum(x[-1] in b"!#$%&*?@|" and quality._MARKED[x[-1]] for x in words) / w]
    else:
        out += [0.0] * 9
    lines = [x for x in text.split("\n") if x]
    out += [math.log1p(len(lines)), len(set(lines)) / len(lines), math.log1p(len(text) / len(lines)), max(Counter(lines).values()) / len(lines)] if lines else [0.0] * 4
    return out


def test_statistics_of_a_slow_twin():
    for text in TEXTS + ["Buy NOW!!! $$$ Buy NOW!!!\nBuy NOW!!!", " ", "a a a b", "é" * 500, "\n\n", "w " * 20_000]:
        assert np.allclose(quality.statistics(text), slow_statistics(text)), text[:30]
    assert not quality.statistics("").any() and not quality.statistics(None).any()


def test_boosting_of_a_slow_twin():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 6, (60, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3)).astype(float)
    trees = quality.boost(x, y, trees=3, depth=2)
    margin = np.full(60, trees.base)
    for t in range(3):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def grow(rows, node, depth):
            if depth == 2:
                value = -0.15 * g[rows].sum() / (h[rows].sum() + 1.0)
                assert abs(trees.value[t, node] - value) < 1e-9
                margin[rows] += value
                return
            best = 0.0
            for j in range(3):
                for cut in np.unique(x[:, j]):
                    left = rows & (x[:, j] <= cut)
                    right = rows & (x[:, j] > cut)
                    if h[left].sum() >= 2.0 and h[right].sum() >= 2.0:
                        gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1.0) for s in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
                        best = max(best, gain)
            j, cut = trees.feature[t, node], trees.cut[t, node]
            left = rows & (x[:, j] <= cut)
            right = rows & (x[:, j] > cut)
            mine = sum(g[s].sum() ** 2 / (h[s].sum() + 1.0) for s in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + 1.0) if right.any() else 0.0
            assert abs(mine - best) < 1e-9 or best <= 1e-6
            if left.any():
                grow(left, 2 * node + 1, depth + 1)
            if right.any():
                grow(right, 2 * node + 2, depth + 1)

        grow(np.ones(60, bool), 0, 0)
    assert np.allclose(margin, trees.margin(x))


# -- odd tables -----------------------------------------------------------------------------------
CLASHING = ["id", "n", "key", "digest", "score", "held_out", "part", "piece", "mark", "bodies", "bucket", "place", "words", "token", "t", "label", "salt", "raw", "run", "hot", "m1", "regs"]
LONG_WORD = "kq" * 60_000 + "é" * 1000
OPERATORS = {
    "packing": packing.pack,
    "license": license_scan.license_scan,
    "language": lambda d: language_id.predict(d, language_id.fit(d)),
    "near": near_dedup.near_dedup,
    "bpe": bpe.bpe_digests,
    "exact": exact_dedup.exact_dedup,
    "suffix": suffix_dedup.dedup_report,
    "removed": suffix_dedup.remove_repeats,
    "groups": suffix_dedup.repeat_groups,
    "media": media_ts.media_digests,
    "quality": lambda d: quality.score(d, quality.fit(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) AS quality"))),
}


# a word of one period is a repeat at every place: not for repeat_groups, which gathers all places
@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "groups"])
def test_clashing_columns_and_one_very_long_word(spark, name):
    texts = {1: LONG_WORD, 2: LONG_WORD + "z", 3: None, 4: "", 5: "plain words of a text", None: "plain words of a text"}
    rows = [(i, t, "en") for i, t in texts.items()]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    extra = spark.createDataFrame([(*r, *CLASHING) for r in rows], "doc_id long, text string, lang string, " + ", ".join(f"`{c}` string" for c in CLASHING))
    keep = lambda d: d.select("doc_id", "text") if name == "removed" else d
    got = O.collect(keep(OPERATORS[name](extra)))
    if name == "packing":
        strip = lambda rs: sorted(tuple(r[:5]) for r in rs if r[0] is not None)
        assert strip(got) == strip(O.collect(OPERATORS[name](plain))) and len(got) > 100
    else:
        assert got == O.collect(keep(OPERATORS[name](plain)))
        assert len(got) == len(rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_chat_of_clashing_columns_and_long_texts(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "x" * 300_000), (2, 0, "user", "hi"), (2, 1, "assistant", None)]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    extra = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], "conv_id long, turn long, role string, text string, turns string, n string, opening string, salt string")
    format_ = lambda d: O.collect(chat_format.format_pairs(chat_format.preference_pairs(d)))
    assert format_(extra) == format_(plain) and len(format_(plain)) == 1


# -- pipeline -------------------------------------------------------------------------------------
@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 6000").cache()
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    near = P.near_stage(spark, docs, DATA).toPandas()
    assert sorted(near.doc_id) == sorted(i for i, _, _, kept in O.brute_near(rows, 5) if kept)
    cut = {r["doc_id"]: r["text"] for r in P.suffix_stage(spark, docs, DATA).collect()}
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            x = b[s : s + 50]
            first[x] = min(first.get(x, i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < i:
                gone[s : s + 50] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        assert (cut[i] or "") == left
    packed = P.packing_stage(spark, docs, DATA).toPandas()
    sums = packed.groupby("sequence_id")["length"].sum()
    assert sums.max() <= 1024 and len(sums) <= math.ceil(packed["length"].sum() / 1024) + 2
