"""Near-dedup and the n-gram join against brute force, shared ids included."""

import random
import re

import numpy as np
import pytest

from scrubline.llm import near_dedup, ngram_join, set_links


def brute(rows, words, threshold=80):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text); rows of one id are one document."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None:
                continue
            same = sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])
            # an empty text of a shared id links with nothing
            if same or (rows[i][0] == rows[j][0] and sets[i] and sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i)]
        out.append((doc, len(sets[i]), None if doc is None else min(ids)))
    return sorted(out, key=repr)


def result(spark, f, rows, **sizes):
    df = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], "doc_id long, text string, `key` string, id int, n int").repartition(4)
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id")) for r in f(df, **sizes).collect()), key=repr)


def corpus(seed, n, vocabulary=60):
    rng = random.Random(seed)
    common = " ".join(f"c{i}" for i in range(30))
    bases = [[f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([1, 3, 4, 5, 6, 9, 14, 40, 90]))] for _ in range(max(2, n // 6))]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(5)}"
        text = " ".join(w) + (" " + common if rng.random() < 0.3 else "")
        rows.append((i, text.upper() if rng.random() < 0.2 else text))
    return rows


@pytest.mark.parametrize("seed,words,often", [(1, 5, 1 << 18), (2, 5, 0), (3, 2, 40), (4, 5, 7)])
def test_join_equals_brute_force(spark, monkeypatch, seed, words, often):
    # small chunks, so that counts are reported by parts
    monkeypatch.setattr(ngram_join, "CHUNK", 400)
    rows = corpus(seed, 220)
    assert result(spark, ngram_join.ngram_join, rows, words=words, often=often) == brute(rows, words)


def test_odd_rows(spark):
    long = " ".join(f"v{i % 977}x{i % 31}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, long), (8, long + " tail"), (None, "one two"), (9, "a b c d e"), (9, "a b c d e"), (10, "ü 😀 b c d e f")]
    assert result(spark, ngram_join.ngram_join, rows) == brute(rows, 5)
    assert result(spark, ngram_join.ngram_join, []) == []


def near(a, n):
    """A text of n words of its own, and one with a word more."""
    base = " ".join(f"{a}{i}" for i in range(n))
    return base, base + " more"


@pytest.mark.parametrize("f", [near_dedup.near_dedup, ngram_join.ngram_join])
def test_one_id_with_several_texts(spark, f):
    (a, a2), (b, b2) = near("a", 30), near("b", 40)
    c = " ".join(f"c{i}" for i in range(20))
    for rows in ([(5, a), (5, b), (8, a2), (7, b2)], [(5, a), (9, a), (9, b), (11, b)], [(3, a), (5, a), (5, b), (9, b), (2, c), (9, c), (1, "lone text of six own words")], [(5, a), (5, ""), (6, "")]):
        assert result(spark, f, rows, words=2) == brute(rows, 2)


def test_similarity_of_exactly_the_threshold(spark):
    rows = []
    for k, union in enumerate((5, 10, 25, 100, 500, 3000)):
        shared = union * 4 // 5
        base = [f"s{k}w{i}" for i in range(union)]
        # one-word shingles: sets are words
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(base[:shared])), (10 * k + 2, " ".join([*base[: shared - 1], f"q{k}"]))]
    assert result(spark, ngram_join.ngram_join, rows, words=1) == brute(rows, 1)


def test_prefix_length():
    for n in range(1, 400):
        assert ngram_join.prefix_length(n, 0.8) == n - -(-80 * n // 100) + 1


def test_prefixes_meet_under_every_order():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        pool = np.unique(rng.integers(0, 1 << 63, 4 * n, dtype=np.uint64))
        often, classes = pool[::3], (np.arange(len(pool[::3])) % 9 + 1).astype(np.uint8)
        base = rng.choice(pool, min(n, len(pool)), replace=False)
        other = np.unique(np.concatenate([base[: max(1, int(len(base) * 0.9))], rng.choice(pool, 2)]))
        base = np.unique(base)
        shared = len(np.intersect1d(base, other))
        if 100 * shared >= 80 * (len(base) + len(other) - shared):
            x, y = (ngram_join.prefixes(s, 0.8, often, classes)[0] for s in (base, other))
            assert all(len(np.intersect1d(p, q)) for p, q in zip(x, y))


def test_groups():
    keys = np.array([5, 5, 6, 7, 7, 8, 8, 8, 9, 9], np.uint64)
    ids = np.array([2, 1, 9, 1, 2, 3, 1, 2, 1, 4])
    sizes = np.array([{1: 10, 2: 9, 3: 8, 4: 7, 9: 10}[i] for i in ids])
    got = ngram_join.groups(keys, ids, sizes, 0.8)
    assert sorted(g[2].tolist() for g in got) == [[1, 2], [1, 2, 3]]
    assert ngram_join.groups(keys[:0], ids[:0], sizes[:0], 0.8) == []


def test_reaches_is_exact():
    assert set_links.reaches(8 * 10**9, 10**10, 0.8) and not set_links.reaches(8 * 10**9 - 1, 10**10, 0.8)
