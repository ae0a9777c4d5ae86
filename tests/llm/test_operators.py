"""The training-data operators against brute force, the tokenizers library, and a nasty table."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from scrubline.llm import bpe, chat_format, exact_dedup, language_id, license_scan, media_ts, near_dedup, packing, quality, queries, suffix_dedup
from scrubline.llm.wordhash import shingles

DATA = "/root/testdata/sf0.001"
LONG = "word! " * 30_000 + "é" * 500
#: Nulls in every column, empty, blank and very long texts, repeated rows, ties, clashing extra columns.
ROWS = [
    (1, "The MIT License applies to the whole of this text, and to every copy of it that is made.", "en", 0, "k"),
    (2, "The MIT License applies to the whole of this text, and to every copy of it that is made.", "en", 0, "k"),
    (3, "the  mit license\napplies to the whole of this text, and to every copy of it that is made.", None, 1, None),
    (4, None, "de", None, "x"),
    (5, "", "de", 2, "x"),
    (6, " \t\n", None, 2, "x"),
    (7, LONG, "fr", 3, "y"),
    (7, LONG, "fr", 3, "y"),
    (8, LONG + "tail", "fr", 3, "y"),
    (None, "The MIT License applies to the whole of this text, and to every copy of it that is made.", None, None, None),
    (9, "<|endoftext|> ünï 😀 12 <|endoftext|>", "es", 4, "z"),
    (10, "123 456 --- !!!", "es", 5, "z"),
]
SCHEMA = "doc_id long, text string, lang string, id int, `key` string"


@pytest.fixture(scope="module")
def nasty(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def collect(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def union_find(pairs, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


# -- 6 --------------------------------------------------------------------------------------------
def brute_exact(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min(g, key=lambda x: x[:3])[3]
        out.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_dedup(nasty, fan_in):
    assert collect(exact_dedup.exact_dedup(nasty, fan_in=fan_in)) == brute_exact([r[:2] for r in ROWS])


# -- 4 --------------------------------------------------------------------------------------------
def brute_near(rows, width):
    sets = []
    for _, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    pairs = []
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]):
                shared = len(sets[a] & sets[b])
                if 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                    pairs.append((rows[a][0], rows[b][0]))
    comp = union_find(pairs, {i for i, _ in rows if i is not None})
    return sorted([(i, len(s), comp.get(i), comp.get(i) == i) for (i, _), s in zip(rows, sets)], key=repr)


def near_rows(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for n in [1, 2, 3, 4, 5, 6, 8, 10, 15, 20, 40, 80, 200, 260, 320, 500] * 2:
        base = [rnd.choice(words) for _ in range(n)]
        for _ in range(rnd.randrange(1, 12)):
            t = list(base)
            for _ in range(rnd.randrange(0, max(1, n // 8) + 1)):
                t[rnd.randrange(n)] = rnd.choice(words)
            rows.append((len(rows) * 7 % 100_003, " ".join(t)))
    return rows


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup(spark, width):
    rows = near_rows(width) + [(r[0], r[1]) for r in ROWS if r[0] not in (1, 2, 3)]
    got = collect(near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=width))
    assert got == brute_near(rows, width)


def test_hypermin_estimates():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8, 0.95):
        n = 3000
        both = int(2 * n * share / (1 + share))
        h = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        a, b = np.unique(h[:n]), np.unique(np.concatenate([h[:both], h[n : 2 * n - both]]))
        got = near_dedup.estimate(near_dedup.registers(a)[None], near_dedup.registers(b)[None], np.array([n]), np.array([n]))[0]
        assert abs(got - share) < 5 * (share * (1 - share) / near_dedup.REGISTERS) ** 0.5
        apart = np.bitwise_count(near_dedup.bitmap(a) ^ near_dedup.bitmap(b)).sum()
        assert near_dedup.most_similar(np.array([apart]), np.array([n]), np.array([n]))[0] >= share - 0.01


def test_shingles_of_short_texts():
    assert len(shingles("A b", 5)) == 1 and len(shingles("", 5)) == 0 and len(shingles(None, 2)) == 0
    assert (shingles("X y", 2) == shingles("x\n\tY ", 2)).all()


# -- 7 --------------------------------------------------------------------------------------------
def brute_suffix(rows, w=50):
    first = {}
    key = lambda i: (1 << 63) - 1 if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - w + 1):
            x = b[s : s + w]
            if first.get(x, 1 << 64) > key(i):
                first[x] = key(i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        m = np.zeros(len(b) + 1, int)
        for s in range(len(b) - w + 1):
            if first[b[s : s + w]] < key(i):
                m[s] += 1
                m[s + w] -= 1
        gone = np.cumsum(m)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_dedup(spark):
    rnd = random.Random(5)
    pieces = ["ab", "the ", "é", "x", "yy ", "qrs", "0", "zz"]
    seg = ["".join(rnd.choice(pieces) for _ in range(40)) for _ in range(10)]
    rows = [(i, "".join(rnd.choice(pieces) for _ in range(rnd.randrange(0, 200)))) for i in range(60)]
    rows += [(200 + i, "".join(rnd.choice(seg)[rnd.randrange(0, 20) :] for _ in range(rnd.randrange(1, 6)))) for i in range(150)]
    rows += [(600 + i, "ab" * rnd.randrange(0, 80) + rnd.choice(["", "a", "c"])) for i in range(30)]
    rows += [(700 + i, "".join(rnd.choice("ab") for _ in range(rnd.randrange(40, 300)))) for i in range(60)]
    rows += [(None, seg[0] * 2), (None, None), (5, seg[1] * 3), (5, seg[1] * 3), (5, seg[2]), (800, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert collect(suffix_dedup.dedup_report(df)) == brute_suffix(rows)


def test_maximal_repeats_have_all_places():
    texts = [b"xxabcdefyy", b"zzabcdefww", b"qqabcdefyy"]  # anchor: "abc"
    right = np.array([list(t[2:]) for t in texts])
    left = np.array([list(t[:2][::-1]) for t in texts])
    got = {(tuple(sorted(m)), lo, hi) for m, lo, hi in suffix_dedup.maximal_repeats(right, left, 6)}
    assert ((0, 1, 2), 0, 6) in got and ((0, 2), 0, 8) in got


def test_remove_repeats_keeps_columns(nasty):
    out = suffix_dedup.remove_repeats(nasty)
    assert out.schema.names == nasty.schema.names and out.count() == len(ROWS)
    by_id = {r["doc_id"]: r["text"] for r in out.collect()}
    assert by_id[1] == ROWS[0][1] and by_id[2] == "" and by_id[4] is None


# -- 5, 1 -----------------------------------------------------------------------------------------
HARD = [r[1] or "" for r in ROWS if r[0] != 7] + ["aaaaaaaaaaaaaaaa" * 5, "é́漢字👩‍👩‍👧 don't I'll 12³½  \u0085  x\x00\x1c\x1dz", "　全角　", "मानक हिन्दी \x0b\x0c", "    ", "a\n\n  b"]


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def test_bpe_equals_the_library(nasty):
    t, c = library(), bpe.Codec(bpe.default_vocabulary(), cache_words=3)
    for _ in range(2):  # with a full cache too
        for text, mine, theirs in zip(HARD, c.encode_batch(HARD), t.encode_batch(HARD, add_special_tokens=False)):
            assert mine.tolist() == theirs.ids
            assert c.decode(mine) == t.decode(theirs.ids, skip_special_tokens=False)
    got = collect(bpe.bpe_digests(nasty))
    want = []
    for i, text, *_ in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_packing(nasty):
    encode, t = packing.encoder(bpe.default_vocabulary()), library()
    for text in HARD:
        assert encode(text) == t.encode(text, add_special_tokens=False).ids
    rows = packing.pack(nasty).toPandas().sort_values(["sequence_id", "offset"])
    sums = rows.groupby("sequence_id")["length"]
    assert sums.sum().max() <= packing.CAPACITY and (sums.cumsum() - rows["length"] == rows["offset"]).all()
    want = Counter()
    for i, text, *_ in ROWS:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, packing.END], "<u4")
        for k, (s, n) in enumerate(packing.piece_bounds(len(ids), packing.CAPACITY)):
            want[(i if i is not None else -1, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
    assert Counter(zip(rows.doc_id.fillna(-1).astype(int), rows.piece, rows.start, rows.length, rows.ids_crc32)) == want


def test_plan_uses_every_piece_once():
    rnd = random.Random(2)
    for _ in range(60):
        cap = rnd.choice([5, 10, 50, 1024])
        counts = Counter()
        for _ in range(rnd.randrange(0, 120)):
            counts[rnd.randrange(1, cap + 1)] += rnd.randrange(1, 50)
        used = Counter()
        for pattern, n in packing.plan(counts, cap):
            assert n > 0 and sum(pattern) <= cap
            for x in pattern:
                used[x] += n
        assert used == counts
    assert sum(n for _, n in packing.plan({600: 7, 300: 7, 100: 7, 24: 7}, 1024)) == 7
    assert packing.piece_bounds(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)]


# -- 9 --------------------------------------------------------------------------------------------
def test_transport_streams_round_trip(nasty):
    for n in [0, 1, 575, 576, 577, 1152, 32_256, 32_257, 100_000, *range(170, 200)]:
        _, payload = media_ts.padded("x" * n)
        data = media_ts.mux(payload)
        s = media_ts.demux(data)
        assert s.payload == payload and s.continuity_errors == 0 and s.programs == {1: media_ts.PMT_PID}
        assert s.pts == [k * media_ts.TICKS for k in range(len(s.pts))] and len(s.random_access) == len(s.pts)
    lost = data[: 188 * 5] + data[188 * 6 :]
    assert len(data) < 188 * 8 or media_ts.demux(lost).continuity_errors == 1
    for bad in (b"", data[:-1], b"\0" + data[1:], data[:10] + b"\xff" + data[11:]):
        with pytest.raises(ValueError):
            media_ts.demux(bad)
    got = collect(media_ts.media_digests(nasty))
    for (i, n, size, sha, tail, *_), (_, text) in zip(got, sorted([r[:2] for r in ROWS], key=lambda r: repr(r[:1]))):
        if i not in (None, 7):
            n2, p = media_ts.padded(dict((r[0], r[1]) for r in ROWS)[i])
            assert (n, size, sha, tail) == (n2, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


# -- 2, 8 and SQL ---------------------------------------------------------------------------------
def plain(d):
    one = lambda x: None if pd.isna(x) else round(float(x), 9) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    cols = sorted(d.columns)
    return cols, sorted(repr(tuple(one(x) for x in r)) for r in d[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    assert plain(queries.QUERIES[name](spark, DATA).toPandas()) == plain(con.sql(queries.ORACLES[name]).df())


def test_license_scan(spark, nasty):
    got = {r["doc_id"]: r for r in license_scan.license_scan(nasty).collect()}
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"], got[3]["base_labels"]) == (1, 1, 1, "mit")
    assert (got[4]["n_words"], got[4]["labels"], got[4]["score"], got[4]["first_word"]) == (0, "", 0.0, None)
    texts = ["x\nLicensed under CC BY-NC 4.0. Next", "a general, PUBLIC\nlicense; and apache license", "summit license", "The work is licensed under the GNU General Public License version 3"]
    got = [r for r in license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [r["labels"] for r in got] == ["CC-BY-NC-4.0", "apache,gpl", "", "GPL-3.0,gpl"]
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (2, 1, 5)


def test_license_scan_over_line_and_sentence_ends(spark):
    texts = [
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that",
        "/* This Source Code Form is subject to the terms of the Mozilla Public\r\n * License, v. 2.0. If a copy of the MPL\r\n */",
        "x " * 500 + "\n# Licensed\n# under\n# CC BY-NC\n# 4.0\n" + "y " * 500,
        # words of a template that stand far from each other are no notice
        ("licensed under" + " x" * 50) * 2 + " cc by nc" + " x" * 50 + " 4 0",
    ]
    got = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r["labels"], r["score"]) for r in got] == [("BSD-3-Clause", 1.0), ("MPL-2.0", 1.0), ("CC-BY-NC-4.0", 1.0), ("", 0.0)]


def test_license_scan_on_near_misses(spark):
    cases = {
        "released under the Apache License": "apache",
        "licensed under CC BY 4.0": "",
        "licensed under CC BY-NC 3.0": "",
        "licensed under CC BY-NC-SA 4.0": "",
        "licensed under the MIT License version 2.0": "MIT,mit",
        "released under the MIT (Expat) License": "MIT",
        "this work is licensed under the GNU General Public License version 2": "gpl",
        "this work is licensed under the GNU General Public License version 2. See section 3": "gpl",
        "this work is licensed under the GNU Lesser General Public License version 3": "gpl",
        "this work is licensed under the GNU General Public License v3": "GPL-3.0,gpl",
        "Licensed under the Apache License, Version 1.1, for 2 years": "apache",
        "Licensed under the Apache License, Version 1.1, or the GPL, version 2": "apache",
        "this work is licensed under the GNU General Public License, either version 2 or version 3": "GPL-3.0,gpl",
        "Licensed under the Apache License 2.0": "Apache-2.0,apache",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1, clause 2.0": "",
    }
    got = license_scan.license_scan(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert dict(zip(cases, (r["labels"] for r in got))) == cases


def test_license_runs_against_brute_force(spark):
    rng = random.Random(5)
    words = license_scan.vocabulary(license_scan.TEMPLATES)
    texts = []
    for _ in range(150):
        t = rng.choice(list(license_scan.TEMPLATES.values())).split()
        spaced = [x for w in t if rng.random() < 0.9 for x in [w.upper(), *rng.choices([*words, "x"], k=rng.choice([0, 0, 0, 1, 8]))]]
        texts.append("".join(w + rng.choice([" ", " ", "\n", ". ", "\n\n * "]) for w in spaced))

    def brute(text):
        ws, out = re.findall("[0-9a-z]+", text.lower()), {}
        for label, t in license_scan.TEMPLATES.items():
            n, span = set(t.split()), license_scan.SPAN * len(t.split())
            runs = [ws[i : i + span] for i in range(len(ws))]
            marked = [r for r in runs if all(any(f" {p} " in f" {' '.join(r)} " for p in ps) for ps in license_scan.MARKS.get(label, []))]
            best = max((len(n & set(r)) for r in marked), default=0)
            if best >= license_scan.THRESHOLD * len(n) - 1e-9:
                out[label] = best / len(n)
        return out

    got = license_scan.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = [brute(t) for t in texts]
    assert 20 < sum(map(bool, want)) < 150
    for r in got:
        labels = set(r["labels"].split(",")) - {"", *license_scan.BASE.values()}
        assert labels == set(want[r["doc_id"]])
        assert r["score"] == (1.0 if r["n_base"] else max(want[r["doc_id"]].values(), default=0.0))


def test_chat_pairs(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (1, 3, "assistant", "b"), (2, 0, "user", "hi"), (2, 1, "assistant", "c"), (3, 0, "user", None), (None, 0, None, "x"), (None, 0, None, "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = {(r["chosen_id"], r["rejected_id"]): r for r in chat_format.format_pairs(chat_format.preference_pairs(df)).collect()}
    r = out[(1, 2)]
    assert r["prompt_turns"] == 1 and r["prompt"] == "<|im_start|>user\nhi<|im_end|>\n"
    assert [r["chosen"][s["start"] : s["end"]] for s in r["chosen_spans"]] == ["a<|im_end|>", "b<|im_end|>"]
    assert [r["rejected"][s["start"] : s["end"]] for s in r["rejected_spans"]] == ["c<|im_end|>"]
    assert set(out) == {(1, 2), (3, 3), (None, None)} and out[(None, None)]["prompt_turns"] == 2
    assert chat_format.preference_pairs(df.limit(0)).count() == 0


# -- 3, 10 ----------------------------------------------------------------------------------------
@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_language_id_on_held_out_rows(spark):
    sf = DATA.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.op3_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97 and len(got) > 250


def test_language_id_edges(nasty):
    got = {r["doc_id"]: r for r in language_id.predict(nasty, language_id.fit(nasty)).collect()}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} >= {4, 5, 6, 10}
    assert got[4]["score"] == 0.0 and all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language_id.predict(nasty, language_id.fit(nasty.limit(0))).collect()} == {"und"}


def test_temperature_calibrates():
    rng = np.random.default_rng(3)
    z = rng.normal(size=(4000, 3))
    y = np.array([rng.choice(3, p=language_id.softmax(r)) for r in z])
    assert abs(language_id.temperature(z * 4, y) - 4) < 0.6


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_quality_on_held_out_rows(spark):
    sf = DATA.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.op10_quality(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95 and (got.predicted == (got.score >= 0.7)).all()


def test_trees_and_quality_edges(spark, nasty):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 1] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    trees = quality.boost(x, y)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.97
    slow = []  # the same trees, walked one node at a time
    for r in x[:50]:
        total = trees.base
        for t in range(len(trees.feature)):
            k = 0
            for _ in range(trees.depth):
                k = 2 * k + 1 + int(r[trees.feature[t, k]] > trees.cut[t, k])
            total += trees.value[t, k]
        slow.append(total)
    assert np.allclose(slow, trees.margin(x[:50]))
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (9, None)], "doc_id long, quality int")
    out = quality.score(nasty, quality.fit(nasty, labels))
    assert out.count() == len(ROWS) and all(0 <= r["score"] <= 1 for r in out.collect())
    assert quality.score(nasty, quality.fit(nasty, labels.limit(0))).count() == len(ROWS)


# -- empty tables ---------------------------------------------------------------------------------
def test_empty_tables(none):
    for f in (exact_dedup.exact_dedup, near_dedup.near_dedup, suffix_dedup.dedup_report, suffix_dedup.remove_repeats, bpe.bpe_digests, bpe.encode_decode, packing.pack, license_scan.license_scan, media_ts.media_digests, media_ts.store_streams):
        assert f(none).count() == 0


# -- methods ---------------------------------------------------------------------------------------
def test_exact_dedup_over_many_runs(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["same text", f"text {rnd.randrange(40)}", f"own {i}"])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(13)
    for fan_in in (None, 2, 4):
        assert collect(exact_dedup.exact_dedup(df, fan_in=fan_in)) == brute_exact(rows)


def test_bpe_of_one_very_long_word():
    rnd = random.Random(6)
    t, c = library(), bpe.Codec(bpe.default_vocabulary())
    words = ["".join(rnd.choice(letters) for _ in range(200_000)) for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "a", "aé漢")] + ["the" * 50_000]
    for word, ids in zip(words, c.encode_batch(words)):
        assert ids.tolist() == t.encode(word, add_special_tokens=False).ids
        assert c.decode(ids) == word


def test_bpe_of_words_of_every_length():
    rnd = random.Random(7)
    t, c = library(), bpe.Codec(bpe.default_vocabulary())
    words = ["".join(rnd.choice("abenrsthio") for _ in range(n)) for n in range(1, 120) for _ in range(5)]
    for word, ids in zip(words, c.encode_batch(words)):
        assert ids.tolist() == t.encode(word, add_special_tokens=False).ids


def fewest_bins(pieces, cap):
    """The fewest sequences by trying all subsets."""
    n = len(pieces)
    best = [(n + 1, 0)] * (1 << n)
    best[0] = (0, cap)  # sequences in use, and how full the last one is
    for mask in range(1 << n):
        used, full = best[mask]
        for i in range(n):
            if not mask >> i & 1:
                step = (used, full + pieces[i]) if full + pieces[i] <= cap else (used + 1, pieces[i])
                best[mask | 1 << i] = min(best[mask | 1 << i], step)
    return best[-1][0]


def test_plan_against_all_packings():
    rnd = random.Random(3)
    over = 0
    for _ in range(150):
        cap = rnd.randrange(4, 30)
        pieces = [rnd.randrange(1, cap + 1) for _ in range(rnd.randrange(1, 10))]
        got, least = sum(n for _, n in packing.plan(Counter(pieces), cap)), fewest_bins(pieces, cap)
        assert least <= got <= least + 1
        over += got - least
    assert over <= 3


def test_triple_sums_are_indexed():
    rnd = random.Random(4)
    for cap in (7, 20, 60):
        have = np.array([0] + [rnd.randrange(0, 3) for _ in range(cap)])
        index = packing._Index(have, cap)
        lengths = np.flatnonzero(have).tolist()
        for gap in range(1, cap):
            want = {(a, b, c) for a in lengths for b in lengths for c in lengths if a >= b >= c and a + b + c == gap}
            assert set(index.triples(gap)) == want


def test_encoder_asks_whether_ids_follow_the_merges(tmp_path):
    import json

    spec = json.load(open(bpe.default_vocabulary(), encoding="utf-8"))
    assert packing.follows_ids(spec)
    vocab = spec["model"]["vocab"]
    swap = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"][:2]]
    a, b = ("".join(m.split(" ")) for m in swap)
    vocab[a], vocab[b] = vocab[b], vocab[a]
    assert not packing.follows_ids(spec)
    path = str(tmp_path / "other.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    for text in ["the man in the hat, and another one", ""]:
        assert packing.encoder(path)(text) == t.encode(text, add_special_tokens=False).ids


# -- transport streams by an independent reader -----------------------------------------------------
def plain_reader(data):
    """Packet by packet, as the standard lays them out: payload, time stamps, random-access packet numbers, clocks."""
    payload, pts, access, clocks, last = b"", [], [], [], None
    held = None

    def close(pes):
        nonlocal payload
        if pes:
            assert pes[:3] == b"\0\0\1" and pes[6] >> 6 == 2
            bits = "".join(f"{b:08b}" for b in pes[9:14])
            assert bits[:4] == "0010" and bits[7] == bits[23] == bits[39] == "1"
            pts.append(int(bits[4:7] + bits[8:23] + bits[24:39], 2))
            payload += pes[9 + pes[8] : 6 + int.from_bytes(pes[4:6], "big")]

    for k in range(0, len(data), 188):
        p = data[k : k + 188]
        pid = int.from_bytes(p[1:3], "big") & 0x1FFF
        if pid != media_ts.DATA_PID:
            continue
        assert last is None or p[3] & 15 == (last + 1) % 16
        last = p[3] & 15
        at = 4
        if p[3] & 0x20:
            at = 5 + p[4]
            if p[4] and p[5] & 0x40:
                access.append(k // 188)
            if p[4] and p[5] & 0x10:
                bits = "".join(f"{b:08b}" for b in p[6:12])
                clocks.append(int(bits[:33], 2) * 300 + int(bits[39:], 2))
        if p[1] & 0x40:
            close(held)
            held = b""
        held += p[at:]
    close(held)
    return payload, pts, access, clocks


def test_streams_against_a_plain_reader(spark):
    texts = {i: "é" * n for i, n in enumerate([0, 1, 300, 16_128, 16_129, 500_000])} | {99: None}
    got = {r["doc_id"]: r for r in media_ts.media_digests(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    columns = {r["doc_id"]: r for r in media_ts.store_streams(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, t in texts.items():
        n, payload = media_ts.padded(t)
        data = bytes(columns[i]["media"])
        back, pts, access, clocks = plain_reader(data)
        assert back == payload and clocks == [x * 300 for x in pts]
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"], r["pts"], r["random_access"]) == (len(data), hashlib.sha256(data).hexdigest(), pts, access)
        s = media_ts.demux(data)
        assert (s.payload, s.pts, s.random_access, [c for _, c in s.clock], s.bad_sections) == (payload, pts, access, clocks, 0)
        assert r["feature"] == media_ts.describe(s)


def packet(pid, counter, body, start=False, field=None):
    out = bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, (0x20 if field is not None else 0) | (0x10 if body else 0) | counter % 16])
    out += bytes([len(field)]) + field if field is not None else b""
    return out + body + b"\xff" * (188 - len(out + body))


def test_foreign_streams():
    # two programs; the second one's map goes over several packets, and both tables come again in a later version
    pat = media_ts._section(0, 1, bytes([0, 1, 0xE1, 0x00, 0, 7, 0xE2, 0x00]))
    pmt1 = media_ts._section(2, 1, bytes([0xE1, 1, 0xF0, 0, 0x06, 0xE1, 1, 0xF0, 0]))
    pmt7 = media_ts._section(2, 7, bytes([0xE3, 1, 0xF0, 0]) + b"".join(bytes([0x1B, 0xE3, k, 0xF0, 4]) + b"note" for k in range(1, 41)))
    tables = packet(0, 0, b"\0" + pat, True) + packet(0x100, 0, b"\0" + pmt1, True)
    rest = b"\0" + pmt7
    cut = [rest[i : i + 184] for i in range(0, len(rest), 184)]
    tables += b"".join(packet(0x200, k, c, k == 0) for k, c in enumerate(cut))
    s = media_ts.demux(tables)
    assert s.programs == {1: 0x100, 7: 0x200} and set(s.streams) == {0x101, *range(0x301, 0x329)} and s.bad_sections == 0

    def pes(data, stamp):
        return b"\0\0\1\xbd" + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + media_ts._stamp(stamp) + data

    def cut_up(pid, counter, raw):
        room = [raw[i : i + 100] for i in range(0, len(raw), 100)]
        return [packet(pid, counter + k, c, k == 0, b"\0" + b"\xff" * (183 - len(c) - 1)) for k, c in enumerate(room)]

    a, b, c = (bytes([65 + k]) * 450 for k in range(3))
    one, two, other = cut_up(0x101, 0, pes(a, 5)), cut_up(0x101, 5, pes(b, 6)), cut_up(0x301, 3, pes(c, 9))
    mixed = [x for pair in zip(one + two, other + other[:0] + [b""] * 5) for x in pair]
    whole = media_ts.demux(tables + b"".join(mixed))
    assert (whole.payloads[0x101], whole.payloads[0x301], whole.continuity_errors, [u.pts for u in whole.units]) == (a + b, c, 0, [5, 6, 9])
    # a packet sent twice and one without payload are legal
    nothing = packet(0x101, 2, b"", False, b"\x00" + b"\xff" * 182)
    legal = media_ts.demux(tables + b"".join(one[:3] + [one[2], nothing] + one[3:] + two))
    assert (legal.payload, legal.continuity_errors, all(u.complete for u in legal.units)) == (a + b, 0, True)
    # a lost packet is counted, and marks its own elementary packet alone
    lost = media_ts.demux(tables + b"".join(one[:2] + one[3:] + two))
    assert lost.continuity_errors == 1 and [u.complete for u in lost.units] == [False, True] and lost.units[1].data == b
    # a table with a wrong checksum is left out where it comes again
    spoiled = bytearray(packet(0, 15, b"\0" + pat, True))
    spoiled[20] ^= 1
    again = media_ts.demux(bytes(spoiled) + tables + b"".join(one))
    assert again.bad_sections == 1 and again.payload == a
    # a packet marked as damaged is lost
    marked = bytearray(one[1])
    marked[1] |= 0x80
    assert media_ts.demux(tables + one[0] + bytes(marked) + b"".join(one[2:])).continuity_errors == 1


def test_chat_with_a_hot_opening(spark):
    turns = [(i, k, r, t) for i in range(400) for k, r, t in ((0, "user", "hi" if i % 3 else f"own {i}"), (1, "assistant", f"answer {i}"), *([(2, "user", "x" * 3000)] if i == 5 else []))]
    df = spark.createDataFrame([(*t, "k", 7) for t in turns], "conv_id long, turn long, role string, text string, opening string, n int")
    out = {(r["chosen_id"], r["rejected_id"]) for r in chat_format.preference_pairs(df).collect()}
    assert out == {(5, i) for i in range(400) if i % 3 and i != 5} | {(i, i) for i in range(0, 400, 3)}


# -- license texts ----------------------------------------------------------------------------------
def test_license_bodies_in_comments(spark):
    rnd = random.Random(11)
    rows, want = [], []
    for k, (label, text, phrases) in enumerate(license_scan.BODIES):
        needed = {w for p in phrases for w in p.split()}
        words = [w for w in text.split() if rnd.random() > 0.05 or needed & set(license_scan.words_of(w))]
        lines = [" # " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9)]
        rows.append((k, "x = 1\n" * 30 + "\n".join(lines) + "\ny = 2" * 400))
        want.append(label)
    rows.append((None, rows[0][1]))
    rows.append((0, rows[0][1]))
    df = spark.createDataFrame([(*r, "t", "f", 1) for r in rows], "doc_id long, text string, token string, found string, part int")
    got = license_scan.license_scan(df).collect()
    assert len(got) == len(rows)
    for r in got:
        label = want[r["doc_id"] or 0]
        assert label in r["labels"].split(",") and 0.8 <= r["score"] <= 1.0
        text = license_scan.words_of(next(t for i, t in rows if i == r["doc_id"]))
        body = set(license_scan.words_of(next(t for x, t, _ in license_scan.BODIES if x == label)))
        places = [tuple(map(int, p.split("@")[1].split("-"))) for p in r["blocks"].split(",") if p.startswith(label + "@")]
        assert any(len(body & set(text[a:b])) >= 0.8 * len(body) for a, b in places)
    others = {"GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later"}
    for r in got:
        label = want[r["doc_id"] or 0]
        if label in others:
            assert set(r["labels"].split(",")) & others == {label}


def test_license_blocks_against_all_blocks(spark):
    rng = random.Random(12)
    templates = {f"T{k}": " ".join(f"v{rng.randrange(14)}" for _ in range(rng.randrange(3, 9))) for k in range(40)}
    texts = [" ".join(rng.choice([f"v{rng.randrange(14)}", f"u{rng.randrange(4)}"]) for _ in range(rng.randrange(0, 60))) for _ in range(60)]
    for threshold in (0.8, 1.0, 0.5):
        found = license_scan.license_blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), templates, threshold, carry=["doc_id"]).collect()
        got = sorted((r["doc_id"], r["label"], r["first"], r["last"], round(r["part"], 9)) for r in found)
        want = []
        for i, text in enumerate(texts):
            ws = text.split()
            for label, t in templates.items():
                n, span, merged = set(t.split()), license_scan.SPAN * len(t.split()), []
                for at, w in enumerate(ws):
                    part = len(n & set(ws[at : at + span])) / len(n)
                    if w in n and part >= threshold - 1e-9:
                        last = min(at + span, len(ws))
                        if merged and at <= merged[-1][1]:
                            merged[-1] = [merged[-1][0], last, max(part, merged[-1][2])]
                        else:
                            merged.append([at, last, part])
                want += [(i, label, a, b, round(p, 9)) for a, b, p in merged]
        assert got == sorted(want) and want


def test_license_plan_does_not_grow_with_templates(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    sizes = []
    for n in (1, 300):
        plan = license_scan.license_blocks(df, {f"T{k}": f"some words number {k}" for k in range(n)})._jdf.queryExecution().optimizedPlan()
        sizes.append(sum(1 for line in plan.treeString().splitlines() if line.lstrip(" :+-")))
    assert sizes[0] == sizes[1]


# -- 7: hot intervals, long texts, groups -----------------------------------------------------------
def test_suffix_dedup_of_hot_intervals(spark):
    rnd = random.Random(9)
    shared = "A passage of sixty bytes and a bit that very many texts hold"
    rows = [(i, "".join(rnd.choice("abcdefgh") for _ in range(60)) + shared[: rnd.choice([30, 45, 55, 60])] + "".join(rnd.choice("abcdefgh") for _ in range(60))) for i in range(120)]
    rows += [(None, rows[3][1]), (3, rows[4][1]), (500, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_suffix(rows)
    assert sum(r[2] > 0 for r in want) > 30
    for hot in (3, 50, 20_000):
        assert collect(suffix_dedup.dedup_report(df, hot_leaves=hot)) == want


def test_anchors_of_long_texts_come_in_pieces():
    rnd = random.Random(10)
    for n in (0, 49, 50, 999, 1000, 5000):
        text = bytes(rnd.choice(b"abc ") for _ in range(n))
        whole = suffix_dedup.anchors([text], 50, 20)
        for chunk in (100, 333, 1000):
            assert all((a == b).all() for a, b in zip(whole, suffix_dedup.long_anchors(text, 50, 20, chunk)))


def brute_groups(rows, window):
    """All maximal repeats of so many bytes, with their places."""
    raw = [(t or "").encode() for _, t in rows]
    places = {}
    for k, b in enumerate(raw):
        for i in range(len(b)):
            for j in range(i + window, len(b) + 1):
                places.setdefault(b[i:j], []).append((k, i))
    out = set()
    for x, at in places.items():
        before = {raw[k][i - 1] if i else (k, "start") for k, i in at}
        after = {raw[k][i + len(x)] if i + len(x) < len(raw[k]) else (k, "end") for k, i in at}
        if len(at) > 1 and len(before) > 1 and len(after) > 1:
            out |= {(hashlib.md5(x).hexdigest(), len(x), rows[k][0], i, False) for k, i in at}
    return out


def test_repeat_groups_against_brute_force(spark):
    rnd = random.Random(13)
    seg = ["".join(rnd.choice("abc ") for _ in range(rnd.randrange(20, 70))) for _ in range(5)]
    rows = [(i, "".join(rnd.choice([rnd.choice(seg), rnd.choice("xyz") * 2]) for _ in range(rnd.randrange(0, 5)))) for i in range(24)] + [(None, seg[0] + "q" + seg[0]), (77, None), (78, "")]
    for window, gram in ((24, 8), (50, 20)):
        got = suffix_dedup.repeat_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window, gram, 400).collect()
        assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == brute_groups(rows, window) and got
