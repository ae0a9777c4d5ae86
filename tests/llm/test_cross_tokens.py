"""Cross-tokenizer alignment against a plain sweep over both tokenizations."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from scrubline.llm import cross_tokens as C

TEXTS = [
    (1, "The quick brown fox can't jump, naïve 😀 12345  twice\n\n\tover <|endoftext|> <s> it."),
    (2, "The quick brown fox can't jump, naïve 😀 12345  twice\n\n\tover <|endoftext|> <s> it."),
    (3, None),
    (4, ""),
    (5, " "),
    (6, "a▁b"),
    (7, "\x00 nul \x7f del ​ zero ﬁ ligature Ａ"),
    (8, "word " * 40_000 + "ünï"),
    (None, "id of none"),
    (9, "x"),
    (9, "y"),
    (10, "x" * 3000),
]


def sweep(pair, texts):
    """Rows as the contract has them, token by token."""
    out, count, links = [], Counter(), []
    for t in texts:
        got = pair.encode([t or ""])[0]
        a, b = got or ([], [])
        ends_a, ends_b = np.cumsum([len(pair.a_bytes[x]) for x in a]).tolist(), np.cumsum([len(pair.b_bytes[x]) for x in b]).tolist()
        mine, j = [], 0
        for i, x in enumerate(a):
            begin = ends_a[i - 1] if i else 0
            while ends_b[j] <= begin:
                j += 1
            k = j
            while k < len(b) and (ends_b[k - 1] if k else 0) < ends_a[i]:
                mine.append((x, b[k]))
                k += 1
        groups, ia, ib = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            ja, jb = ends_a.index(cut, ia) + 1, ends_b.index(cut, ib) + 1
            groups.append(",".join(map(str, a[ia:ja])) + "|" + ",".join(map(str, b[ib:jb])))
            ia, ib = ja, jb
        links.append(mine)
        count.update(mine)
        out.append([len(a), len(b), len(groups), len(mine), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return [(*row[:4], sum(count[x] == most[x[1]] for x in mine), sum(count[x] for x in mine), row[4]) for row, mine in zip(out, links)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0, "k", b"p") for i, t in TEXTS], "doc_id long, text string, n_a int, row string, pairs binary").repartition(3)


def rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("frequent", [C.FREQUENT, 7])
def test_equals_sweep(docs, frequent):
    pair = C.tokenizers(C.default_vocabulary(), C.default_pieces())
    want = sorted(((i, *r) for (i, _), r in zip(TEXTS, sweep(pair, [t for _, t in TEXTS]))), key=repr)
    assert rows(C.cross_tokens(docs, frequent=frequent)) == want


def test_bytes_that_do_not_come_out():
    pair = C.tokenizers(C.default_vocabulary(), C.default_pieces())
    assert pair.encode(["", "a▁b"]) == [None, None]
    a, b = pair.encode(["é <|endoftext|> <s>"])[0]
    assert 50256 not in a and 1 not in b
    assert b"".join(pair.a_bytes[i] for i in a) == b"".join(pair.b_bytes[i] for i in b) == " é <|endoftext|> <s>".encode()


def test_alignments_name_tokens(docs):
    pair = C.tokenizers(C.default_vocabulary(), C.default_pieces())
    for r in C.alignments(docs).where("doc_id in (1, 9)").collect():
        assert r["links"][0]["cut"] and {x["a"] for x in r["links"]} == set(range(len(r["a_ids"]))) and {x["b"] for x in r["links"]} == set(range(len(r["b_ids"])))
    got = C.alignments(docs).where("doc_id = 3").first()
    assert got["a_ids"] == [] and got["links"] == []
    assert pair.a_size.min() >= 0


def test_align_random():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        cut = lambda: np.diff(np.concatenate([[0], np.sort(rng.choice(np.arange(1, n + 1), int(rng.integers(1, n + 1)), replace=False)), [n]]))
        a, b = (x[x > 0] for x in (cut(), cut()))
        la, lb, at = C.align(a, b)
        oa, ob = C.owners(a), C.owners(b)
        assert set(zip(la.tolist(), lb.tolist())) == set(zip(oa.tolist(), ob.tolist())) and len(la) == len(set(zip(oa, ob)))
        assert at.sum() == len(set(np.cumsum(a)) & set(np.cumsum(b)))


def test_empty_table(spark):
    assert C.cross_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []
