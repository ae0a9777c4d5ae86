"""Cross-tokenizer alignment by byte-owner arrays.

Both tokenizers cut the same bytes. ``np.repeat`` of token numbers by token lengths tells, for every
byte, which token of A and which of B owns it. Going over the bytes, each new pair of owners is an
overlap of two tokens, a link; where both owners change at once both tokenizations have a cut, and
what lies between two cuts is a group.

How often a pair of ids is linked counts over the whole corpus. Texts are tokenized once: a row keeps
its distinct id pairs and how often it has them as two packed arrays. Pair counts are summed per
task before they are shuffled. The ``FREQUENT`` most frequent pairs, which make up nearly all links,
are broadcast and looked up in the row; the links of all other pairs meet their counts by a join.
"""

from __future__ import annotations

import hashlib
import json
import threading

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, _byte_letters, chunks, default_vocabulary
from .common import settle, ship, table, text_or_empty
from .packing import follows_ids

#: How many id pairs are broadcast, 13 bytes each.
FREQUENT = 1 << 18
#: Bits of an id of B in a pair's number.
B_BITS = 24
#: A task sums the pairs of so many links before it hands them on.
FLUSH = 1 << 22


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """Both tokenizers of a worker: ids of a text, and the bytes of every id."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        value = {c: b for b, c in enumerate(_byte_letters())}
        spec = json.load(open(byte_path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for word, i in vocab.items():
            self.a_bytes[i] = bytes(value[c] for c in word) if all(c in value for c in word) else word.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_size, self.b_size = (np.array([len(x) for x in w], np.int64) for w in (self.a_bytes, self.b_bytes))
        # the ids in decimal, each with what may follow it
        self.text = [f"{i}{c}" for w, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for c in ends for i in range(len(w))]
        self._encode_a = self._by_rank(spec) if follows_ids(spec) else self._by_library(byte_path)

    def _by_rank(self, spec: dict):
        """The tiktoken library merges by id, which is the rank here, and is the faster one."""
        import tiktoken

        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {self.a_bytes[i]: i for w, i in spec["model"]["vocab"].items() if w not in special}
        coder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: map(coder.encode_ordinary, texts)

    @staticmethod
    def _by_library(path: str):
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(path)
        coder.encode_special_tokens = True  # their strings are plain text here
        coder.no_truncation()
        coder.no_padding()
        return lambda texts: (x.ids for x in coder.encode_batch_fast(texts, add_special_tokens=False))

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """The ids of both for each text; None where a text is empty or its bytes do not come out."""
        spaced = [" " + t for t in texts]
        got = zip(texts, spaced, self._encode_a(spaced), self.b.encode(texts, num_threads=1))
        out = []
        for text, whole, a, b in got:
            wanted = whole.encode()
            same = text and b"".join(map(self.a_bytes.__getitem__, a)) == wanted and b"".join(map(self.b_bytes.__getitem__, b)) == wanted
            out.append((a, b) if same else None)
        return out


def owners(sizes: np.ndarray) -> np.ndarray:
    """Which token every byte belongs to."""
    return np.repeat(np.arange(len(sizes)), sizes)


def align(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of A, tokens of B, cut): the overlaps in order, and whether both owners change before each."""
    oa, ob = owners(a_sizes), owners(b_sizes)
    first = np.ones(min(1, len(oa)), bool)
    new_a, new_b = (np.concatenate([first, o[1:] != o[:-1]]) for o in (oa, ob))
    at = np.flatnonzero(new_a | new_b)
    return oa[at], ob[at], (new_a & new_b)[at]


def group_text(pair: Pair, a: np.ndarray, b: np.ndarray, links_a: np.ndarray, links_b: np.ndarray, cut: np.ndarray) -> str:
    """The groups as a1,a2|b1;a3|b2,b3."""
    group = np.cumsum(cut) - 1
    of_a, of_b = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
    of_a[links_a], of_b[links_b] = group, group
    n = int(group[-1]) + 1
    # every token stands after those of the groups before, and B's after A's of its own group
    before_b = np.concatenate([[0], np.cumsum(np.bincount(of_b, minlength=n))])
    upto_a = np.cumsum(np.bincount(of_a, minlength=n))
    ends_a, ends_b = (np.concatenate([g[1:] != g[:-1], [True]]) for g in (of_a, of_b))
    out = np.empty(len(a) + len(b), np.int64)
    out[np.arange(len(a)) + before_b[of_a]] = a + ends_a * len(pair.a_bytes)
    out[np.arange(len(b)) + upto_a[of_b]] = b + ends_b * len(pair.b_bytes) + 2 * len(pair.a_bytes)
    return "".join(map(pair.text.__getitem__, out.tolist()))[:-1]


_PAIRS: dict[tuple[str, str], Pair] = {}
_LOCK = threading.Lock()


def tokenizers(byte_path: str, piece_path: str) -> Pair:
    """The tokenizers of a worker process."""
    with _LOCK:
        key = (byte_path, piece_path)
        if key not in _PAIRS:
            _PAIRS[key] = Pair(*key)
        return _PAIRS[key]


def alignments(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a_ids, b_ids, links array<struct<a:int,b:int,cut:boolean>>) of every document; links name tokens by their place.

    Arrays are empty where a text is null or empty, or where the bytes of a tokenization are not those of the text.
    """
    import pyarrow as pa

    ship(docs.sparkSession)
    paths = byte_path or default_vocabulary(), piece_path or default_pieces()

    def run(it):
        pair = tokenizers(*paths)
        for batch in it:
            texts = batch.column(1).to_pylist()
            for lo, hi in chunks(texts, 200_000):
                rows = []
                for doc, got in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), pair.encode(texts[lo:hi])):
                    a, b = got or ([], [])
                    la, lb, cut = align(pair.a_size[a], pair.b_size[b]) if got else ((), (), ())
                    rows.append({"doc_id": doc, "a_ids": list(a), "b_ids": list(b), "links": [{"a": int(x), "b": int(y), "cut": bool(z)} for x, y, z in zip(la, lb, cut)]})
                yield pa.RecordBatch.from_pylist(rows, schema)

    link = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cut", pa.bool_())])
    schema = pa.schema([("doc_id", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())), ("links", pa.list_(link))])
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, links array<struct<a:int,b:int,cut:boolean>>")


def _packed(docs: DataFrame, paths: tuple[str, str], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): pairs are sorted numbers of id pairs (8 bytes each), times how often each is linked (4 bytes)."""
    import pyarrow as pa

    ship(docs.sparkSession)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(it):
        pair = tokenizers(*paths)
        for batch in it:
            texts = batch.column(1).to_pylist()
            for lo, hi in chunks(texts, 200_000):
                rows = []
                for got in pair.encode(texts[lo:hi]):
                    if got is None:
                        rows.append((0, 0, 0, 0, "", b"", b""))
                        continue
                    a, b = np.array(got[0], np.int64), np.array(got[1], np.int64)
                    la, lb, cut = align(pair.a_size[a], pair.b_size[b])
                    text = group_text(pair, a, b, la, lb, cut)
                    numbers, times = np.unique(a[la] << B_BITS | b[lb], return_counts=True)
                    rows.append((len(a), len(b), int(cut.sum()), len(la), hashlib.sha256(text.encode()).hexdigest(), numbers.tobytes(), times.astype("<u4").tobytes()))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def _joined(column, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column in one array, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind), np.array([len(r) for r in rows], np.int64) // np.dtype(kind).itemsize


def _pair_counts(packed: DataFrame) -> DataFrame:
    """(pair, n): how many links of all rows hold each id pair."""
    import pyarrow as pa

    def run(it):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed():
            pairs, back = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, back, np.concatenate([t for _, t in held]))
            return pairs, n

        size = 0
        for batch in it:
            held.append((_joined(batch.column(0), "<i8")[0], _joined(batch.column(1), "<u4")[0].astype(np.int64)))
            size += len(held[-1][0])
            if size >= FLUSH:
                held = [summed()]
                size = len(held[0][0])
                if size >= FLUSH // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["pair", "n"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in summed()], ["pair", "n"])

    return packed.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_best(counts: DataFrame) -> DataFrame:
    """Pair counts (pair, n) with ``best``: no other pair of the same id of B has more."""
    b = (F.col("pair") % (1 << B_BITS)).alias("b")
    # one row per id of B, so no more than the vocabulary has
    most = counts.groupBy(b).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _looked_up(packed: DataFrame, frequent) -> tuple[DataFrame, DataFrame]:
    """Rows with n_best and count_sum over the frequent pairs, and (row, pair, times) of all other pairs."""
    import pyarrow as pa

    def known(rows):
        """Numbers, times, row of each, its place among the frequent pairs, and whether it is one."""
        pairs, size = _joined(rows.column(1), "<i8")
        times = _joined(rows.column(2), "<u4")[0].astype(np.int64)
        table = frequent.value[0]
        place = np.minimum(np.searchsorted(table, pairs), max(0, len(table) - 1))
        return pairs, times, np.repeat(np.arange(rows.num_rows), size), place, (table[place] == pairs if len(table) else np.zeros(len(pairs), bool))

    def sums(it):
        for batch in it:
            _, times, row, place, hit = known(batch)
            n, best = frequent.value[1:]
            count, top = (np.zeros(batch.num_rows, np.int64) for _ in range(2))
            np.add.at(count, row[hit], times[hit] * n[place[hit]])
            np.add.at(top, row[hit], times[hit] * best[place[hit]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top), pa.array(count), *(batch.column(i) for i in range(3, batch.num_columns))], ["row", "n_best", "count_sum", *REST])

    def others(it):
        for batch in it:
            pairs, times, row, _, hit = known(batch)
            if not hit.all():
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[~hit])), pa.array(pairs[~hit]), pa.array(times[~hit])], ["row", "pair", "times"])

    whole = packed.select("row", "pairs", "times", *REST)
    kinds = dict(packed.dtypes)
    own = ", ".join(f"{c} {kinds[c]}" for c in REST)
    return whole.mapInArrow(sums, f"row long, n_best long, count_sum long, {own}"), whole.select("row", "pairs", "times").mapInArrow(others, "row long, pair long, times long")


REST = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def cross_tokens(docs: DataFrame, byte_path: str | None = None, piece_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document, repeated rows and null ids too.

    Null and empty texts, and texts whose bytes one of the tokenizations does not give back, have
    zeros and an empty groups_sha256. Counts are over all rows, repeated ones counting each; pairs of
    one id of B with equal counts are best together. A text of any length is aligned whole. An empty
    table gives none; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    paths = byte_path or default_vocabulary(), piece_path or default_pieces()
    packed = settle(_packed(docs, paths, id_col, text_col)).withColumn("row", F.monotonically_increasing_id())
    counts = settle(with_best(_pair_counts(packed)))
    top = counts.orderBy(F.desc("n"), "pair").limit(frequent).toArrow()
    pairs, n, best = (top.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pairs)
    sent = spark.sparkContext.broadcast((pairs[order], n[order], best[order].astype(np.int64)))
    known, others = _looked_up(packed, sent)
    if len(pairs) < frequent:  # all pairs there are
        return known.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    rest = others.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    whole = known.join(rest, "row", "left")
    return whole.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"), "groups_sha256"
    )


def op11_cross_tokens(spark, sf_dir: str) -> DataFrame:
    return cross_tokens(table(spark, sf_dir, "documents"))
