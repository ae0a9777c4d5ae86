"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round every adjacent pair inside a word
is looked up by binary search in the sorted pair keys. A word's lowest-ranked pairs merge, not the
very lowest alone: a merge makes a known symbol, and no pair with that symbol ranks below the
symbol's own limit, so all pairs that rank below the least limit of the word's pairs are settled
among themselves, lower rank and then left place first. The array is compacted and words without a
pair leave. So a word of any length takes some hundred rounds. Words recur, so each worker keeps the
ids of words it has met in a cache of bounded size.

The vocabulary file is a parameter; its ``added_tokens`` are cut out of the text first, as the
tokenizers library does with its default settings.
"""

from __future__ import annotations

import hashlib
import json
import threading
from collections.abc import Iterator

import numpy as np
import regex

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table

#: Fixed value: the published pre-tokenization pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_WORDS, CACHE_CHARS = 400_000, 16_000_000
_PAIR = np.uint64(32)
_NONE = np.iinfo(np.int64).max


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> list[str]:
    """The printable letter of every byte: itself if visible in Latin-1, else the next from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, n = {b: chr(b) for b in seen}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(n)
            n += 1
    return [letters[b] for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        spec = json.load(open(path, encoding="utf-8"))
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = _byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        keys = (left << _PAIR) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        # the least rank of a pair that holds the symbol which a merge makes
        lowest = np.full(max(vocab.values()) + 1, _NONE)
        np.minimum.at(lowest, (keys >> _PAIR).astype(np.int64), np.arange(len(keys)))
        np.minimum.at(lowest, (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), np.arange(len(keys)))
        self.limit = lowest[self.merged]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces: list[bytes] = [b""] * size
        for word, i in vocab.items():
            pieces[i] = bytes(value[c] for c in word) if all(c in value for c in word) else word.encode()
        for word, i in self.special.items():
            pieces[i] = word.encode()
        self.length = np.array([len(p) for p in pieces], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.words = regex.compile(PATTERN)
        self.cache_words = cache_words
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = 0
        self.ids = np.empty(1 << 16, np.int32)
        self.offsets = [0]

    # -- encoding ------------------------------------------------------------------------------
    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and the number of ids of each word."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        counts = np.array([len(w) for w in raw], np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(raw)), counts)
        out_sym, out_word = [], []
        while len(sym):
            n = len(sym)
            rank, limit = np.full(n, _NONE), np.full(n, _NONE)
            slot = np.zeros(n, np.int64)
            if n > 1:
                inside = np.flatnonzero(word[1:] == word[:-1])
                key = (sym[inside].astype(np.uint64) << _PAIR) | sym[inside + 1].astype(np.uint64)
                found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[found] == key
                rank[inside[hit]] = self.rank[found[hit]]
                limit[inside[hit]] = self.limit[found[hit]]
                slot[inside[hit]] = found[hit]
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.concatenate([first, [n]]))
            lowest = np.minimum.reduceat(rank, first)
            alive = np.repeat(lowest != _NONE, sizes)
            if not alive.all():
                out_sym.append(sym[~alive])
                out_word.append(word[~alive])
            # never below the lowest rank itself, whatever the vocabulary
            below = np.maximum(np.minimum.reduceat(limit, first), np.minimum(lowest, _NONE - 1) + 1)
            at = self._settled(np.flatnonzero(rank < np.repeat(below, sizes)), rank)
            if len(at):
                sym = sym.copy()
                sym[at] = self.merged[slot[at]]
                alive[at + 1] = False
            sym, word = sym[alive], word[alive]
        if not out_sym:
            return np.empty(0, np.int32), np.zeros(len(raw), np.int64)
        all_sym, all_word = np.concatenate(out_sym), np.concatenate(out_word)
        order = np.argsort(all_word, kind="stable")
        return all_sym[order].astype(np.int32), np.bincount(all_word, minlength=len(raw))

    @staticmethod
    def _settled(at: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Which of the pairs at these places merge: lower rank first, then left to right, none overlapping."""
        chosen = []
        while len(at):
            r = rank[at]
            joined = np.diff(at) == 1
            # a run of one rank (a pair of equal symbols, repeated) merges every second place
            begin = np.flatnonzero(np.concatenate([[True], ~joined | (r[1:] != r[:-1])]))
            size = np.diff(np.concatenate([begin, [len(at)]]))
            end = begin + size - 1
            value = r[begin]
            touch = joined[begin[1:] - 1]
            lower = np.concatenate([[True], ~touch | (value[1:] < value[:-1])]) & np.concatenate([~touch | (value[:-1] < value[1:]), [True]])
            ready = np.repeat(lower, size)
            nth = np.arange(len(at)) - np.repeat(begin, size)
            take = ready & (nth % 2 == 0)
            chosen.append(at[take])
            gone = ready.copy()
            # a taken pair at the edge of its run leaves nothing to the pair beside it
            left = begin[lower]
            beside = left[left > 0] - 1
            gone[beside[joined[beside]]] = True
            right = end[lower & ((size - 1) % 2 == 0)]
            beside = right[right < len(at) - 1]
            gone[beside[joined[beside]] + 1] = True
            at = at[~gone]
        return np.sort(np.concatenate(chosen)) if chosen else at

    def _learn(self, words: list[str]) -> None:
        ids, counts = self.merge_words(words)
        base = self.offsets[-1]
        while len(self.ids) < base + len(ids):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids), np.int32)])
        self.ids[base : base + len(ids)] = ids
        ends = (base + np.cumsum(counts)).tolist()
        first = len(self.offsets) - 1
        self.at.update(zip(words, range(first, first + len(words))))
        self.offsets.extend(ends)

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        if len(self.at) > self.cache_words or self.chars > CACHE_CHARS:
            self._reset()
        split = []
        for text in texts:
            if self.cut is not None and any(s in text for s in self.special):
                words = []
                for part in self.cut.split(text):
                    words.extend([part] if part in self.special else self.words.findall(part))
            else:
                words = self.words.findall(text)
            split.append(words)
        new = list({w: None for words in split for w in words if w not in self.at})
        for w in [w for w in new if w in self.special]:
            self._learn_special(w)
        self.chars += sum(map(len, new))
        self._learn([w for w in new if w not in self.special])
        offsets, at, out = np.array(self.offsets), self.at, []
        for words in split:
            k = np.fromiter(map(at.__getitem__, words), np.int64, len(words))
            begin, size = offsets[k], offsets[k + 1] - offsets[k]
            total = int(size.sum())
            where = np.repeat(begin - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(total)
            out.append(self.ids[where])
        return out

    def _learn_special(self, word: str) -> None:
        base = self.offsets[-1]
        if len(self.ids) < base + 1:
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids), np.int32)])
        self.ids[base] = self.special[word]
        self.at[word] = len(self.offsets) - 1
        self.offsets.append(base + 1)

    # -- decoding ------------------------------------------------------------------------------
    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens too; bytes that are no UTF-8 become U+FFFD."""
        size = self.length[ids]
        total = int(size.sum())
        where = np.repeat(self.start[ids] - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(total)
        return self.bytes[where].tobytes().decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}
_LOCK = threading.Lock()


def codec(path: str) -> Codec:
    """The codec of a worker process."""
    with _LOCK:
        if path not in _CODECS:
            _CODECS[path] = Codec(path)
        return _CODECS[path]


def chunks(texts: list[str], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters together."""
    begin = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def encode_decode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every document; null text counts as empty."""
    return _run(docs, vocabulary, id_col, text_col, digests=False)


def bpe_digests(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, repeated rows and null ids too.

    Null and empty texts have no ids and the digest of nothing. An empty table gives no rows; other
    columns are ignored; a text of any length is encoded whole.
    """
    return _run(docs, vocabulary, id_col, text_col, digests=True)


def _run(docs: DataFrame, vocabulary: str | None, id_col: str, text_col: str, digests: bool) -> DataFrame:
    import pyarrow as pa

    ship(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def batches(it):
        c = codec(path)
        for batch in it:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                got = c.encode_batch(texts[lo:hi])
                ids = batch.column(0).slice(lo, hi - lo)
                back = (c.decode(g) for g in got)
                if digests:
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids,
                            pa.array([len(g) for g in got], pa.int64()),
                            pa.array([hashlib.sha256(g.astype("<u4").tobytes()).hexdigest() for g in got], pa.string()),
                            pa.array([hashlib.sha256(b.encode("utf-8")).hexdigest() for b in back], pa.string()),
                        ],
                        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                    )
                else:
                    flat = pa.array(np.concatenate(got) if got else np.empty(0, np.int32), pa.int32())
                    ends = pa.array(np.concatenate([[0], np.cumsum([len(g) for g in got])]), pa.int32())
                    yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(ends, flat), pa.array(list(back), pa.string())], ["doc_id", "ids", "decoded"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids array<int>, decoded string"
    return slim.mapInArrow(batches, schema)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))
