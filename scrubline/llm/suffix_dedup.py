"""Suffix-array dedup: bytes that an earlier document already holds in a long repeated string.

The suffix array is sparse and partitioned. Of every window of ``window`` bytes the suffix with the
smallest hash of its first ``gram`` bytes (its anchor) is a member, so equal windows have their
anchors at the same place, and the suffixes that share their first ``gram`` bytes (the intervals of
the common-prefix tree at that depth) meet in one partition. There

1. suffixes whose whole surroundings (all windows through the anchor) are equal are one leaf, an entry
   of the array with several members: they are told apart by 96 bits of hash, and each lies in a
   repeat as long as its surroundings;
2. for an interval with different leaves, the surroundings of each leaf's first document are fetched,
   sorted as suffixes, and their common-prefix array is scanned with a stack: every interval of the
   tree is split by left extension the same way, and where a group's left and right extensions are
   both diverse, and together ``window`` bytes or more, it is a maximal repeat with all its places.
   (An interval of two entries is one node; such nodes are compared all at once.)

In both cases the smallest document of a group keeps its bytes and all others lose theirs. A map
task sends only the first document of each leaf it has seen, so a passage that many documents share
shrinks to one row per task before the shuffle. Texts move only to their own spans.

An interval of more than ``HOT_LEAVES`` leaves, a string that very many documents hold between
different neighbours, is not gathered: each of its windows is a row, and the first document of each
window is found by an aggregate that combines before its shuffle. That is exact as well.

``repeat_groups`` gives the maximal repeats themselves, with all their places.
"""

from __future__ import annotations

import hashlib

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, settle, ship, table, text_or_empty
from .wordhash import BASE, BYTE_VALUE, mix, powers, prefix_sums

WINDOW = 50
GRAM = 20
#: Bytes hashed at once, and anchors gathered before a map task sends them.
CHUNK_BYTES = 400_000
FLUSH_ANCHORS = 400_000
#: Leaves of an interval that one worker takes at most; about 1.4 KB and 22 microseconds each.
HOT_LEAVES = 20_000
#: A window is hot if it holds more than this part of all rows, so at most 1/HOT_PART are hot.
HOT_PART = 1 / 256
#: Buckets of suffixes for each shuffle partition; a worker holds one bucket at a time.
BUCKETS_PER_PARTITION = 3
_LAST = np.iinfo(np.int64).max  # stands for a null id
_LOW48 = np.uint64((1 << 48) - 1)


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of x[i : i + width] for every i, by doubling."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchors(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place, gram hash and hash of the surroundings of every anchor of some texts."""
    reach = window - gram
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = reach + np.concatenate([[0], np.cumsum(sizes + reach)])[:-1]
    n = int(sizes.sum()) + reach * (len(texts) + 1)
    gap = b"\0" * reach
    raw = np.frombuffer(gap + b"".join(t + gap for t in texts), np.uint8)
    value = BYTE_VALUE[raw]
    edge = np.zeros(n + 1, np.int8)
    edge[starts] += 1
    np.subtract.at(edge, starts + sizes, 1)
    inside = np.cumsum(edge[:-1]).astype(bool)
    value[~inside] = BYTE_VALUE[256]
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    value *= up[:n]
    np.cumsum(value, out=sums[1:])
    del value, inside
    none = np.empty(0, np.int64)
    if n < window + 2 * reach:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    g = mix((sums[gram:] - sums[:-gram]) * down[: n + 1 - gram])
    least = _slide(g, reach + 1, np.minimum)  # of the window at s
    whole = np.zeros(len(least), bool)
    mark = np.zeros(len(least) + 1, np.int32)
    long = sizes >= window
    mark[starts[long]] += 1
    np.subtract.at(mark, starts[long] + sizes[long] - window + 1, 1)
    whole = np.cumsum(mark[:-1]) > 0
    least[~whole] = 0
    most = _slide(np.concatenate([np.zeros(reach, np.uint64), least, np.zeros(reach, np.uint64)]), reach + 1, np.maximum)
    at = np.flatnonzero((most[: len(g)] == g) & (g > 0))
    left = at - reach
    around = mix((sums[at + window] - sums[left]) * down[left] * np.uint64(BASE) + np.uint64(window))
    doc = np.searchsorted(starts, at, side="right") - 1
    return doc, at - starts[doc], g[at], around


def long_anchors(text: bytes, window: int, gram: int, chunk: int = CHUNK_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of one text of any length, piece by piece: what decides on an anchor lies within two windows of it."""
    margin, parts = 2 * window, []
    for at in range(0, max(1, len(text)), chunk):
        low = max(0, at - margin)
        doc, place, g, around = anchors([text[low : at + chunk + margin]], window, gram)
        mine = (place + low >= at) & (place + low < at + chunk)
        parts.append((doc[mine], place[mine] + low, g[mine], around[mine]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _six(x: np.ndarray) -> np.ndarray:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def _pack(doc: np.ndarray, place: np.ndarray, g: np.ndarray, around: np.ndarray) -> bytes:
    import zstandard

    step = np.diff(doc, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T
    pos = place.astype("<u4").view(np.uint8).reshape(-1, 4).T
    hashes = np.concatenate([_six(g), _six(around)], 1)
    return zstandard.compress(step.tobytes() + pos.tobytes(), 1) + hashes.tobytes()


def _unpack(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    cut = len(blob) - 12 * n
    plain = np.frombuffer(zstandard.decompress(blob[:cut]), np.uint8).reshape(8, n)
    step = np.ascontiguousarray(plain[:4].T).view("<u4").ravel()
    place = np.ascontiguousarray(plain[4:].T).view("<u4").ravel()
    six = np.frombuffer(blob, np.uint8, 12 * n, cut).reshape(n, 2, 6)
    wide = np.zeros((n, 2, 8), np.uint8)
    wide[:, :, :6] = six
    wide = wide.view("<u8")
    return np.cumsum(step.astype(np.int64)), place.astype(np.int64), wide[:, 0, 0], wide[:, 1, 0]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """True where any sorted key differs from the one before."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _per_doc(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Per document number the union of its ranges as rows (low, high)."""
    if not len(doc):
        return []
    order = np.lexsort((high, low, doc))
    doc, low, high = doc[order], low[order], high[order]
    # ranges of one document that touch become one; documents are set apart by a large stride
    stride = np.int64(1) << np.int64(33)
    base = (np.cumsum(_runs(doc)) - 1) * stride
    a, b = low + base, np.maximum.accumulate(high + base)
    new = np.concatenate([[True], a[1:] > b[:-1]])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:] - 1, [len(a) - 1]])
    lo, hi, d = low[first], b[last] - base[last], doc[first]
    cut = np.flatnonzero(_runs(d))
    rows = np.stack([lo, hi], 1).astype("<u4")
    return [(int(d[i]), rows[i:j]) for i, j in zip(cut, [*cut[1:], len(d)])]


_SENT = "bucket int, n int, ids binary, marks binary, body binary"
_SPAN = "doc_id long, mark long, kind int, body binary"


def _sender(window: int, gram: int, buckets: int):
    """Map side: anchors by bucket (n > 0), and spans found within the task (n = 0)."""
    import pyarrow as pa

    reach = window - gram
    names = [x.split()[0] for x in _SENT.split(", ")]
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def flush(ids, marks, parts):
        ids, marks = np.array(ids, np.int64), np.array(marks, np.int64)
        doc, place, g, around = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids[doc], around, g))
        doc, place, g, around = doc[order], place[order], g[order], around[order]
        new = _runs(g, around)
        first = ids[doc][np.flatnonzero(new)[np.cumsum(new) - 1]]
        keep = ids[doc] == first
        rows = []
        # found spans only pass through; dealt out by row, since copies have equal marks
        through = mix(ids.view(np.uint64) + marks.view(np.uint64)) % np.uint64(buckets)
        for d, ranges in _per_doc(doc[~keep], np.maximum(place[~keep] - reach, 0), place[~keep] + window):
            rows.append((int(through[d]), 0, ids[d : d + 1].tobytes(), marks[d : d + 1].tobytes(), ranges.tobytes()))
        doc, place, g, around = doc[keep], place[keep], g[keep], around[keep]
        # anchors have small hashes, being minima; mixed again they spread evenly
        bucket = (mix(g & _LOW48) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((place, doc, bucket))
        doc, place, g, around, bucket = doc[order], place[order], g[order], around[order], bucket[order]
        cut = np.flatnonzero(_runs(bucket))
        for i, j in zip(cut, [*cut[1:], len(bucket)]):
            used, local = np.unique(doc[i:j], return_inverse=True)
            rows.append((int(bucket[i]), int(j - i), ids[used].tobytes(), marks[used].tobytes(), _pack(local, place[i:j], g[i:j], around[i:j])))
        for lo in range(0, len(rows), 5000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + 5000]), types)], names)

    def run(it):
        ids, marks, parts, held = [], [], [], 0

        def add(texts, these_ids, these_marks):
            nonlocal held
            doc, place, g, around = anchors(texts, window, gram) if len(texts) > 1 else long_anchors(texts[0], window, gram)
            parts.append((doc + len(ids), place, g, around))
            held += len(doc)
            ids.extend(_LAST if i is None else i for i in these_ids)
            marks.extend(these_marks)

        for batch in it:
            all_ids = batch.column(0).to_pylist()
            all_marks = batch.column(1).to_pylist()
            texts, size, base = [], 0, 0
            for k, t in enumerate(batch.column(2)):
                raw = t.as_py().encode("utf-8")
                if size and size + len(raw) > CHUNK_BYTES:
                    add(texts, all_ids[base:k], all_marks[base:k])
                    texts, size, base = [], 0, k
                texts.append(raw)
                size += len(raw)
                if size >= CHUNK_BYTES or k == batch.num_rows - 1:
                    add(texts, all_ids[base : k + 1], all_marks[base : k + 1])
                    texts, size, base = [], 0, k + 1
                if held >= FLUSH_ANCHORS:
                    yield from flush(ids, marks, parts)
                    ids, marks, parts, held = [], [], [], 0
        if held:
            yield from flush(ids, marks, parts)

    return run


def _out(rows: list[tuple], names: list[str], types: list) -> "object":
    import pyarrow as pa

    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)


def _leaves(window: int, gram: int, hot: int):
    """Reduce side: spans of equal leaves (kind 0), and requests of intervals with several leaves (kind 1) or very many (kind 2)."""
    import pyarrow as pa

    reach = window - gram
    names, types = ["doc_id", "mark", "kind", "body"], [pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(t):
        rows, parts, ids, marks, have = [], [], [], [], 0
        for n, i, m, body in zip(*(t.column(c).to_pylist() for c in ("n", "ids", "marks", "body"))):
            i, m = np.frombuffer(i, np.int64), np.frombuffer(m, np.int64)
            if not n:
                rows.append((int(i[0]), int(m[0]), 0, body))
                continue
            doc, place, g, around = _unpack(body, n)
            parts.append((doc + have, place, g, around))
            ids.append(i)
            marks.append(m)
            have += len(i)
        if parts:
            ids, marks = np.concatenate(ids), np.concatenate(marks)
            doc, place, g, around = (np.concatenate(x) for x in zip(*parts))
            own = ids[doc]
            order = np.lexsort((own, around, g))
            doc, place, g, around, own = doc[order], place[order], g[order], around[order], own[order]
            cls, leaf = _runs(g), _runs(g, around)
            leaf_at, cls_at = np.flatnonzero(leaf), np.flatnonzero(cls)
            leaf_of, cls_of = np.cumsum(leaf) - 1, np.cumsum(cls) - 1
            first = own[leaf_at][leaf_of] == own
            rest = ~first
            for d, ranges in _per_doc(doc[rest], np.maximum(place[rest] - reach, 0), place[rest] + window):
                rows.append((int(ids[d]), int(marks[d]), 0, ranges.tobytes()))
            leaves = np.bincount(cls_of[leaf_at], minlength=len(cls_at))
            several = (leaves > 1) & (np.minimum.reduceat(own, cls_at) != np.maximum.reduceat(own, cls_at))
            for kind, wanted in ((1, several & (leaves <= hot)), (2, several & (leaves > hot))):
                ask = np.flatnonzero(first & wanted[cls_of])
                ask = ask[np.lexsort((place[ask], doc[ask]))]
                for part in np.split(ask, np.flatnonzero(_runs(doc[ask]))[1:]) if len(ask) else []:
                    d = doc[part[0]]
                    rows.append((int(ids[d]), int(marks[d]), kind, np.stack([place[part].astype("<u8"), g[part].astype("<u8")], 1).tobytes()))
        return _out(rows, names, types)

    return run


_AROUND = "bucket int, g long, doc_id long, mark long, place int, low int, high int, around binary"


def _fetcher(window: int, gram: int, buckets: int):
    """Cuts the surroundings of requested suffixes out of their texts."""
    import pyarrow as pa

    reach, size = window - gram, 2 * window - gram
    names = [x.split()[0] for x in _AROUND.split(", ")]

    def run(it):
        for batch in it:
            rows = []
            for doc_id, mark, text, bodies in zip(*(c.to_pylist() for c in batch.columns)):
                raw = np.frombuffer(b"\0" * reach + text.encode("utf-8") + b"\0" * reach, np.uint8)
                n = len(raw) - 2 * reach
                asks = np.concatenate([np.frombuffer(b, "<u8").reshape(-1, 2) for b in bodies])
                place = asks[:, 0].astype(np.int64)
                around = np.lib.stride_tricks.sliding_window_view(raw, size)[place]
                low, high = np.maximum(reach - place, 0), np.minimum(n - place + reach, size)
                rows.append((asks[:, 1], np.full(len(place), doc_id), np.full(len(place), mark), place, low, high, around))
            if not rows:
                continue
            g, doc_id, mark, place, low, high, around = (np.concatenate(x) for x in zip(*rows))
            bucket = (mix(g) % np.uint64(buckets)).astype(np.int32)
            for lo in range(0, len(g), 50_000):
                s = slice(lo, lo + 50_000)
                flat = pa.py_buffer(np.ascontiguousarray(around[s]).tobytes())
                k = len(g[s])
                column = pa.Array.from_buffers(pa.binary(size), k, [None, flat]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[s]), pa.array(g[s].astype(np.int64)), pa.array(doc_id[s]), pa.array(mark[s]), *[pa.array(x[s].astype(np.int32)) for x in (place, low, high)], column], names
                )

    return run


def _windows(window: int, gram: int):
    """The windows through requested suffixes: (w, doc_id, mark, at)."""
    import pyarrow as pa

    def run(it):
        for batch in it:
            for doc_id, mark, text, bodies in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode("utf-8")
                place = np.concatenate([np.frombuffer(b, "<u8").reshape(-1, 2) for b in bodies])[:, 0].astype(np.int64)
                at = np.unique(place[:, None] - np.arange(window - gram + 1)[None, :])
                at = at[(at >= 0) & (at + window <= len(raw))].tolist()
                for lo in range(0, len(at), 20_000):
                    part = at[lo : lo + 20_000]
                    k = len(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([raw[i : i + window] for i in part], pa.binary()), pa.array([doc_id] * k, pa.int64()), pa.array([mark] * k, pa.int64()), pa.array(part, pa.int32())], ["w", "doc_id", "mark", "at"]
                    )

    return run


def _hot_spans(docs: DataFrame, asked: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, mark, body) of the windows through the requested suffixes that an earlier document has."""
    import pyarrow as pa

    rows = settle(docs.join(asked, ["doc_id", "mark"]).select("doc_id", "mark", "text", "bodies").mapInArrow(_windows(window, gram), "w binary, doc_id long, mark long, at int"))
    first = settle(rows.groupBy("w").agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    total = rows.count()
    hot = first.where(F.col("n") > max(1.0, total * HOT_PART)).select("w", "owner")
    marked = rows.join(F.broadcast(hot), "w", "left")
    rest = marked.where("owner is null").drop("owner").join(first.select("w", "owner"), "w")
    lost = marked.where("owner is not null").unionByName(rest).where("doc_id > owner").groupBy("doc_id", "mark").agg(F.collect_list("at").alias("at"))

    def pack(it):
        for batch in it:
            ends = [np.array(a, np.int64) for a in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.stack([a, a + window], 1).astype("<u4").tobytes() for a in ends], pa.binary())], ["doc_id", "mark", "body"])

    return lost.select("doc_id", "mark", "at").mapInArrow(pack, "doc_id long, mark long, body binary")


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """The length of the common prefix of every row with the one before; 0 for the first."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def intervals(lcp: list[int], least: int):
    """(depth, from, to) of the common-prefix tree's intervals of depth ``least`` or more, by a stack scan.

    ``lcp[i]`` is what entries i-1 and i share; intervals come children first.
    """
    stack: list[tuple[int, int]] = []
    n = len(lcp)
    for i in range(1, n + 1):
        depth = lcp[i] if i < n else 0
        begin = i - 1
        while stack and stack[-1][0] > depth:
            d, begin = stack.pop()
            if d >= least:
                yield d, begin, i
        if (not stack or stack[-1][0] < depth) and depth:
            stack.append((depth, begin))


def maximal_repeats(right: np.ndarray, left: np.ndarray, window: int, least: int = 1):
    """Maximal repeats through the anchor of some suffixes that share it.

    right: bytes from the anchor on; left: bytes before it, nearest first; values differ where a
    text ends. Yields (members, left length, right length) of every group whose members share that
    much on both sides, differ beyond on both, and share ``window`` or more together, ``least`` or more
    to the right.
    """
    order = np.lexsort(right.T[::-1])
    for depth, i, j in intervals(common_prefixes(right[order]).tolist(), max(least, window - left.shape[1])):
        members = order[i:j]
        by_left = members[np.lexsort(left[members].T[::-1])]
        shared = common_prefixes(left[by_left])
        need = window - depth
        if need <= 0:
            yield by_left, 0, depth
        for extent, a, b in intervals(shared.tolist(), max(1, need)):
            yield by_left[a:b], extent, depth


def _trees(window: int, gram: int):
    """Spans of the intervals with several leaves, from their members' surroundings."""
    import pyarrow as pa

    reach, size = window - gram, 2 * window - gram
    names, types = ["doc_id", "mark", "kind", "body"], [pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(t):
        t = t.combine_chunks()
        g, own, mark, place, low, high = (t.column(c).to_numpy() for c in ("g", "doc_id", "mark", "place", "low", "high"))
        own = np.where(np.isnan(own), _LAST, own).astype(np.int64) if own.dtype.kind == "f" else own
        around = np.frombuffer(b"".join(t.column("around").to_pylist()), np.uint8).reshape(-1, size).astype(np.int16)
        # beyond the ends of its text every member differs from all others
        n = len(g)
        spot = np.arange(size)[None, :]
        outside = (spot < low[:, None]) | (spot >= high[:, None])
        order = np.lexsort((place, own, g))
        g, own, mark, place, around, outside = g[order], own[order], mark[order], place[order], around[order], outside[order]
        cut = np.flatnonzero(_runs(g))
        ends = np.concatenate([cut[1:], [n]])
        at = np.concatenate([np.arange(k) for k in ends - cut])  # number within the interval
        around = around.astype(np.int32)
        around[outside] = (256 + at[:, None] + np.zeros((1, size), np.int64))[outside]
        right, left = around[:, reach:], around[:, :reach][:, ::-1]
        span_doc, span_low, span_high = [], [], []

        def lose(i, lo, hi):
            span_doc.append(i)
            span_low.append(place[i] - lo)
            span_high.append(place[i] + hi)

        # two members: the tree is one interval
        pair = cut[ends - cut == 2]
        if len(pair):
            reach_of = lambda x: np.where((x[pair] != x[pair + 1]).any(1), (x[pair] != x[pair + 1]).argmax(1), x.shape[1])
            a, b = reach_of(left), reach_of(right)
            hit = (a + b >= window) & (own[pair] < own[pair + 1])
            lose(pair[hit] + 1, a[hit], b[hit])
        for i, j in zip(cut[ends - cut > 2], ends[ends - cut > 2]):
            for members, lo, hi in maximal_repeats(right[i:j], left[i:j], window):
                members = members + i
                later = members[own[members] > own[members].min()]
                if len(later):
                    lose(later, lo, hi)
        rows = []
        if span_doc:
            who = np.concatenate(span_doc)
            lo, hi = np.concatenate(span_low), np.concatenate(span_high)
            _, doc = np.unique(np.stack([own, mark], 1), axis=0, return_inverse=True)
            doc = doc.ravel()
            back = dict(zip(doc.tolist(), zip(own.tolist(), mark.tolist())))
            rows = [(*back[d], 0, r.tobytes()) for d, r in _per_doc(doc[who], lo, hi)]
        return _out(rows, names, types)

    return run


def removal_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_leaves: int = HOT_LEAVES) -> DataFrame:
    """(doc_id, mark, body): byte ranges to remove, as arrays of little-endian u4 pairs, some per document.

    docs: (doc_id, mark, text), text not null; mark is a hash of the text, which together with the id
    names a row. Null ids come as the largest long. Ranges of one document may overlap.
    """
    spark = docs.sparkSession
    ship(spark)
    buckets = BUCKETS_PER_PARTITION * partitions(spark)
    sent = docs.mapInArrow(_sender(window, gram, buckets), _SENT)
    first = settle(sent.groupBy("bucket").applyInArrow(_leaves(window, gram, hot_leaves), _SPAN))
    asked = lambda kind: first.where(f"kind = {kind}").groupBy("doc_id", "mark").agg(F.collect_list("body").alias("bodies"))
    keyed = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(int(_LAST))))
    around = keyed.join(asked(1), ["doc_id", "mark"]).select("doc_id", "mark", "text", "bodies").mapInArrow(_fetcher(window, gram, buckets), _AROUND)
    second = settle(around.groupBy("bucket").applyInArrow(_trees(window, gram), _SPAN))
    spans = first.where("kind = 0").select("doc_id", "mark", "body").unionByName(second.select("doc_id", "mark", "body"))
    if first.where("kind = 2").isEmpty():
        return spans
    return spans.unionByName(settle(_hot_spans(keyed, asked(2), window, gram)))


_OPEN = "group string, length long, doc_id long, start long, row long, place long"


def _places(window: int, gram: int, right: int, buckets: int, asked: bool):
    """Anchors of texts (all, or the places asked for) with what stands before and after them."""
    import pyarrow as pa

    reach = window - gram + 1
    size = reach + right

    def run(it):
        for batch in it:
            columns = [c.to_pylist() for c in batch.columns]
            for k, (row, doc_id, text) in enumerate(zip(*columns[:3])):
                raw = text.encode("utf-8")
                held = np.frombuffer(b"\0" * reach + raw + b"\0" * right, np.uint8)
                if asked:
                    place = np.array(columns[3][k], np.int64)
                    sums = prefix_sums(np.frombuffer(raw, np.uint8))
                    g = mix((sums[place + gram] - sums[place]) * powers(len(raw) + 1)[1][place])
                else:
                    _, place, g, _ = long_anchors(raw, window, gram)
                step = max(1, 4_000_000 // size)
                for lo in range(0, len(place), step):
                    p, h = place[lo : lo + step], g[lo : lo + step]
                    rows = np.lib.stride_tricks.sliding_window_view(held, size)[p]
                    low, high = np.maximum(reach - p, 0), np.minimum(len(raw) - p + reach, size)
                    columns_out = [(mix(h) % np.uint64(buckets)).astype(np.int32), h.astype(np.int64), np.full(len(p), row, np.int64)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in columns_out]
                        + [pa.array([doc_id] * len(p), pa.int64()), pa.array(p.astype(np.int64)), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array([r.tobytes() for r in rows], pa.binary())],
                        ["bucket", "g", "row", "doc_id", "place", "low", "high", "around"],
                    )

    return run


def _scanned(window: int, gram: int, right: int, before: int):
    """Maximal repeats that share ``before`` or more and less than ``right`` bytes from their anchor on, and places (row not null) of those that share more."""
    import pyarrow as pa

    reach = window - gram + 1
    size = reach + right
    names, types = [x.split()[0] for x in _OPEN.split(", ")], [pa.string(), *[pa.int64()] * 5]

    def run(t):
        t = t.combine_chunks()
        ids = t.column("doc_id").to_pylist()
        g, row, place, low, high = (t.column(c).to_numpy() for c in ("g", "row", "place", "low", "high"))
        raw = np.frombuffer(b"".join(t.column("around").to_pylist()), np.uint8).reshape(-1, size)
        order = np.argsort(g, kind="stable")
        rows = []
        for members in np.split(order, np.flatnonzero(_runs(g[order]))[1:]) if len(order) else []:
            if len(members) < 2:
                continue
            around = raw[members].astype(np.int32)
            spot = np.arange(size)[None, :]
            outside = (spot < low[members][:, None]) | (spot >= high[members][:, None])
            # beyond the ends of its text every member differs from all others
            around[outside] = (256 + np.arange(len(members))[:, None] + np.zeros((1, size), np.int64))[outside]
            after, back = around[:, reach:], around[:, :reach][:, ::-1]
            seen, still = set(), set()
            for found, lo, hi in maximal_repeats(after, back, window, max(1, before)):
                # a repeat has several anchors: the one of its first window, no further in than that, speaks for it
                if lo >= reach:
                    continue
                a, b = (int((x[found] != x[found[0]]).any(0).argmax()) if (x[found] != x[found[0]]).any() else x.shape[1] for x in (back, after))
                key = (lo, hi, tuple(sorted(found.tolist())))
                # the group's own extent, on both sides, must be the one of its node
                if (a, b) != (lo, hi) or key in seen:
                    continue
                seen.add(key)
                one = raw[members[found[0]], reach - lo : reach + hi]
                sums = prefix_sums(one[:window])
                hashes = mix((sums[gram:] - sums[:-gram]) * powers(window + 1)[1][: window + 1 - gram])
                if int(hashes.argmin()) != lo:
                    continue
                if hi == right:
                    still.update(found.tolist())
                    continue
                name = hashlib.md5(one.tobytes()).hexdigest()
                rows += [(name, lo + hi, ids[m], int(place[m]) - lo, None, None) for m in members[found].tolist()]
            rows += [(None, None, None, None, int(row[m]), int(place[m])) for m in members[sorted(still)].tolist()]
        return _out(rows, names, types)

    return run


def repeat_groups(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, context: int = 4 * WINDOW) -> DataFrame:
    """(group, length, doc_id, start, cut): the maximal repeats of ``window`` bytes or more, one row per place.

    A repeat is a string of bytes with two places or more, in one document or several, that differ
    both before and after it; group is its MD5. Repeats of any length come whole, so ``cut`` is false: the first round
    follows strings for ``context`` bytes, and each further one those that are longer, four times as
    far, until none is. Only the places where such a repeat begins go on, so a long repeat costs one
    row a place and round. Null texts count as empty, a null id stays null; rows with one id and text
    are places of their own; an empty table gives no rows; other columns are ignored.

    Every suffix of an interval goes to one worker here, with its surroundings: meant for corpora
    without strings that very many documents share, such as samples or what dedup has left. In a text
    of one short period nearly every place begins a repeat of its own, so rows grow with the square of
    its length.
    """
    spark = docs.sparkSession
    ship(spark)
    buckets = BUCKETS_PER_PARTITION * partitions(spark)
    texts = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("row", F.monotonically_increasing_id()))
    sent = "bucket int, g long, row long, doc_id long, place long, low int, high int, around binary"
    rows, before, right, done = texts.select("row", "doc_id", "text"), 0, max(context, window), None
    while True:
        places = rows.mapInArrow(_places(window, gram, right, buckets, before > 0), sent)
        got = settle(places.groupBy("bucket").applyInArrow(_scanned(window, gram, right, before), _OPEN))
        closed = got.where("row is null").select("group", "length", "doc_id", "start")
        done = closed if done is None else done.unionByName(closed)
        longer = got.where("row is not null")
        if longer.isEmpty():
            return done.select("group", F.col("length").cast("int").alias("length"), "doc_id", "start", F.lit(False).alias("cut"))
        asked = longer.groupBy("row").agg(F.sort_array(F.collect_set("place")).alias("asked"))
        rows, before, right = texts.join(asked, "row").select("row", "doc_id", "text", "asked"), right, 4 * right


def union_ranges(bodies: list[bytes] | None, size: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that some ranges cover, cut at the text's end."""
    if not bodies:
        return []
    r = np.concatenate([np.frombuffer(b, "<u4").reshape(-1, 2) for b in bodies]).astype(np.int64)
    r = r[np.argsort(r[:, 0], kind="stable")]
    low, high = r[:, 0], np.minimum(np.maximum.accumulate(r[:, 1]), size)
    new = np.concatenate([[True], low[1:] > high[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(low) - 1]])
    return [(a, b) for a, b in zip(low[new].tolist(), high[last].tolist()) if a < b]


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def _with_spans(docs: DataFrame, window: int, gram: int, hot_leaves: int = HOT_LEAVES) -> tuple[DataFrame, list[str]]:
    """All columns of the rows (names made unique for the join) with their span bodies."""
    columns = docs.columns
    plain = docs.select(
        *[docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(columns)],
        F.coalesce(docs["doc_id"].cast("long"), F.lit(int(_LAST))).alias("doc_id"),
        F.xxhash64(text_or_empty()).alias("mark"),
    )
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("mark"), text_or_empty().alias("text"))
    spans = removal_spans(slim, window, gram, hot_leaves).groupBy("doc_id", "mark").agg(F.collect_list("body").alias("bodies"))
    return plain.join(spans, ["doc_id", "mark"], "left").drop("doc_id", "mark"), columns


def dedup_report(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_leaves: int = HOT_LEAVES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Null text counts as empty. A null id counts as larger than all others; rows with one id are never
    earlier than each other, so ties lose nothing to each other. Repeated rows give repeated rows; an
    empty table gives none; texts shorter than the window lose nothing, and texts of any length are
    taken whole, in pieces. Other columns are ignored, whatever their names.
    """
    import pyarrow as pa

    joined, columns = _with_spans(docs.select("doc_id", "text"), window, gram, hot_leaves)

    def run(it):
        for batch in it:
            rows = []
            for doc_id, text, bodies in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (text or "").encode("utf-8")
                runs = union_ranges(bodies, len(raw))
                rows.append((doc_id, len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_kept(raw, runs)).hexdigest()))
            if rows:
                types = [pa.int64()] * 4 + [pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.select(F.col("c0").cast("long"), "c1", "bodies").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents, all columns kept, without the bytes that earlier ones hold in repeats.

    Characters of which only some bytes are removed go whole. n_chars, where it is a column, is
    counted anew. A null text stays null; a null id counts as larger than all others, and rows with
    one id lose nothing to each other. Repeated rows stay repeated rows; an empty table gives none.
    """
    import pyarrow as pa

    joined, columns = _with_spans(docs, window, gram)
    text_at = columns.index("text")
    chars_at = columns.index("n_chars") if "n_chars" in columns else None
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns)

    def run(it):
        for batch in it:
            out = []
            for text, bodies in zip(batch.column(text_at).to_pylist(), batch.column(len(columns)).to_pylist()):
                if text is None or not bodies:
                    out.append(text)
                    continue
                raw = text.encode("utf-8")
                out.append(_kept(raw, union_ranges(bodies, len(raw))).decode("utf-8", "ignore"))
            arrays = list(batch.columns[: len(columns)])
            arrays[text_at] = pa.array(out, pa.string())
            if chars_at is not None:
                arrays[chars_at] = pa.array([None if o is None else len(o) for o in out], batch.column(chars_at).type)
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return joined.select(*[f"c{i}" for i in range(len(columns))], "bodies").mapInArrow(run, schema)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))
