"""N-gram Jaccard join by prefix filters under several global token orders.

Two sets of a Jaccard similarity of t or more share a token among the first n - ceil(t n) + 1 tokens
of each, whatever the global order of the tokens; so they do under every one of ``ORDERS`` orders.
All orders put tokens that many sets hold last, by the power of two of a count, and differ in how
they hash tokens of one class. Sets that meet under a prefix token of the first order are
candidates; those whose prefixes under another order do not meet, or whose sizes or parity bitmaps
are too far apart, are ruled out, and the rest is verified on full sets.

The counts that order tokens come from all documents: each task counts the tokens of all its
documents and reports those that several of them have; the ``OFTEN`` tokens with the largest sums
are broadcast. Any order gives the same result, so what a count misses costs time, not links.

Prefix tokens are dealt to buckets by hash as packed arrays. In a bucket the sets of a token are cut
where sizes are too far apart to link, and what is left of several sets comes out as a group; many
tokens give the same group, and one of each is kept. Tokens with a count do not go there, as one
bucket would get all their sets; their rows are grouped by key with partial aggregates. Which pairs
are then compared, and how components come of them, is in ``set_links``.
"""

from __future__ import annotations

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import set_links
from .common import settle, ship, table
from .set_links import BITMAP, bitmap, marks, most_similar
from .wordhash import mix, shingles

WORDS, THRESHOLD = 5, 0.8
ORDERS = 3
#: A task counts so many tokens at a time, and reports those that LEAST of their sets have.
CHUNK, LEAST = 1 << 22, 2
#: How many reported tokens are broadcast, 9 bytes each, if their counts come to MOST_RARE.
OFTEN, MOST_RARE = 1 << 19, 4
#: About how many prefix tokens a bucket gets.
BUCKET = 500_000
_U = np.uint64
_SALT = mix(np.arange(1, ORDERS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def prefix_length(n: int, threshold: float) -> int:
    """How many first tokens of n, under any order, hold one of every set that links."""
    t = round(threshold * 1_000_000)
    return n + -(t * n // 1_000_000 if t * n % 1_000_000 == 0 else t * n // 1_000_000 + 1) + 1


def token_class(tokens: np.ndarray, often: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The power of two of each token's count; 0 for tokens without one."""
    if not len(often):
        return np.zeros(len(tokens), np.uint64)
    at = np.minimum(np.searchsorted(often, tokens), len(often) - 1)
    return np.where(often[at] == tokens, classes[at], 0).astype(np.uint64)


def prefixes(s: np.ndarray, threshold: float, often: np.ndarray, classes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The prefix of a sorted set under each order, and the classes of the first one's tokens."""
    p = prefix_length(len(s), threshold)
    kind = token_class(s, often, classes)
    out, first = [], None
    for k in range(ORDERS):
        # a stable sort, so equal places are in the order of the tokens
        order = np.argsort((kind << _U(57)) | (mix(s ^ _SALT[k]) >> _U(7)), kind="stable")[:p]
        out.append(s[order])
        first = kind[order] if k == 0 else first
    return out, first


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """Two kinds of rows: (doc_id, n, m1, m2) of every document, and (n, m1) with ``token`` true, where n documents of a task have the token m1."""
    import pyarrow as pa

    ship(docs.sparkSession)
    names = ["token", "doc_id", "n", "m1", "m2"]

    def run(it):
        held: list[np.ndarray] = []
        seen: set = set()

        def report():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            often = n >= LEAST
            count = int(often.sum())
            none = pa.nulls(count, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(count, bool)), none, pa.array(n[often].astype(np.int64)), pa.array(tokens[often].view(np.int64)), none], names)

        size = 0
        for batch in it:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                n, m1, m2 = [], [], []
                for t in part.column(1).to_pylist():
                    s = shingles(t, words)
                    mark = marks(s)
                    n.append(len(s))
                    m1.append(mark[0])
                    m2.append(mark[1])
                    if len(s) and mark not in seen:  # equal sets are one
                        seen.add(mark)
                        held.append(s)
                        size += len(s)
                    if size >= CHUNK:
                        yield report()
                        held, size = [], 0
                        seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(part.num_rows, bool)), part.column(0), *(pa.array(x, pa.int64()) for x in (n, m1, m2))], names)
        if held:
            yield report()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "token boolean, doc_id long, n long, m1 long, m2 long")


def _often(reports: DataFrame, often: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens with the largest counts, sorted, and their classes."""
    top = reports.groupBy("m1").agg(F.sum("n").alias("n")).where(F.col("n") >= MOST_RARE).orderBy(F.desc("n"), "m1").limit(often).toArrow()
    tokens, n = top.column("m1").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], np.minimum(np.floor(np.log2(np.maximum(n[order], 2))), 100).astype(np.uint8)


def _member_prefixes(docs: DataFrame, rows: DataFrame, often, words: int, threshold: float) -> DataFrame:
    """(id, n, cold, hot, others, map): the first prefix's tokens without and with a count, the other prefixes as 32-bit hashes, the parity bitmap."""
    import pyarrow as pa

    def run(it):
        for batch in it:
            for lo in range(0, batch.num_rows, 500):
                out = []
                for i, s in set_links.own_sets(batch.slice(lo, 500), words):
                    (first, *rest), kind = prefixes(s, threshold, *often.value)
                    others = b"".join(np.sort((t & _U(0xFFFFFFFF)).astype("<u4")).tobytes() for t in rest)
                    out.append((i, len(s), first[kind == 0].tobytes(), first[kind > 0].tobytes(), others, bitmap(s).tobytes()))
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["id", "n", "cold", "hot", "others", "map"])

    return set_links.member_texts(docs, rows).mapInArrow(run, "id long, n long, cold binary, hot binary, others binary, map binary").dropDuplicates(["id"])


def groups(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray, threshold: float) -> list[tuple[int, int, np.ndarray]]:
    """The distinct groups (two names, ids in order) of ids that share a key and may link by their sizes."""
    if not len(keys):
        return []
    order = np.lexsort((ids, sizes, keys))
    keys, ids, sizes = keys[order], ids[order], sizes[order].astype(np.int64)
    # sizes rise within a key: nothing links over a step that is too large
    step = sizes[:-1] * 1_000_000 < round(threshold * 1_000_000) * sizes[1:]
    begin = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | step]))
    count = np.diff(np.concatenate([begin, [len(keys)]]))
    named = ids.astype(np.int64).view(np.uint64)
    names = np.stack([np.add.reduceat(mix(named ^ salt), begin) for salt in _SALT[:2]], 1).view(np.int64)
    several = np.flatnonzero(count > 1)
    if not len(several):
        return []
    first = several[np.unique(names[several], axis=0, return_index=True)[1]]
    return [(int(names[k, 0]), int(names[k, 1]), np.sort(ids[begin[k] : begin[k] + count[k]])) for k in first.tolist()]


def _cold_keys(members: DataFrame, threshold: float) -> DataFrame:
    """(key, id, pivot) of the groups of members that share a token without a count in their first prefix."""
    import pyarrow as pa

    total = members.agg(F.coalesce(F.sum(F.octet_length("cold")), F.lit(0))).first()[0] // 8
    buckets = max(1, total // BUCKET, members.sparkSession.sparkContext.defaultParallelism)

    def deal(it):
        for batch in it:
            for lo in range(0, batch.num_rows, 4000):
                part = batch.slice(lo, 4000)
                rows = part.column(2).to_pylist()
                keys = np.frombuffer(b"".join(rows), np.uint64)
                ids, sizes = (np.repeat(part.column(k).to_numpy(), [len(r) // 8 for r in rows]) for k in (0, 1))
                bucket = (mix(keys) % _U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
                used = np.flatnonzero(edge[1:] > edge[:-1])
                cut = [order[edge[b] : edge[b + 1]] for b in used]
                columns = [pa.array([x[c].tobytes() for c in cut], pa.binary()) for x in (keys, ids, sizes.astype("<u4"))]
                yield pa.RecordBatch.from_arrays([pa.array(used), *columns], ["bucket", "keys", "ids", "sizes"])

    def meet(group):
        keys, ids, sizes = (np.frombuffer(b"".join(group.column(c).to_pylist()), kind) for c, kind in (("keys", np.uint64), ("ids", np.int64), ("sizes", "<u4")))
        got = groups(keys, ids, sizes, threshold)
        return pa.table({"key": pa.array([g[0] for g in got], pa.int64()), "also": pa.array([g[1] for g in got], pa.int64()), "ids": pa.array([g[2] for g in got], pa.list_(pa.int64()))})

    dealt = members.select("id", "n", "cold").mapInArrow(deal, "bucket long, keys binary, ids binary, sizes binary")
    # one group under both names, so a key has one pivot
    distinct = dealt.groupBy("bucket").applyInArrow(meet, "key long, also long, ids array<long>").groupBy("key", "also").agg(F.first("ids").alias("ids"))
    return distinct.select(F.xxhash64("key", "also", F.get("ids", F.lit(0))).alias("key"), F.explode("ids").alias("id"), F.get("ids", F.lit(0)).alias("pivot"))


def _hot_keys(members: DataFrame) -> DataFrame:
    """The same of the tokens with a count; their pivots are as few as the broadcast tokens."""
    import pyarrow as pa

    def run(it):
        for batch in it:
            rows = batch.column(1).to_pylist()
            ids = np.repeat(batch.column(0).to_numpy(), [len(r) // 8 for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(rows), np.int64)), pa.array(ids)], ["key", "id"])

    rows = members.where(F.octet_length("hot") > 0).select("id", "hot").mapInArrow(run, "key long, id long")
    pivots = rows.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot <> last").select("key", "pivot")
    return rows.join(F.broadcast(pivots), "key").select("key", "id", "pivot")


def _filtered(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(a, b, low, open): pairs that sizes, bitmaps and the other orders' prefixes do not rule out are open."""
    import pyarrow as pa

    def meets(x: bytes, y: bytes) -> bool:
        """Whether the prefixes meet under every other order; each half of others is one."""
        x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
        x, y = (np.split(z, ORDERS - 1) for z in (x, y))
        return all(len(np.intersect1d(p, q)) for p, q in zip(x, y))

    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            n1, n2 = (batch.column(i).to_numpy() for i in (2, 3))
            b1, b2 = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u8").reshape(-1, BITMAP // 64) for i in (6, 7))
            most = np.minimum(most_similar(np.bitwise_count(b1 ^ b2).sum(1, dtype=np.int64), n1, n2), np.minimum(n1, n2) / np.maximum(n1, n2))
            may = most >= threshold - 1e-9
            x, y = batch.column(4), batch.column(5)
            for i in np.flatnonzero(may).tolist():
                if not meets(x[i].as_py(), y[i].as_py()):
                    may[i], most[i] = False, min(most[i], threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(1.0 - most), pa.array(may)], ["a", "b", "low", "open"])

    left = members.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("others").alias("o1"), F.col("map").alias("b1"))
    right = members.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("others").alias("o2"), F.col("map").alias("b2"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "n1", "n2", "o1", "o2", "b1", "b2").mapInArrow(run, "a long, b long, low double, open boolean")


def _with_maps(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (id, ...) with n and the bitmap as longs t0, t1, ..."""
    import pyarrow as pa

    names = [f"t{i}" for i in range(BITMAP // 64)]

    def run(it):
        for batch in it:
            if batch.num_rows:
                maps = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i8").reshape(-1, BITMAP // 64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.ascontiguousarray(maps[:, i])) for i in range(len(names)))], ["id", "n", *names])

    wanted = members.select("id", "n", "map").join(rows.select("id").distinct(), "id", "left_semi")
    return rows.join(wanted.mapInArrow(run, "id long, n long, " + ", ".join(f"{x} long" for x in names)), "id")


def ngram_join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, often: int = OFTEN) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Null and empty texts, and texts without words, have no shingles and link with nothing; a text of
    fewer words than a shingle is one shingle. Rows with a null id link with nothing and have a null
    component. Rows that share an id are one document: their links meet. Repeated rows give repeated
    rows and equal sets are linked; a similarity of exactly the threshold links; texts of any length
    are taken whole; an empty table gives none; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    first = settle(_sketches(docs, words))
    sketches = first.where("not token").select("doc_id", "n", "m1", "m2")
    sets = set_links.members(sketches.where("n > 0 and doc_id is not null"))
    sent = spark.sparkContext.broadcast(_often(first.where("token"), often))
    members = settle(_member_prefixes(docs, sets.rows, sent, words, threshold))

    def test(pairs: DataFrame) -> DataFrame:
        guess = settle(_filtered(pairs, members, threshold))
        sure = set_links.verified(guess.where("open"), docs, sets.rows, words, threshold)
        return guess.where("not open").select("a", "b", "low", F.lit(1.0).alias("high"), F.lit(False).alias("linked")).unionByName(sure)

    rows = settle(_cold_keys(members, threshold).unionByName(_hot_keys(members)))
    comps = set_links.find_components(rows, test, lambda r: _with_maps(r, members), lambda x, y: set_links.sizes_and_maps(x, y, threshold), threshold, sets.links)
    return set_links.documents(sketches, sets, comps)


def op12_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
