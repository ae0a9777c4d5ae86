"""Links between sets of shingles: what the near-duplicate operators share.

Documents with equal sets are one member. An operator gives each member keys such that members which
may link meet under a key; here pairs are chosen, and components found.

No group is expanded into all its pairs. Under each key one member is a pivot for all others; most
groups are then one component and done. Where a key still joins several components, a second pivot
follows, and then only pairs of different components that the distances to both pivots, by the
triangle inequality of the Jaccard distance, do not rule out. So no link between different
components is lost, and a group of copies of any size costs a row per member and key.

Components are found by alternating star contraction on DataFrames; nothing but counts comes to the
driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, text_or_empty
from .wordhash import mix, shingles

KEY = ["m1", "m2", "n"]
#: Cells of a set's parity bitmap.
BITMAP = 1024
#: A set is hot if more than this part of all documents has it, so at most 1/HOT are.
HOT = 1 / 256
_U = np.uint64


def marks(s: np.ndarray) -> tuple[np.int64, np.int64]:
    """128 bits that name a set, whatever the order of its members."""
    return mix(s ^ _U(0xE7037ED1A0B428DB)).sum(dtype=np.uint64).astype(np.int64), mix(s + _U(0x8EBC6AF09C88C6E3)).sum(dtype=np.uint64).astype(np.int64)


def bitmap(s: np.ndarray) -> np.ndarray:
    """Which of BITMAP cells an odd number of members falls in, as bytes.

    Two bitmaps differ in at most as many cells as their sets differ in members.
    """
    return np.packbits((np.bincount((s & _U(BITMAP - 1)).astype(np.int64), minlength=BITMAP) & 1).astype(np.uint8), bitorder="little")


def most_similar(apart: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """The largest Jaccard similarity of sets of these sizes with so many members in just one, or more."""
    return np.maximum(n1 + n2 - apart, 0) / np.maximum(n1 + n2 + apart, 1)


def reaches(shared: int, union: int, threshold: float) -> bool:
    """shared / union >= threshold, in integers."""
    return shared * 1_000_000 >= round(threshold * 1_000_000) * union


@dataclass
class Members:
    """``rows``: (id, doc, m1, m2, n, size, ...), one row per distinct set, ``doc`` being the smallest doc_id that has it.

    Where no doc_id has two sets, a member's ``id`` is its ``doc`` and ``links`` is None. Else ids are
    numbers of their own, and ``links`` (a, b) joins the members that share a doc_id.
    """

    rows: DataFrame
    links: DataFrame | None


def members(named: DataFrame, *aggregates) -> Members:
    """The distinct sets of (doc_id, m1, m2, n, ...), ids not null."""
    groups = settle(named.groupBy(*KEY).agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("size"), *aggregates))
    mark = F.struct(*KEY)
    twice = settle(named.groupBy("doc_id").agg(F.min(mark).alias("x"), F.max(mark).alias("y")).where("x <> y").select("doc_id"))
    if twice.isEmpty():
        return Members(groups.withColumn("id", F.col("doc")), None)
    groups = settle(groups.withColumn("id", F.monotonically_increasing_id()))
    met = named.select("doc_id", *KEY).join(twice, "doc_id").distinct().join(groups.select(*KEY, "id"), KEY).select("doc_id", "id")
    star = met.groupBy("doc_id").agg(F.min("id").alias("a"))
    return Members(groups, settle(met.join(star, "doc_id").where("id <> a").select("a", F.col("id").alias("b")).distinct()))


def documents(sketches: DataFrame, sets: Members, comps: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of all rows (doc_id, m1, m2, n); comps (id, comp) name components by members."""
    rows = sets.rows.select(*KEY, "id", "doc", "size")
    label = rows.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    if sets.links is not None:
        least = label.groupBy("comp").agg(F.min("doc").alias("least"))
        label = label.join(least, "comp").withColumn("comp", F.col("least"))
    label = settle(label.select(*KEY, "comp", "size"))
    # rows -> their set's component; the few sets of a large part of all rows are broadcast
    total = sketches.count()
    hot = label.where(F.col("size") > F.lit(max(1.0, total * HOT))).drop("size")
    marked = sketches.where("n > 0 and doc_id is not null").select("doc_id", *KEY).join(F.broadcast(hot), KEY, "left")
    cold = marked.where("comp is null").select("doc_id", *KEY).join(label.drop("size"), KEY)
    linked = marked.where("comp is not null").unionByName(cold).select("doc_id", "n", "comp")
    alone = sketches.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("comp"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))


def member_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, m1, m2, text) of members (id, doc, m1, m2): texts of the doc_id, of which those with the marks are the member's."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), text_or_empty().alias("text"))
    return texts.join(rows.select("id", "doc", "m1", "m2"), "doc").select("id", "m1", "m2", "text")


def own_sets(part, words: int) -> list[tuple[int, np.ndarray]]:
    """(id, set) of the rows of an Arrow batch of ``member_texts`` that have the marks."""
    out = []
    for i, m1, m2, t in zip(*(part.column(k).to_pylist() for k in range(4))):
        s = shingles(t, words)
        if marks(s) == (m1, m2):
            out.append((i, s))
    return out


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, words: int, threshold: float) -> DataFrame:
    """(a, b, low, high, linked) of pairs of members, from their full sets."""
    import pyarrow as pa

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()

    def sets(it):
        for batch in it:
            for lo in range(0, batch.num_rows, 500):
                got = own_sets(batch.slice(lo, 500), words)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in got], pa.int64()), pa.array([s.tobytes() for _, s in got], pa.binary())], ["id", "s"])

    # rows of one doc_id with equal sets give the same
    full = settle(member_texts(docs, rows.join(wanted, "id", "left_semi")).mapInArrow(sets, "id long, s binary").dropDuplicates(["id"]))

    def compare(it):
        for batch in it:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                low, linked = [], []
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = np.sort(np.concatenate([x, y]), kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    union = len(both) - shared
                    low.append(1.0 - shared / union)
                    linked.append(reaches(shared, union, threshold))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(low, pa.float64()), pa.array(low, pa.float64()), pa.array(linked, pa.bool_())], ["a", "b", "low", "high", "linked"])

    right = full.select(F.col("id").alias("b"), F.col("s").alias("y"))
    left = full.select(F.col("id").alias("a"), F.col("s").alias("x"))
    return settle(pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long, low double, high double, linked boolean"))


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable, of all ids in links (a, b), by alternating stars."""
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        # large star: larger neighbours go to the least of the neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = settle(small.where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
        before = now


def _with_components(rows: DataFrame, comps: DataFrame) -> DataFrame:
    return rows.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _split_keys(rows: DataFrame) -> DataFrame:
    """The rows of keys that still hold several components, with each key's second pivot."""
    keys = rows.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.max(F.struct("id", "comp")).alias("p")).where("c1 <> c2")
    return rows.join(keys.select("key", F.col("p.id").alias("second"), F.col("p.comp").alias("second_comp")), "key")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def find_components(rows: DataFrame, test: Callable[[DataFrame], DataFrame], narrow: Callable[[DataFrame], DataFrame], plausible: Callable[[str, str], object], threshold: float, known: DataFrame | None = None) -> DataFrame:
    """(id, comp) of all members with a link.

    rows: (key, id, pivot), with the key's least id as pivot, of keys of two members or more. ``test``
    gives (a, b, low, high, linked) for every given pair: bounds of its distance, and whether it is a
    link. ``narrow`` adds what ``plausible(x, y)``, a join condition that is true for all links, reads.
    ``known``: links (a, b) that hold anyway.
    """

    def grouped(tested: DataFrame) -> DataFrame:
        links = tested.where("linked").select("a", "b")
        return components(links if known is None else links.unionByName(known))

    tested = test(ordered(rows.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b"))))
    comps = grouped(tested)
    rest = settle(_split_keys(_with_components(rows, comps)))
    if rest.isEmpty():
        return comps
    more = rest.where("comp <> second_comp").select(F.col("second").alias("a"), "id").select("a", F.col("id").alias("b"))
    more = ordered(more).join(tested, ["a", "b"], "left_anti")
    tested = tested.unionByName(test(more))
    comps = grouped(tested)
    rest = _split_keys(_with_components(rest.select("key", "id", "pivot"), comps)).drop("second_comp")
    for pivot, name in (("pivot", "1"), ("second", "2")):
        bounds = tested.select("a", "b", F.col("low").alias(f"low{name}"), F.col("high").alias(f"high{name}"))
        rest = rest.withColumns({"a": F.least("id", pivot), "b": F.greatest("id", pivot)}).join(bounds, ["a", "b"], "left").drop("a", "b")
        same = F.col("id") == F.col(pivot)
        rest = rest.withColumns(
            {f"low{name}": F.when(same, 0.0).otherwise(F.coalesce(f"low{name}", F.lit(0.0))), f"high{name}": F.when(same, 0.0).otherwise(F.coalesce(f"high{name}", F.lit(1.0)))}
        )
    rest = rest.select("key", "id", "comp", "low1", "high1", "low2", "high2")
    rest = settle(narrow(rest))
    # under each key the largest component is met by all others, not by itself
    main = rest.groupBy("key", "comp").count().groupBy("key").agg(F.max(F.struct("count", "comp")).alias("m")).select("key", F.col("m.comp").alias("main"))
    rest = rest.join(main, "key")
    x, y = rest.where("comp <> main").alias("x"), rest.alias("y")
    reach = F.lit(1.0 - threshold + 1e-9)
    near = plausible("x", "y")
    for k in "12":
        near = near & (F.col(f"x.low{k}") - F.col(f"y.high{k}") <= reach) & (F.col(f"y.low{k}") - F.col(f"x.high{k}") <= reach)
    once = (F.col("y.comp") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    last = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & once & near)
    last = last.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    last = settle(last)
    if last.isEmpty():
        return comps
    return grouped(tested.unionByName(test(last)))


def sizes_and_maps(x: str, y: str, threshold: float):
    """A join condition by exact bounds: sizes n, and bitmaps as longs t0, t1, ..."""
    cells = [F.bit_count(F.col(f"{x}.t{i}").bitwiseXOR(F.col(f"{y}.t{i}"))) for i in range(BITMAP // 64)]
    sizes = F.least(f"{x}.n", f"{y}.n") >= F.greatest(f"{x}.n", f"{y}.n") * F.lit(threshold - 1e-9)
    return sizes & (sum(cells[1:], cells[0]) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * F.lit((1 - threshold) / (1 + threshold) + 1e-9))
