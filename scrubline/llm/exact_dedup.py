"""Exact dedup: a tree-merge of sorted digest runs, in DataFrame operations only.

Every input partition is one run of digests, numbered in binary. In a binomial round the runs whose
numbers differ in one binary place are partners and exchange: of two partners each keeps the rows
whose digest has its own bit at that place and is sent the other's. The aggregate's map side sorts
and combines a partition's rows before they leave, its reduce side merges the sorted runs that
arrive. Several rounds ride on one exchange, which then merges ``fan_in`` runs at once. When all
places are done a run's number is a part of its digests' hash: each digest is in one run.

So a digest that a third of all rows share comes as one row from each partner, and at most ``fan_in``
rows of it meet in a task. With the default, half of the rounds on each exchange, every digest moves
twice however many runs there are.

Equality is held by SHA-256 and verified by a second, independent 64-bit hash and the length of
the normalised text, all three part of the merge key at every level; the smallest identifier and the
size of a group are kept at every level, and the sizes must add up to all rows in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, table, text_or_empty

#: The characters of [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: A digest is hot if it holds more than this part of all rows, so at most 1/HOT_PART are hot.
HOT_PART = 1 / 256

_KEY = ["digest", "check", "width"]


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, points, digest, check, width, run): one narrow row per document."""
    slim = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("raw"))
    norm = slim.select("id", F.char_length("raw").alias("points"), F.translate("raw", SPACES, "").alias("norm"))
    return norm.select(
        "id",
        "points",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.xxhash64("norm").alias("check"),
        F.octet_length("norm").alias("width"),
        F.spark_partition_id().alias("run"),
    )


def text_sha256(text: Column) -> Column:
    """The digest of a text as the verdict names it."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), SPACES, ""), 256)


def tree_merge(runs: DataFrame, n_runs: int, fan_in: int | None = None) -> DataFrame:
    """(digest, check, width, keep, group_size), one row per distinct text; fan_in: runs merged at once, a power of two."""
    places = max(1, (n_runs - 1).bit_length())
    rounds = (fan_in - 1).bit_length() if fan_in else -(-places // 2)
    # null ids come after all others
    best = F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("z"), F.col("id").alias("id"))
    level = runs.select(*_KEY, "run", best.alias("best"), F.lit(1).cast("long").alias("n"))
    for at in range(0, places, rounds):
        traded = ((1 << min(rounds, places - at)) - 1) << at
        own, other = F.col("run").bitwiseAND(~traded), F.xxhash64("digest").bitwiseAND(traded)
        level = level.withColumn("run", own.bitwiseOR(other.cast("int"))).groupBy(*_KEY, "run").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    return level.select(*_KEY, F.col("best.id").alias("keep"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the row with most code points in its original text,
    then the smallest id, stays; null ids come last. Ties of both (repeated rows with one id) share
    their outcome and each counts in group_size. Texts of any length are hashed whole. An empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    runs = settle(digest_runs(docs, id_col, text_col))
    total, last_run = runs.agg(F.count(F.lit(1)), F.coalesce(F.max("run"), F.lit(0))).first()
    groups = settle(tree_merge(runs, last_run + 1, fan_in))
    if (groups.agg(F.sum("group_size")).first()[0] or 0) != total:
        raise RuntimeError("merged runs do not add up to all rows")
    # The few groups that hold a large part of all rows are looked up from a broadcast of at most
    # 1/HOT_PART rows; all others are joined by digest, where no key is large.
    hot = groups.where(F.col("group_size") > F.lit(max(1.0, total * HOT_PART)))
    marked = runs.select("id", *_KEY).join(F.broadcast(hot), _KEY, "left")
    done = marked.where(F.col("group_size").isNotNull())
    rest = marked.where(F.col("group_size").isNull()).select("id", *_KEY).join(groups, _KEY)
    return done.unionByName(rest).select(
        F.col("id").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        F.col("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS raw,
         translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS norm
  FROM documents
), r AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(raw) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
