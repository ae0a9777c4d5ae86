"""The corpus pipeline: documents in, packed training sequences out.

Quality classifier, exact dedup, near-dedup, suffix-array dedup and packing, in this order; each
stage works on all that the one before has kept, and is written as Parquet and read again before
the next.

Of every stage: null texts count as empty and null ids are allowed; texts of any length are taken
whole; ties go to the smallest id; repeated rows (one id and text) share their outcome; an empty
table gives an empty one; other columns pass through as they are, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.llm import exact_dedup, near_dedup, packing, quality, suffix_dedup
from scrubline.llm.common import scratch_folder, table, text_or_empty


def _only(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """The documents that a verdict (doc_id, kept) keeps; rows with a null id are judged as well."""
    kept = verdict.where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; it learns from all labelled documents given.

    A null or empty text is scored as one with all statistics zero. Where no or only one label can be
    learned, all documents stay.
    """
    trees = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, trees)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts.

    The verdict holds for an id along with its text: rows of one id with different texts are judged
    each by its own. Repeated rows with one id share their outcome; of rows without an id that are
    kept for one text the longest stays, alone.
    """
    kept = exact_dedup.exact_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_text")).distinct()

    def judged(rows: DataFrame) -> DataFrame:
        return rows.join(kept, rows["doc_id"].eqNullSafe(kept["kept_id"]) & (exact_dedup.text_sha256(rows["text"]) == kept["kept_text"]), "left_semi")

    # combined before the exchange, so that no task holds all rows of a text
    nameless = judged(docs.where("doc_id is null"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    raw = text_or_empty()
    one = nameless.groupBy(exact_dedup.text_sha256(F.col("text")).alias("t")).agg(F.max_by(row, F.struct(F.char_length(raw), raw)).alias("r")).select("r.*")
    return judged(docs.where("doc_id is not null")).unionByName(one)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (five words, 0.8).

    Texts without words and rows without an id link with nothing and stay.
    """
    return _only(docs, near_dedup.near_dedup(docs))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out of each text what an earlier document already has in a repeat of 50 bytes or more.

    No row goes, but its text may become empty; a null text stays null; a null id is later than all.
    """
    return suffix_dedup.remove_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens; one row per piece, an empty text being its end id alone."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("suffix dedup", suffix_stage),
    ("packing", packing_stage),
]

#: Models, hashing and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; each is written and read again, and emptied once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{scratch_folder(spark)}/pipeline-{uuid.uuid4().hex}-{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            spark.range(0).write.mode("overwrite").parquet(before)
        before = path
    return docs
