"""Streams: detection, policy rewriting and gating are narrow, so they run on readStream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.operators.decide import by_policy, review
from scrubline.operators.detect import blocking, detect
from scrubline.operators.rewrite import rewritten

DEFAULT_POLICY = {"email": "tokenize", "phone": "tokenize", "taiwan-id": "tokenize", "exact-data": "tokenize", "ip-address": "delete"}


def sanitize_stream(docs: DataFrame, text_col: str = "text", policy: dict[str, str] | None = None, terms: tuple[str, ...] = ()) -> DataFrame:
    """All columns, with findings, sanitized_text and cleared (the second scan blocks nothing); batch or stream.

    A null text stays null and is not cleared.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), detect(F.col(text_col), terms).alias("found"))
    rows = rows.withColumn("findings", F.col("found"))
    rows = rewritten(review(rows, terms, by_policy(DEFAULT_POLICY if policy is None else policy)), ["row", "findings"])
    return rows.select("row.*", "findings", "sanitized_text", F.coalesce(blocking(F.col("sanitized_text")) == 0, F.lit(False)).alias("cleared"))


def findings_stream(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    rows = docs.select(F.col(id_col).alias("source_id"), F.explode(detect(F.col(text_col))).alias("f"))
    return rows.select("source_id", "f.finding_id", "f.type", "f.severity", "f.masked_preview", "f.detector")
