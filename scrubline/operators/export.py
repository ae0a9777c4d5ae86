"""The export: documents and decisions in, gated and packaged documents out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gate, report
from .rewrite import sanitize


def gated(result: DataFrame, classification: Column, route: Column, coverage: Column, terms: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The rewritten rows with ``classification``, ``route``, ``coverage`` and ``gate``: ok, or what holds the row back."""
    rows = result.withColumns({"classification": classification, "route": route, "coverage": coverage})
    state = gate.export_status(F.col("classification"), F.col("route"), F.col("sanitized_text"), F.col("n_unresolved"), F.col("status"), terms, F.col("coverage"))
    return rows.withColumn("gate", state)


def cleared(rows: DataFrame, project: str) -> DataFrame:
    """(source_id, sanitized_text, n_tokens, m, r) of the gated rows that may leave, with manifest and report as structs."""
    source = F.col("source_id").cast("string")
    m = report.manifest(F.lit(project), source, F.col("source_sha256"), F.col("sanitized_text"), F.col("classification"), F.col("route"), F.col("n_tokens") > 0, F.col("coverage"))
    r = report.report(F.lit(project), source, report.counts_map(F.col("public")), F.col("public"), F.col("residual_risk"))
    one = F.struct("source_id", "sanitized_text", "n_tokens", m.alias("m"), r.alias("r"))
    # exploded, not filtered: a filter would be pushed down and scan every text twice
    return rows.select(F.explode(F.when(F.col("gate") == "ok", F.array(one))).alias("x")).select("x.*")


def safe_packages(
    docs: DataFrame,
    decisions: DataFrame | Callable[[DataFrame], DataFrame],
    project: str,
    terms: list[str] | tuple[str, ...] = (),
    rescan_terms: list[str] | tuple[str, ...] = (),
    token_scope: str = "source",
    coverage: str | None = "coverage",
    registry=None,
) -> tuple[DataFrame, DataFrame]:
    """All rows with their gate, and one archive per row that may leave.

    docs: source_id, text, classification, route, and the column that ``coverage`` names, which the readers
    give; None says that all texts are known to be understood. The first frame is (source_id, status, first_error, gate, ...), one row per row of docs; the second
    (source_id, package_sha256, zip_sha256, zip), for ``archive.save_packages``.
    """
    from scrubline.sources import archive

    docs = docs.withColumn("coverage", F.lit(report.COVERAGE) if coverage is None else F.col(coverage))
    result = sanitize(docs, decisions, terms, token_scope, ["classification", "route", "coverage"], registry)
    rows = gated(result, F.col("carry.classification"), F.col("carry.route"), F.col("carry.coverage"), rescan_terms)
    ready = cleared(rows, project).select("source_id", "sanitized_text", F.to_json("m").alias("manifest"), F.to_json("r").alias("report"))
    return rows, archive.packages(ready)
