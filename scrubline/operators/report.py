"""Counts, report and manifest of an export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOOL, TOOL_VERSION = "scrubline", "0.1.0"
#: Fixed values of the package format: schema version, entries in their order, coverage, disclaimer.
SCHEMA = "1.0"
SOURCE_ENTRY = "SAFE_SOURCE/source.md"
ENTRIES = (SOURCE_ENTRY, "SAFE-MANIFEST.json", "DLP-REPORT.json", "README-SAFE-UPLOAD.md")
COVERAGE = "plain-text-complete"
DISCLAIMER = "Defense-in-depth only; absence of detection is not proof of safety."


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def finding_counts(public: DataFrame) -> DataFrame:
    """(source_id, severity, action, n)."""
    return public.groupBy("source_id", "severity", "action").agg(F.count(F.lit(1)).alias("n"))


def counts_map(public: Column) -> Column:
    """Counts by severity:action, in this order, of an array of public findings."""
    keys = F.array_sort(F.transform(public, lambda x: F.concat_ws(":", x["severity"], x["action"])))
    return F.map_from_entries(F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), F.size(F.filter(keys, lambda other: other == k)).cast("long").alias("value"))))


def manifest(project: Column, source: Column, source_sha256: Column, sanitized: Column, classification: Column, route: Column, token_map_created: Column, coverage: Column | None = None) -> Column:
    return F.struct(
        F.lit(SCHEMA).alias("schema_version"),
        F.lit(TOOL).alias("tool"),
        F.lit(TOOL_VERSION).alias("tool_version"),
        project.alias("project_id"),
        F.concat(project, F.lit("-"), source).alias("package_id"),
        F.struct(source.alias("source_id"), source_sha256.alias("sha256")).alias("source"),
        F.struct(F.lit(SOURCE_ENTRY).alias("path"), sha256(sanitized).alias("sha256")).alias("derivative"),
        classification.alias("classification"),
        route.alias("allowed_route"),
        (F.lit(COVERAGE) if coverage is None else coverage).alias("parser_coverage"),
        token_map_created.alias("token_map_created"),
        F.lit(False).alias("token_map_in_package"),
        F.array(*[F.lit(e) for e in ENTRIES]).alias("allowlist"),
    )


def report(project: Column, source: Column, counts: Column, public: Column, residual: Column) -> Column:
    """public: array of public findings; counts: map. Only cleared documents have a report, so the second scan has passed."""
    return F.struct(
        F.lit(SCHEMA).alias("schema_version"),
        project.alias("project_id"),
        source.alias("source_id"),
        counts.alias("finding_counts"),
        public.alias("findings"),
        residual.alias("residual_risk_count"),
        F.struct(F.lit("pass").alias("result"), F.lit(0).alias("blocking_findings")).alias("second_scan"),
        F.lit(DISCLAIMER).alias("disclaimer"),
    )
