"""Gates before an export: route, open findings, second scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import CLASSIFICATIONS, ROUTES
from .detect import blocking
from .report import COVERAGE


def route_status(classification: Column, route: Column) -> Column:
    """blocked_route for P3 or local-only, invalid for unknown values (nulls too), else ok."""
    known = F.coalesce(classification.isin(*CLASSIFICATIONS) & route.isin(*ROUTES), F.lit(False))
    return F.when(~known, "invalid").when((classification == "P3") | (route == "local-only"), "blocked_route").otherwise("ok")


def export_status(
    classification: Column, route: Column, text: Column, n_unresolved: Column | None = None, status: Column | None = None, terms: list[str] | tuple[str, ...] = (), coverage: Column | None = None
) -> Column:
    """The first gate that holds a document back: route, parser coverage, state of the rewrite, then the second scan (with a dictionary if given).

    Whatever is unknown holds it back as well: a null coverage, status, count or text.
    """
    gate = route_status(classification, route)
    out = F.when(gate != "ok", gate)
    if coverage is not None:
        out = out.when(F.coalesce(coverage != COVERAGE, F.lit(True)), "incomplete_coverage")
    if status is not None:
        out = out.when(~F.coalesce(status.isin("ok", "unresolved"), F.lit(False)), "not_transformed")
    if n_unresolved is not None:
        out = out.when(F.coalesce(n_unresolved > 0, F.lit(True)), "unresolved")
    return out.when(text.isNull(), "not_transformed").when(blocking(text, terms) > 0, "blocked_scan").otherwise("ok")
