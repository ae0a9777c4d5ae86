"""Source policy lint: which files of a tree hold network or telemetry code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What no runtime source file may hold.
FORBIDDEN = {
    "url": r"\bhttps?://",
    "fetch": r"\bfetch\s*\(",
    "network_module": r"""from\s+["'](?:node:)?(?:http|https|net|tls|dgram)["']""",
    "telemetry": r"(?i)\b(?:axios|telemetry|analytics|sentry)\b",
}


#: Fixed value: the files that are looked at, by their endings.
ENDINGS = r"\.(?:[cm]?js|ts)$"


def violations(files: DataFrame, path_col: str = "path", text_col: str = "text", endings: str | None = ENDINGS, exempt: tuple[str, ...] = ()) -> DataFrame:
    """(path, rule), one row per broken rule, of the files with these endings but the exempt ones (the rules' own file).

    endings=None looks at all files.
    """
    rows = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    if endings is not None:
        rows = rows.where(F.col("path").rlike(endings))
    if exempt:
        rows = rows.where(~F.col("path").isin(*exempt))
    hits = F.array(*[F.when(F.col("text").rlike(p), F.lit(rule)) for rule, p in FORBIDDEN.items()])
    return rows.select("path", F.explode(F.filter(hits, lambda r: r.isNotNull())).alias("rule"))
