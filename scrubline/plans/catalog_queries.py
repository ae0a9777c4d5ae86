"""Registered queries of the sanitization operators and their SQL.

The tables hold few natural hits, so most queries run over ``documents`` with a suffix made from
doc_id, by one expression that both dialects read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.functions import scalars as S
from scrubline.operators import decide as D
from scrubline.operators import export as X
from scrubline.operators import gate as G
from scrubline.operators import report as R
from scrubline.operators import rewrite as W
from scrubline.operators.catalog import DETECTORS, Detector
from scrubline.operators.detect import blocking, detect, findings, matches
from scrubline.operators.registry import Registry
from scrubline.sources import archive, lint, readers, vault
from scrubline.sources.readers import spread
from scrubline.sources.scratch import scratch_folder, settle
from scrubline.streaming.decisions import review_stream
from scrubline.streaming.sanitize import sanitize_stream

TERMS = ("Harbour Looms", "risk sk-a", "ba", "aa")

_ID = "CAST(doc_id AS STRING)"
AUGMENTED = f"""coalesce(text, '') || CASE CAST(doc_id % 9 AS INT)
 WHEN 0 THEN ' 電郵a.b' || {_ID} || '@example.com請 10.2.3.' || CAST(doc_id % 256 AS STRING) || ' x' || {_ID} || '@mail.example.org'
 WHEN 1 THEN ' tel 0912-345-' || right('00' || {_ID}, 3) || ' 1' || '0912345678 0987 654 321'
 WHEN 2 THEN ' 身分A1' || right('0000000' || {_ID}, 8) || '號 B2' || right('0000000' || {_ID}, 8) || 'x C212345678'
 WHEN 3 THEN ' host 192.168.' || CAST(doc_id % 256 AS STRING) || '.7.9 256.1.1.1 1.2.3.4.5'
 WHEN 4 THEN ' Password : "synthetic-' || {_ID} || '-pass" api_key = sk-abcdefghijklmnopqrst' || {_ID}
 WHEN 5 THEN ' sk-abcdefghijklmnop_' || right('0000000' || {_ID}, 7) || '-- Harbour Looms baaa'
 WHEN 6 THEN ' ghp_abcdefghijklmnop' || right('000000' || {_ID}, 6) || ' risk sk-abcdefghijklmnopqrstuv'
 WHEN 7 THEN chr(10) || '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || 'abc' || {_ID} || chr(10) || '-----END EC PRIVATE KEY----- passwd:abcdefgh' || {_ID}
 ELSE '' END"""
_DUCK_AUGMENTED = AUGMENTED.replace(" AS STRING)", " AS VARCHAR)")


def augmented(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return docs.select(F.col("doc_id").alias("source_id"), F.expr(AUGMENTED).alias("text"), "lang", "source")


def found(spark, d: str) -> DataFrame:
    return findings(augmented(spark, d), "source_id", terms=TERMS)


#: The action of each type; reasons and replacements come with it.
_ACTION = """CASE WHEN {t} IN ('private-key', 'api-token', 'credential') THEN 'delete' WHEN {t} = 'ip-address' THEN 'keep'
 WHEN {t} = 'phone' THEN 'generalize' ELSE 'tokenize' END"""


def decisions(rows: DataFrame) -> DataFrame:
    """Two decisions for each finding, of which the later counts; sources divisible by 10 leave their high findings open."""
    base = rows.where("NOT (source_id % 10 = 0 AND severity = 'high')").select("source_id", "finding_id", "type", "start")
    none = F.lit(None).cast("string")
    first = F.struct(F.lit(1).alias("seq"), F.lit("keep").alias("action"), none.alias("token_label"), none.alias("replacement"), F.lit("first").alias("reason"))
    second = F.struct(
        F.lit(2).alias("seq"),
        F.expr(_ACTION.format(t="type")).alias("action"),
        F.expr("CASE WHEN type = 'taiwan-id' THEN ' staff id! ' ELSE '' END").alias("token_label"),
        F.expr("CASE WHEN type = 'phone' THEN '  a phone ' END").alias("replacement"),
        F.expr("CASE WHEN type = 'ip-address' THEN 'internal' END").alias("reason"),
    )
    return base.select("source_id", "finding_id", F.explode(F.array(first, second)).alias("x")).select("source_id", "finding_id", "x.*")


def sanitized(spark, d: str, token_scope: str = "source", registry=None) -> DataFrame:
    """Documents rewritten by a table of decisions, which is made from their findings and joined with them."""
    return W.sanitize(augmented(spark, d), decisions, TERMS, token_scope, registry=registry)


# -- the SQL side --------------------------------------------------------------------------------
_SPACE = r"\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: The detectors' patterns (and parts of them), white space and checked strings below are those of the catalog.
_OCT = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_PEM = "(?:RSA |EC |OPENSSH )?PRIVATE KEY-----"
#: The detectors' patterns as DuckDB's RE2 takes them, whose \b is ASCII; the phone has its own scan.
_RE2 = {
    "private-key-block": rf"-----BEGIN {_PEM}(?s:.)*?-----END {_PEM}",
    "openai-style-token": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "github-token": r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    "credential-assignment": rf"(?i)\b(?:password|passwd|api[_-]?key|access[_-]?token|client[_-]?secret)[{_SPACE}]*[:=][{_SPACE}]*[\"'']?[^{_SPACE}\"'']{{8,}}",
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "taiwan-id": r"\b[A-Z][12][0-9]{8}\b",
    "ipv4": rf"\b{_OCT}(?:\.{_OCT}){{3}}\b",
}


def _scan_sql(name: str, kind: str, severity: int, ord: int, table: str = "a") -> str:
    """Rows (id, st, en, sev, ord, typ, det, v) of one detector over table(id, t)."""
    label = f"{severity} AS sev, {ord} AS ord, '{kind}' AS typ, '{name}' AS det"
    if name == "taiwan-mobile":
        return f"""SELECT id, i - 1 AS st, i - 1 + length(v) AS en, {label}, v FROM (
  SELECT id, i, t, regexp_extract(substr(t, i, 12), '^09[0-9]{{2}}[- ]?[0-9]{{3}}[- ]?[0-9]{{3}}') AS v FROM (
    SELECT id, t, unnest(range(1, length(t) + 1)) AS i FROM {table} WHERE contains(t, '09')) WHERE substr(t, i, 2) = '09')
 WHERE v <> '' AND NOT regexp_matches(substr(t, i + length(v), 1), '[0-9]') AND (i = 1 OR NOT regexp_matches(substr(t, i - 1, 1), '[0-9]'))"""
    p = _RE2[name]
    return f"""SELECT id, st, st + length(v) AS en, {label}, v FROM (
  SELECT id, m[i] AS v, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS st
  FROM (SELECT id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT id, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM {table})))"""


def _term_sql(term: str, ord: int, table: str = "a") -> str:
    return f"""SELECT id, st, st + {len(term)} AS en, 2 AS sev, {ord} AS ord, 'exact-data' AS typ, 'local-exact-data' AS det, '{term}' AS v FROM (
  SELECT id, list_sum(list_transform(g[1:i], lambda x: length(x))) + {len(term)} * (i - 1) AS st
  FROM (SELECT id, g, unnest(range(1, len(g))) AS i FROM (SELECT id, string_split(t, '{term}') AS g FROM {table})))"""


_RANK = {"medium": 1, "high": 2, "critical": 3}


def _resolved_ctes(source: str, table: str, out: str, terms=TERMS) -> str:
    """CTEs: candidates of a table(id, t), and its resolved findings as ``out``."""
    scans = [_scan_sql(x.name, x.kind, _RANK[x.severity], i, table) for i, x in enumerate(DETECTORS)]
    scans += [_term_sql(t, len(DETECTORS) + i, table) for i, t in enumerate(terms)]
    union = "\nUNION ALL\n".join(scans)
    return f"""{table} AS ({source}), {table}_c AS (
{union}
), {table}_l AS (
  SELECT id, list({{'last': en::BIGINT, 'o': [{{'st': st::BIGINT, 'en': en::BIGINT, 'sev': sev, 'typ': typ, 'det': det, 'v': v}}]}} ORDER BY st, sev DESC, en DESC, ord) AS l FROM {table}_c GROUP BY id
), {table}_r AS (
  SELECT id, list_reduce(l, lambda p, x: CASE WHEN x.o[1].st < p.last THEN p ELSE {{'last': x.last, 'o': list_concat(p.o, x.o)}} END).o AS o FROM {table}_l
), {out} AS (
  SELECT id, u.st AS st, u.en AS en, u.sev AS sev, u.typ AS typ, u.det AS det, u.v AS v,
         CASE u.sev WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
         substr(sha256(u.typ || chr(0) || u.st || chr(0) || u.v), 1, 16) AS fid,
         CASE WHEN length(u.v) <= 4 THEN repeat('•', length(u.v)) ELSE left(u.v, 2) || repeat('•', least(8, length(u.v) - 4)) || right(u.v, 2) END AS masked
  FROM (SELECT id, unnest(o) AS u FROM {table}_r)
)"""


_SOURCE = f"SELECT doc_id AS id, {_DUCK_AUGMENTED} AS t FROM documents"
_FOUND = "WITH " + _resolved_ctes(_SOURCE, "a", "f")
_DECIDED = (
    _FOUND
    + f""", d AS (
  SELECT *, CASE WHEN id % 10 = 0 AND severity = 'high' THEN NULL ELSE {_ACTION.format(t='typ')} END AS action FROM f
), s AS (
  SELECT *, sum((action IS NULL)::INT) OVER (PARTITION BY id) AS n_open,
         CASE WHEN action = 'tokenize' THEN CASE WHEN typ = 'taiwan-id' THEN 'STAFF-ID' ELSE upper(typ) END END AS label FROM d
), t AS (
  SELECT *, CASE WHEN label IS NOT NULL THEN '【' || label || '-' || printf('%02d', row_number() OVER (PARTITION BY id, label ORDER BY st)) || '】' END AS token FROM s
), p AS (
  SELECT *, CASE action WHEN 'delete' THEN '[REMOVED]' WHEN 'tokenize' THEN token WHEN 'generalize' THEN 'a phone' ELSE v END AS nv,
         coalesce(lag(en) OVER (PARTITION BY id ORDER BY st), 0) AS pe FROM t WHERE n_open = 0
), j AS (
  SELECT p.id, string_agg(substr(a.t, pe + 1, st - pe) || nv, '' ORDER BY st) || substr(any_value(a.t), max(en) + 1) AS out,
         count(*) FILTER (WHERE action = 'keep') AS kept, count(*) AS n, count(token) AS tokens FROM p JOIN a USING (id) GROUP BY p.id
), o AS (
  SELECT id, max(n_open) AS n_open FROM s GROUP BY id
), x AS (
  SELECT a.id AS source_id, CASE WHEN o.n_open > 0 THEN 'unresolved' ELSE 'ok' END AS status, coalesce(j.out, a.t) AS sanitized_text,
         coalesce(kept, 0)::BIGINT AS residual_risk, coalesce(o.n_open, 0)::BIGINT AS n_unresolved, coalesce(n, 0)::BIGINT AS n_public, coalesce(tokens, 0)::BIGINT AS n_tokens
  FROM a LEFT JOIN j USING (id) LEFT JOIN o USING (id)
)"""
)

QUERIES: dict = {}
ORACLES: dict = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


# one detector each, before resolution
for _i, _det in enumerate(DETECTORS):

    def _one(spark, d, det=_det, i=_i):
        rows = augmented(spark, d).select("source_id", F.explode(matches(F.col("text"), det, i)).alias("m"))
        return rows.select("source_id", F.col("m.start").cast("long").alias("start_at"), F.col("m.value").alias("value"))

    _add("detect_" + _det.name.replace("-", "_"), _one, f"WITH a AS ({_SOURCE}) SELECT id AS source_id, st::BIGINT AS start_at, v AS value FROM ({_scan_sql(_det.name, _det.kind, _RANK[_det.severity], _i)})")


def _dictionary(spark, d):
    rows = found(spark, d).where("type = 'exact-data'")
    return rows.select("source_id", F.col("start").cast("long").alias("start_at"), "value")


_add("detect_dictionary", _dictionary, _FOUND + " SELECT id AS source_id, st AS start_at, v AS value FROM f WHERE typ = 'exact-data'")
#: More terms than get an expression of their own; some are parts of others.
MANY = tuple(f"C-{i}" for i in range(1, 101)) + ("ase", "case C-7")
_CASES = f"coalesce(text, '') || ' case C-' || CAST(doc_id % 150 AS STRING) || ' case C-1 C-100' || {_ID}"


def _large_dictionary(s, d):
    rows = spread(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).select(F.col("doc_id").alias("source_id"), F.expr(_CASES).alias("text"))
    return findings(rows, "source_id", terms=MANY).where("type = 'exact-data'").select("source_id", F.col("start").cast("long").alias("start_at"), "value")


_add(
    "detect_large_dictionary",
    _large_dictionary,
    "WITH " + _resolved_ctes(f"SELECT doc_id AS id, {_CASES.replace(' AS STRING)', ' AS VARCHAR)')} AS t FROM documents", "a", "f", MANY) + " SELECT id AS source_id, st AS start_at, v AS value FROM f WHERE typ = 'exact-data'",
)
_add(
    "resolve_overlaps",
    lambda s, d: found(s, d).select("source_id", F.col("start").cast("long").alias("start_at"), F.col("end").cast("long").alias("end_at"), "detector"),
    _FOUND + " SELECT id AS source_id, st AS start_at, en AS end_at, det AS detector FROM f",
)
_add(
    "finding_ids",
    # the oracle's offsets are code points: rows before whose findings only BMP characters stand agree
    lambda s, d: found(s, d).select("source_id", "finding_id", "masked_preview"),
    _FOUND + " SELECT id AS source_id, fid AS finding_id, masked AS masked_preview FROM f",
)
_add(
    "findings_by_type",
    lambda s, d: findings(spread(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")), "doc_id").groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n")),
    "WITH " + _resolved_ctes("SELECT doc_id AS id, coalesce(text, '') AS t FROM documents", "a", "f", ()) + " SELECT typ AS type, severity, count(*) AS n FROM f GROUP BY ALL",
)
_add(
    "findings_by_lang_source",
    lambda s, d: augmented(s, d).select("lang", "source", F.explode(F.transform(detect(F.col("text"), TERMS), lambda f: f["type"])).alias("type")).groupBy("lang", "source", "type").agg(F.count(F.lit(1)).alias("n")),
    _FOUND + " SELECT lang, source, typ AS type, count(*) AS n FROM f JOIN documents ON doc_id = id GROUP BY ALL",
)
_add(
    "pages_scan",
    lambda s, d: findings(s.read.parquet(f"{d}/pages.parquet"), "page_id", "html").select("source_id", "type", F.col("start").cast("long").alias("start_at"), "masked_preview"),
    "WITH " + _resolved_ctes("SELECT page_id AS id, coalesce(html, '') AS t FROM pages", "a", "f", ()) + " SELECT id AS source_id, typ AS type, st AS start_at, masked AS masked_preview FROM f",
)


def _conversations(s, d):
    rows = s.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("source_id"), F.concat(F.coalesce("text", F.lit("")), F.lit(" mail u"), F.col("conv_id").cast("string"), F.lit("@example.com")).alias("text"))
    return findings(rows, "source_id").select("source_id", "type", "value")


_add(
    "conversations_scan",
    _conversations,
    "WITH " + _resolved_ctes("SELECT conv_id * 1000 + turn AS id, coalesce(text, '') || ' mail u' || conv_id || '@example.com' AS t FROM conversations", "a", "f", ()) + " SELECT id AS source_id, typ AS type, v AS value FROM f",
)
_add(
    "decisions_last_wins",
    lambda s, d: D.last_decisions(decisions(found(s, d))).select("source_id", "finding_id", "action", F.coalesce("token_label", F.lit("")).alias("token_label")),
    _DECIDED + " SELECT id AS source_id, fid AS finding_id, action, CASE WHEN typ = 'taiwan-id' THEN ' staff id! ' ELSE '' END AS token_label FROM d WHERE action IS NOT NULL",
)


def _unresolved(s, d):
    docs = augmented(s, d)
    return D.unresolved(D.verdicts(settle(D.hits(docs, TERMS)), docs, decisions(found(s, d))))


_add("unresolved", _unresolved, _DECIDED + " SELECT id AS source_id, fid AS finding_id, typ AS type FROM d WHERE action IS NULL")
_add("all_or_nothing", lambda s, d: sanitized(s, d).select("source_id", "status", "n_unresolved", "n_public"), _DECIDED + " SELECT source_id, status, n_unresolved, CASE WHEN status = 'ok' THEN n_public ELSE 0 END AS n_public FROM x")


def _always(action: Column | str, reason: str | None = None, replacement: str | None = None):
    """The same decision for every finding, or one whose action is made from the finding."""
    null = F.lit(None).cast("string")

    def choose(f: Column) -> Column:
        made = action(f) if callable(action) else F.lit(action)
        return F.when(made.isNotNull(), F.struct(made.alias("action"), null.alias("token_label"), F.lit(replacement).cast("string").alias("replacement"), F.lit(reason).cast("string").alias("reason")))

    return choose


def _judged(action: str, reason: str | None, replacement: str | None):
    def run(s, d):
        rows = D.validated(D.review(augmented(s, d), TERMS, _always(action, reason, replacement)))
        return rows.select("source_id", "finding_id", F.coalesce("error", F.lit("none")).alias("error"), F.coalesce("first_error", F.lit("none")).alias("first_error"))

    return run


def _judged_sql(action: str, other: str) -> str:
    error = f"CASE WHEN typ IN ('private-key', 'api-token', 'credential') AND '{action}' <> 'delete' THEN 'must_delete' ELSE '{other}' END"
    return _FOUND + f", e AS (SELECT *, {error} AS error FROM f) SELECT id AS source_id, fid AS finding_id, error, coalesce(arg_min(error, st) FILTER (WHERE error <> 'none') OVER (PARTITION BY id), 'none') AS first_error FROM e"


_add("validate_forced_delete", _judged("tokenize", None, None), _judged_sql("tokenize", "none"))
_add("validate_keep_reason", _judged("keep", " 　 ", None), _judged_sql("keep", "keep_needs_reason"))
_add("validate_generalize", _judged("generalize", None, "﻿ "), _judged_sql("generalize", "generalize_needs_replacement"))
_add("validate_delete", _judged("delete", None, None), _judged_sql("delete", "none"))
_add("validate_unknown_action", _judged("shred", None, None), _FOUND + " SELECT id AS source_id, fid AS finding_id, 'unknown_action' AS error, 'unknown_action' AS first_error FROM f")


def _precedence(s, d):
    def action(f):
        kind = f["type"]
        return F.when(kind.isin("email", "ip-address"), "keep").when(kind == "phone", "generalize").when(kind == "exact-data", "delete").when(kind != "taiwan-id", "tokenize")

    rows = D.review(augmented(s, d), TERMS, _always(action)).where(F.size("judged") > 0)
    return rows.select("source_id", "status", F.coalesce("first_error", F.lit("none")).alias("first_error"))


_add(
    "error_precedence",
    _precedence,
    _FOUND
    + """, e AS (
  SELECT id, st, typ, CASE WHEN typ IN ('email', 'ip-address') THEN 'keep_needs_reason' WHEN typ = 'phone' THEN 'generalize_needs_replacement'
         WHEN typ IN ('private-key', 'api-token', 'credential') THEN 'must_delete' END AS error FROM f
) SELECT id AS source_id, CASE WHEN count(error) > 0 THEN 'error' WHEN bool_or(typ = 'taiwan-id') THEN 'unresolved' ELSE 'ok' END AS status,
         coalesce(arg_min(error, st) FILTER (WHERE error IS NOT NULL), 'none') AS first_error FROM e GROUP BY id""",
)


def _uniform(action: str, reason: str | None = None, replacement: str | None = None):
    """Sanitized texts when every finding that needs no deletion gets one action."""

    def run(s, d):
        wanted = lambda f: F.when(f["type"].isin("private-key", "api-token", "credential"), "delete").otherwise(action)
        rows = W.rewritten(D.review(augmented(s, d), TERMS, _always(wanted, reason, replacement)), ["source_id"])
        return rows.select("source_id", "status", "residual_risk", R.sha256(F.col("sanitized_text")).alias("text_sha256"))

    return run


def _uniform_sql(value: str, kept: bool) -> str:
    forced = "typ IN ('private-key', 'api-token', 'credential')"
    return _FOUND + f""", t AS (
  SELECT *, '【' || upper(typ) || '-' || printf('%02d', row_number() OVER (PARTITION BY id, typ ORDER BY st)) || '】' AS token, coalesce(lag(en) OVER (PARTITION BY id ORDER BY st), 0) AS pe FROM f
), j AS (
  SELECT t.id, string_agg(substr(a.t, pe + 1, st - pe) || CASE WHEN {forced} THEN '[REMOVED]' ELSE {value} END, '' ORDER BY st) || substr(any_value(a.t), max(en) + 1) AS out,
         count(*) FILTER (WHERE NOT {forced}) AS kept FROM t JOIN a USING (id) GROUP BY t.id
) SELECT a.id AS source_id, 'ok' AS status, {'coalesce(kept, 0)' if kept else '0'}::BIGINT AS residual_risk, sha256(coalesce(j.out, a.t)) AS text_sha256 FROM a LEFT JOIN j USING (id)"""


_add("rewrite_delete", _uniform("delete"), _uniform_sql("'[REMOVED]'", False))
_add("rewrite_tokenize", _uniform("tokenize"), _uniform_sql("token", False))
_add("rewrite_generalize", _uniform("generalize", replacement=" 　someone\n"), _uniform_sql("'someone'", False))
_add("rewrite_keep", _uniform("keep", reason="reviewed"), _uniform_sql("v", True))
_add("rewrite_mixed", lambda s, d: sanitized(s, d).select("source_id", "status", "sanitized_text"), _DECIDED + " SELECT source_id, status, sanitized_text FROM x")
_add("residual_risk", lambda s, d: sanitized(s, d).select("source_id", "residual_risk", "n_tokens"), _DECIDED + " SELECT source_id, residual_risk, n_tokens FROM x")
_add("rewrite_reviewed", lambda s, d: sanitized(s, d).select("source_id", "status", "sanitized_text"), _DECIDED + " SELECT source_id, status, sanitized_text FROM x")
_add("token_entries", lambda s, d: W.token_entries(sanitized(s, d)), _DECIDED + " SELECT id AS source_id, token, v AS original, typ AS finding_type FROM p WHERE token IS NOT NULL")


_EMAILS = 104


def _many_tokens(s, d):
    mails = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(_EMAILS)), lambda i: F.concat(F.lit("u"), i.cast("string"), F.lit("@example.com"))), " ")
    rows = spread(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).select(F.col("doc_id").alias("source_id"), F.concat(F.coalesce("text", F.lit("")), F.lit(" "), mails).alias("text"))
    wanted = lambda f: F.when(f["type"].isin("private-key", "api-token", "credential"), "delete").when(f["type"] == "email", "tokenize").otherwise("delete")
    return W.token_entries(W.rewritten(D.review(rows, (), _always(wanted)), ["source_id"])).select("source_id", "token", "original")


_MAILS_SQL = f"SELECT doc_id AS id, coalesce(text, '') || ' ' || list_aggregate(list_transform(range(1, {_EMAILS + 1}), lambda i: 'u' || i || '@example.com'), 'string_agg', ' ') AS t FROM documents"
_add(
    "token_ordinals_over_100",
    _many_tokens,
    "WITH " + _resolved_ctes(_MAILS_SQL, "a", "f", ()) + " SELECT id AS source_id, '【EMAIL-' || printf('%02d', row_number() OVER (PARTITION BY id ORDER BY st)) || '】' AS token, v AS original FROM f WHERE typ = 'email'",
)
_add(
    "token_project_scope",
    lambda s, d: W.token_entries(sanitized(s, d, "project")),
    _DECIDED
    + f""", w AS (SELECT DISTINCT label, v FROM s WHERE label IS NOT NULL), o2 AS (
  SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY substr(sha256(v), 1, {W.BUCKET_DIGITS}), v) AS k FROM w
) SELECT id AS source_id, '【' || label || '-' || printf('%02d', k) || '】' AS token, v AS original, typ AS finding_type FROM p JOIN o2 USING (label, v)""",
)


#: Turns of conversations, some with an address that a document has as well.
_TURN = "coalesce(text, '') || ' mail a.b' || {id} || '@example.com and u' || {id} || '@example.org'"


def _two_batches(s, d):
    """Documents are entered first, then conversations, then the documents once more; tokens of the last two."""
    registry = Registry(s, f"{scratch_folder(s)}/registry-{uuid.uuid4().hex}", b"a registry's secret of 32 bytes.")
    W.enter(augmented(s, d), decisions, registry, TERMS)
    turns = s.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("source_id"), F.expr(_TURN.format(id="CAST(conv_id AS STRING)")).alias("text"))
    later = W.sanitize(turns, decisions, TERMS, "project", registry=registry)
    again = sanitized(s, d, "project", registry)
    one, two = (W.token_entries(x).withColumn("batch", F.lit(k)) for k, x in ((2, later), (1, again)))
    return one.unionByName(two)


_add(
    "token_registry",
    _two_batches,
    _DECIDED
    + ", "
    + _resolved_ctes(f"SELECT conv_id * 1000 + turn AS id, {_TURN.format(id='conv_id::VARCHAR')} AS t FROM conversations", "c", "cf")
    + f""", w AS (SELECT DISTINCT label, v FROM s WHERE label IS NOT NULL), o2 AS (
  SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY substr(sha256(v), 1, {W.BUCKET_DIGITS}), v) AS k FROM w
), cd AS (
  SELECT *, CASE WHEN id % 10 = 0 AND severity = 'high' THEN NULL ELSE {_ACTION.format(t='typ')} END AS action FROM cf
), cs AS (
  SELECT *, sum((action IS NULL)::INT) OVER (PARTITION BY id) AS n_open, CASE WHEN action = 'tokenize' THEN CASE WHEN typ = 'taiwan-id' THEN 'STAFF-ID' ELSE upper(typ) END END AS label FROM cd
), cw AS (SELECT DISTINCT label, v FROM cs WHERE label IS NOT NULL), o3 AS (
  SELECT * FROM o2 UNION ALL
  SELECT label, v, coalesce((SELECT max(k) FROM o2 WHERE o2.label = n.label), 0) + row_number() OVER (PARTITION BY label ORDER BY substr(sha256(v), 1, {W.BUCKET_DIGITS}), v) AS k FROM (FROM cw ANTI JOIN o2 USING (label, v)) n
) SELECT 1 AS batch, id AS source_id, '【' || label || '-' || printf('%02d', k) || '】' AS token, v AS original, typ AS finding_type FROM p JOIN o3 USING (label, v)
UNION ALL SELECT 2 AS batch, id AS source_id, '【' || label || '-' || printf('%02d', k) || '】' AS token, v AS original, typ AS finding_type FROM cs JOIN o3 USING (label, v) WHERE n_open = 0""",
)


def _rehydrated(s, d):
    rows = sanitized(s, d)
    return rows.select("source_id", F.coalesce(W.rehydrate(F.col("sanitized_text"), F.col("tokens")), F.col("sanitized_text")).alias("text"))


_add(
    "rehydrate",
    _rehydrated,
    _DECIDED
    + """, y AS (
  SELECT p.id, string_agg(substr(a.t, pe + 1, st - pe) || CASE WHEN token IS NULL THEN nv ELSE v END, '' ORDER BY st) || substr(any_value(a.t), max(en) + 1) AS back FROM p JOIN a USING (id) GROUP BY p.id
) SELECT a.id AS source_id, coalesce(back, a.t) AS text FROM a LEFT JOIN y USING (id)""",
)
_add(
    "public_findings",
    lambda s, d: W.public_findings(sanitized(s, d)).select("source_id", "finding_id", "type", "severity", "masked_preview", "detector", "action", F.coalesce("token", F.lit("")).alias("token"), F.coalesce("reason", F.lit("")).alias("reason")),
    _DECIDED + " SELECT id AS source_id, fid AS finding_id, typ AS type, severity, masked AS masked_preview, det AS detector, action, coalesce(token, '') AS token, CASE WHEN typ = 'ip-address' THEN 'internal' ELSE '' END AS reason FROM p",
)
_add("finding_counts", lambda s, d: R.finding_counts(W.public_findings(sanitized(s, d))), _DECIDED + " SELECT id AS source_id, severity, action, count(*) AS n FROM p GROUP BY ALL")
_add(
    "normalize_label",
    lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", S.normalize_label(F.concat(F.lit("--"), "c_name", F.lit(" / acct!"))).alias("label"), S.normalize_label(F.lit(" ?! ")).alias("empty_label")),
    "SELECT c_custkey, regexp_replace(regexp_replace(upper('--' || c_name || ' / acct!'), '[^A-Z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS label, 'SENSITIVE' AS empty_label FROM customer",
)

_CLASS = "CASE doc_id % 5 WHEN 0 THEN 'P0' WHEN 1 THEN 'P1' WHEN 2 THEN 'P2' WHEN 3 THEN 'P3' ELSE 'P1' END"
_ROUTE = "CASE doc_id % 4 WHEN 0 THEN 'local-only' WHEN 1 THEN 'cloud-approved' WHEN 2 THEN 'cloud-sanitized' ELSE 'mail' END"


def _policies(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("source_id"), F.expr(_CLASS).alias("classification"), F.expr(_ROUTE).alias("route"))


_GATE = f"CASE WHEN {_ROUTE} = 'mail' THEN 'invalid' WHEN {_CLASS} = 'P3' OR {_ROUTE} = 'local-only' THEN 'blocked_route' ELSE 'ok' END"
_add("route_gate", lambda s, d: _policies(s, d).select("source_id", G.route_status(F.col("classification"), F.col("route")).alias("gate")), f"SELECT doc_id AS source_id, {_GATE} AS gate FROM documents")
_SECOND = _DECIDED + ", " + _resolved_ctes("SELECT source_id AS id, sanitized_text AS t FROM x", "a2", "f2", ()) + ", b AS (SELECT id, count(*) FILTER (WHERE sev >= 2) AS n FROM f2 GROUP BY id)"
_add("second_scan", lambda s, d: sanitized(s, d).select("source_id", blocking(F.col("sanitized_text")).cast("long").alias("n_blocking")), _SECOND + " SELECT source_id, coalesce(n, 0)::BIGINT AS n_blocking FROM x LEFT JOIN b ON b.id = source_id")


_SECOND_TERMS = _DECIDED + ", " + _resolved_ctes("SELECT source_id AS id, sanitized_text AS t FROM x", "a2", "f2") + ", b AS (SELECT id, count(*) FILTER (WHERE sev >= 2) AS n FROM f2 GROUP BY id)"
_add(
    "second_scan_dictionary",
    lambda s, d: sanitized(s, d).select("source_id", blocking(F.col("sanitized_text"), TERMS).cast("long").alias("n_blocking")),
    _SECOND_TERMS + " SELECT source_id, coalesce(n, 0)::BIGINT AS n_blocking FROM x LEFT JOIN b ON b.id = source_id",
)


def exports(s, d) -> tuple[DataFrame, DataFrame]:
    """The gates of all documents, and the archives of those that may leave; the texts are made here, so all of them are understood."""
    docs = augmented(s, d).withColumns({"classification": F.expr(_CLASS.replace("doc_id", "source_id")), "route": F.expr(_ROUTE.replace("doc_id", "source_id"))})
    return X.safe_packages(docs, decisions, "demo", TERMS, coverage=None)


_EXPORT_SQL = _SECOND + f", g AS (SELECT x.*, {_CLASS} AS classification, {_ROUTE} AS route, CASE WHEN {_GATE} <> 'ok' THEN {_GATE} WHEN n_unresolved > 0 THEN 'unresolved' WHEN n > 0 THEN 'blocked_scan' ELSE 'ok' END AS gate FROM x JOIN documents ON doc_id = source_id LEFT JOIN b ON b.id = source_id)"
_add("export_status", lambda s, d: exports(s, d)[0].select("source_id", "gate"), _EXPORT_SQL + " SELECT source_id, gate FROM g")
_add("derivative_hash", lambda s, d: sanitized(s, d).select("source_id", R.sha256(F.col("sanitized_text")).alias("sha256")), _DECIDED + " SELECT source_id, sha256(sanitized_text) AS sha256 FROM x")


def cleared(s, d) -> DataFrame:
    """(source_id, sanitized_text, n_tokens, m, r) of the documents that pass all gates."""
    return X.cleared(exports(s, d)[0], "demo")


_add(
    "manifest_fields",
    lambda s, d: cleared(s, d).select("source_id", "m.package_id", F.col("m.source.sha256").alias("source_sha256"), F.col("m.derivative.sha256").alias("derivative_sha256"), "m.classification", "m.allowed_route", "m.token_map_created", "m.token_map_in_package"),
    _EXPORT_SQL + " SELECT source_id, 'demo-' || source_id AS package_id, sha256(a.t) AS source_sha256, sha256(sanitized_text) AS derivative_sha256, classification, route AS allowed_route, n_tokens > 0 AS token_map_created, false AS token_map_in_package FROM g JOIN a ON a.id = source_id WHERE gate = 'ok'",
)
_add(
    "report_fields",
    lambda s, d: cleared(s, d).select(
        "source_id",
        F.size("r.findings").cast("long").alias("n_findings"),
        F.col("r.residual_risk_count").alias("residual_risk"),
        F.coalesce(F.expr("r.finding_counts['critical:delete']"), F.lit(0)).cast("long").alias("critical_deletes"),
        F.array_join(F.transform("r.findings", lambda x: F.concat_ws("|", x["finding_id"], x["type"], x["severity"], x["masked_preview"], x["detector"], x["action"], F.coalesce(x["token"], F.lit("-")), F.coalesce(x["reason"], F.lit("-")))), ";").alias("listed"),
        F.concat_ws("|", "r.schema_version", "r.project_id", "r.source_id", "r.second_scan.result", F.col("r.second_scan.blocking_findings").cast("string"), "r.disclaimer").alias("head"),
    ),
    _EXPORT_SQL
    + f""", k AS (
  SELECT id, count(*) AS n_all, count(*) FILTER (WHERE severity = 'critical' AND action = 'delete') AS cd,
         string_agg(fid || '|' || typ || '|' || severity || '|' || masked || '|' || det || '|' || action || '|' || coalesce(token, '-') || '|' || CASE WHEN typ = 'ip-address' THEN 'internal' ELSE '-' END, ';' ORDER BY st) AS listed
  FROM p GROUP BY id
) SELECT source_id, coalesce(n_all, 0)::BIGINT AS n_findings, residual_risk, coalesce(cd, 0)::BIGINT AS critical_deletes, coalesce(listed, '') AS listed,
         '{R.SCHEMA}|demo|' || source_id || '|pass|0|{R.DISCLAIMER}' AS head FROM g LEFT JOIN k ON k.id = source_id WHERE gate = 'ok'""",
)


def packaged(s, d) -> DataFrame:
    return exports(s, d)[1]


def _json_text(value: str) -> str:
    """SQL: a text as a JSON string; the values here hold no control characters but line ends."""
    return f"""'"' || replace(replace(replace({value}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '"'"""


def _pretty(pairs: list[tuple[str, str]], depth: int) -> str:
    """SQL: a JSON object whose members are SQL texts of JSON, indented by two."""
    pad = " " * depth
    lines = " || ',' || chr(10) || ".join(f"""'{pad}  "{k}": ' || {v}""" for k, v in pairs)
    return f"'{{' || chr(10) || {lines} || chr(10) || '{pad}}}'"


_FINDING_JSON = [(k, _json_text(v)) for k, v in [("finding_id", "fid"), ("type", "typ"), ("severity", "severity"), ("masked_preview", "masked"), ("detector", "det"), ("action", "action")]]
_FOUND_JSON = (
    "CASE WHEN token IS NOT NULL THEN " + _pretty([*_FINDING_JSON, ("token", _json_text("token"))], 4) + " WHEN typ = 'ip-address' THEN " + _pretty([*_FINDING_JSON, ("reason", "'\"internal\"'")], 4) + " ELSE " + _pretty(_FINDING_JSON, 4) + " END"
)
_MANIFEST_JSON = _pretty(
    [
        ("schema_version", f"'\"{R.SCHEMA}\"'"),
        ("tool", f"'\"{R.TOOL}\"'"),
        ("tool_version", f"'\"{R.TOOL_VERSION}\"'"),
        ("project_id", "'\"demo\"'"),
        ("package_id", "'\"demo-' || source_id || '\"'"),
        ("source", _pretty([("source_id", "'\"' || source_id || '\"'"), ("sha256", "'\"' || sha256(a.t) || '\"'")], 2)),
        ("derivative", _pretty([("path", f"'\"{R.SOURCE_ENTRY}\"'"), ("sha256", "'\"' || sha256(sanitized_text) || '\"'")], 2)),
        ("classification", "'\"' || classification || '\"'"),
        ("allowed_route", "'\"' || route || '\"'"),
        ("parser_coverage", f"'\"{R.COVERAGE}\"'"),
        ("token_map_created", "CASE WHEN n_tokens > 0 THEN 'true' ELSE 'false' END"),
        ("token_map_in_package", "'false'"),
        ("allowlist", "'[' || chr(10) || '" + "' || chr(10) || '".join(f'    "{e}"' + ("," if e != R.ENTRIES[-1] else "") for e in R.ENTRIES) + "' || chr(10) || '  ]'"),
    ],
    0,
)
_REPORT_JSON = _pretty(
    [
        ("schema_version", f"'\"{R.SCHEMA}\"'"),
        ("project_id", "'\"demo\"'"),
        ("source_id", "'\"' || source_id || '\"'"),
        ("finding_counts", "coalesce('{' || chr(10) || counts || chr(10) || '  }', '{}')"),
        ("findings", "coalesce('[' || chr(10) || listed || chr(10) || '  ]', '[]')"),
        ("residual_risk_count", "residual_risk"),
        ("second_scan", _pretty([("result", "'\"pass\"'"), ("blocking_findings", "'0'")], 2)),
        ("disclaimer", f"'\"{R.DISCLAIMER}\"'"),
    ],
    0,
)
#: Rows (source_id, pos, name, data) of the entries of every cleared document.
_ENTRIES_SQL = (
    _EXPORT_SQL
    + f""", kl AS (
  SELECT id, string_agg('    ' || {_FOUND_JSON}, ',' || chr(10) ORDER BY st) AS listed FROM p GROUP BY id
), kc AS (
  SELECT id, string_agg('    "' || severity || ':' || action || '": ' || n, ',' || chr(10) ORDER BY severity || ':' || action) AS counts FROM (SELECT id, severity, action, count(*) AS n FROM p GROUP BY ALL) GROUP BY id
), e4 AS (
  SELECT source_id, [sanitized_text, {_MANIFEST_JSON} || chr(10), {_REPORT_JSON} || chr(10), '{archive.README.replace(chr(10), "' || chr(10) || '")}'] AS data
  FROM g JOIN a ON a.id = source_id LEFT JOIN kl ON kl.id = source_id LEFT JOIN kc ON kc.id = source_id WHERE gate = 'ok'
), e AS (
  SELECT source_id, i - 1 AS pos, ({list(R.ENTRIES)!r})[i] AS name, data[i] AS data FROM e4, range(1, 5) r(i)
)"""
)
#: CRC-32 of the bytes of a text: reflected, with the polynomial EDB88320, from a table of the 256 single bytes.
_CRC_SQL = """, ct AS (
  SELECT list(c ORDER BY n) AS crc_table FROM (
    SELECT n, list_reduce(list_prepend(n::UBIGINT, range(8)::UBIGINT[]), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) b(n))
), cr AS (
  SELECT source_id, pos, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, octet_length(encode(data)) + 1), lambda i: ('0x' || substr(hex(encode(data)), 2 * i - 1, 2))::UBIGINT)),
         lambda c, b: xor(c >> 8, crc_table[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS crc32 FROM e, ct
)"""
_add(
    "package_entries",
    lambda s, d: archive.opened(packaged(s, d)).select(F.col("source_id").cast("long").alias("source_id"), "pos", "name", "n_bytes", "sha256"),
    _ENTRIES_SQL + " SELECT source_id, pos::BIGINT AS pos, name, octet_length(encode(data))::BIGINT AS n_bytes, sha256(data) AS sha256 FROM e",
)
_NAMES = "CASE doc_id % 6 WHEN 0 THEN 'SAFE_SOURCE/' || doc_id || '.md' WHEN 1 THEN '/abs' || doc_id WHEN 2 THEN 'a' || chr(92) || 'b' WHEN 3 THEN 'a/../b' WHEN 4 THEN '' ELSE 'a..b/c' END"
_add(
    "entry_name_guard",
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.expr(_NAMES).alias("name")).select("doc_id", "name", S.safe_entry_name(F.col("name")).alias("safe")),
    f"SELECT doc_id, {_NAMES} AS name, doc_id % 6 IN (0, 5) AS safe FROM documents",
)


_add(
    "crc32_entries",
    lambda s, d: archive.opened(packaged(s, d)).select(F.col("source_id").cast("long").alias("source_id"), "pos", "crc32"),
    _ENTRIES_SQL + _CRC_SQL + " SELECT source_id, pos::BIGINT AS pos, crc32 FROM cr",
)


def _sealed(s, d) -> DataFrame:
    return vault.encrypt_maps(W.token_entries(sanitized(s, d)), "nine quiet lanterns")


def _roundtrip(s, d):
    opened = vault.decrypt_maps(_sealed(s, d), "nine quiet lanterns")
    return opened.select("source_id", "status", F.explode("entries").alias("e")).select("source_id", "status", "e.token", "e.original", F.col("e.findingType").alias("finding_type"))


_add("vault_roundtrip", _roundtrip, _DECIDED + " SELECT id AS source_id, 'ok' AS status, token, v AS original, typ AS finding_type FROM p WHERE token IS NOT NULL")
_add(
    "vault_wrong_passphrase",
    lambda s, d: vault.decrypt_maps(_sealed(s, d), "nine loud lanterns").select("source_id", "status", F.col("entries").isNotNull().alias("opened")),
    _DECIDED + " SELECT DISTINCT id AS source_id, 'denied' AS status, false AS opened FROM p WHERE token IS NOT NULL",
)
#: A payload spoiled in one of several ways by its source's number.
_SPOILED = "CASE WHEN source_id % 5 = 0 THEN regexp_replace(payload, '\"salt\":\"....', '\"salt\":\"abc') WHEN source_id % 5 = 1 THEN regexp_replace(payload, '\"nonce\":\"...', '\"nonce\":\"*') WHEN source_id % 5 = 2 THEN replace(payload, 'scrypt', 'none') WHEN source_id % 5 = 3 THEN substr(payload, 1, 60) ELSE payload END"
_add(
    "vault_malformed",
    lambda s, d: vault.decrypt_maps(_sealed(s, d).withColumn("payload", F.expr(_SPOILED)), "nine quiet lanterns").select("source_id", "status"),
    _DECIDED + " SELECT DISTINCT id AS source_id, CASE WHEN id % 5 IN (0, 1) THEN 'denied' WHEN id % 5 IN (2, 3) THEN 'unsupported' ELSE 'ok' END AS status FROM p WHERE token IS NOT NULL",
)


def _tampered(s, d):
    sealed = _sealed(s, d)
    field = '"ciphertext":"'
    other = F.when(F.contains("payload", F.lit(field + "A")), F.lit(field + "B")).otherwise(F.lit(field + "A"))
    bad = sealed.select("source_id", F.regexp_replace("payload", F.lit(field + "."), other).alias("payload"))
    return vault.decrypt_maps(bad, "nine quiet lanterns").select("source_id", "status", F.col("entries").isNotNull().alias("opened"))


_add("vault_tamper", _tampered, _DECIDED + " SELECT DISTINCT id AS source_id, 'denied' AS status, false AS opened FROM p WHERE token IS NOT NULL")


_add(
    "zip_inspection",
    lambda s, d: packaged(s, d).select(F.col("source_id").cast("long").alias("source_id"), "package_sha256", F.octet_length("zip").cast("long").alias("zip_bytes")),
    # a stored archive: a local header and a directory entry for each file, and the end record
    _ENTRIES_SQL + " SELECT source_id, sha256(string_agg(name || data, '' ORDER BY pos)) AS package_sha256, (sum(30 + 46 + 2 * octet_length(encode(name)) + octet_length(encode(data))) + 22)::BIGINT AS zip_bytes FROM e GROUP BY source_id",
)
_POLICY_SQL = (
    "WITH "
    + _resolved_ctes(_SOURCE, "a", "f", ())
    + """, n AS (
  SELECT *, CASE WHEN typ IN ('email', 'phone', 'taiwan-id', 'exact-data') THEN '【' || upper(typ) || '-' || printf('%02d', row_number() OVER (PARTITION BY id, typ ORDER BY st)) || '】' ELSE '[REMOVED]' END AS nv,
         coalesce(lag(en) OVER (PARTITION BY id ORDER BY st), 0) AS pe FROM f
), j AS (
  SELECT n.id, count(*) AS n, string_agg(substr(a.t, pe + 1, st - pe) || nv, '' ORDER BY st) || substr(any_value(a.t), max(en) + 1) AS out FROM n JOIN a USING (id) GROUP BY n.id
), x AS (SELECT a.id AS source_id, coalesce(n, 0)::BIGINT AS n_findings, coalesce(out, a.t) AS sanitized_text FROM a LEFT JOIN j USING (id)), """
    + _resolved_ctes("SELECT source_id AS id, sanitized_text AS t FROM x", "a2", "f2", ())
    + ", b AS (SELECT id, count(*) FILTER (WHERE sev >= 2) AS n FROM f2 GROUP BY id)"
)
_add(
    "policy_stream_form",
    lambda s, d: sanitize_stream(augmented(s, d)).select("source_id", F.size("findings").cast("long").alias("n_findings"), "sanitized_text", "cleared"),
    _POLICY_SQL + " SELECT source_id, n_findings, sanitized_text, coalesce(n, 0) = 0 AS cleared FROM x LEFT JOIN b ON b.id = source_id",
)
def _decision_stream(s, d):
    """Documents and decisions written as files, read as streams, and of every source that was emitted the last row."""
    folder = f"{scratch_folder(s)}/stream-{uuid.uuid4().hex}"
    key = F.col("source_id").cast("string").alias("source_id")
    sides = {"docs": augmented(s, d).select(key, "text"), "decisions": decisions(found(s, d)).select(key, "finding_id", "seq", "action", "token_label", "replacement", "reason")}
    for name, rows in sides.items():
        rows.write.parquet(f"{folder}/{name}")
    streams = [s.readStream.schema(rows.schema).parquet(f"{folder}/{name}") for name, rows in sides.items()]

    def keep(rows, batch):
        rows.select("source_id", "version", "status", "sanitized_text").write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    query = review_stream(*streams, terms=TERMS).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.parquet(f"{folder}/out").groupBy("source_id").agg(F.max_by(F.struct("status", "sanitized_text"), "version").alias("x")).select("source_id", "x.*")


_add("decision_stream", _decision_stream, _DECIDED + " SELECT source_id::VARCHAR AS source_id, status, sanitized_text FROM x WHERE status = 'ok'")
#: Files made from pages: some with an ending that is looked at, some of which hold what is forbidden.
_FILE = f"""'src/p' || CAST(page_id AS STRING) || CASE CAST(page_id % 5 AS INT) WHEN 0 THEN '.ts' WHEN 1 THEN '.mjs' WHEN 2 THEN '.js' WHEN 3 THEN '.md' ELSE '.tsx' END"""
_CODE = """coalesce(html, '') || CASE CAST(page_id % 7 AS INT) WHEN 0 THEN ' await fetch (u)' WHEN 1 THEN ' http' || '://a.b' WHEN 2 THEN ' import x from "node:net"' WHEN 3 THEN ' Sentry.init() fetch(' WHEN 4 THEN ' prefetch(u) fromx "net" analyticss' ELSE '' END"""
_add(
    "policy_lint",
    lambda s, d: lint.violations(s.read.parquet(f"{d}/pages.parquet").select(F.expr(_FILE).alias("path"), F.expr(_CODE).alias("text")), exempt=("src/p0.ts", "src/p7.js")),
    # fixed values: the four rules and the endings, as above
    rf"""WITH files AS (SELECT {_FILE.replace(' AS STRING)', ' AS VARCHAR)')} AS path, {_CODE} AS t FROM pages) SELECT path, rule FROM (
  SELECT path, unnest([CASE WHEN regexp_matches(t, '\bhttps?://') THEN 'url' END, CASE WHEN regexp_matches(t, '\bfetch\s*\(') THEN 'fetch' END, CASE WHEN regexp_matches(t, 'from\s+[""''](?:node:)?(?:http|https|net|tls|dgram)[""'']') THEN 'network_module' END, CASE WHEN regexp_matches(t, '(?i)\b(?:axios|telemetry|analytics|sentry)\b') THEN 'telemetry' END]) AS rule
  FROM files WHERE regexp_matches(path, '\.(?:[cm]?js|ts)$') AND path NOT IN ('src/p0.ts', 'src/p7.js')) WHERE rule IS NOT NULL""",
)

#: Ids as careless tables have them: none, or one for two rows.
_ODD_ID = "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 IN (1, 2) THEN doc_id - doc_id % 7 ELSE doc_id END"


def _odd_sources(s, d):
    rows = spread(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).select("doc_id", F.expr(_ODD_ID).alias("source_id"), F.expr(AUGMENTED).alias("text"))
    known = findings(rows, "source_id", terms=TERMS)
    all_deleted = known.select("source_id", "finding_id", F.lit(1).alias("seq"), F.lit("delete").alias("action"), *[F.lit(None).cast("string").alias(c) for c in ("token_label", "replacement", "reason")])
    out = W.sanitize(rows, all_deleted, TERMS, carry=["doc_id"])
    return out.select("carry.doc_id", "status", R.sha256(F.col("sanitized_text")).alias("text_sha256"), "n_public")


_add(
    "odd_sources",
    _odd_sources,
    _FOUND
    + f""", t AS (SELECT *, coalesce(lag(en) OVER (PARTITION BY id ORDER BY st), 0) AS pe FROM f), j AS (
  SELECT t.id, count(*) AS n, string_agg(substr(a.t, pe + 1, st - pe) || '[REMOVED]', '' ORDER BY st) || substr(any_value(a.t), max(en) + 1) AS out FROM t JOIN a USING (id) GROUP BY t.id
), o AS (SELECT doc_id, {_ODD_ID} AS source_id, count(*) OVER (PARTITION BY {_ODD_ID}) AS k FROM documents)
SELECT doc_id, CASE WHEN source_id IS NULL THEN 'no_source_id' WHEN k > 1 THEN 'duplicate_source' ELSE 'ok' END AS status,
       sha256(CASE WHEN source_id IS NULL OR k > 1 THEN a.t ELSE coalesce(j.out, a.t) END) AS text_sha256, CASE WHEN source_id IS NULL OR k > 1 THEN 0 ELSE coalesce(n, 0) END AS n_public
FROM o JOIN a ON a.id = doc_id LEFT JOIN j ON j.id = doc_id""",
)
#: A detector whose pattern finds the empty text nearly everywhere: only its digits count.
_DIGITS = Detector("digits", "digits", "low", "[0-9]*", "")
_add(
    "empty_matches",
    lambda s, d: spread(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))
    .select("doc_id", F.explode(matches(F.col("text"), _DIGITS, 0)).alias("m"))
    .select("doc_id", F.col("m.start").cast("long").alias("start_at"), F.col("m.value").alias("value")),
    """SELECT doc_id, st::BIGINT AS start_at, v AS value FROM (
  SELECT doc_id, m[i] AS v, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS st
  FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS m, string_split_regex(text, '[0-9]+') AS g FROM documents)))""",
)


_BODY = """c_name || ' said "hi",' || chr(10) || 'mail u' || {id} || '@example.com' || chr(9) || 'end'"""


def _delimited(sep: str):
    """Customers written as delimited files and read back as documents."""

    def run(s, d):
        folder = f"{scratch_folder(s)}/source-{uuid.uuid4().hex}"
        rows = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("id"), F.expr(_BODY.format(id="CAST(c_custkey AS STRING)")).alias("body"))
        rows.write.csv(folder, header=True, sep=sep, escape='"')
        back = readers.read_csv(s, folder, "id", "body", sep)
        return back.select("source_id", "source_sha256", "coverage", F.size(detect(F.col("text"))).cast("long").alias("n_findings"))

    return run


_DELIMITED_SQL = f"SELECT c_custkey::VARCHAR AS source_id, sha256({_BODY.format(id='c_custkey::VARCHAR')}) AS source_sha256, '{R.COVERAGE}' AS coverage, 1::BIGINT AS n_findings FROM customer"
_add("source_csv", _delimited(","), _DELIMITED_SQL)
_add("source_tsv", _delimited("\t"), _DELIMITED_SQL)


#: Documents as records of a delimited file, most of them damaged in one of several ways by their number.
_QUOTED = """'"' || replace(coalesce(text, ''), '"', '""') || '"'"""
_DAMAGED = f"""CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN {_ID} || ',' || {_QUOTED} || ',more' WHEN 1 THEN {_ID}
 WHEN 2 THEN {_ID} || ',' || {_QUOTED} || 'tail' WHEN 3 THEN {_ID} || ',two "words" here' ELSE {_ID} || ',' || {_QUOTED} END"""


def _damaged(s, d):
    """Documents written as such files and read back; of those that end in 5 the last byte of the text is no UTF-8."""
    folder = f"{scratch_folder(s)}/source-{uuid.uuid4().hex}"
    record = F.expr(_DAMAGED)
    broken = F.concat(F.substring(F.encode(record, "UTF-8"), F.lit(1), F.octet_length(record) - 1), F.unhex(F.lit("FF22")))
    rows = spread(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))
    rows.select(F.when(F.col("doc_id") % 6 == 5, broken.cast("string")).otherwise(record).alias("value")).write.text(folder)
    return readers.read_csv(s, folder, "id", "body", columns=["id", "body"])


_add(
    "source_csv_damaged",
    lambda s, d: _damaged(s, d).select("source_id", "coverage", F.when(F.col("coverage") == R.COVERAGE, F.col("source_sha256")).alias("source_sha256")),
    f"SELECT doc_id::VARCHAR AS source_id, CASE WHEN doc_id % 6 = 4 THEN '{R.COVERAGE}' ELSE '{readers.PARTIAL}' END AS coverage, CASE WHEN doc_id % 6 = 4 THEN sha256(coalesce(text, '')) END AS source_sha256 FROM documents",
)
_add(
    "coverage_gate",
    lambda s, d: _damaged(s, d).select(F.col("source_id").cast("long").alias("doc_id"), G.export_status(F.lit("P1"), F.lit("cloud-approved"), F.col("text"), coverage=F.col("coverage")).alias("gate")),
    "WITH "
    + _resolved_ctes("SELECT doc_id AS id, coalesce(text, '') AS t FROM documents", "a", "f", ())
    + ", b AS (SELECT DISTINCT id FROM f WHERE sev >= 2) SELECT doc_id, CASE WHEN doc_id % 6 <> 4 THEN 'incomplete_coverage' WHEN b.id IS NOT NULL THEN 'blocked_scan' ELSE 'ok' END AS gate FROM documents LEFT JOIN b ON b.id = doc_id",
)


def _text_files(s, d):
    """Customers' lines written as a few text files, each of which is a document."""
    folder = f"{scratch_folder(s)}/source-{uuid.uuid4().hex}"
    line = F.concat("c_name", F.lit(" mail u"), F.col("c_custkey").cast("string"), F.lit("@example.com"))
    rows = s.read.parquet(f"{d}/customer.parquet").select(line.alias("value"), (F.col("c_custkey") % 5).cast("int").alias("part"))
    rows.repartition(5, "part").sortWithinPartitions("part", "value").write.partitionBy("part").text(folder)
    back = readers.read_text(s, f"{folder}/part=*")
    return back.select("source_sha256", "coverage", F.size(detect(F.col("text"))).cast("long").alias("n_findings"))


_add(
    "source_text_files",
    _text_files,
    f"SELECT sha256(string_agg(c_name || ' mail u' || c_custkey || '@example.com' || chr(10), '' ORDER BY c_name || ' mail u' || c_custkey)) AS source_sha256, '{R.COVERAGE}' AS coverage, count(*) AS n_findings FROM customer GROUP BY c_custkey % 5",
)


def _archive_files(s, d):
    """The archives written to files, and what is read back from them."""
    folder = f"{scratch_folder(s)}/packages-{uuid.uuid4().hex}"
    archive.save_packages(packaged(s, d), folder.removeprefix("file:"))
    return archive.opened(archive.read_packages(s, folder)).select(F.col("source_id").cast("long").alias("source_id"), "pos", "name", "sha256")


_add("archive_files", _archive_files, _ENTRIES_SQL + " SELECT source_id, pos::BIGINT AS pos, name, sha256(data) AS sha256 FROM e")
