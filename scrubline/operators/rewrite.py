"""Rewriting: judged findings back into text, inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubline.functions import scalars as S
from scrubline.functions.folds import cut, let, lookup, ranks
from scrubline.sources.scratch import settle
from scrubline.sources.vault import Secret

from .decide import hits, listed, verdicts, with_verdicts
from .report import sha256

#: Fixed value: what stands for a deleted finding.
REMOVED = "[REMOVED]"
#: Hex digits of a value's hash that name its bucket, so 4096 buckets a label.
BUCKET_DIGITS = 3
#: A value is hot if it stands in more than this part of all places, so at most 1/HOT_PART are hot.
HOT_PART = 1 / 256


def label(token_label: Column, kind: Column) -> Column:
    return S.normalize_label(F.coalesce(F.when(token_label != "", token_label), kind))


def splice(text: Column, parts: Column) -> Column:
    """A text with sorted disjoint parts (start, end, new_value) put in."""

    def whole(p: Column) -> Column:
        before = lambda i: F.coalesce(F.get(p, i - 1)["end"], F.lit(0))
        # one more, which stands for the end of the text
        closed = F.concat(p, F.array(F.struct(F.length(text).alias("start"), F.length(text).alias("end"), F.lit("").alias("new_value"))))
        return F.array_join(let(closed, lambda c: cut(text, c, lambda x, i, part: F.concat(part(before(i), x["start"]), x["new_value"]))), "")

    return let(parts, whole)


def rewritten(reviewed: DataFrame, keep: list[str] | tuple[str, ...] = (), ordinals: str | None = None) -> DataFrame:
    """The columns ``keep`` and status, first_error, source_sha256, sanitized_text, residual_risk, n_unresolved, n_public, n_tokens, public, tokens.

    All or nothing: unless the status is ok the text stays as it is and nothing counts. ``public``
    may leave (no value, no offsets); ``tokens`` is SENSITIVE (tokens and what they stand for).
    A token's number counts the findings of its label in the row, or comes from ``ordinals``, an array
    with a number for each judged finding.
    """
    rows = reviewed.withColumn("named", F.transform("judged", lambda x: F.when(x["action"] == "tokenize", label(x["token_label"], x["type"]))))
    numbers = ranks(F.col("named"), F.transform("judged", lambda x: x["start"])) if ordinals is None else F.col(ordinals)
    token = lambda r: F.transform("named", lambda name, i: F.when(name.isNotNull(), S.token(name, F.get(r, i))))
    rows = rows.withColumn("token_of", let(numbers, token))

    def new_value(x: Column, token: Column) -> Column:
        return F.when(x["action"] == "delete", REMOVED).when(x["action"] == "tokenize", token).when(x["action"] == "generalize", S.trim(x["replacement"])).otherwise(x["value"])

    ok = F.col("status") == "ok"
    parts = F.zip_with("judged", "token_of", lambda x, token: F.struct(x["start"].alias("start"), x["end"].alias("end"), new_value(x, token).alias("new_value")))
    rows = rows.withColumn("parts", F.when(ok, parts))
    public = F.zip_with(
        "judged",
        "token_of",
        lambda x, token: F.struct(*[x[c].alias(c) for c in ("finding_id", "type", "severity", "masked_preview", "detector", "action")], token.alias("token"), F.when(x["reason"] != "", x["reason"]).alias("reason")),
    )
    entries = F.filter(F.zip_with("judged", "token_of", lambda x, token: F.struct(token.alias("token"), x["value"].alias("original"), x["type"].alias("finding_type"))), lambda e: e["token"].isNotNull())
    none = lambda c: F.filter(c, lambda _: F.lit(False))
    count = lambda c: F.when(ok, F.size(c)).otherwise(F.lit(0)).cast("long")
    return rows.select(
        *keep,
        "status",
        "first_error",
        sha256(F.col("text")).alias("source_sha256"),
        F.when(F.size("parts") > 0, splice(F.col("text"), F.col("parts"))).otherwise(F.col("text")).alias("sanitized_text"),
        count(F.filter("judged", lambda x: x["action"] == "keep")).alias("residual_risk"),
        F.when(F.col("status") == "unresolved", F.col("n_open")).otherwise(F.lit(0)).cast("long").alias("n_unresolved"),
        count("judged").alias("n_public"),
        count(F.filter("named", lambda name: name.isNotNull())).alias("n_tokens"),
        F.when(ok, public).otherwise(none(public)).alias("public"),
        F.when(ok, entries).otherwise(none(entries)).alias("tokens"),
    )


def sanitize(docs: DataFrame, decisions: DataFrame | Callable[[DataFrame], DataFrame], terms: list[str] | tuple[str, ...] = (), token_scope: str = "source", carry: list[str] | tuple[str, ...] = (), registry=None) -> DataFrame:
    """(source_id, carry, status, first_error, ...) of ``rewritten``, one row per row of docs (source_id, text).

    decisions: a table, or a function that makes one from the findings without their values (``decide.listed``),
    so that a rule over findings needs no detection of its own.
    token_scope="project" gives equal values one number over all sources; with a ``registry`` it is the
    number that the value has there, new values being entered. Findings are written to the session's
    checkpoint folder without their values, and docs are read again: a text that changes in between is
    not rewritten (status text_changed).
    """
    if token_scope == "project":
        secret = registry.secret if registry is not None else Secret()
        judged = with_numbers(settle(_judged(docs, decisions, terms, secret)), secret, registry)
    else:
        judged = _judged(docs, decisions, terms)
    rows = with_verdicts(docs, settle(judged), terms, carry)
    return rewritten(rows, ["source_id", "carry"], "numbers" if token_scope == "project" else None)


def _judged(docs: DataFrame, decisions: DataFrame | Callable[[DataFrame], DataFrame], terms: list[str] | tuple[str, ...], secret: Secret | None = None) -> DataFrame:
    """The verdicts on docs; with a secret they have ``more``, the protected value of each finding."""
    found = settle(hits(docs, terms, secret and (lambda rows: secret.protect(rows, F.transform("found", lambda x: x["value"]), "more"))))
    return verdicts(found, docs, decisions(listed(found)) if callable(decisions) else decisions)


def enter(docs: DataFrame, decisions: DataFrame | Callable[[DataFrame], DataFrame], registry, terms: list[str] | tuple[str, ...] = ()) -> None:
    """Enters what ``sanitize`` with this registry would enter, rewriting nothing: the texts need not meet their verdicts, nor these the numbers."""
    values = _places(_judged(docs, decisions, terms, registry.secret)).groupBy("label", "blind", "bucket").agg(F.first("sealed").alias("sealed"))
    registry.enter(values.select("label", "blind", "bucket", "sealed"))


def _name(x: Column) -> Column:
    return F.when(x["action"] == "tokenize", label(x["token_label"], x["type"]))


def _places(verdicts: DataFrame) -> DataFrame:
    """(source_id, label, blind, bucket, sealed): one row for each finding that becomes a token."""
    used = F.transform("judged", lambda x, i: F.struct(_name(x).alias("label"), F.get("more", i).alias("p")))
    used = F.filter(F.transform(used, lambda x: F.struct(x["label"].alias("label"), x["p"]["blind"].alias("blind"), x["p"]["bucket"].alias("bucket"), x["p"]["sealed"].alias("sealed"))), lambda x: x["label"].isNotNull())
    return verdicts.where("not repeated").select("source_id", F.explode(used).alias("x")).select("source_id", "x.*")


def numbered(values: DataFrame, secret: Secret) -> DataFrame:
    """(label, blind, bucket, sealed, ordinal) of distinct (label, blind, bucket, sealed): from 1 within each label, by (bucket, value).

    Each bucket's sealed values are opened and sorted inside one row, and moved by the sizes of the
    buckets before: no task holds a whole label, no value goes through an exchange, and a number depends
    neither on the partitioning nor on the secret.
    """
    one = F.struct("blind", "sealed")
    buckets = values.groupBy("label", "bucket").agg(F.collect_list(one).alias("held"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = buckets.select("label", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    opened = buckets.join(base, ["label", "bucket"]).withColumn("key", secret.key("bucket"))
    opened = opened.withColumn("open", F.transform("held", lambda x: F.struct(secret.unseal(x["sealed"], F.col("key")).alias("value"), x["blind"].alias("blind"), x["sealed"].alias("sealed"))))
    slim = F.transform(F.array_sort("open"), lambda x: F.struct(x["blind"].alias("blind"), x["sealed"].alias("sealed")))
    rows = opened.select("label", "bucket", "base", F.posexplode(slim).alias("pos", "x"))
    return rows.select("label", "x.blind", "bucket", "x.sealed", (F.col("base") + F.col("pos") + 1).alias("ordinal"))


def project_ordinals(values: DataFrame) -> DataFrame:
    """(label, value, ordinal) of distinct (label, value): from 1 within each label, by (hash bucket, value)."""
    secret = Secret()
    rows = secret.protect(values, F.array("value"), "p").select("label", F.col("p")[0]["blind"].alias("blind"), F.col("p")[0]["bucket"].alias("bucket"), F.col("p")[0]["sealed"].alias("sealed"))
    # sealing draws at random: written once, then read
    rows = numbered(settle(rows), secret).withColumn("key", secret.key("bucket"))
    return rows.select("label", secret.unseal(F.col("sealed"), F.col("key")).alias("value"), "ordinal")


def with_numbers(verdicts: DataFrame, secret: Secret, registry=None) -> DataFrame:
    """Verdicts with ``numbers``, for each judged finding the number of its (label, value) over all sources, instead of ``more``.

    Values of rows in error and of unresolved rows are numbered as well. Values are joined by their
    blind index. The few that stand in a large part of all places are looked up from a broadcast of at
    most 1/HOT_PART rows; all others are joined, where no key is large.
    """
    # of one value in a source one place is enough
    places = settle(_places(verdicts).groupBy("source_id", "label", "blind", "bucket").agg(F.first("sealed").alias("sealed")))
    # written once: it is read for the numbers, beside them and to be added up
    counted = settle(places.groupBy("label", "blind", "bucket").agg(F.first("sealed").alias("sealed"), F.count(F.lit(1)).alias("n")))
    if registry is None:
        known = numbered(counted.select("label", "blind", "bucket", "sealed"), secret).select("label", "blind", "ordinal")
    else:
        known = registry.enter(counted.select("label", "blind", "bucket", "sealed"))
    known = settle(known.join(counted.select("label", "blind", "n"), ["label", "blind"]))
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = known.where(F.col("n") > max(1.0, total * HOT_PART)).select("label", "blind", "ordinal")
    marked = places.select("source_id", "label", "blind").join(F.broadcast(hot), ["label", "blind"], "left")
    rest = marked.where("ordinal is null").drop("ordinal").join(known.select("label", "blind", "ordinal"), ["label", "blind"])
    entry = F.struct(F.struct("label", "blind").alias("key"), F.col("ordinal").alias("value"))
    lists = marked.where("ordinal is not null").unionByName(rest).groupBy("source_id").agg(F.array_sort(F.collect_list(entry)).alias("ordinals"))
    key = lambda x, p: F.struct(_name(x).alias("label"), p["blind"].alias("blind"))
    # the key, whose label is made by patterns, once a finding, not at each step of the halving
    number = lambda keys, known: F.zip_with("judged", "more", lambda x, p: let(key(x, p), lambda k: lookup(keys, known, k))["value"])
    numbers = let(F.col("ordinals"), lambda known: let(F.transform(known, lambda e: e["key"]), lambda keys: number(keys, known)))
    return verdicts.join(lists, "source_id", "left").withColumn("numbers", numbers).drop("more", "ordinals")


def public_findings(result: DataFrame) -> DataFrame:
    """What may leave, one row per finding: no value, no offsets."""
    fields = ("finding_id", "type", "severity", "masked_preview", "detector", "action", "token", "reason")
    return result.select("source_id", F.explode(F.transform("public", lambda x: F.struct(*[x[c].alias(c) for c in fields]))).alias("x")).select("source_id", *[f"x.{c}" for c in fields])


def token_entries(result: DataFrame) -> DataFrame:
    """SENSITIVE: tokens and what they stand for, one row each; never joined into exports."""
    fields = ("token", "original", "finding_type")
    return result.select("source_id", F.explode(F.transform("tokens", lambda x: F.struct(*[x[c].alias(c) for c in fields]))).alias("x")).select("source_id", *[f"x.{c}" for c in fields])


def rehydrate(text: Column, entries: Column) -> Column:
    """Puts originals (array of token, original) back in place of their tokens.

    The text is cut at its tokens once, and each token looked up, so an original that looks like a
    token is not replaced again; tokens without an entry stay. Of several entries of one token the one
    with the smallest original counts.
    """
    pattern = "【[^【】]*-[0-9]+】"
    known = F.array_sort(F.transform(entries, lambda e: F.struct(e["token"].alias("token"), e["original"].alias("original"))))
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("token"))

    def put_back(e: Column) -> Column:
        tokens, originals = F.transform(e, lambda x: x["token"]), F.transform(e, lambda x: x["original"])
        back = lambda k, v: F.transform(steps, lambda s: F.concat(s["gap"], F.coalesce(lookup(k, v, s["token"]), s["token"], F.lit(""))))
        return let(tokens, lambda k: let(originals, lambda v: back(k, v)))

    return F.array_join(let(known, put_back), "")
