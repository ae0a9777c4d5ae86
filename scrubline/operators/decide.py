"""Decisions: the last one for each finding, looked up by (source, finding), and their validation.

A decision is never applied to another text than the one its finding id was made from, whatever the
source ids are: a row without an id has no decisions and is in error, and so are all rows of an id
that more than one row has.

Most rows of a large table have no findings, so texts do not travel to their decisions. Texts are
detected once (``hits``); what goes through the exchanges is the ids of the rows that have findings,
with the findings without their values (``verdicts``). The verdicts then meet the texts: from a
broadcast where they are small, else by a join of those texts alone that a detector may match
(``with_verdicts``). A row without findings is not shuffled in either case.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions import scalars as S
from scrubline.functions.folds import cut, let, lookup

from .catalog import ACTIONS, FORCED_DELETE
from .detect import detect, may_hold

KEY = ["source_id", "finding_id"]
FIELDS = ["action", "token_label", "replacement", "reason"]
DECISION = "struct<action:string,token_label:string,replacement:string,reason:string>"
#: What is kept of a finding between the steps; its value is the text's from start to end.
SLIM = ["finding_id", "type", "severity", "start", "end", "masked_preview", "detector"]
#: Verdicts of so many bytes are broadcast; a row and a finding are counted with so many.
BROADCAST_BYTES, ROW_BYTES, FINDING_BYTES = 32 << 20, 100, 400
#: Repeated ids are known by so many cells of their hash, which bounds what is broadcast of them.
CELLS = 1 << 16


def last_decisions(decisions: DataFrame) -> DataFrame:
    """Of several decisions for a finding the one with the largest ``seq`` counts.

    Of equal ``seq`` (null comes first) the one with the largest action, label, replacement and
    reason, in this order. Decisions without a source or a finding count for nothing.
    """
    known = decisions.where(F.col("source_id").isNotNull() & F.col("finding_id").isNotNull())
    one = F.struct(*FIELDS)
    return known.groupBy(*KEY).agg(F.max_by(one, F.struct("seq", *FIELDS)).alias("d")).select(*KEY, *[f"d.{c}" for c in FIELDS])


def with_decisions(docs: DataFrame, decisions: DataFrame, carry: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(source_id, text, carry, decisions, repeated): documents with the map of their decisions, by one join.

    Before the join the decisions are combined by finding, and of the documents only the ids are
    counted. ``carry`` is a struct of further columns of the documents.
    """
    last = last_decisions(decisions).select("source_id", F.struct(F.col("finding_id").alias("key"), F.struct(*FIELDS).cast(DECISION).alias("value")).alias("d"))
    ids = docs.where(F.col("source_id").isNotNull()).groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    side = last.withColumn("again", F.lit(False)).unionByName(ids.select("source_id", F.lit(True).alias("again")), allowMissingColumns=True)
    side = side.groupBy("source_id").agg(F.map_from_entries(F.collect_list("d")).alias("decisions"), F.bool_or("again").alias("again"))
    rows = docs.select("source_id", "text", F.struct(*carry).alias("carry") if carry else F.lit(None).alias("carry"))
    return rows.join(side, "source_id", "left").select("source_id", "text", "carry", "decisions", F.coalesce("again", F.lit(False)).alias("repeated"))


def hits(docs: DataFrame, terms: list[str] | tuple[str, ...] = (), more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(source_id, mark, found): the rows with an id and findings; neither texts nor values, so it may be written down.

    ``mark`` is a hash of the text. ``more`` adds a column of this name, made from ``found`` with its values.
    """
    rows = docs.where(F.col("source_id").isNotNull()).select("source_id", F.xxhash64("text").alias("mark"), detect(F.col("text"), terms).alias("found"))
    # exploded, not filtered: a filter would be pushed down and detect every text twice
    rows = rows.select(F.explode(F.when(F.size("found") > 0, F.array(F.struct("*")))).alias("x")).select("x.*")
    slim = F.transform("found", lambda f: F.struct(*[f[c].alias(c) for c in SLIM])).alias("found")
    if more:
        rows = more(rows)
    return rows.select("source_id", "mark", slim, *(["more"] if more else []))


def listed(found: DataFrame) -> DataFrame:
    """(source_id, finding_id, type, severity, start, end, masked_preview, detector): one row for each finding of ``hits``."""
    return found.select("source_id", F.explode("found").alias("x")).select("source_id", "x.*")


def decision_maps(decisions: DataFrame) -> DataFrame:
    """(source_id, decisions): a map from finding to the decision that counts, as ``last_decisions`` has it.

    A source's decisions are brought together by one exchange and sorted inside its row; of a finding the last one stays.
    """
    known = decisions.where(F.col("source_id").isNotNull() & F.col("finding_id").isNotNull())
    sources = known.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("finding_id", "seq", *FIELDS))).alias("said"))
    last = F.filter("said", lambda x, i: F.coalesce(F.get("said", i + 1)["finding_id"] != x["finding_id"], F.lit(True)))
    pair = lambda x: F.struct(x["finding_id"].alias("key"), F.struct(*[x[c].alias(c) for c in FIELDS]).cast(DECISION).alias("value"))
    return sources.select("source_id", F.map_from_entries(F.transform(last, pair)).alias("decisions"))


def verdicts(found: DataFrame, docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """(source_id, repeated, mark, judged, first_error, n_open): one row for each source of ``hits``, and for each id that several rows of docs have.

    Of docs only the ids are shuffled, to be counted.
    """
    ids = docs.where(F.col("source_id").isNotNull()).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    again = ids.where("n > 1").select("source_id", F.lit(True).alias("repeated"))
    single = found.join(again, "source_id", "left_anti").join(decision_maps(decisions), "source_id", "left")
    extra = ["more"] if "more" in found.columns else []
    judged = review(single).select("source_id", F.lit(False).alias("repeated"), "mark", "judged", "first_error", "n_open", *extra)
    return judged.unionByName(again, allowMissingColumns=True)


def with_verdicts(docs: DataFrame, verdicts: DataFrame, terms: list[str] | tuple[str, ...] = (), carry: list[str] | tuple[str, ...] = (), limit: int = BROADCAST_BYTES) -> DataFrame:
    """Reviewed rows (source_id, text, carry, judged, first_error, n_open, status), one for each of docs (source_id, text).

    verdicts: of these docs, written down before, since they are read several times. Where all of them
    are estimated at ``limit`` bytes at most they are broadcast. Else the texts that a detector may
    match, and those whose id may be repeated, are joined with them; all other rows stay where they
    are. A text that is not the one that was judged has the status text_changed.
    """
    rows = docs.select("source_id", "text", F.struct(*carry).alias("carry") if carry else F.lit(None).alias("carry"))
    size = verdicts.agg(F.sum(F.lit(ROW_BYTES) + F.coalesce(F.size("judged"), F.lit(0)) * F.lit(FINDING_BYTES))).first()[0] or 0
    if size <= limit:
        met = rows.join(F.broadcast(verdicts), "source_id", "left")
    else:
        cell = F.pmod(F.xxhash64("source_id"), F.lit(CELLS)).cast("int")
        cells = verdicts.where("repeated").select(cell.alias("cell"), F.lit(True).alias("taken")).distinct()
        marked = rows.withColumn("cell", cell).join(F.broadcast(cells), "cell", "left").drop("cell")
        asked = F.col("source_id").isNotNull() & (F.coalesce("taken", F.lit(False)) | may_hold(F.col("text"), terms))
        met = marked.where(asked).drop("taken").join(verdicts, "source_id", "left")
        met = met.unionByName(marked.where(~asked).drop("taken"), allowMissingColumns=True)
    field = lambda x, c, part: part(x["start"], x["end"]) if c == "value" else x[c]
    kind = dict(verdicts.dtypes)["judged"]
    whole = cut(F.col("text"), F.coalesce("judged", F.array().cast(kind)), lambda x, i, part: F.struct(*[field(x, c, part).alias(c) for c in [*SLIM, "value", *FIELDS, "error"]]))
    changed = F.coalesce(F.col("mark") != F.xxhash64("text"), F.lit(False))
    met = met.withColumns({"repeated": F.coalesce("repeated", F.lit(False)), "n_open": F.coalesce("n_open", F.lit(0))})
    met = met.withColumn("status", _status(met.columns, F.when(changed, "text_changed")))
    return met.withColumn("judged", F.when(F.col("status") == "text_changed", F.filter(whole, lambda _: F.lit(False))).otherwise(whole))


def error(kind: Column, severity: Column, action: Column, reason: Column, replacement: Column) -> Column:
    """What is wrong with a decision, or null: unknown action, forced delete, keep without reason, nothing to generalize to."""
    return (
        F.when(action.isNull(), F.lit(None).cast("string"))
        .when(~action.isin(*ACTIONS), "unknown_action")
        .when(kind.isin(*FORCED_DELETE) & (action != "delete"), "must_delete")
        .when((action == "keep") & (severity != "low") & S.is_blank(reason), "keep_needs_reason")
        .when((action == "generalize") & S.is_blank(replacement), "generalize_needs_replacement")
    )


def by_policy(actions: dict[str, str]) -> Callable[[Column], Column]:
    """Decisions by a rule from type to action; types that it does not name, and those that must be, are deleted."""
    none = F.lit(None).cast("string")

    def choose(finding: Column) -> Column:
        action = F.lit("delete")
        for kind, wanted in sorted(actions.items()):
            if kind not in FORCED_DELETE:
                action = F.when(finding["type"] == kind, wanted).otherwise(action)
        return F.struct(action.alias("action"), none.alias("token_label"), none.alias("replacement"), none.alias("reason"))

    return choose


def review(rows: DataFrame, terms: list[str] | tuple[str, ...] = (), choose: Callable[[Column], Column] | None = None) -> DataFrame:
    """The rows with ``judged`` (findings with their decision and its error), ``first_error`` and ``status``.

    rows: ``text`` and, unless ``choose`` makes a decision from a finding, ``decisions``, a map from
    finding id to decision; a column ``found`` with the findings is taken as it is. Narrow, so batch or
    stream. The status is the first that holds: no_source_id (``source_id`` is a column and null),
    duplicate_source (``repeated`` is a column and true), no_text, error, unresolved, ok.
    """
    if "found" not in rows.columns:
        rows = rows.withColumn("found", detect(F.col("text"), terms))
    fields = rows.schema["found"].dataType.elementType.names
    meet = lambda decide: F.transform("found", lambda f: F.struct(*[f[c].alias(c) for c in fields], decide(f).alias("d")))
    if choose is None:
        # sorted once, then halved: a look-up in a map goes through all of its keys
        known = lambda e, keys: meet(lambda f: lookup(keys, e, f["finding_id"])["value"])
        met = let(F.sort_array(F.map_entries("decisions")), lambda e: let(F.transform(e, lambda x: x["key"]), lambda keys: known(e, keys)))
    else:
        met = meet(choose)
    # one projection each, so that what is used several times is computed once
    rows = rows.withColumn("met", met)
    judged = F.transform(
        "met",
        lambda x: F.struct(
            *[x[c].alias(c) for c in fields],
            *[x["d"][c].alias(c) for c in FIELDS],
            error(x["type"], x["severity"], x["d"]["action"], x["d"]["reason"], x["d"]["replacement"]).alias("error"),
        ),
    )
    rows = rows.withColumn("judged", judged)
    rows = rows.withColumns(
        {
            "first_error": F.get(F.filter("judged", lambda x: x["error"].isNotNull()), F.lit(0))["error"],
            "n_open": F.size(F.filter("judged", lambda x: x["action"].isNull())),
        }
    )
    return rows.withColumn("status", _status(rows.columns)).drop("found", "met")


def _status(columns: list[str], other: Column | None = None) -> Column:
    """The first state that holds, of those whose columns are there; ``other`` stands before the decisions' own."""
    state = F.when(F.col("source_id").isNull() if "source_id" in columns else F.lit(False), "no_source_id")
    if "repeated" in columns:
        state = state.when(F.col("repeated"), "duplicate_source")
    if "text" in columns:
        state = state.when(F.col("text").isNull(), "no_text")
    own = F.when(F.col("first_error").isNotNull(), "error").when(F.col("n_open") > 0, "unresolved").otherwise("ok")
    return state.otherwise(own if other is None else F.coalesce(other, own))


def validated(reviewed: DataFrame) -> DataFrame:
    """One row per finding with its decision, ``error``, and the ``status`` and ``first_error`` of its source."""
    rows = reviewed.select("source_id", "status", "first_error", F.explode(F.filter("judged", lambda x: x["finding_id"].isNotNull())).alias("x"))
    return rows.select("source_id", "status", "first_error", "x.*")


def unresolved(reviewed: DataFrame) -> DataFrame:
    """The findings without a decision."""
    return reviewed.select("source_id", F.explode(F.filter("judged", lambda x: x["action"].isNull())).alias("x")).select("source_id", "x.finding_id", "x.type")


class SanitizeError(ValueError):
    """Raised in strict mode for the first violation found."""


def require_valid(reviewed: DataFrame) -> None:
    """Strict mode: raises if any decision is in error or any row cannot be told from others; one row comes to the driver."""
    bad = reviewed.select("source_id", "status", "first_error").where("status in ('error', 'no_source_id', 'duplicate_source')").limit(1).collect()
    if bad:
        raise SanitizeError(f"source {bad[0]['source_id']}: {bad[0]['first_error'] or bad[0]['status']}")
