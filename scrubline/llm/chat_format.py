"""Chat formatting: preference pairs with a shared, once-rendered prompt.

A pair of conversations (chosen and rejected) is split at its longest common turn prefix: that
prefix is rendered once as the prompt, and the rest of each conversation is rendered as its
completion. A completion is masked: only what the assistant says is trained on, given as the
character spans [start, end) of the completion that count.

Pairs come from the table itself: conversations that open with the same turn are one group, its
members are ranked (longest first, then smallest id), and each member but the first is the rejected
side of a pair with the first as chosen; a conversation that shares its opening with no other one is
paired with its own shortened form (its last assistant turn withheld). A group is never gathered:
only its best row is found by an aggregate, and each conversation then meets that one row. Where an
opening is hot, its conversations are salted by their ids and the best row is repeated for every salt.
Turns are ordered by (turn, role, text); rows of one conversation are gathered, groups of
conversations are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, table

TRAINED_ROLE = "assistant"
HOT_PART = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def conversations_as_rows(turns: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<turn, role, text>>): null roles and texts become empty strings."""
    clean = turns.select("conv_id", F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return clean.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def render_turn(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render_turn), "")


def common_prefix(a: Column, b: Column) -> Column:
    """The number of leading turns with equal role and text."""
    same = F.zip_with(a, b, lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b)).cast("long"))


def spans(turns: Column) -> Column:
    """The character ranges of a rendered list of turns that an assistant's words and end mark fill."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["role"]) + F.lit(len(OPEN) + 1)
        end = begin + F.length(t["text"]) + F.lit(len(CLOSE))
        mine = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + 1).cast("long").alias("at"), F.when(t["role"] == TRAINED_ROLE, F.concat(acc["out"], mine)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, zero, step, lambda acc: acc["out"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, chosen, rejected) turn lists -> prompt and two masked completions.

    An empty or null list counts as no turns; equal conversations give empty completions.
    """
    empty = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    p = pairs.withColumns({c: F.coalesce(c, empty) for c in ("chosen", "rejected")}).withColumn("shared", common_prefix(F.col("chosen"), F.col("rejected")).cast("int"))
    rest = lambda c: F.slice(c, F.col("shared") + 1, F.size(c))
    p = p.select("chosen_id", "rejected_id", "shared", F.slice("chosen", F.lit(1), F.col("shared")).alias("head"), rest("chosen").alias("a"), rest("rejected").alias("b"))
    return p.select(
        "chosen_id",
        "rejected_id",
        F.col("shared").cast("long").alias("prompt_turns"),
        render(F.col("head")).alias("prompt"),
        render(F.col("a")).alias("chosen"),
        render(F.col("b")).alias("rejected"),
        spans(F.col("a")).alias("chosen_spans"),
        spans(F.col("b")).alias("rejected_spans"),
    )


def preference_pairs(turns: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, chosen, rejected) of a table of turns; null ids form one conversation.

    An empty table gives no pairs. Repeated rows are turns of their own, and of turns that tie in number
    the smaller role and text comes first. Texts of any length are taken whole; other columns are
    ignored, whatever their names. Every conversation is in
    some pair, as chosen or as rejected; rejected_id equals chosen_id where a conversation stands
    against its own shortened form.
    """
    rows = conversations_as_rows(turns)
    rows = rows.select("conv_id", "turns", F.size("turns").alias("n"), F.xxhash64(F.element_at("turns", 1)["role"], F.element_at("turns", 1)["text"]).alias("opening"), F.element_at("turns", 1).alias("first"))
    key = ["opening", "role", "text"]
    rows = rows.select("conv_id", "turns", "n", "opening", F.col("first.role").alias("role"), F.col("first.text").alias("text"))
    order = F.struct((-F.col("n")).alias("n"), F.col("conv_id").isNull().alias("z"), F.col("conv_id").alias("id"))
    best = rows.groupBy(*key).agg(F.min(F.struct(order.alias("order"), F.col("turns").alias("turns"))).alias("best"), F.count(F.lit(1)).alias("members"))
    best = best.select(*key, F.col("best.order.id").alias("chosen_id"), F.col("best.turns").alias("chosen"), "members")
    # openings with more than 1/HOT_PART of all conversations, so HOT_PART at most
    total = best.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    hot = best.where(F.col("members") > max(1.0, total / HOT_PART)).select(*key, F.lit(True).alias("hot"))
    salts = partitions(turns.sparkSession)
    salted = rows.drop("n").join(F.broadcast(hot.select("opening", "hot").distinct()), "opening", "left")
    salted = salted.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("conv_id"), F.lit(salts))).otherwise(0)).drop("hot")
    spread = best.join(F.broadcast(hot.select("opening", "hot").distinct()), "opening", "left")
    spread = spread.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))).drop("hot")
    met = salted.join(spread, [*key, "salt"]).drop("salt")
    alone = F.col("conv_id").eqNullSafe(F.col("chosen_id"))
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED_ROLE, i)))
    shortened = F.when(last.isNotNull(), F.slice("turns", F.lit(1), last)).otherwise(F.col("turns"))
    return met.where(~alone | (F.col("members") == 1)).select(
        "chosen_id", F.col("conv_id").alias("rejected_id"), "chosen", F.when(alone, shortened).otherwise(F.col("turns")).alias("rejected")
    )


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every pair with its texts; the spans are given as strings start-end, comma-joined."""
    out = format_pairs(preference_pairs(table(spark, sf_dir, "conversations")))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return out.select("chosen_id", "rejected_id", "prompt_turns", "prompt", "chosen", "rejected", text("chosen_spans").alias("chosen_spans"), text("rejected_spans").alias("rejected_spans"))


OP8_SQL = rf"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations
), c AS (
  SELECT conv_id, count(*) AS n, max(k) FILTER (WHERE role = '{TRAINED_ROLE}') AS last_k FROM t GROUP BY conv_id
), f AS (
  SELECT c.conv_id, n, last_k, t.role, t.text FROM c JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id AND k = 1
), g AS (
  SELECT *, first_value(conv_id) OVER w AS chosen_id, count(*) OVER (PARTITION BY role, text) AS members
  FROM f WINDOW w AS (PARTITION BY role, text ORDER BY n DESC, conv_id NULLS LAST)
), p AS (
  SELECT chosen_id, conv_id AS rejected_id,
         CASE WHEN chosen_id IS NOT DISTINCT FROM conv_id THEN coalesce(last_k - 1, n) ELSE n END AS rejected_n
  FROM g WHERE chosen_id IS DISTINCT FROM conv_id OR members = 1
), z AS (
  SELECT p.*, (SELECT max(k) FROM t WHERE t.conv_id IS NOT DISTINCT FROM p.chosen_id) AS chosen_n FROM p
), s AS (
  SELECT z.chosen_id, z.rejected_id, chosen_n, rejected_n,
         coalesce(min(a.k) FILTER (WHERE b.k IS NULL OR a.role <> b.role OR a.text <> b.text), least(chosen_n, rejected_n) + 1) - 1 AS shared0
  FROM z LEFT JOIN t a ON a.conv_id IS NOT DISTINCT FROM z.chosen_id
  LEFT JOIN t b ON b.conv_id IS NOT DISTINCT FROM z.rejected_id AND b.k = a.k AND b.k <= z.rejected_n
  GROUP BY z.chosen_id, z.rejected_id, chosen_n, rejected_n
), r AS (
  SELECT *, '{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10) AS shown,
         length(role) + {len(OPEN) + 1} AS lead
  FROM t
), side AS (
  SELECT s.chosen_id, s.rejected_id, 'p' AS part, r.k, r.shown, r.lead, r.role FROM s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.chosen_id AND r.k <= shared0
  UNION ALL
  SELECT s.chosen_id, s.rejected_id, 'c', r.k, r.shown, r.lead, r.role FROM s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.chosen_id AND r.k > shared0
  UNION ALL
  SELECT s.chosen_id, s.rejected_id, 'r', r.k, r.shown, r.lead, r.role FROM s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.rejected_id AND r.k > shared0 AND r.k <= rejected_n
), e AS (
  SELECT *, sum(length(shown)) OVER (PARTITION BY chosen_id, rejected_id, part ORDER BY k) AS stop FROM side
), j AS (
  SELECT chosen_id, rejected_id, part, string_agg(shown, '' ORDER BY k) AS shown,
         string_agg((stop - length(shown) + lead)::BIGINT || '-' || (stop - 1)::BIGINT, ',' ORDER BY k) FILTER (WHERE role = '{TRAINED_ROLE}') AS spans
  FROM e GROUP BY chosen_id, rejected_id, part
)
SELECT s.chosen_id, s.rejected_id, s.shared0::BIGINT AS prompt_turns, coalesce(jp.shown, '') AS prompt, coalesce(jc.shown, '') AS chosen,
       coalesce(jr.shown, '') AS rejected, coalesce(jc.spans, '') AS chosen_spans, coalesce(jr.spans, '') AS rejected_spans
FROM s
LEFT JOIN j jp ON jp.chosen_id IS NOT DISTINCT FROM s.chosen_id AND jp.rejected_id IS NOT DISTINCT FROM s.rejected_id AND jp.part = 'p'
LEFT JOIN j jc ON jc.chosen_id IS NOT DISTINCT FROM s.chosen_id AND jc.rejected_id IS NOT DISTINCT FROM s.rejected_id AND jc.part = 'c'
LEFT JOIN j jr ON jr.chosen_id IS NOT DISTINCT FROM s.chosen_id AND jr.rejected_id IS NOT DISTINCT FROM s.rejected_id AND jr.part = 'r'
"""
