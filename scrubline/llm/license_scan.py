"""License scans: an exact set-similarity join of blocks of text with license templates.

A block is a run of consecutive words, over line and sentence ends, of ``SPAN`` times the words of
the template that it is held against; one starts at every word. Block and template are sets of
words, and a block contains a template if it has the part ``threshold`` of the template's words.
Words are ordered by their document frequency over the whole corpus, rarest first. With n words in a
template, t*n of which a block must have (rounded up: ``least``), only documents are candidates in which

* prefix: one of the template's first n - least + 1 words stands: documents and the table of prefixes
  are joined on these words, each pair once, by the first prefix word that they share;
* length: ``least`` words of the templates' vocabulary or more stand;
* position: after that first shared word enough words are left in both.

The filters lose nothing. Of the candidates every block that starts with one of the template's words
is verified. A block must also hold what tells the license from its neighbours (name and version),
whatever other words are missing. The template side is a table, so the plan is of the same size for
any number of templates; it is broadcast while it is small. No Python runs on rows, and nothing is
shuffled but word counts and matches.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty
from .license_templates import BODIES, MARKS, TEMPLATES

#: Words are runs of [0-9A-Za-z] and non-ASCII characters.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same as [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+; Java matches the positive form 20 times as fast.
LETTER = r"[0-9A-Za-z\x80-\x{10FFFF}]"
WORD = LETTER + "+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The base phrases, each ending in "license", and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
THRESHOLD = 0.8
#: A block has so many times the words of its template.
SPAN = 4
#: Template tables of up to so many bytes are broadcast.
BROADCAST_BYTES = 8_000_000
SALTS = 16
_ROW = "token string, at int, label string, words array<string>, first array<string>, n int, least int, span int, marks array<string>"


def words_of(text: str) -> list[str]:
    """The words of a template's text."""
    return re.findall("[0-9a-z]+", text.lower())


def vocabulary(templates: dict[str, str]) -> list[str]:
    return sorted({w for t in templates.values() for w in words_of(t)})


def all_templates(templates: dict[str, str] | None = None) -> list[tuple[str, list[str], list[tuple[str, ...]]]]:
    """(label, words, phrases) of the caller's templates, which have no phrases, or of the published ones."""
    if templates is not None:
        return [(label, words_of(text), []) for label, text in sorted(templates.items())]
    short = [(label, words_of(text), MARKS.get(label, [])) for label, text in sorted(TEMPLATES.items())]
    return short + [(label, words_of(text), [phrases] if phrases else []) for label, text, phrases in BODIES]


def _lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(_lower(text), F.lit(WORD), F.lit(0))


def _listed(words: list[str]) -> Column:
    return F.from_json(F.lit(json.dumps(words)), "array<string>")


def document_frequencies(docs: DataFrame, words: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many of all documents each word stands. The result has one row per given word."""
    counted = docs.select(F.explode(F.array_intersect(_listed(words), _words(text_or_empty(text_col)))).alias("w")).groupBy("w").count()
    return {r["w"]: r["count"] for r in counted.collect()}  # as many rows as the templates have words, at most


def prefix_rows(templates: list[tuple[str, list[str], list[tuple[str, ...]]]], order: dict[str, int], threshold: float) -> list[dict]:
    """One row per template and word of its prefix; words in their global order."""
    rows = []
    for label, text, phrases in templates:
        words = sorted(set(text), key=order.__getitem__)
        least = math.ceil(threshold * len(words) - 1e-9)
        first = sorted({*words, *(p.split()[0] for line in phrases for p in line)})
        marks = [f"(?<![^ ])(?:{'|'.join(line)})(?![^ ])" for line in phrases]
        one = {"label": label, "words": words, "first": first, "n": len(words), "least": least, "span": SPAN * len(text), "marks": marks}
        rows += [{"token": w, "at": k, **one} for k, w in enumerate(words[: len(words) - least + 1])]
    return rows


def _blocks(words: Column, t: Column) -> Column:
    """(first, last, part) of every stretch of blocks that contain the template, in order."""
    starts = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(t["first"], w), i)), lambda i: i.isNotNull())

    def part(run: Column) -> Column:
        shared = F.size(F.array_intersect(t["words"], run))
        joined = F.array_join(run, " ")
        return F.when((shared >= t["least"]) & F.forall(t["marks"], lambda m: F.regexp_like(joined, m)), shared / t["n"])

    # an array of one, so that a run is taken once
    parts = F.transform(starts, lambda i: F.struct(i.alias("first"), F.least(i + t["span"], F.size(words)).alias("last"), F.get(F.transform(F.array(F.slice(words, i + 1, t["span"])), part), F.lit(0)).alias("part")))
    hits = F.filter(parts, lambda h: h["part"].isNotNull())

    def step(acc: Column, h: Column) -> Column:
        end = F.get(acc, F.size(acc) - 1)
        wider = F.struct(end["first"].alias("first"), h["last"].alias("last"), F.greatest(end["part"], h["part"]).alias("part"))
        return F.when(end.isNotNull() & (h["first"] <= end["last"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(h)))

    return F.aggregate(hits, F.array().cast("array<struct<first:int,last:int,part:double>>"), step)


def license_blocks(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, text_col: str = "text", carry: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(carry, text_key, label, first, last, part): every stretch of text that contains a template.

    Words first to last (exclusive, from 0) are a union of overlapping blocks, part is the best
    containment of one of them; text_key is the SHA-256 of the text. Null text counts as empty.
    """
    spark = docs.sparkSession
    known = all_templates(templates)
    frequency = document_frequencies(docs, sorted({w for _, text, _ in known for w in text}), text_col)
    order = sorted({w for _, text, _ in known for w in text}, key=lambda w: (frequency.get(w, 0), w))
    listed = json.dumps(prefix_rows(known, {w: i for i, w in enumerate(order)}, threshold))
    prefixes = spark.range(1).select(F.explode(F.from_json(F.lit(listed), f"array<struct<{_ROW.replace(' ', ':').replace(',:', ',')}>>")).alias("t")).select(F.col("t.token").alias("token"), "t")
    tokens = sorted({r["token"] for r in json.loads(listed)})
    rows = docs.select(*carry, F.sha2(text_or_empty(text_col), 256).alias("text_key"), _words(text_or_empty(text_col)).alias("words"))
    rows = rows.withColumn("found", F.array_intersect(_listed(order), "words"))  # in global order
    probes = rows.select("*", F.explode(F.array_intersect("found", _listed(tokens))).alias("token"))
    met = probes.join(F.broadcast(prefixes) if len(listed) <= BROADCAST_BYTES else prefixes, "token")
    before, n_found = F.slice("t.words", F.lit(1), F.col("t.at")), F.size("found")
    once = ~F.arrays_overlap(before, "found")
    left = F.least(F.col("t.n") - F.col("t.at"), n_found - F.array_position("found", F.col("token")).cast("int") + 1)
    shared = F.size(F.array_intersect("t.words", F.col("found")))
    possible = met.where((n_found >= F.col("t.least")) & once & (left >= F.col("t.least")) & (shared >= F.col("t.least")))
    out = possible.select(*carry, "text_key", F.col("t.label").alias("label"), F.explode(_blocks(F.col("words"), F.col("t"))).alias("b"))
    return out.select(*carry, "text_key", "label", "b.first", "b.last", "b.part")


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks per document.

    n_base counts all places of the base phrases; first_word and last_word are the smallest and
    largest of their first words' numbers, null if there is none. labels has the base labels and the
    labels of the templates that some block contains, along with their marks; templates of the
    caller's own have no marks. score is the largest containment of a matched template, 1.0 if a base
    phrase was found, else 0. blocks lists label@first-last of ``license_blocks``, sorted and
    comma-joined. Null text counts as empty (no words, empty labels, score 0). Equal texts have equal
    results, repeated rows give repeated rows; texts of any length are scanned whole; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    raw = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("raw"))
    phrases = "|".join(GAP.join(map(re.escape, p.split())) for p in BASE)
    flagged = F.col("raw").rlike("(?i)" + "|".join(f"{p.split()[0]}{GAP}{p.split()[1]}" for p in BASE))

    # places: every word with the two after it, only for rows that hold a phrase's letters at all
    lowered = _words(F.col("raw"))
    trio = F.arrays_zip(lowered.alias("a"), F.slice(lowered, F.lit(2), F.size(lowered)).alias("b"), F.slice(lowered, F.lit(3), F.size(lowered)).alias("c"), F.sequence(F.lit(0), F.size(lowered) - 1).alias("i"))

    def label_of(x: Column) -> Column:
        out = None
        for phrase, label in BASE.items():
            p = phrase.split()
            hit = (x["a"] == p[0]) & (x["b"] == p[1]) & ((x["c"] == p[2]) if len(p) == 3 else F.lit(True))
            out = F.when(hit, label) if out is None else out.when(hit, label)
        return out

    place = F.filter(F.transform(trio, lambda x: F.struct(label_of(x).alias("label"), x["i"].cast("long").alias("at"))), lambda y: y["label"].isNotNull())
    no_place = F.array().cast("array<struct<label:string,at:bigint>>")
    places = F.when(flagged & F.col("raw").rlike("(?i)" + phrases), place).otherwise(no_place)
    base = raw.select("doc_id", F.sha2("raw", 256).alias("text_key"), F.regexp_count("raw", F.lit(WORD)).cast("long").alias("n_words"), places.alias("places"))

    found = license_blocks(raw, templates, threshold, "raw")
    place_of = F.format_string("%s@%d-%d", F.col("label"), F.col("first"), F.col("last"))
    # copies have one text: their blocks are one group of a few rows each
    matches = found.groupBy("text_key").agg(F.collect_set("label").alias("found"), F.max("part").alias("part"), F.array_join(F.array_sort(F.collect_set(place_of)), ",").alias("blocks"))
    # a text that very many rows have meets its blocks in several partitions
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    spread = matches.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    step = base.withColumn("salt", salt).join(spread, ["text_key", "salt"], "left")
    starts, named = F.transform("places", lambda p: p["at"]), F.transform("places", lambda p: p["label"])
    return step.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(named, F.coalesce("found", F.array().cast("array<string>"))))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("part", F.lit(0.0))).alias("score"),
        F.coalesce("blocks", F.lit("")).alias("blocks"),
    )


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _op2_sql() -> str:
    """The same result without filters: how many words of a template each block has, by a sweep over the places where words come and go."""
    known = all_templates()
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ",\n    ".join(
        f"({k}, '{label}', {quoted(sorted(set(text)))}, {len(set(text))}, {math.ceil(THRESHOLD * len(set(text)) - 1e-9)}, {SPAN * len(text)}, {'[' + ', '.join(quoted(p.split()) for p in (phrases[0] if phrases else ())) + ']::VARCHAR[][]'})"
        for k, (label, text, phrases) in enumerate(known)
    )
    return rf"""
WITH templates(t, label, words, n, least, span, phrases) AS (VALUES
    {rows}
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents
), w AS (
  SELECT rid, doc_id, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d
), p AS (
  SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), q AS (
  SELECT rid, i - 1 AS i, ws[i] AS word, ws[i + 1] AS w2, ws[i + 2] AS w3, ws FROM p
), b AS (
  SELECT rid, i AS pos,
         CASE WHEN word = 'mit' AND w2 = 'license' THEN 'mit'
              WHEN word = 'apache' AND w2 = 'license' THEN 'apache'
              WHEN word = 'general' AND w2 = 'public' AND w3 = 'license' THEN 'gpl' END AS label
  FROM q
), base AS (
  SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS ls
  FROM b WHERE label IS NOT NULL GROUP BY rid
), tw AS (
  SELECT t, unnest(words) AS word FROM templates
), cand AS (
  SELECT rid, t FROM (SELECT DISTINCT rid, word FROM q WHERE word IN (SELECT word FROM tw)) JOIN tw USING (word) JOIN templates USING (t)
  GROUP BY rid, t, least HAVING count(*) >= least
), ph AS (
  SELECT t, unnest(phrases) AS phrase FROM templates
), occ AS (
  SELECT rid, t, span, i, lag(i) OVER (PARTITION BY rid, t, word ORDER BY i) AS before FROM cand JOIN templates USING (t) JOIN q USING (rid) JOIN tw USING (t, word)
), ev AS (
  SELECT rid, t, greatest(coalesce(before + 1, 0), i - span + 1) AS pos, 1 AS d, 0 AS m FROM occ UNION ALL
  SELECT rid, t, i + 1, -1, 0 FROM occ UNION ALL
  SELECT rid, t, greatest(0, i + len(phrase) - span), 0, 1 FROM cand JOIN templates USING (t) JOIN ph USING (t) JOIN q USING (rid) WHERE word = phrase[1] AND ws[i + 1:i + len(phrase)] = phrase UNION ALL
  SELECT rid, t, i + 1, 0, -1 FROM cand JOIN ph USING (t) JOIN q USING (rid) WHERE word = phrase[1] AND ws[i + 1:i + len(phrase)] = phrase
), st AS (
  SELECT DISTINCT rid, t, i AS pos FROM cand JOIN q USING (rid) WHERE EXISTS (SELECT 1 FROM tw WHERE tw.t = cand.t AND tw.word = q.word) OR EXISTS (SELECT 1 FROM ph WHERE ph.t = cand.t AND ph.phrase[1] = q.word)
), sw AS (
  SELECT rid, t, pos, s, sum(d) OVER k AS shared, sum(m) OVER k AS marked FROM (
    SELECT rid, t, pos, d, m, false AS s FROM ev UNION ALL SELECT rid, t, pos, 0, 0, true FROM st)
  WINDOW k AS (PARTITION BY rid, t ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), hit AS (
  SELECT rid, t, label, pos AS first, least(pos + span, len(ws)) AS last, shared / n AS part FROM sw JOIN templates USING (t) JOIN w USING (rid)
  WHERE s AND shared >= least AND (marked > 0 OR len(phrases) = 0)
), isl AS (
  SELECT *, sum(fresh) OVER (PARTITION BY rid, t ORDER BY first) AS k FROM (
    SELECT *, CASE WHEN first <= lag(last) OVER (PARTITION BY rid, t ORDER BY first) THEN 0 ELSE 1 END AS fresh FROM hit)
), bl AS (
  SELECT rid, t, label, min(first) AS first, max(last) AS last, max(part) AS part FROM isl GROUP BY rid, t, label, k
), tm AS (
  SELECT rid, list(DISTINCT label) AS ls, max(part) AS part, array_to_string(list_sort(list(DISTINCT label || '@' || first || '-' || last)), ',') AS blocks FROM bl GROUP BY rid
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
       first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(base.ls), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(tm.ls, [])))), ','), '') AS labels,
       (CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(part, 0.0) END)::DOUBLE AS score, coalesce(blocks, '') AS blocks
FROM w LEFT JOIN base USING (rid) LEFT JOIN tm USING (rid)
"""


OP2_SQL = _op2_sql()
