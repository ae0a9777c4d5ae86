"""Detection: text to an array of disjoint, sorted findings, in one narrow projection.

Each detector scans the whole text by itself, once, behind a cheap test that spares clean rows the scan: all of them together in
Arrow batches (``candidates``), or one of them, any, as an expression (``matches``: its matches are marked, the text is cut at the marks, and
running totals give the positions). Overlaps are then resolved by one sorted chain of jumps. Offsets are 0-based code points, half-open; ids hash the UTF-16 offset,
which is added up beside them. The work of a row grows with n log n of its findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubline.functions import scalars as S
from scrubline.functions.folds import below, chain, let, scan

from .catalog import DETECTORS, DICTIONARY, DICTIONARY_KIND, SEVERITY, Detector, escape, with_dictionary

#: Up to so many terms each get an expression of their own; more are looked for together.
MANY_TERMS = 64

_CANDIDATE = "array<struct<start:int,neg_severity:int,neg_end:int,ord:int,type:string,severity:string,detector:string,value:string,start16:int>>"
#: Kinds, severities and names of the detectors, then of the dictionary's terms.
_KINDS, _SEVERITIES, _NAMES = ([getattr(d, f) for d in with_dictionary(("ab",))] for f in ("kind", "severity", "name"))
FINDING = "array<struct<finding_id:string,type:string,severity:string,start:int,end:int,value:string,masked_preview:string,detector:string>>"


def _size(value: Column) -> Column:
    """The lengths of a text in code points (upper half) and in UTF-16 units (lower half) as one long, so that both add up at once."""
    return let(F.length(value), lambda n: F.shiftleft(n.cast("long"), 32) + F.when(F.octet_length(value) == n, n).otherwise(S.utf16_length(value)))


def _found(end: Column, value: Column, size: Column, kind: str, severity: str, detector: str, ord: Column) -> Column:
    """A candidate that ends where ``end`` (a sum of sizes) says."""
    start = end - size
    return F.struct(
        F.shiftright(start, 32).cast("int").alias("start"),
        F.lit(-SEVERITY[severity]).alias("neg_severity"),
        (-F.shiftright(end, 32).cast("int")).alias("neg_end"),
        ord.alias("ord"),
        F.lit(kind).alias("type"),
        F.lit(severity).alias("severity"),
        F.lit(detector).alias("detector"),
        value.alias("value"),
        start.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("start16"),
    )


#: What matches are marked with: characters that Unicode keeps for internal use.
_MARK, _OTHER = "\ufdd0", "\ufdd1"


def _marked(text: Column, d: Detector) -> Column:
    """A text as gap, match, gap, ..., gap, by one scan. Where matches may be empty, those that are stay gaps.

    A text that holds a mark itself gets longer ones, each with a longer run of ``_OTHER`` than the text has.
    """

    def pieces(run: Column) -> Column:
        long = lambda n: F.concat(F.lit(_MARK), F.repeat(F.lit(_OTHER), n), F.lit(_MARK))
        first = F.when(run == 0, _MARK).otherwise(long(run))
        if not d.may_be_empty:
            return F.split(F.regexp_replace(text, F.lit(d.pattern), F.concat(first, F.lit("$0"), first)), first, -1)
        last = F.when(run == 0, _OTHER).otherwise(long(run + 1))
        marked = F.replace(F.regexp_replace(text, F.lit(d.pattern), F.concat(first, F.lit("$0"), last)), F.concat(first, last), F.lit(""))
        return F.split(marked, F.when(run == 0, f"[{_MARK}{_OTHER}]").otherwise(F.concat(first, F.lit("|"), last)), -1)

    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"{_OTHER}+"), F.lit(0)), F.length))
    own = F.contains(text, F.lit(_MARK))
    own = own | F.contains(text, F.lit(_OTHER)) if d.may_be_empty else own
    return let(F.when(own, F.coalesce(longest, F.lit(0)) + 1).otherwise(0), pieces)


def matches(text: Column, d: Detector, ord: int) -> Column:
    """All matches of one detector, left to right, not overlapping; empty ones count for nothing."""
    empty = F.array().cast(_CANDIDATE)

    def places(pieces: Column) -> Column:
        ends = scan(F.transform(pieces, _size), lambda a, b: a + b)
        ended = F.zip_with(pieces, ends, lambda x, end: F.struct(x.alias("hit"), end.alias("end")))
        hits = F.filter(ended, lambda x, i: (i % 2 == 1) & (x["hit"] != ""))
        return F.transform(hits, lambda x: _found(x["end"], x["hit"], _size(x["hit"]), d.kind, d.severity, d.name, F.lit(ord))).cast(_CANDIDATE)

    return F.when(d.may_match(text), let(_marked(text, d), places)).otherwise(empty)


def keyword_automaton(terms: list[str] | tuple[str, ...]):
    """A function from text to the places, in ``terms``, of those it holds: one pass, whose work is that of the text, not of text and terms.

    Each Python worker builds the automaton once.
    """
    terms, built = list(terms), []

    def held(text: str) -> list[int]:
        import ahocorasick

        if not built:
            places: dict[str, list[int]] = {}
            for i, term in enumerate(terms):
                places.setdefault(term, []).append(i)
            automaton = ahocorasick.Automaton()
            for term, rows in places.items():
                automaton.add_word(term, rows)
            automaton.make_automaton()
            built.append(automaton)
        return sorted({i for _, rows in built[0].iter(text) for i in rows}) if text else []

    return held


def holds_term(terms: list[str] | tuple[str, ...]):
    """A function from text to whether it holds any of many terms."""
    from pyspark.sql.functions import pandas_udf

    held = keyword_automaton(terms)

    def holds(texts):
        import pandas as pd

        return pd.Series([bool(held(t or "")) for t in texts], dtype=bool)

    return pandas_udf(holds, "boolean")


#: A character that UTF-16 writes as two units, and the first of its bytes in UTF-8.
_ASTRAL, _ASTRAL_BYTE = "[\U00010000-\U0010ffff]", r"[\xF0-\xF4]"
_SCANNED = "array<struct<start:int,neg_severity:int,neg_end:int,ord:int,value:string,start16:int>>"


def anchored(mark: str, before: str, head: str, tail: str):
    """A function from text to the matches (start, end) of head and tail, left to right, that looks at the text's marks alone.

    A match is the last of a run of characters ``before``, up to a mark, and what follows from the mark on; the run is gone
    through once, and only where the rest is there, so the work of a text grows with its length.
    """
    import re

    rest, first, held = re.compile(tail, re.ASCII), re.compile(rf"(?:{head})\Z", re.ASCII), frozenset(before)

    def found(text: str):
        done, at = 0, text.find(mark)
        while at >= 0:
            if end := rest.match(text, at):
                low = at
                while low > done and text[low - 1] in held:
                    low -= 1
                if start := first.search(text, low, at):
                    done = end.end()
                    yield start.start(), done
            at = text.find(mark, max(at + 1, done))

    return found


def _scanner(detectors: list[Detector], terms: list[str]):
    """A function from texts and patterns (one for each detector, a line each) to all matches of detectors and terms, each scanned by itself.

    The texts come in Arrow batches; what one holds is looked for with Python's ``re``, which takes the patterns as they are, and terms
    as plain strings. Where only a probe tells, Arrow asks it of the whole batch; matches about a character are looked for at that
    character (``anchored``). Bytes that are no UTF-8 count as U+FFFD.
    """
    from pyspark.sql.functions import arrow_udf

    guards = [(d.literal, d.signs, d.probe, d.around and (*d.around, d.head, d.tail)) for d in detectors]
    severities = [SEVERITY[d.severity] for d in detectors] + [SEVERITY["high"]] * len(terms)
    own = list(enumerate(terms, len(detectors)))
    held = keyword_automaton(terms) if len(terms) > MANY_TERMS else None
    ready: list = []

    def prepared(patterns: str) -> list:
        import re

        def scan(pattern, around):
            if around:
                return anchored(*around)
            every = re.compile(pattern, re.ASCII).finditer
            return lambda text: (m.span() for m in every(text))

        if not ready:
            for i, ((literal, signs, probe, around), p) in enumerate(zip(guards, patterns.split("\n"))):
                alone = probe if not (literal or signs) else None
                ready.append((i, literal, signs, probe and not alone and re.compile(probe, re.ASCII), alone, scan(p, around)))
            ready.append(re.compile(_ASTRAL))
        return ready

    def scanned(texts, patterns):
        from bisect import bisect_left

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        starts, ends, ords, values, starts16, offsets = [], [], [], [], [], [0]
        *rules, astral = prepared(patterns[0].as_py()) if len(texts) else [None]
        texts = texts.cast(pa.binary())
        # as bytes, which are what the pattern says: a probe holds ASCII alone
        asked = lambda p: pc.match_substring_regex(texts, p).to_pylist()
        told = [(*rule[:4], rule[4] and asked(rule[4]), rule[5]) for rule in rules]
        two = asked(_ASTRAL_BYTE)
        for n, data in enumerate(texts):
            text = (data.as_py() or b"").decode("utf-8", "replace")
            before = len(starts)
            for i, literal, signs, probe, alone, spans in told:
                if (alone and not alone[n]) or (literal and literal not in text) or (signs and not any(s in text for s in signs)) or (probe and not probe.search(text)):
                    continue
                for start, end in spans(text):
                    starts.append(start)
                    ends.append(end)
                    ords.append(i)
                    values.append(text[start:end])
            for i, term in own if held is None else ((i + len(rules), terms[i]) for i in held(text)):
                at = text.find(term)
                while at >= 0:
                    starts.append(at)
                    ends.append(at + len(term))
                    ords.append(i)
                    values.append(term)
                    at = text.find(term, at + len(term))
            wide = [m.start() for m in astral.finditer(text)] if len(starts) > before and two[n] else []
            starts16.extend(at + bisect_left(wide, at) for at in starts[before:])
            offsets.append(len(starts))
        ord_ = np.array(ords, "int32")
        columns = [np.array(starts, "int32"), -np.array(severities, "int32")[ord_], -np.array(ends, "int32"), ord_, pa.array(values, pa.string()), np.array(starts16, "int32")]
        names = ["start", "neg_severity", "neg_end", "ord", "value", "start16"]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in columns], names))

    return arrow_udf(scanned, _SCANNED)


def candidates(text: Column, terms: list[str] | tuple[str, ...] = ()) -> Column:
    """All matches of all detectors and terms. The patterns are an argument of the scan, so they stand in the plan."""
    own = [d.literal for d in with_dictionary(terms)[len(DETECTORS) :]]
    return _scanner(list(DETECTORS), own)(text, F.lit("\n".join(d.pattern for d in DETECTORS)))


def may_hold(text: Column, terms: list[str] | tuple[str, ...] = ()) -> Column:
    """Whether any detector may find something: true for every text with a finding, and cheap; false for null."""
    detectors = with_dictionary(terms)
    own = detectors[len(DETECTORS) :]
    # what only looks for a literal is asked first, and of these the short ones: most texts with a finding need no pattern then
    cheap = sorted(detectors if len(own) <= MANY_TERMS else DETECTORS, key=lambda d: (bool(d.probe or not d.literal), len(d.literal or "")))
    asked = [d.may_match(text) for d in cheap]
    if len(own) > MANY_TERMS:
        asked.append(holds_term([d.literal for d in own])(text))
    held = asked[0]
    for a in asked[1:]:
        held = held | a
    return F.coalesce(held, F.lit(False))


def resolve(found: Column) -> Column:
    """Earliest start first, then severity, then length, then detector; what overlaps an accepted one goes."""

    def accepted(c: Column) -> Column:
        # from each candidate to the first that starts where it ends or later: what a greedy choice takes is a chain of these jumps
        jumps = let(F.transform(c, lambda x: x["start"]), lambda starts: F.transform(c, lambda x: below(starts, -x["neg_end"])))
        chosen = F.transform(chain(jumps), lambda i: F.get(c, i))
        overlaps = F.exists(F.transform(c, lambda x, i: (i > 0) & (x["start"] < -F.get(c, i - 1)["neg_end"])), lambda x: x)
        return F.when(overlaps, chosen).otherwise(c)

    # no element is null, and this one compares without a lambda
    return let(F.sort_array(found), accepted)


def detect(text: Column, terms: list[str] | tuple[str, ...] = ()) -> Column:
    """The findings of a text; null for null."""
    # all terms are of one kind, the last
    of = lambda names, x: F.get(F.array(*[F.lit(n) for n in names]), F.least(x["ord"], F.lit(len(DETECTORS))))
    found = F.transform(
        resolve(candidates(text, terms)),
        lambda x: F.struct(
            S.finding_id(of(_KINDS, x), x["start16"], x["value"]).alias("finding_id"),
            of(_KINDS, x).alias("type"),
            of(_SEVERITIES, x).alias("severity"),
            x["start"].alias("start"),
            (-x["neg_end"]).alias("end"),
            x["value"].alias("value"),
            S.mask(x["value"]).alias("masked_preview"),
            of(_NAMES, x).alias("detector"),
        ),
    )
    return F.when(text.isNull(), F.lit(None).cast(FINDING)).otherwise(found)


def findings(docs: DataFrame, id_col: str, text_col: str = "text", terms: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(source_id, finding_id, type, severity, start, end, value, masked_preview, detector), one row per finding."""
    rows = docs.select(F.col(id_col).alias("source_id"), F.explode(detect(F.col(text_col), terms)).alias("f"))
    return rows.select("source_id", "f.*")


def blocking(text: Column, terms: list[str] | tuple[str, ...] = ()) -> Column:
    """How many critical or high findings a second scan has; it looks for no terms unless they are given.

    It goes by the expressions of single detectors, since its text is made in the same projection; many terms are scanned in batches.
    """
    detectors = with_dictionary(terms)
    few = len(detectors) - len(DETECTORS) <= MANY_TERMS
    found = F.concat(*[matches(text, d, i) for i, d in enumerate(detectors)]) if few else candidates(text, terms)
    return F.size(F.filter(resolve(found), lambda x: x["neg_severity"] <= -SEVERITY["high"]))
