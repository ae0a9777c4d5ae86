"""Decisions as a stream: documents wait in state until all their findings are decided.

Documents and decisions come as two streams, in any order and interleaved, and are grouped by source.
The state of a source holds its text, its findings without their values, and of each finding the
decision that counts, by the order of the batch form; a text is detected once, when it comes. Once nothing is open the source is emitted with the
map of its decisions, and what follows is the batch form's own projection of that row. A decision
that changes an emitted source emits it again; the last row of a source is the one that counts, and
equals what the batch form gives for all documents and decisions seen.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from scrubline.functions.folds import cut
from scrubline.operators.decide import DECISION, FIELDS, SLIM, review
from scrubline.operators.detect import detect
from scrubline.operators.rewrite import rewritten

#: What a group takes and gives is held in few columns: each costs a conversion for every group.
_OUT = "source_id string, text string, info string"
_STATE = "text string, found string, n_rows long, decided string, version long"
#: The findings of a text without their values, which stand in events and state as JSON; ``info`` of what is emitted.
_FOUND = "array<struct<finding_id:string,type:string,severity:string,start:int,end:int,masked_preview:string,detector:string>>"
_INFO = f"found {_FOUND}, n_rows long, version long, late boolean, decided map<string,array<string>>"


def events(docs: DataFrame, decisions: DataFrame, terms: tuple[str, ...] = ()) -> DataFrame:
    """(source_id, text, event): documents (source_id, text), with their findings, and decisions (text null); rows without a source are left out."""
    slim = F.transform(detect(F.coalesce("text", F.lit("")), terms), lambda f: F.struct(*[f[c].alias(c) for c in SLIM]))
    left = docs.select(F.col("source_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"), F.to_json(slim).alias("event"))
    said = F.to_json(F.array(*[F.col(c).cast("string") for c in ("finding_id", "seq", *FIELDS)]))
    right = decisions.where("finding_id is not null").select(F.col("source_id").cast("string"), F.lit(None).cast("string").alias("text"), said.alias("event"))
    return left.unionByName(right).where("source_id is not null")


def _counts_more(a: list, b: list) -> bool:
    """Whether decision a (seq, then the fields) counts more than b; nulls come first."""
    key = lambda d: [(x is not None, x if x is not None else 0 if i == 0 else "") for i, x in enumerate(d)]
    return key(a) > key(b)


def _step(wait_ms: int | None):
    """The function of one source: its new events, and what is emitted of them."""
    import pandas as pd

    def row(source, state, late):
        text, found, n_rows, decided, version = state
        info = f'{{"found": {found}, "n_rows": {n_rows}, "version": {version}, "late": {json.dumps(late)}, "decided": {decided}}}'
        return pd.DataFrame({"source_id": [source], "text": [text], "info": [info]})

    def run(key, batches, group):
        source = key[0]
        text, found, n_rows, decided, version = group.get if group.exists else (None, "[]", 0, "{}", 0)
        if group.hasTimedOut:
            # what is open now goes out as it is, and is forgotten
            group.remove()
            if n_rows and not version:
                yield row(source, (text, found, n_rows, decided, 1), True)
            return
        known, have = json.loads(decided), {f["finding_id"] for f in json.loads(found)}
        changed = False
        for rows in batches:
            for new, event in zip(rows["text"].tolist(), rows["event"].tolist()):
                if new is not None:
                    n_rows += 1
                    text, found, changed = new, event, True
                    have = {f["finding_id"] for f in json.loads(found)}
                else:
                    finding, seq, *decision = json.loads(event)
                    mine = [None if seq is None else int(seq), *decision]
                    if finding not in known or _counts_more(mine, known[finding]):
                        known[finding] = mine
                        changed = changed or finding in have
        # several rows of one source are in error, whatever is decided
        ready = n_rows > 1 or (n_rows == 1 and have <= known.keys())
        version += ready and changed
        state = (text, found, n_rows, json.dumps(known), version)
        group.update(state)
        if wait_ms is not None:
            group.setTimeoutDuration(wait_ms)
        if ready and changed:
            yield row(source, state, False)

    return run


def review_stream(docs: DataFrame, decisions: DataFrame, terms: tuple[str, ...] = (), wait_ms: int | None = None) -> DataFrame:
    """(source_id, version, late, status, ...) of ``rewritten``, for streams of documents and of decisions.

    A source is emitted when all its findings are decided, at once if it has none, and again, with a
    higher ``version``, when a later decision changes it; the last version counts. With ``wait_ms`` a source
    that stays open for so long (processing time, since its last event) is emitted as it stands, with
    ``late`` true, and forgotten; without it state is kept until its decisions come. A null text counts as
    empty. A source that comes twice has the status duplicate_source.
    """
    kept = GroupStateTimeout.NoTimeout if wait_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    out = events(docs, decisions, terms).groupBy("source_id").applyInPandasWithState(_step(wait_ms), _OUT, _STATE, "update", kept)
    out = out.select("source_id", "text", F.from_json("info", _INFO).alias("i")).select("source_id", "text", "i.*")
    field = lambda v: F.struct(*[F.get(v, F.lit(i + 1)).alias(c) for i, c in enumerate(FIELDS)]).cast(DECISION)
    rows = out.withColumns({"decisions": F.transform_values("decided", lambda _, v: field(v)), "repeated": F.col("n_rows") > 1})
    value = lambda x, c, part: part(x["start"], x["end"]) if c == "value" else x[c]
    rows = rows.withColumn("found", cut(F.col("text"), F.col("found"), lambda x, _, part: F.struct(*[value(x, c, part).alias(c) for c in [*SLIM, "value"]])))
    return rewritten(review(rows, terms), ["source_id", "version", "late"])
