"""Documents and decisions as streams, against the batch form."""

import time

from pyspark.sql import functions as F

from scrubline.operators import rewrite as W
from scrubline.operators.detect import findings
from scrubline.streaming.decisions import review_stream

DOCS = "source_id string, text string"
DECISION = "source_id string, seq int, finding_id string, action string, token_label string, replacement string, reason string"


def ids(spark, text):
    rows = findings(spark.createDataFrame([("x", text)], DOCS), "source_id").collect()
    return [r["finding_id"] for r in rows]


class Feed:
    """Two folders that a stream reads, one file of each at a time."""

    def __init__(self, spark, folder, **more):
        self.spark, self.folder, self.more, self.n, self.seen = spark, folder, more, 0, []
        self.docs, self.decisions = [], []
        for name, schema in (("docs", DOCS), ("decisions", DECISION)):
            spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}")

    def put(self, docs=(), decisions=()):
        self.docs += docs
        self.decisions += decisions
        for name, rows, schema in (("docs", docs, DOCS), ("decisions", decisions, DECISION)):
            if rows:
                self.spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")
        self.n += 1
        streams = [self.spark.readStream.schema(x).parquet(f"{self.folder}/{n}") for n, x in (("docs", DOCS), ("decisions", DECISION))]
        out = review_stream(*streams, **self.more)

        def keep(rows, _):
            self.seen += [r.asDict() for r in rows.collect()]

        before = len(self.seen)
        q = out.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return self.seen[before:]

    def last(self):
        out = {}
        for r in self.seen:
            if r["source_id"] not in out or r["version"] > out[r["source_id"]]["version"]:
                out[r["source_id"]] = r
        return {s: (r["status"], r["sanitized_text"], r["n_public"], r["residual_risk"]) for s, r in out.items()}

    def batch(self):
        docs, decisions = self.spark.createDataFrame(self.docs, DOCS), self.spark.createDataFrame(self.decisions, DECISION)
        rows = W.sanitize(docs, decisions).collect()
        return {r["source_id"]: (r["status"], r["sanitized_text"], r["n_public"], r["residual_risk"]) for r in rows if r["status"] != "unresolved"}


def test_stream_equals_batch(spark, tmp_path):
    feed = Feed(spark, str(tmp_path))
    two = "mail a.b@example.net and host 10.1.2.3"
    one, other = ids(spark, two)
    (mail,) = ids(spark, "mail a.b@example.net")
    decide = lambda s, seq, f, action, reason=None: (s, seq, f, action, None, None, reason)
    # decisions before the document, a clean document, and one that waits
    assert {r["source_id"] for r in feed.put([("clean", "nothing here"), ("wait", two)], [decide("early", 1, mail, "tokenize")])} == {"clean"}
    assert {r["source_id"]: r["sanitized_text"] for r in feed.put([("early", "mail a.b@example.net")])} == {"early": "mail 【EMAIL-01】"}
    # one of two findings is not enough
    assert feed.put((), [decide("wait", 1, one, "delete")]) == []
    assert [r["status"] for r in feed.put((), [decide("wait", 1, other, "keep")])] == ["error"]
    assert feed.last() == feed.batch()
    # a later decision counts, an earlier one does not, and one that changes nothing emits nothing
    assert [(r["version"], r["status"]) for r in feed.put((), [decide("wait", 3, other, "keep", "internal")])] == [(2, "ok")]
    assert feed.put((), [decide("wait", 2, other, "delete"), decide("wait", 3, other, "keep", "internal")]) == []
    assert feed.last() == feed.batch()
    # a source that comes again is in error
    assert [r["status"] for r in feed.put([("clean", "other text")])] == ["duplicate_source"]
    feed.put([(None, "no id"), ("null", None)], [(None, 1, "f", "delete", None, None, None)])
    assert feed.last()["null"][:2] == ("ok", "") and None not in feed.last()


def test_what_stays_open_goes_out_late(spark, tmp_path):
    for name, rows, schema in (("docs", [("open", "mail a.b@example.net"), ("other", "clean")], DOCS), ("decisions", [], DECISION)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
    streams = [spark.readStream.schema(x).parquet(f"{tmp_path}/{n}") for n, x in (("docs", DOCS), ("decisions", DECISION))]
    seen = []
    # with a waiting time a query does not end by itself
    q = review_stream(*streams, wait_ms=1).writeStream.outputMode("update").foreachBatch(lambda rows, _: seen.extend(rows.collect())).option("checkpointLocation", f"{tmp_path}/state").start()
    until = time.time() + 60
    while time.time() < until and not any(r["late"] for r in seen):
        time.sleep(0.5)
    q.stop()
    assert [(r["source_id"], r["status"], r["sanitized_text"]) for r in seen if r["late"]] == [("open", "unresolved", "mail a.b@example.net")]


def test_order_of_decisions_is_the_batch_forms(spark):
    from scrubline.operators.decide import last_decisions
    from scrubline.streaming.decisions import _counts_more

    rows = [(seq, a, t, None, r) for seq in (None, 1, 2) for a in ("delete", "keep", None) for t in (None, "x", "") for r in (None, "y")]
    best = rows[0]
    for r in rows:
        best = r if _counts_more(list(r), list(best)) else best
    got = last_decisions(spark.createDataFrame([("s", r[0], "f", *r[1:]) for r in rows], DECISION)).first()
    assert (got["action"], got["token_label"], got["replacement"], got["reason"]) == best[1:]
