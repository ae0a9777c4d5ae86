"""Decisions meet texts sparsely; values stay out of what is written between steps; project tokens are stable."""

import os
import random

import pytest
from pyspark.sql import functions as F

from scrubline.operators import decide as D
from scrubline.operators import rewrite as W
from scrubline.operators.detect import findings
from scrubline.operators.registry import Registry
from scrubline.sources.scratch import scratch_folder, settle

DECISION = "source_id string, seq int, finding_id string, action string, token_label string, replacement string, reason string"
KEY = b"k" * 32


def table(spark, n=400):
    rng = random.Random(2)
    pick = lambda i: rng.choice(["plain words only", f"mail u{i % 40}@example.net", f"host 10.0.0.{i % 250} and u{i}@example.net", None, "looks like @ or sk- or 09 but is none"])
    ids = [None if i % 50 == 7 else f"s{i // 2 * 2 if i % 40 == 3 else i}" for i in range(n)]
    return spark.createDataFrame([(s, pick(i), i) for i, s in enumerate(ids)], "source_id string, text string, k int").repartition(4)


def decided(d, action="tokenize"):
    rows = findings(d.where("source_id is not null and crc32(source_id) % 5 <> 0"), "source_id")
    none = F.lit(None).cast("string")
    return rows.select("source_id", F.lit(1).alias("seq"), "finding_id", F.lit(action).alias("action"), none.alias("token_label"), none.alias("replacement"), F.lit("ok").alias("reason"))


def judged(d, decisions):
    return settle(D.verdicts(settle(D.hits(d)), d, decisions))


def outcome(rows):
    out = W.rewritten(rows, ["source_id", "carry"])
    # a null text has no findings in either form
    out = out.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in ("public", "tokens")})
    return sorted(map(repr, out.select("source_id", "carry.k", "status", "first_error", "sanitized_text", "residual_risk", "n_unresolved", "n_public", "public", "tokens").collect()))


@pytest.mark.parametrize("action", ["tokenize", "keep"])
def test_both_ways_agree_with_the_row_by_row_form(spark, action):
    d = table(spark)
    decisions = decided(d, action)
    found = judged(d, decisions)
    one, two = (outcome(D.with_verdicts(d, found, (), ["k"], limit)) for limit in (D.BROADCAST_BYTES, 0))
    assert one == two
    plain = outcome(D.review(D.with_decisions(d, decisions, ["k"])))
    # only what a repeated id says of its findings is not kept
    assert [r for r in one if "duplicate" not in r] == [r for r in plain if "duplicate" not in r]
    assert sum("duplicate" in r for r in one) == sum("duplicate" in r for r in plain) > 0


def nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


def test_rows_without_findings_are_not_shuffled(spark):
    d = table(spark)
    found = judged(d, decided(d))
    plan = D.with_verdicts(d, found, limit=0)._jdf.queryExecution().sparkPlan()
    union = next(x for x in nodes(plan) if x.nodeName() == "Union")
    joined, clean = ([x.nodeName() for x in nodes(union.children().apply(i))] for i in (0, 1))
    assert any("SortMergeJoin" in x or "ShuffledHashJoin" in x for x in joined) or joined.count("BroadcastHashJoin") == 2
    # the cells of repeated ids, which are of bounded number, are all that it meets
    assert clean.count("BroadcastHashJoin") == 1 and not any("SortMerge" in x or "ShuffledHash" in x for x in clean)
    small = D.with_verdicts(d, found)._jdf.queryExecution().sparkPlan()
    assert [x.nodeName() for x in nodes(small) if "Join" in x.nodeName()] == ["BroadcastHashJoin"]


def test_queries_join_a_table_of_decisions(spark):
    from scrubline.plans import catalog_queries

    for name in ("rewrite_mixed", "export_status", "public_findings", "vault_roundtrip"):
        plan = catalog_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join LeftOuter" in plan, name


def test_a_text_that_changed_is_not_rewritten(spark):
    d = spark.createDataFrame([("a", "mail a.b@example.net"), ("b", "mail c.d@example.net")], "source_id string, text string")
    found = judged(d, decided(d, "delete").unionByName(decided(d, "delete")))
    later = d.withColumn("text", F.when(F.col("source_id") == "a", "longer mail a.b@example.net").otherwise(F.col("text")))
    got = {r["source_id"]: r for r in W.rewritten(D.with_verdicts(later, found), ["source_id"]).collect()}
    assert (got["a"]["status"], got["a"]["sanitized_text"], got["a"]["n_public"]) == ("text_changed", "longer mail a.b@example.net", 0)


def test_may_hold_is_true_of_all_hits(spark):
    from scrubline.operators.detect import detect, may_hold

    d = table(spark)
    many = tuple(f"word{i}" for i in range(70)) + ("plain",)
    for terms in ((), ("words",), many):
        rows = d.select(F.size(detect(F.col("text"), terms)).alias("n"), may_hold(F.col("text"), terms).alias("may"))
        assert rows.where("n > 0 and not may").count() == 0 and rows.where("n > 0").count() > 0 and rows.where("may is null").count() == 0


@pytest.mark.parametrize("scope", ["source", "project"])
def test_no_value_in_the_checkpoint_folder(spark, scope):
    d = spark.createDataFrame([(str(i), f"mail zq{i % 3}xkv9w7@example.net end") for i in range(30)], "source_id string, text string")
    rows = W.sanitize(d, decided(d), token_scope=scope).collect()
    assert any("EMAIL" in r["sanitized_text"] for r in rows)
    folder = scratch_folder(spark).removeprefix("file:")
    seen = 0
    for at, _, names in os.walk(folder):
        for n in names:
            seen += 1
            data = open(os.path.join(at, n), "rb").read()
            assert b"xkv9w7" not in data and "xkv9w7".encode("utf-16-le") not in data
    assert seen


def entries(out):
    return {(r["token"], r["original"]) for r in W.token_entries(out).collect()}


def test_a_registry_keeps_numbers(spark, tmp_path):
    registry = Registry(spark, str(tmp_path / "r"), KEY)
    texts = lambda lo, hi: spark.createDataFrame([(str(i), f"mail u{i}@example.net or 09120000{i:02d}") for i in range(lo, hi)], "source_id string, text string")

    def run(d):
        all_ = findings(d, "source_id").select("source_id", F.lit(1).alias("seq"), "finding_id", F.lit("tokenize").alias("action"), *[F.lit(None).cast("string").alias(c) for c in ("token_label", "replacement", "reason")])
        return entries(W.sanitize(d, all_, token_scope="project", registry=registry))

    first = run(texts(10, 40))
    assert run(texts(10, 40)) == first and len(registry.versions()) == 1
    second = run(texts(30, 70))
    assert {t for t in second if int(t[1][1:3] if t[1][0] == "u" else t[1][-2:]) < 40} <= first
    assert len(registry.versions()) == 2
    # a run that ended before its line was written has left a folder
    (tmp_path / "r" / "values-orphan").mkdir()
    again = Registry(spark, str(tmp_path / "r"), KEY)
    whole = {(r["token"], r["original"]) for r in again.entries().collect()}
    assert first | second == whole
    for label in ("EMAIL", "PHONE"):
        assert sorted(int(t[len(label) + 2 : -1]) for t, _ in whole if label in t) == list(range(1, 61))


def test_two_writers_of_one_version(spark, tmp_path):
    a = Registry(spark, str(tmp_path / "r"), KEY)
    assert a.versions() == []

    def values(*words):
        rows = a.secret.protect(spark.createDataFrame([(w,) for w in words], "v string"), F.array("v"), "p")
        return rows.select(F.lit("L").alias("label"), F.col("p")[0]["blind"].alias("blind"), F.col("p")[0]["bucket"].alias("bucket"), F.col("p")[0]["sealed"].alias("sealed"))

    a.enter(values("x", "y"))
    # another writer's version 2, of which a learns only when both lines stand
    settled = settle(values("z"))
    settled.withColumn("ordinal", F.lit(3).cast("long")).write.parquet(str(tmp_path / "r" / "values-0"))
    spark.createDataFrame([(2, "values-0")], "version long, folder string").write.mode("append").parquet(str(tmp_path / "r" / "log"))
    late = settle(values("w"))
    late.withColumn("ordinal", F.lit(3).cast("long")).write.parquet(str(tmp_path / "r" / "values-late"))
    spark.createDataFrame([(2, "values-late")], "version long, folder string").write.mode("append").parquet(str(tmp_path / "r" / "log"))
    numbers = {r["ordinal"] for r in a.enter(values("w")).collect()}
    assert numbers == {1, 2, 3, 4} and [f for _, f in a.versions()][1] == "values-0"


def test_a_short_secret_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        Registry(spark, str(tmp_path), b"short")


def test_decisions_made_from_the_hits_need_no_detection_of_their_own(spark):
    """Both ways of giving decisions rewrite the same."""
    none = F.lit(None).cast("string")
    made = lambda rows: rows.where("type = 'email'").select("source_id", F.lit(1).alias("seq"), "finding_id", F.lit("tokenize").alias("action"), none.alias("token_label"), none.alias("replacement"), none.alias("reason"))
    d = table(spark, 60)
    one, two = (sorted(map(repr, W.sanitize(d, x).select("source_id", "status", "sanitized_text", "n_unresolved").collect())) for x in (made, made(findings(d, "source_id"))))
    assert one == two and any("EMAIL-" in r for r in one)


def test_values_are_entered_without_rewriting(spark, tmp_path):
    """The same values under the same numbers as by rewriting, unresolved and repeated rows included; fewer files are written on the way."""
    none = F.lit(None).cast("string")
    made = lambda rows: rows.where("type = 'email' or source_id % 3 = 0").select("source_id", F.lit(1).alias("seq"), "finding_id", F.lit("tokenize").alias("action"), none.alias("token_label"), none.alias("replacement"), none.alias("reason"))
    rows = [(i, f"mail u{i % 20}@example.net or 09120000{i:02d} or u{i}@example.org") for i in range(40)] + [(7, "twice u99@example.net"), (None, "none u98@example.net")]
    d = spark.createDataFrame(rows, "source_id int, text string")
    one, two = (Registry(spark, str(tmp_path / n), KEY) for n in "ab")
    W.enter(d, made, one)
    whole = W.token_entries(W.sanitize(d, made, token_scope="project", registry=two)).collect()
    first, second = ({(r["token"], r["original"]) for r in x.entries().collect()} for x in (one, two))
    assert first == second and {(r["token"], r["original"]) for r in whole} <= first
    originals = {v for _, v in first}
    assert {"u1@example.org", "u39@example.org", "0912000003"} <= originals and not {"u99@example.net", "u98@example.net", "u7@example.org", "0912000001"} & originals
    # entered again, by either way, nothing changes
    W.enter(d, made, two)
    assert len(two.versions()) == len(one.versions()) == 1


def test_a_value_is_sealed_once_in_a_row(spark):
    from scrubline.sources.vault import Secret

    secret = Secret(KEY)
    rows = [(1, ["a", "漢😀", "a", "", "a"]), (2, ["a", "b"]), (3, []), (4, None)]
    out = secret.protect(spark.createDataFrame(rows, "i int, v array<string>"), F.col("v"), "p").withColumn("key", secret.key("i"))
    out = settle(out.withColumn("open", F.transform("p", lambda x: Secret.unseal(x["sealed"], F.col("key"))))).orderBy("i").collect()
    assert [(r["i"], r["open"]) for r in out] == rows
    blinds = {(v, x["blind"], x["bucket"]) for r in out for v, x in zip(r["open"] or [], r["p"] or [])}
    assert len(blinds) == 4 and len({b for _, b, _ in blinds}) == 4
    # each time it was sealed it was drawn at random
    assert len({bytes(x["sealed"]) for x in out[0]["p"]}) == 3 and out[0]["p"][0]["sealed"] != out[1]["p"][0]["sealed"]
