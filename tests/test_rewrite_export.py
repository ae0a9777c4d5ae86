"""Decisions, rewriting, gates, vault, archive and streams."""

import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from scrubline.functions import scalars as S
from scrubline.operators import decide as D
from scrubline.operators import export as X
from scrubline.operators import gate as G
from scrubline.operators import rewrite as W
from scrubline.operators.detect import findings
from scrubline.sources import archive, lint, readers, vault
from scrubline.streaming.sanitize import findings_stream, sanitize_stream

DECISION = "source_id string, seq int, finding_id string, action string, token_label string, replacement string, reason string"


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source_id string, text string")


def decisions(spark, d, choose, terms=()):
    rows = findings(d, "source_id", terms=terms).collect()
    return spark.createDataFrame([(r["source_id"], k, r["finding_id"], *x) for r in rows for k, x in enumerate(choose(r))], DECISION)


def sanitized(spark, d, choose, terms=(), scope="source"):
    return W.sanitize(d, decisions(spark, d, choose, terms), terms, scope)


def result(spark, d, choose, terms=()):
    return {r["source_id"]: r for r in sanitized(spark, d, choose, terms).collect()}


def test_tokenize_and_last_decision_wins(spark):
    d = docs(spark, "Ask kim.l@example.net about Harbour Looms first.", "none", None)
    out = result(spark, d, lambda r: [("delete", None, None, None), ("tokenize", "", None, None)], ("Harbour Looms",))
    assert out["0"]["sanitized_text"] == "Ask 【EMAIL-01】 about 【EXACT-DATA-01】 first."
    assert (out["0"]["status"], out["0"]["n_tokens"], out["1"]["sanitized_text"], out["2"]["status"]) == ("ok", 2, "none", "no_text")


def test_errors_outrank_unresolved_and_keep_their_order(spark):
    d = docs(spark, "a@b.co password = synthetic-password-123 10.0.0.1", "a@b.co 10.0.0.1")
    choose = lambda r: {"credential": [("tokenize", None, None, None)], "ip-address": [("keep", None, None, "　")]}.get(r["type"], [])
    out = result(spark, d, choose)
    assert (out["0"]["status"], out["0"]["first_error"]) == ("error", "must_delete")
    assert (out["1"]["status"], out["1"]["first_error"]) == ("error", "keep_needs_reason")
    assert out["0"]["sanitized_text"].startswith("a@b.co")
    with pytest.raises(D.SanitizeError):
        D.require_valid(D.review(D.with_decisions(d, decisions(spark, d, choose))))


def test_all_or_nothing(spark):
    d = docs(spark, "a@b.co 10.0.0.1")
    out = result(spark, d, lambda r: [("delete", None, None, None)] if r["type"] == "email" else [])["0"]
    assert (out["status"], out["sanitized_text"], out["n_unresolved"], out["n_public"], out["residual_risk"]) == ("unresolved", "a@b.co 10.0.0.1", 1, 0, 0)


def test_generalize_keep_and_project_tokens(spark):
    d = docs(spark, "a@b.co a@b.co 0912345678 1.2.3.4", "a@b.co")
    choose = lambda r: [{"email": ("tokenize", "mail!", None, None), "phone": ("generalize", None, "﻿ a phone ", None)}.get(r["type"], ("keep", None, None, "ok"))]
    assert result(spark, d, choose)["0"]["sanitized_text"] == "【MAIL-01】 【MAIL-02】 a phone 1.2.3.4"
    out = {r["source_id"]: r for r in sanitized(spark, d, choose, scope="project").collect()}
    assert (out["0"]["sanitized_text"], out["1"]["sanitized_text"], out["0"]["residual_risk"]) == ("【MAIL-01】 【MAIL-01】 a phone 1.2.3.4", "【MAIL-01】", 1)
    public = W.public_findings(sanitized(spark, d, choose))
    assert not {"value", "start", "end"} & set(public.columns)


def test_project_ordinals_are_gapless_and_independent_of_partitions(spark):
    values = spark.range(3000).selectExpr("IF(id % 3 = 0, 'A', 'B') AS label", "concat('v', id) AS value")
    one, two = ({(r["label"], r["value"]): r["ordinal"] for r in W.project_ordinals(v).collect()} for v in (values.coalesce(1), values.repartition(7)))
    assert one == two
    for label, n in (("A", 1000), ("B", 2000)):
        assert sorted(k for (x, _), k in one.items() if x == label) == list(range(1, n + 1))


def test_rehydrate_and_second_scan_with_dictionary(spark):
    row = spark.createDataFrame([("【A-01】 to 【A-10】", [("【A-01】", "x"), ("【A-10】", "y")])], "t string, e array<struct<token:string,original:string>>")
    assert row.select(W.rehydrate(F.col("t"), F.col("e"))).first()[0] == "x to y"
    d = docs(spark, "Harbour Looms")
    gates = d.select(*[G.export_status(F.lit("P0"), F.lit("cloud-approved"), F.col("text"), terms=t) for t in ((), ("Looms",))]).first()
    assert tuple(gates) == ("ok", "blocked_scan")


def test_scalars(spark):
    row = spark.range(1).select(
        S.mask(F.lit("abcdefgh")).alias("a"),
        S.mask(F.lit("abcd")).alias("b"),
        S.token(F.lit("X"), F.lit(100)).alias("c"),
        S.normalize_label(F.lit("--ä b!")).alias("d"),
        S.normalize_label(F.lit("?")).alias("e"),
        *[S.safe_entry_name(F.lit(n)).alias(f"n{i}") for i, n in enumerate(["", "/a", "a\\b", "a/../b", "SAFE_SOURCE/source.md"])],
    ).first()
    assert tuple(row) == ("ab••••gh", "••••", "【X-100】", "B", "SENSITIVE", False, False, False, False, True)


def test_gates(spark):
    rows = [("P1", "cloud-approved", "clean"), ("P3", "cloud-approved", "clean"), ("P1", "local-only", "x"), ("P1", "cloud-sanitized", "a@b.co"), ("P9", "cloud-approved", ""), ("P0", "cloud-approved", "1.2.3.4"), (None, None, "")]
    got = spark.createDataFrame(rows, "c string, r string, t string").select(G.export_status(F.col("c"), F.col("r"), F.col("t"))).collect()
    assert [g[0] for g in got] == ["ok", "blocked_route", "blocked_route", "blocked_scan", "invalid", "ok", "invalid"]


def test_vault(spark):
    entries = spark.createDataFrame([("s", "【EMAIL-01】", "a@b.co", "email"), ("t", "【X-01】", "é😀", "exact-data")], "source_id string, token string, original string, finding_type string")
    sealed = vault.encrypt_maps(entries, "long enough passphrase").cache()
    good = {r["source_id"]: r for r in vault.decrypt_maps(sealed, "long enough passphrase").collect()}
    assert good["t"]["status"] == "ok" and good["t"]["entries"][0]["original"] == "é😀"
    assert {r["status"] for r in vault.decrypt_maps(sealed, "another passphrase").collect()} == {"denied"}
    bad = sealed.withColumn("payload", F.regexp_replace("payload", '"tag":"..', '"tag":"AA'))
    assert {r["status"] for r in vault.decrypt_maps(bad, "long enough passphrase").collect()} <= {"denied"}
    old = sealed.withColumn("payload", F.regexp_replace("payload", "ewmap-1", "ewmap-0"))
    assert {r["status"] for r in vault.decrypt_maps(old, "long enough passphrase").collect()} == {"unsupported"}
    with pytest.raises(ValueError):
        vault.encrypt_maps(entries, "short")


def test_archive(spark, tmp_path):
    rows = spark.createDataFrame([("a", "text é", '{"m":1}', '{"r":[1,2]}')], "source_id string, sanitized_text string, manifest string, report string")
    built = archive.packages(rows).cache()
    r = built.first()
    with zipfile.ZipFile(io.BytesIO(r["zip"])) as z:
        assert z.namelist() == list(archive.ENTRIES)
        assert z.read("SAFE_SOURCE/source.md") == "text é".encode()
        assert z.read("DLP-REPORT.json") == b'{\n  "r": [\n    1,\n    2\n  ]\n}\n'
    assert hashlib.sha256(r["zip"]).hexdigest() == r["zip_sha256"]
    archive.save_packages(built, str(tmp_path))
    archive.save_packages(built, str(tmp_path))  # as a repeated task would
    assert len(list(tmp_path.iterdir())) == 1
    next(tmp_path.iterdir()).write_bytes(b"other")
    with pytest.raises(Exception, match="FileExistsError"):
        archive.save_packages(built, str(tmp_path))
    assert len(list(tmp_path.iterdir())) == 1
    with pytest.raises(ValueError):
        archive.build_zip([("../x", b"")])
    with pytest.raises(ValueError):
        archive.inspect_zip(archive.build_zip([("x", b"")]))


def test_readers_and_lint(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,body\n1,"a@b.co\nnext"\n', encoding="utf-8")
    r = readers.read_csv(spark, str(tmp_path / "a.csv"), "id", "body").first()
    assert (r["source_id"], r["text"]) == ("1", "a@b.co\nnext") and len(r["source_sha256"]) == 64
    (tmp_path / "b.md").write_text("one\ntwo", encoding="utf-8")
    assert readers.read_text(spark, str(tmp_path / "b.md")).first()["text"] == "one\ntwo"
    files = spark.createDataFrame([("x", "fetch (u); http" + "://h"), ("y", "fine")], "path string, text string")
    assert sorted(tuple(v) for v in lint.violations(files, endings=None).collect()) == [("x", "fetch"), ("x", "url")]


def test_stream_equals_batch(spark, tmp_path):
    d = docs(spark, "a@b.co a@b.co 0912345678 password = abcdefgh9", "clean", None)
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    for name, build in (("texts", lambda x: sanitize_stream(x).select("source_id", "sanitized_text", "cleared")), ("finds", lambda x: findings_stream(x, "source_id"))):
        q = build(stream).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        assert sorted(map(repr, spark.table(name).collect())) == sorted(map(repr, build(d).collect()))
    text = sanitize_stream(d).orderBy("source_id").first()
    assert text["sanitized_text"] == "【EMAIL-01】 【EMAIL-02】 【PHONE-01】 [REMOVED]" and text["cleared"]


DELETE = lambda r: [("delete", None, None, None)]


def test_rows_without_an_id_or_with_a_repeated_one_do_not_leave(spark):
    texts = [(None, "host 10.1.2.3 and Harbour Looms"), ("dup", "mail a.b@example.com end"), ("dup", "zzzzz 1.2.3.4 mail c.d@example.com"), ("dup", None), ("one", "mail a.b@example.com end"), (None, None)]
    d = spark.createDataFrame(texts, "source_id string, text string").repartition(3)
    rows = W.sanitize(d, decisions(spark, d, DELETE), ("Harbour Looms",)).collect()
    got = sorted((r["source_id"] or "", r["status"], r["sanitized_text"] or "", r["n_public"], len(r["public"] or [])) for r in rows)
    assert got == [
        ("", "no_source_id", "", 0, 0),
        ("", "no_source_id", texts[0][1], 0, 0),
        ("dup", "duplicate_source", "", 0, 0),
        ("dup", "duplicate_source", texts[1][1], 0, 0),
        ("dup", "duplicate_source", texts[2][1], 0, 0),
        ("one", "ok", "mail [REMOVED] end", 1, 1),
    ]
    gate = spark.createDataFrame([(s,) for s in ("ok", "no_source_id", "duplicate_source", "error", "no_text", None)], "s string")
    gate = gate.select(G.export_status(F.lit("P0"), F.lit("cloud-approved"), F.lit("x"), F.lit(0), F.col("s"))).collect()
    assert [g[0] for g in gate] == ["ok"] + ["not_transformed"] * 5
    with pytest.raises(D.SanitizeError, match="duplicate_source|no_source_id"):
        D.require_valid(D.review(D.with_decisions(d, decisions(spark, d, DELETE))))


def test_a_decision_is_never_applied_to_another_text(spark):
    d = docs(spark, "mail a.b@example.com end", "longer mail a.b@example.com end")
    wrong = decisions(spark, d.where("source_id = '0'"), DELETE).withColumn("source_id", F.lit("1"))
    out = {r["source_id"]: (r["status"], r["sanitized_text"]) for r in W.sanitize(d, wrong).collect()}
    assert out == {"0": ("unresolved", "mail a.b@example.com end"), "1": ("unresolved", "longer mail a.b@example.com end")}


def test_decisions_of_equal_seq_have_an_order(spark):
    rows = [("s", 1, "f", a, t, None, None) for a, t in (("keep", "x"), ("tokenize", "a"), ("tokenize", "b"), ("delete", "z"))]
    rows += [("s", None, "f", "tokenize", "zz", None, None), (None, 9, "f", "tokenize", None, None, None), ("s", 9, None, "tokenize", None, None, None)]
    for seed in range(4):
        shuffled = spark.createDataFrame(rows, DECISION).orderBy(F.rand(seed)).repartition(3)
        assert [(r["source_id"], r["action"], r["token_label"]) for r in D.last_decisions(shuffled).collect()] == [("s", "tokenize", "b")]


def test_one_detection_in_the_plan(spark):
    from scrubline.operators.catalog import DETECTORS
    from scrubline.operators.detect import detect

    d = docs(spark, "a@b.co").withColumn("found", detect(F.col("text")))
    d = d.withColumn("decisions", F.create_map().cast(f"map<string,{D.DECISION}>"))
    plan = W.rewritten(D.review(d), ["source_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == len(DETECTORS)


def test_odd_decisions(spark):
    d = docs(spark, "a@b.co", "", None)
    none = spark.createDataFrame([], DECISION)
    assert {r["source_id"]: r["status"] for r in W.sanitize(d, none).collect()} == {"0": "unresolved", "1": "ok", "2": "no_text"}
    assert W.sanitize(d.limit(0), none).count() == 0
    assert {r["status"] for r in W.sanitize(d, none, token_scope="project").collect()} == {"unresolved", "ok", "no_text"}


def test_project_tokens_of_a_value_that_many_sources_share(spark):
    d = docs(spark, *["mail same@b.co" if i % 3 else f"mail u{i}@b.co" for i in range(600)]).repartition(4)
    rows = sanitized(spark, d, lambda r: [("tokenize", None, None, None)], scope="project").collect()
    tokens = {r["sanitized_text"] for r in rows if int(r["source_id"]) % 3}
    assert len(tokens) == 1 and len({r["sanitized_text"] for r in rows}) == 201


def test_rehydrated_originals_are_not_replaced_again(spark):
    row = spark.createDataFrame([("【A-01】 and 【A-02】 and 【B-01】", [("【A-01】", "【A-02】"), ("【A-02】", "y")])], "t string, e array<struct<token:string,original:string>>")
    assert row.select(W.rehydrate(F.col("t"), F.col("e"))).first()[0] == "【A-02】 and y and 【B-01】"


def test_malformed_vaults_are_denied_row_by_row(spark):
    entries = spark.createDataFrame([(str(i), "【X-01】", "v", "exact-data") for i in range(6)], "source_id string, token string, original string, finding_type string")
    sealed = vault.encrypt_maps(entries, "long enough passphrase")
    swap = lambda field, value: F.regexp_replace("payload", f'"{field}":"[^"]*"', f'"{field}":"{value}"')
    n = F.col("source_id")
    bad = sealed.withColumn("payload", F.when(n == "0", swap("salt", "abc")).when(n == "1", swap("salt", "AAAA")).when(n == "2", swap("nonce", "*")).when(n == "3", "no json").when(n == "4", F.lit(None)).otherwise(F.col("payload")))
    got = {r["source_id"]: r["status"] for r in vault.decrypt_maps(bad, "long enough passphrase").collect()}
    assert got == {"0": "denied", "1": "denied", "2": "denied", "3": "unsupported", "4": "unsupported", "5": "ok"}


def test_export_end_to_end(spark, tmp_path):
    texts = {"a": "mail a.b@example.com", "b": "clean", "c": "open 1.2.3.4", "d": "secret route", "e": "half read"}
    rows = [(k, t, "P1", "local-only" if k == "d" else "cloud-approved", "plain-text-partial" if k == "e" else "plain-text-complete") for k, t in texts.items()]
    d = spark.createDataFrame(rows, "source_id string, text string, classification string, route string, coverage string")
    gates, built = X.safe_packages(d, decisions(spark, d.where("source_id = 'a'"), lambda r: [("tokenize", None, None, None)]), "demo")
    assert {r["source_id"]: r["gate"] for r in gates.collect()} == {"a": "ok", "b": "ok", "c": "unresolved", "d": "blocked_route", "e": "incomplete_coverage"}
    built = built.cache()
    for folder in (str(tmp_path / "plain"), f"file://{tmp_path}/store"):
        archive.save_packages(built, folder)
        archive.save_packages(built, folder)  # as a repeated task would
        back = archive.opened(archive.read_packages(spark, folder.removeprefix("file://"))).collect()
        assert sorted({r["source_id"] for r in back}) == ["a", "b"] and len(back) == 8
    assert all(b"a.b@example.com" not in bytes(r["zip"]) for r in built.collect())


def test_coverage_of_files(spark, tmp_path):
    (tmp_path / "good.md").write_text("漢 fine", encoding="utf-8")
    (tmp_path / "bad.md").write_bytes(b"half \xff\xfe")
    assert sorted(r["coverage"] for r in readers.read_text(spark, str(tmp_path)).collect()) == ["plain-text-complete", "plain-text-partial"]


def test_lint_looks_at_source_files_only(spark):
    text = "fetch(u)"
    files = spark.createDataFrame([(p, text) for p in ("a.ts", "b.mjs", "c.md", "d.tsx", "rules.js", "ts")], "path string, text string")
    assert sorted(v["path"] for v in lint.violations(files, exempt=("rules.js",)).collect()) == ["a.ts", "b.mjs"]


def test_archives_are_handed_on_in_small_batches():
    """However many rows come in at once, a worker holds a few archives only."""
    import pyarrow as pa

    from scrubline.sources import archive

    schema, held = pa.schema([("n", pa.int64())]), []

    def rows():
        for i in range(1000):
            held.append(i)
            yield (i,), 1 << 20

    sizes = []
    for batch in archive._by_size(schema, rows()):
        sizes.append(batch.num_rows)
        assert len(held) == sum(sizes)
    assert sum(sizes) == 1000 and max(sizes) == archive.OUT_BYTES >> 20
    assert [b.num_rows for b in archive._by_size(schema, (((i,), 0) for i in range(archive.OUT_ROWS + 1)))] == [archive.OUT_ROWS, 1]
