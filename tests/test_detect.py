"""Golden vectors and an independent oracle for detection."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scrubline.operators.detect import detect

A20 = "a" * 20
G1 = "Invoice of Blue Heron Ltd to ann.lee+billing@mail.example.org, call 0987 654321 (id B298765432)\nserver 192.0.2.77; client-secret: 'q9w8e7r6t5-sk-zyxwvutsrqponmlkjihgfedcba98'"
#: name: text, terms, expected (detector, start, end, id or None)
GOLDEN = {
    "all_kinds": (
        G1,
        ("Blue Heron Ltd",),
        [
            ("local-exact-data", 11, 25, "dab8c6d1d0dbc80d"),
            ("email", 29, 61, "585fce34375e9e53"),
            ("taiwan-mobile", 68, 79, "524356b80f7799de"),
            ("taiwan-id", 84, 94, "94324c3befeaa5aa"),
            ("ipv4", 103, 113, "81a1700cb02cc10c"),
            ("credential-assignment", 115, 173, "5b46dc433c0688e0"),
        ],
    ),
    "quoted_secret": ("passwd:'hunter2-hunter2'", (), [("credential-assignment", 0, 23, "5c95a0779a7afd1c")]),
    "cjk_email": ("電郵a.b@example.com請", (), [("email", 2, 17, "d596d70e3b268900")]),
    "astral": ("😀A123456789", (), [("taiwan-id", 1, 11, "e72d4b7512126bdb")]),
    "terms_scan_alone": ("baaa", ("ba", "aa"), [("local-exact-data", 0, 2, "830b0b4a1b1d5e7b")]),
    "earlier_suppresses": ("risk sk-abcdefghijklmnopqrstuvw", ("risk sk-a",), [("local-exact-data", 0, 9, "fe4ceebbc90d2719")]),
    "octets": ("1.2.3.4.5 256.1.1.1 01.02.03.04", (), [("ipv4", 0, 7, None), ("ipv4", 20, 31, None)]),
    "short_word": ('password: "my secret pass"', (), []),
    "prefixed_key": ("db_password=abcdefgh1", (), []),
    "phone": ("10912345678 0912 345-678", (), [("taiwan-mobile", 12, 24, "22c079dea867a07b")]),
    "underscore_kills": (f"ghp_{A20}_x", (), []),
    "hyphens_given_back": (f"sk-{A20}--", (), [("openai-style-token", 0, 23, "44920cf17e469806")]),
    "nbsp_ends_value": ("password=abcdefghij tail", (), [("credential-assignment", 0, 19, "e6e5e2e5e1f811ed")]),
    "closing_quote": ('password="abcdefghij" end', (), [("credential-assignment", 0, 20, "1596c7d8ca423788")]),
    "pem_kinds": ("-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END EC PRIVATE KEY-----", (), [("private-key-block", 0, 64, "f2703aabdb7991fb")]),
    "cjk_credential": ("的password=abcdefgh", (), [("credential-assignment", 1, 18, "8c263aac59557c14")]),
    "combining": ("A123456789́", (), [("taiwan-id", 0, 10, "3fa9e0db6e64ca92")]),
    "empty": ("", (), []),
}


def run(spark, texts, terms=()):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", detect(F.col("t"), terms).alias("f"))
    return [r["f"] for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("name", GOLDEN)
def test_golden(spark, name):
    text, terms, expected = GOLDEN[name]
    got = run(spark, [text], terms)[0]
    assert [(f["detector"], f["start"], f["end"]) for f in got] == [e[:3] for e in expected]
    for f, e in zip(got, expected):
        assert e[3] is None or f["finding_id"] == e[3]
        assert f["value"] == text[f["start"] : f["end"]]


def test_null_text_has_null_findings(spark):
    assert run(spark, [None]) == [None]


_S = "[ \\t\\n\\x0b\\f\\r\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
_O = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: The detectors' patterns as Python takes them.
ORACLE = [
    (3, r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", 0),
    (3, r"\bsk-[A-Za-z0-9_-]{20,}\b", 0),
    (3, r"\bgh[pousr]_[A-Za-z0-9]{20,}\b", 0),
    (3, rf"\b(?:password|passwd|api[_-]?key|access[_-]?token|client[_-]?secret){_S}]*[:=]{_S}]*[\"']?[^{_S[1:]}\"']{{8,}}", re.I),
    (2, r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", re.I),
    (2, r"(?<!\d)09\d{2}[- ]?\d{3}[- ]?\d{3}(?!\d)", 0),
    (2, r"\b[A-Z][12]\d{8}\b", 0),
    (1, rf"\b{_O}(?:\.{_O}){{3}}\b", 0),
]


def oracle(text, terms):
    found = []
    rules = ORACLE + [(2, re.escape(t), 0) for t in terms if len(t) >= 2]
    for k, (sev, p, flags) in enumerate(rules):
        found += [(m.start(), -sev, -m.end(), k) for m in re.finditer(p, text, flags | re.ASCII)]
    out, last = [], 0
    for s, _, e, _ in sorted(found):
        if s >= last:
            out.append((s, -e))
            last = -e
    return out


PIECES = ["sk-", A20, "ghp_", "password", " = ", ":", '"', " ", "　", "é", "漢", "😀", "a.b@c.de", "@", ".", "0912", "345678", "-", "A1", "23456789", "10.0.0.1", ".5", "ba", "aa", "\n", "-----BEGIN PRIVATE KEY-----", "-----END EC PRIVATE KEY-----", "_", "9"]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=14).map("".join), min_size=40, max_size=60))
def test_same_as_python_re(spark, texts):
    terms = ("ba", "aa", "A1")
    for text, got in zip(texts, run(spark, texts, terms)):
        assert [(f["start"], f["end"]) for f in got] == oracle(text, terms)
        assert all(f["value"] == text[f["start"] : f["end"]] for f in got)


def test_large_dictionary_scans_each_term_by_itself(spark):
    terms = ("ba", "aa", "x") + tuple(f"t{i}.(" for i in range(70)) + ("t1.(t2", "漢", "漢😀")
    texts = ["baaa", "t1.(t2.( t69.(", "😀漢😀 t1.(t1.(", "", "none", "password=t5.(t6.(t7.(", "a@b.co t3.("]
    for text, got in zip(texts, run(spark, texts, terms)):
        assert [(f["start"], f["end"]) for f in got] == oracle(text, terms)
        assert all(f["value"] == text[f["start"] : f["end"]] for f in got)
    assert run(spark, [None], terms) == [None]


def test_no_detector_matches_nothing(spark):
    from scrubline.operators.catalog import DETECTORS, Detector
    from scrubline.operators.detect import matches

    empty = spark.createDataFrame([("",), ("axb",)], "t string")
    assert all(not any(r) for r in empty.select(*[F.size(matches(F.col("t"), d, 0)) for d in DETECTORS]).collect())
    maybe = Detector("maybe", "x", "low", "x*")
    got = [[(m["start"], m["value"]) for m in r[0]] for r in empty.select(matches(F.col("t"), maybe, 0)).collect()]
    assert all(value for row in got for _, value in row)


PUNCTUATED = ["a.b", "(x)", "[y]", "c++", "$1", "^^", "\\E\\Q", "a|b", "{2}", "-#-", "é.", "?*"]


def test_terms_are_literal(spark):
    texts = [" ".join(PUNCTUATED), "axb x y c+ 1 a b 22", "\\\\E\\Q.."]
    for extra in ((), tuple(f"none{i}" for i in range(70))):
        for text, got in zip(texts, run(spark, texts, (*PUNCTUATED, *extra))):
            assert [(f["start"], f["end"]) for f in got] == oracle(text, PUNCTUATED)


def test_a_dictionary_of_many_thousand_terms(spark):
    terms = tuple(f"customer {i}" for i in range(20_000)) + ("mer 77", "漢字")
    texts = ["nothing", "to customer 77 and customer 19999 漢字", None, ""]
    got = run(spark, texts, terms)
    assert [[f["value"] for f in g] for g in got if g is not None] == [[], ["customer 77", "customer 19999", "漢字"], []] and got[2] is None


def test_cheap_tests_hold_of_every_match(spark):
    """The guards are true wherever the patterns match, in letters of either case."""
    from scrubline.operators.catalog import DETECTORS

    texts = ["PASSWORD: abcdefgh", "Api-Key=abcdefgh1", "apikey = 'abcdefgh1", "API_KEY:abcdefgh", "Access-Token : abcdefgh", "accesstoken=abcdefgh", "CLIENT_SECRET=abcdefgh", "client-secret:abcdefgh", "passWD=abcdefgh", "A123456789", "x 1.2.3.4 y", "漢 Client_Secret：=abcdefgh", "İ Access_token=abcdefgh"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for d in DETECTORS:
        got = rows.select(F.col("t").rlike(d.pattern).alias("m"), d.may_match(F.col("t")).alias("g"))
        assert got.where("m and not g").count() == 0
    assert rows.where(DETECTORS[3].may_match(F.col("t"))).count() >= 11


def test_texts_that_hold_the_marks(spark):
    texts = ["﷐ a@b.co ﷑﷑﷐", "password=abc﷐﷑defgh sk-" + A20 + "﷑", "﷑﷐﷑" * 3 + "0912345678", "﷐ba﷐aa"]
    for text, got in zip(texts, run(spark, texts, ("ba", "﷐a"))):
        assert [(f["start"], f["end"]) for f in got] == oracle(text, ("ba", "﷐a"))
        assert all(f["value"] == text[f["start"] : f["end"]] for f in got)


def test_empty_matches_leave_the_places_of_others(spark):
    from scrubline.operators.catalog import Detector
    from scrubline.operators.detect import matches

    texts = ["a1", "12", "é12漢345", "﷐3﷑﷑4", "", "none"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", matches(F.col("t"), Detector("digits", "digits", "low", "[0-9]*", ""), 0).alias("m")).orderBy("i").collect()
    assert [[(m["start"], m["value"]) for m in r["m"]] for r in got] == [[(m.start(), m.group()) for m in re.finditer("[0-9]+", t)] for t in texts]


def test_a_text_is_scanned_once_by_a_detector(spark):
    """Each pattern stands in one expression that goes over the text, and no copy in lower case is made."""
    plan = spark.createDataFrame([("x",)], "t string").select(detect(F.col("t")).alias("f"))._jdf.queryExecution().analyzed().toString()
    assert "lower(" not in plan and plan.count("ccess[_-]?token)|(?<=c)") == 1


def test_the_common_scan_finds_what_each_detector_finds(spark):
    """All detectors in one scan over Arrow batches, by the patterns that the expressions of single detectors take; broken UTF-8 counts as U+FFFD."""
    from scrubline.operators.catalog import DETECTORS
    from scrubline.operators.detect import candidates, matches

    texts = [t for t, _, _ in GOLDEN.values()] + ["x᠎password = abcdefgh tail", "KPI_KEY=abcdefgh apiſkey=abcdefgh", "-----BEGIN PRIVATE KEY-----\U0001f600-----END PRIVATE KEY-----", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    broken = spark.range(1).select(F.lit(99).alias("i"), F.concat(F.lit("a@b.co "), F.unhex(F.lit("E6BC")).cast("string"), F.lit(" sk-" + A20)).alias("t"))
    both = rows.unionByName(broken).select("i", candidates(F.col("t")).alias("one"), *[matches(F.col("t"), d, k).alias(f"m{k}") for k, d in enumerate(DETECTORS)])
    for r in both.collect():
        got = sorted((x["ord"], x["start"], -x["neg_end"], x["start16"], x["value"]) for x in r["one"])
        assert got == sorted((x["ord"], x["start"], -x["neg_end"], x["start16"], x["value"]) for k in range(len(DETECTORS)) for x in r[f"m{k}"] or []), r["i"]
    plan = rows.select(detect(F.col("t"), ("ba", "aa")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "split(" not in plan


def test_matches_about_a_character_are_those_of_the_pattern():
    import random

    from scrubline.operators.catalog import DETECTORS
    from scrubline.operators.detect import anchored

    letters = {"email": ["a", "B", "_", ".", "%", "-", "+", "@", ".com", " ", "é", "😀", "9", "@b.cc", "x@y.zz"], "ipv4": ["1", "2", "25", "255", "256", ".", "1.2.3.4", "a", "_", " ", "٣", "0", ".0.", "é"]}
    draw, seen = random.Random(5), 0
    for d in (d for d in DETECTORS if d.around):
        assert d.head + d.tail == d.pattern
        scan, pattern = anchored(*d.around, d.head, d.tail), re.compile(d.pattern, re.ASCII)
        for _ in range(20000):
            text = "".join(draw.choices(letters[d.name], k=draw.randint(1, 14)))
            spans = [m.span() for m in pattern.finditer(text)]
            assert list(scan(text)) == spans, text
            seen += len(spans)
    assert seen > 5000


def test_a_long_run_before_a_sign_is_gone_through_once(spark):
    """Each of its characters was tried as the start of an address: 40,000 took 3.8 s, ten times as many a hundred times as long."""
    import time

    text = "a." * 200000 + "@ " + "1." * 200000 + " a@b.co"
    began = time.time()
    got = run(spark, [text])[0]
    assert [(f["detector"], f["start"], f["end"]) for f in got] == [("ipv4", 400002 + 8 * i, 400009 + 8 * i) for i in range(50000)] + [("email", 800003, 800009)]
    assert time.time() - began < 120
