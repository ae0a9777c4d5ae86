"""The delimited reader against the csv module, on damaged files, and over many byte ranges."""

import csv
import io
import random

import pytest

from scrubline.operators.report import COVERAGE
from scrubline.sources import readers


def read(spark, path, sep=",", **more):
    rows = readers.read_csv(spark, str(path), "id", "body", sep, **more).collect()
    return sorted(((r["source_id"], r["text"], r["coverage"] == COVERAGE) for r in rows), key=repr)


@pytest.mark.parametrize("sep", [",", "\t"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_csv_module(spark, tmp_path, sep, end):
    rng = random.Random(4)
    rows = [(str(i), "".join(rng.choice('ab"\n\r,\t é漢') for _ in range(rng.randrange(30)))) for i in range(300)]
    rows += [("300", ""), ("301", '"'), ("302", '""'), ("303", "\n\n"), ("304", "x" * 100_000 + '"' * 1000)]
    out = io.StringIO(newline="")
    w = csv.writer(out, delimiter=sep, lineterminator=end, quoting=csv.QUOTE_MINIMAL)
    w.writerows([("id", "body"), *rows])
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + out.getvalue().encode())
    assert read(spark, tmp_path / "a.csv", sep) == sorted(((i, t, True) for i, t in rows), key=repr)


@pytest.mark.parametrize(
    "body,want",
    [
        (b"1,half \xff\xfe\n2,fine\n", {"1": False, "2": True}),
        (b"1,a,b\n2,fine\n", {"1": False, "2": True}),
        (b"1\n2,fine\n", {"1": False, "2": True}),
        (b'1,"open\n2,fine\n', {"1": False}),
        (b'1,"open\n2,fine\n3,"x"\n4,fine\n', {"1": False}),
        (b'1,5" disk\n2,plain\n3,6" disk\n4,ok\n', {"1": False, "4": True}),
        (b'1,"a"b\n2,ok\n', {"1": False, "2": True}),
        ("1,a￿b\n2,ok\n".encode(), {"1": False, "2": True}),
        (b'\n1,"two\n\nlines"\n\n2,ok', {"1": True, "2": True}),
    ],
)
def test_damage_is_partial(spark, tmp_path, body, want):
    (tmp_path / "a.csv").write_bytes(b"id,body\n" + body)
    assert {i: ok for i, _, ok in read(spark, tmp_path / "a.csv")} == want


def test_columns_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("body,id\nx,1\n")
    (tmp_path / "b.csv").write_text("id,other\n2,y\n")
    (tmp_path / "c.csv").write_text('"id","body"\n')
    (tmp_path / "d.csv").write_text("")
    assert read(spark, tmp_path) == [("1", "x", True), ("2", None, False)]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "a.csv").write_text("1,x\n")
    assert read(spark, tmp_path / "e", columns=["id", "body"]) == [("1", "x", True)]


def test_one_file_over_many_tasks(spark, tmp_path):
    rows = [(str(i), f'say "{i}",\n' * (i % 7) + "end") for i in range(4000)]
    with open(tmp_path / "big.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([("id", "body"), *rows])
    key = "spark.sql.files.maxPartitionBytes"
    before, cost = spark.conf.get(key), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(key, 4096)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        lines = spark.read.text(str(tmp_path / "big.csv"), lineSep="\n")
        assert lines.selectExpr("spark_partition_id() AS p").distinct().count() > 20
        assert read(spark, tmp_path / "big.csv") == sorted(((i, t, True) for i, t in rows), key=repr)
    finally:
        spark.conf.set(key, before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_a_record_too_long_is_reported(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "MAX_RECORD", 100)
    (tmp_path / "a.csv").write_text('id,body\n1,"' + "line\n" * 40 + '"\n2,ok\n')
    assert read(spark, tmp_path / "a.csv") == [("2", "ok", True), (None, None, False)]
