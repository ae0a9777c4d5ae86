"""The pipeline's stages against brute force, each on its own input."""

import os
import re

import pytest

import corpus_pipeline as P
from scrubline.llm import near_dedup, quality, suffix_dedup

DATA = "/root/testdata/sf0.001"
SPACE = re.compile("[\x20\x09-\x0d]")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    states = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, states[-1], DATA).write.parquet(str(tmp_path / str(k)))
        states.append(spark.read.parquet(str(tmp_path / str(k))))
    raw, good, exact, near, cut, packed = [s.toPandas() for s in states]
    for s in (good, exact, near, cut):
        assert list(s.columns) == list(raw.columns)
    verdict = quality.score(docs, quality.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))).toPandas()
    assert set(good.doc_id) == set(verdict[verdict.predicted == 1].doc_id) and 0 < len(good) < len(raw)
    best = {}
    for r in good.itertuples():
        key = SPACE.sub("", r.text)
        best[key] = min(best.get(key, (1, 0)), (-len(r.text), r.doc_id))
    assert set(exact.doc_id) == {i for _, i in best.values()}
    kept = near_dedup.near_dedup(states[2]).where("kept").toPandas()
    assert set(near.doc_id) == set(kept.doc_id)
    report = suffix_dedup.dedup_report(states[3]).toPandas().set_index("doc_id")
    before = dict(zip(near.doc_id, near.text))
    assert set(cut.doc_id) == set(before)
    for r in cut.itertuples():
        lost = len(before[r.doc_id].encode()) - len(r.text.encode())
        assert report.n_removed[r.doc_id] <= lost <= report.n_removed[r.doc_id] + 6 * report.n_spans[r.doc_id]
        assert r.n_chars == len(r.text)
    assert set(packed.doc_id) == set(cut.doc_id)
    assert P.run(spark, DATA).count() == len(packed)


def test_null_ids_pass_the_stages(spark):
    rows = [(None, "one text", None, None, None), (1, "one text", "en", "s", 8), (2, None, "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for stage in (P.exact_stage, P.near_stage, P.suffix_stage):
        assert stage(spark, docs, "").count() in (2, 3)


def test_exact_stage_judges_rows_of_null_and_repeated_ids(spark):
    rows = [(None, "own text"), (None, "a text"), (None, "lone copy"), (None, "lone  copy"), (None, None), (None, ""), (1, "a text"), (2, "b text"), (3, "b text"), (3, "c text")]
    docs = spark.createDataFrame([(*r, "en", "s", 8) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = P.exact_stage(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"] or "") for r in out.collect()]
    assert sorted(got, key=repr) == sorted([(None, "own text"), (None, "lone  copy"), (None, ""), (1, "a text"), (2, "b text"), (3, "c text")], key=repr)


CLASHING = ["id", "kept", "kept_id", "keep", "keep_id", "digest", "run", "n", "key", "comp", "quality_score", "score", "held_out", "piece", "length", "part", "count", "a", "b"]


@pytest.fixture(scope="module")
def labels_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("labels"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def _odd_rows(spark):
    """Null and empty texts, a very long one, ties, repeated rows, null ids; other columns have the stages' own names."""
    long_text = " ".join(f"word{i * 7919 % 5003}" for i in range(60_000))
    texts = {1: "plain words of one short text", 2: None, 3: "", 4: long_text, 5: long_text, 6: "plain words of one short text", 7: " \n\t", None: "no id at all"}
    rows = [(i, t, None, None, None, *CLASHING) for i, t in texts.items()] + [(1, texts[1], None, None, None, *CLASHING)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))


def test_stages_on_odd_rows(spark, labels_dir):
    docs = _odd_rows(spark).cache()
    got = {name: stage(spark, docs, labels_dir).toPandas() for name, stage in P.STAGES}
    for name, rows in got.items():
        if name != "packing":
            assert list(rows.columns) == docs.columns, name
            assert all((rows[c] == c).all() for c in CLASHING), name
    ids = {name: sorted(-1 if i != i or i is None else int(i) for i in rows.doc_id) for name, rows in got.items()}
    # of equal texts one id stays, with all its rows; null, empty and blank texts are equal
    assert ids["exact dedup"] == [-1, 1, 1, 4, 7]
    # texts without words link with nothing; equal sets do
    assert ids["near dedup"] == [-1, 1, 1, 2, 3, 4, 7]
    assert ids["suffix dedup"] == [-1, 1, 1, 2, 3, 4, 5, 6, 7]
    left = dict(zip(got["suffix dedup"].doc_id, got["suffix dedup"].text))
    assert left[5] == "" and left[4] == docs.where("doc_id = 4").first()["text"]
    packed = got["packing"]
    assert len(packed[packed.piece == 0]) == 9
    for _, s in packed.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 1024


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(i, i % 2, 0) for i in range(6)], [(i, 0, 0) for i in range(40)]])
def test_quality_stage_keeps_all_where_nothing_was_learned(spark, tmp_path, labels):
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, f"plain words of text {i}") for i in range(40)], "doc_id long, text string")
    assert P.quality_stage(spark, docs, str(tmp_path)).count() == 40


def test_stages_on_empty_tables(spark, labels_dir):
    docs = _odd_rows(spark).limit(0)
    for name, stage in P.STAGES:
        out = stage(spark, docs, labels_dir)
        assert out.count() == 0, name
        assert name == "packing" or out.columns == docs.columns, name
