"""The bounded sample of language identification keeps rare languages."""

from scrubline.llm import language_id


def test_a_rare_language_is_learned(spark):
    rows = [(i, f"the quick brown fox number {i} jumps over it and that", "en") for i in range(900)]
    rows += [(1000 + i, f"der schnelle braune fuchs nummer {i} springt und das ist", "de") for i in range(12)]
    rows += [(2000, "no language given", None), (None, "the fox", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.fit(docs, sample=60)
    assert model.languages == ["de", "en"]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, model).collect()}
    assert sum(got[i] == "de" for i in range(1000, 1012)) >= 10


def test_no_language_at_all(spark):
    docs = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == [] and [tuple(r) for r in language_id.predict(docs, model).select("lang_pred", "score").collect()] == [("und", 0.0)] * 2
