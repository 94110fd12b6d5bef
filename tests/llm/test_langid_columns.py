"""Language ID beside columns of its own names."""

from chunkwright.llm.langid import keep_identified


def test_columns_named_like_the_prediction_pass(spark):
    rows = [(i, "the cat and the dog", "en", 0.5, "x", i) for i in range(20)] + [(20, "the dog", None, 7.0, "y", 1), (21, "12 --", None, 8.0, "z", 2), (22, None, "en", 9.0, "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, n int")
    out = keep_identified(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [*rows[:20], (20, "the dog", "en", 7.0, "y", 1)]
    unlabelled = keep_identified(docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "score as SCORE"))
    assert unlabelled.columns == ["doc_id", "text", "lang", "SCORE"] and unlabelled.count() == 21
