import corpus_pipeline

from .conftest import DOCS, prose


def test_language_stage_keeps_the_users_columns(spark, rng):
    rows = [(i, prose(rng, 30), "en", 0.25 + i, "mine", "l") for i in range(6)] + [(9, "123", None, 0.5, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, _lang string")
    found = corpus_pipeline.identify_language(spark, docs, "")
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect())) == sorted(rows[:6])


def test_different_texts_of_one_id_stay(spark, rng):
    one, two, three = (prose(rng, 40) for _ in range(3))
    rows = [(1, one, "en", "b", 1), (1, two, "en", "a", 1), (1, one, "en", "a", 1), (2, three, "en", "s", 1), (3, three, "en", "s", 1), (None, None, None, None, None)]
    found = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, [rows[1], rows[2], rows[3], rows[5]]))
