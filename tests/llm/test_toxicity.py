"""Toxicity: quotation marks, choice of the fitted rows, empty tables."""

import numpy as np

from urlvane.llm import toxicity


def test_inside_quotes():
    text = 'a "b c" d\n"e\nf „g“ h'
    places = np.array([i for i, c in enumerate(text) if c.isalpha()])
    plain = [sum(text[text.rfind("\n", 0, i) + 1:i].count(q) for q in toxicity.QUOTES) % 2 == 1 for i in places]
    assert toxicity._inside_quotes(text, places).tolist() == plain


def test_fitted_rows(spark):
    docs = spark.createDataFrame(
        [(1, "b", 0), (1, "a", 0), (2, None, 0), (3, "c", 0), (None, "d", 0), (4, "e", 0)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, 0), (None, 1), (4, None), (9, 1)], "doc_id long, toxic int")
    rows, n = toxicity.fitted_rows(docs, labels)
    assert sorted((r.text, r.toxic) for r in rows.collect()) == [("a", 1), ("c", 0)]
    assert n == {1: 2, 0: 1}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.judged(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "text"), (2, None)], "doc_id long, text string")
    assert [r.score for r in toxicity.judged(some, labels).collect()] == [0.0, 0.0]
