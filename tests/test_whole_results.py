"""Limits that are parameters, and what they leave out."""

import logging

from scrubline.operators import compare, text


def test_many_normal_forms(spark, caplog):
    rows = [(i, f"City {i % 40}" if i % 3 else f"city {i % 40} ") for i in range(400)] + [(400, None)]
    df = spark.createDataFrame(rows, "id int, city string")
    with caplog.at_level(logging.WARNING):
        assert text.normalise_categories(df).select("city").distinct().count() > 41
    assert "city" in caplog.text
    whole = text.normalise_categories(df, max_forms=None)
    assert whole.columns == ["id", "city"] and whole.count() == 401
    assert whole.select("city").distinct().count() == 41 and whole.where("id = 400").first()["city"] is None


def test_columns_left_out_of_correlations(spark, caplog):
    df = spark.createDataFrame([(str(i), "x" if i % 2 else "y", "a" if i % 2 else "b") for i in range(100)], "k string, u string, v string").selectExpr("concat('key', k) AS k", "u", "v")
    with caplog.at_level(logging.WARNING):
        compare.correlations(df, "cramers_v").collect()
    assert "k" in caplog.text
