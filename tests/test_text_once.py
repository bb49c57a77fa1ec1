"""Parts of the feature record that must be evaluated once per mail."""

from pyspark.sql import functions as F

from lurewatch.functions import fixed_values as fv, text


def test_each_phrase_is_searched_once(spark):
    shown = str(text.lexicon_counts(F.col("body"), {"one": ["zig", "zag"]}))
    assert shown.count("zig") == shown.count("zag") == 1
    df = spark.createDataFrame([("Zig zag zig",), ("",), (None,)], "body string")
    got = df.select(text.lexicon_counts(F.col("body"), {"one": ["zig", "zag"]}).alias("s")).select("s.*").collect()
    assert [tuple(r) for r in got] == [(2, 1), (0, 0), (0, 0)]


def test_texts_are_lowered_once_for_all_shorteners(spark):
    column = text.link_manipulation(F.col("body"), F.col("html"), F.array().cast("array<string>"))
    assert len(fv.SHORTENERS) > 1 and str(column).count("lower(") == 2
    df = spark.createDataFrame([("x BIT.ly/1", None), ("x", "<a href='http://BIT.LY/2'>"), ("x", "")], "body string, html string")
    assert [r[0] for r in df.select(column).collect()] == [1, 1, 0]
