"""characters are counted by text."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechmart.operators import vocab


def test_a_text_has_one_row_for_each_distinct_character(spark):
    df = spark.createDataFrame([(1, "abaa"), (2, ""), (3, None), (None, "ba😀")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["ch"], r["pos"], r["n"]) for r in vocab.distinct_characters(df, F.col("text"), "doc_id").collect()))
    assert got == [(0, "a", 1, 1), (0, "b", 0, 1), (0, "😀", 2, 1), (1, "a", 0, 3), (1, "b", 1, 1)]
