"""words meet by shuffles, however small Spark takes their forms to be."""

from __future__ import annotations

from speechmart.operators import scoring


def test_forms_of_words_are_not_broadcast(spark):
    df = spark.createDataFrame([("abcdefgh",), ("abcdefgi",), ("kitten",), ("titten",)], "w string")
    pairs = scoring.similar_words(df, "w", 0.8)
    plan = pairs._jdf.queryExecution().toString()
    assert plan.count("SortMergeJoin") >= 3 and "Broadcast" not in plan
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == [("abcdefgh", "abcdefgi"), ("abcdefgi", "abcdefgh"), ("kitten", "titten"), ("titten", "kitten")]
