"""words behind the last one asked for are never split off or sent."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechmart.operators import chunks, segments


def test_transcript_ends_with_the_words_asked_for(spark):
    rows = [("s", k, " ".join(f"w{k}_{n}" for n in range(5))) for k in range(40)] + [("t", 0, "a b c"), (None, 1, "x y z")]
    docs = spark.createDataFrame(rows, "session string, doc_id long, text string")
    regions = spark.createDataFrame([(1, "s", 0.0, 2.0), (1, "s", 3.0, 5.0), (2, "s", 0.0, 1.0), (3, None, 0.0, 4.0)], "audio_path long, session string, start double, end double")
    b = segments.budget_words(regions, F.lit(3.5))
    some = chunks.transcript_words(docs, "session", "doc_id", first=segments.words_asked(b, "session"))
    whole = chunks.transcript_words(docs, "session", "doc_id")
    assert some.count() == 14 and some.exceptAll(whole).count() == 0
    want = {tuple(r) for r in segments.assign_budget(regions, whole, F.lit(3.5), "session").collect()}
    assert {tuple(r) for r in segments.budget_text(b, some, "session").collect()} == want and len(want) == 3
