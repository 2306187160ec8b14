"""words of chunks in work that grows with the words."""

from __future__ import annotations

from speechmart.operators import chunks


def test_a_text_is_split_once_and_not_for_every_word(spark):
    c = spark.createDataFrame([(1, 0, 0.0, 10.0, "a b c")], "audio_stem long, chunk_idx int, start double, end double, text string")
    plan = chunks.chunk_words(c)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan.split("Generate")[0]


def test_words_meet_the_chunks_of_their_time_only(spark):
    spans = [(1, k, 28.0 * k, 28.0 * k + 30) for k in range(200)]
    words = [(1, float(t)) for t in range(0, 5600, 3)]
    s = spark.createDataFrame(spans, "audio_stem long, chunk_idx int, chunk_start double, chunk_end double")
    w = spark.createDataFrame(words, "audio_stem long, start double")
    got = chunks.words_of_chunks(w, s)
    assert sorted((r["start"], r["chunk_idx"]) for r in got.collect()) == sorted((t, k) for _, t in words for _, k, a, b in spans if a <= t < b)
    assert "_cell" in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[1].split("\n")[0]
