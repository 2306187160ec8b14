from __future__ import annotations

import functools
import json
import os
import random
import zipfile

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from speechmart.functions import metrics
from speechmart.operators import anchors, asr, chunks, corrections, ctc, dtw, ranking, scoring, segments, sequences, splits, tiers, vad, vocab
from speechmart.queries import catalog, stream_queries
from speechmart.sources import io as sources
from speechmart.streaming import streams


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=14))
def test_increasing_is_longest(positions):
    best = [1] * len(positions)
    for i, p in enumerate(positions):
        best[i] = max([best[j] + 1 for j in range(i) if positions[j] < p], default=1)
    at = sequences.increasing(positions)
    assert len(at) == max(best, default=0)
    assert at == sorted(at) and all(positions[a] < positions[b] for a, b in zip(at, at[1:]))


def test_anchor_time_and_merge(spark):
    c = spark.createDataFrame([("a", 1, 10.0, 20.0, "te fono")], "audio_stem string, chunk_idx int, start double, end double, text string")
    assert anchors.anchor_hits(c, ["fono"], "mms").first()["time"] == pytest.approx(10 + 10 * 3 / 7)
    hit = "audio_stem string, chunk_idx int, keyword_idx int, offset int, word string, time double, source string, confidence double, chunk_text string"

    def rows(*r):
        return spark.createDataFrame([("a", 0, k, 0, w, float(t), "s", 0.5, "c") for k, (w, t) in enumerate(r)], hit)

    both = anchors.merge_anchors(rows(("palamene", 10)), rows(("parliament", 11.5))).collect()
    assert [(r["word"], r["time"], r["source"], r["confidence"]) for r in both] == [("palamene", 10.75, "both", 0.9)]
    assert anchors.merge_anchors(rows(("palamene", 10)), rows(("parliament", 12))).count() == 1
    assert anchors.merge_anchors(rows(("palamene", 10)), rows(("parliament", 12.1))).count() == 2
    assert anchors.merge_anchors(rows(("palamene", 10)), rows().limit(0)).count() == 1
    first_fit = anchors.merge_anchors(rows(("fono", 5), ("fono", 6)), rows(("fono", 6.5), ("fono", 5.1))).orderBy("time").collect()
    assert [r["source"] for r in first_fit] == ["both", "both"] and first_fit[0]["time"] == pytest.approx(5.55)


def test_pair_split(spark):
    pairs = spark.createDataFrame([("a", 0, 0.0, 40.0, 0, 49, "x", "y")], "audio_stem string, pos int, start double, end double, word_start long, word_end long, anchor_start string, anchor_end string")
    ws = F.array(*[F.lit(f"w{k}") for k in range(60)])
    got = segments.pair_segments(pairs, ws, F.lit(0.8)).orderBy("slice").collect()
    assert [r["word_count"] for r in got] == [16, 16, 18]
    assert [(r["anchor_start"], r["anchor_end"]) for r in got] == [("x", None), (None, None), (None, "y")]
    assert got[0]["confidence"] == pytest.approx(0.75) and got[2]["end"] == 40


def slow_warp(a, b, ratio=0.3):
    """The same recurrence written over dictionaries."""
    n, m = len(a), len(b)
    band = max(3, int(max(n, m) * ratio))
    cost = {(0, 0): 0.0}
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if abs(j - int((i - 1) * m / n)) <= band:
                low = min(cost.get(k, float("inf")) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
                cost[i, j] = 1 - dtw.similarity(a[i - 1], b[j - 1]) + low
    return cost.get((n, m), float("inf"))


def test_warp_cost_and_path():
    rng = random.Random(3)
    words = ["te", "fono", "palamene", "katoa", "tatoa", "lima", "rima", "ng", "n"]
    for _ in range(60):
        a, b = rng.choices(words, k=rng.randint(1, 9)), rng.choices(words, k=rng.randint(1, 9))
        path, score = dtw.warp(a, b)
        assert path[-1] == (len(a) - 1, len(b) - 1) and 0 <= score <= 1
        assert all(0 <= y[0] - x[0] <= 1 and 0 <= y[1] - x[1] <= 1 for x, y in zip(path, path[1:]))
        if path[0] == (0, 0) and slow_warp(a, b) < float("inf"):
            assert sum(1 - dtw.similarity(a[i], b[j]) for i, j in path) == pytest.approx(slow_warp(a, b))
    assert dtw.warp([], ["a"]) == ([], 0.0)


@settings(max_examples=100, deadline=None)
@given(*[st.lists(st.text(alphabet="ktngrl A", max_size=6), min_size=1, max_size=12)] * 2)
def test_similarities_equal_the_scalar(heard, written):
    i, j = np.repeat(np.arange(len(heard)), len(written)), np.tile(np.arange(len(written)), len(heard))
    want = [dtw.similarity(a, b) for a in heard for b in written]
    assert dtw.Similarities(heard, written).at(i, j).tolist() == want == dtw.Similarities(heard, written, cells=0).at(i, j).tolist()


def test_cut_segments():
    heard = [(f"w{k}", k * 1.0, k + 1.0) for k in range(30)]
    written = [f"w{k}" + ("." if k in (9, 19) else "") for k in range(30)]
    assert len(dtw.cut_segments(heard[:10], written[:10], 0, 10)) == 1
    pieces = dtw.cut_segments(heard, written, 0, 30)
    assert [p[2].split()[0] for p in pieces] == ["w0", "w9.", "w19."] and all(2 <= p[1] - p[0] <= 15 for p in pieces)
    assert dtw.cut_segments(heard[:2], written, 0, 30) == []


def test_utterances_and_runs(spark):
    rows = [("a", k * 1.0, k + 0.9, -1.0, f"w{k}") for k in range(25)] + [("a", 40.0, 40.5, -1.0, "x"), ("a", 41.5, 41.7, -9.0, "bad"), ("b", 0.0, 0.1, 0.0, "only")]
    t = spark.createDataFrame(rows, "audio_path string, start double, end double, score double, word string")
    got = segments.utterances(t).orderBy("start").collect()
    assert [r["word_count"] for r in got] == [20, 5]
    m = spark.createDataFrame([(1, 0, "a", 0.0, 0.5, "p"), (1, 1, "a", 0.6, 1.0, "q"), (1, 2, "b", 1.1, 1.2, "r"), (1, 3, "b", 2.0, 2.2, "s")], "block int, pos int, audio_path string, start double, end double, word string")
    assert [r["text"] for r in segments.split_runs(m).orderBy("piece").collect()] == ["p q", "r", "s"]


def test_ctc_collapse(spark):
    frames = [("a", k, t) for k, t in enumerate(["a", "a", "<pad>", "a", "|", "b"])]
    got = ctc.collapse_frames(spark.createDataFrame(frames, "audio_stem string, frame int, token string")).orderBy("word_idx").collect()
    assert [(r["word"], r["start"], r["end"]) for r in got] == [("aa", 0.0, 0.06), ("b", 0.1, 0.1)]


def test_speech_regions(spark):
    energy = [0.1] * 200 + [5.0] * 150 + [0.1] * 20 + [5.0] * 120 + [0.1] * 400 + [5.0] * 30 + [0.1] * 300
    df = spark.createDataFrame([("a", k, e) for k, e in enumerate(energy)], "audio_path string, frame int, energy double")
    got = vad.speech_regions(df).orderBy("start").collect()
    assert [(round(r["start"], 2), round(r["end"], 2)) for r in got] == [(1.95, 4.95)]


def test_chunk_folds(spark):
    segs = spark.createDataFrame([("a", 0.0, 4.0, "x"), ("a", 9.0, 12.0, "y"), ("a", 13.0, 15.0, "z"), ("a", 31.0, 32.0, " ")], "audio_stem string, start double, end double, text string")
    acc = chunks.accumulate_chunks(segs)
    assert sorted((r["start"], r["end"], r["text"]) for r in acc.collect()) == [(0.0, 12.0, "x y"), (13.0, 15.0, "z")]
    assert sorted((r["start"], r["end"]) for r in chunks.regrid(acc).collect()) == [(0.0, 12.0), (10.0, 20.0)]
    files = spark.createDataFrame([("a", 58.3)], "audio_stem string, duration double")
    assert [r["start"] for r in chunks.fixed_chunks(files, 30.0, 2.0, 0.5).orderBy("start").collect()] == [0.0, 28.0, 56.0]


def test_tiers(spark):
    cases = [(0.72, 0.61, 3.0, "high_confidence"), (0.55, 0.55, 5.0, "rough_patch"), (0.3, 0.9, 3.0, "rejected"), (0.5, 0.5, 1.0, "usable")]
    for llm, align, wps, want in cases:
        assert spark.range(1).select(tiers.tier(F.lit(llm), F.lit(align), F.lit(wps)).alias("t")).first()["t"] == want
    assert spark.range(1).select(scoring.combined_confidence(F.lit(0.5), F.lit(0.75)).alias("c")).first()["c"] == 0.65
    rows = [("a", 0.0, 0.9, 0.9, 0.9), ("a", 1.0, 0.5, 0.45, 0.45), ("a", 2.0, 0.9, 0.9, 0.9), ("b", 0.0, 0.5, 0.45, 0.45)]
    s = spark.createDataFrame(rows, "audio_path string, start double, confidence double, llm_score double, align_score double")
    got = {(r["audio_path"], r["start"]): (r["label"], r["neighbor_score"], r["included"]) for r in tiers.assign(s, ["start"]).collect()}
    assert got["a", 1.0] == ("bridge_segment", pytest.approx(0.9), True) and got["b", 0.0] == ("rough_patch", 0.0, False)


def test_split_sizes(spark):
    df = spark.range(1430).withColumnRenamed("id", "k")
    n = {r["split"]: r["count"] for r in splits.split_capped(df, ["k"]).groupBy("split").count().collect()}
    assert n == {"test": 71, "valid": 71, "train": 1288}
    strata = df.withColumn("tier", F.when(F.col("k") < 1, "one").when(F.col("k") < 3, "two").otherwise("many"))
    got = {(r["tier"], r["split"]): r["count"] for r in splits.split_stratified(strata, ["k"]).groupBy("tier", "split").count().collect()}
    assert got["one", "test"] == 1 and got["two", "valid"] == 1 and got["many", "test"] == 71
    assert splits.review_sample(df.withColumn("confidence", F.lit(0.65)), ["k"]).count() == 20


def test_scores_and_joins(spark):
    seg = spark.createDataFrame([("f", 1, 0.0, 12.0)], "audio_stem string, segment_id int, start double, end double")
    ch = spark.createDataFrame([("f", k, k * 10.0, k * 10.0 + 10, f"t{k}") for k in range(4)], "audio_stem string, chunk_idx int, start double, end double, text string")
    assert scoring.overlap_text(seg, ch).first()["asr_text"] == "t0 t1"
    scores = spark.createDataFrame([("a", 0.1, "f1", 0), ("a", 0.9, "f2", 0)], "id string, score double, file string, row_idx int")
    s = spark.createDataFrame([("a", 0.3), ("b", 0.4), ("c", None)], "id string, align_score double")
    assert {r["id"]: r["llm_score"] for r in scoring.merge_scores(s, scores).collect()} == {"a": 0.9, "b": 0.4, "c": 0.5}
    many = spark.range(5).select(F.col("id").cast("string").alias("o"))
    with pytest.raises(ValueError, match="distinct names"):
        scoring.fuzzy_name_join(many.withColumnRenamed("o", "n"), many, "n", "o", max_other_names=3)


def test_corrections(spark, tmp_path):
    bundle = {
        "segments": {"0.0-5.0": {"original_mms": "a", "corrected_text": "Fā'nau mai", "start": 0.0, "end": 5.0, "quality": 4}, "5.0-5.5": {"original_mms": "b", "corrected_text": "te", "start": 5.0, "end": 5.5, "quality": 5}},
        "vocabulary": {"fono": {"word": "fono", "meaning": "meeting", "pos": "n"}},
        "metadata": {"created": "x"},
    }
    (tmp_path / "c.json").write_text(json.dumps(bundle))
    read = sources.read_corrections(spark, str(tmp_path / "c.json"))
    rows = corrections.training_rows(corrections.explode_corrections(read))
    assert [(r["text"], r["duration"]) for r in rows.collect()] == [("fa'nau mai", 5.0)]
    assert sources.vocabulary_rows(read).first()["meaning"] == "meeting"
    assert sources.touch_corrections(read).first()["metadata"]["last_modified"]
    assert sources.read_corrections(spark, str(tmp_path / "absent.json")).count() == 0
    runs = spark.createDataFrame([("iteration_2",), ("iteration_10",)], "name string")
    assert corrections.next_iteration(runs).first()["iteration"] == 11


def test_ctc_vocabulary_sizes(spark):
    df = spark.createDataFrame([(0, "e fano au"), (1, "te fono")], "doc_id long, text string")
    assert vocab.ctc_vocabulary(df, "system4").count() == 38 and vocab.ctc_vocabulary(df, "system6").count() == 33
    ids = {r["token"]: r["id"] for r in vocab.ctc_vocabulary(df).collect()}
    assert ids["<pad>"] == 0 and ids[" "] == 6 and ids["o"] == 5 or ids["e"] in (5, 6, 7)


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "Day_1.json").write_text(json.dumps([{"text": "b", "start": 10.0, "end": None}, {"text": "a", "start": 0.0, "end": 10.0}]))
    got = sources.read_chunks(spark, str(tmp_path / "t")).orderBy("chunk_idx").collect()
    assert [(r["audio_stem"], r["chunk_idx"], r["end"], r["text"]) for r in got] == [("Day_1", 0, 10.0, "a"), ("Day_1", 1, 20.0, "b")]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sources.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int").count() == 2
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>Te </w:t></w:r><w:r><w:t>fono</w:t></w:r></w:p><w:p/></w:body></w:document>")
    assert [r["text"] for r in sources.read_docx(spark, str(tmp_path / "d.docx")).collect()] == ["Te fono"]
    wave = np.sin(np.arange(8000) / 10).astype(np.float32) / 2
    (tmp_path / "x.wav").write_bytes(sources.wav_bytes(wave, 8000))
    row = sources.read_audio(spark, str(tmp_path / "x.wav")).first()
    assert row["duration"] == 1.0 and row["sample_rate"] == 8000 and len(row["samples"]) == 16000
    clips = spark.createDataFrame([("c", wave.tolist())], "file string, samples array<float>")
    assert len(sources.encode_clips(clips).first()["content"]) == 44 + 16000

    def make_model():
        return lambda xs: [str(len(x)) for x in xs]

    assert asr.transcribe(clips, make_model, ["file"]).first()["text"] == "8000"
    sources.write_splits(spark.createDataFrame([(1, "train"), (2, "test")], "a int, split string"), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["split=test", "split=train"]


def test_streams(spark, tmp_path):
    """Words in batches of any order give the utterances of the batch fold."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream_queries.STATE_STORE)
    rng = random.Random(3)
    rows, at = [], 1000.0
    for k in range(60):
        at += rng.choice([0.25, 0.5, 2.0])
        rows.append((rng.choice("ab"), at, at + 0.25, f"w{k}", 0.0 if k % 13 else -9.0))
    schema = "audio_path string, start double, end double, word string, score double"
    end = (None, None, None, None, None)
    want = sorted((r["audio_path"], r["text"], r["start"], r["end"], r["word_count"]) for r in segments.utterances(spark.createDataFrame(rows, schema)).collect())
    for turn in range(3):
        rng.shuffle(rows)
        src = tmp_path / f"in{turn}"
        for n, part in enumerate([rows[:7], rows[7:40], rows[40:], [end]]):
            df = spark.createDataFrame(part, schema).withColumn("ts", F.coalesce(F.timestamp_micros((F.col("start") * 1_000_000).cast("long")), F.lit("2999-01-01").cast("timestamp")))
            seen = set(src.glob("part-*"))
            df.coalesce(1).write.mode("append").parquet(str(src))
            for f in set(src.glob("part-*")) - seen:
                os.utime(f, (1_700_000_000 + 60 * n,) * 2)
        stream = streams.new_files(spark, str(src), spark.read.parquet(str(src)).schema, 1)
        q = streams.utterance_stream(stream, late="1 hour").writeStream.format("memory").queryName(f"utt{turn}").option("checkpointLocation", str(tmp_path / f"cp{turn}")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert sorted(tuple(r) for r in spark.table(f"utt{turn}").collect()) == want and len(want) > 3
    ev = spark.createDataFrame([(1, "2024-01-01 00:00:01", 1.0), (1, "2024-01-01 00:00:02", 2.0), (1, "2024-01-01 00:00:12", 4.0)], "user_id int, t string, value double").withColumn("ts", F.to_timestamp("t"))
    assert sorted(r["n"] for r in streams.regrid_stream(ev, "user_id").collect()) == [1, 2]
    assert sorted(r["n"] for r in streams.session_stream(ev, "user_id", gap="5 seconds").collect()) == [1, 2]


def test_alignments_take_whole_turns(spark, tmp_path):
    words = [f"word{k}" + "." * (k % 10 == 9) for k in range(120)]
    rows = [(1, 0, "user", " ".join(words)), (1, 1, "user", " ".join(words)), (2, 0, "user", "a b c d"), (2, 1, "user", "a b c d")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    assert {(r["pair_id"], r["path_length"]) for r in run("dtw_align")} == {(100, 120), (200, 4)}
    assert {(r["pair_id"], r["length"]) for r in run("difflib_blocks")} == {(100, 120), (200, 4)}
    pieces = [r for r in run("word_aligned_segments") if r["pair_id"] == 100]
    assert {w for r in pieces for w in r["text"].split()} == set(words) and max(r["end"] for r in pieces) == 36.0


def test_sessions_of_files_out_of_order(spark, tmp_path, monkeypatch):
    rows = [(k % 3, f"2024-01-{day:02d} 00:00:{k:02d}", float(k)) for day in (20, 5, 12) for k in range(10)]
    events = spark.createDataFrame(rows, "user_id long, t string, value double").select("user_id", F.to_timestamp("t").alias("ts"), "value")
    for n, day in enumerate((20, 5, 12)):  # the newest events come first
        seen = set(tmp_path.glob("events.parquet/part-*"))
        events.filter(F.dayofmonth("ts") == day).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        for f in set(tmp_path.glob("events.parquet/part-*")) - seen:
            os.utime(f, (1_700_000_000 + 60 * n,) * 2)
    monkeypatch.setattr(stream_queries, "new_files", functools.partial(streams.new_files, max_files=1))
    got = stream_queries.stream_sessions(spark, str(tmp_path)).collect()
    assert sum(r["n"] for r in got) == 30 and len(got) == 9


def test_names_join_without_a_cap(spark):
    rng = random.Random(5)
    pick = lambda n: ["".join(rng.choices("aB_é", k=rng.randint(0, 7))) for _ in range(n)]
    fold = lambda x: x.replace("_", "").lower()
    names, others = [*pick(60), "long_Name_One", None], [*pick(40), "longnameoneandmore", None]
    for theirs in (others, [x for x in others if x and len(fold(x)) > 3]):
        want = {n: min(hits) for n in names if n is not None and (hits := [o for o in theirs if o is not None and (fold(n) in fold(o) or fold(o) in fold(n))])}
        got = scoring.fuzzy_name_join(spark.createDataFrame([(x,) for x in names], "n string"), spark.createDataFrame([(x,) for x in theirs], "o string"), "n", "o")
        assert {r["n"]: r["o"] for r in got.collect()} == want and got.count() == len(want)
    many = spark.range(100_001).select(F.format_string("File_%07d", "id").alias("o"))
    got = scoring.fuzzy_name_join(many.filter("o like '%0000'").withColumnRenamed("o", "n"), many, "n", "o")
    assert got.filter("n = o").count() == 11


@pytest.mark.parametrize("name", ["pair_segments", "merge_scores_by_position"])
def test_long_conversations_equal_sql(spark, tmp_path, name):
    rows = [(1, k, "user", "x " * (k % 5) + "that this") for k in range(1200)] + [(2, k, "user", "from here that") for k in range(3)]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(path)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    want = duck.execute(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
    keys = list(want.columns)[:3]
    assert len(want) > 1000
    pd.testing.assert_frame_equal(got.sort_values(keys, ignore_index=True), want.sort_values(keys, ignore_index=True), check_dtype=False, atol=1e-9)


def test_similar_words_equal_all_pairs(spark):
    rng = random.Random(11)
    base = ["".join(rng.choices("aektnglro", k=rng.randint(1, 24))) for _ in range(60)]
    words = set(base)
    for w in base:
        for _ in range(6):
            x = list(w)
            for _ in range(rng.randint(1, 4)):
                at = rng.randrange(len(x) + 1)
                x[at : at + rng.randint(0, 1)] = rng.choice(["", "k", "t", "ng", "r", "l"])
            words.add("".join(x))
        words |= {w.replace("k", "t"), w.replace("ng", "n"), w.replace("r", "l")}
    words.discard("")
    df = spark.createDataFrame([(w,) for w in words] + [(None,), (" ",)], "w string")
    for least in (0.8, 0.7):
        want = {(a, b) for a in words for b in words if a != b and round(dtw.similarity(a, b), 6) >= least}
        got = scoring.similar_words(df, "w", least).collect()
        assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_word_distance_of_many_words(spark):
    """Beyond the code points of two bytes, over the surrogates, and on nulls."""
    far = [f"w{k}" for k in range(56_000)]
    short = [["a", "b"], [], ["b", "b", "a"]]
    rows = [(0, far, [far[-2]]), (1, None, ["a"])] + [(2 + k, a, b) for k, (a, b) in enumerate((a, b) for a in short for b in short)]
    df = spark.createDataFrame(rows, "k int, a array<string>, b array<string>")
    got = {r["k"]: r["d"] for r in df.select("k", metrics.word_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert got == {0: 55_999, 1: None} | {k: slow_distance(a, b) for k, a, b in rows[2:]}


def test_merge_of_sides_that_share_a_source(spark, tmp_path):
    """Both sides from one table: the columns of one must not be taken for the other's."""
    rng = random.Random(6)
    rows = [(s, k, 10.0 * k, 10.0 * k + 10, "x " * rng.randint(0, 9) + rng.choice(["fono", "meeting"]) + " y" * rng.randint(0, 9), rng.choice(["mms", "whisper_en"])) for s in range(12) for k in range(30)]
    spark.createDataFrame(rows, "audio_stem long, chunk_idx int, start double, end double, text string, source string").write.parquet(str(tmp_path / "c"))
    c = spark.read.parquet(str(tmp_path / "c"))
    left, right = (anchors.anchor_hits(c.filter(F.col("source") == s), [w], s) for s, w in (("mms", "fono"), ("whisper_en", "meeting")))
    got = anchors.merge_anchors(left, right, 25.0, {"fono": "meeting"}).select("audio_stem", "time", "source")
    want = []
    for stem in range(12):
        a, b = ([r["time"] for r in df.filter(F.col("audio_stem") == stem).orderBy("chunk_idx").collect()] for df in (left, right))
        used = set()
        for t in a:
            hit = next((k for k, u in enumerate(b) if k not in used and abs(u - t) <= 25), None)
            used.add(hit)
            want.append((stem, t if hit is None else (t + b[hit]) / 2, "mms" if hit is None else "both"))
        want += [(stem, u, "whisper_en") for k, u in enumerate(b) if k not in used]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_positions_over_ranges(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), k if k % 11 else None, k) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, at int, v long").repartition(7)
    got = ranking.positions(df, ["g"], ["at", "v"], "pos").collect()
    for g in ("hot", "b", None):
        mine = sorted((r["pos"], r["at"] is not None, r["at"] or 0, r["v"]) for r in got if r["g"] == g)
        assert [m[0] for m in mine] == list(range(len(mine))) and [m[1:] for m in mine] == sorted(m[1:] for m in mine)
    total = ranking.running_total(df, [], ["v"], F.col("v"), "sum").orderBy("v").collect()
    assert [r["sum"] for r in total] == [k * (k - 1) // 2 for k in range(900)]
    assert ranking.positions(df.limit(0), [], ["v"], "pos").count() == 0


def test_band_candidates_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(sequences, "CELL", 16)
    rng = random.Random(4)
    words = [(s, rng.choice("abcxyz"), k) for s in ("s", "t") for k in range(400)] + [("s", "rare", 5), ("s", "rare", 390)]
    pos = spark.createDataFrame(words, "session string, word string, word_idx long")
    ask = [(f"f{k % 5}", k, rng.choice(["s", "t"]), rng.choice(["a", "b", "rare", "none"]), lo, lo + rng.choice([0, 3, 90])) for k, lo in enumerate(rng.choices(range(-20, 420), k=120))]
    df = spark.createDataFrame(ask, "audio_stem string, anchor_idx int, session string, word string, hint_start long, hint_end long")
    blocks = sequences.posting_blocks(pos, [*"abcxyz", "rare"], "session")
    assert {tuple(r) for r in sequences.posted_positions(blocks, "session").collect()} == set(words)
    assert blocks.filter(F.size("offsets") > 16).isEmpty()
    got = {(r["anchor_idx"], r["place"], r["word_idx"]) for r in sequences.band_candidates(df, blocks, "session").collect()}
    want = set()
    for _, k, s, w, lo, hi in ask:
        all_ = sorted(i for t, x, i in words if t == s and x == w)
        inside = [i for i in all_ if lo <= i <= hi]
        picked = inside or sorted(all_, key=lambda i: (min(abs(i - lo), abs(i - hi)), i))[:3]
        want |= {(k, p, i) for p, i in enumerate(picked, 1)}
    assert got == want


def test_benchmark_sample_and_model_fallback(spark, tmp_path):
    (tmp_path / "reference.txt").write_text("te fānau\n")
    got = sources.benchmark_sample(spark, str(tmp_path / "absent.json"), str(tmp_path / "reference.txt")).first()
    assert (got["system4"], got["system6"]) == ("te fānau\n".strip(), "te fanau")
    (tmp_path / "m.json").write_text(json.dumps({"title": "t", "reference_text": {"system4": "ā", "system6": None}}))
    got = sources.benchmark_sample(spark, str(tmp_path / "m.json"), str(tmp_path / "reference.txt")).first()
    assert (got["system4"], got["system6"]) == ("ā", "te fanau")

    def tuned():
        raise FileNotFoundError("no adapter")

    def base():
        return lambda xs: [f"{len(x)}" if len(x) else "" for x in xs]

    audio = spark.createDataFrame([("a", [0.1] * 25), ("b", [0.2] * 4)], "audio_stem string, samples array<float>")
    heard = asr.transcribe_chunked(audio, asr.with_fallback(tuned, base), size=1.0, rate=10)
    assert {r["audio_stem"]: r["text"] for r in heard.collect()} == {"a": "10 10 5", "b": "4"}


def test_blocks_with_times_and_null_arrays(spark):
    word = "array<struct<word:string,start:double,end:double>>"
    rows = [(1, list("abcxyz"), [(w, k * 0.1, k * 0.1 + 0.1) for k, w in enumerate("abcq")] + [("x", 5.0, 6.0), ("y", 6.0, 7.0), ("z", 7.0, 7.5)]), (2, None, None), (3, ["a"], None)]
    df = spark.createDataFrame(rows, f"k int, official array<string>, heard {word}")
    got = [tuple(r) for r in dtw.timed_blocks(df, "k", "official", "heard").collect()]
    assert got == [(1, 0, 3, 3, "x y z", 5.0, 7.5)]
    plain = df.select("k", "official", F.transform("heard", lambda h: h["word"]).alias("heard"))
    assert {r["k"]: r["score"] for r in dtw.dtw_align(plain, "k", "heard", "official").collect()}[2] == 0.0
    assert {r["k"] for r in dtw.block_align(plain, "k", "official", "heard").collect()} == {1}
    spans = df.select("k", F.lit("s").alias("session"), F.lit(0.0).alias("start"), F.lit(9.0).alias("end"), "heard", F.col("official").alias("written")).withColumnRenamed("k", "pair_id")
    assert {r["pair_id"] for r in dtw.word_segments(spans).collect()} <= {1}
