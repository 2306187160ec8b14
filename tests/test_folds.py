"""Folds, islands, bands and bit vectors against the plain loops they replace."""

from __future__ import annotations

import random
import time
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from speechmart.functions.distance import edit_distance
from speechmart.operators import anchors, chunks, dtw, ranking, segments


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=90), st.lists(st.sampled_from("abcd"), max_size=90))
def test_edit_distance(a, b):
    assert edit_distance(a, b) == slow_distance(a, b)


def test_edit_distance_of_long_turns():
    rng = random.Random(1)
    a = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    b = list(a)
    for _ in range(50):
        b[rng.randrange(len(b))] = "changed"
    began = time.process_time()
    assert 40 <= edit_distance(a, b) <= 50 and time.process_time() - began < 5


def whole_table(a, b, ratio=0.3):
    """The path over the full table, step by step from its definition."""
    n, m = len(a), len(b)
    band = max(3, int(max(n, m) * ratio))
    inf = float("inf")
    cost = [[inf] * (m + 1) for _ in range(n + 1)]
    cost[0][0] = 0.0
    for i in range(1, n + 1):
        c = int((i - 1) * m / n)
        for j in range(max(1, c - band), min(m, c + band) + 1):
            cost[i][j] = 1 - dtw.similarity(a[i - 1], b[j - 1]) + min(cost[i - 1][j], cost[i][j - 1], cost[i - 1][j - 1])
    path, i, j = [], n, m
    while i > 0 and j > 0:
        path.append((i - 1, j - 1))
        ways = [(i - 1, j - 1), (i - 1, j), (i, j - 1)]
        i, j = ways[int(np.argmin([cost[x][y] for x, y in ways]))]
    return path[::-1]


@pytest.mark.parametrize("at_once", [0, 1 << 20])
@pytest.mark.parametrize("ratio", [0.3, 0.1, 0.02])
def test_band_equals_the_whole_table(ratio, at_once, monkeypatch):
    monkeypatch.setattr(dtw, "STEPS_AT_ONCE", at_once)
    rng = random.Random(8)
    words = ["te", "fono", "palamene", "katoa", "tatoa", "lima", "rima", "ng", "n", "", "Te "]
    for n, m in [(1, 1), (1, 40), (40, 1), (2, 90), (90, 2), (3, 200), (60, 61), (35, 120), (150, 20)] + [(rng.randint(1, 30), rng.randint(1, 30)) for _ in range(60)]:
        a, b = rng.choices(words, k=n), rng.choices(words, k=m)
        path, score = dtw.warp(a, b, ratio)
        want = whole_table(a, b, ratio)
        assert path == want and score == pytest.approx(sum(dtw.similarity(a[x], b[y]) for x, y in want) / len(want))


def test_band_of_long_turns_in_little_memory():
    rng = random.Random(9)
    known = ["".join(rng.choices("aeioukltngmpf", k=rng.randint(2, 8))) for _ in range(400)]
    a = rng.choices(known, k=20_000)
    b = [w for w in a if rng.random() > 0.02]
    tracemalloc.start()
    path, score = dtw.warp(a, b, 0.03)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert score > 0.95 and path[-1] == (len(a) - 1, len(b) - 1) and peak < 300e6


def naive_merge(left, right, tolerance, partners):
    used, out = set(), []
    for word, t in left:
        hit = next((k for k, (w, u) in enumerate(right) if k not in used and (w == word or w in partners.get(word, ())) and abs(t - u) <= tolerance), None)
        used.add(hit)
        out.append(hit)
    return out


def test_first_fit_equals_scan():
    rng = random.Random(2)
    partners = {"a": {"x"}, "x": {"a", "b"}, "b": {"x"}}
    for _ in range(200):
        left, right = ([(rng.choice("abxyq"), rng.choice([rng.randint(0, 20) / 2, rng.random() * 10])) for _ in range(rng.randint(0, 40))] for _ in range(2))
        assert anchors.first_fit(left, right, 1.5, partners) == naive_merge(left, right, 1.5, partners)


def test_merge_of_one_long_file(spark):
    """200000 hits of two tied words, closer than the tolerance all along: one island."""
    hit = "audio_stem string, chunk_idx int, keyword_idx int, offset int, word string, time double, chunk_text string"
    side = lambda word, shift: spark.range(100_000).select(F.lit("f").alias("audio_stem"), (F.col("id") / 10).cast("int").alias("chunk_idx"), F.lit(0).alias("keyword_idx"), (F.col("id") % 10).cast("int").alias("offset"), F.lit(word).alias("word"), (F.col("id") + shift).cast("double").alias("time"), F.lit("t").alias("chunk_text"))
    left, right = side("fono", 0.0), side("meeting", 0.25)
    assert left.schema.simpleString() == spark.createDataFrame([], hit).schema.simpleString()
    began = time.time()
    got = anchors.merge_anchors(left, right, 2.0, {"fono": "meeting"}).groupBy("source").agg(F.count("*").alias("n"), F.max("anchor_idx").alias("last")).collect()
    assert {(r["source"], r["n"], r["last"]) for r in got} == {("both", 100_000, 99_999)}
    assert time.time() - began < 120


def test_merge_equals_scan_over_files(spark):
    rng = random.Random(3)
    make = lambda words: [(rng.choice(["f", "g", None]), rng.randint(0, 9), k, rng.randint(0, 50), rng.choice(words), rng.choice([None, rng.random() * 60, float(rng.randint(0, 60))]), f"t{k}") for k in range(250)]
    a, b = make(["one", "two", "three"]), make(["uno", "dos", "one", "four"])
    schema = "audio_stem string, chunk_idx int, keyword_idx int, offset int, word string, time double, chunk_text string"
    equal = {"one": "uno", "two": "dos", "three": "uno"}
    partners = {}
    for x, y in equal.items():
        partners.setdefault(x, set()).add(y)
        partners.setdefault(y, set()).add(x)
    got = anchors.merge_anchors(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 2.0, equal).collect()
    want = []
    for f in ("f", "g", None):
        l, r = (sorted((x for x in side if x[0] == f), key=lambda x: x[1:4]) for side in (a, b))
        time_of = lambda x: float("nan") if x is None else x
        hits = naive_merge([(x[4], time_of(x[5])) for x in l], [(x[4], time_of(x[5])) for x in r], 2.0, partners)
        want += [(f, x[4], x[5], "mms") if h is None else (f, x[4], (x[5] + r[h][5]) / 2, "both") for x, h in zip(l, hits, strict=True)]
        want += [(f, x[4], x[5], "whisper_en") for k, x in enumerate(r) if k not in hits]
    clean = lambda rows: sorted(str((f, w, None if t is None or t != t else round(t, 9), s)) for f, w, t, s in rows)
    assert clean((r["audio_stem"], r["word"], r["time"], r["source"]) for r in got) == clean(want)


def utterances_by_loop(rows, gap, limit, least):
    out, group = [], []
    for r in sorted(rows):
        if group and (r[0] - group[-1][1] > gap or r[1] - group[0][0] > limit):
            out.append(group)
            group = []
        group.append(r)
    out.append(group)
    return sorted((" ".join(r[2] for r in g), g[0][0], g[-1][1], len(g)) for g in out if len(g) >= least and len(rows) >= 3)


def test_utterances_equal_the_loop(spark):
    rng = random.Random(4)
    files = {}
    for f in ("steady", "gaps", "long words", "overlap", None):
        at, rows = 0.0, []
        for k in range(400):
            at += rng.choice([0.25, 0.5, 3.0 if f == "gaps" else 0.25])
            rows.append((at, at + (rng.choice([30.0, 0.25]) if f == "long words" and k % 9 == 0 else rng.choice([0.25, 5.0 if f == "overlap" else 0.5])), f"w{k}"))
        files[f] = rows
    data = [(f, s, e, -1.0, w) for f, rows in files.items() for s, e, w in rows]
    df = spark.createDataFrame(data, "audio_path string, start double, end double, score double, word string").repartition(5)
    for at_least in (3, 1):
        got = {}
        for r in segments.utterances(df, at_least=at_least).collect():
            got.setdefault(r["audio_path"], []).append((r["text"], r["start"], r["end"], r["word_count"]))
        assert {f: sorted(v) for f, v in got.items()} == {f: utterances_by_loop(rows, 0.5, 20.0, at_least) for f, rows in files.items()}
    assert segments.utterances(df.limit(0)).count() == 0


def test_split_runs_equal_the_loop(spark):
    rng = random.Random(5)
    data = []
    for block in range(6):
        at, path = 0.0, "a"
        for pos in range(120):
            at += rng.choice([0.2, 0.4, 0.9]) if block else 0.3
            if block and rng.random() < 0.03:
                path, at = rng.choice("abc"), 0.0
            data.append((block, pos, path, at, at + 0.2, f"w{pos}"))
    got = {}
    for r in segments.split_runs(spark.createDataFrame(data, "block int, pos int, audio_path string, start double, end double, word string")).collect():
        got.setdefault(r["block"], []).append((r["piece"], r["audio_path"], r["text"], r["start"], r["end"]))
    for block in range(6):
        out, group = [], []
        for _, _, path, s, e, w in (d for d in data if d[0] == block):
            if group and (s - group[-1][2] > 0.5 or e - group[0][1] > 20.0 or path != group[0][0]):
                out.append(group)
                group = []
            group.append((path, s, e, w))
        out.append(group)
        assert sorted(got[block]) == [(n, g[0][0], " ".join(x[3] for x in g), g[0][1], g[-1][2]) for n, g in enumerate(out)]


def chunks_by_loop(rows, size):
    out, now = [], None
    for start, end, text in sorted(rows, key=lambda r: (r[0], r[1], (r[2] or "").strip())):
        text = (text or "").strip()
        if now is None or not now[2]:
            now = [start, end, text]
        elif start - now[0] < size:
            now = [now[0], end, f"{now[2]} {text}"]
        else:
            out.append(now)
            now = [start, end, text]
    return sorted((s, e, t) for s, e, t in [*out, now] if t.strip())


def test_accumulated_chunks_equal_the_loop(spark):
    rng = random.Random(6)
    files = {}
    for f in ("dense", "sparse", "blank", None):
        at, rows = 0.0, []
        for k in range(300):
            at += rng.choice([0.5, 2.5, 25.0 if f == "sparse" else 1.0])
            rows.append((at, at + 1.5, rng.choice([f"t{k}", " ", None, ""]) if f == "blank" else f" t{k} "))
        files[f] = rows
    data = [(f, *r) for f, rows in files.items() for r in rows]
    df = spark.createDataFrame(data, "audio_stem string, start double, end double, text string").repartition(4)
    got = {}
    for r in chunks.accumulate_chunks(df, 10.0).collect():
        got.setdefault(r["audio_stem"], []).append((r["start"], r["end"], r["text"]))
    assert {f: sorted(v) for f, v in got.items()} == {f: chunks_by_loop(rows, 10.0) for f, rows in files.items()}


def test_running_values_and_runs(spark):
    rng = random.Random(7)
    data = [(rng.choice(["hot", "hot", "b", None]), k, rng.choice([None, rng.randint(0, 99)])) for k in range(700)]
    df = spark.createDataFrame(data, "g string, at int, v int").repartition(6)
    got = ranking.running(df, ["g"], ["at"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("last", F.col("v"))}).collect()
    runs = {(r["g"], r["at"]): r["run"] for r in ranking.numbered_runs(df, ["g"], ["at"], ["at"], lambda own, before: own("at") - before("at") > 3, "run").collect()}
    for g in ("hot", "b", None):
        total, most, last, before, run = 0, None, None, None, 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["at"]):
            if r["v"] is not None:
                total, most, last = total + r["v"], max(r["v"], most if most is not None else r["v"]), r["v"]
            assert (r["s"], r["m"], r["l"]) == (total, most, last)
            run += before is None or r["at"] - before > 3
            before = r["at"]
            assert runs[g, r["at"]] == run
