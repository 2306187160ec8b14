"""Forced alignment against all paths, the full table, and its registered query."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechmart.operators import ctc
from speechmart.queries import adapters, catalog


def collapsed(path, blank=0):
    return [k for k, _ in itertools.groupby(path) if k != blank]


def all_paths(lines, labels):
    """The best score of all frame labellings that collapse to the labels."""
    best = None
    for path in itertools.product(range(lines.shape[1]), repeat=len(lines)):
        if collapsed(path) == labels:
            score = sum(lines[t, k] for t, k in enumerate(path))
            best = score if best is None else max(best, score)
    return best


def full_table(lines, labels, blank=0):
    """The same by the whole table."""
    ids = [blank]
    for k in labels:
        ids += [k, blank]
    at = [lines[0, ids[s]] if s < 2 else -np.inf for s in range(len(ids))]
    for line in lines[1:]:
        at = [max(at[s], at[s - 1] if s else -np.inf, at[s - 2] if s > 1 and s % 2 and ids[s] != ids[s - 2] else -np.inf) + line[ids[s]] for s in range(len(ids))]
    return max(at[-2:])


def emissions(rng, frames, kinds):
    x = rng.normal(size=(frames, kinds)) * 2
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def test_equals_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(150):
        lines, labels = emissions(rng, int(rng.integers(1, 7)), 3), [int(k) for k in rng.integers(1, 3, rng.integers(0, 4))]
        got, want = ctc.forced_frames(lines, labels), all_paths(lines, labels)
        assert (got is None) == (want is None)
        if got is not None:
            assert collapsed(got[0].tolist()) == labels and got[1].sum() == pytest.approx(want)


@pytest.mark.parametrize("cells", [1, 40, 900, 1 << 22])
def test_cut_tables_equal_the_full_table(cells):
    rng = np.random.default_rng(2)
    for frames, n in ((120, 30), (90, 44), (64, 0), (33, 16), (200, 3)):
        lines, labels = emissions(rng, frames, 6), [int(k) for k in rng.integers(1, 6, n)]
        ids = np.zeros(2 * n + 1, int)
        ids[1::2] = labels
        path, whole = ctc.viterbi_states(lines, ids, cells), ctc.viterbi_states(lines, ids)
        if whole is None:
            assert path is None
            continue
        assert path.tolist() == whole.tolist()
        assert lines[np.arange(frames), ids[path]].sum() == pytest.approx(full_table(lines, labels))


def test_long_file_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    lines, labels = emissions(rng, 6000, 5), [int(k) for k in rng.integers(1, 5, 2500)]
    tracemalloc.start()
    path, _ = ctc.forced_frames(lines, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert collapsed(path.tolist()) == labels and peak < 24_000_000  # the whole table would hold 30 MB of steps alone


def test_words_of_clips(spark):
    vocab = {"a": 1, "p": 2, "|": 3}
    target = "00113220|"  # a word "a" over frames 2-3, a separator, a word "p"

    def make():
        table = np.log(np.full((8, 4), 0.01) + np.eye(4)[[int(c) for c in target[:8]]])
        return lambda xs: [table for _ in xs]

    rows = [("x", [1.0], "A b"), ("few", [1.0], "a"), ("long", [1.0], "a a a a a a a"), ("none", None, "a b"), ("null", [1.0], None)]
    clips = spark.createDataFrame(rows, "audio_path string, samples array<float>, text string").withColumn("labels", ctc.label_ids(F.col("text"), vocab))
    got = ctc.forced_words(ctc.forced_align(clips, make), clips, 3).orderBy("audio_path", "word_idx").collect()
    # b is folded to p; blanks before a word belong to it, as do those behind it
    assert [(r["audio_path"], r["word_idx"], r["word"], r["start"], r["end"]) for r in got] == [("x", 0, "a", 0.0, 0.08), ("x", 1, "b", 0.1, 0.16)]


def test_registered_query(spark):
    """Every turn's frames are labelled, spell the turn's letters and score what the whole table gives."""
    d = "/root/testdata/sf0.001"
    clips = adapters.spelled_clips(spark, d).collect()
    got = {}
    for r in catalog.queries()["forced_alignment"](spark, d).collect():
        got.setdefault(r["clip"], []).append(r)
    emit = adapters.spelling_model()
    checked = 0
    for r in clips:
        if r["labels"] is None or len(r["labels"]) < 3:
            assert r["clip"] not in got
            continue
        words = sorted(got[r["clip"]], key=lambda w: w["word_idx"])
        assert [w["word"] for w in words] == r["text"].lower().split()[: len(words)]
        if len(r["labels"]) < 150:
            lines = np.asarray(emit([np.asarray(r["samples"], np.float32)])[0], float)
            path, scores = ctc.forced_frames(lines, list(r["labels"]))
            assert collapsed(path.tolist()) == list(r["labels"]) and scores.sum() == pytest.approx(full_table(lines, list(r["labels"])))
            spans, at = [], None
            for t, k in enumerate(path.tolist()):
                if k == adapters.SPELLING["|"]:
                    at = None
                elif at is None:
                    at = [t, t + 1]
                    spans.append(at)
                else:
                    at[1] = t + 1
            assert [(round(w["start"] * 50), round(w["end"] * 50)) for w in words] == [tuple(x) for x in spans[: len(words)]]
            checked += 1
    assert checked > 10


def test_windows_give_the_whole_tables_path():
    """a path is proven in its window or left open, never another one."""
    rng, emit = np.random.default_rng(8), adapters.spelling_model()
    texts = [rng.integers(1, 38, int(n)).astype(np.float32) for n in rng.integers(1, 160, 30)] + [np.full(40, 5, np.float32)]
    clips = [(np.asarray(x, float), [int(k) for k in ids]) for x, ids in zip(emit(texts), texts, strict=True)]
    clips += [(np.round(emissions(rng, f, 5)), [int(k) for k in rng.integers(1, 5, n)]) for f, n in ((1, 0), (1, 1), (2, 2), (50, 20), (30, 29), (8, 8), (5, 9))]
    ids = [ctc._interleaved(labels, 0) for _, labels in clips]
    proven = 0
    for (lines, _), own, path in zip(clips, ids, ctc.windowed_states([(c[0], i) for c, i in zip(clips, ids, strict=True)], 32), strict=True):
        if path is not None:
            assert path.tolist() == ctc.viterbi_states(lines, own).tolist()
            proven += 1
    assert proven >= 31
    for got, (lines, labels) in zip(ctc.forced_clips(clips), clips, strict=True):
        want = ctc.forced_frames(lines, labels)
        assert (got is None) == (want is None) and (got is None or (got[0].tolist() == want[0].tolist() and got[1].tolist() == want[1].tolist()))
