"""files pass a task one after the other; none is a pandas group of its own."""

from __future__ import annotations

import math
import random

from speechmart.operators import sequences


def test_sequences_of_many_small_files(spark):
    rng = random.Random(3)
    rows = []
    for stem in [None, *range(60)]:
        for anchor in range(rng.randint(1, 12)):
            time = rng.choice([None, float("nan"), *[float(rng.randint(0, 9)) for _ in range(8)]])
            rows += [(stem, anchor, place, f"w{anchor}", time, rng.randint(0, 40), 0.5) for place in range(1, rng.randint(2, 4))]
    table = spark.createDataFrame(rows, "audio_stem long, anchor_idx int, place int, word string, time double, word_idx long, confidence double")
    for once in (False, True):
        want = []
        for stem in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == stem]
            untimed = {id(r): r[4] is None or math.isnan(r[4]) for r in own}
            own.sort(key=lambda r: (untimed[id(r)], 0.0 if untimed[id(r)] else r[4], r[1], -r[5] if once else r[2]))
            at = sequences.increasing([r[5] for r in own])
            want += [(stem, pos, own[i][3], own[i][5]) for pos, i in enumerate(at)] if len(at) >= sequences.LEAST_LENGTH else []
        got = sequences.matched_sequences(table.repartition(3), distinct_anchors=once)
        assert "FlatMapGroups" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert got.filter("time is null or isnan(time) or time between 0 and 9").count() == len(want)
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted(map(tuple, got.select("audio_stem", "pos", "word", "word_idx").collect()), key=key) == sorted(want, key=key)
        assert len({w[0] for w in want}) > 10
