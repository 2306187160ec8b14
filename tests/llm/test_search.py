from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from speechmart.llm import topk


def brute(rows, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in ok if i % 20 == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(i, [1.0] * 6) for i in range(150, 230)]  # ties
    rows += [(i, [float(x) for x in range(6)]) for i in (300, 301, 301)]
    rows += [(400, None), (401, [1.0, None] + [0.0] * 4), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [9.0] * 6)]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20).collect()}
    assert got == brute(rows, 20)


def test_fewer_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, 20).orderBy("rank").collect()] == [(0, 1, 1, 128 * 64), (0, 2, 2, -64 * 64)]
    assert topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert topk.top_k(df, F.col("vec_id") == 99).count() == 0


def test_large_components_stay_exact():
    q, c = np.array([[2.0**40, 3.0]]), np.array([[2.0**40, 1.0], [2.0**40, 2.0]])
    scores = topk.Lists(q, c, 2)
    assert [int(x) for x in scores.whole(0)[0] + scores.whole(1)[0]] == [2**80 + 3, 2**80 + 6]
    cut = {7: (2**80 + 6, [2**80, 3])}
    assert topk._best_of(np.array([7]), np.array([8, 9]), scores, cut, 1, 2) == [(7, 9, 2**63 - 1)]


def test_phase_three_resolves_few_entries():
    rng = np.random.default_rng(5)
    heavy = rng.random(64) ** 4  # a few dimensions hold most of every score
    q, c = np.floor(64 * rng.normal(size=(16, 64)) * heavy), np.floor(64 * rng.normal(size=(3000, 64)) * heavy)
    for vectors, share in ((q, 0.25), (np.floor(20 * rng.normal(size=(16, 64))), 0.25)):
        scores = topk.Lists(vectors, c, 2)
        total = vectors @ c.T
        cutoff = np.sort(total, axis=1)[:, -20]
        least = np.stack([scores.whole(j).min(axis=1) for j in range(2)], axis=1)
        i, j, known, seen = topk.collected(scores, cutoff, least, np.ones(total.shape, bool), 2)
        found = set(zip(i.tolist(), j.tolist()))
        assert len(found) < share * total.size
        assert all((a, b) in found for a, b in zip(*np.nonzero(total >= cutoff[:, None])))
        assert np.array_equal(topk.resolved(scores, i, j, known, seen), total[i, j])
        # entries seen in one list only had their other part computed
        assert 0 < (~seen).sum() < len(i) * 2


def test_blocks_stay_bounded_with_many_small_partitions(spark):
    df = spark.range(4000).select(F.col("id"), F.array(F.lit(1.0)).alias("v")).repartition(64)
    sizes = [r["n"] for r in topk._blocks(df, F.monotonically_increasing_id(), 100, "test")[0].select((F.length("ids") / 8).alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 160


def test_clashing_columns_and_repeated_query_ids(spark):
    rows = [(20, [1.0, 2.0]), (20, [3.0, 1.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [-1.0, 5.0])]
    df = spark.createDataFrame([(*r, 1, b"x", 2, 3) for r in rows], "vec_id long, embedding array<double>, block int, ids binary, salt int, rank int")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 20).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 4 * 4096), (20, 2, 1, 4 * 4096), (20, 3, 2, 2 * 4096)]
