"""Posting lists: recall against brute force, exact scores, odd rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from speechmart.llm import balanced_postings as B
from speechmart.llm.queries import op12_balanced_postings

SCHEMA = "vec_id long, embedding array<double>"


def brute(ids, x, queries, k=20):
    out = {}
    for q in queries:
        s = (x * x[q]).sum(axis=1)
        order = [int(e) for e in np.lexsort((ids, -s)) if ids[e] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[e]), float(s[e])) for e in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["vec_id"], r["score"]))
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def test_registered_query_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = found(op12_balanced_postings(spark, "/root/testdata/sf0.1"))
    want = brute(ids, x, np.flatnonzero(ids % 20 == 0))
    assert recall(got, want) >= 0.95
    place = {int(i): n for n, i in enumerate(ids)}
    for q, hits in got.items():
        assert len(hits) == 20 and q not in {i for i, _ in hits}
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0]))
        assert [s for _, s in hits] == pytest.approx([float(x[place[i]] @ x[place[q]]) for i, _ in hits], abs=1e-12)


@pytest.mark.parametrize("kind", ["plain", "clustered", "norms"])
def test_recall_over_many_lists(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12_000, 24))
    if kind == "clustered":
        x = rng.normal(size=(60, 24))[rng.integers(60, size=len(x))] + 0.2 * x
    if kind == "norms":
        x *= rng.lognormal(0, 0.4, size=(len(x), 1))
    df = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], SCHEMA)
    got = found(B.nearest(df, F.col("vec_id") % 100 == 0))
    assert recall(got, brute(np.arange(len(x)), x, range(0, len(x), 100))) >= 0.9


def test_lists_are_balanced_and_boundaries_replicated():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(6000, 16)), 0.01 * rng.normal(size=(2000, 16)) + 3])
    index = B.Index(x, len(x), 1.0, float((x * x).sum(axis=1).max()))
    import pandas as pd

    rows, lists = index.post(pd.Series(list(x)))
    assert set(rows) == set(range(len(x)))
    assert np.bincount(rows).max() <= B.REPLICAS and len(rows) > len(x)
    d = B._squared(B._lifted(x, 1.0, index.reach, False), index.centroids)
    sizes = np.bincount(d.argmin(axis=1), minlength=len(index.centroids))
    assert sizes.max() <= 8 * B.LIST


def test_graph_finds_what_a_scan_finds():
    rng = np.random.default_rng(6)
    c = np.concatenate([rng.normal(size=(300, 8)), rng.normal(size=(40, 8)) + 50])  # two far parts
    graph = B.CentroidGraph(c)
    for q in np.concatenate([rng.normal(size=(30, 8)), rng.normal(size=(10, 8)) + 50]):
        d = np.sqrt(((c - q) ** 2).sum(axis=1))
        want = set(np.flatnonzero(d <= d.min() * 1.12))
        assert len(want & set(graph.within(q, 1.12))) >= 0.95 * len(want)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [(20, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [0.5]), (40, [0.0, -2.0]), (20, [0.5, 0.0])]
    odd = [(4, None), (5, [None, 1.0]), (6, [nan]), (7, [inf, 1.0]), (8, []), (9, [0.0, 0.0]), (None, [1.0, 1.0]), (60, [0.0])]
    df = spark.createDataFrame(good + odd, SCHEMA)
    wide = df.withColumns({c: F.lit(1) for c in ("id", "v", "key", "list", "block", "_q", "score", "rank", "blocks")})
    got = found(B.nearest(wide, F.col("vec_id") % 20 == 0))
    assert got == {20: [(1, 1.0), (2, 1.0), (2, 1.0), (3, 0.5), (40, 0.0)], 40: [(3, 0.0), (20, 0.0), (20, 0.0), (1, -2.0), (2, -2.0), (2, -2.0)]}
    assert B.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert B.nearest(df.filter("vec_id % 20 <> 0"), F.col("vec_id") % 20 == 0).count() == 0


def test_one_common_vector(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([np.tile(rng.normal(size=8), (3000, 1)), rng.normal(size=(1000, 8))])
    df = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(x)], SCHEMA)
    got = found(B.nearest(df, F.col("vec_id") % 500 == 0))
    want = brute(np.arange(len(x)), x, range(0, len(x), 500))
    assert recall(got, want) >= 0.9
    copies = [i for i, s in got[0] if abs(s - float(x[0] @ x[0])) < 1e-9]  # equal ones in order of their ids, but the query
    assert copies == list(range(1, len(copies) + 1))


def test_best_rows_of_a_task_with_little_room():
    rng = np.random.default_rng(8)
    q, v = rng.normal(size=(6, 5)), rng.normal(size=(300, 5))
    q_ids, ids = np.arange(6), np.arange(300)
    best, parts = B.Best(4, room=20), []
    for at in range(0, 300, 25):
        for again in range(2):  # a row may stand in two lists
            best.meet(q_ids, q, ids[at : at + 25], ids[at : at + 25], v[at : at + 25])
            if best.full():
                parts.append(best.reduce())
                best.clear()
    parts.append(best.reduce())
    import pandas as pd

    got = pd.concat(parts).drop_duplicates(["query_id", "key"]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(4)
    scores = (v[None] * q[:, None]).sum(axis=2)
    want = [(int(i), int(e)) for i in range(6) for e in [e for e in np.lexsort((ids, -scores[i])) if e != i][:4]]
    assert list(zip(got["query_id"], got["vec_id"], strict=True)) == want


def test_rows_of_many_lists_are_handed_on_in_parts():
    """A row that goes to all of many lists makes batches of bounded size (F1)."""
    pdf = pd.DataFrame({"key": range(40), "id": range(40), "v": [np.zeros(2)] * 40})
    blocks = np.full(3000, 7)
    everywhere = lambda v: (np.repeat(np.arange(len(v)), 3000), np.tile(np.arange(3000), len(v)))
    out = list(B._dealt(everywhere, blocks)(iter([pdf])))
    assert max(map(len, out)) <= 8192 and sum(map(len, out)) == 40 * 3000
    whole = pd.concat(out)
    assert set(zip(whole["key"], whole["list"], strict=True)) == {(k, n) for k in range(40) for n in range(3000)}
    assert (whole["block"] == whole["key"] % 7).all()


def test_packed_queries_are_not_broadcast(spark):
    """However small Spark takes the queries' postings to be, they are not gathered in the driver (F1)."""
    df = spark.createDataFrame([(n, [float(n), 1.0]) for n in range(60)], SCHEMA)
    plan = B.nearest(df, F.col("vec_id") % 20 == 0)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_fitting_holds_few_distances(monkeypatch):
    """Many lists make no larger blocks of distances in the driver (F1)."""
    sizes = []
    monkeypatch.setattr(B, "_squared", lambda a, b, f=B._squared: (sizes.append(len(a) * len(b)), f(a, b))[1])
    monkeypatch.setattr(B, "DISTANCES", 1 << 14)
    points = np.random.default_rng(9).normal(size=(600, 4))
    B.CentroidGraph(B.fit_centroids(points, 300))
    assert max(sizes) <= 1 << 14
