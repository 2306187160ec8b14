"""Every registered query with SQL against DuckDB, on small tables made from the test data."""

from __future__ import annotations

import os
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from speechmart.operators import dtw
from speechmart.queries import catalog
from tests.test_folds import whole_table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if v is None or (isinstance(v, (float, np.floating)) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    return float(v) if isinstance(v, (int, float, np.integer, np.floating)) else v


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(str([plain(v) for v in r]) for r in pdf[cols].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = rows(catalog.queries()[name](spark, SF_DIR).toPandas())
    assert got == rows(duck.execute(catalog.oracle_sql()[name]).df())


def test_queries_without_sql(spark):
    """Only alignments that SQL cannot express: their rows against the operators run row by row (``forced_alignment`` has tests of its own)."""
    assert set(catalog.queries()) - set(catalog.oracle_sql()) <= {"dtw_align", "word_aligned_segments", "difflib_blocks", "forced_alignment"}
    turns = {(r["conv_id"], r["turn"]): r["text"].split() for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect()}
    pairs = {c * 100 + t: (turns[c, t], turns[c, t + 1]) for c, t in turns if (c, t + 1) in turns}
    got = {r["pair_id"]: (r["score"], r["path_length"]) for r in catalog.queries()["dtw_align"](spark, SF_DIR).collect()}
    assert got.keys() == pairs.keys()
    for k, (heard, written) in pairs.items():
        path, score = dtw.warp(heard, written)
        assert got[k][1] == len(path) and got[k][0] == pytest.approx(score, abs=1e-6)
        if len(heard) * len(written) < 2500:
            assert path == whole_table(heard, written)
    cut = defaultdict(list)
    for r in catalog.queries()["word_aligned_segments"](spark, SF_DIR).collect():
        cut[r["pair_id"]].append((r["piece"], r["text"]))
    for k, (heard, written) in pairs.items():
        end = max(12.0, 0.3 * len(heard))
        step = end / max(1, len(heard))
        timed = [(w, i * step, (i + 1) * step) for i, w in enumerate(heard)]
        assert sorted(cut[k]) == [(n, p[2]) for n, p in enumerate(dtw.cut_segments(timed, written, 0.0, end))]
    runs = defaultdict(list)
    for r in catalog.queries()["difflib_blocks"](spark, SF_DIR).collect():
        runs[r["pair_id"]].append((r["official_start"], r["heard_start"], r["length"]))
    for k, (heard, written) in pairs.items():
        assert sorted(runs[k]) == sorted(dtw.blocks(written, heard))
        assert all(written[a : a + n] == heard[b : b + n] and n >= 3 for a, b, n in runs[k])
