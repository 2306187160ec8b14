"""The Merkle manifest against a plain recursion, and its odd cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from speechmart.llm import merkle
from speechmart.llm.queries import op11_block_manifest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """The top, and for every leaf its (left, right) siblings from the lowest level up."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
            ways[k].append((run[: p % 8], run[p % 8 + 1 :]))
        at = [p // 8 for p in at]
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
    return nodes[0], ways


def reference(rows):
    """Rows of (doc_id, source, lang, n_chars, text) to sorted rows of the manifest."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops, parts = [], []
    for g in order:
        leaves = sorted(((r[0], leaf_of(r), r) for r in groups[g]), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        top, ways = tree([x[1] for x in leaves])
        tops.append(top)
        parts.append((leaves, ways))
    root, above = tree(tops) if tops else (None, [])
    out = []
    for (leaves, ways), top, high in zip(parts, tops, above, strict=True):
        for (i, leaf, row), way in zip(leaves, ways, strict=True):
            text = row[4].translate(LOWER) if row[4] is not None and i is not None and zlib.crc32(str(i).encode()) % 3 == 0 else row[4]
            node, proof = leaf_of((*row[:4], text)), []
            for left, right in way + high:
                node = h(*left, node, *right)
                proof += left + right
            out.append((str(i), leaf, top, root, h(*proof), node, node == root))
    return sorted(out)


def collected(df):
    return sorted((str(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in df.collect())


def columns_of(df):
    return [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in df.collect()]


def test_registered_query_equals_recursion(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = collected(op11_block_manifest(spark, "/root/testdata/sf0.001"))
    assert got == reference(columns_of(docs))
    assert {v[-1] for v in got} == {True, False}


def test_odd_rows(spark, odd_docs, no_docs):
    assert collected(merkle.manifest(odd_docs)) == reference(columns_of(odd_docs))
    assert merkle.manifest(no_docs).count() == 0


@pytest.mark.parametrize("sizes", [(1,), (8, 1), (9, 64, 65), (512, 513, 2), (4097, 520, 1)])
def test_sizes_around_runs_and_blocks(spark, sizes):
    rng = random.Random(3)
    rows = [(k, "s", lang, 1, rng.choice(["Aa", "b", "C"])) for lang, n in zip((None, "É", "a"), sizes, strict=False) for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert collected(merkle.manifest(df)) == reference(rows)


def test_many_groups_and_clashing_columns(spark):
    rows = [(k, None, f"g{k % 600}", k, f"T{k}") for k in range(1300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    wide = df.withColumns({c: F.lit(1) for c in ("group", "node", "id", "pos", "block", "levels", "up", "_g", "n", "seen")})
    assert collected(merkle.manifest(wide)) == reference(rows)
