"""Exact top-k search by inner product in three phases with one uniform threshold.

Vectors become integers, floor(64 * x). Their dimensions are split into lists, and a score is the sum
of one part per list, each counted from the least part that any candidate has in that list, so that
all parts are at least 0.

1. Every block of candidates makes, per query and list, its local score list: the least part and the
   ``k`` entries with the highest parts. Only the scores of these entries are summed. The k-th best of
   them over all blocks is a cutoff that the true k-th score cannot be below.
2. A candidate that reaches the cutoff has at least one part of at least cutoff / number of lists.
   That threshold is sent to the blocks with the queries, and a block collects the entries that reach
   it in some list. Entries whose parts seen so far, with the threshold for every other list, stay
   below the cutoff are dropped.
3. The collected entries are resolved exactly: their parts in the lists where they were not collected
   are computed one by one, those below the cutoff are dropped, and each block sends on its best ``k``
   at most.

Two lists are the default: the threshold is then half of the cutoff and about one entry in eight of
vectors without structure reaches it (a third with three lists, half with four).

Queries and candidates are packed into blocks of bounded size that meet in a grid, one cell at a
time; the query set is a stated share of the rows, and no pair below the cutoff leaves its cell.

Vectors that are null, or hold a null or a non-finite component, take no part, nor do rows without
an id; rows that share the query's id are its own, and of several query rows with one id the greatest
vector counts; repeated candidate rows are ranked each. Vectors of different lengths count as padded with
zeros. Equal scores go to the smaller id. Scores beyond a long are held at its bounds. An empty
table, or no queries, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pick

LISTS = 2
QUERY_BLOCK, CANDIDATE_BLOCK, SALT_BLOCKS = 4096, 4096, 8
#: Queries of a block that are scored at once, and entries that are resolved at once.
TILE, RESOLVED_AT_ONCE = 512, 1 << 16
_BOUND = 1 << 63


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block: ids and a matrix of floor(64 * x), in the smallest integer type that holds it."""
    wide = max((len(v) for v in pdf["v"]), default=0)
    m = np.zeros((len(pdf), wide))
    for k, v in enumerate(pdf["v"]):
        m[k, : len(v)] = v
    m = np.floor(64.0 * m)
    top = np.abs(m).max(initial=0)
    kind = next((t for t in ("int8", "int16", "int32") if top <= np.iinfo(t).max), "float64")
    order = np.argsort(pdf["id"].to_numpy(), kind="stable")
    return pd.DataFrame(
        {
            "block": [int(pdf["block"].iloc[0])],
            "ids": [pdf["id"].to_numpy(np.int64)[order].tobytes()],
            "data": [m[order].astype(kind).tobytes()],
            "kind": [kind],
            "dim": [wide],
        }
    )


def _matrix(data: bytes, kind: str, n: int, dim: int, wide: int) -> np.ndarray:
    m = np.zeros((n, wide))
    m[:, :dim] = np.frombuffer(data, kind).reshape(n, dim)
    return m


class Lists:
    """The parts of all scores between one tile of queries and one block of candidates, by list.

    Single or double floats are used where they hold every sum exactly, Python integers elsewhere.
    """

    def __init__(self, q: np.ndarray, c: np.ndarray, lists: int) -> None:
        most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
        self.kind = np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else object
        self.q, self.c = (np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape) if self.kind is object else m.astype(self.kind) for m in (q, c))
        self.cuts = np.linspace(0, q.shape[1], lists + 1).astype(int)
        self.shape = len(q), len(c)

    def whole(self, j: int) -> np.ndarray:
        """List ``j``: the parts of all pairs."""
        a, b = self.cuts[j], self.cuts[j + 1]
        if a == b:
            return np.zeros(self.shape, self.kind)
        return self.q[:, a:b] @ self.c[:, a:b].T

    def parts(self, j: int, i: np.ndarray, c: np.ndarray) -> np.ndarray:
        """List ``j`` at the entries (i, c) alone."""
        a, b = self.cuts[j], self.cuts[j + 1]
        return (self.q[i, a:b] * self.c[c, a:b]).sum(axis=1) if a < b else np.zeros(len(i), self.kind)


def _long(score) -> int:
    return max(-_BOUND, min(_BOUND - 1, int(score)))


def _tiles(row: pd.Series, lists: int) -> Iterator[tuple[np.ndarray, np.ndarray, Lists]]:
    """Query ids, candidate ids and lists of one cell, some queries at a time."""
    qid, cid = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["c_ids"], np.int64)
    wide = max(row["q_dim"], row["c_dim"])
    q, c = _matrix(row["q_data"], row["q_kind"], len(qid), row["q_dim"], wide), _matrix(row["c_data"], row["c_kind"], len(cid), row["c_dim"], wide)
    for at in range(0, len(qid), TILE):
        yield qid[at : at + TILE], cid, Lists(q[at : at + TILE], c, lists)


def local_lists(qid: np.ndarray, cid: np.ndarray, scores: Lists, k: int, lists: int) -> list[dict]:
    """Phase 1 in one tile: per query the least part of every list, and the scores of the lists' best."""
    take = min(k + 1, len(cid))
    least, picks = [], []
    for j in range(lists):
        p = scores.whole(j)
        least.append(p.min(axis=1))
        picks.append(np.argsort(-p, axis=1, kind="stable")[:, :take] if p.dtype == object else np.argpartition(-p, take - 1, axis=1)[:, :take])
    seen = np.sort(np.concatenate(picks, axis=1), axis=1)
    i = np.repeat(np.arange(len(qid)), seen.shape[1])
    total = sum(scores.parts(j, i, seen.ravel()) for j in range(lists)).reshape(seen.shape)
    once = np.concatenate([np.ones((len(qid), 1), bool), seen[:, 1:] != seen[:, :-1]], axis=1) & (cid[seen] != qid[:, None])
    return [
        {"query_id": int(one), "least": [_long(p[r]) for p in least], "best": sorted((_long(x) for x in total[r, once[r]]), reverse=True)[:k]}
        for r, one in enumerate(qid)
    ]


def collected(scores: Lists, cutoff: np.ndarray, least: np.ndarray, live: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Phase 2 in one tile: entries (i, c) that reach the threshold in a list, their summed parts, and where they were seen.

    ``live`` marks the entries that may be collected at all.
    """
    threshold = least + ((cutoff - least.sum(axis=1)) / lists)[:, None]
    reach, known = np.zeros((lists, *scores.shape), bool), np.zeros(scores.shape, scores.kind)
    for j in range(lists):
        p = scores.whole(j)
        reach[j] = (p >= threshold[:, j, None] - 1e-6 * np.maximum(1.0, np.abs(threshold[:, j, None]))) & live
        known += np.where(reach[j], p, 0)
    i, c = np.nonzero(reach.any(axis=0))
    return i, c, known[i, c], reach[:, i, c]


def resolved(scores: Lists, i: np.ndarray, c: np.ndarray, known: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Phase 3: full scores of collected entries, from the lists where they were not seen."""
    out = known.astype(object if scores.kind is object else np.float64)
    for j, there in enumerate(seen):
        missing = np.flatnonzero(~there)
        for at in range(0, len(missing), RESOLVED_AT_ONCE):
            some = missing[at : at + RESOLVED_AT_ONCE]
            out[some] += scores.parts(j, i[some], c[some])
    return out


def _best_of(qid: np.ndarray, cid: np.ndarray, scores: Lists, cut: dict[int, tuple[int, list[int]]], k: int, lists: int) -> list[tuple[int, int, int]]:
    """Phases 2 and 3 in one tile: its best entries with their full scores."""
    live, out = qid[:, None] != cid[None, :], []
    armed = np.array([int(x) in cut for x in qid], bool)
    cutoff = np.array([cut[int(x)][0] if a else 0 for x, a in zip(qid, armed, strict=True)], float)
    least = np.array([cut[int(x)][1] if a else [0] * lists for x, a in zip(qid, armed, strict=True)], float).reshape(len(qid), lists)
    i, c, known, seen = collected(scores, cutoff, least, live & armed[:, None], lists)
    # fewer than k candidates anywhere: there is no cutoff, and all are resolved
    free = np.nonzero(live & ~armed[:, None])
    i, c, known = np.concatenate([i, free[0]]), np.concatenate([c, free[1]]), np.concatenate([known, np.zeros(len(free[0]), known.dtype)])
    seen = np.concatenate([seen, np.zeros((lists, len(free[0])), bool)], axis=1)
    full = resolved(scores, i, c, known, seen)
    slack = 1e-6 * np.maximum(1.0, np.abs(cutoff)) if scores.kind is object else 0.0
    stay = ~armed[i] | (full >= (cutoff - slack)[i])
    i, c, full = i[stay], c[stay], full[stay]
    for r in np.unique(i):
        at = np.flatnonzero(i == r) if full.dtype == object else np.arange(*np.searchsorted(i, [r, r + 1])) if armed.all() else np.flatnonzero(i == r)
        order = sorted(at, key=lambda e: (-full[e], cid[c[e]]))[:k]
        out += [(int(qid[r]), int(cid[c[e]]), _long(full[e])) for e in order]
    return out


def _blocks(rows: DataFrame, key: Column, size: int, name: str) -> tuple[DataFrame, int]:
    """Packed blocks of about ``size`` rows by the hash of ``key``, which no two rows share, and the number of blocks."""
    blocks = max(1, -(-rows.count() // size))
    keyed = rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    return materialize(keyed.groupBy("block").applyInPandas(_pack, "block int, ids binary, data binary, kind string, dim int"), name), blocks


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    lists: int = LISTS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows for every row that meets ``is_query``."""
    v = pick(vectors, [id_col, vector_col]).withColumn("_q", F.coalesce(is_query, F.lit(False)))
    as_double = F.col(vector_col).cast("array<double>")
    sound = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = v.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(sound)
    rows = materialize(rows.select(F.col(id_col).cast("long").alias("id"), as_double.alias("v"), "_q"), "topk-rows")
    queries = rows.filter("_q").groupBy("id").agg(F.max("v").alias("v"))
    q_blocks, n_query_blocks = _blocks(queries, F.col("id"), QUERY_BLOCK, "topk-queries")
    # ids may repeat, so rows are spread by their number in the written table
    c_blocks, n_candidate_blocks = _blocks(rows.select("id", "v"), F.monotonically_increasing_id(), CANDIDATE_BLOCK, "topk-candidates")
    salts = max(1, -(-n_candidate_blocks // SALT_BLOCKS))
    # the grid: a candidate block carries every query block's number, a query block every salt, and a key holds few cells
    salted = _named(c_blocks, "c").withColumn("salt", F.col("c_block") % salts)
    cells = salted.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))))
    cells = cells.join(_named(q_blocks, "q").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["q_block", "salt"])

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                for qid, cid, scores in _tiles(row, lists):
                    yield pd.DataFrame(local_lists(qid, cid, scores, k, lists))

    local = cells.mapInPandas(gather, "query_id long, least array<long>, best array<long>")
    spread = local.select("query_id", "best", *[F.col("least")[j].alias(f"m{j}") for j in range(lists)])
    spread = materialize(spread, "topk-lists")
    lows = spread.groupBy("query_id").agg(F.array(*[F.min(f"m{j}") for j in range(lists)]).alias("least"))
    ranked = spread.select("query_id", F.explode("best").alias("s")).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"))))
    cutoff = ranked.filter(F.col("r") == k).select("query_id", F.col("s").alias("cutoff"))
    sent = q_blocks.select("block", "ids").mapInPandas(_ids_of, "q_block int, query_id long").join(lows.join(cutoff, "query_id"), "query_id")
    sent = sent.groupBy("q_block").agg(F.collect_list(F.struct("query_id", "cutoff", "least")).alias("cuts"))
    armed = cells.join(sent, "q_block", "left")

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                cuts = row["cuts"] if row["cuts"] is not None else []
                cut = {c["query_id"]: (c["cutoff"], [int(x) for x in c["least"]]) for c in cuts}
                for qid, cid, scores in _tiles(row, lists):
                    yield pd.DataFrame(_best_of(qid, cid, scores, cut, k, lists), columns=["query_id", "vec_id", "score"])

    found = armed.mapInPandas(collect, "query_id long, vec_id long, score long")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ids_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for block, ids in zip(pdf["block"], pdf["ids"], strict=True):
            yield pd.DataFrame({"q_block": int(block), "query_id": np.frombuffer(ids, np.int64)})
