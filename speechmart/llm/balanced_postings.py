"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted on a bounded sample by splitting it in equal halves until the parts have the size
of a list, followed by rounds of nearest assignment in which a list costs more the fuller it is. Every
row is posted to its nearest centroid, and a row near a boundary also to those that are at most
``REPLICA_RATIO`` times as far, ``REPLICAS`` lists in all. A list is dealt to as many blocks of ``POSTINGS``
rows as the sample lets expect, and packed so many rows at a time whatever comes, so no task holds a list
that a common vector makes long. Postings are not written; they pass two shuffles, in the vectors' own
precision.

A query searches the centroids through a graph in memory (each centroid with its ``NEIGHBOURS`` nearest
and the reverse edges) from fixed entries, and probes the lists whose centroids are at most
``PROBE_RATIO`` times as far as the nearest one. Query blocks and posting blocks of a list meet in a
merge join; each meeting scores all its pairs, and a task sends on the best ``k`` a query of all its meetings.
Rows found in several lists count once.

Largest inner products become smallest distances by one more dimension: a row x has there the root of
(greatest squared norm - squared norm of x), a query 0. That affects the lists alone; scores are inner
products of the original vectors in double precision, summed in one fixed order, so equal vectors have
equal scores.

Bounds: the driver holds the sample (a few copies of it while it fits) and ``DISTANCES`` distances at once;
the sample has about ``SAMPLE_ROWS`` rows and at most ``SAMPLE_BYTES``, the centroids at most
``CENTROIDS`` and ``CENTROID_BYTES``; beyond about ``CENTROIDS * LIST`` rows lists grow and are held in more
blocks. Every row is indexed and recall is measured against brute force in the tests.

Vectors that are null, empty, zero, or hold a null or a non-finite component take no part, nor do rows
without an id. Rows that share the query's id are its own; of several query rows with one id the greatest
vector counts; repeated candidate rows are ranked each. Vectors of different lengths count as padded with
zeros. Equal scores go to the smaller id. An empty table, or no queries, gives an empty result; columns
other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, pick

LIST, POSTINGS, QUERY_BLOCK = 256, 1024, 1024
REPLICAS, REPLICA_RATIO, PROBE_RATIO = 3, 1.15, 1.13
NEIGHBOURS, ENTRIES, BEAM = 16, 8, 24
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_QUERIES = 100_000, 64 << 20, 10_000
CENTROIDS, CENTROID_BYTES = 16_384, 16 << 20
ROUNDS, FULLNESS = 4, 0.05
PACKED = ["list", "keys", "ids", "data", "wide"]
#: Found rows that a task holds at once.
HELD = 1 << 20
#: Rows that a task hands on at once, and distances to centroids that it holds at once.
DEALT, DISTANCES = 8192, 1 << 22


def _step(centroids: np.ndarray, most: int = 1024) -> int:
    """Rows whose distances to all centroids are held at once."""
    return max(1, min(most, DISTANCES // len(centroids)))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between all rows of ``a`` and of ``b``."""
    return np.maximum((a * a).sum(axis=1)[:, None] - 2.0 * (a @ b.T) + (b * b).sum(axis=1), 0.0)


def _halves(points: np.ndarray, parts: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Means of ``parts`` parts of nearly equal size, by repeated cuts along the line between two far points."""
    work, out = [(np.arange(len(points)), parts)], []
    while work:
        rows, n = work.pop()
        if n == 1 or len(rows) < 2:
            out.append(points[rows].mean(axis=0))
            continue
        one = points[rows[np.argmax(_squared(points[rows], points[rows[rng.integers(len(rows))]][None])[:, 0])]]
        two = points[rows[np.argmax(_squared(points[rows], one[None])[:, 0])]]
        order = rows[np.argsort(points[rows] @ (two - one), kind="stable")]
        cut = len(order) * (n // 2) // n
        work += [(order[:cut], n // 2), (order[cut:], n - n // 2)]
    return out


def fit_centroids(points: np.ndarray, parts: int, seed: int = 0) -> np.ndarray:
    """Centroids of lists of nearly equal size."""
    parts = max(1, min(parts, len(points)))
    centroids = np.array(_halves(points, parts, np.random.default_rng(seed)))
    sizes, step = np.full(parts, len(points) / parts), _step(centroids, 4096)
    for _ in range(ROUNDS):
        extra = FULLNESS * (sizes / sizes.mean() - 1.0)
        nearest = np.empty(len(points), int)
        for at in range(0, len(points), step):
            d = _squared(points[at : at + step], centroids)
            nearest[at : at + step] = np.argmin(d + extra * d.mean(), axis=1)
        sums, sizes = np.zeros_like(centroids), np.bincount(nearest, minlength=parts).astype(float)
        np.add.at(sums, nearest, points)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1.0)[:, None], centroids)
    return centroids


class CentroidGraph:
    """Centroids joined to their nearest ones, searched from fixed entries."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.c = centroids
        n = len(centroids)
        width = min(NEIGHBOURS, n - 1)
        edges: list[set[int]] = [set() for _ in range(n)]
        step = _step(centroids)
        for at in range(0, n, step):
            d = _squared(centroids[at : at + step], centroids)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            for i, near in enumerate(np.argpartition(d, width - 1, axis=1)[:, :width] if width else []):
                for j in near.tolist():
                    edges[at + i].add(j)
                    edges[j].add(at + i)
        self.edges = [np.fromiter(e, int, len(e)) for e in edges]
        self.entries = np.unique(np.linspace(0, n - 1, min(ENTRIES, n)).astype(int))
        self._join_parts()

    def _join_parts(self) -> None:
        """Makes every part of the graph an entry, so that no list is out of reach."""
        seen = np.zeros(len(self.c), bool)
        extra, work = [], list(self.entries)
        for start in range(-1, len(self.c)):
            if start >= 0 and not seen[start]:
                extra.append(start)
                work.append(start)
            while work:
                at = work.pop()
                if not seen[at]:
                    seen[at] = True
                    work += self.edges[at].tolist()
        self.entries = np.unique(np.concatenate([self.entries, np.array(extra, int)]))

    def within(self, q: np.ndarray, ratio: float) -> np.ndarray:
        """Centroids at most ``ratio`` times as far from ``q`` as the nearest one found."""
        far = np.full(len(self.c), np.inf)
        open_ = np.zeros(len(self.c), bool)
        fresh = self.entries
        while len(fresh):
            far[fresh] = ((self.c[fresh] - q) ** 2).sum(axis=1)
            open_[fresh] = True
            known = far[np.isfinite(far)]
            # nodes within the ratio, and always the nearest few, lead on
            bound = max(known.min() * ratio * ratio, np.partition(known, min(BEAM, len(known)) - 1)[min(BEAM, len(known)) - 1])
            edge = np.flatnonzero(open_ & (far <= bound))
            open_[edge] = False
            fresh = np.unique(np.concatenate([self.edges[e] for e in edge])) if len(edge) else edge
            fresh = fresh[~np.isfinite(far[fresh])]
        return np.flatnonzero(far <= far.min() * ratio * ratio)


def _lifted(v: np.ndarray, scale: float, reach: float, query: bool) -> np.ndarray:
    """Vectors divided by ``scale``, with the dimension that turns inner products into distances."""
    x = v / scale
    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(reach - (x * x).sum(axis=1), 0.0))
    return np.concatenate([x, more[:, None]], axis=1)


def _matrix(vectors: pd.Series | list, wide: int) -> np.ndarray:
    m = np.zeros((len(vectors), wide))
    for k, v in enumerate(vectors):
        m[k, : len(v)] = v
    return m


class Index:
    """What every task needs to post rows and to probe: centroids, their graph and the norms' bounds."""

    def __init__(self, sample: np.ndarray, rows: int, scale: float, reach: float) -> None:
        self.wide, self.scale, self.reach = sample.shape[1], scale, reach
        most = max(1, min(CENTROIDS, CENTROID_BYTES // (8 * (self.wide + 1))))
        self.centroids = fit_centroids(_lifted(sample, scale, reach, False), min(most, -(-rows // LIST)))
        self.graph = CentroidGraph(self.centroids)
        #: Blocks that each list is dealt to, from the sample's postings.
        posted = np.zeros(len(self.centroids))
        step = self.step()
        for at in range(0, len(sample), step):
            posted += np.bincount(self.post(sample[at : at + step])[1], minlength=len(posted))
        self.blocks = np.maximum(1, np.ceil(posted * (rows / len(sample)) / POSTINGS)).astype(np.int64)

    def step(self) -> int:
        """Rows posted at once."""
        return _step(self.centroids)

    def post(self, vectors: pd.Series | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of every posting."""
        d = _squared(_lifted(vectors if isinstance(vectors, np.ndarray) else _matrix(vectors, self.wide), self.scale, self.reach, False), self.centroids)
        n = min(REPLICAS, d.shape[1])
        lists = np.argpartition(d, n - 1, axis=1)[:, :n]
        near = np.take_along_axis(d, lists, axis=1)
        rows, at = np.nonzero(near <= near.min(axis=1, keepdims=True) * REPLICA_RATIO**2)
        return rows, lists[rows, at]

    def query_blocks(self, sample: np.ndarray, queries: int) -> np.ndarray:
        """Blocks that each list deals its queries to, from a sample of them."""
        probed = np.zeros(len(self.centroids))
        for at in range(0, len(sample), self.step()):
            d = _squared(_lifted(sample[at : at + self.step()], self.scale, self.reach, True), self.centroids)
            probed += (d <= d.min(axis=1, keepdims=True) * PROBE_RATIO**2).sum(axis=0)
        return np.maximum(1, np.ceil(probed * (queries / max(1, len(sample))) / QUERY_BLOCK)).astype(np.int64)

    def probe(self, vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) of every probed list."""
        found = [self.graph.within(q, PROBE_RATIO) for q in _lifted(_matrix(vectors, self.wide), self.scale, self.reach, True)]
        return np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate(found)


def _dealt(dealer: Callable[[pd.Series], tuple[np.ndarray, np.ndarray]], blocks: np.ndarray, step: int = 1024) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows with their lists and blocks, at most ``DEALT`` at once however many lists a row goes to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), step):
                part = pdf.iloc[at : at + step]
                rows, lists = dealer(part["v"])
                for cut in range(0, len(rows), DEALT):
                    some = lists[cut : cut + DEALT]
                    out = part.iloc[rows[cut : cut + DEALT]].assign(list=some)
                    out["block"] = out["key"].to_numpy(np.int64) % blocks[some]
                    yield out[["list", "block", "key", "id", "v"]]

    return run


def _packed(dealt: DataFrame, size: int, kind: str) -> DataFrame:
    """Rows of one list and block packed together, ``size`` at a time, so a block that holds more is cut."""

    def pack(at: tuple[int, int], keys: list[int], ids: list[int], vectors: list[np.ndarray]) -> tuple:
        wide = max(map(len, vectors))
        return at[0], np.array(keys, np.int64).tobytes(), np.array(ids, np.int64).tobytes(), _matrix(vectors, wide).astype(kind).tobytes(), wide

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, ([], [], [])
        for pdf in batches:
            out = []
            for one, block, *row in zip(pdf["list"].tolist(), pdf["block"].tolist(), pdf["key"].tolist(), pdf["id"].tolist(), pdf["v"], strict=True):
                if held[0] and (at != (one, block) or len(held[0]) == size):
                    out.append(pack(at, *held))
                    held = ([], [], [])
                at = one, block
                for values, value in zip(held, row, strict=True):
                    values.append(value)
            yield pd.DataFrame(out, columns=PACKED)
        if held[0]:
            yield pd.DataFrame([pack(at, *held)], columns=PACKED)

    along = dealt.repartition("list", "block").sortWithinPartitions("list", "block")
    return along.mapInPandas(run, "list int, keys binary, ids binary, data binary, wide int")


def _sample(rows: DataFrame, want: int, n: int, wide: int) -> np.ndarray:
    """About ``want`` of ``n`` vectors: a share by hash of keys that no two rows share."""
    part = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(min(1.0, want / n) * (1 << 30))).select("v").toArrow()
    part = part if part.num_rows else rows.select("v").limit(1).toArrow()
    return np.concatenate([_matrix(c.to_pandas(), wide) for c in part["v"].chunks])


class Best:
    """The ``k`` best rows of each query among all that a task has met so far; a row found in two lists counts once."""

    def __init__(self, k: int, room: int = HELD) -> None:
        self.k, self.room = k, room
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0
        self.least: dict[int, float] = {}

    def meet(self, q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, keys: np.ndarray, v: np.ndarray) -> None:
        """Adds the rows of one posting block that may be among the best of a query of one query block."""
        scores = q @ v.T
        slack = 1e-9 * (np.abs(q) @ np.abs(v).T).max(axis=1, initial=0.0)
        for r, one in enumerate(q_ids.tolist()):
            other = np.flatnonzero(ids != one)
            line = scores[r, other]
            least = self.least.get(one, -np.inf)
            if len(other) > self.k:
                least = max(least, np.partition(line, len(line) - self.k)[len(line) - self.k])
            other = other[~(line < least - slack[r])]
            exact = (v[other] * q[r]).sum(axis=1)
            best = np.lexsort((keys[other], ids[other], -exact))[: self.k]
            other = other[best]
            self.parts.append((np.full(len(other), one), ids[other], keys[other], exact[best]))
            self.held += len(other)

    def reduce(self) -> pd.DataFrame:
        """What is best so far; all that is held."""
        q, i, key, score = (np.concatenate(c) for c in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        order = np.lexsort((key, i, -score, q))
        q, i, key, score = q[order], i[order], key[order], score[order]
        once = np.ones(len(q), bool)
        once[1:] = (q[1:] != q[:-1]) | (key[1:] != key[:-1])
        q, i, key, score = q[once], i[once], key[once], score[once]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.least.update(zip(q[place == self.k - 1].tolist(), score[place == self.k - 1].tolist(), strict=True))
        stay = place < self.k
        self.parts = [(q[stay], i[stay], key[stay], score[stay])]
        self.held = int(stay.sum())
        return pd.DataFrame({"query_id": q[stay], "vec_id": i[stay], "key": key[stay], "score": score[stay]})

    def in_parts(self) -> Iterator[pd.DataFrame]:
        """What is best so far, at most ``DEALT`` rows at once."""
        out = self.reduce()
        for at in range(0, len(out), DEALT):
            yield out.iloc[at : at + DEALT]

    def full(self) -> bool:
        """Whether even the best take more than half of the room."""
        if self.held <= self.room:
            return False
        self.reduce()
        return self.held > self.room // 2

    def clear(self) -> None:
        self.parts, self.held = [], 0
        self.least.clear()


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for every row that meets ``is_query``."""
    v = pick(vectors, [id_col, vector_col]).withColumn("_q", F.coalesce(is_query, F.lit(False)))
    as_double = F.col(vector_col).cast("array<double>")
    sound = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(as_double, lambda x: x != 0)
    rows = v.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(sound)
    short = rows.schema[vector_col].dataType.elementType.typeName() == "float"  # then four bytes a component are kept
    vector, kind = (F.col(vector_col), "<f4") if short else (as_double, "<f8")
    rows = materialize(rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("v"), "_q"), "postings-rows")
    # ids may repeat; a row is known by its number in the written table
    rows = rows.withColumn("key", F.monotonically_increasing_id())
    spark = rows.sparkSession
    as_double = F.col("v").cast("array<double>")
    top = F.max(F.array_max(F.transform(as_double, F.abs)))
    n, wide, scale = rows.agg(F.count("*"), F.max(F.size("v")), top).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    reach = rows.agg(F.max(F.aggregate(as_double, F.lit(0.0), lambda s, x: s + (x / scale) * (x / scale)))).first()[0]
    want = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * wide)))
    index = Index(_sample(rows, want, n, wide), n, scale, reach)
    schema = f"list int, block long, key long, id long, v {rows.schema['v'].dataType.simpleString()}"
    postings = rows.select("key", "id", "v").mapInPandas(_dealt(index.post, index.blocks, index.step()), schema)
    asked = materialize(rows.filter("_q").groupBy("id").agg(F.max("v").alias("v")).withColumn("key", F.col("id")).select("key", "id", "v"), "postings-asked")
    queries = asked.count()
    if not queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    query_blocks = index.query_blocks(_sample(asked, min(want, SAMPLE_QUERIES), queries, wide), queries)
    # few queries lie in few partitions, while their search is the work
    probes = asked.repartition(spark.sparkContext.defaultParallelism * 4, "id").mapInPandas(_dealt(index.probe, query_blocks), schema)
    cells = _packed(postings, POSTINGS, kind)
    queries = _packed(probes, QUERY_BLOCK, kind).select("list", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("wide").alias("q_wide"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(k)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                ids, keys, q_ids = (np.frombuffer(b, np.int64) for b in (row.ids, row.keys, row.q_ids))
                q, c = np.zeros((len(q_ids), wide)), np.zeros((len(ids), wide))
                q[:, : row.q_wide] = np.frombuffer(row.q_data, kind).reshape(len(q_ids), row.q_wide)
                c[:, : row.wide] = np.frombuffer(row.data, kind).reshape(len(ids), row.wide)
                best.meet(q_ids, q, ids, keys, c)
                if best.full():
                    yield from best.in_parts()
                    best.clear()
        yield from best.in_parts()

    # Spark takes the packed queries to be as small as the asked rows, and would gather them in the driver to broadcast them
    found = cells.join(queries.hint("merge"), "list").mapInPandas(meet, "query_id long, vec_id long, key long, score double")
    along = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "key")
    # a row stands in REPLICAS lists at most, so this many hold the best k; Spark applies it before the shuffle too
    few = found.withColumn("_r", F.row_number().over(along)).filter(F.col("_r") <= k * REPLICAS).drop("_r").dropDuplicates(["query_id", "key"])
    return few.withColumn("rank", F.row_number().over(along)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
