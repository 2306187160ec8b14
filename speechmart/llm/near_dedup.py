"""Near-duplicate groups by MinHash bands and odd sketches.

A document's set is its distinct five-word shingles, as 64-bit hashes. Documents with equal sets
form one class and are represented by their smallest id. Each class gets MinHash samples, whose
bands propose candidates, and an odd sketch: the samples folded into a parity bitmap. The number of
ones in the XOR of two sketches is at most twice the number of samples that differ, so a pair whose
XOR has more ones than ``max_xor`` differs in more samples than a linked pair ever does in practice,
and is dropped without reading its sets. All pairs that remain are confirmed on the full sets.

Buckets with the same members count once. Pairs are never listed within a bucket. First every member
is held against its bucket's smallest id. Then components are built, and only members of different
components that still share a bucket are compared: those outside a bucket's largest component with
all others, in cells of bounded size (a grid of blocks, each pair of blocks met once). Members of one
component need no further pair, so no link between components is lost. A cell is one sorted run of
rows in one task and is visited twice:

* with fine odd sketches (1024 samples on 4096 bits, which tell the least similarity from one 0.07
  below). It names the members that have a plausible partner there, a pair counting only in the first
  bucket that it shares;
* with the full sets of those members. Candidates come from an exact prefix filter (a link at least
  shares one of the rarest shingles of either side), are confirmed on the sets at once and joined in
  a union-find, and only the joining edges leave the task.

So both visits send on a number of rows that is linear in the members, however many pairs are near.

Both limits follow from the least similarity. A link at it has more samples different than
``max_xor`` allows with a chance of 2e-8 at most, and exceeds ``max_fine_xor`` (5.6 standard
deviations above the mean) with a chance of 1e-8. It misses all 24 bands of 4 with a chance of 2e-8
at 0.85 and of 3e-6 at 0.80.

Texts that are null, empty or without words have an empty set and are linked with nothing; texts
with fewer than five words have one shingle, the whole sequence. Rows that share an id count as one
document of the graph; rows without an id are in no group. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pick, slices, sorted_runs

WORDS, BANDS, ROWS = 5, 24, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
FINE_SAMPLES, FINE_BITS = 1024, 4096
#: Members of a block: a share of the bucket within these bounds, and no more shingles than that.
BLOCK_LEAST, BLOCK_MOST, BLOCK_SHARE, BLOCK_SHINGLES = 256, 4096, 64, 1 << 20
_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 63, SAMPLES + FINE_SAMPLES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, SAMPLES + FINE_SAMPLES, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def max_xor(percent: int) -> int:
    """Twice the least number of samples that a link exceeds with a chance of 2e-8 at most."""
    same, tail = percent / 100, 0.0
    for k in range(SAMPLES, 0, -1):
        tail += comb(SAMPLES, k) * (1 - same) ** k * same ** (SAMPLES - k)
        if tail > 2e-8:
            return 2 * k
    return 0


def max_fine_xor(percent: int) -> int:
    """5.6 standard deviations above the mean of the ones in the XOR of two fine sketches."""
    same, n = percent / 100, FINE_BITS
    one, two = ((same + (1 - same) * (1 - k / n) ** 2) ** FINE_SAMPLES for k in (2, 4))
    return int(n / 2 * (1 - one) + 5.6 * sqrt(max(0.0, n + n * (n - 1) * two - (n * one) ** 2)) / 2)


#: The limits at the least similarity of 0.85.
MAX_XOR, MAX_FINE_XOR = max_xor(85), max_fine_xor(85)


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(words, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * _MIX + w[k : len(w) - size + 1 + k]
        h ^= h >> np.uint64(32)
    return np.unique(_stir(h))


def samples(shingles: np.ndarray, first: int = 0, n: int = SAMPLES) -> np.ndarray:
    """The least value of the set under each of ``n`` hash functions, from number ``first`` on."""
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    a, b = _A[first : first + n, None], _B[first : first + n, None]
    for at in range(0, len(shingles), 1024):
        np.minimum(low, (a * shingles[None, at : at + 1024] + b).min(axis=1), out=low)
    return low


def bands_of(low: np.ndarray) -> np.ndarray:
    """One key per band; keys of different bands differ."""
    rows = low.reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = _stir(h * _MIX + rows[:, k])
    return h.view(np.int64)


def odd_sketch(low: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity of how many samples fall on each bit, as 64-bit words."""
    seat = np.arange(1, len(low) + 1, dtype=np.uint64) * _MIX
    bit = (_stir(low ^ seat) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(bit, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def similarity(xor_ones: int) -> float:
    """The estimate from the XOR's ones: the expected share of equal samples."""
    x = max(1e-9, 1 - 2 * xor_ones / SKETCH_BITS)
    return max(0.0, 1 + SKETCH_BITS * np.log(x) / (4 * SAMPLES))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc_id, n_shingles, set_hash, sketch, bands."""
    names = ["doc_id", "n_shingles", "set_hash", "sketch", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, key, sketch, bands = [], [], [], []
            for text in batch.column(1).to_pylist():
                h = shingle_set(text)
                n.append(len(h))
                key.append(xxhash.xxh3_128_digest(h.tobytes()))
                low = samples(h) if len(h) else None
                sketch.append(None if low is None else odd_sketch(low))
                bands.append(None if low is None else bands_of(low))
            cols = [pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    d = pick(docs, [id_col, text_col]).select(F.col(id_col).cast("long").alias("doc_id"), text_col)
    return d.mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, sketch array<long>, bands array<long>")


def _ones(a: Column, b: Column) -> Column:
    """Ones in the XOR of two sketches."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _plausible(a: Column, b: Column, percent: int) -> Column:
    """Whether two classes' sizes and sketches allow a link."""
    size = F.lit(100) * F.least(a["n"], b["n"]) >= F.lit(percent) * F.greatest(a["n"], b["n"])
    return size & (_ones(a["sketch"], b["sketch"]) <= max_xor(percent))


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Full sets of the candidate ids, one pass over their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "members"])

    d = pick(docs, [id_col, text_col]).select(F.col(id_col).cast("long").alias("id"), text_col)
    return materialize(d.join(ids, "id", "left_semi").mapInArrow(run, "id long, members binary"), "near-sets")


def _fine(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """Fine sketches of the ids whose buckets are open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fine = [odd_sketch(samples(np.frombuffer(m.as_buffer(), np.uint64), SAMPLES, FINE_SAMPLES), FINE_BITS).tobytes() for m in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fine, pa.binary())], names=["rep", "fine"])

    return materialize(sets.join(ids, "id", "left_semi").select("id", "members").mapInArrow(run, "rep long, fine binary"), "near-fine")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            last, one, keep = None, None, []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.as_buffer(), y.as_buffer()
                if last is None or not x.equals(last):
                    last, one = x, np.frombuffer(x, np.uint64)
                two = np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= percent * (len(one) + len(two) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    half = pairs.join(sets.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
    full = half.join(sets.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a").select("a", "b", "ma", "mb")
    return full.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every vertex of the edges (a, b); the root is the smallest id of its component.

    Each round sends every vertex to the smallest of its neighbours, follows such steps a few times,
    and contracts the graph; the rounds' maps are composed at the end.
    """
    e = materialize(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    steps: list[DataFrame] = []
    while not e.isEmpty():
        p = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p"))
        for _ in range(2):
            p = materialize(p, "parents")
            p = p.join(p.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select("a", F.col("q").alias("p"))
        p = materialize(p, "parents")
        steps.append(p)
        moved = e.join(p, "a").select(F.col("p").alias("x"), "b")
        moved = moved.join(p.select(F.col("a").alias("b"), F.col("p").alias("y")), "b")
        e = materialize(moved.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    if not steps:
        return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
    out = steps[0].select(F.col("a").alias("id"), F.col("p").alias("root"))
    for p in steps[1:]:
        out = out.join(p.select(F.col("a").alias("root"), "p"), "root", "left").select("id", F.coalesce("p", "root").alias("root"))
    return materialize(out, "roots")


def _open_cells(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of open buckets by cell: key, i, j, rep, c, block.

    Blocks 0 to ``rest_blocks`` - 1 hold the members outside the bucket's largest component, the
    others those within it; cell (i, j) is where block i of the former meets block j.
    """
    m = members.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("c"))
    sizes = m.groupBy("key", "c").agg(F.count("*").alias("k"), F.sum("n").alias("w"))
    open_keys = sizes.groupBy("key").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("k"), F.sum("w").alias("w"), F.count("*").alias("parts"))
    block = F.least(F.greatest(F.col("k") / BLOCK_SHARE, F.lit(BLOCK_LEAST)), F.lit(BLOCK_MOST), F.greatest(F.lit(1), BLOCK_SHINGLES * F.col("k") / F.col("w")))
    counts = [F.ceil((F.col("k") - F.col("top.k")) / block).cast("int").alias("rest_blocks"), F.ceil(F.col("top.k") / block).cast("int").alias("main_blocks")]
    open_keys = open_keys.filter("parts > 1 and k > 2").select("key", F.col("top.c").alias("main"), *counts)
    m = m.join(open_keys, "key")
    inside, h = F.col("c") == F.col("main"), F.xxhash64("rep", "key")
    m = m.withColumn("block", F.when(inside, F.col("rest_blocks") + F.pmod(h, "main_blocks")).otherwise(F.pmod(h, "rest_blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("rest_blocks") + F.col("main_blocks") - 1)
    partner = F.when(inside, F.sequence(F.lit(0), F.col("rest_blocks") - 1)).otherwise(every)
    met = m.select("key", "rep", "c", "block", F.explode(partner).alias("_with"))
    return met.select("key", F.least("block", "_with").alias("i"), F.greatest("block", "_with").alias("j"), "rep", "c", "block")


def _screened(cells: DataFrame, percent: int) -> DataFrame:
    """The members of a cell that have a plausible partner in it, by size and fine sketch."""
    limit = max_fine_xor(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in sorted_runs(batches, 3):
            col = {name: cell.column(name).to_numpy() for name in ("key", "c", "block", "n")}
            fine = np.frombuffer(b"".join(cell.column("fine").to_pylist()), np.uint64).reshape(cell.num_rows, -1)
            bands = cell.column("bands").combine_chunks().values.to_numpy().reshape(cell.num_rows, -1)
            i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
            wanted = np.zeros(cell.num_rows, bool)
            right = np.flatnonzero(col["block"] == j)
            for x in np.flatnonzero(col["block"] == i):
                y = right[right > x] if i == j else right
                y = y[(col["c"][y] != col["c"][x]) & (100 * np.minimum(col["n"][x], col["n"][y]) >= percent * np.maximum(col["n"][x], col["n"][y]))]
                y = y[np.bitwise_count(fine[y] ^ fine[x]).sum(axis=1) <= limit]
                if len(y):
                    same = bands[y] == bands[x]
                    y = y[bands[x][same.argmax(axis=1)] == col["key"][x]]
                    wanted[y] = True
                    wanted[x] |= len(y) > 0
            if wanted.any():
                yield cell.select(["key", "i", "j", "rep", "c", "block"]).filter(pa.array(wanted)).combine_chunks().to_batches()[0]

    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "key long, i int, j int, rep long, c long, block int")


def joining_edges(reps: np.ndarray, comps: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Linked pairs between two blocks (or within one) that join different components, a forest of them."""
    size = np.array([len(s) for s in sets], np.int64)
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rare_first = np.empty(len(often), np.int64)
    rare_first[np.argsort(often, kind="stable")] = np.arange(len(often))
    start = np.concatenate([[0], np.cumsum(size)])
    codes = [np.sort(rare_first[code[start[k] : start[k + 1]]]) for k in range(len(sets))]
    prefix = size - -(-percent * size // 100) + 1
    token = np.concatenate([codes[k][: prefix[k]] for k in range(len(sets))])
    owner = np.repeat(np.arange(len(sets)), prefix)
    order = np.argsort(token, kind="stable")
    owner, first = owner[order], np.searchsorted(token[order], np.arange(len(often) + 1))
    one_block = blocks.min() == blocks.max()
    known: dict[int, int] = {}
    root = np.array([known.setdefault(int(c), k) for k, c in enumerate(comps)])
    mark, out = np.zeros(len(often), bool), []
    for x in range(len(sets)) if one_block else np.flatnonzero(blocks == blocks.min()):
        held = [owner[first[t] : first[t + 1]] for t in codes[x][: prefix[x]]]
        y = np.unique(np.concatenate(held))
        y = y[(y > x) if one_block else (blocks[y] != blocks[x])]
        y = y[(root[y] != root[x]) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))]
        if not len(y):
            continue
        mark[codes[x]] = True
        both = np.add.reduceat(mark[np.concatenate([codes[k] for k in y])], np.concatenate([[0], np.cumsum(size[y])[:-1]]), dtype=np.int64)
        mark[codes[x]] = False
        for z in y[100 * both >= percent * (size[x] + size[y] - both)]:
            if root[z] != root[x]:
                root[root == root[z]] = root[x]
                out.append((int(reps[x]), int(reps[z])))
    return out


def _confirmed(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Joining edges (a, b) of the screened cells, by full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in sorted_runs(batches, 3):
            members = [np.frombuffer(m.as_buffer(), np.uint64) for m in cell.column("members")]
            reps, comps, blocks = (cell.column(n).to_numpy() for n in ("rep", "c", "block"))
            edges = joining_edges(reps, comps, blocks, members, percent)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

    whole = cells.join(sets.select(F.col("id").alias("rep"), "members"), "rep").select("key", "i", "j", "rep", "c", "block", "members")
    return whole.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, kept."""
    rows = materialize(signatures(docs, id_col, text_col), "near-rows")
    live = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(
        live.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")),
        "near-classes",
    )
    exploded = classes.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    marks = [F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"mark{k}") for k in range(2)]
    buckets = exploded.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("size"), F.first("band").alias("band"), *marks).filter("size > 1")
    # of buckets with the same members the one of the first band stays
    buckets = buckets.groupBy("leader", "size", "mark0", "mark1").agg(F.min_by("key", "band").alias("key")).select("key", "leader")
    members = materialize(exploded.join(buckets, "key").select("key", "leader", "rep", "n"), "near-members")
    traits = classes.select("rep", F.struct("n", "sketch").alias("s"))
    first = members.filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    first = first.join(traits.withColumnsRenamed({"rep": "b", "s": "sb"}), "b").join(traits.withColumnsRenamed({"rep": "a", "s": "sa"}), "a")
    first = materialize(first.filter(_plausible(F.col("sa"), F.col("sb"), percent)).select("a", "b"), "near-pairs")
    sets = _sets(docs, materialize(members.select(F.col("rep").alias("id")).distinct(), "near-ids"), id_col, text_col)
    edges = materialize(confirm(first, sets, percent), "near-edges")
    roots = components(edges)
    cells = materialize(_open_cells(members, roots), "near-cells")
    if not cells.isEmpty():
        fine = _fine(sets, materialize(cells.select(F.col("rep").alias("id")).distinct(), "near-ids"))
        traits = classes.select("rep", "n", "bands").join(fine, "rep")
        screened = materialize(_screened(cells.join(traits, "rep").select("key", "i", "j", "rep", "c", "block", "n", "fine", "bands"), percent), "near-screened")
        more = materialize(_confirmed(screened, sets, percent), "near-edges")
        if not more.isEmpty():
            roots = components(edges.unionAll(more))
    owner = classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("set_hash", F.coalesce("root", "rep").alias("root"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    out = rows.select("doc_id", "n_shingles", "set_hash").join(owner, "set_hash", "left")
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_representatives(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that another document of their group stands for.

    Null, empty and wordless texts stay, and so do rows without an id; rows that share an id stay or go
    together; an empty table stays empty. All columns are passed on, whatever their names.
    """
    name = "_gone"
    while name in docs.columns:
        name += "_"
    gone = near_duplicates(docs, percent, id_col, text_col).filter("not kept").select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(name), "left_anti")
