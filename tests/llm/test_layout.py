from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from speechmart.llm import common, exact_dedup, packing, sharding

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_plan_places_every_piece_without_gaps():
    rng = random.Random(3)
    cases = [{700: 900}, {1023: 51, 1: 3}, {}, {5: 1}, {i: rng.randint(0, 5) for i in range(1, 1024)}, {i: rng.randint(0, 3) for i in range(600, 1024)}]
    for histogram in cases:
        plan, windows = packing.Plan(histogram), defaultdict(list)
        for length, n in histogram.items():
            for rank in range(n):
                at = 0
                for start, size, window, offset in plan.places(length, rank):
                    assert start == at
                    at += size
                    windows[window].append((offset, size))
                assert at == length
        for parts in windows.values():
            at = 0
            for offset, size in sorted(parts):
                assert offset == at
                at += size
            assert at <= 1024
        assert sorted(windows) == list(range(plan.windows))
        total = sum(k * n for k, n in histogram.items())
        assert plan.windows == -(-total // 1024)


def test_best_fill_is_optimal():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(6)}
        room = rng.randint(1, 60)
        reach = {0}
        for length, n in counts.items():
            reach = {r + k * length for r in reach for k in range(n + 1) if r + k * length <= room}
        total, used = packing.best_fill(counts, room)
        assert total == max(reach) == sum(k * n for k, n in used.items())
        assert all(n <= counts[k] for k, n in used.items())


def test_cached_tokenizer_equals_the_library(monkeypatch):
    with open(VOCABULARY, encoding="utf-8") as f:
        coder = packing.WordCachedTokenizer(f.read(), cache_room=10_000)
    library, rng = Tokenizer.from_file(VOCABULARY), random.Random(9)
    bits = [*"ab'st  \n\t.,!é1中 ", "<|endoftext|>", "<|endof", " word", " two words"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(4000)]
    for text in [*texts, "a <|endoftext|> b", "<|endoftext|>", "a<|endoftext|><|endoftext|>b c"]:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert library.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]


def test_packing_query(odd_docs, no_docs):
    library = Tokenizer.from_file(VOCABULARY)
    rows = packing.pack_documents(odd_docs, VOCABULARY).collect()
    want = sorted((r["doc_id"] or 0, [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in odd_docs.collect())
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"] or 0].append(r)
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(len(ids) for _, ids in want) == sum(r["length"] for r in rows)
    for doc, ids in want:
        raw = np.array(ids, "<u4").tobytes()
        for r in pieces[doc]:
            assert r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(raw[4 * r["start"] : 4 * (r["start"] + r["length"])])
    for parts in windows.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 1024
    assert sum(1024 - sum(s for _, s in p) for p in windows.values()) < 1024
    assert packing.pack_documents(no_docs, VOCABULARY).count() == 0


def check_shards(rows, docs, n_shards):
    """Every row once, with its own size and digest, one shard per virtual slot, places gapless in each shard."""
    want = sorted(((r["doc_id"] is None, r["doc_id"] or 0), len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["size"], r["text_crc32"]) for r in rows) == want
    by, shard_of = defaultdict(list), {}
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert shard_of.setdefault(r["virtual_slot"], r["shard"]) == r["shard"] < n_shards
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    return shard_of


def test_shards(odd_docs, no_docs):
    assert check_shards(sharding.shard_documents(odd_docs).collect(), odd_docs.collect(), 8)
    assert sharding.shard_documents(no_docs).count() == 0


def test_shards_follow_the_stored_versions(spark, tmp_path):
    rng, path = random.Random(3), str(tmp_path / "map")
    texts = ["hot copy"] * 1500 + ["x" * rng.randint(0, 400) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    docs = df.collect()
    rows = sharding.shard_documents(df, map_path=path).collect()
    placed = check_shards(rows, docs, 8)
    assert {r["map_version"] for r in rows} == {2}
    assert sharding.load_map(spark, path, 1) == (1, [s % 8 for s in range(4096)])
    version, shards = sharding.load_map(spark, path)
    assert version == 2 and all(shards[v] == s for v, s in placed.items())
    load = defaultdict(int)
    for r in rows:
        load[r["shard"]] += r["size"]
    assert len(load) == 8 and max(load.values()) - min(load.values()) < 0.01 * sum(load.values()) / 8
    # the hot text is spread over all shards
    hot = defaultdict(int)
    for r in rows:
        hot[r["shard"]] += r["text_crc32"] == zlib.crc32(b"hot copy")
    assert min(hot.values()) > 100
    # the same rows again: nothing moves, no version is added
    assert {r["map_version"] for r in sharding.shard_documents(df, map_path=path).collect()} == {2}
    # one more shard: version 3, and rows only move into the new shard
    grown = sharding.shard_documents(df, n_shards=9, map_path=path).collect()
    moved = check_shards(grown, docs, 9)
    assert {r["map_version"] for r in grown} == {3}
    assert all(s in (placed[v], 8) for v, s in moved.items()) and 8 in moved.values()
    # an older version still places rows as it did
    again = sharding.shard_documents(df, map_path=path, map_version=2).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_rebalancing_moves_little():
    rng = random.Random(6)
    slot_bytes = {s: rng.randint(1000, 3000) for s in range(4096)}
    old = sharding.rebalance(sharding.first_map(8), slot_bytes, 8)
    loads = [sum(b for s, b in slot_bytes.items() if old[s] == k) for k in range(8)]
    assert max(loads) - min(loads) < 3000
    new = sharding.rebalance(old, slot_bytes, 9)
    moved = [s for s in range(4096) if new[s] != old[s]]
    assert moved and all(new[s] == 8 for s in moved)
    loads = [sum(b for s, b in slot_bytes.items() if new[s] == k) for k in range(9)]
    assert max(loads) < 1.02 * sum(loads) / 9
    gone = sharding.rebalance(new, slot_bytes, 7)
    assert max(gone) == 6 and all(gone[s] == new[s] or new[s] >= 7 or gone[s] < 7 for s in range(4096))


def test_cuckoo_index_inserts_deletes_and_grows():
    rng = random.Random(1)
    index, keys = exact_dedup.CuckooIndex(8), [rng.randbytes(32) for _ in range(3000)]
    for k, key in enumerate(keys):
        assert index.find(key) is None
        index.insert(key, [k])
    # misses were told by the filter: hardly any stored digest was read
    assert index.reads < 60 and index.resizes > 0
    assert all(index.find(key) == [k] for k, key in enumerate(keys))
    for key in keys[::2]:
        index.delete(key)
    assert all(index.find(key) is None for key in keys[::2]) and all(index.find(key) for key in keys[1::2])
    assert all(index.maybe(key) for key in keys[1::2])
    for k, key in enumerate(keys[::2]):  # deleted digests come back, through further resizings
        index.insert(key, [-k])
    for k in range(6000):
        index.insert(rng.randbytes(32), [k])
    assert all(index.find(key) == [-k] for k, key in enumerate(keys[::2])) and len(index.keys) == 9000


def test_fingerprint_clashes_are_verified():
    """Digests that share fingerprint and buckets are told apart by what is stored."""
    index, keys = exact_dedup.CuckooIndex(8), [bytes(10) + bytes([k]) * 22 for k in range(7)]
    for k, key in enumerate(keys):
        assert index.find(key) is None
        index.insert(key, [k])
    index.delete(keys[3])
    assert [index.find(key) for key in keys] == [[0], [1], [2], None, [4], [5], [6]]


def test_buckets_overflow_and_replace_owners(spark):
    """One bucket of the query: its filter grows, and better owners replace live ones; results as by brute force."""
    rng = random.Random(2)
    shas = [rng.randbytes(32).hex() for _ in range(900)]
    rows = [(salt, sha, rng.random() < 0.9, rng.randint(0, 50), k, rng.randint(1, 9)) for k, (salt, sha) in enumerate((s, x) for s in range(6) for x in shas)]
    rng.shuffle(rows)
    pdf = pd.DataFrame(rows, columns=["salt", "text_sha256", "has_id", "top_id", "top_rid", "n"])
    got = exact_dedup._resolve(pdf)
    best, size = {}, defaultdict(int)
    for _, sha, *owner, n in rows:
        best[sha] = max(best.get(sha, (False, 0, -1)), tuple(owner))
        size[sha] += n
    assert [(sha, h, t, r, n) for _, sha, h, t, r, n in got.itertuples(index=False)] == [(sha, *best[sha], size[sha]) for _, sha, *_ in rows]


def test_exact_dedup(odd_docs, no_docs):
    def fold(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")

    groups = defaultdict(list)
    for r in odd_docs.collect():
        groups[fold(r["text"])].append(r["doc_id"])
    rows = exact_dedup.dedup_exact(odd_docs, bucket_rows=2).collect()
    assert len(rows) == odd_docs.count() and sum(r["kept"] for r in rows) == len(groups)
    size = {i: (max((x for x in ids if x is not None), default=None), len(ids)) for ids in groups.values() for i in ids}
    assert all((r["keep_id"], r["group_size"]) == size[r["doc_id"]] for r in rows)
    kept = exact_dedup.keep_first_texts(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(groups)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rows if r["kept"])
    assert exact_dedup.keep_first_texts(no_docs).count() == 0
    assert exact_dedup.dedup_exact(no_docs).count() == 0


def test_rows_equal_in_id_and_text_keep_their_greatest_columns(spark):
    rows = [(1, "A", 3, {"k": 1}), (1, "a", 7, {"k": 2}), (1, "a", 5, None), (None, "b", 1, None), (None, "b", 2, None), (0, "c", 9, None), (None, "c", 99, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _sha int, extra map<string,int>").repartition(3)
    got = sorted(((r["doc_id"], r["text"], r["_sha"]) for r in exact_dedup.keep_first_texts(df).collect()), key=str)
    assert got == [(0, "c", 9), (1, "a", 7), (None, "b", 2)]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default if key == "spark.checkpoint.dir" else "/machine/warehouse"

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        common.shared_dir(Session())
    Session.sparkContext.master = "local[2]"
    assert common.shared_dir(Session()) == "/machine/warehouse/scratch-tables"
