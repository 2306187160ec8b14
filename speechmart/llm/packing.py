"""Packing documents into fixed windows by minimum bin slack.

Every document is cut into full windows and one remaining piece. The remaining lengths form a
histogram with fewer entries than a window has tokens, however large the corpus is, and the plan is
made on that histogram alone: take the longest remaining length, find by a bitset subset-sum over
the other lengths the multiset that fills the window closest to its capacity, walk the bitsets back
for the counts, and repeat that pattern as often as the histogram allows. Where the best filling
still leaves slack, one further piece is cut to fill it, since cuts are free; its rest goes back to
the histogram. So every window but the last is full.

Each piece finds its place from its length and its rank among the pieces of that length. Ranks come
from per-chunk counts and their running sums, never from a sort of all pieces of a length.

Null and empty texts hold the end id alone; texts are read whole; repeated rows are packed each;
an empty table gives an empty result; columns other than the two named are not read.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
import zlib
from collections import defaultdict, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import materialize, pick, slices

CAPACITY = 1024
#: Bytes that a process may spend on remembered words, and what one takes besides its letters and ids.
CACHE_ROOM, WORD_COST = 24_000_000, 32
#: Letters of texts that are encoded together, and words that are laid out at once.
TOGETHER, LAID = 4_000_000, 1 << 18
#: Two marks of white space in a row, between which the pattern may join or split.
_SPACES = re.compile(r"\s\s")
#: Letters with marks behind them, to which the pattern never joins those.
_MARKED = "^(?P<head>\n?[A-Za-zÀ-ÖØ-öø-ɏЀ-ҁҊ-ӿ]+)(?P<tail>[.,!?;:*#$%&|]+)$"


class Ids:
    """Runs of ids, one after the other."""

    def __init__(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.flat, self.size = flat, size

    @classmethod
    def of(cls, runs: list[list[int]]) -> Ids:
        return cls(np.fromiter(itertools.chain.from_iterable(runs), "<u4"), np.fromiter(map(len, runs), np.int64, len(runs)))

    @classmethod
    def joined(cls, parts: list[Ids]) -> Ids:
        return cls(np.concatenate([p.flat for p in parts]), np.concatenate([p.size for p in parts]))

    def take(self, codes: np.ndarray) -> Ids:
        """The runs of these numbers."""
        size, at = self.size[codes], np.cumsum(self.size) - self.size
        out, done = np.empty(size.sum(), "<u4"), 0
        for k in range(0, len(codes), LAID):
            n = size[k : k + LAID]
            laid = self.flat[np.repeat(at[codes[k : k + LAID]] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            out[done : done + len(laid)] = laid
            done += len(laid)
        return Ids(out, size)


class WordCachedTokenizer:
    """Ids of whole texts by the ``tokenizers`` library, with repeated words remembered.

    The byte-level pattern never joins two words at a single space or line's end, so " word" and "\\nword"
    are encoded on their own; texts with more white space in a row or at an end, or with one of the
    vocabulary's added tokens in them, are given to the library whole. The words of many texts are
    numbered together, and each distinct one is looked up once. A word that follows a line's end begins
    with it; a space before a word is left out.
    """

    def __init__(self, vocabulary: str, cache_room: int = CACHE_ROOM) -> None:
        self.library = Tokenizer.from_str(vocabulary)
        #: Strings that the library gives one id of their own, wherever they stand in a text.
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        pieces = self.library.get_vocab(with_added_tokens=True)
        #: Whether an id begins with a space (Ġ), and the id of a line's end (Ċ).
        self.spaced = np.zeros(max(pieces.values()) + 1, bool)
        self.spaced[[n for piece, n in pieces.items() if piece.startswith("Ġ")]] = True
        self.line = pieces["Ċ"]
        self.words, self.ids = pa.array([], pa.large_string()), Ids.of([])
        self.room = cache_room

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> Ids:
        """Ids of words in one call: each is found again by the id that begins with its space or line's end."""
        after = np.array([w[0] == "\n" for w in words], bool)
        spaced = np.array(self._encode(["".join([" " + w for w in words if w[0] != "\n"])])[0], "<u4")
        lined = np.array(self._encode(["".join([w for w in words if w[0] == "\n"])])[0], "<u4")
        begins = [np.flatnonzero(self.spaced[spaced]), np.flatnonzero(lined == self.line)]
        sizes = [np.diff(begins[0], append=len(spaced)), np.diff(begins[1], append=len(lined))]
        codes = np.empty(len(words), np.int64)
        codes[~after] = np.arange(len(sizes[0]))
        codes[after] = len(sizes[0]) + np.arange(len(sizes[1]))
        return Ids(np.concatenate([spaced, lined]), np.concatenate(sizes)).take(codes)

    def _look_up(self, words: pa.Array) -> tuple[Ids, np.ndarray]:
        """Runs of ids, and for each of these distinct words the number of its own."""
        codes = _indices(words, self.words)
        missing = np.flatnonzero(codes < 0)
        if not len(missing):
            return self.ids, codes
        whole = words.take(pa.array(missing))
        cut = pc.extract_regex(whole, _MARKED)
        heads = pc.coalesce(pc.struct_field(cut, "head"), whole).dictionary_encode()
        tails = pc.fill_null(pc.struct_field(cut, "tail"), "").dictionary_encode()
        head_codes = _indices(heads.dictionary, self.words)
        new = np.flatnonzero(head_codes < 0)
        head_codes[new] = len(self.words) + np.arange(len(new))
        asked = heads.dictionary.take(pa.array(new))
        got = self._encode_words(asked.to_pylist())
        marks = Ids.of(self._encode(tails.dictionary.to_pylist()))
        known = Ids.joined([self.ids, got, marks])
        marks_from = len(self.words) + len(new)
        pairs = np.column_stack([head_codes[heads.indices.to_numpy()], marks_from + tails.indices.to_numpy()])
        both = known.take(pairs.ravel())
        codes[missing] = len(known.size) + np.arange(len(missing))
        self._remember(asked, got)
        return Ids.joined([known, Ids(both.flat, both.size.reshape(-1, 2).sum(axis=1))]), codes

    def _remember(self, words: pa.Array, ids: Ids) -> None:
        """New words stay while there is room for them."""
        cost = np.cumsum(WORD_COST + pc.binary_length(words).to_numpy() + 4 * ids.size)
        n = int(np.searchsorted(cost, self.room, "right"))
        if n:
            self.room -= int(cost[n - 1])
            self.words = pa.concat_arrays([self.words, words[:n]])
            self.ids = Ids.joined([self.ids, Ids(ids.flat[: ids.size[:n].sum()], ids.size[:n])])

    def _encode_group(self, texts: list[str]) -> Iterator[bytes]:
        odd = [not t or t[0].isspace() or t[-1].isspace() or bool(_SPACES.search(t)) or any(a in t for a in self.added) for t in texts]
        plain = pa.array(["" if o else t for o, t in zip(odd, texts, strict=True)], pa.large_string())
        split = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        # nothing stands before the first word
        firsts = self._encode(pc.list_element(split, 0).to_pylist())
        for n in np.flatnonzero(odd).tolist():
            firsts[n] = self._encode([texts[n]])[0]
        rest = pc.list_slice(split, 1)
        counts = rest.value_lengths().to_numpy()
        words = rest.flatten().dictionary_encode()
        ids, codes = self._look_up(words.dictionary)
        places = np.insert(codes[words.indices.to_numpy()], np.cumsum(counts) - counts, len(ids.size) + np.arange(len(texts)))
        laid = Ids.joined([ids, Ids.of(firsts)]).take(places)
        start = 0
        for end in np.cumsum(laid.size)[np.cumsum(counts + 1) - 1].tolist():
            yield laid.flat[start:end].tobytes()
            start = end

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of every text, in order."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._encode_group(group)
                group, size = [], 0
        if group:
            yield from self._encode_group(group)

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        return next(self.encode_all([text]))


def _indices(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Places of words in another array; -1 where they are not in it."""
    return pc.fill_null(pc.index_in(words, value_set=among), -1).to_numpy().astype(np.int64)


_TOKENIZERS: dict[int, WordCachedTokenizer] = {}


def process_tokenizer(vocabulary: str) -> WordCachedTokenizer:
    """One tokenizer per Python process."""
    key = hash(vocabulary)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = WordCachedTokenizer(vocabulary)
    return _TOKENIZERS[key]


def best_fill(counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to ``room`` of a multiset within ``counts``, and its counts."""
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int]] = []
    for length in sorted((x for x in counts if x <= room and counts[x] > 0), reverse=True):
        steps.append((length, reach))
        for _ in range(min(counts[length], room // length)):
            more = reach | (reach << length) & mask
            if more == reach:
                break
            reach = more
        if reach >> room & 1:
            break
    total = at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, before in reversed(steps):
        while not before >> at & 1:
            at -= length
            used[length] = used.get(length, 0) + 1
    return total, used


class Plan:
    """Places for all remaining pieces, from the histogram of their lengths.

    ``rules`` is keyed by (length, start): what happens to the part of a piece of that length from
    ``start`` on. A rule is (first rank, first member, members per window, first window, offset,
    length, cut, first rank of the rest).
    """

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.rules: dict[tuple[int, int], list[tuple]] = defaultdict(list)
        self.windows = 0
        self.padded: list[int] = []
        self._made: dict[tuple[int, int], int] = defaultdict(int)
        self._stock: dict[int, deque] = defaultdict(deque)
        self._counts: dict[int, int] = {}
        for length, n in histogram.items():
            if n > 0:
                self._add((length, 0), n)
        while self._counts:
            self._round()
        self.starts = {k: [r[0] for r in v] for k, v in self.rules.items()}
        del self._stock, self._counts, self._made

    def _add(self, part: tuple[int, int], n: int) -> int:
        first = self._made[part]
        self._made[part] += n
        left = part[0] - part[1]
        self._stock[left].append([part, first, n])
        self._counts[left] = self._counts.get(left, 0) + n
        return first

    def _take(self, left: int, n: int) -> Iterator[tuple[tuple[int, int], int, int]]:
        self._counts[left] -= n
        if not self._counts[left]:
            del self._counts[left]
        while n:
            part, first, there = self._stock[left][0]
            k = min(n, there)
            if k == there:
                self._stock[left].popleft()
            else:
                self._stock[left][0] = [part, first + k, there - k]
            n -= k
            yield part, first, k

    def _round(self) -> None:
        longest = max(self._counts)
        rest = dict(self._counts)
        rest[longest] -= 1
        filled, used = best_fill(rest, self.capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        slack = self.capacity - longest - filled
        times = min(self._counts[x] // m for x, m in used.items())
        cut = 0
        if slack:
            cut = max((x for x, n in self._counts.items() if x > slack and n > used.get(x, 0)), default=0)
            if cut:
                times = min(times, self._counts[cut] // (used.get(cut, 0) + 1))
            else:
                times = 1
                self.padded.append(self.capacity - slack)
        offset = 0
        for length in sorted(used, reverse=True):
            m, member = used[length], 0
            for part, first, k in list(self._take(length, m * times)):
                self.rules[part].append((first, member, m, self.windows, offset, length, 0, 0))
                member += k
            offset += m * length
        if cut:
            member = 0
            for part, first, k in list(self._take(cut, times)):
                rest_first = self._add((part[0], part[1] + slack), k)
                self.rules[part].append((first, member, 1, self.windows, offset, slack, slack, rest_first))
                member += k
        self.windows += times

    def places(self, length: int, rank: int) -> Iterator[tuple[int, int, int, int]]:
        """(start in the piece, length, window, offset) of the parts of one piece."""
        start = 0
        while True:
            key = (length, start)
            first, member, m, window, offset, size, cut, rest = self.rules[key][bisect.bisect_right(self.starts[key], rank) - 1]
            at = member + rank - first
            yield start, size, window + at // m, offset + at % m * size
            if not cut:
                return
            start += cut
            rank = rest + rank - first


def pack_documents(
    docs: DataFrame,
    vocabulary_path: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Ranks are counted once per written chunk; the plan is broadcast and is bounded by the window,
    not by the corpus.
    """
    spark = docs.sparkSession
    d = pick(docs, [id_col, text_col])
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    kind = d.schema[id_col].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["id", "chunk", "doc_tokens", "crcs", "first_window", "rest", "rank", "rest_ids"]

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = process_tokenizer(vocabulary.value)
        chunk, windows, ranks = TaskContext.get().partitionId(), 0, defaultdict(int)
        step = capacity * 4
        for batch in slices(batches):
            out: dict[str, list] = {n: [] for n in names[2:]}
            for ids in coder.encode_all(text or "" for text in batch.column(1).to_pylist()):
                ids += end
                full = len(ids) // step
                rest = len(ids) // 4 - full * capacity
                out["doc_tokens"].append(len(ids) // 4)
                out["crcs"].append([zlib.crc32(ids[k * step : (k + 1) * step]) for k in range(full)])
                out["first_window"].append(windows)
                out["rest"].append(rest)
                out["rank"].append(ranks[rest])
                out["rest_ids"].append(ids[full * step :])
                windows += full
                ranks[rest] += 1
            types = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            cols = [pa.array(out[n], t) for n, t in zip(names[2:], types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([chunk] * batch.num_rows, pa.int32()), *cols], names=names)

    tokens = materialize(
        d.mapInArrow(tokenize, f"id {kind}, chunk int, doc_tokens long, crcs array<long>, first_window long, rest int, rank long, rest_ids binary"),
        "pack-tokens",
    )
    counts = tokens.groupBy("rest", "chunk").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("rest").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(counts.select("rest", "chunk", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "pack-bases")
    histogram = {r["rest"]: r["n"] for r in bases.groupBy("rest").agg(F.sum("n").alias("n")).collect() if r["rest"]}
    plan = spark.sparkContext.broadcast(Plan(histogram, capacity))
    out_names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        for batch in slices(batches):
            at: list[int] = []
            out: dict[str, list] = {n: [] for n in out_names[1:]}

            def add(row: int, *values: int) -> None:
                at.append(row)
                for n, v in zip(out_names[1:], values, strict=True):
                    out[n].append(v)

            col = {n: batch.column(n).to_pylist() for n in batch.schema.names if n != "id"}
            for row in range(batch.num_rows):
                total, crcs, ids = col["doc_tokens"][row], col["crcs"][row], col["rest_ids"][row]
                for k, crc in enumerate(crcs):
                    sequence = ((col["chunk"][row] + 1) << 40) + col["first_window"][row] + k
                    add(row, k * capacity, capacity, crc, total, sequence, 0)
                if col["rest"][row]:
                    base = len(crcs) * capacity
                    for start, size, window, offset in p.places(col["rest"][row], col["base"][row] + col["rank"][row]):
                        add(row, base + start, size, zlib.crc32(ids[start * 4 : (start + size) * 4]), total, window, offset)
            cols = [pa.array(out[n], pa.int64()) for n in out_names[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), *cols], names=[id_col, *out_names[1:]])

    joined = tokens.join(bases.select("rest", "chunk", "base"), ["rest", "chunk"]).select("id", *names[1:], "base")
    return joined.mapInArrow(place, f"`{id_col}` {kind}, " + ", ".join(f"`{n}` long" for n in out_names[1:]))
