"""SentencePiece BPE encoding by prefix tables, and decoding.

For every prefix of a segment there is one token that ends its BPE encoding. The table of these last
tokens is filled from left to right: an automaton lists the pieces that end at a position, and a
piece is the last token there when it is compatible with the last token of the prefix before it,
that is when merging the two pieces' text by the model's rules gives back just those two. The ids
then follow backwards from the end of the table. Work is linear in the text; only segments are held.

Texts are cut where no piece of the vocabulary spans the two characters, so segments are encoded on
their own and repeated ones are remembered in a bounded table. Pieces that share their score with
another piece (runs of spaces in the model used) are ordered by position rather than by piece, so
for a segment that holds two spaces in a row the merges are replayed one by one instead.

Null and empty texts have no ids and decode to an empty text; texts of any length are read whole;
repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import pick, slices

SPACE = "▁"
CACHE_WORDS = 500_000
#: Characters and ids that the remembered words and segments may hold together, so that long ones are bounded too.
CACHE_ROOM = 64_000_000


class PrefixTableEncoder:
    """Encodes texts to ids exactly as the model's library does."""

    def __init__(self, model: bytes, cache_words: int = CACHE_WORDS) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib = self.library
        self.rank: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        spans = set()
        self.automaton = ahocorasick.Automaton()
        for i in range(lib.vocab_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.id_of[piece] = i
                self.rank[piece] = -lib.get_score(i)
                self.automaton.add_word(piece, piece)
                spans.update(zip(piece, piece[1:], strict=False))
        self.automaton.make_automaton()
        self.spans = spans
        self.chars = {p for p in self.id_of if len(p) == 1}
        ranks = sorted(self.rank.values())
        twice = {a for a, b in zip(ranks, ranks[1:], strict=False) if a == b}
        self.tied = [p for p, r in self.rank.items() if r in twice and len(p) > 1]
        self.tied_spaces_only = all(set(p) == {SPACE} for p in self.tied)
        self.words: dict[str, tuple[tuple[int, ...], str]] = {}
        self.segments: dict[str, tuple[int, ...]] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.cache_words = cache_words
        self.room = CACHE_ROOM

    def _remember(self, cache: dict, key: str, value: tuple, size: int) -> None:
        """Keeps a result while there is room for it."""
        if len(cache) < self.cache_words and size <= self.room:
            self.room -= size
            cache[key] = value

    def merge(self, text: str) -> list[str]:
        """Replays the merges: the best-ranked adjacent pair first, the leftmost of equals."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two tokens stay as they are when their text is encoded."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            known = self.merge(left + right) == ([left, right] if left else [right])
            if len(self.fits) < 4 * self.cache_words:
                self.fits[key] = known
        return known

    def tokens(self, segment: str) -> list[str]:
        """The tokens of one segment, read back from its table of last tokens."""
        last = [""] * (len(segment) + 1)
        fits = self.fits
        if self.chars.issuperset(segment):
            for end, piece in self.automaton.iter(segment):
                if last[end + 1]:
                    continue
                start = end + 1 - len(piece)
                left = last[start]
                if left or not start:
                    fit = fits.get((left, piece))
                    if fit or (fit is None and self.compatible(left, piece)):
                        last[end + 1] = piece
        else:
            self._fill_with_unknown(segment, last)
        out, at = [], len(segment)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def _fill_with_unknown(self, segment: str, last: list[str]) -> None:
        ends: dict[int, list[str]] = {}
        for end, piece in self.automaton.iter(segment):
            ends.setdefault(end, []).append(piece)
        for end, char in enumerate(segment):
            for piece in [*ends.get(end, ()), char]:
                start = end + 1 - len(piece)
                if (start == 0 or last[start]) and self.compatible(last[start], piece):
                    last[end + 1] = piece
                    break

    def _ids(self, tokens: Iterable[str]) -> tuple[int, ...]:
        out: list[int] = []
        for token in tokens:
            known = self.id_of.get(token)
            if known is not None:
                out.append(known)
            elif self.byte_id:
                out.extend(self.byte_id[b] for b in token.encode())
            else:
                out.append(self.library.unk_id())
        return tuple(out)

    def segment_ids(self, segment: str) -> tuple[int, ...]:
        """Ids of a text that has no space after its first character that is not one."""
        spaced = SPACE * 2 in segment or not self.tied_spaces_only
        out: list[int] = []
        for part in self.parts(segment):
            known = self.segments.get(part)
            if known is None:
                known = self._ids(replay(part, self.rank) if spaced else self.tokens(part))
                self._remember(self.segments, part, known, len(part) + 2 * len(known))
            out += known
        return tuple(out)

    def parts(self, segment: str) -> list[str]:
        """The segment cut wherever no piece holds the two characters in a row."""
        spans, out, at = self.spans, [], 0
        for k, pair in enumerate(zip(segment, segment[1:], strict=False), 1):
            if pair not in spans:
                out.append(segment[at:k])
                at = k
        out.append(segment[at:])
        return out

    def _word(self, word: str) -> tuple[tuple[int, ...], str]:
        ids = self.segment_ids(SPACE + word)
        out = (ids, ",".join(map(str, ids)))
        self._remember(self.words, word, out, len(word) + 2 * len(ids) + len(out[1]))
        return out

    def encode(self, text: str) -> tuple[list[int], str]:
        """The ids of a whole text, as a list and as decimals joined by commas."""
        if not text:
            return [], ""
        words = text.split(" ")
        if "" in words or SPACE in text or "\0" in text:
            return self._encode_spaced(text)
        get, make = self.words.get, self._word
        found = [get(w) or make(w) for w in words]
        return list(chain.from_iterable([f[0] for f in found])), ",".join([f[1] for f in found])

    def _encode_spaced(self, text: str) -> tuple[list[int], str]:
        whole = self.library.normalize(text)
        starts = [0, *(k for k in range(1, len(whole)) if whole[k] == SPACE and whole[k - 1] != SPACE), len(whole)]
        ids = list(chain.from_iterable(self.segment_ids(whole[a:b]) for a, b in zip(starts, starts[1:], strict=False)))
        return ids, ",".join(map(str, ids))

    def decode(self, ids: list[int]) -> str:
        """The library's own decoding of the ids."""
        return self.library.decode(ids) if ids else ""


_ENCODERS: dict[int, PrefixTableEncoder] = {}


def process_encoder(model: bytes) -> PrefixTableEncoder:
    """One encoder per model and Python process, so that its tables outlive a task."""
    key = hash(model)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PrefixTableEncoder(model)
    return _ENCODERS[key]


def replay(text: str, rank: dict[str, float]) -> list[str]:
    """The merges of one text by a heap over a linked list, for texts of any length."""
    import heapq

    n = len(text)
    part: list[str | None] = list(text)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[float, int, int, str]] = []

    def offer(a: int, b: int) -> None:
        both = part[a] + part[b]
        r = rank.get(both)
        if r is not None:
            heapq.heappush(heap, (r, a, b, both))

    for k in range(n - 1):
        offer(k, k + 1)
    while heap:
        _, a, b, both = heapq.heappop(heap)
        if part[a] is None or part[b] is None or after[a] != b or part[a] + part[b] != both:
            continue
        part[a], part[b] = both, None
        after[a] = after[b]
        if after[b] >= 0:
            before[after[b]] = a
            offer(a, after[a])
        if before[a] >= 0:
            offer(before[a], a)
    return [p for p in part if p is not None]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, the ids and the decoded text.

    The model file is read on the driver and sent to the executors once; its size is that of the
    vocabulary.
    """
    d = pick(docs, [id_col, text_col])
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = process_encoder(model.value)
        for batch in slices(batches):
            out: dict[str, list] = {k: [] for k in ("n", "i", "d", "ids", "text")}
            for text in batch.column(1).to_pylist():
                ids, joined = coder.encode(text or "")
                back = coder.decode(ids)
                out["n"].append(len(ids))
                out["i"].append(hashlib.sha256(joined.encode()).hexdigest())
                out["d"].append(hashlib.sha256(back.encode()).hexdigest())
                if keep_ids:
                    out["ids"].append(ids)
                    out["text"].append(back)
            cols = [batch.column(0), pa.array(out["n"], pa.int64()), pa.array(out["i"], pa.string()), pa.array(out["d"], pa.string())]
            if keep_ids:
                cols += [pa.array(out["ids"], pa.list_(pa.int32())), pa.array(out["text"], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = d.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if keep_ids else [])
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")
    return d.mapInArrow(run, schema)
