"""Keyword anchors: time-interpolated hits and their one-to-one merge over two sources."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechmart.dims import ANCHOR_EQUIVALENTS
from speechmart.functions.grammar import located_words
from speechmart.functions.text import literal_map
from speechmart.operators.ranking import fresh, numbered_runs, positions
from speechmart.sources.shared import materialize

ANCHOR = "word string, time double, source string, confidence double, chunk_text string"


def anchor_hits(chunks: DataFrame, keywords: list[str], source: str, stem: str = "audio_stem") -> DataFrame:
    """Every keyword in every chunk, at the time its offset in the text suggests.

    Discovery order is (chunk_idx, keyword_idx, offset). The keyword list is a parameter of the
    query and of bounded size, so it is looked up as a constant.
    """
    table = F.create_map(*[x for k, w in enumerate(keywords) for x in (F.lit(w), F.lit(k))])
    tokens = chunks.select(stem, "chunk_idx", "start", F.coalesce("end", F.col("start") + 10).alias("end"), "text", F.explode(located_words(F.col("text"), keywords)).alias("t"))
    found = tokens.withColumn("keyword_idx", F.try_element_at(table, F.col("t.word"))).filter("keyword_idx is not null")
    at = F.col("start") + (F.col("end") - F.col("start")) * F.col("t.position") / F.length("text")
    return found.select(
        stem,
        "chunk_idx",
        "keyword_idx",
        F.col("t.position").alias("offset"),
        F.col("t.word").alias("word"),
        at.alias("time"),
        F.lit(source).alias("source"),
        F.lit(0.5).alias("confidence"),
        F.substring("text", 1, 100).alias("chunk_text"),
    )


def same_anchor(a: Column, b: Column, equivalents: dict[str, str] | None = None) -> Column:
    table = literal_map(ANCHOR_EQUIVALENTS if equivalents is None else equivalents)
    return (a == b) | F.coalesce(F.try_element_at(table, a) == b, F.lit(False)) | F.coalesce(F.try_element_at(table, b) == a, F.lit(False))


def anchor_candidates(left: DataFrame, right: DataFrame, tolerance: float = 2.0, equivalents: dict[str, str] | None = None, stem: str = "audio_stem") -> DataFrame:
    """All pairs of one file that may be merged: an interval join with the file and time cells as keys."""
    cell = F.floor(F.col("time") / tolerance)
    a = left.select(stem, F.col("word").alias("l_word"), F.col("time").alias("l_time"), cell.alias("cell"))
    b = right.select(stem, F.col("word").alias("r_word"), F.col("time").alias("r_time"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    near = (F.abs(F.col("l_time") - F.col("r_time")) <= tolerance) & same_anchor(F.col("l_word"), F.col("r_word"), equivalents)
    return a.join(b, [stem, "cell"]).filter(near).select(stem, "l_word", "l_time", "r_word", "r_time")


def _components(equivalents: dict[str, str]) -> dict[str, str]:
    """Each word of the map to one word of all that it is tied to, however indirectly."""
    top: dict[str, str] = {}

    def find(w: str) -> str:
        while top.setdefault(w, w) != w:
            w = top[w]
        return w

    for x, y in equivalents.items():
        top[find(x)] = find(y)
    return {w: find(w) for w in list(top)}


class FirstFree:
    """Right anchors of one word by time: the earliest discovered one in a range that is not taken yet."""

    def __init__(self, entries: list[tuple[float, int]]) -> None:
        entries.sort()
        self.times = [t for t, _ in entries]
        self.place = {rank: n for n, (_, rank) in enumerate(entries)}
        self.size = len(entries)
        self.none = 1 << 62
        self.least = [self.none] * self.size + [rank for _, rank in entries]
        for n in range(self.size - 1, 0, -1):
            self.least[n] = min(self.least[2 * n], self.least[2 * n + 1])

    def find(self, time: float, tolerance: float) -> int:
        a = bisect.bisect_left(self.times, True, key=lambda r: r >= time or time - r <= tolerance) + self.size
        b = bisect.bisect_left(self.times, True, key=lambda r: r > time and r - time > tolerance) + self.size
        best, least = self.none, self.least
        while a < b:
            if a & 1:
                best, a = min(best, least[a]), a + 1
            if b & 1:
                b -= 1
                best = min(best, least[b])
            a, b = a >> 1, b >> 1
        return best

    def take(self, rank: int) -> None:
        n, least = self.place[rank] + self.size, self.least
        least[n] = self.none
        while n > 1:
            n >>= 1
            least[n] = min(least[2 * n], least[2 * n + 1])


def first_fit(left: list[tuple[str, float]], right: list[tuple[str, float]], tolerance: float, partners: dict[str, set[str]]) -> list[int | None]:
    """For every left (word, time), in order, the place of the first right one that fits and is free."""
    by_word: dict[str, list[tuple[float, int]]] = {}
    for rank, (word, time) in enumerate(right):
        if time == time and time is not None:
            by_word.setdefault(word, []).append((time, rank))
    free = {w: FirstFree(e) for w, e in by_word.items()}
    out: list[int | None] = []
    for word, time in left:
        known = [free[w] for w in {word} | partners.get(word, set()) if w in free] if time == time and time is not None else []
        best, where = min(((f.find(time, tolerance), n) for n, f in enumerate(known)), default=(1 << 62, 0))
        if best < 1 << 62:
            known[where].take(best)
            out.append(best)
        else:
            out.append(None)
    return out


def merge_anchors(left: DataFrame, right: DataFrame, tolerance: float = 2.0, equivalents: dict[str, str] | None = None, stem: str = "audio_stem") -> DataFrame:
    """First-fit merge in discovery order, one right anchor to one left anchor at most.

    Pairs take the mean time and 0.9, left ones alone 0.5, right ones alone 0.4. What a left anchor
    takes depends on those before it, but only on anchors of words tied to its own, and only within its
    island: anchors farther apart than the tolerance cannot meet, so a file's anchors are cut wherever
    tied ones leave such a gap, and islands are resolved on their own. In an island a tree over the times
    of each word's right anchors finds the first one that is free. Anchors without a time stay alone.
    """
    equal = ANCHOR_EQUIVALENTS if equivalents is None else equivalents
    partners: dict[str, set[str]] = {}
    for x, y in equal.items():
        partners.setdefault(x, set()).add(y)
        partners.setdefault(y, set()).add(x)
    kind = left.schema[stem].dataType.simpleString()
    order = ["chunk_idx", "keyword_idx", "offset"]
    tied = _components(equal)
    word_class = F.coalesce(F.try_element_at(literal_map(tied), F.col("word")), F.col("word")) if tied else F.col("word")
    need = [stem, *order, "word", "time", "chunk_text"]
    both = fresh(left.select(*need)).withColumn("_side", F.lit(0)).unionByName(fresh(right.select(*need)).withColumn("_side", F.lit(1)))
    keyed = both.withColumn("_f", F.coalesce(F.concat(F.lit("="), F.col(f"`{stem}`").cast("string")), F.lit("-"))).withColumn("_class", word_class)
    keyed = materialize(keyed, "hits")  # else the hits would be found again to choose the ranges
    islands = numbered_runs(keyed, ["_f", "_class"], ["time"], ["time"], lambda own, before: own("time") - before("time") > tolerance, "_island")
    names = ["_f", "_class", "_island"]
    out = [stem, "word", "time", "source", "confidence", "chunk_text", "_late", *order]

    def resolved(rows: list[tuple]) -> list[tuple]:
        a, b = [r for r in rows if not r[0]], [r for r in rows if r[0]]
        hits = first_fit([(r[5], r[6]) for r in a], [(r[5], r[6]) for r in b], tolerance, partners) if a and b else [None] * len(a)
        used, done = set(), []
        for r, hit in zip(a, hits, strict=True):
            if hit is None:
                done.append((r[1], r[5], r[6], "mms", 0.5, r[7], 0, *r[2:5]))
            else:
                used.add(hit)
                done.append((r[1], r[5], (r[6] + b[hit][6]) / 2, "both", 0.9, r[7] or b[hit][7], 0, *r[2:5]))
        return done + [(r[1], r[5], r[6], "whisper_en", 0.4, r[7], 1, *r[2:5]) for n, r in enumerate(b) if n not in used]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        island, rows, done = None, [], []
        for pdf in batches:
            columns = [pdf[c].tolist() for c in (*names, "_side", stem, *order, "word", "time", "chunk_text")]
            for at, *row in zip(zip(*columns[:3], strict=True), *columns[3:], strict=True):
                if at != island:
                    done += resolved(rows)
                    island, rows = at, []
                    if len(done) >= 10_000:
                        yield pd.DataFrame(done, columns=out)
                        done = []
                rows.append(tuple(row))
        done += resolved(rows)
        if done:
            yield pd.DataFrame(done, columns=out)

    placed = islands.repartition(*names).sortWithinPartitions(*names, "_side", *order)
    types = ", ".join(f"{c} {left.schema[c].dataType.simpleString()}" for c in order)
    merged = materialize(placed.mapInPandas(run, f"`{stem}` {kind}, {ANCHOR}, _late int, {types}"), "merged")
    numbered = positions(merged, [stem], ["time", "_late", *order], "anchor_idx")
    return numbered.select(stem, F.col("anchor_idx").cast("int").alias("anchor_idx"), "word", "time", "source", "confidence", "chunk_text")


def anchor_counts(anchors: DataFrame, stem: str = "audio_stem", least: float = 0.7) -> DataFrame:
    """Anchors and high-confidence anchors of every file."""
    return anchors.groupBy(stem).agg(F.count("*").alias("anchors"), F.count_if(F.col("confidence") >= least).alias("high_confidence"))
