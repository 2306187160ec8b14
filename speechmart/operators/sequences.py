"""Matched sequences: transcript positions, candidates, increasing subsequences and their scores."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechmart.functions.text import match_key
from speechmart.operators.ranking import running
from speechmart.sources.shared import materialize

LEAST_LENGTH = 5


#: Words of a transcript that form one cell of positions.
CELL = 512


def keyword_positions(words: DataFrame, keywords: list[str], source: str) -> DataFrame:
    """source, word, word_idx of every keyword of a transcript. The list is a bounded parameter."""
    return words.select(source, match_key(F.col("word")).alias("word"), "word_idx").filter(F.col("word").isin(keywords))


def posting_blocks(words: DataFrame, keywords: list[str], source: str) -> DataFrame:
    """The inverted index of the keywords: source, word, cell, offsets.

    A row holds the positions of one word in one cell of ``CELL`` words, ascending and counted from the
    cell's first word, so no row grows with the transcript or with how common a word is.
    """
    hits = keyword_positions(words, keywords, source).withColumn("cell", _cell(F.col("word_idx")))
    offset = (F.col("word_idx") - F.col("cell") * CELL).cast("short")
    return hits.groupBy(source, "word", "cell").agg(F.sort_array(F.collect_list(offset)).alias("offsets"))


def positions_in(cell: str, offsets: str) -> Column:
    """The positions of a posting block."""
    return F.transform(offsets, lambda o: F.col(cell) * CELL + o)


def posted_positions(blocks: DataFrame, source: str) -> DataFrame:
    """source, word, word_idx of every posting."""
    return blocks.select(source, "word", F.explode(positions_in("cell", "offsets")).alias("word_idx"))


def position_hints(files: DataFrame, session: str = "session", order: tuple[str, ...] = ("day", "take")) -> DataFrame:
    """Expected word range of every file (session, audio, duration, total_words, order columns).

    Durations before a file come from ranges of files, and a session's total from an aggregate.
    """
    totals = files.groupBy(F.col(f"`{session}`").alias("_session")).agg(F.sum("duration").alias("_total"))
    placed = running(files, [session], list(order), {"elapsed": ("sum", F.col("duration"))}, own=False)
    placed = placed.join(totals, F.col(f"`{session}`").eqNullSafe(F.col("_session")))
    placed = placed.withColumn("wps", F.when(F.col("_total") > 0, F.col("total_words") / F.col("_total")).otherwise(2.0)).drop("_total", "_session")
    return placed.withColumn("hint_start", F.floor(F.col("elapsed") * F.col("wps")).cast("long")).withColumn(
        "hint_end", F.least(F.floor((F.col("elapsed") + F.col("duration")) * F.col("wps")), F.col("total_words")).cast("long")
    )


def _cell(position: Column) -> Column:
    return F.floor(position / CELL).cast("long")


def _around(misses: DataFrame, positions: DataFrame, source: str, nearest: int) -> DataFrame:
    """For every (source, word, hint_start) the ``nearest`` positions before it and after it.

    Positions get their rank from counts per cell and a window inside a cell; a hint start gets the
    number of positions before it in the same way, and its neighbours are equal keys then.
    """
    keys = [source, "word"]
    wanted = misses.select(*keys, "hint_start").distinct().withColumn("cell", _cell(F.col("hint_start")))
    held = positions.join(wanted.select(*keys).distinct(), keys, "left_semi").withColumn("cell", _cell(F.col("word_idx")))
    counts = held.groupBy(*keys, "cell").agg(F.count("*").alias("n")).unionByName(wanted.select(*keys, "cell").distinct().withColumn("n", F.lit(0).cast("long")))
    counts = counts.groupBy(*keys, "cell").agg(F.sum("n").alias("n"))
    along = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*keys, "cell", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy(*keys, "cell").orderBy("word_idx"))
    ranked = held.withColumn("inside", inside).join(bases, [*keys, "cell"]).select(*keys, "word_idx", (F.col("base") + F.col("inside")).alias("rank"))
    local = wanted.join(held, [*keys, "cell"], "left").groupBy(*keys, "cell", "hint_start").agg(F.count_if(F.col("word_idx") < F.col("hint_start")).alias("local"))
    before = local.join(bases, [*keys, "cell"]).select(*keys, "hint_start", (F.col("base") + F.col("local")).alias("k"))
    near = before.select(*keys, "hint_start", F.explode(F.sequence(F.col("k") - (nearest - 1), F.col("k") + nearest)).alias("rank"))
    return near.join(ranked, [*keys, "rank"]).select(*keys, "hint_start", "word_idx")


def band_candidates(anchors: DataFrame, blocks: DataFrame, source: str, stem: str = "audio_stem", nearest: int = 3) -> DataFrame:
    """Positions of each anchor's word inside the hint range, else the ``nearest`` ones.

    ``anchors`` has stem, anchor_idx, word, time, confidence, hint_start, hint_end and the source;
    ``blocks`` is made by ``posting_blocks``. Inside the range an anchor meets the blocks of its word by
    cell, so a frequent word meets its own neighbourhood only; anchors without a hit there look up the
    positions around the range by rank. The cost is one row per candidate and cell, and not one per
    anchor and position of its word.
    """
    cells = F.sequence(_cell(F.col("hint_start")), F.greatest(_cell(F.col("hint_start")), _cell(F.col("hint_end"))))
    spread = anchors.withColumn("cell", F.explode(cells))
    hit = spread.join(blocks, [source, "word", "cell"])
    inside = F.filter(positions_in("cell", "offsets"), lambda p: p.between(F.col("hint_start"), F.col("hint_end")))
    hit = hit.withColumn("word_idx", F.explode(inside)).drop("cell", "offsets")
    one = Window.partitionBy(stem, "anchor_idx")
    hit = materialize(hit.withColumn("place", F.row_number().over(one.orderBy("word_idx"))), "in-band")
    misses = anchors.join(hit.select(stem, "anchor_idx").distinct(), [stem, "anchor_idx"], "left_anti")
    far = misses.join(_around(misses, posted_positions(blocks, source), source, nearest), [source, "word", "hint_start"])
    away = F.least(F.abs(F.col("word_idx") - F.col("hint_start")), F.abs(F.col("word_idx") - F.col("hint_end")))
    far = far.withColumn("place", F.row_number().over(one.orderBy(away, "word_idx"))).filter(F.col("place") <= nearest)
    return hit.unionByName(far)


def increasing(positions: list[int], strict_times: list[float] | None = None) -> list[int]:
    """Indices of one longest strictly increasing run of positions, by patience piles."""
    tails, ends, parent = [], [], [-1] * len(positions)
    for i, p in enumerate(positions):
        k = bisect.bisect_left(tails, p)
        if k == len(tails):
            tails.append(p)
            ends.append(i)
        else:
            tails[k], ends[k] = p, i
        if k:
            parent[i] = ends[k - 1]
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(at)
        at = parent[at]
    return out[::-1]


def matched_sequences(candidates: DataFrame, stem: str = "audio_stem", least: int = LEAST_LENGTH, distinct_anchors: bool = False) -> DataFrame:
    """The longest increasing sequence of every file's candidates: stem, pos, word, time, word_idx, confidence.

    Candidates are in time order, strict in the word index only, so an anchor with several candidates
    may be chained more than once; ``distinct_anchors`` takes each anchor once. A task passes its files by one
    after the other and holds the candidates of one.
    """
    kind = candidates.schema[stem].dataType.simpleString()
    need = [stem, "word", "time", "word_idx", "confidence"]
    out = [stem, "pos", *need[1:]]
    # no time and no number as a time come last, as equals
    time = F.when(~F.isnan("time"), F.col("time")).asc_nulls_last()
    last = F.col("word_idx").desc() if distinct_anchors else F.col("place")
    placed = candidates.repartition(F.col(f"`{stem}`")).sortWithinPartitions(F.col(f"`{stem}`"), time, "anchor_idx", last)

    def longest(rows: list[tuple]) -> list[tuple]:
        at = increasing([r[3] for r in rows])
        return [(rows[i][0], pos, *rows[i][1:]) for pos, i in enumerate(at)] if len(at) >= least else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, rows, done, types = None, [], [], None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=out)

        for batch in batches:
            field = batch.schema.field
            types = [field(0).type, pa.int32(), *[field(n).type for n in range(1, len(need))]]
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != file:
                    done += longest(rows)
                    file, rows = row[0], []
                    if len(done) >= 10_000:
                        yield made()
                        done = []
                rows.append(row)
        done += longest(rows)
        if done:
            yield made()

    columns = [F.col(f"`{stem}`"), "word", F.col("time").cast("double").alias("time"), F.col("word_idx").cast("long").alias("word_idx"), F.col("confidence").cast("double").alias("confidence")]
    return placed.select(*columns).mapInArrow(run, f"`{stem}` {kind}, pos int, word string, time double, word_idx long, confidence double")


def sequence_metrics(anchors: DataFrame, key: str = "audio_stem") -> DataFrame:
    """Length, spans, rate and its spread, density, diversity and mean confidence of every sequence."""
    along = Window.partitionBy(key).orderBy("pos")
    dt = F.col("time") - F.lag("time").over(along)
    dw = F.col("word_idx") - F.lag("word_idx").over(along)
    steps = anchors.withColumn("pair_wps", F.when(dt > 0, dw / dt))
    g = steps.groupBy(key).agg(
        F.count("*").alias("sequence_length"),
        (F.max_by("time", "pos") - F.min_by("time", "pos")).alias("audio_span"),
        (F.max_by("word_idx", "pos") - F.min_by("word_idx", "pos")).alias("word_span"),
        F.count("pair_wps").alias("pairs"),
        F.stddev_pop("pair_wps").alias("spread"),
        F.countDistinct("word").alias("unique_anchors"),
        F.avg(F.coalesce("confidence", F.lit(0.5))).alias("anchor_confidence"),
    )
    return g.select(
        key,
        "sequence_length",
        "audio_span",
        "word_span",
        F.try_divide(F.col("word_span"), F.col("audio_span")).alias("wps"),
        F.when(F.col("pairs") >= 2, F.col("spread")).otherwise(0.0).alias("wps_std"),
        F.try_divide(F.col("sequence_length") * 60.0, F.col("audio_span")).alias("anchor_density"),
        (F.col("unique_anchors") / F.col("sequence_length")).alias("diversity"),
        "unique_anchors",
        "anchor_confidence",
    )


def sequence_confidence() -> Column:
    """Weighted score over the columns of ``sequence_metrics``; 0 without a span."""
    n, wps = F.col("sequence_length"), F.col("wps")
    length = F.least(F.lit(1.0), (n - 5) / 15 + 0.5)
    pace = F.when(wps.between(1, 5), 1 - F.abs(wps - 2.5) / 2.5).otherwise(0.3)
    steady = F.greatest(F.lit(0.0), 1 - F.col("wps_std") / 2)
    score = 0.3 * length + 0.25 * pace + 0.2 * steady + 0.15 * F.col("diversity") + 0.1 * F.col("anchor_confidence")
    return F.when((n < 2) | (F.col("audio_span") <= 0) | (F.col("word_span") <= 0), 0.0).otherwise(score)


def scored_sequences(anchors: DataFrame, key: str = "audio_stem", least: float = 0.4) -> DataFrame:
    """Metrics and confidence of the sequences that reach ``least``."""
    return sequence_metrics(anchors, key).withColumn("confidence", sequence_confidence()).filter(F.col("confidence") >= least)


def session_anchor_totals(words: DataFrame, keywords: list[str], source: str = "session") -> DataFrame:
    """How many keywords a session has, and how many hits of them."""
    hits = keyword_positions(words, keywords, source)
    return hits.groupBy(source).agg(F.countDistinct("word").alias("anchor_types"), F.count("*").alias("positions"))
