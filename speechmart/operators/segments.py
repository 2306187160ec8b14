"""Segments: pairs of anchors, utterance folds, budgets of words."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechmart.functions.text import words
from speechmart.operators.folds import limited_groups
from speechmart.operators.ranking import fresh, numbered_runs, running_total


#: Least and most words a second of a pair.
PACE = (0.5, 6.0)


def anchor_pairs(anchors: DataFrame, key: str = "audio_stem") -> DataFrame:
    """Every anchor with its successor: key, pos, start, end, word_start, word_end and both words."""
    along = Window.partitionBy(key).orderBy("pos")
    cols = [F.lead(c).over(along).alias(n) for c, n in (("time", "end"), ("word_idx", "word_end"), ("word", "anchor_end"))]
    pairs = anchors.select(key, "pos", F.col("time").alias("start"), F.col("word_idx").alias("word_start"), F.col("word").alias("anchor_start"), *cols)
    return pairs.filter((F.col("word_end") > F.col("word_start")) & (F.col("end") > F.col("start")))


def pair_segments(
    pairs: DataFrame,
    transcript: Column,
    confidence: Column,
    max_seconds: float = 15.0,
    max_words: int = 30,
    key: str = "audio_stem",
) -> DataFrame:
    """Segments between anchors from the transcript's word array, long ones in equal slices.

    Both anchors' words belong to a segment, so neighbours share one. The last slice takes the words
    that are left over; slices without words are dropped.
    """
    cut = pairs.withColumn("ws", F.slice(transcript, (F.col("word_start") + 1).cast("int"), (F.col("word_end") - F.col("word_start") + 1).cast("int")))
    cut = cut.withColumn("d", F.col("end") - F.col("start")).withColumn("nw", F.size("ws")).withColumn("wps", F.col("nw") / F.col("d"))
    cut = cut.filter(F.col("wps").between(*PACE))
    odd = F.when((F.col("wps") < 1) | (F.col("wps") > 4.5), 0.1).otherwise(0.0)
    whole = (F.col("d") <= max_seconds) & (F.col("nw") <= max_words)
    n = F.when(whole, 1).otherwise(F.greatest(F.lit(2), F.floor(F.col("d") / max_seconds) + 1, F.floor(F.col("nw") / max_words) + 1)).cast("int")
    each = cut.withColumn("conf", confidence - odd).withColumn("n", n).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    q, step = F.floor(F.col("nw") / F.col("n")).cast("int"), F.col("d") / F.col("n")
    last = F.col("s") == F.col("n") - 1
    size = F.when(last, F.col("nw") - q * F.col("s")).otherwise(q)
    out = each.select(
        key,
        "pos",
        F.col("s").alias("slice"),
        F.lower(F.array_join(F.slice("ws", F.col("s") * q + 1, size), " ")).alias("text"),
        (F.col("start") + F.col("s") * step).alias("start"),
        F.when(last, F.col("end")).otherwise(F.col("start") + (F.col("s") + 1) * step).alias("end"),
        (size / step).alias("wps"),
        (F.col("conf") - F.when(F.col("n") > 1, 0.05).otherwise(0.0)).alias("confidence"),
        F.when(F.col("s") == 0, F.col("anchor_start")).alias("anchor_start"),
        F.when(last, F.col("anchor_end")).alias("anchor_end"),
        size.alias("word_count"),
    )
    return out.filter("word_count > 0")


def _file_key(key: str) -> Column:
    """A text that no two files share; null has one of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{key}`").cast("string")), F.lit("-"))


def _joined(order: list[str], value: str) -> Column:
    """The texts of a group in order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(value).cast("string").alias("_word")))), lambda r: r["_word"]), " ")


def gap_sessions(timed: DataFrame, gap: float, key: str = "audio_path", end: str = "end") -> DataFrame:
    """Runs without a gap longer than ``gap``: key, run, n, start, end. Only the order within a key matters."""
    rows = timed.select(F.col(f"`{key}`").alias("k"), "start", F.col(end).alias("end"))
    runs = numbered_runs(rows, ["k"], ["start", "end"], ["start", "end"], lambda own, before: own("start") - before("end") > gap, "run")
    g = runs.groupBy("k", "run").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))
    return g.select(F.col("k").alias(key), (F.col("run") - 1).alias("run"), "n", "start", "end")


def utterances(timed: DataFrame, max_gap: float = 0.5, max_seconds: float = 20.0, at_least: int = 3, least_score: float = -5.0, key: str = "audio_path") -> DataFrame:
    """Aligned words grouped into utterances by gap and by length from the group's start.

    A gap, and a word longer than the limit, always begin a group; between them the groups are chains
    that ``folds.limited_groups`` follows. Words of equal times are ordered by word and score. Files with
    fewer than three words have no utterances.
    """
    order = ["start", "end", "word", "score"]
    kept = timed.filter(F.col("score") > least_score).select(_file_key(key).alias("_f"), F.col(f"`{key}`").alias("_key"), *order)
    runs = numbered_runs(kept, ["_f"], order, ["start", "end"], lambda own, before: (own("start") - before("end") > max_gap) | (own("end") - own("start") > max_seconds), "_r")
    rows = limited_groups(runs, ["_f", "_r"], order, "start", "end", max_seconds)
    last = F.max_by("end", F.struct(*order))
    g = rows.groupBy("_f", "_r", "_head").agg(F.first("_key").alias(key), _joined(order, "word").alias("text"), F.min("start").alias("start"), last.alias("end"), F.avg("score").alias("score"), F.count("*").cast("int").alias("word_count"))
    if at_least < 3:
        g = g.join(kept.groupBy("_f").agg(F.count("*").alias("_n")).filter("_n >= 3"), "_f", "left_semi")
    return g.filter(F.col("word_count") >= at_least).select(key, "text", "start", "end", "score", "word_count")


def split_runs(matched: DataFrame, max_gap: float = 0.5, max_seconds: float = 20.0, block: str = "block", key: str = "audio_path") -> DataFrame:
    """Matched blocks (block, pos, audio_path, start, end, word) cut at gaps, at length and at file changes.

    Within one file of a block, times must not fall along ``pos``.
    """
    rows = matched.select(_file_key(block).alias("_f"), F.col(f"`{block}`").alias("_block"), F.col(f"`{key}`").alias("_key"), "pos", "start", "end", "word")

    def breaks(own, before):
        other = ~own("_key").eqNullSafe(before("_key"))
        return other | F.coalesce((own("start") - before("end") > max_gap) | (own("end") - own("start") > max_seconds), F.lit(False))

    runs = numbered_runs(rows, ["_f"], ["pos"], ["_key", "start", "end"], breaks, "_r")
    parts = limited_groups(runs, ["_f", "_r"], ["pos"], "start", "end", max_seconds)
    first, last = F.min_by("start", "pos"), F.max_by("end", "pos")
    g = parts.groupBy("_f", "_r", "_head").agg(F.first("_block").alias(block), F.first("_key").alias(key), F.min("pos").alias("_at"), _joined(["pos"], "word").alias("text"), first.cast("double").alias("start"), last.cast("double").alias("end"))
    piece = F.row_number().over(Window.partitionBy("_f").orderBy("_at")) - 1
    return g.withColumn("piece", piece).select(block, "piece", key, "text", "start", "end")


def budget_words(regions: DataFrame, wps: Column, least: int = 3, key: str = "audio_path") -> DataFrame:
    """Next words of a transcript for every region: key, start, end, first_word, n_words."""
    n = F.greatest(F.lit(least), F.floor((F.col("end") - F.col("start")) * wps)).cast("long")
    return running_total(regions.withColumn("n_words", n), [key], ["start", "end"], F.col("n_words"), "first_word")


def assign_budget(regions: DataFrame, transcript: DataFrame, wps: Column, source: str, least: int = 3, key: str = "audio_path") -> DataFrame:
    """``budget_words`` with ``text``; regions left with fewer than ``least`` words are dropped.

    ``regions`` names the transcript of each region in ``source``; ``transcript`` has source, word_idx and
    word. Every region brings the words of its own range, so no transcript is ever held whole.
    """
    return budget_text(budget_words(regions, wps, least, key), transcript, source, least)


def words_asked(budget: DataFrame, source: str) -> DataFrame:
    """source, n: how many of a transcript's first words its regions (of ``budget_words``) ask for."""
    return budget.groupBy(source).agg(F.max(F.col("first_word") + F.col("n_words")).alias("n"))


def budget_text(budget: DataFrame, transcript: DataFrame, source: str, least: int = 3) -> DataFrame:
    """Regions of ``budget_words`` with the ``text`` of their words; those left with fewer than ``least`` are dropped.

    Words behind the last one asked for meet no region, so a transcript may end there (``words_asked``).
    """
    b = budget
    asked = b.withColumn("word_idx", F.explode(F.sequence(F.col("first_word"), F.col("first_word") + F.col("n_words") - 1)))
    kept = [c for c in b.columns]
    own = asked.join(transcript.select(source, "word_idx", "word"), [source, "word_idx"])
    words_of = F.sort_array(F.collect_list(F.struct("word_idx", "word")))
    g = own.groupBy(*[F.col(f"`{c}`") for c in kept]).agg(words_of.alias("_ws")).filter(F.size("_ws") >= least)
    return g.withColumn("text", F.array_join(F.transform("_ws", lambda w: w["word"]), " ")).drop("_ws")


def bucket_paragraphs(paragraphs: DataFrame, files: DataFrame, session: str = "session") -> DataFrame:
    """Paragraphs dealt to files in order until each file has its expected words: session, audio, para_idx.

    ``files`` has session, file_idx, audio and expected_words. The pointer carries over from file to file
    while the count restarts, so what a file gets depends on all files before it. A session's paragraphs
    pass by in order as word counts alone, behind its files; only the list of files is held.
    """
    k, a = paragraphs.schema[session].dataType.simpleString(), files.schema["audio"].dataType.simpleString()
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{session}`").cast("string")), F.lit("-")).alias("_f")
    p = paragraphs.select(key, F.col(f"`{session}`").alias("_session"), F.lit(1).alias("_kind"), F.col("para_idx").cast("long").alias("_at"), F.size(words(F.col("text"))).cast("double").alias("_n"), F.lit(None).cast(a).alias("_audio"))
    f = fresh(files).select(key, F.col(f"`{session}`").alias("_session"), F.lit(0).alias("_kind"), F.col("file_idx").cast("long").alias("_at"), F.col("expected_words").cast("double").alias("_n"), F.col("audio").alias("_audio"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, wanted, file, got = None, [], 0, 0.0
        for pdf in batches:
            out = []
            for key_, session_, kind, place, n, audio in zip(*(pdf[c].tolist() for c in ("_f", "_session", "_kind", "_at", "_n", "_audio")), strict=True):
                if key_ != at:
                    at, wanted, file, got = key_, [], 0, 0.0
                if not kind:
                    wanted.append((audio, n))
                    continue
                while file < len(wanted) and not got < wanted[file][1]:
                    file, got = file + 1, 0.0
                if file < len(wanted):
                    out.append((session_, wanted[file][0], place))
                    got += n
            yield pd.DataFrame(out, columns=[session, "audio", "para_idx"])

    along = p.unionByName(f).repartition("_f").sortWithinPartitions("_f", "_kind", "_at")
    return along.mapInPandas(deal, f"`{session}` {k}, audio {a}, para_idx long")
