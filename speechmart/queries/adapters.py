"""How the test tables play the roles of the domain."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechmart.operators.ctc import label_ids
from speechmart.operators.ranking import positions

ACCENTS = "áéíóúäëïöüàèìòùâêîôû"
MACRON_TARGET = "āēīōūāēīōūāēīōūāēīōū"
#: Keywords that occur in the invented prose.
KEYWORDS = ["that", "with", "from", "this", "than", "tion", "thre"]
OTHER_KEYWORDS = ["that", "with", "the", "of", "and"]
EQUIVALENTS = {"that": "the", "with": "of", "from": "and"}
#: Macron forms of words of the prose.
DICTIONARY = {"the": "thē", "und": "ūnd", "que": "quē", "para": "pāra", "of": "ōf"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def macron(text: Column) -> Column:
    """Accented vowels as macron vowels; the prose has no macrons of its own."""
    return F.translate(text, ACCENTS, MACRON_TARGET)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as ten-second transcript chunks of two sources."""
    c = read(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("audio_stem"),
        F.col("turn").alias("chunk_idx"),
        (F.col("turn") * 10.0).alias("start"),
        (F.col("turn") * 10.0 + 10.0).alias("end"),
        "text",
        F.when(F.col("role") == "user", "mms").otherwise("whisper_en").alias("source"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored segments, with a total order that their key alone lacks."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("audio_path"),
        F.col("l_linenumber").cast("double").alias("start"),
        (F.col("l_linenumber") + F.col("l_quantity") / 4).alias("end"),
        (F.col("l_discount") * 10).alias("confidence"),
        (F.col("l_tax") * 12.5).alias("llm_score"),
        (F.col("l_discount") * 10).alias("align_score"),
        (F.col("l_quantity") / 10).alias("wps"),
        F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("text"),
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_shipdate",
        "l_extendedprice",
    )


SEGMENT_ORDER = ["start", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "wps", "confidence", "llm_score"]
SEGMENT_IDS = ["audio_path", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

SEGMENTS_SQL = """seg AS (
  SELECT l_orderkey AS audio_path, CAST(l_linenumber AS DOUBLE) AS "start", l_linenumber + l_quantity / 4 AS "end",
         l_discount * 10 AS confidence, l_tax * 12.5 AS llm_score, l_discount * 10 AS align_score, l_quantity / 10 AS wps,
         l_returnflag || ' ' || l_linestatus AS text, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice
  FROM lineitem)"""
CHUNKS_SQL = """ch AS (
  SELECT conv_id AS audio_stem, turn AS chunk_idx, turn * CAST(10.0 AS DOUBLE) AS "start", turn * CAST(10.0 AS DOUBLE) + 10.0 AS "end", text,
         CASE WHEN role = 'user' THEN 'mms' ELSE 'whisper_en' END AS source
  FROM conversations)"""


def timed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as words of a file: one second long, scored."""
    e = read(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(F.col("user_id").alias("audio_path"), start.alias("start"), (start + 1).alias("end"), (F.col("value") / 100 - 5.2).alias("score"), F.col("event_type").alias("word"))


EVENTS_SQL = """ev AS (
  SELECT user_id AS audio_path, epoch_us(ts) / CAST(1000000 AS DOUBLE) AS "start", epoch_us(ts) / CAST(1000000 AS DOUBLE) + 1 AS "end",
         value / 100 - 5.2 AS score, event_type AS word
  FROM events)"""


def with_next_turn(turns: DataFrame, text: str, name: str) -> DataFrame:
    """Turns (conv_id, turn, ...) that another follows, with that one's ``text`` as ``name``.

    Places come from ranges and neighbours meet by equal keys, so a conversation of any length spreads.
    """
    placed = positions(turns, ["conv_id"], ["turn"], "_place")
    after = placed.select(F.col("conv_id").alias("_conv"), (F.col("_place") - 1).alias("_before"), F.col(text).alias(name))
    return placed.join(after, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_place") == F.col("_before"))).drop("_place", "_conv", "_before")


#: Label ids of the stand-in acoustic model: a blank, letters and the word separator.
SPELLING = {c: n for n, c in enumerate("abcdefghijklmnopqrstuvwxyzäöüßéèêçñíó|", 1)}


def spelled_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as clips: their letters as label ids, and a waveform that is no more than those ids."""
    c = read(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("clip"), "text")
    labelled = c.withColumn("labels", label_ids(F.col("text"), SPELLING))
    return labelled.withColumn("samples", F.col("labels").cast("array<float>"))


def spelling_model():
    """A stand-in acoustic model: two frames a letter and one at the end, each likely its letter or a blank, with steady noise."""

    def emit(clips: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for x in clips:
            ids = x.astype(np.int64)
            frames, kinds = 2 * len(ids) + 1, len(SPELLING) + 1
            t, k = np.arange(frames)[:, None], np.arange(kinds)[None, :]
            noise = ((t * 7919 + k * 104729 + (t * k) * 31) % 1009) / 1009.0
            line = 3.0 * noise
            line[np.arange(2 * len(ids)), np.repeat(ids, 2)] += 4.0
            line[:, 0] += 2.0
            out.append(line - np.log(np.exp(line).sum(axis=1, keepdims=True)))
        return out

    return emit
