"""The ordered operators on unbounded input, as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def new_files(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """Files as they arrive; the query's checkpoint remembers those that were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def regrid_stream(events: DataFrame, key: str, time: str = "ts", size: str = "10 seconds", late: str = "1 minute", value: str = "value") -> DataFrame:
    """Count, sum and span of every key and grid cell; cells close when the watermark passes them."""
    w = events.withWatermark(time, late).groupBy(key, F.window(time, size))
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total")


def session_stream(events: DataFrame, key: str, time: str = "ts", gap: str = "30 minutes", late: str | None = "1 minute") -> DataFrame:
    """Runs of events without a gap, by session windows.

    Rows later than the watermark are lost, in complete mode too. Without ``late`` there is no
    watermark: nothing is lost and no state is dropped, which only complete and update mode allow.
    """
    timed = events.withWatermark(time, late) if late else events
    s = timed.groupBy(key, F.session_window(time, gap))
    return s.agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


class Utterances(StatefulProcessor):
    """Folds one file's words into utterances as the watermark passes them.

    Words wait in a list until the watermark is beyond their start, since only then no earlier word can
    come. The words before the watermark are folded in order; all groups but the last are final, and the
    last one is as soon as the watermark is beyond its end by more than the gap, for then whatever comes
    breaks it. So the result does not depend on how words are dealt to batches.
    """

    def __init__(self, columns: list[str], max_gap: float, max_seconds: float, at_least: int) -> None:
        self.columns, self.max_gap, self.max_seconds, self.at_least = columns, max_gap, max_seconds, at_least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.words = handle.getListState("words", "start double, end double, word string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [r for part in rows for r in zip(part["start"].tolist(), part["end"].tolist(), part["word"].tolist(), strict=True)]
        if came:
            self.words.appendList(came)
            self._wake(min(r[0] for r in came))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        pending = sorted(self.words.get())
        groups: list[list[tuple]] = []
        for row in (r for r in pending if r[0] < now):
            if groups and not (row[0] - groups[-1][-1][1] > self.max_gap or row[1] - groups[-1][0][0] > self.max_seconds):
                groups[-1].append(row)
            else:
                groups.append([row])
        left = [r for r in pending if not r[0] < now]
        if groups and not now - groups[-1][-1][1] > self.max_gap:
            left = groups.pop() + left
            self._wake(max(now, left[0][1] + self.max_gap))
        elif left:
            self._wake(left[0][0])
        if left:
            self.words.put(left)
        else:
            self.words.clear()
        done = [g for g in groups if len(g) >= self.at_least]
        if done:
            yield pd.DataFrame([(key[0], " ".join(r[2] for r in g), g[0][0], g[-1][1], len(g)) for g in done], columns=self.columns)

    def _wake(self, seconds: float) -> None:
        """A timer right after a moment of the file's time."""
        self.handle.registerTimer(int(seconds * 1000) + 1)

    def close(self) -> None:
        pass


def utterance_stream(
    timed: DataFrame, key: str = "audio_path", time: str = "ts", late: str = "1 minute", max_gap: float = 0.5, max_seconds: float = 20.0, at_least: int = 3, least_score: float = -5.0
) -> DataFrame:
    """``operators.segments.utterances`` on unbounded input, for words that come at most ``late`` behind the newest one.

    ``time`` is the start as a timestamp. Words with a score of ``least_score`` or less are dropped, where
    there are scores; words of null are no words, but move the watermark. Needs the RocksDB state store.
    """
    if "score" in timed.columns:
        timed = timed.filter(F.col("word").isNull() | (F.col("score") > least_score))
    words = timed.select(key, time, "start", "end", "word").withWatermark(time, late)
    # a condition on the word alone would be moved before the watermark, which would then not see such rows
    words = words.filter(F.col("word").isNotNull() | F.col(time).isNull())
    kind = timed.schema[key].dataType.simpleString()
    processor = Utterances([key, "text", "start", "end", "word_count"], max_gap, max_seconds, at_least)
    return words.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, text string, start double, end double, word_count int", "append", "eventtime")
