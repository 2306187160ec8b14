"""Energy-based speech regions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _energies(x: np.ndarray, frame: int, hop: int) -> np.ndarray:
    """Mean squares of all frames, from the sums of the blocks that frames and hops have in common.

    A difference of running sums over the whole waveform would lose quiet frames behind loud ones.
    """
    block = math.gcd(frame, hop)
    squares = np.square(x[: len(x) // block * block].astype(np.float64)).reshape(-1, block).sum(axis=1)
    n = (len(x) - frame) // hop + 1
    starts = np.arange(n) * (hop // block)
    total = np.zeros(n)
    for k in range(frame // block):
        total += squares[starts + k]
    return total / frame


def frame_energies(audio: DataFrame, rate: int = 16_000, key: str = "audio_path", samples: str = "samples", frame: float = 0.025, hop: float = 0.010) -> DataFrame:
    """Mean square of every frame of a waveform array: key, frame, energy. Shorter waveforms have no frames.

    Every sample is squared once, and a frame adds a fixed number of block sums.
    """
    f, h = int(frame * rate), int(hop * rate)
    kind = audio.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, x in zip(pdf[key], pdf[samples], strict=True):
                energy = _energies(np.asarray(x, np.float32), f, h)
                for at in range(0, len(energy), 100_000):
                    part = energy[at : at + 100_000]
                    yield pd.DataFrame({key: k, "frame": np.arange(at, at + len(part)), "energy": part})

    return audio.filter(F.size(samples) >= f).select(key, samples).mapInPandas(run, f"`{key}` {kind}, frame int, energy double")


def speech_regions(frames: DataFrame, key: str = "audio_path", hop: float = 0.01, factor: float = 2.0, reach: int = 5, least: float = 1.0, gap: float = 0.3) -> DataFrame:
    """Regions louder than ``factor`` times the lower median: key, region, start, end.

    Loud frames spread over ``reach`` neighbours; runs shorter than ``least`` seconds are dropped
    before runs closer than ``gap`` are merged.
    """
    level = frames.groupBy(key).agg(F.expr("percentile_disc(0.5) within group (order by energy)").alias("median"), F.max("frame").alias("last"))
    along, near = Window.partitionBy(key).orderBy("frame"), Window.partitionBy(key).orderBy("frame").rowsBetween(-reach, reach)
    loud = frames.join(level, key).withColumn("loud", (F.col("energy") > factor * F.col("median")).cast("int"))
    spread = loud.withColumn("speech", F.max("loud").over(near)).withColumn("place", F.row_number().over(along) - 1)
    n = Window.partitionBy(key)
    edged = spread.withColumn("start_flag", F.when((F.col("speech") == 1) & (F.coalesce(F.lag("speech").over(along), F.lit(0)) == 0), 1).otherwise(0))
    runs = edged.withColumn("n", F.count("*").over(n)).withColumn("run", F.sum("start_flag").over(along)).filter("speech = 1")
    g = runs.groupBy(key, "run").agg((F.min("place") * hop).alias("start"), ((F.max("place") + 1) * hop).alias("end"))
    kept = g.filter(F.col("end") - F.col("start") >= least - 1e-9)
    by_start = Window.partitionBy(key).orderBy("start")
    joined = kept.withColumn("new", F.when(F.coalesce(F.col("start") - F.lag("end").over(by_start) < gap - 1e-9, F.lit(False)), 0).otherwise(1))
    regions = joined.withColumn("region", F.sum("new").over(by_start) - 1)
    return regions.groupBy(key, "region").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def words_per_second(total_words, total_seconds):
    """Rate of a session; 2 without a duration."""
    return F.when(total_seconds > 0, total_words / total_seconds).otherwise(2.0)
