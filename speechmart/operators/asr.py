"""Acoustic models as callables: the engine batches waveforms to them and reads their output.

A model is a function from a list of waveforms to a list of outputs. It is made on the executor by a
factory, once per task, so that weights load where they run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechmart.functions.text import clip_samples
from speechmart.operators.chunks import fixed_chunks

Transcriber = Callable[[list[np.ndarray]], list[str]]
Framer = Callable[[list[np.ndarray]], list[list[tuple[str, float]]]]


def transcribe(clips: DataFrame, make_model: Callable[[], Transcriber], keys: list[str], samples: str = "samples") -> DataFrame:
    """The keys and ``text`` of every clip."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in parts:
            yield pdf[keys].assign(text=model([np.asarray(s, dtype=np.float32) for s in pdf[samples]]))

    need = clips.select(*keys, samples)
    fields = ", ".join(f"`{k}` {need.schema[k].dataType.simpleString()}" for k in keys)
    return need.mapInPandas(run, f"{fields}, text string")


def label_frames(clips: DataFrame, make_model: Callable[[], Framer], key: str, samples: str = "samples") -> DataFrame:
    """key, frame, token, score: what ``ctc.collapse_frames`` and ``ctc.aligned_words`` read."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in parts:
            out = []
            for k, frames in zip(pdf[key], model([np.asarray(s, dtype=np.float32) for s in pdf[samples]]), strict=True):
                out += [(k, n, token, score) for n, (token, score) in enumerate(frames)]
            yield pd.DataFrame(out, columns=[key, "frame", "token", "score"])

    need = clips.select(key, samples)
    return need.mapInPandas(run, f"`{key}` {need.schema[key].dataType.simpleString()}, frame int, token string, score double")


def with_fallback(*factories: Callable[[], Transcriber]) -> Callable[[], Transcriber]:
    """A factory that gives the first model whose files are there, such as a tuned one before its base."""

    def make() -> Transcriber:
        for factory in factories[:-1]:
            try:
                return factory()
            except FileNotFoundError:
                continue
        return factories[-1]()

    return make


def transcribe_chunked(audio: DataFrame, make_model: Callable[[], Transcriber], key: str = "audio_stem", size: float = 30.0, rate: int = 16_000) -> DataFrame:
    """key and text of whole files (key, samples): transcribed in chunks, which are joined in order; blank chunks leave no trace."""
    timed = audio.withColumn("duration", F.size("samples") / rate)
    at = fixed_chunks(timed, size, stem=key).join(audio.select(key, "samples"), key)
    clips = at.select(key, "chunk_idx", clip_samples(F.col("samples"), F.col("start"), F.col("end"), rate).alias("samples")).filter("samples is not null")
    heard = transcribe(clips, make_model, [key, "chunk_idx"]).withColumn("text", F.trim("text")).filter("text <> ''")
    joined = heard.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("chunk_idx", "text"))).alias("ts"))
    return joined.select(key, F.array_join(F.transform("ts", lambda t: t["text"]), " ").alias("text"))
