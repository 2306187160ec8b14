"""Sources and sinks: transcripts, corrections, paragraphs, clips, splits, reports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechmart.functions.text import WHITE, session_of, to_plain
from speechmart.operators.ranking import positions
from speechmart.sources.audio import decode_wav, resample, wav_bytes

CHUNK = "text string, start double, end double, source string"
NESTED = "text string, language string, segments array<struct<start:double,end:double,text:string>>"
CORRECTION = "original_mms string, corrected_text string, start double, end double, quality int, whisper string, source string, auto_accepted boolean"
CORRECTIONS = f"segments map<string, struct<{CORRECTION.replace(' ', ':').replace(',:', ',')}>>, vocabulary map<string, struct<word:string,meaning:string,pos:string,added:string>>, metadata struct<created:string,last_modified:string,audio_file:string>"
SAMPLE = "reference_text struct<system4:string,system6:string>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def stem_of(path: Column) -> Column:
    """File name without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def read_rows(spark: SparkSession, path: str, schema: str, stem: Column | None = None) -> DataFrame:
    """JSON arrays of rows, one file per stem, with audio_stem: the file's name, or ``stem`` (of a folder's columns)."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.withColumn("audio_stem", stem_of(F.col("_metadata.file_path")) if stem is None else stem)


def rows_in(files: DataFrame, schema: str, key: str = "audio_stem") -> DataFrame:
    """``read_rows`` of a table of files (``key``, value): many transcripts need no file and folder each."""
    parsed = F.from_json("value", f"array<struct<{schema}>>")
    broken = F.array(F.lit(None).cast(f"struct<{schema}>"))  # as read from a file, a broken document is a row of nulls
    return files.filter(F.col("value").rlike(r"\S")).select(key, F.inline(F.coalesce(parsed, broken)))


def read_chunks(spark: SparkSession, path: str, stem: Column | None = None) -> DataFrame:
    """``placed_chunks`` of JSON arrays, one file per stem."""
    return placed_chunks(read_rows(spark, path, CHUNK, stem))


def placed_chunks(rows: DataFrame) -> DataFrame:
    """Transcript chunks with chunk_idx by start; a missing end is ten seconds on."""
    rows = rows.withColumn("end", F.coalesce("end", F.col("start") + 10))
    columns = ["start", "end", "text", "source"]
    placed = positions(rows.select("audio_stem", *columns), ["audio_stem"], columns, "chunk_idx")
    return placed.select("audio_stem", F.col("chunk_idx").cast("int").alias("chunk_idx"), *columns)


def read_nested(spark: SparkSession, path: str, stem: Column | None = None) -> DataFrame:
    """``nested_rows`` of JSON objects, one file per stem."""
    return nested_rows(read_rows(spark, path, NESTED, stem))


def nested_rows(transcripts: DataFrame) -> DataFrame:
    """Objects with text, language and segments: one row per segment."""
    return transcripts.select("audio_stem", "language", F.posexplode("segments").alias("chunk_idx", "s")).select("audio_stem", "language", "chunk_idx", "s.*")


def latest_bundle(bundles: DataFrame, name: str = "audio_stem") -> DataFrame:
    """Rows of the last file by name."""
    return bundles.join(F.broadcast(bundles.agg(F.max(name).alias(name))), name)


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """Correction bundles; an absent path gives an empty table of the same schema."""
    try:
        return spark.read.schema(CORRECTIONS).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CORRECTIONS)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per line; blank lines are skipped."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")


def docx_paragraphs(content: bytes) -> list[str]:
    """Paragraph texts of a word-processor file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return ["".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p")]


def docx_rows(files: DataFrame) -> DataFrame:
    """audio_stem, para_idx, text of every paragraph that is not blank, of files (audio_stem, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stem, content in zip(batch.column(0), batch.column(1), strict=True):  # one file's bytes at a time
                found = [(k, p.strip()) for k, p in enumerate(docx_paragraphs(content.as_py())) if p.strip()]
                values = [pa.array([stem.as_py()] * len(found), pa.string()), pa.array([k for k, _ in found], pa.int32()), pa.array([p for _, p in found], pa.string())]
                yield pa.RecordBatch.from_arrays(values, names=["audio_stem", "para_idx", "text"])

    return files.select("audio_stem", "content").mapInArrow(run, "audio_stem string, para_idx int, text string")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """``docx_rows`` of word-processor files."""
    return docx_rows(spark.read.format("binaryFile").load(path).select(stem_of(F.col("path")).alias("audio_stem"), "content"))


#: Bytes of a file to (mono samples, rate, channels, bits).
Decoder = Callable[[bytes], tuple[np.ndarray, int, int, int]]


def audio_rows(files: DataFrame, target: int = 16_000, decode: Decoder = decode_wav) -> DataFrame:
    """audio_stem, audio_path, samples (mono, ``target`` Hz), duration, sample_rate, channels, bit_depth, file_size.

    ``files`` has path, audio_stem, content and length. Formats other than PCM come with a ``decode`` of
    their own, which runs on the executors.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for p, stem, content, size in zip(pdf["path"], pdf["audio_stem"], pdf["content"], pdf["length"], strict=True):
                x, rate, channels, bits = decode(content)
                row = {"audio_stem": stem, "audio_path": p, "samples": resample(x, rate, target), "duration": len(x) / rate, "sample_rate": rate, "channels": channels, "bit_depth": bits, "file_size": size}
                yield pd.DataFrame([row])

    need = files.select("path", "audio_stem", "content", "length")
    return need.mapInPandas(run, "audio_stem string, audio_path string, samples array<float>, duration double, sample_rate int, channels int, bit_depth int, file_size long")


def read_audio(spark: SparkSession, path: str, target: int = 16_000, decode: Decoder = decode_wav) -> DataFrame:
    """``audio_rows`` of audio files."""
    files = spark.read.format("binaryFile").load(path).select("path", stem_of(F.col("path")).alias("audio_stem"), "content", "length")
    return audio_rows(files, target, decode)


def encode_clips(clips: DataFrame, name: str = "file", samples: str = "samples", rate: int = 16_000) -> DataFrame:
    """name and wav bytes of every clip that has samples; a table of files is written as any other."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({name: pdf[name], "content": [wav_bytes(np.asarray(s, dtype=np.float32), rate) for s in pdf[samples]]})

    kept = clips.filter(F.size(samples) > 0).select(name, samples)
    return kept.mapInPandas(run, f"`{name}` string, content binary")


def safe_name(path: Column) -> Column:
    """Flattened file name: separators and spaces to underscores, no extension."""
    return F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), "[/ ]", "_")


def media_files(files: DataFrame, path: str = "path") -> DataFrame:
    return files.filter(F.lower(path).rlike(r"\.(mp3|mp4|wav|m4a)$"))


def files_of_session(files: DataFrame, session: str, path: str = "path") -> DataFrame:
    """Files whose path names the session."""
    return files.filter(session_of(F.col(path)) == session)


def not_yet_done(inputs: DataFrame, outputs: DataFrame, stem: str = "audio_stem", force: bool = False) -> DataFrame:
    """Inputs without an output; all of them with ``force``."""
    return inputs if force else inputs.join(outputs, stem, "left_anti")


def with_existing_audio(segments: DataFrame, files: DataFrame, path: str = "audio_path") -> DataFrame:
    return segments.join(files.select(path).distinct(), path, "left_semi")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One folder of JSON lines per split."""
    df.write.mode("overwrite").partitionBy(split).json(path)


def hf_rows(clips: DataFrame) -> DataFrame:
    """audio, sentence, duration, quality (0 where missing)."""
    return clips.select(F.col("file").alias("audio"), F.col("text").alias("sentence"), "duration", F.coalesce("quality", F.lit(0)).alias("quality"))


def dataset_metadata(df: DataFrame, split: str = "split") -> DataFrame:
    """One row: clips, hours and clips by split."""
    by = df.groupBy(split).agg(F.count("*").alias("n"), F.sum("duration").alias("s"))
    return by.agg(F.sum("n").alias("clips"), (F.sum("s") / 3600).alias("hours"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(split, "n")))).alias("splits"))


def tier_metadata(df: DataFrame, tier: str = "tier") -> DataFrame:
    """One row: clips, hours, mean confidence, and per tier its clips and confidence from least to most."""
    c = F.coalesce("confidence", F.lit(0.0))
    by = df.groupBy(tier).agg(F.count("*").alias("clips"), F.sum("duration").alias("s"), F.sum(c).alias("c"), F.min(c).alias("low"), F.max(c).alias("high"))
    one = F.struct(F.col(tier).alias("tier"), "clips", (F.col("c") / F.col("clips")).alias("mean"), "low", "high")
    return by.agg(F.sum("clips").alias("clips"), (F.sum("s") / 3600).alias("hours"), (F.sum("c") / F.sum("clips")).alias("mean_confidence"), F.sort_array(F.collect_list(one)).alias("tiers"))


def benchmark_sample(spark: SparkSession, metadata_path: str, reference_path: str) -> DataFrame:
    """system4 and system6 reference texts: those of the metadata, else the plain reference file for both."""
    schema = "title string, reference_text struct<system4:string,system6:string>"
    try:
        meta = spark.read.schema(schema).option("multiLine", True).json(metadata_path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        meta = spark.createDataFrame([], schema)
    whole = spark.read.text(reference_path, wholetext=True).select(F.btrim("value", F.lit(WHITE)).alias("plain"))
    both = whole.join(meta.limit(1), F.lit(True), "left")
    return both.select(F.coalesce("reference_text.system4", "plain").alias("system4"), F.coalesce("reference_text.system6", to_plain(F.col("plain"))).alias("system6"))


def benchmark_samples(spark: SparkSession, metadata_path: str, reference_path: str, key: str) -> DataFrame:
    """key, system4, system6 of many samples: the reference texts of their metadata, else their plain reference files.

    Both paths hold a folder per sample, named ``key=...``.
    """
    plain = spark.read.text(reference_path, wholetext=True).select(key, F.btrim("value", F.lit(WHITE)).alias("plain"))
    meta = spark.read.schema(SAMPLE).option("multiLine", True).json(metadata_path)
    return sample_texts(plain, meta, key)


def sample_texts(plain: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """key, system4, system6 of plain texts (key, plain) and metadata (key, reference_text)."""
    both = plain.join(meta, key, "full")
    four = F.coalesce("reference_text.system4", "plain")
    return both.select(key, four.alias("system4"), F.coalesce("reference_text.system6", to_plain(four)).alias("system6"))


def benchmark_bundle(results: DataFrame, benchmark: str) -> DataFrame:
    """One row (value) of JSON: the benchmark's name and its results in order of model."""
    cols = ["model", "transcription", "wer_system4", "wer_system6", "cer_system4", "cer_system6"]
    return results.agg(F.to_json(F.struct(F.lit(benchmark).alias("benchmark"), F.sort_array(F.collect_list(F.struct(*cols))).alias("results"))).alias("value"))


def touch_corrections(bundles: DataFrame) -> DataFrame:
    """Bundles with the time of change set, for writing back."""
    return bundles.withColumn("metadata", F.col("metadata").withField("last_modified", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")))


def vocabulary_rows(bundles: DataFrame) -> DataFrame:
    return bundles.select(F.explode("vocabulary").alias("key", "v")).select("v.*")


def review_lines(rows: DataFrame, idx: str = "idx") -> DataFrame:
    """Lines of a review file, in order of ``idx``."""
    line = F.format_string("## %s\n- heard: %s\n- suggested: %s\n- similarity: %.2f\n", F.col("seg_key"), F.col("mms_text"), F.col("model_prediction"), F.col("similarity"))
    return rows.select(idx, line.alias("value"))


def checklist_lines(rows: DataFrame, idx: str = "idx") -> DataFrame:
    """Lines of a listening checklist."""
    line = F.format_string("- [ ] %s  text: %s  confidence: %.2f  score (1-5): __", F.col("file"), F.col("text"), F.col("confidence"))
    return rows.select(idx, line.alias("value"))


def result_lines(results: DataFrame) -> DataFrame:
    """Table lines of benchmark results."""
    cols = ["wer_system4", "wer_system6", "cer_system4", "cer_system6"]
    return results.select(F.format_string("%-30s %8.4f %8.4f %8.4f %8.4f", F.col("model"), *cols).alias("value"))
