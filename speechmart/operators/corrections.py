"""Corrected segments: training rows, improvements, what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechmart.functions.text import jaccard, normalize


def explode_corrections(bundles: DataFrame) -> DataFrame:
    """Rows of the map ``segments``: seg_key and the fields of its values."""
    return bundles.select(F.explode("segments").alias("seg_key", "s")).select("seg_key", "s.*")


def bootstrap(chunks: DataFrame, quality: int = 3) -> DataFrame:
    """Machine transcripts taken as corrections."""
    return chunks.select("start", "end", F.col("text").alias("corrected_text"), F.lit(quality).alias("quality"), F.lit("bootstrap").alias("source"))


def training_rows(corrections: DataFrame, orthography: str = "system6", least: int = 3, shortest: float = 1.0, longest: float = 30.0, dictionary: dict[str, str] | None = None) -> DataFrame:
    """Normalized rows of sufficient quality and length."""
    d = F.col("end") - F.col("start")
    kept = corrections.filter((F.col("quality") >= least) & (F.trim("corrected_text") != "") & d.between(shortest, longest))
    out = kept.withColumns(
        {
            "duration": d,
            "text": normalize(F.col("corrected_text"), orthography, dictionary),
            "original_text": F.col("corrected_text"),
            "orthography": F.lit(orthography),
        }
    )
    return out.filter(F.col("text") != "").drop("corrected_text")


def uncorrected(segments: DataFrame, corrections: DataFrame, keys: list[str]) -> DataFrame:
    """Segments nobody corrected yet."""
    return segments.join(corrections, keys, "left_anti")


def with_uncorrected(training: DataFrame, segments: DataFrame, corrections: DataFrame, keys: list[str], orthography: str = "system6") -> DataFrame:
    """Training rows and, below them in quality, the uncorrected machine transcripts."""
    raw = uncorrected(segments, corrections, keys).withColumnRenamed("text", "corrected_text")
    raw = raw.withColumn("quality", F.lit(2)).withColumn("source", F.lit("mms_uncorrected"))
    return training.unionByName(training_rows(raw, orthography, least=2), allowMissingColumns=True)


def is_improvement(heard: Column, predicted: Column) -> Column:
    """A prediction that differs from the transcript, but not wholly, and is not tiny."""
    j = jaccard(heard, predicted)
    return (F.trim(predicted) != "") & (j > 0.1) & (j < 0.9) & (F.length(predicted) > 5)


def auto_accepted(predictions: DataFrame, heard: str, predicted: str, least: float = 0.7) -> DataFrame:
    """Improvements close enough to take without review, at quality 3."""
    j = jaccard(F.col(heard), F.col(predicted))
    kept = predictions.filter(is_improvement(F.col(heard), F.col(predicted)) & (j >= least))
    return kept.withColumns({"corrected_text": F.col(predicted), "quality": F.lit(3), "source": F.lit("auto"), "auto_accepted": F.lit(True)})


def merge_corrections(existing: DataFrame, accepted: DataFrame, keys: list[str]) -> DataFrame:
    """Accepted rows replace existing ones of the same key."""
    return existing.join(accepted, keys, "left_anti").unionByName(accepted, allowMissingColumns=True)


def next_iteration(runs: DataFrame, name: str = "name") -> DataFrame:
    """One more than the highest number at the end of a run's name."""
    return runs.agg((F.coalesce(F.max(F.regexp_extract(name, r"(\d+)$", 1).try_cast("int")), F.lit(0)) + 1).alias("iteration"))


def latest(files: DataFrame, name: str = "path", modified: str = "modified") -> DataFrame:
    """The file changed last, the greater name of equals."""
    return files.agg(F.max_by(name, F.struct(modified, name)).alias(name))
