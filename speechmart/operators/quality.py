"""Quality reports over segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechmart.functions.text import is_repetitive, shorten


def summary(segments: DataFrame) -> DataFrame:
    """Segments, hours, mean pace (missing: 0) and mean confidence; one row, also without segments."""
    return segments.agg(
        F.count("*").alias("segments"),
        (F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0.0)) / 3600).alias("hours"),
        F.coalesce(F.avg(F.coalesce("wps", F.lit(0.0))), F.lit(0.0)).alias("mean_wps"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"),
    )


def banded(value: Column, edges: list[float], names: list[str], descending: bool = False) -> Column:
    """The first name whose edge the value reaches (descending) or stays under (ascending)."""
    out = None
    for edge, name in zip(edges, names, strict=False):
        test = value >= edge if descending else value < edge
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(names[-1])


def confidence_band(confidence: Column) -> Column:
    return banded(confidence, [0.8, 0.7, 0.6], ["high", "good", "fair", "low"], descending=True)


def pace_band(wps: Column) -> Column:
    return banded(wps, [1.0, 1.5, 3.5, 4.5], ["very_slow", "slow", "normal", "fast", "very_fast"])


def histogram(segments: DataFrame, band: Column, name: str = "band") -> DataFrame:
    return segments.groupBy(band.alias(name)).agg(F.count("*").alias("n"))


def flags(start: Column, end: Column, wps: Column, confidence: Column, text: Column | None = None) -> Column:
    """Names of everything odd about a segment."""
    d = end - start
    tests = [(wps < 1, "very_slow_wps"), (wps > 4.5, "very_fast_wps"), (confidence < 0.55, "low_confidence"), (d < 1, "very_short"), (d > 12, "very_long")]
    if text is not None:
        tests.append((is_repetitive(text), "repetitive_text"))
    return F.array_compact(F.array(*[F.when(t, n) for t, n in tests]))


def flagged_report(segments: DataFrame, order: list[str], first: int = 50, partition: str | None = None) -> DataFrame:
    """The first ``first`` flagged segments in order, with the number of all flagged ones.

    The report's length is its feature; the count covers every row.
    """
    f = segments.withColumn("flags", flags(F.col("start"), F.col("end"), F.col("wps"), F.col("confidence"), F.col("text"))).filter(F.size("flags") > 0)
    total = f.agg(F.count("*").alias("flagged_count"))
    return f.withColumn("text", shorten(F.col("text"), 50, "...")).orderBy(*order).limit(first).crossJoin(F.broadcast(total))


def merged_distribution(segments: DataFrame) -> DataFrame:
    """Rows by confidence band after scores were merged, and those from 0.6 up."""
    return segments.agg(
        F.count_if(F.col("confidence") >= 0.8).alias("from_08"),
        F.count_if((F.col("confidence") >= 0.6) & (F.col("confidence") < 0.8)).alias("from_06"),
        F.count_if((F.col("confidence") >= 0.4) & (F.col("confidence") < 0.6)).alias("from_04"),
        F.count_if(F.col("confidence") < 0.4).alias("below_04"),
        F.count_if(F.col("confidence") >= 0.6).alias("usable"),
    )


def score_distribution(segments: DataFrame) -> DataFrame:
    """Counts by alignment, overall and semantic score."""
    a, c, m = F.col("align_score"), F.col("confidence"), F.col("llm_score")
    return segments.agg(
        F.count_if(a >= 0.6).alias("align_high"),
        F.count_if((a >= 0.4) & (a < 0.6)).alias("align_medium"),
        F.count_if(a < 0.4).alias("align_low"),
        F.count_if(c >= 0.7).alias("confidence_high"),
        F.count_if((c >= 0.6) & (c < 0.7)).alias("confidence_medium"),
        F.count_if(m >= 0.7).alias("llm_high"),
        F.count_if((m >= 0.5) & (m < 0.7)).alias("llm_medium"),
    )


def quality_counts(corrections: DataFrame) -> DataFrame:
    """Rows by quality, 0 for unrated."""
    return corrections.groupBy(F.coalesce("quality", F.lit(0)).cast("int").alias("quality")).agg(F.count("*").alias("n"))


def training_ready(corrections: DataFrame, least: int = 4) -> DataFrame:
    """Rows good enough to train on and their seconds."""
    return corrections.filter(F.col("quality") >= least).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0.0)).alias("seconds"))


def progress(total: DataFrame, corrections: DataFrame) -> DataFrame:
    """Total, corrected, remaining and percent."""
    a, b = total.agg(F.count("*").alias("total")), corrections.agg(F.count("*").alias("corrected"))
    both = a.crossJoin(b)
    return both.withColumn("remaining", F.col("total") - F.col("corrected")).withColumn("percent", F.coalesce(F.try_divide(F.col("corrected") * 100.0, F.col("total")), F.lit(0.0)))


def source_counts(corrections: DataFrame) -> DataFrame:
    return corrections.groupBy(F.coalesce("source", F.lit("manual")).alias("source")).agg(F.count("*").alias("n"))


def review_place(order: list[str], partition: str) -> Column:
    return F.row_number().over(Window.partitionBy(partition).orderBy(*order))


def audio_report(files: DataFrame) -> DataFrame:
    """Files, whether any rate suffices, total length and a verdict on it: columns duration and sample_rate."""
    total = F.coalesce(F.sum("duration"), F.lit(0.0))
    g = files.agg(F.count("*").alias("files"), total.alias("seconds"), F.coalesce(F.max("sample_rate") >= 16_000, F.lit(False)).alias("rate_ok"))
    return g.withColumn("length_verdict", F.when(F.col("seconds") >= 3600, "ok").when(F.col("seconds") >= 1800, "warn").otherwise("short"))
