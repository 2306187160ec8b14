"""Tiers of scored segments and what is taken into the dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_defaults(segments: DataFrame) -> DataFrame:
    """llm_score, align_score and wps filled: the scores from confidence, else 0.5, wps 2."""
    have = set(segments.columns)

    def col(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("double")

    conf = F.coalesce(col("confidence"), F.lit(0.5))
    return segments.withColumns({"llm_score": F.coalesce(col("llm_score"), conf), "align_score": F.coalesce(col("align_score"), conf), "wps": F.coalesce(col("wps"), F.lit(2.0))})


def prefer_sources(*sources: DataFrame) -> DataFrame:
    """The first source that has rows, with defaults filled."""
    for df in sources:
        if not df.isEmpty():
            return with_defaults(df)
    return with_defaults(sources[-1])


def tier(llm: Column, align: Column, wps: Column, high: tuple[float, float] = (0.7, 0.6), usable: tuple[float, float] = (0.5, 0.5), rough: tuple[float, float] = (0.4, 0.4)) -> Column:
    """high_confidence, usable, rough_patch or rejected; an odd pace drops usable to rough."""
    return (
        F.when((llm >= high[0]) & (align >= high[1]), "high_confidence")
        .when((llm >= usable[0]) & (align >= usable[1]) & wps.between(1.0, 4.5), "usable")
        .when((llm >= rough[0]) & (align >= rough[1]), "rough_patch")
        .otherwise("rejected")
    )


def neighbor_score(order: list, window: int = 2, audio: str = "audio_path") -> Column:
    """Mean confidence of up to ``window`` rows on both sides in the same file, without the row itself; 0 alone."""
    near = Window.partitionBy(audio).orderBy(*order).rowsBetween(-window, window)
    conf = F.coalesce("confidence", F.lit(0.5))
    n = F.count("*").over(near) - 1
    return F.when(n > 0, (F.sum(conf).over(near) - conf) / n).otherwise(0.0)


def assign(segments: DataFrame, order: list, bridge: float = 0.6, rough_patches: bool = True, audio: str = "audio_path") -> DataFrame:
    """tier, neighbor_score (rough rows only), label and included."""
    t = with_defaults(segments)
    t = t.withColumn("tier", tier(F.col("llm_score"), F.col("align_score"), F.col("wps"))).withColumn("_near", neighbor_score(order, audio=audio))
    rough = F.col("tier") == "rough_patch"
    bridged = rough & (F.col("_near") >= bridge) & F.lit(rough_patches)
    return t.withColumns(
        {
            "neighbor_score": F.when(rough, F.col("_near")),
            "label": F.when(bridged, "bridge_segment").otherwise(F.col("tier")),
            "included": F.col("tier").isin("high_confidence", "usable") | bridged,
        }
    ).drop("_near")


def keep_clips(segments: DataFrame, confidence: float = 0.6, low: float = 0.5, high: float = 30.0) -> DataFrame:
    """Rows confident enough (a missing confidence counts as 1) and of a usable length."""
    return segments.filter((F.coalesce("confidence", F.lit(1.0)) >= confidence) & (F.col("end") - F.col("start")).between(low, high))


def skip_long(segments: DataFrame, longest: float = 30.0, duration: str = "duration") -> DataFrame:
    """Rows up to a length; a missing length counts as 0 and stays."""
    return segments.filter(F.coalesce(duration, F.lit(0.0)) <= longest)


def tier_counts(tiered: DataFrame) -> DataFrame:
    return tiered.groupBy("tier").agg(F.count("*").alias("n"))
