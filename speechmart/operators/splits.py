"""Deterministic splits and samples: rows are ranked by a digest of seed and id, sizes follow from n.

Global ranks come without a global sort in one task: digests are cut into ranges by their leading
characters, counted per range, and ranked within.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))


def ranked(df: DataFrame, seed: int, ids: list[str], strata: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Adds ``rank`` (from 1) and ``n`` by digest, overall or per stratum."""
    keys = strata or []
    marked = df.withColumn("_d", digest(seed, *ids)).withColumn("_p", F.substring("_d", 1, 3))
    # 4096 ranges per stratum: their counts are a bounded table per stratum
    counts = marked.groupBy(*keys, "_p").agg(F.count("*").alias("_k"))
    along = Window.partitionBy(*keys).orderBy("_p")
    bases = counts.select(*keys, "_p", F.coalesce(F.sum("_k").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.sum("_k").over(Window.partitionBy(*keys)).alias("n"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy("_d", *(ties or ids)))
    return marked.join(bases, [*keys, "_p"]).withColumn("rank", (F.col("_base") + inside).cast("long")).drop("_d", "_p", "_base")


def split_80_10_10(df: DataFrame, ids: list[str], seed: int = 42, ties: list[str] | None = None) -> DataFrame:
    r = ranked(df, seed, ids, ties=ties)
    n = F.col("n")
    return r.withColumn("split", F.when(F.col("rank") <= F.floor(n * 0.8), "train").when(F.col("rank") <= F.floor(n * 0.9), "val").otherwise("test")).drop("n", "rank")


def split_capped(df: DataFrame, ids: list[str], seed: int = 42, share: float = 0.05, cap: int = 500, ties: list[str] | None = None) -> DataFrame:
    """test, then valid, of ``share`` each and ``cap`` at most; the rest is train."""
    r = ranked(df, seed, ids, ties=ties)
    k = F.least(F.floor(F.col("n") * share), F.lit(cap))
    return r.withColumn("split", F.when(F.col("rank") <= k, "test").when(F.col("rank") <= 2 * k, "valid").otherwise("train")).drop("n", "rank")


def split_stratified(df: DataFrame, ids: list[str], stratum: str = "tier", seed: int = 42, share: float = 0.05, ties: list[str] | None = None) -> DataFrame:
    """Per stratum: test, then valid, of at least one row each while there are any."""
    r = ranked(df, seed, ids, [stratum], ties)
    k = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    return r.withColumn("split", F.when(F.col("rank") <= k, "test").when(F.col("rank") <= 2 * k, "valid").otherwise("train")).drop("n", "rank")


def review_sample(df: DataFrame, ids: list[str], n: int = 20, seed: int = 42, ties: list[str] | None = None) -> DataFrame:
    """``n`` rows for review: half from confidence 0.7 up, filled from [0.6, 0.7), then from the rest.

    The number is the feature of a review sample; at most ``n`` rows of each stratum are ranked on.
    """
    band = F.when(F.col("confidence") >= 0.7, 0).when(F.col("confidence") >= 0.6, 1).otherwise(2)
    keyed = df.withColumn("band", band).withColumn("_d", digest(seed, *ids))
    in_band = Window.partitionBy("band").orderBy("_d", *(ties or ids))
    # the constant bound lets every task keep its own first rows before the bands are dealt
    top = keyed.withColumn("place", F.row_number().over(in_band)).filter(F.col("place") <= n).filter((F.col("band") != 0) | (F.col("place") <= n // 2))
    order = Window.orderBy("band", "place")
    return top.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= n).drop("_d", "place")
