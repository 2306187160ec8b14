"""Running totals and positions over long orders, without one task that holds a whole order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechmart.sources.shared import materialize


def running_total(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before a row, in ``order`` within ``keys``.

    Rows are dealt to ranges of (keys, order) and written once; totals per range, as few as there are
    ranges, give each range its base, and the rest is a window inside a range. A key of any size, or no
    key at all, so spreads over all ranges. Rows equal in keys and order count in no stated order among
    themselves. Null keys form one group of their own.
    """
    along = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    # the value is taken after the rows are dealt, so that the sampling of the ranges need not work it out
    dealt = materialize(df.repartitionByRange(*along).withColumns({"_v": value.cast("long"), "_run": F.spark_partition_id()}), "ranges")
    sums = dealt.groupBy(*keys, "_run").agg(F.sum("_v").alias("_s"))
    ranges = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col("_run").alias("_range"), F.coalesce(F.sum("_s").over(ranges), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_run").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    same = F.col("_run") == F.col("_range")
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    return placed.join(bases, same).select(*df.columns, (F.col("_base") + F.col("_in")).alias(name))


def _same_key(keys: list[str]) -> Column:
    """Joins rows to the ranges table of ``_bases``."""
    same = F.col("_run") == F.col("_range")
    for n, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{n}"))
    return same


def _bases(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The ranges table under names of its own."""
    for n, k in enumerate(keys):
        ranges = ranges.withColumnRenamed(k, f"_k{n}")
    return ranges.withColumnRenamed("_run", "_range")


def running(df: DataFrame, keys: list[str], order: list[str], what: dict[str, tuple[str, Column]], own: bool = True) -> DataFrame:
    """Adds running values over all rows up to a row, and with ``own`` including it, in ``order`` within ``keys``.

    ``what`` gives each new column its kind and value: ``sum``, ``max``, or ``last`` for the last value
    that is not null. Rows are dealt to ranges as by ``running_total``, so a key of any size spreads over
    all ranges. Rows equal in keys and order count in no stated order among themselves.
    """
    along = [F.col(f"`{c}`").asc_nulls_first() for c in [*keys, *order]]
    values = {f"_v_{name}": value for name, (_, value) in what.items()}
    dealt = materialize(df.repartitionByRange(*along).withColumns(values | {"_run": F.spark_partition_id()}), "ranges")
    place = F.struct(*[F.col(f"`{c}`") for c in order])
    whole = {"sum": F.sum, "max": F.max, "last": lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), place))}
    over = {"sum": F.sum, "max": F.max, "last": lambda v: F.last(v, ignorenulls=True)}
    ranges = dealt.groupBy(*[F.col(f"`{k}`") for k in keys], "_run").agg(*[whole[kind](f"_v_{name}").alias(f"_t_{name}") for name, (kind, _) in what.items()])
    before = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumns({f"_b_{name}": over[kind](f"_t_{name}").over(before) for name, (kind, _) in what.items()})
    inside = Window.partitionBy(*[F.col(f"`{k}`") for k in keys], "_run").orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    placed = dealt.withColumns({f"_i_{name}": over[kind](f"_v_{name}").over(inside) for name, (kind, _) in what.items()})
    joined = placed.join(_bases(ranges.drop(*[f"_t_{name}" for name in what]), keys), _same_key(keys))
    put = {
        "sum": lambda b, i: F.coalesce(b + i, i, b, F.lit(0)),
        "max": lambda b, i: F.greatest(b, i),
        "last": lambda b, i: F.coalesce(i, b),
    }
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[put[kind](F.col(f"_b_{name}"), F.col(f"_i_{name}")).alias(name) for name, (kind, _) in what.items()])


def numbered_runs(df: DataFrame, keys: list[str], order: list[str], carry: list[str], breaks: Callable[[Callable[[str], Column], Callable[[str], Column]], Column], name: str) -> DataFrame:
    """Adds ``name``: the number of the run a row lies in, from 1 within ``keys``, in ``order``.

    ``breaks(own, previous)`` tells whether a row starts a new run, from the columns ``carry`` of the row
    and of the one before it; the first row of a key always does. Rows are dealt to ranges as by
    ``running_total``, each of which passes on its last row and its count.
    """
    key_cols = [F.col(f"`{k}`") for k in keys]
    along = [F.col(f"`{c}`").asc_nulls_first() for c in [*keys, *order]]
    # the row's own number breaks ties, so that all steps see one order
    dealt = materialize(df.repartitionByRange(*along).withColumn("_run", F.spark_partition_id()), "ranges").withColumn("_id", F.monotonically_increasing_id())
    row = F.struct(*[F.col(f"`{c}`") for c in carry])
    inside = Window.partitionBy(*key_cols, "_run").orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in order], "_id")
    rows = dealt.withColumn("_own", row).withColumn("_prev", F.lag(row).over(inside)).withColumn("_at", F.row_number().over(inside))

    def broken(own: str, previous: str) -> Column:
        return F.coalesce(breaks(lambda c: F.col(f"{own}.`{c}`"), lambda c: F.col(f"{previous}.`{c}`")), F.lit(False))

    rows = rows.withColumn("_new", F.when(F.col("_at") > 1, broken("_own", "_prev").cast("long")).otherwise(0))
    ranges = rows.groupBy(*key_cols, "_run").agg(F.sum("_new").alias("_n"), F.min_by("_own", "_at").alias("_first"), F.max_by("_own", "_at").alias("_last"))
    order_of_ranges = Window.partitionBy(*key_cols).orderBy("_run")
    ranges = ranges.withColumn("_before", F.lag("_last").over(order_of_ranges)).withColumn("_rank", F.row_number().over(order_of_ranges))
    ranges = ranges.withColumn("_head", F.when((F.col("_rank") == 1) | broken("_first", "_before"), 1).otherwise(0))
    ranges = ranges.withColumn("_base", F.sum(F.col("_n") + F.col("_head")).over(order_of_ranges.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    counted = rows.withColumn("_in", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    joined = counted.join(_bases(ranges.select(*key_cols, "_run", "_base"), keys), _same_key(keys))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_base") + F.col("_in")).cast("long").alias(name))


def fresh(df: DataFrame) -> DataFrame:
    """The same rows under new attributes.

    Two sides of a cogroup that share a source share attributes, and Spark then may hand the columns of
    one side to the other; renamed sides cannot be mixed up.
    """
    return df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns])


def spread(df: DataFrame, key: str) -> DataFrame:
    """The same rows dealt by ``key`` to as many partitions as keep every core busy.

    Few bytes of rows may be much work for a Python step; without a stated number Spark would put them
    into one partition.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.col(f"`{key}`"))


def positions(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: the 0-based position of every row in ``order`` within ``keys``."""
    return running_total(df, keys, order, F.lit(1), name)
