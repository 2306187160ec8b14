"""Groups that end at a limit counted from their own start, without one task that folds a whole file.

Where a group ends depends on where it began, so the groups of a file are a chain: every row points to
the row that would begin the next group if it began one itself. That pointer is a range lookup. The
chain from a run's first row is then followed by pointer doubling: each round doubles the length of all
pointers and the part of the chain that is known, so as many rounds are needed as the number of groups
of the longest run has binary digits. Runs that end before the limit are one group and take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechmart.operators.ranking import running
from speechmart.sources.shared import materialize


def _links(rows: DataFrame, keys: list[str], start: Column, reach: Column, limit: float, inclusive: bool, begins: Column) -> DataFrame:
    """keys, _pos, _next: the first later row that may begin a group and whose reach is beyond start + limit."""
    key_cols = [F.col(f"`{k}`") for k in keys]
    probes = rows.filter(begins).select(*key_cols, "_pos", (-(start + limit)).alias("_v"), F.lit(1 if inclusive else 0).alias("_k"), F.lit(None).cast("long").alias("_hit"))
    events = rows.filter(begins & reach.isNotNull()).select(*key_cols, "_pos", (-reach).alias("_v"), F.lit(0 if inclusive else 1).alias("_k"), F.col("_pos").alias("_hit"))
    # by falling value; of equal reaches the earliest row comes last and so counts
    both = probes.unionByName(events).withColumn("_back", -F.col("_pos"))
    found = running(both, keys, ["_v", "_k", "_back"], {"_next": ("last", F.col("_hit"))})
    return found.filter(F.col("_hit").isNull() & F.col("_next").isNotNull()).select(*key_cols, "_pos", "_next")


def _reached(links: DataFrame, first: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _pos of all rows on the chains from ``first``."""
    same = [F.col(f"`{k}`") for k in keys]
    known, jump = materialize(first.select(*same, "_pos"), "fold-known"), materialize(links, "fold-jumps")
    while True:
        more = materialize(known.join(jump, [*keys, "_pos"]).select(*same, F.col("_next").alias("_pos")), "fold-more")
        if more.isEmpty():
            return known
        known = materialize(known.unionByName(more), "fold-known")
        then = jump.select(*same, F.col("_pos").alias("_next"), F.col("_next").alias("_after"))
        jump = materialize(jump.join(then, [*keys, "_next"]).select(*same, "_pos", F.col("_after").alias("_next")), "fold-jumps")


def limited_groups(rows: DataFrame, keys: list[str], order: list[str], start: str, reach: str, limit: float, inclusive: bool = False, begins: Column | None = None) -> DataFrame:
    """Adds ``_head``: the 0-based place, within ``keys``, of the row that begins a row's group.

    ``keys`` name a run. Its first row begins a group, and so does the first row whose ``reach`` lies
    beyond (or, with ``inclusive``, at or beyond) the group's ``start`` + ``limit``. ``start`` must not fall
    along ``order``, and no row but a run's first may reach beyond its own start + limit. Rows for which
    ``begins`` is false begin no group: they are in the group before them if they lie within its limit, and
    in none (null) otherwise. Keys are not null.
    """
    allowed = F.lit(True) if begins is None else begins
    key_cols = [F.col(f"`{k}`") for k in keys]
    placed = rows.withColumn("_ok", allowed)
    # the reach of a run's first row may lie beyond its own limit; every row after it reaches what the greatest before it did
    placed = materialize(running(placed, keys, order, {"_pos": ("sum", F.lit(1)), "_top": ("max", F.when(F.col(f"`{reach}`") - F.col(f"`{start}`") <= limit, F.col(f"`{reach}`")))}).withColumn("_pos", F.col("_pos") - 1), "fold-rows")
    spans = placed.filter("_ok").groupBy(*key_cols).agg(F.min("_pos").alias("_first"), F.min(start).alias("_from"), F.max(reach).alias("_to"))
    over = F.col("_to") - F.col("_from") >= limit if inclusive else F.col("_to") - F.col("_from") > limit
    spans = materialize(spans.withColumn("_long", over), "fold-spans")
    with_span = placed.join(spans.select(*key_cols, "_first", "_long"), keys, "left")
    chained = with_span.filter("_long and _pos >= _first")
    links = _links(chained, keys, F.col(f"`{start}`"), F.col("_top"), limit, inclusive, F.col("_ok"))
    heads = _reached(links, spans.filter("_long").withColumn("_pos", F.col("_first")), keys).withColumn("_mark", F.lit(True))
    marked = with_span.join(heads, [*keys, "_pos"], "left")
    marked = marked.withColumn("_begin", F.when(F.coalesce("_mark", F.lit(False)) | (F.col("_pos") == F.col("_first")), F.struct(F.col("_pos").alias("p"), F.col(f"`{start}`").alias("s"))))
    carried = running(marked, keys, ["_pos"], {"_group": ("last", F.col("_begin"))})
    beyond = F.col(f"`{reach}`") - F.col("_group.s") >= limit if inclusive else F.col(f"`{reach}`") - F.col("_group.s") > limit
    lost = ~F.col("_ok") & beyond
    return carried.select(*[F.col(f"`{c}`") for c in rows.columns], F.when(~F.coalesce(lost, F.lit(False)), F.col("_group.p")).alias("_head"))
