"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of virtual slots; bytes are aggregated per slot; a versioned
map sends slots to shards. The map is a table, one folder per version, that is only ever added to:
version 1 deals the slots in turn, and every rebalancing reads the latest version, edits it by the
slots' bytes and stores the next. Records are never rehashed. Only DataFrame and SQL functions run on
the data; the driver sees one row per virtual slot, a number that is fixed.

Law: ``bytes``. A rebalanced map's shards differ by little more than one small slot. A slot is chosen
by id and text together, so a group of equal texts under different ids spreads over all slots and
shards like any other rows, however large it is; the law does not keep equal texts together.

Nulls and odd input: a null text has size 1; a null id is hashed by its text alone; equal rows share
a slot and get distinct positions; an empty table gives an empty result and the map of version 1.
Only the two named columns are read, so further columns never clash. Places within a shard come from
a sort within each virtual slot: as many tasks as slots, narrow rows, on disk where they do not fit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, pick, shared_dir

VIRTUAL_SLOTS = 4096


def virtual_slot(doc_id: Column, text: Column, n_slots: int = VIRTUAL_SLOTS) -> Column:
    """The slot of a record: by its id and text, so a hot text spreads over all slots."""
    return F.pmod(F.xxhash64(doc_id, F.crc32(F.encode(text, "UTF-8"))), F.lit(n_slots)).cast("int")


def first_map(n_shards: int, n_slots: int = VIRTUAL_SLOTS) -> list[int]:
    """Version 1: slots dealt to the shards in turn, before anything is known of their bytes."""
    return [slot % n_shards for slot in range(n_slots)]


def rebalance(old: list[int], slot_bytes: dict[int, int], n_shards: int) -> list[int]:
    """The old map edited for ``n_shards``: slots leave only shards above the mean, or shards that go.

    With more shards than before, slots move only into the new ones; the rest of the map stays.
    """
    new, before = list(old), max(old, default=-1) + 1
    loads = [0] * max(n_shards, before)
    for slot, shard in enumerate(old):
        loads[shard] += slot_bytes.get(slot, 0)
    mean = sum(loads) / max(1, n_shards)
    targets = range(before, n_shards) if n_shards > before else range(n_shards)
    for slot in sorted(range(len(old)), key=lambda s: (-slot_bytes.get(s, 0), s)):
        size, src = slot_bytes.get(slot, 0), new[slot]
        dst = min(targets, key=lambda s: (loads[s], s))
        levels = loads[src] - size / 2 >= mean and loads[dst] + size / 2 <= mean and loads[dst] + size < loads[src]
        if src >= n_shards or levels:
            loads[src] -= size
            loads[dst] += size
            new[slot] = dst
    return new


def store_map(spark: SparkSession, path: str, shards: list[int], version: int) -> None:
    """Adds a version to the map's table (version, virtual_slot, shard); fails where that version exists."""
    slot = F.col("id").cast("int")
    rows = spark.range(len(shards)).select(slot.alias("virtual_slot"), map_column(shards, slot).cast("int").alias("shard"))
    rows.coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]] | None:
    """(version, shard of every slot) of one version, the latest by default; none where nothing is stored."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    chosen = stored.agg(F.max("version")).first()[0] if version is None else version
    rows = stored.filter(F.col("version") == chosen).orderBy("virtual_slot").select("shard").collect()
    if not rows:
        raise ValueError(f"no version {chosen} of the slot map in {path}")
    return chosen, [r["shard"] for r in rows]


def rebalance_stored(spark: SparkSession, path: str, slot_bytes: dict[int, int], n_shards: int, n_slots: int = VIRTUAL_SLOTS) -> tuple[int, list[int]]:
    """Edits the latest stored map for these bytes and shards and stores it as the next version.

    Where nothing is stored, version 1 is stored first; where no slot has to move, no version is added.
    """
    known = load_map(spark, path)
    if known is None:
        known = 1, first_map(n_shards, n_slots)
        store_map(spark, path, known[1], 1)
    version, old = known
    new = rebalance(old, slot_bytes, n_shards)
    if new == old:
        return known
    store_map(spark, path, new, version + 1)
    return version + 1, new


def map_column(values: list[int], slot: Column) -> Column:
    """Looks up ``slot`` in a constant array that holds one number per virtual slot."""
    return F.element_at(F.from_json(F.lit(json.dumps(values)), "array<bigint>"), slot + 1)


def shard_documents(
    docs: DataFrame,
    n_shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_slots: int = VIRTUAL_SLOTS,
    map_path: str | None = None,
    map_version: int | None = None,
) -> DataFrame:
    """Every row with its virtual slot, shard and place in the shard.

    Returns id, size, text_crc32, law, shard, slot (place in the shard, gapless from 0),
    grown_shard (null under this law), virtual_slot and map_version.

    The map stored under ``map_path`` (a new one in the session's shared folder by default) is
    rebalanced for these rows and ``n_shards``, and the rows are placed by the version that comes out.
    With ``map_version`` they are placed by that stored version as it is.
    """
    spark = docs.sparkSession
    d = pick(docs, [id_col, text_col])
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = materialize(
        d.select(
            F.col(id_col),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            virtual_slot(F.col(id_col), text, n_slots).alias("virtual_slot"),
        ),
        "shard-rows",
    )
    stats = narrow.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    slot_bytes = {r["virtual_slot"]: r["b"] for r in stats}
    slot_rows = {r["virtual_slot"]: r["n"] for r in stats}
    path = map_path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    if map_version is None:
        version, shards = rebalance_stored(spark, path, slot_bytes, n_shards, n_slots)
    else:
        known = load_map(spark, path, map_version)
        if known is None:
            raise ValueError(f"no slot map in {path}")
        version, shards = known
    first, used = [0] * n_slots, [0] * (max(shards) + 1)
    for slot in range(n_slots):
        first[slot] = used[shards[slot]]
        used[shards[slot]] += slot_rows.get(slot, 0)
    place = Window.partitionBy("virtual_slot").orderBy(F.col(id_col).asc_nulls_last(), "text_crc32", "size")
    return narrow.select(
        id_col,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        map_column(shards, F.col("virtual_slot")).cast("int").alias("shard"),
        (map_column(first, F.col("virtual_slot")) + F.row_number().over(place) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(version).alias("map_version"),
    )
