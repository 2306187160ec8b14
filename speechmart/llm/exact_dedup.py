"""Exact deduplication with a cuckoo-filter index.

Rows are reduced to (id, digest) once. Copies are first counted per digest and salt, so a group that
holds a third of all rows reaches its bucket as one row per salt at most, and salts are as many as the
session has shuffle partitions, however large the input is. These partial rows go to digest buckets of
bounded size, each with a cuckoo filter whose slots point into the bucket's stored digests. The filter
decides what is read: a miss is a new digest and is inserted without reading any stored one; a hit is
verified against the digests that its slots point to, and those alone; a better owner deletes the live
entry and inserts its own; an overflow builds a filter of twice the size from the stored keys.

Texts are equal when identical after lower-casing A-Z, as told by SHA-256; null counts as empty. Of
equal texts the row with the largest id stays (null ids lose to all; of rows with the same id, the one
read last). Every input row gives one output row; an empty table gives none; other columns are not
read. Texts of any length are digested in the scan.
"""

from __future__ import annotations

from array import array

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .common import lower_ascii, materialize, pick

BUCKET_ROWS = 100_000


class CuckooIndex:
    """Cuckoo filter over live digests; its slots point to the digests' places in ``keys``.

    The filter has buckets of four 16-bit fingerprints; an item may lie in either of two buckets
    that are found from each other by the fingerprint. Nothing but the filter leads to a stored
    digest.
    """

    WIDTH, KICKS = 4, 200

    def __init__(self, capacity: int = 64) -> None:
        self.bits = max(2, (max(1, capacity) // self.WIDTH).bit_length())
        self.keys: list[bytes] = []
        self.values: list[list | None] = []
        self.resizes = self.reads = 0
        self._clear()

    def _clear(self) -> None:
        self.marks = array("H", bytes(2 * self.WIDTH << self.bits))
        self.places = array("q", bytes(8 * self.WIDTH << self.bits))

    def _seats(self, key: bytes) -> tuple[int, int, int]:
        mask = (1 << self.bits) - 1
        mark = (int.from_bytes(key[:2], "little") % 65535) + 1
        one = int.from_bytes(key[2:10], "little") & mask
        return mark, one, one ^ (mark * 0x5BD1E995 & mask)

    def _hits(self, key: bytes) -> list[int]:
        """Slots that hold the key's fingerprint."""
        mark, one, two = self._seats(key)
        marks, w = self.marks, self.WIDTH
        return [at for b in ((one, two) if one != two else (one,)) for at in range(b * w, b * w + w) if marks[at] == mark]

    def _put(self, key: bytes, place: int) -> bool:
        mark, one, two = self._seats(key)
        marks, places, w = self.marks, self.places, self.WIDTH
        for b in (one, two):
            for at in range(b * w, b * w + w):
                if not marks[at]:
                    marks[at], places[at] = mark, place
                    return True
        b, mask = two, (1 << self.bits) - 1
        for turn in range(self.KICKS):
            at = b * w + turn % w
            mark, marks[at] = marks[at], mark
            place, places[at] = places[at], place
            b ^= mark * 0x5BD1E995 & mask
            for at in range(b * w, b * w + w):
                if not marks[at]:
                    marks[at], places[at] = mark, place
                    return True
        return False

    def _grow(self) -> None:
        live = [k for k, v in enumerate(self.values) if v is not None]
        self.keys, self.values = [self.keys[k] for k in live], [self.values[k] for k in live]
        while True:
            self.bits += 1
            self.resizes += 1
            self._clear()
            if all(self._put(key, k) for k, key in enumerate(self.keys)):
                return

    def maybe(self, key: bytes) -> bool:
        """The filter's answer: false is certain, true may be wrong."""
        return bool(self._hits(key))

    def _find(self, key: bytes) -> tuple[int, int] | None:
        for at in self._hits(key):
            self.reads += 1
            if self.keys[self.places[at]] == key:
                return at, self.places[at]
        return None

    def find(self, key: bytes) -> list | None:
        """The value under ``key``, verified against the stored digest."""
        found = self._find(key)
        return None if found is None else self.values[found[1]]

    def insert(self, key: bytes, value: list) -> None:
        """Adds a digest that is not live yet."""
        self.keys.append(key)
        self.values.append(value)
        if not self._put(key, len(self.keys) - 1):
            self._grow()

    def delete(self, key: bytes) -> None:
        """Removes a live digest; its stored key goes with the next resizing."""
        found = self._find(key)
        if found is not None:
            self.marks[found[0]], self.values[found[1]] = 0, None


def _resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket's partial rows, each with the owner and size of its digest's group."""
    index = CuckooIndex()
    keys = [bytes.fromhex(x) for x in pdf["text_sha256"]]
    for key, has, top, rid, n in zip(keys, pdf["has_id"], pdf["top_id"], pdf["top_rid"], pdf["n"], strict=True):
        owner, live = (bool(has), int(top), int(rid)), index.find(key)
        if live is None:
            index.insert(key, [owner, int(n)])
        elif owner > live[0]:
            index.delete(key)
            index.insert(key, [owner, int(n) + live[1]])
        else:
            live[1] += int(n)
    found = [index.find(k) for k in keys]
    return pd.DataFrame(
        {
            "salt": pdf["salt"],
            "text_sha256": pdf["text_sha256"],
            "keep_has": [v[0][0] for v in found],
            "keep_top": [v[0][1] for v in found],
            "keep_rid": [v[0][2] for v in found],
            "group_size": [v[1] for v in found],
        }
    )


def _digest(text: Column) -> Column:
    return F.sha2(F.encode(lower_ascii(F.coalesce(text, F.lit(""))), "UTF-8"), 256)


def dedup_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256."""
    d = pick(docs, [id_col, text_col])
    salts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = materialize(
        d.select(F.col(id_col).cast("long").alias("_id"), _digest(F.col(text_col)).alias("text_sha256"), F.monotonically_increasing_id().alias("_rid")),
        "dedup-rows",
    ).withColumn("salt", F.pmod(F.shiftright("_rid", 33), F.lit(salts)).cast("int"))
    owner = F.struct(F.col("_id").isNotNull().alias("h"), F.coalesce("_id", F.lit(0)).alias("i"), F.col("_rid").alias("r"))
    partial = rows.groupBy("salt", "text_sha256").agg(F.max(owner).alias("o"), F.count("*").alias("n"))
    buckets = max(1, -(-rows.count() // bucket_rows))
    resolved = (
        partial.select(
            "salt",
            "text_sha256",
            F.col("o.h").alias("has_id"),
            F.col("o.i").alias("top_id"),
            F.col("o.r").alias("top_rid"),
            "n",
            F.pmod(F.xxhash64("text_sha256"), F.lit(max(buckets, 4 * salts))).alias("bucket"),
        )
        .groupBy("bucket")
        .applyInPandas(_resolve, "salt int, text_sha256 string, keep_has boolean, keep_top long, keep_rid long, group_size long")
    )
    return rows.join(resolved, ["salt", "text_sha256"]).select(
        F.col("_id").alias(id_col),
        F.when(F.col("keep_has"), F.col("keep_top")).alias("keep_id"),
        "group_size",
        (F.col("_rid") == F.col("keep_rid")).alias("kept"),
        "text_sha256",
    )


def keep_first_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one for every distinct text, with the largest id.

    Of rows equal in id and text the one with the greatest other columns stays (columns whose type has
    no order do not count). Null texts and ids are as in ``dedup_exact``; an empty table stays empty.
    Whole rows are shuffled once, by digest and id, which spreads a hot group over its ids.
    """
    keys = ["_sha", "_has", "_key"]
    stay = dedup_exact(docs, id_col, text_col).filter("kept")
    stay = stay.select(F.col("text_sha256").alias("_sha"), F.col(f"`{id_col}`").isNotNull().alias("_has"), F.coalesce(F.col(f"`{id_col}`"), F.lit(0)).alias("_key"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    as_long = F.col(f"`{id_col}`").cast("long")
    marked = docs.select(_digest(F.col(f"`{text_col}`")).alias("_sha"), as_long.isNotNull().alias("_has"), F.coalesce(as_long, F.lit(0)).alias("_key"), F.struct(*names).alias("_row"))
    ordered = [F.col("_row")[f.name] for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))] or [F.lit(0)]
    return marked.join(stay, keys).groupBy(*keys).agg(F.max_by("_row", F.struct(*ordered)).alias("_row")).select("_row.*")
