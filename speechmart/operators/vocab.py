"""Character vocabularies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechmart.functions.text import normalize, vocabulary

# Reserved labels.
RESERVED = ["<pad>", "<s>", "</s>", "<unk>", "|"]


def characters(texts: DataFrame, text: Column, key: str) -> DataFrame:
    """key, pos, ch of every character."""
    return texts.select(key, F.posexplode(F.filter(F.split(text, ""), lambda c: c != "")).alias("pos", "ch"))


def distinct_characters(texts: DataFrame, text: Column, key: str) -> DataFrame:
    """key, ch, pos, n of every character that a text has: where it stands first, and how often it occurs."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, codes, first, counts = [], [], [], []
                for k, t in enumerate(part.column(1)):
                    if t.is_valid:
                        c, f, n = np.unique(np.frombuffer(t.as_py().encode("utf-32-le"), "<u4"), return_index=True, return_counts=True)
                        rows += [k] * len(c)
                        codes += map(chr, c.tolist())
                        first += f.tolist()
                        counts += n.tolist()
                values = [pa.array(codes, pa.string()), pa.array(first, pa.int32()), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), *values], names=[key, "ch", "pos", "n"])

    return texts.select(key, text.alias("_text")).mapInArrow(run, f"`{key}` {kind}, ch string, pos int, n long")


def ctc_vocabulary(texts: DataFrame, system: str = "system6", text: str = "text", key: str = "doc_id") -> DataFrame:
    """token, id: reserved ones, then characters by frequency, then valid ones that do not occur.

    Equal counts go by first appearance in (key, position) order. A text is counted as a whole, and counts
    are combined before the shuffle, so no character is a row of its own.
    """
    chars = distinct_characters(texts, normalize(F.col(text), system), key)
    seen = chars.groupBy("ch").agg(F.sum("n").alias("n"), F.min(F.struct(key, "pos")).alias("first"))
    spark = texts.sparkSession
    valid = spark.createDataFrame([(c, k) for k, c in enumerate(sorted(vocabulary(system)))], "ch string, code int")
    ranked = valid.join(seen, "ch", "left")
    order = Window.orderBy(F.col("n").desc_nulls_last(), F.col("first").asc_nulls_last(), "code")
    ids = ranked.select(F.col("ch").alias("token"), (F.row_number().over(order) + len(RESERVED) - 1).cast("int").alias("id"))
    return spark.createDataFrame([(t, k) for k, t in enumerate(RESERVED)], "token string, id int").unionByName(ids)


def character_counts(texts: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """ch, n over all texts: counted by code point in each batch, then summed, so no character is a row of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[int, int] = {}
            for t in batch.column(0):
                if t.is_valid:
                    codes, counts = np.unique(np.frombuffer(t.as_py().encode("utf-32-le"), "<u4"), return_counts=True)
                    for c, n in zip(codes.tolist(), counts.tolist(), strict=True):
                        total[c] = total.get(c, 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(list(map(chr, total)), pa.string()), pa.array(list(total.values()), pa.int64())], names=["ch", "n"])

    return texts.select(text).mapInArrow(run, "ch string, n long").groupBy("ch").agg(F.sum("n").alias("n"))


def ranked_characters(texts: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``character_counts`` with the rank by count, ties by character."""
    return character_counts(texts, text, key).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "ch")))


def alphabet(texts: DataFrame, text: str = "text", key: str = "doc_id", extra: str = "'") -> DataFrame:
    """Letters and apostrophes that occur, lower-cased."""
    chars = character_counts(texts.withColumn(text, F.lower(text)), text, key)
    return chars.filter(F.col("ch").rlike(r"^\p{L}$") | (F.col("ch") == extra))


def uncovered(texts: DataFrame, system: str = "system6", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Characters of the lower-cased texts outside a vocabulary, with counts."""
    chars = character_counts(texts.withColumn(text, F.lower(text)), text, key)
    return chars.filter(~F.col("ch").isin(vocabulary(system)))


def is_standard(character: Column, system: str = "system4") -> Column:
    return F.lower(character).isin(vocabulary(system))
