"""Error rates of transcripts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from speechmart.functions.distance import edit_distance
from speechmart.functions.text import normalize, to_plain, words


@F.pandas_udf(IntegerType())
def _word_distance(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else edit_distance(list(a), list(b)) for a, b in zip(reference, hypothesis, strict=True)], dtype="Int32")


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Edit distance of two word arrays, by bit vectors over the words' places; null where an array is null.

    No built-in function compares arrays by edits, and turning words into letters for ``levenshtein`` takes
    a linear search a word.
    """
    return _word_distance(reference, hypothesis)


@F.pandas_udf(IntegerType())
def _character_distance(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else edit_distance(a, b) for a, b in zip(reference, hypothesis, strict=True)], dtype="Int32")


def character_distance(reference: Column, hypothesis: Column) -> Column:
    """``levenshtein`` by bit vectors: a text of n characters takes n steps on integers of n bits, and not n times n."""
    return _character_distance(reference, hypothesis)


def _guarded(reference: Column, hypothesis: Column, rate: Column) -> Column:
    no_ref, no_hyp = F.trim(reference) == "", F.trim(hypothesis) == ""
    return F.when(no_ref, F.when(no_hyp, 0.0).otherwise(1.0)).when(no_hyp, 1.0).otherwise(rate)


def wer(reference: Column, hypothesis: Column) -> Column:
    """Word errors by reference words; 0 or 1 where a side is blank."""
    r, h = words(reference), words(hypothesis)
    return _guarded(reference, hypothesis, F.try_divide(word_distance(r, h), F.size(r)))


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character errors, spaces included, by reference characters."""
    return _guarded(reference, hypothesis, F.try_divide(character_distance(reference, hypothesis), F.length(reference)))


def _positional(r: Column, h: Column) -> Column:
    short = F.least(F.size(r), F.size(h))
    wrong = F.size(F.filter(F.arrays_zip(F.slice(r, 1, short).alias("a"), F.slice(h, 1, short).alias("b")), lambda p: p["a"] != p["b"]))
    return F.least(F.lit(1.0), F.try_divide(wrong + F.abs(F.size(r) - F.size(h)), F.size(r)))


def positional_wer(reference: Column, hypothesis: Column) -> Column:
    """Word by word comparison at equal positions plus the difference in length, at most 1."""
    return _guarded(reference, hypothesis, _positional(words(reference), words(hypothesis)))


def positional_cer(reference: Column, hypothesis: Column) -> Column:
    """The same for characters without spaces."""

    def chars(t: Column) -> Column:
        return F.filter(F.split(F.regexp_replace(t, " ", ""), ""), lambda c: c != "")

    return _guarded(reference, hypothesis, _positional(chars(reference), chars(hypothesis)))


def corpus_rates(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """One row: wer and cer over all pairs whose reference is not blank, by summed errors."""
    r, h = words(F.col(reference)), words(F.col(hypothesis))
    kept = pairs.filter(F.trim(reference) != "").select(
        word_distance(r, h).alias("we"),
        F.size(r).alias("wn"),
        character_distance(F.col(reference), F.col(hypothesis)).alias("ce"),
        F.length(reference).alias("cn"),
    )
    return kept.agg(
        F.try_divide(F.sum("we"), F.sum("wn")).alias("wer"),
        F.try_divide(F.sum("ce"), F.sum("cn")).alias("cer"),
        F.count("*").alias("pairs"),
    )


def trainer_rates(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """``corpus_rates`` as trainers report them: an empty text counts as one space."""

    def spaced(c: str) -> Column:
        return F.when(F.col(c) == "", " ").otherwise(F.col(c)).alias(c)

    return corpus_rates(pairs.select(spaced(reference), spaced(hypothesis)), reference, hypothesis)


def dual_orthography(hypothesis: Column, macron_reference: Column, plain_reference: Column) -> Column:
    """struct of wer and cer in both orthographies."""
    heard = normalize(hypothesis, "system4")
    s4 = normalize(macron_reference, "system4")
    s6 = normalize(plain_reference, "system6")
    plain = to_plain(heard)
    return F.struct(
        wer(s4, heard).alias("wer_system4"),
        wer(s6, plain).alias("wer_system6"),
        cer(s4, heard).alias("cer_system4"),
        cer(s6, plain).alias("cer_system6"),
    )
