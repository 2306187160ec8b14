"""Text functions as Column expressions: orthography, four normalizers, keys and names."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from speechmart.dims import FOLD_FROM, FOLD_TO, MACRONS, PLAIN

LETTERS = "abcdefghijklmnopqrstuvwxyz"
MACRON_CLASS = f"[{MACRONS}]"


#: What Python's ``str.strip`` takes away.
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def literal_map(pairs: dict[str, str]) -> Column:
    """A constant map column; an empty dict gives an empty map."""
    if not pairs:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, and not at every place that names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """White-space separated words without empty ones."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def letter_words(text: Column) -> Column:
    """Runs of letters."""
    return F.filter(F.split(text, r"[^\p{L}]+"), lambda w: w != "")


# orthography


def to_plain(text: Column) -> Column:
    """Macron vowels become plain ones."""
    return F.translate(text, MACRONS, PLAIN)


def has_macrons(text: Column) -> Column:
    return text.rlike(MACRON_CLASS)


def count_macrons(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, MACRONS, ""))


def detect_system(text: Column) -> Column:
    """``system4`` with any macron vowel, else ``system6``."""
    return F.when(has_macrons(text), "system4").otherwise("system6")


def to_macron(text: Column, dictionary: dict[str, str] | None = None) -> Column:
    """Words found in the dictionary get their macron form, with the case pattern of the word.

    Marks around a word's letters are kept; words are rejoined by single spaces. Without a dictionary
    the text is unchanged.
    """
    if dictionary is None:
        return text
    table = literal_map({k.lower(): v for k, v in dictionary.items()})
    peel = r"^(\P{L}*)(.*?)(\P{L}*)$"

    def one(w: Column) -> Column:
        core = F.regexp_extract(w, peel, 2)
        found = F.try_element_at(table, F.lower(core))
        first, rest = F.substring(core, 1, 1), F.substring(found, 2, 10**6)
        shout = (core == F.upper(core)) & (core != F.lower(core))
        title = (first == F.upper(first)) & (first != F.lower(first))
        cased = F.when(shout, F.upper(found)).when(title, F.concat(F.upper(F.substring(found, 1, 1)), F.lower(rest))).otherwise(found)
        return F.when(found.isNull(), w).otherwise(F.concat(F.regexp_extract(w, peel, 1), cased, F.regexp_extract(w, peel, 3)))

    return F.array_join(F.transform(words(text), one), " ")


def normalize(text: Column, system: str = "system6", dictionary: dict[str, str] | None = None, fix_curly: bool = False) -> Column:
    """Lower case, backtick as apostrophe, one orthography, other characters to single spaces."""
    if system not in ("system4", "system6"):
        raise ValueError(f"unknown orthography {system!r}")
    t = F.regexp_replace(F.lower(text), "`", "'")
    if fix_curly:
        t = F.regexp_replace(t, "[‘’]", "'")
    if system == "system6":
        t, allowed = to_plain(t), f"[^{LETTERS} ']"
    else:
        if dictionary:
            t = F.when(has_macrons(t), t).otherwise(to_macron(t, dictionary))
        allowed = f"[^{LETTERS}āēīōū ']"
    return F.trim(F.regexp_replace(F.regexp_replace(t, allowed, " "), " +", " "))


def vocabulary(system: str) -> list[str]:
    """Valid characters of an orthography; any other name means the plain one."""
    return [*LETTERS, " ", "'", *("āēīōū" if system == "system4" else "")]


# normalizers of training, scoring and alignment


def _class(characters: str) -> str:
    return "".join("\\" + c if c in "\\^-[]&" else c for c in characters)


def whitelist_training(text: Column, allowed: str = LETTERS + "'|āēīōū") -> Column:
    """Lower case, two apostrophe forms unified, other characters deleted, spaces collapsed."""
    t = F.translate(F.lower(text), "ʻ`", "''")
    return F.trim(F.regexp_replace(F.regexp_replace(t, rf"[^{_class(allowed)}\s]", ""), r"\s+", " "))


def whitelist_scoring(text: Column, allowed: str = LETTERS + "'āēīōū") -> Column:
    """As ``whitelist_training`` without unified apostrophes."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), rf"[^{_class(allowed)}\s]", ""), r"\s+", " "))


def _compose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(text: Column) -> Column:
    """Canonical composition; no built-in function does it."""
    return F.pandas_udf(_compose, "string")(text)


def alignment_text(text: Column, compose: bool = True) -> Column:
    """Composed, lower-cased, without characters that are neither word characters nor white space."""
    t = nfc(text) if compose else text
    return F.regexp_replace(F.lower(t), r"(?U)[^\w\s]", "")


def alignment_words(text: Column, compose: bool = True) -> Column:
    return words(alignment_text(text, compose))


def acoustic_text(text: Column, compose: bool = True) -> Column:
    """``alignment_text`` with letters folded to those of the acoustic model."""
    return F.translate(alignment_text(text, compose), FOLD_FROM, FOLD_TO)


def voiced_text(text: Column, least_words: int = 3, compose: bool = True) -> Column:
    """``alignment_text``, or null with fewer than ``least_words`` words."""
    t = alignment_text(text, compose)
    return F.when(F.size(words(t)) >= least_words, t)


def match_key(word: Column) -> Column:
    """Lower case, word characters only."""
    return F.regexp_replace(F.lower(word), r"(?U)[^\w]", "")


def is_sentence_end(word: Column) -> Column:
    return word.rlike(r"[.!?:]\s*$")


# similarity


def word_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance by the longer word, with one bonus for a known sound change, at most 1."""
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    longest = F.greatest(F.length(x), F.length(y))
    bonus = (
        F.when(F.regexp_replace(x, "k", "t") == F.regexp_replace(y, "k", "t"), 0.3)
        .when(F.regexp_replace(x, "ng", "n") == F.regexp_replace(y, "ng", "n"), 0.2)
        .when(F.regexp_replace(x, "r", "l") == y, 0.15)
        .otherwise(0.0)
    )
    near = F.least(F.lit(1.0), 1 - F.levenshtein(x, y) / longest + bonus)
    return F.when((F.length(x) == 0) | (F.length(y) == 0), 0.0).when(x == y, 1.0).otherwise(near)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of the sets of lower-cased words; 0 if either is empty."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def unique_ratio(text: Column) -> Column:
    w = words(F.lower(text))
    return F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w))


def is_repetitive(text: Column) -> Column:
    """More than three words of which under three tenths are distinct."""
    return (F.size(words(F.lower(text))) > 3) & (unique_ratio(text) < 0.3)


# labels, keys and names


def label_ids(text: Column, vocab: dict[str, int], unknown: int = 3, space: str = "|") -> Column:
    """Ids of the lower-cased characters; a space takes the id of ``space``."""
    table = F.create_map(*[F.lit(x) for kv in vocab.items() for x in kv])
    chars = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.coalesce(F.try_element_at(table, F.when(c == " ", space).otherwise(c)), F.lit(unknown)))


def pad_labels(ids: Column, longest: Column, fill: int = -100) -> Column:
    """Right padding to the group's longest with the masked label."""
    return F.concat(ids, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), longest - F.size(ids)).cast("int")))


def proportional_truncate(text: Column, samples: Column, max_samples: int) -> Column:
    """Keeps the share of the text that the kept audio has, cut at a late space if there is one."""
    target = F.floor(F.length(text) * F.try_divide(F.lit(max_samples), samples)).cast("int")
    cut = F.substring(text, F.lit(1), target)
    last = F.length(cut) - F.locate(" ", F.reverse(cut))
    at_space = (F.locate(" ", cut) > 0) & (last > target * 0.7)
    return F.when(samples <= max_samples, text).when(at_space, F.trim(F.substring(cut, F.lit(1), last))).otherwise(F.trim(cut))


def day_take(name: Column) -> Column:
    """(day, take) numbers in a file name, 0 where missing."""

    def number(pattern: str) -> Column:
        return F.coalesce(F.expr("cast(null as int)"), F.when(name.rlike(pattern), F.regexp_extract(name, pattern, 1).try_cast("int")), F.lit(0))

    return F.struct(number(r"(?i)DAY[_\s]*(\d+)").alias("day"), number(r"(?i)Take[_\s]*(\d+)").alias("take"))


def session_of(path: Column) -> Column:
    """Session inferred from a path."""
    p = F.lower(path)
    return F.when(p.contains("june") | p.contains("24-06-24"), "june").when(p.contains("december") | p.contains("12-24"), "december").otherwise("unknown")


def segment_key(start: Column, end: Column) -> Column:
    """``start-end`` with one decimal each; built-in formatting rounds ties differently."""
    return F.pandas_udf(_keys, "string")(start, end)


def _keys(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for start, end in batches:
        yield pd.Series([None if a is None or b is None or math.isnan(a) or math.isnan(b) else f"{a:.1f}-{b:.1f}" for a, b in zip(start, end, strict=True)])


def character_name(character: Column) -> Column:
    """Unicode name of a character."""
    return F.pandas_udf(_names, "string")(character)


def _names(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda c: unicodedata.name(c, "UNKNOWN") if c else None)


def clip_name(session: Column, index: Column) -> Column:
    return F.format_string("%s_%05d", session, index)


def clip_name_timed(prefix: Column, index: Column, start: Column, end: Column) -> Column:
    """Name with both times; ``start`` and ``end`` are given with one decimal."""
    return F.concat_ws("_", prefix, F.format_string("%04d", index), start, end)


def shorten(text: Column, n: int, mark: str = "") -> Column:
    return F.concat(F.substring(text, 1, n), F.lit(mark))


def strip_special_tokens(text: Column) -> Column:
    return F.regexp_replace(text, "<s>|</s>|<unk>|<pad>", "")


def scoring_prompt(ids: Column, asr: Column, transcript: Column) -> Column:
    """One block of a scoring request."""
    return F.format_string("### Segment %s\nHeard: %s\nWritten: %s\n", ids, asr, transcript)


# waveforms


def clip_samples(samples: Column, start: Column, end: Column, rate: int, bounded: bool = True) -> Column:
    """The samples from ``start`` to ``end`` seconds; null where that is empty."""
    first = F.floor(start * rate).cast("int")
    last = F.floor(end * rate).cast("int")
    if bounded:
        last = F.least(last, F.size(samples))
    return F.when(last > first, F.slice(samples, first + 1, last - first))


def media_length(seconds: Column) -> Column:
    """MM:SS."""
    return F.format_string("%02d:%02d", F.floor(seconds / 60), F.floor(seconds % 60))
