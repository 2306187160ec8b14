"""Rule-based grammar checks and lookups as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechmart import dims
from speechmart.functions.text import bound, literal_map

ISSUE = "array<struct<severity:string,category:string,message:string,position:int>>"
LEVELS = ("strict", "moderate", "permissive")


def _issue(severity: str, category: str, message: Column, position: Column | None = None) -> Column:
    return F.struct(
        F.lit(severity).alias("severity"),
        F.lit(category).alias("category"),
        message.alias("message"),
        (F.lit(None) if position is None else position).cast("int").alias("position"),
    )


def character_issues(text: Column, level: str = "moderate") -> Column:
    """Letters foreign to the traditional alphabet, with their 0-based positions."""
    if level == "permissive":
        return F.array().cast(ISSUE)
    severity = "error" if level == "strict" else "warning"
    at = F.transform(F.split(F.lower(text), ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    found = F.filter(at, lambda x: x["c"].rlike(f"^[{dims.FOREIGN_LETTERS}]$"))
    return F.transform(found, lambda x: _issue(severity, "character", F.concat(F.lit("foreign letter "), x["c"]), x["i"])).cast(ISSUE)


def final_vowel_issues(text: Column, level: str = "moderate") -> Column:
    """Words that do not end in a vowel."""
    severity = "error" if level == "strict" else "warning"
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-zA-ZāēīōūĀĒĪŌŪ']+"), F.lit(0))
    bare = F.filter(found, lambda w: F.regexp_replace(w, "'+$", "").rlike("[^aeiouāēīōū]$"))
    return F.transform(bare, lambda w: _issue(severity, "phonotactic", F.concat(F.lit("word does not end in a vowel: "), w))).cast(ISSUE)


def cluster_issues(text: Column) -> Column:
    """The first run of two or more consonants, ``ng`` counting as one letter that is none of them.

    The check for ``ng`` reads the original text at the offsets of the shortened one.
    """
    low = F.lower(text)
    short = F.regexp_replace(low, "ng", "N")
    run = F.regexp_extract(short, f"[{dims.CLUSTER_CONSONANTS}]{{2,}}", 0)
    at = F.regexp_instr(short, F.lit(f"[{dims.CLUSTER_CONSONANTS}]{{2,}}"))
    hides = F.substring(low, at, F.length(run)).contains("ng")
    hit = (F.length(run) > 0) & ~hides
    return F.when(hit, F.array(_issue("info", "phonotactic", F.concat(F.lit("consonant cluster: "), run)))).otherwise(F.array().cast(ISSUE)).cast(ISSUE)


def validate(text: Column, level: str = "moderate") -> Column:
    """struct(issues, conformant, is_valid): only errors, which only ``strict`` raises, count against a text."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}")
    issues = F.concat(character_issues(text, level), final_vowel_issues(text, level), cluster_issues(text))
    conformant = ~F.exists(issues, lambda i: i["severity"] == "error")
    return F.struct(issues.alias("issues"), conformant.alias("conformant"), (F.lit(level == "permissive") | conformant).alias("is_valid"))


def _nouns() -> dict[str, tuple[str, str]]:
    out = {w: ("o", c) for c, ws in dims.O_CLASS.items() for w in ws}
    return out | {w: ("a", c) for c, ws in dims.A_CLASS.items() for w in ws}


def possessive_class(word: Column) -> Column:
    """``a``, ``o`` or ``?``."""
    table = literal_map({w: k for w, (k, _) in _nouns().items()})
    return F.coalesce(F.try_element_at(table, F.trim(F.lower(word))), F.lit("?"))


def possessive_category(word: Column) -> Column:
    """Category of a listed noun, else null."""
    return F.try_element_at(literal_map({w: c for w, (_, c) in _nouns().items()}), F.trim(F.lower(word)))


def possessive_pronoun(person: Column, number: Column, noun_class: Column, count: Column) -> Column:
    """Form for a singular owner; a placeholder for all others. An unknown class takes ``o``."""
    v = F.when(noun_class == "a", "a").otherwise("o")
    tail = F.when(person == "1", "ku").when(person == "2", "u").when(person == "3", "na")
    known = (number == "singular") & count.isin("singular", "plural") & tail.isNotNull()
    form = F.concat(F.when(count == "singular", "t").otherwise(""), v, tail)
    return F.when(known, form).otherwise(F.concat(F.lit("t"), v, F.lit("??")))


def conjugate(stem: Column, tense: Column, negative: bool = False) -> Column:
    """Particle and stem without its infinitive mark; unknown tenses give the list of known ones."""
    rows = dims.NEGATIVES if negative else dims.TENSES
    particle = F.try_element_at(literal_map({t: p for t, p, _ in rows}), tense)
    bare = F.regexp_replace(stem, "^o ", "")
    unknown = F.concat(F.lit("Unknown tense '"), tense, F.lit("'. Available: " + ", ".join(t for t, _, _ in rows)))
    return F.when(particle.isNull(), unknown).otherwise(F.concat_ws(" ", particle, bare))


def number_for_people(n: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in dims.CARDINALS.items() for x in kv])
    return F.concat(F.lit("toko"), F.coalesce(F.try_element_at(table, n), n.cast("string")))


def alliterate(preceding: Column, pronoun: Column) -> Column:
    """The changed pronoun after a word with an ``s``."""
    changed = F.try_element_at(literal_map(dims.ALLITERATION), F.lower(pronoun))
    return F.when(F.lower(preceding).contains("s") & changed.isNotNull(), changed).otherwise(pronoun)


def located_words(text: Column, only: Iterable[str] | None = None) -> Column:
    """Word tokens of the lower-cased text with 0-based positions: array of (word, position).

    Tokens are maximal runs of word characters, so a listed word is a token exactly where it stands
    between word boundaries. With ``only``, a constant list of words, no other token is located.
    """
    pattern = r"(?U)\w+" if only is None else r"(?U)\b(?:" + "|".join(re.escape(w) for w in only) + r")\b"
    low = F.lower(text)
    found = F.regexp_extract_all(low, F.lit(pattern), F.lit(0))
    pairs = bound(found, lambda w: F.arrays_zip(F.slice(F.split(low, pattern, -1), 1, F.size(w)).alias("g"), w.alias("w")))
    return bound(pairs, _with_positions)


TOKEN = "array<struct<word:string,position:int>>"
_BLOCK = 256


def _with_positions(pairs: Column) -> Column:
    """Positions from the running lengths of (gap g, word w) pairs, block by block, so the work stays linear."""

    def step(s: Column, p: Column) -> Column:
        start = s["pos"] + F.length(p["g"])
        token = F.struct(p["w"].alias("word"), start.alias("position"))
        return F.struct((start + F.length(p["w"])).alias("pos"), F.array_append(s["out"], token).alias("out"))

    def shift(s: Column, b: Column) -> Column:
        return F.struct((s["pos"] + b["pos"]).alias("pos"), F.array_append(s["out"], s["pos"]).alias("out"))

    def merge(blocks: Column) -> Column:
        firsts = F.aggregate(blocks, F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out")), shift)["out"]
        moved = F.zip_with(blocks, firsts, lambda b, k: F.transform(b["out"], lambda t: F.struct(t["word"].alias("word"), (t["position"] + k).alias("position"))))
        return F.flatten(moved)

    empty = F.array().cast(TOKEN)
    local = F.transform(
        F.sequence(F.lit(1), F.size(pairs), F.lit(_BLOCK)),
        lambda k: F.aggregate(F.slice(pairs, k, _BLOCK), F.struct(F.lit(0).alias("pos"), empty.alias("out")), step),
    )
    return F.when(F.size(pairs) > 0, bound(local, merge)).otherwise(empty)


def _listed(df: DataFrame, text_col: str, dim: DataFrame, listed: list[str], key: str, keep: list[str]) -> DataFrame:
    tokens = df.select(*keep, F.explode(located_words(F.col(text_col), listed)).alias("t")).select(*keep, F.col("t.word").alias(key), F.col("t.position").alias("position"))
    return tokens.join(F.broadcast(dim), key)


def verb_phrases(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Every tense or negative particle with its position; the particle table is a constant of ten rows."""
    return _listed(df, text_col, dims.particles(df.sparkSession), [p for _, p, _ in (*dims.TENSES, *dims.NEGATIVES)], "particle", keep)


def pronoun_hits(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Every pronoun with its position, person, number and gloss."""
    return _listed(df, text_col, dims.pronouns(df.sparkSession), [w for w, *_ in dims.PRONOUNS], "pronoun", keep)


def _hits(text: Column, table: dict[str, str]) -> Column:
    listed = literal_map(table)
    return F.transform(located_words(text, table), lambda t: F.struct(t["word"].alias("word"), t["position"].alias("position"), F.try_element_at(listed, t["word"]).alias("sense")))


def analyze(text: Column, level: str = "moderate") -> Column:
    """struct(validation, verb_phrases, pronouns, summary) of one text."""
    tenses = {p: t for t, p, _ in dims.TENSES} | {p: f"neg_{t}" for t, p, _ in dims.NEGATIVES}
    v, verbs, prons = validate(text, level), _hits(text, tenses), _hits(text, {w: g for w, _, _, g in dims.PRONOUNS})
    summary = F.format_string("valid=%s issues=%d particles=%d pronouns=%d", v["is_valid"].cast("string"), F.size(v["issues"]), F.size(verbs), F.size(prons))
    return F.struct(v.alias("validation"), verbs.alias("verb_phrases"), prons.alias("pronouns"), summary.alias("summary"))
