"""Queries over text functions, grammar, vocabularies and error rates."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechmart import dims
from speechmart.functions import grammar, metrics
from speechmart.functions import text as T
from speechmart.operators import scoring, vocab
from speechmart.queries.adapters import ACCENTS, DICTIONARY, MACRON_TARGET, macron, read, with_next_turn

QUERIES, SQL = {}, {}
_M = f"translate(text, '{ACCENTS}', '{MACRON_TARGET}')"
_MACRONS, _PLAIN = dims.MACRONS, dims.PLAIN


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", macron(F.col("text")).alias("m"), "text", "n_chars", "source")


@query(f"SELECT doc_id, md5(translate({_M}, '{_MACRONS}', '{_PLAIN}')) AS plain_md5 FROM documents")
def ortho_to_plain(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.to_plain(F.col("m"))).alias("plain_md5"))


@query(
    f"""WITH x AS (SELECT doc_id, {_M} AS m FROM documents)
SELECT doc_id, CASE WHEN n > 0 THEN 'system4' ELSE 'system6' END AS system, n > 0 AS has_macrons, CAST(n AS INTEGER) AS n_macrons
FROM (SELECT doc_id, length(m) - length(translate(m, '{_MACRONS}', '')) AS n FROM x)"""
)
def ortho_detect_counts(spark, d):
    m = F.col("m")
    return _docs(spark, d).select("doc_id", T.detect_system(m).alias("system"), T.has_macrons(m).alias("has_macrons"), T.count_macrons(m).alias("n_macrons"))


def _norm_sql(inner: str, allowed: str) -> str:
    return f"trim(regexp_replace(regexp_replace({inner}, '[^{allowed} '']', ' ', 'g'), ' +', ' ', 'g'))"


_TICKED = f"replace(lower({_M}), '`', '''')"
_PLAIN_NORM = _norm_sql(f"translate({_TICKED}, '{_MACRONS}', '{_PLAIN}')", "a-z")
_MACRON_NORM = _norm_sql(_TICKED, "a-zāēīōū")


@query(f"SELECT doc_id, md5({_PLAIN_NORM}) AS norm_md5 FROM documents")
def ortho_normalize_plain(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.normalize(F.col("m"), "system6")).alias("norm_md5"))


@query(f"SELECT doc_id, md5({_MACRON_NORM}) AS norm_md5 FROM documents")
def ortho_normalize_macron(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.normalize(F.col("m"), "system4")).alias("norm_md5"))


_DICT_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in DICTIONARY.items())


@query(
    f"""WITH dict(k, v) AS (VALUES {_DICT_VALUES}),
w AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), 1) AS p FROM conversations),
x AS (SELECT *, regexp_extract(w, '^([^\\p{{L}}]*)(.*?)([^\\p{{L}}]*)$', 1) AS a, regexp_extract(w, '^([^\\p{{L}}]*)(.*?)([^\\p{{L}}]*)$', 2) AS c, regexp_extract(w, '^([^\\p{{L}}]*)(.*?)([^\\p{{L}}]*)$', 3) AS z FROM w),
j AS (SELECT x.*, dict.v FROM x LEFT JOIN dict ON dict.k = lower(x.c)),
o AS (SELECT conv_id, turn, p, CASE WHEN v IS NULL THEN w
  WHEN c = upper(c) AND c <> lower(c) THEN a || upper(v) || z
  WHEN substr(c, 1, 1) = upper(substr(c, 1, 1)) AND substr(c, 1, 1) <> lower(substr(c, 1, 1)) THEN a || upper(substr(v, 1, 1)) || lower(substr(v, 2)) || z
  ELSE a || v || z END AS r FROM j)
SELECT conv_id, turn, string_agg(r, ' ' ORDER BY p) AS restored FROM o GROUP BY conv_id, turn"""
)
def ortho_restore_dict(spark, d):
    c = read(spark, d, "conversations")
    return c.select("conv_id", "turn", T.to_macron(F.col("text"), DICTIONARY).alias("restored")).filter("restored <> ''")


@query(
    f"""WITH n AS (SELECT doc_id, {_norm_sql("replace(lower(text), '`', '''')", "a-z")} AS t FROM (SELECT doc_id, translate({_M}, '{_MACRONS}', '{_PLAIN}') AS text FROM documents)),
c AS (SELECT doc_id, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS pos FROM n WHERE t <> ''),
s AS (SELECT ch, count(*) AS n, min((doc_id, pos)) AS f FROM c GROUP BY ch),
v AS (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz ''', '')) AS ch),
r AS (SELECT v.ch AS token, CAST(row_number() OVER (ORDER BY n DESC NULLS LAST, f NULLS LAST, v.ch) + 4 AS INTEGER) AS id FROM v LEFT JOIN s ON s.ch = v.ch)
SELECT * FROM r UNION ALL VALUES ('<pad>', 0), ('<s>', 1), ('</s>', 2), ('<unk>', 3), ('|', 4)"""
)
def ctc_vocab(spark, d):
    return vocab.ctc_vocabulary(_docs(spark, d).withColumn("text", T.to_plain(F.col("m"))), "system6")


@query(
    """SELECT conv_id, turn,
 trim(regexp_replace(regexp_replace(translate(lower(text), 'ʻ`', ''''''), '[^a-z''|āēīōū\\s]', '', 'g'), '\\s+', ' ', 'g')) AS training,
 trim(regexp_replace(regexp_replace(lower(text), '[^a-z''āēīōū\\s]', '', 'g'), '\\s+', ' ', 'g')) AS scoring FROM conversations"""
)
def whitelist_normalize(spark, d):
    t = F.col("text")
    return read(spark, d, "conversations").select("conv_id", "turn", T.whitelist_training(t).alias("training"), T.whitelist_scoring(t).alias("scoring"))


@query(
    f"""SELECT conv_id, turn, list_filter(regexp_split_to_array(translate(lower(regexp_replace(nfc_normalize({_M}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g')), '{dims.FOLD_FROM}', '{dims.FOLD_TO}'), '\\s+'), lambda x: x <> '') AS words FROM conversations"""
)
def ctc_fold_normalize(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.words(T.acoustic_text(macron(F.col("text")))).alias("words"))


_VOCAB = {c: k + 5 for k, c in enumerate("abcdefghijklmnopqrstuvwxyz'")} | {"|": 4}


@query(
    """WITH c AS (SELECT item_id, unnest(string_split(lower(text), '')) AS ch, generate_subscripts(string_split(lower(text), ''), 1) AS p FROM benchmark)
SELECT item_id, string_agg(CASE WHEN ch = ' ' OR ch = '|' THEN '4' WHEN ch = '''' THEN '31' WHEN regexp_matches(ch, '^[a-z]$') THEN CAST(ascii(ch) - 92 AS VARCHAR) ELSE '3' END, ',' ORDER BY p) AS labels FROM c GROUP BY item_id"""
)
def label_encode(spark, d):
    ids = T.label_ids(F.col("text"), _VOCAB)
    return read(spark, d, "benchmark").select("item_id", F.array_join(ids.cast("array<string>"), ",").alias("labels"))


@query(
    """WITH x AS (SELECT doc_id, text, CASE WHEN n_chars > 0 THEN CAST(floor(length(text) * (CAST(16000 AS DOUBLE) / (n_chars * 10))) AS INTEGER) END AS t, n_chars * 10 AS s FROM documents),
y AS (SELECT *, substr(text, 1, t) AS cut FROM x),
z AS (SELECT *, CASE WHEN strpos(cut, ' ') > 0 THEN length(cut) - strpos(reverse(cut), ' ') ELSE -1 END AS last FROM y)
SELECT doc_id, md5(CASE WHEN s <= 16000 THEN text WHEN last > t * CAST(0.7 AS DOUBLE) THEN trim(substr(cut, 1, last)) ELSE trim(cut) END) AS kept_md5 FROM z"""
)
def proportional_truncate(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(T.proportional_truncate(F.col("text"), F.col("n_chars") * 10, 16_000)).alias("kept_md5"))


@query(
    """SELECT page_id, session, CAST(coalesce(try_cast(regexp_extract(name, '(?i)DAY[_\\s]*(\\d+)', 1) AS INTEGER), 0) AS INTEGER) AS day,
 CAST(coalesce(try_cast(regexp_extract(name, '(?i)Take[_\\s]*(\\d+)', 1) AS INTEGER), 0) AS INTEGER) AS take FROM (
SELECT page_id, name, CASE WHEN contains(lower(name), 'june') OR contains(lower(name), '24-06-24') THEN 'june' WHEN contains(lower(name), 'december') OR contains(lower(name), '12-24') THEN 'december' ELSE 'unknown' END AS session
FROM (SELECT page_id, (CASE page_id % 3 WHEN 0 THEN 'June_' WHEN 1 THEN 'rec_12-24_' ELSE 'x_' END) || 'Day_' || (page_id % 7) || '_Take_' || (page_id % 5) || '.wav' AS name FROM pages))"""
)
def session_day_take(spark, d):
    pid = F.col("page_id")
    head = F.when(pid % 3 == 0, "June_").when(pid % 3 == 1, "rec_12-24_").otherwise("x_")
    name = F.concat(head, F.lit("Day_"), (pid % 7).cast("string"), F.lit("_Take_"), (pid % 5).cast("string"), F.lit(".wav"))
    dt = T.day_take(name)
    return read(spark, d, "pages").select("page_id", T.session_of(name).alias("session"), dt["day"].alias("day"), dt["take"].alias("take"))


@query(
    f"""WITH x AS (SELECT conv_id, turn, lower({_M}) AS t FROM conversations)
SELECT conv_id, turn, len(list_filter(string_split(t, ''), lambda c: regexp_matches(c, '^[bcdjqrwxyz]$'))) AS n_foreign,
 len(list_filter(regexp_extract_all(t, '[a-zāēīōū'']+'), lambda w: regexp_matches(regexp_replace(w, '''+$', ''), '[^aeiouāēīōū]$'))) AS n_consonant_final,
 len(list_filter(string_split(t, ''), lambda c: regexp_matches(c, '^[bcdjqrwxyz]$'))) + len(list_filter(regexp_extract_all(t, '[a-zāēīōū'']+'), lambda w: regexp_matches(regexp_replace(w, '''+$', ''), '[^aeiouāēīōū]$'))) = 0 AS strict_valid, true AS moderate_valid
FROM x"""
)
def grammar_validate(spark, d):
    m = macron(F.col("text"))
    return read(spark, d, "conversations").select(
        "conv_id",
        "turn",
        F.size(grammar.character_issues(m)).cast("long").alias("n_foreign"),
        F.size(grammar.final_vowel_issues(m)).cast("long").alias("n_consonant_final"),
        grammar.validate(m, "strict")["is_valid"].alias("strict_valid"),
        grammar.validate(m, "moderate")["is_valid"].alias("moderate_valid"),
    )


@query(
    """WITH x AS (SELECT conv_id, turn, lower(text) AS t, replace(lower(text), 'ng', 'N') AS s FROM conversations),
y AS (SELECT *, regexp_extract(s, '[fhklmnpstv]{2,}') AS run FROM x)
SELECT conv_id, turn, run FROM y WHERE run <> '' AND NOT contains(substr(t, strpos(s, run), length(run)), 'ng')"""
)
def consonant_cluster(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", grammar.cluster_issues(F.col("text")).alias("i")).filter(F.size("i") > 0)
    return c.select("conv_id", "turn", F.regexp_replace(F.col("i")[0]["message"], "^consonant cluster: ", "").alias("run"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in r) + ")" for r in rows)


_NOUNS = [(w, "a") for ws in dims.A_CLASS.values() for w in ws] + [(w, "o") for ws in dims.O_CLASS.values() for w in ws]


@query(
    f"""WITH dim(word, class) AS (VALUES {_values(_NOUNS)}),
w AS (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '')) AS word FROM documents)
SELECT coalesce(class, '?') AS class, count(*) AS n, count(DISTINCT w.word) AS words FROM w LEFT JOIN dim ON dim.word = w.word GROUP BY 1"""
)
def possessive_classes(spark, d):
    w = read(spark, d, "documents").select(F.explode(T.letter_words(F.lower("text"))).alias("word"))
    by_word = w.groupBy("word").agg(F.count("*").alias("k"))
    return by_word.groupBy(grammar.possessive_class(F.col("word")).alias("class")).agg(F.sum("k").alias("n"), F.count("*").alias("words"))


_PARTICLES = [(p, t) for t, p, _ in dims.TENSES] + [(p, f"neg_{t}") for t, p, _ in dims.NEGATIVES]
_TOKENS_SQL = """x AS (SELECT doc_id, lower(text) AS t FROM documents),
g AS (SELECT doc_id, regexp_extract_all(t, '[\\p{L}\\p{M}\\p{N}_]+') AS ws FROM x),
w AS (SELECT doc_id, unnest(ws) AS word FROM g)"""


@query(
    f"""WITH dim(particle, tense) AS (VALUES {_values(_PARTICLES)}), {_TOKENS_SQL}
SELECT doc_id, particle, tense, count(*) AS n FROM w JOIN dim ON dim.particle = w.word GROUP BY ALL"""
)
def verb_particles(spark, d):
    hits = grammar.verb_phrases(read(spark, d, "documents"), "text", ["doc_id"])
    return hits.groupBy("doc_id", "particle", "tense").agg(F.count("*").alias("n"))


@query(
    f"""WITH dim(pronoun, person, number) AS (VALUES {_values([(w, p, n) for w, p, n, _ in dims.PRONOUNS])}), {_TOKENS_SQL}
SELECT pronoun, CAST(person AS INTEGER) AS person, number, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w JOIN dim ON dim.pronoun = w.word GROUP BY ALL"""
)
def pronouns(spark, d):
    hits = grammar.pronoun_hits(read(spark, d, "documents"), "text", ["doc_id"])
    return hits.groupBy("pronoun", "person", "number").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


#: Pronouns that are dealt to words by their length; the last one never changes.
_DEALT = [*dims.ALLITERATION, "Tena", "matou"]


def _documents_words(spark: SparkSession, d: str) -> DataFrame:
    """word, n of all documents."""
    w = read(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_TOKENS_SQL}, p AS (SELECT word AS prev, list_extract({_DEALT}, CAST(1 + length(word) % {len(_DEALT)} AS BIGINT)) AS pron, count(*) AS n FROM w GROUP BY word)
SELECT prev, pron, CASE WHEN contains(lower(prev), 's') AND lower(pron) IN ('toku','taku','tou','tau','tona','tena') THEN 's' || substr(lower(pron), 2) ELSE pron END AS form, n FROM p"""
)
def alliteration(spark, d):
    """Every word of the documents before a pronoun that its length chooses."""
    pron = F.element_at(F.array(*map(F.lit, _DEALT)), 1 + F.length("word") % len(_DEALT))
    p = _documents_words(spark, d).select(F.col("word").alias("prev"), pron.alias("pron"), "n")
    return p.select("prev", "pron", grammar.alliterate(F.col("prev"), F.col("pron")).alias("form"), "n")


_TENSE_NAMES = [*(t for t, _, _ in dims.TENSES), "never"]


@query(
    f"""WITH t(tense, particle) AS (VALUES {_values([(t, p) for t, p, _ in dims.TENSES])}), {_TOKENS_SQL},
s AS (SELECT CASE WHEN length(word) % 2 = 1 THEN 'o ' ELSE '' END || word AS stem, list_extract({_TENSE_NAMES}, CAST(1 + length(word) % {len(_TENSE_NAMES)} AS BIGINT)) AS tense, count(*) AS n FROM w GROUP BY word)
SELECT stem, s.tense, n, coalesce(particle || ' ' || regexp_replace(stem, '^o ', ''), 'Unknown tense ''never''. Available: present, future, past, future_conditional, consequential, perfect_conditional, precautionary') AS form
FROM s LEFT JOIN t ON t.tense = s.tense"""
)
def conjugations(spark, d):
    """Every word of the documents as a verb, every other with the mark of the infinitive, in a tense that its length chooses."""
    w = F.col("word")
    stem = F.when(F.length(w) % 2 == 1, F.concat(F.lit("o "), w)).otherwise(w)
    s = _documents_words(spark, d).select(stem.alias("stem"), F.element_at(F.array(*map(F.lit, _TENSE_NAMES)), 1 + F.length(w) % len(_TENSE_NAMES)).alias("tense"), "n")
    return s.select("stem", "tense", "n", grammar.conjugate(F.col("stem"), F.col("tense")).alias("form"))


@query(
    f"""WITH c(n, w) AS (VALUES {", ".join(f"({k}, '{v}')" for k, v in dims.CARDINALS.items())}), r AS (SELECT o_custkey % 1001 AS n, count(*) AS orders FROM orders GROUP BY 1)
SELECT CAST(r.n AS INTEGER) AS n, orders, 'toko' || coalesce(c.w, CAST(r.n AS VARCHAR)) AS form FROM r LEFT JOIN c ON c.n = r.n"""
)
def people_numbers(spark, d):
    """Numbers of people after the customers of all orders."""
    n = read(spark, d, "orders").groupBy((F.col("o_custkey") % 1001).cast("int").alias("n")).agg(F.count("*").alias("orders"))
    return n.withColumn("form", grammar.number_for_people(F.col("n")))


_LOOKUPS = [
    *(("particles", p, "|".join(dims.PARTICLE_RECORDS[p])) for _, p, _ in (*dims.TENSES, *dims.NEGATIVES)),
    *(("pronouns", w, g) for w, _, _, g in dims.PRONOUNS),
    *(("articles", w, g) for w, _, _, g in dims.ARTICLES),
    *(("exclamations", w, m) for w, m in dims.EXCLAMATIONS),
    *(("siblings", w, m) for w, m in dims.SIBLINGS),
]


@query(
    "WITH " + _TOKENS_SQL + ", d(lookup, entry, detail) AS (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in _LOOKUPS) + """)
SELECT lookup, entry, detail, count(w.word) AS n FROM d LEFT JOIN w ON w.word = d.entry GROUP BY ALL"""
)
def reference_tables(spark, d):
    """The entries of the reference tables, and how often they stand in the documents."""
    t = dims.lookups(spark)
    columns = {
        "particles": ("particle", F.concat_ws("|", "name", "example")),
        "pronouns": ("pronoun", F.col("gloss")),
        "articles": ("article", F.col("gloss")),
        "exclamations": ("word", F.col("meaning")),
        "siblings": ("term", F.col("meaning")),
    }
    parts = [t[name].select(F.lit(name).alias("lookup"), F.col(entry).alias("word"), detail.alias("detail")) for name, (entry, detail) in columns.items()]
    found = functools.reduce(DataFrame.unionByName, parts).join(_documents_words(spark, d), "word", "left")
    return found.select("lookup", F.col("word").alias("entry"), "detail", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    f"""WITH c AS (SELECT unnest(string_split(lower(text), '')) AS ch FROM documents WHERE text <> '')
SELECT ch, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, ch) AS rank, regexp_matches(ch, '^[a-zāēīōū '']$') AS standard FROM c GROUP BY ch"""
)
def char_frequency(spark, d):
    r = vocab.ranked_characters(read(spark, d, "documents").withColumn("text", F.lower("text")))
    return r.select("ch", "n", F.col("rank").cast("long").alias("rank"), vocab.is_standard(F.col("ch")).alias("standard"))


@query(
    """WITH c AS (SELECT unnest(string_split(lower(text), '')) AS ch FROM documents WHERE text <> '')
SELECT ch, count(*) AS n FROM c WHERE NOT regexp_matches(ch, '^[a-z '']$') GROUP BY ch"""
)
def vocab_coverage(spark, d):
    return vocab.uncovered(read(spark, d, "documents"), "system6")


_FOLD = ("äöüßéèêçñíóáúàëïîôûâÄÖÜÉÈÊÇÑÍÓ", "aouseeecnioauaeiiouaAOUEEECNIO")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select("conv_id", "turn", F.translate(F.lower("text"), *_FOLD).alias("ref"))
    c = c.select("conv_id", "turn", F.trim(F.regexp_replace("ref", "[^a-z ]+", " ")).alias("ref"))
    return with_next_turn(c, "ref", "hyp").filter("hyp is not null")


#: Word distance row by row: one list per reference word, folded from the left.
_PAIRS_SQL = f"""RECURSIVE c0 AS (SELECT conv_id, turn, trim(regexp_replace(translate(lower(text), '{_FOLD[0]}', '{_FOLD[1]}'), '[^a-z ]+', ' ', 'g')) AS ref FROM conversations),
c1 AS (SELECT *, lead(ref) OVER (PARTITION BY conv_id ORDER BY turn) AS hyp FROM c0),
c2 AS MATERIALIZED (SELECT *, list_filter(string_split(ref, ' '), lambda x: x <> '') AS r, list_filter(string_split(hyp, ' '), lambda x: x <> '') AS h FROM c1 WHERE hyp IS NOT NULL),
dist AS (SELECT conv_id, turn, 0 AS i, range(0, len(h) + 1) AS line FROM c2 UNION ALL
 SELECT conv_id, turn, i + 1, list_reduce(list_prepend([i + 1], list_transform(h, lambda w, j: [least(line[j + 1] + 1, line[j] + CASE WHEN w = r[i + 1] THEN 0 ELSE 1 END)])), lambda a, x: list_append(a, least(x[1], a[-1] + 1)))
 FROM dist JOIN c2 USING (conv_id, turn) WHERE i < len(r)),
p AS (SELECT c2.*, dist.line[-1] AS wd FROM c2 JOIN dist ON dist.conv_id = c2.conv_id AND dist.turn = c2.turn AND dist.i = len(c2.r))"""


@query(
    f"""WITH {_PAIRS_SQL}
SELECT conv_id, turn, round(CASE WHEN ref = '' THEN CASE WHEN hyp = '' THEN 0.0 ELSE 1.0 END WHEN hyp = '' THEN 1.0 ELSE wd / len(r) END, 6) AS wer,
 round(CASE WHEN ref = '' THEN CASE WHEN hyp = '' THEN 0.0 ELSE 1.0 END WHEN hyp = '' THEN 1.0 ELSE levenshtein(ref, hyp) / length(ref) END, 6) AS cer FROM p"""
)
def pair_error_rates(spark, d):
    r, h = F.col("ref"), F.col("hyp")
    return _pairs(spark, d).select("conv_id", "turn", F.round(metrics.wer(r, h), 6).alias("wer"), F.round(metrics.cer(r, h), 6).alias("cer"))


@query(f"""WITH {_PAIRS_SQL} SELECT round(sum(wd) / sum(len(r)), 6) AS wer, round(sum(levenshtein(ref, hyp)) / sum(length(ref)), 6) AS cer, count(*) AS pairs FROM p WHERE ref <> ''""")
def corpus_error_rates(spark, d):
    return metrics.corpus_rates(_pairs(spark, d), "ref", "hyp").select(F.round("wer", 6).alias("wer"), F.round("cer", 6).alias("cer"), "pairs")


@query(
    f"""WITH {_PAIRS_SQL}, q AS (SELECT conv_id, turn, ref, hyp, r, h, len(list_filter(range(1, least(len(r), len(h)) + 1), lambda i: r[i] <> h[i])) AS bad FROM p)
SELECT conv_id, turn, round(CASE WHEN ref = '' THEN CASE WHEN hyp = '' THEN 0.0 ELSE 1.0 END WHEN hyp = '' THEN 1.0 ELSE least(1.0, (bad + abs(len(r) - len(h))) / len(r)) END, 6) AS wer FROM q"""
)
def positional_error_rate(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", F.round(metrics.positional_wer(F.col("ref"), F.col("hyp")), 6).alias("wer"))


_DUAL = f"""m AS (SELECT conv_id, turn, {_M} AS text FROM conversations),
n AS (SELECT conv_id, turn, {_norm_sql("replace(lower(text), '`', '''')", "a-zāēīōū")} AS s4, {_norm_sql(f"translate(replace(lower(text), '`', ''''), '{_MACRONS}', '{_PLAIN}')", "a-z")} AS s6 FROM m),
q AS (SELECT *, lead(s4) OVER (PARTITION BY conv_id ORDER BY turn) AS h4 FROM n)"""


@query(
    f"""WITH {_DUAL} SELECT conv_id, turn, round(CASE WHEN s6 = '' THEN CASE WHEN translate(h4, '{_MACRONS}', '{_PLAIN}') = '' THEN 0.0 ELSE 1.0 END WHEN h4 = '' THEN 1.0
 ELSE levenshtein(s6, translate(h4, '{_MACRONS}', '{_PLAIN}')) / length(s6) END, 6) AS cer_system6 FROM q WHERE h4 IS NOT NULL"""
)
def dual_ortho_eval(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", macron(F.col("text")).alias("ref"))
    c = with_next_turn(c, "ref", "hyp").filter("hyp is not null")
    e = metrics.dual_orthography(F.col("hyp"), F.col("ref"), F.col("ref"))
    return c.select("conv_id", "turn", F.round(e["cer_system6"], 6).alias("cer_system6"))


@query(
    """WITH w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS w FROM conversations),
t AS (SELECT w, length(w) AS n, replace(w, 'k', 't') AS kt, replace(w, 'ng', 'n') AS ng, replace(w, 'r', 'l') AS rl FROM w),
p AS (SELECT a.w AS a, b.w AS b, levenshtein(a.w, b.w) AS l, CASE WHEN a.kt = b.kt THEN 0.3 WHEN a.ng = b.ng THEN 0.2 WHEN a.rl = b.w THEN 0.15 ELSE 0 END AS bonus, greatest(a.n, b.n) AS n
 FROM t a JOIN t b ON a.w <> b.w AND abs(a.n - b.n) <= 0.5 * greatest(a.n, b.n)),
s AS (SELECT a, b, round(least(1.0, 1 - l / n + bonus), 6) AS similarity FROM p)
SELECT * FROM s WHERE similarity >= 0.8"""
)
def word_similarity_pairs(spark, d):
    w = read(spark, d, "conversations").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w"))
    return scoring.similar_words(w, "w", 0.8)


@query(
    """WITH x AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS a,
 lead(list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''))) OVER w AS b, lead(text) OVER w AS nxt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
y AS (SELECT conv_id, turn, nxt, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS j FROM x WHERE b IS NOT NULL)
SELECT conv_id, turn, round(j, 6) AS jaccard, trim(nxt) <> '' AND j > 0.1 AND j < 0.9 AND length(nxt) > 5 AS improved FROM y"""
)
def jaccard_improve(spark, d):
    from speechmart.operators.corrections import is_improvement

    c = with_next_turn(read(spark, d, "conversations").select("conv_id", "turn", "text"), "text", "nxt").filter("nxt is not null")
    a, b = F.col("text"), F.col("nxt")
    return c.select("conv_id", "turn", F.round(T.jaccard(a, b), 6).alias("jaccard"), is_improvement(a, b).alias("improved"))


