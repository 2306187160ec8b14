"""Queries over chunks, anchors, sequences, segments and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechmart.functions import text as T
from speechmart.operators import anchors, chunks, ctc, dtw, ranking, scoring, segments, sequences, vad
from speechmart.queries.adapters import CHUNKS_SQL, EQUIVALENTS, EVENTS_SQL, KEYWORDS, OTHER_KEYWORDS, SPELLING, read, spelled_clips, spelling_model, timed_words, with_next_turn
from speechmart.queries.adapters import chunks as chunk_table
from speechmart.sources.shared import materialize

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _list(items) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


_SPLIT = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')"


@query(
    f"""WITH {CHUNKS_SQL}, w AS (SELECT *, {_SPLIT} AS ws FROM ch),
e AS (SELECT audio_stem, chunk_idx, "start" AS s, ("end" - "start") / len(ws) AS step, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM w)
SELECT audio_stem, chunk_idx, CAST(pos AS INTEGER) AS pos, word, round_even(s + pos * step, 3) AS "start", round_even(s + (pos + 1) * step, 3) AS "end" FROM e"""
)
def chunk_words(spark, d):
    return chunks.chunk_words(chunk_table(spark, d))


def _hits_sql(name: str, source: str, words: list[str], label: str) -> str:
    """Keyword hits: tokens with offsets from the lengths of what stands before them."""
    return f"""{name}0 AS (SELECT *, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS ws, regexp_split_to_array(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS gs FROM ch WHERE source {source}),
{name}1 AS (SELECT *, unnest(ws) AS word, unnest(list_slice(gs, 1, len(ws))) AS gap, generate_subscripts(ws, 1) AS p FROM {name}0),
{name}2 AS (SELECT *, sum(length(gap) + length(word)) OVER (PARTITION BY audio_stem, chunk_idx ORDER BY p) - length(word) AS off FROM {name}1),
{name} AS (SELECT audio_stem, chunk_idx, CAST(list_position({_list(words)}, word) - 1 AS INTEGER) AS keyword_idx, CAST(off AS INTEGER) AS "offset", word,
 "start" + ("end" - "start") * CAST(off AS INTEGER) / length(text) AS time, '{label}' AS source FROM {name}2 WHERE word IN (SELECT unnest({_list(words)})))"""


def _hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = chunk_table(spark, d)
    return anchors.anchor_hits(c.filter("source = 'mms'"), KEYWORDS, "mms"), anchors.anchor_hits(c.filter("source <> 'mms'"), OTHER_KEYWORDS, "whisper_en")


_L = _hits_sql("l", "= 'mms'", KEYWORDS, "mms")
_R = _hits_sql("r", "<> 'mms'", OTHER_KEYWORDS, "whisper_en")


@query(f"""WITH {CHUNKS_SQL}, {_L} SELECT audio_stem, chunk_idx, keyword_idx, "offset", word, round(time, 6) AS time FROM l""")
def anchor_hits(spark, d):
    left, _ = _hits(spark, d)
    return left.select("audio_stem", "chunk_idx", "keyword_idx", "offset", "word", F.round("time", 6).alias("time"))


@query(f"""WITH {CHUNKS_SQL}, {_L}, {_R} SELECT audio_stem, count(*) AS anchors, count(*) FILTER (source = 'mms') AS mms FROM (SELECT audio_stem, source FROM l UNION ALL SELECT audio_stem, source FROM r) GROUP BY audio_stem""")
def anchor_counts(spark, d):
    left, right = _hits(spark, d)
    return left.unionByName(right).groupBy("audio_stem").agg(F.count("*").alias("anchors"), F.count_if(F.col("source") == "mms").alias("mms"))


_EQ = "(l.word = r.word OR " + " OR ".join(f"(l.word = '{a}' AND r.word = '{b}') OR (l.word = '{b}' AND r.word = '{a}')" for a, b in EQUIVALENTS.items()) + ")"


@query(
    f"""WITH {CHUNKS_SQL}, {_L}, {_R} SELECT audio_stem, l_word, r_word, count(*) AS n FROM (SELECT l.audio_stem, l.word AS l_word, r.word AS r_word FROM l JOIN r ON l.audio_stem = r.audio_stem
 AND abs(l.time - r.time) <= 6.0 AND {_EQ}) GROUP BY ALL"""
)
def anchor_interval_candidates(spark, d):
    left, right = _hits(spark, d)
    return anchors.anchor_candidates(left, right, 6.0, EQUIVALENTS).groupBy("audio_stem", "l_word", "r_word").agg(F.count("*").alias("n"))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    return anchors.merge_anchors(*_hits(spark, d), tolerance=6.0, equivalents=EQUIVALENTS)


#: First fit in discovery order: the list of right anchors taken so far goes from one left anchor to the next.
_MERGE = f"""ln AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY audio_stem ORDER BY chunk_idx, keyword_idx, "offset") AS i FROM l),
rn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY audio_stem ORDER BY chunk_idx, keyword_idx, "offset") AS k FROM r),
fit AS MATERIALIZED (SELECT ln.audio_stem, ln.i, list(r.k ORDER BY r.k) FILTER (r.k IS NOT NULL) AS ks FROM ln LEFT JOIN rn r ON r.audio_stem = ln.audio_stem AND abs(ln.time - r.time) <= 6.0 AND {_EQ.replace("l.word", "ln.word")} GROUP BY ALL),
take AS (SELECT DISTINCT audio_stem, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS k FROM ln
 UNION ALL SELECT audio_stem, i, CASE WHEN k IS NULL THEN used ELSE list_append(used, k) END, k FROM
 (SELECT f.audio_stem, f.i, t.used, list_filter(coalesce(f.ks, []), lambda x: NOT list_contains(t.used, x))[1] AS k FROM take t JOIN fit f ON f.audio_stem = t.audio_stem AND f.i = t.i + 1)),
mg0 AS (SELECT ln.audio_stem, ln.word, CASE WHEN rn.k IS NULL THEN ln.time ELSE (ln.time + rn.time) / 2 END AS time, CASE WHEN rn.k IS NULL THEN 'mms' ELSE 'both' END AS source, CASE WHEN rn.k IS NULL THEN 0.5 ELSE 0.9 END AS confidence, 0 AS side, ln.i AS rnk
 FROM ln JOIN take t ON t.audio_stem = ln.audio_stem AND t.i = ln.i LEFT JOIN rn ON rn.audio_stem = ln.audio_stem AND rn.k = t.k
 UNION ALL SELECT audio_stem, word, time, 'whisper_en', 0.4, 1, k FROM rn WHERE NOT EXISTS (SELECT 1 FROM take t WHERE t.audio_stem = rn.audio_stem AND t.k = rn.k)),
mg AS MATERIALIZED (SELECT audio_stem, row_number() OVER (PARTITION BY audio_stem ORDER BY time, side, rnk) - 1 AS anchor_idx, word, time, source, CAST(confidence AS DOUBLE) AS confidence FROM mg0)"""


@query(f"""WITH RECURSIVE {CHUNKS_SQL}, {_L}, {_R}, {_MERGE} SELECT audio_stem, CAST(anchor_idx AS INTEGER) AS anchor_idx, word, round(time, 6) AS time, source, confidence FROM mg""")
def anchor_merge_greedy(spark, d):
    """First-fit merge in discovery order."""
    return _merged(spark, d).select("audio_stem", "anchor_idx", "word", F.round("time", 6).alias("time"), "source", "confidence")


def _transcript(spark: SparkSession, d: str, first: DataFrame | None = None) -> DataFrame:
    """Documents of one source as one transcript, or as many of its ``first`` words."""
    docs = read(spark, d, "documents").select(F.col("source").alias("session"), "doc_id", "text")
    return chunks.transcript_words(docs, "session", "doc_id", first=first)


_TW = """tw0 AS (SELECT source AS session, doc_id, list_filter(regexp_split_to_array(text, '[\\s\\x{00A0}\\x{0085}\\x0B]+'), lambda x: x <> '') AS ws FROM documents),
tw1 AS (SELECT session, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM tw0),
tw AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY doc_id, p) - 1 AS word_idx, regexp_replace(lower(w), '[^\\p{L}\\p{M}\\p{N}_]', '', 'g') AS word FROM tw1)"""


@query(f"""WITH {_TW} SELECT session, word, word_idx // {sequences.CELL} AS cell, array_to_string(list(word_idx ORDER BY word_idx), ',') AS positions FROM tw WHERE word IN (SELECT unnest({_list(KEYWORDS)})) GROUP BY session, word, word_idx // {sequences.CELL}""")
def inverted_index(spark, d):
    """Posting blocks of the keywords, each with its positions."""
    blocks = sequences.posting_blocks(_transcript(spark, d), KEYWORDS, "session")
    positions = sequences.positions_in("cell", "offsets").cast("array<string>")
    return blocks.select("session", "word", "cell", F.array_join(positions, ",").alias("positions"))


@query(f"""WITH {_TW} SELECT session, count(DISTINCT word) AS anchor_types, count(*) AS positions FROM tw WHERE word IN (SELECT unnest({_list(KEYWORDS)})) GROUP BY session""")
def session_anchor_totals(spark, d):
    return sequences.session_anchor_totals(_transcript(spark, d), KEYWORDS, "session")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as audio files of fifty sessions."""
    c = chunk_table(spark, d).groupBy("audio_stem").agg(F.max("end").alias("duration"))
    f = c.select("audio_stem", F.concat(F.lit("src"), (F.col("audio_stem") % 20).cast("string")).alias("session"), "duration", F.lit(1).alias("day"), F.col("audio_stem").alias("take"))
    docs = read(spark, d, "documents").select(F.col("source").alias("session"), F.size(T.words(F.trim("text"))).alias("n"))
    total = docs.groupBy("session").agg(F.sum("n").alias("total_words"))
    return f.join(total, "session")


_FILES = f"""{CHUNKS_SQL}, {_TW},
f0 AS (SELECT audio_stem, 'src' || (audio_stem % 20) AS session, max("end") AS duration FROM ch GROUP BY audio_stem),
tt AS (SELECT session, count(*) AS total_words FROM tw GROUP BY session),
f1 AS (SELECT f0.*, total_words, total_words / sum(duration) OVER (PARTITION BY f0.session) AS wps,
 coalesce(sum(duration) OVER (PARTITION BY f0.session ORDER BY audio_stem ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS elapsed FROM f0 JOIN tt ON tt.session = f0.session),
f AS (SELECT *, CAST(floor(elapsed * wps) AS BIGINT) AS hint_start, CAST(least(floor((elapsed + duration) * wps), total_words) AS BIGINT) AS hint_end FROM f1)"""


@query(f"WITH {_FILES} SELECT audio_stem, session, hint_start, hint_end FROM f")
def cumulative_hints(spark, d):
    return sequences.position_hints(_files(spark, d)).select("audio_stem", "session", "hint_start", "hint_end")


def _anchored(spark: SparkSession, d: str) -> DataFrame:
    """Keyword hits of both sources as anchors, in time order."""
    left, right = _hits(spark, d)
    both = left.unionByName(right.filter(F.col("word").isin(KEYWORDS)))
    idx = F.row_number().over(Window.partitionBy("audio_stem").orderBy("time", "chunk_idx", "keyword_idx", "offset")) - 1
    return both.withColumn("anchor_idx", idx)


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    # both are read by several steps; unwritten, every step would split and look through all texts again
    index = materialize(sequences.posting_blocks(_transcript(spark, d), KEYWORDS, "session"), "postings")
    hints = sequences.position_hints(_files(spark, d)).select("audio_stem", "session", "hint_start", "hint_end")
    return sequences.band_candidates(materialize(_anchored(spark, d).join(hints, "audio_stem"), "anchored"), index, "session")


_R2 = _hits_sql("r", "<> 'mms'", [w for w in OTHER_KEYWORDS if w in KEYWORDS], "whisper_en").replace("CAST(list_position(['that', 'with'], word)", f"CAST(list_position({_list(OTHER_KEYWORDS)}, word)")


def _band_sql(anchors: str) -> str:
    """Candidates of ``anchors`` (audio_stem, anchor_idx, word, time) against the transcript's words."""
    return f"""c AS (SELECT b.audio_stem, b.anchor_idx, b.word, b.time, b.confidence, tw.word_idx, tw.word_idx BETWEEN hint_start AND hint_end AS inside, least(abs(tw.word_idx - hint_start), abs(tw.word_idx - hint_end)) AS away
 FROM {anchors} b JOIN f ON f.audio_stem = b.audio_stem JOIN tw ON tw.session = f.session AND tw.word = b.word AND tw.word IN (SELECT unnest({_list(KEYWORDS)}))),
k0 AS (SELECT *, bool_or(inside) OVER (PARTITION BY audio_stem, anchor_idx) AS any_inside FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY audio_stem, anchor_idx ORDER BY CASE WHEN any_inside THEN 0 ELSE away END, word_idx) AS place FROM k0)"""


_BAND = f"""{_FILES}, {_L}, {_R2}, a AS (SELECT * FROM l UNION ALL SELECT * FROM r),
b AS (SELECT audio_stem, word, time, 0.5 AS confidence, row_number() OVER (PARTITION BY audio_stem ORDER BY time, chunk_idx, keyword_idx, "offset") - 1 AS anchor_idx FROM a),
{_band_sql("b")}"""


@query(f"""WITH {_BAND} SELECT audio_stem, CAST(anchor_idx AS INTEGER) AS anchor_idx, word_idx FROM k WHERE inside OR (NOT any_inside AND place <= 3)""")
def band_candidates_nearest3(spark, d):
    return _candidates(spark, d).select("audio_stem", "anchor_idx", "word_idx")


def _sequence(spark: SparkSession, d: str) -> DataFrame:
    return sequences.matched_sequences(_candidates(spark, d))


def _lis_sql(candidates: str) -> str:
    """Patience piles over ``candidates`` (audio_stem, anchor_idx, place, word, time, word_idx, confidence): piles go from row to row, parents are walked back."""
    return f"""cn AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY audio_stem ORDER BY time, anchor_idx, place) AS n FROM {candidates}),
pile AS (SELECT DISTINCT audio_stem, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS tails, CAST([] AS BIGINT[]) AS ends, CAST(NULL AS BIGINT) AS parent FROM cn
 UNION ALL SELECT audio_stem, n, list_concat(list_append(tails[1:k], p), tails[k + 2:]), list_concat(list_append(ends[1:k], n), ends[k + 2:]), CASE WHEN k > 0 THEN ends[k] END FROM
 (SELECT c.audio_stem, c.n, CAST(c.word_idx AS BIGINT) AS p, s.tails, s.ends, len(list_filter(s.tails, lambda x: x < c.word_idx)) AS k FROM pile s JOIN cn c ON c.audio_stem = s.audio_stem AND c.n = s.n + 1)),
piled AS MATERIALIZED (SELECT * FROM pile),
top AS (SELECT audio_stem, max_by(ends, n) AS ends FROM piled GROUP BY audio_stem),
walk AS (SELECT audio_stem, ends[-1] AS n, len(ends) - 1 AS pos FROM top WHERE len(ends) >= 5
 UNION ALL SELECT w.audio_stem, p.parent, w.pos - 1 FROM walk w JOIN piled p ON p.audio_stem = w.audio_stem AND p.n = w.n WHERE p.parent IS NOT NULL),
lis AS MATERIALIZED (SELECT c.audio_stem, w.pos, c.word, c.time, c.word_idx, c.confidence FROM walk w JOIN cn c ON c.audio_stem = w.audio_stem AND c.n = w.n)"""


@query(
    f"""WITH RECURSIVE {_BAND}, cc AS (SELECT *, 0.5 AS confidence FROM k WHERE inside OR (NOT any_inside AND place <= 3)), {_lis_sql("cc")}
SELECT audio_stem, CAST(pos AS INTEGER) AS pos, word, round(time, 6) AS time, word_idx FROM lis"""
)
def lis_sequence(spark, d):
    """One longest increasing sequence of every file, the one that patience piles find."""
    return _sequence(spark, d).select("audio_stem", "pos", "word", F.round("time", 6).alias("time"), "word_idx")


def _plain_sequence(spark: SparkSession, d: str) -> DataFrame:
    """A sequence SQL can make too: hits in time order, each with its rank times three as position."""
    left, _ = _hits(spark, d)
    place = Window.partitionBy("audio_stem").orderBy("time", "chunk_idx", "keyword_idx", "offset")
    return left.withColumn("pos", F.row_number().over(place) - 1).withColumn("word_idx", (F.col("pos") * 3 + F.floor(F.col("time")) % 3 + F.col("chunk_idx")).cast("long"))


_SEQ = f"""{CHUNKS_SQL}, {_L}, s0 AS (SELECT *, row_number() OVER (PARTITION BY audio_stem ORDER BY time, chunk_idx, keyword_idx, "offset") - 1 AS pos FROM l),
s AS (SELECT audio_stem, pos, word, time, CAST(pos * 3 + floor(time) % 3 + chunk_idx AS BIGINT) AS word_idx FROM s0)"""
_METRICS = f"""{_SEQ}, st AS (SELECT *, time - lag(time) OVER w AS dt, word_idx - lag(word_idx) OVER w AS dw FROM s WINDOW w AS (PARTITION BY audio_stem ORDER BY pos)),
m0 AS (SELECT audio_stem, count(*) AS sequence_length, max_by(time, pos) - min_by(time, pos) AS audio_span, max_by(word_idx, pos) - min_by(word_idx, pos) AS word_span,
 count(CASE WHEN dt > 0 THEN 1 END) AS pairs, stddev_pop(CASE WHEN dt > 0 THEN dw / dt END) AS spread, count(DISTINCT word) AS unique_anchors FROM st GROUP BY audio_stem),
m AS (SELECT *, CASE WHEN audio_span <> 0 THEN word_span / audio_span END AS wps, CASE WHEN pairs >= 2 THEN spread ELSE 0.0 END AS wps_std, CASE WHEN audio_span <> 0 THEN sequence_length * 60.0 / audio_span END AS anchor_density, unique_anchors / sequence_length AS diversity FROM m0)"""


@query(f"""WITH {_METRICS} SELECT audio_stem, sequence_length, round(audio_span, 5) AS audio_span, word_span, round(wps, 5) AS wps, round(wps_std, 5) AS wps_std, round(anchor_density, 5) AS anchor_density, round(diversity, 5) AS diversity FROM m""")
def sequence_metrics(spark, d):
    m = sequences.sequence_metrics(_plain_sequence(spark, d))
    return m.select("audio_stem", "sequence_length", F.round("audio_span", 5).alias("audio_span"), "word_span", *[F.round(c, 5).alias(c) for c in ("wps", "wps_std", "anchor_density", "diversity")])


@query(
    f"""WITH {_METRICS}, c AS (SELECT audio_stem, CASE WHEN sequence_length < 2 OR audio_span <= 0 OR word_span <= 0 THEN 0.0 ELSE
 0.3 * least(1.0, (sequence_length - 5) / CAST(15 AS DOUBLE) + 0.5) + 0.25 * CASE WHEN wps BETWEEN 1 AND 5 THEN 1 - abs(wps - 2.5) / 2.5 ELSE 0.3 END + 0.2 * greatest(0.0, 1 - wps_std / 2) + 0.15 * diversity + 0.1 * 0.5 END AS confidence FROM m)
SELECT audio_stem, round(confidence, 5) AS confidence FROM c"""
)
def sequence_confidence(spark, d):
    m = sequences.sequence_metrics(_plain_sequence(spark, d))
    return m.select("audio_stem", F.round(sequences.sequence_confidence(), 5).alias("confidence"))


_LEADS = f"""{_SEQ}, p0 AS (SELECT audio_stem, pos, time AS a, word_idx AS wa, lead(time) OVER w AS b, lead(word_idx) OVER w AS wb FROM s WINDOW w AS (PARTITION BY audio_stem ORDER BY pos)),
p1 AS (SELECT *, b - a AS dt, wb - wa + 1 AS nw FROM p0 WHERE wb > wa AND b > a),
p2 AS (SELECT *, CASE WHEN dt <= 15 AND nw <= 30 THEN 1 ELSE greatest(2, CAST(floor(dt / 15) AS INTEGER) + 1, CAST(floor(nw / 30) AS INTEGER) + 1) END AS n FROM p1 WHERE nw / dt BETWEEN 0.5 AND 6.0),
p3 AS (SELECT *, unnest(range(0, n)) AS sl FROM p2), p4 AS (SELECT *, CASE WHEN sl = n - 1 THEN nw - (nw // n) * sl ELSE nw // n END AS sz FROM p3)"""


@query(
    f"""WITH {_LEADS} SELECT audio_stem, CAST(pos AS INTEGER) AS pos, CAST(sl AS INTEGER) AS slice, CAST(sz AS INTEGER) AS word_count, round(a + sl * dt / n, 5) AS "start", round(CASE WHEN sl = n - 1 THEN b ELSE a + (sl + 1) * dt / n END, 5) AS "end",
 round(0.8 - CASE WHEN nw / dt < 1 OR nw / dt > 4.5 THEN 0.1 ELSE 0 END - CASE WHEN n > 1 THEN 0.05 ELSE 0 END, 5) AS confidence FROM p4 WHERE sz > 0"""
)
def pair_segments(spark, d):
    # a transcript without end: every pair brings its own words, counted from its first
    ws = F.transform(F.sequence("word_start", "word_end"), lambda i: F.concat(F.lit("w"), i.cast("string")))
    pairs = segments.anchor_pairs(_plain_sequence(spark, d)).withColumn("own", ws)
    pairs = pairs.withColumns({"word_start": F.lit(0), "word_end": F.col("word_end") - F.col("word_start")})
    s = segments.pair_segments(pairs, F.col("own"), F.lit(0.8))
    return s.select("audio_stem", "pos", "slice", "word_count", F.round("start", 5).alias("start"), F.round("end", 5).alias("end"), F.round("confidence", 5).alias("confidence"))


@query(
    f"""WITH {CHUNKS_SQL} SELECT u.audio_stem, u.chunk_idx AS segment_id, md5(string_agg(a.text, ' ' ORDER BY a.chunk_idx)) AS asr_md5
FROM ch u JOIN ch a ON a.audio_stem = u.audio_stem AND a.source <> 'mms' AND a."start" < u."end" + 3 AND a."end" > u."start" - 3 WHERE u.source = 'mms' GROUP BY u.audio_stem, u.chunk_idx"""
)
def overlap_asr_text(spark, d):
    c = chunk_table(spark, d)
    wide = c.filter("source = 'mms'").select("audio_stem", F.col("chunk_idx").alias("segment_id"), (F.col("start") - 3).alias("start"), (F.col("end") + 3).alias("end"))
    return scoring.overlap_text(wide, c.filter("source <> 'mms'")).select("audio_stem", "segment_id", F.md5("asr_text").alias("asr_md5"))


@query(
    f"""WITH {EVENTS_SQL}, g AS (SELECT *, CASE WHEN "start" - lag("end") OVER w > 40000 THEN 1 ELSE 0 END AS b FROM ev WINDOW w AS (PARTITION BY audio_path ORDER BY "start", "end")),
r AS (SELECT *, sum(b) OVER (PARTITION BY audio_path ORDER BY "start", "end") AS run FROM g)
SELECT audio_path, CAST(run AS BIGINT) AS run, count(*) AS n, min("start") AS "start", max("end") AS "end" FROM r GROUP BY audio_path, run"""
)
def gap_sessions(spark, d):
    g = segments.gap_sessions(timed_words(spark, d), 40_000.0)
    return g.select("audio_path", F.col("run").cast("long").alias("run"), "n", "start", "end")


@query(
    f"""WITH RECURSIVE {EVENTS_SQL}, e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY audio_path ORDER BY "start", "end") AS n, count(*) OVER (PARTITION BY audio_path) AS m FROM ev WHERE score > -5),
g AS (SELECT audio_path, n, "start" AS opened, "end" AS seen, 0 AS grp FROM e WHERE n = 1
 UNION ALL SELECT e.audio_path, e.n, CASE WHEN e."start" - g.seen > 40000 OR e."end" - g.opened > 400000 THEN e."start" ELSE g.opened END, e."end", g.grp + CASE WHEN e."start" - g.seen > 40000 OR e."end" - g.opened > 400000 THEN 1 ELSE 0 END
 FROM g JOIN e ON e.audio_path = g.audio_path AND e.n = g.n + 1)
SELECT e.audio_path, min(e."start") AS "start", max_by(e."end", e.n) AS "end", CAST(count(*) AS INTEGER) AS word_count, round(avg(e.score), 9) AS score FROM g JOIN e ON e.audio_path = g.audio_path AND e.n = g.n WHERE e.m >= 3 GROUP BY e.audio_path, g.grp HAVING count(*) >= 3"""
)
def utterance_fold(spark, d):
    """Utterances with the length limit from their start, which depends on each break before."""
    u = segments.utterances(timed_words(spark, d), max_gap=40_000.0, max_seconds=400_000.0)
    return u.select("audio_path", "start", "end", "word_count", F.round("score", 9).alias("score"))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(F.col("user_id").alias("audio_path"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("frame"), F.col("value").alias("energy"))


@query(
    """WITH fr AS (SELECT user_id AS audio_path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value AS energy FROM events),
md AS (SELECT audio_path, quantile_disc(energy, 0.5) AS med FROM fr GROUP BY audio_path),
sp AS (SELECT fr.audio_path, frame, max(CASE WHEN energy > 2 * med THEN 1 ELSE 0 END) OVER (PARTITION BY fr.audio_path ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS speech FROM fr JOIN md ON md.audio_path = fr.audio_path),
ed AS (SELECT *, CASE WHEN speech = 1 AND coalesce(lag(speech) OVER (PARTITION BY audio_path ORDER BY frame), 0) = 0 THEN 1 ELSE 0 END AS st FROM sp),
rn AS (SELECT *, sum(st) OVER (PARTITION BY audio_path ORDER BY frame) AS run FROM ed),
rg AS (SELECT audio_path, run, min(frame) AS a, max(frame) + 1 AS b FROM rn WHERE speech = 1 GROUP BY audio_path, run HAVING max(frame) + 1 - min(frame) >= 8),
mg AS (SELECT *, CASE WHEN coalesce(a - lag(b) OVER (PARTITION BY audio_path ORDER BY a) < 4, false) THEN 0 ELSE 1 END AS nw FROM rg),
g2 AS (SELECT *, sum(nw) OVER (PARTITION BY audio_path ORDER BY a) - 1 AS region FROM mg)
SELECT audio_path, CAST(region AS BIGINT) AS region, round(min(a) * CAST(0.01 AS DOUBLE), 6) AS "start", round(max(b) * CAST(0.01 AS DOUBLE), 6) AS "end" FROM g2 GROUP BY audio_path, region"""
)
def vad_islands(spark, d):
    r = vad.speech_regions(_frames(spark, d), least=0.08, gap=0.04)
    return r.select("audio_path", F.col("region").cast("long").alias("region"), F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(
    f"""WITH {EVENTS_SQL}, n AS (SELECT *, CAST(greatest(3, floor((2 + "start" % 7) * 2.5)) AS BIGINT) AS n_words FROM ev)
SELECT audio_path, "start", n_words, CAST(coalesce(sum(n_words) OVER (PARTITION BY audio_path ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_word FROM n"""
)
def budget_assign(spark, d):
    w = timed_words(spark, d).withColumn("end", F.col("start") + (2 + F.col("start") % 7))
    w = w.withColumn("rate", F.lit(2.5))
    b = segments.budget_words(w.withColumn("end", F.col("start") + F.round(F.col("end") - F.col("start"), 6)), F.col("rate"))
    return b.select("audio_path", "start", "n_words", "first_word")


@query(
    f"""WITH RECURSIVE p AS MATERIALIZED (SELECT source AS session, doc_id AS para_idx, len(list_filter(regexp_split_to_array(text, '[\\s\\x{{00A0}}\\x{{0085}}\\x0B]+'), lambda x: x <> '')) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
g AS (SELECT session, i, para_idx, 0 AS file, n AS got FROM p WHERE i = 1
 UNION ALL SELECT p.session, p.i, p.para_idx, g.file + CASE WHEN g.got >= 2000 THEN 1 ELSE 0 END, CASE WHEN g.got >= 2000 THEN 0 ELSE g.got END + p.n FROM g JOIN p ON p.session = g.session AND p.i = g.i + 1)
SELECT session, session || '_' || file AS audio, para_idx FROM g WHERE file < 3"""
)
def paragraph_bucketing(spark, d):
    """Documents of a source dealt to three files in order; the pointer carries over."""
    p = read(spark, d, "documents").select(F.col("source").alias("session"), F.col("doc_id").alias("para_idx"), "text")
    f = p.select("session").distinct().withColumn("file_idx", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    f = f.select("session", "file_idx", F.concat("session", F.lit("_"), F.col("file_idx").cast("string")).alias("audio"), F.lit(2000.0).alias("expected_words"))
    return segments.bucket_paragraphs(p, f)


@query(
    f"""WITH {EVENTS_SQL}, g AS (SELECT audio_path, CAST(floor("start" / 3600) * 3600 AS DOUBLE) AS grid, "start", "end", word FROM ev)
SELECT audio_path, grid AS "start", greatest(grid + 3600, max("end")) AS "end", string_agg(word, ' ' ORDER BY "start", word) AS text FROM g GROUP BY audio_path, grid"""
)
def tumbling_regrid(spark, d):
    e = timed_words(spark, d).withColumnRenamed("word", "text").withColumnRenamed("audio_path", "audio_stem")
    return chunks.regrid(e, 3600.0).withColumnRenamed("audio_stem", "audio_path")


@query(
    f"""WITH RECURSIVE {EVENTS_SQL}, e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY audio_path ORDER BY "start") AS n FROM ev),
g AS (SELECT audio_path, n, "start" AS opened, 0 AS grp FROM e WHERE n = 1
 UNION ALL SELECT e.audio_path, e.n, CASE WHEN e."start" - g.opened < 50000 THEN g.opened ELSE e."start" END, g.grp + CASE WHEN e."start" - g.opened < 50000 THEN 0 ELSE 1 END FROM g JOIN e ON e.audio_path = g.audio_path AND e.n = g.n + 1)
SELECT e.audio_path AS audio_stem, min(e."start") AS "start", max_by(e."end", e.n) AS "end", string_agg(e.word, ' ' ORDER BY e.n) AS text FROM g JOIN e ON e.audio_path = g.audio_path AND e.n = g.n GROUP BY e.audio_path, g.grp"""
)
def accumulated_chunks(spark, d):
    """Phase one of re-gridding: what is appended depends on where the chunk began."""
    e = timed_words(spark, d).withColumnRenamed("word", "text").withColumnRenamed("audio_path", "audio_stem")
    return chunks.accumulate_chunks(e, 50_000.0)


@query(
    """WITH f AS (SELECT o_orderkey AS audio_stem, o_totalprice / 1000 AS duration FROM orders), c AS (SELECT *, unnest(range(0, CAST(greatest(ceil(duration / 28), 1) AS BIGINT))) AS chunk_idx FROM f)
SELECT audio_stem, CAST(chunk_idx AS INTEGER) AS chunk_idx, chunk_idx * CAST(28 AS DOUBLE) AS "start", least(chunk_idx * CAST(28 AS DOUBLE) + 30, duration) AS "end" FROM c WHERE least(chunk_idx * CAST(28 AS DOUBLE) + 30, duration) - chunk_idx * CAST(28 AS DOUBLE) >= 0.5"""
)
def overlap_chunks(spark, d):
    f = read(spark, d, "orders").select(F.col("o_orderkey").alias("audio_stem"), (F.col("o_totalprice") / 1000).alias("duration"))
    return chunks.fixed_chunks(f, 30.0, 2.0, 0.5)


_FRAME_TOKENS = """fr AS (SELECT conv_id * 100 + turn AS audio_stem, generate_subscripts(string_split(lower(text), ''), 1) - 1 AS frame, unnest(string_split(lower(text), '')) AS c FROM conversations WHERE text <> ''),
ft AS (SELECT audio_stem, frame, CASE WHEN c = ' ' THEN '|' WHEN regexp_matches(c, '^[aeiou]$') AND frame % 5 = 0 THEN '<pad>' ELSE c END AS token FROM fr)"""


@query(
    f"""WITH {_FRAME_TOKENS}, n AS (SELECT *, coalesce(lag(token) OVER w <> token, true) AS isnew, sum(CASE WHEN token = '|' THEN 1 ELSE 0 END) OVER w AS part FROM ft WINDOW w AS (PARTITION BY audio_stem ORDER BY frame)),
g AS (SELECT audio_stem, part, string_agg(token, '' ORDER BY frame) AS word, min(frame) AS a, max(frame) AS b FROM n WHERE isnew AND token NOT IN ('<pad>', '|') GROUP BY audio_stem, part)
SELECT audio_stem, CAST(row_number() OVER (PARTITION BY audio_stem ORDER BY part) - 1 AS INTEGER) AS word_idx, word, round_even(a * CAST(0.02 AS DOUBLE), 3) AS "start", round_even(b * CAST(0.02 AS DOUBLE), 3) AS "end" FROM g"""
)
def ctc_collapse(spark, d):
    c = read(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("audio_stem"), F.filter(F.split(F.lower("text"), ""), lambda x: x != "").alias("cs"))
    f = c.select("audio_stem", F.posexplode("cs").alias("frame", "c"))
    token = F.when(F.col("c") == " ", "|").when(F.col("c").rlike("^[aeiou]$") & (F.col("frame") % 5 == 0), "<pad>").otherwise(F.col("c"))
    return ctc.collapse_frames(f.select("audio_stem", "frame", token.alias("token")))


def _turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = with_next_turn(read(spark, d, "conversations").select("conv_id", "turn", "text"), "text", "next")
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("pair_id"), "turn", T.words(F.col("text")).alias("heard"), T.words(F.col("next")).alias("written")).filter("written is not null")


@query()
def dtw_align(spark, d):
    """Warping of every turn's words with those of the next."""
    return dtw.dtw_align(_turn_pairs(spark, d), "pair_id", "heard", "written").select("pair_id", F.round("score", 6).alias("score"), F.size("path_heard").alias("path_length"))


@query()
def word_aligned_segments(spark, d):
    """Segments cut along the warping path; heard words are spread over twelve seconds a turn, or 0.3 each if that is longer."""
    p = _turn_pairs(spark, d).withColumn("end", F.greatest(F.lit(12.0), 0.3 * F.size("heard")))
    step = F.col("end") / F.size("heard")
    heard = F.transform("heard", lambda w, i: F.struct(w.alias("word"), (i * step).alias("start"), ((i + 1) * step).alias("end")))
    q = p.select("pair_id", F.lit("s").alias("session"), F.lit(0.0).alias("start"), "end", heard.alias("heard"), "written")
    return dtw.word_segments(q).select("pair_id", "piece", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "text", F.round("align_score", 6).alias("align_score"))


@query()
def difflib_blocks(spark, d):
    """Equal runs of three words or more between a turn and the next."""
    return dtw.block_align(_turn_pairs(spark, d), "pair_id", "written", "heard")


@query(
    """WITH ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
x AS (SELECT doc_id, p, trim(CASE WHEN p % 4 = 2 THEN 'Day ' || (p // 8) ELSE t END) AS t FROM ln), y AS (SELECT *, regexp_matches(t, '(?i)(day\\s*\\d+|^\\d{1,2}/\\d{1,2}/\\d{2,4})') AND length(t) < 50 AS h FROM x WHERE t <> ''),
z AS (SELECT *, last_value(CASE WHEN h THEN t END IGNORE NULLS) OVER w AS sec, last_value(CASE WHEN h THEN p END IGNORE NULLS) OVER w AS pos_at, bool_or(h) OVER (PARTITION BY doc_id) AS headed FROM y WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
b AS (SELECT doc_id, coalesce(sec, 'all') AS section, coalesce(pos_at, -1) AS pos_at, string_agg(t, ' ' ORDER BY p) AS text FROM z WHERE NOT h AND (NOT headed OR pos_at IS NOT NULL) GROUP BY ALL),
hh AS (SELECT doc_id, t AS section, p AS pos_at FROM z WHERE h), a AS (SELECT * FROM b UNION ALL SELECT doc_id, section, pos_at, '' FROM hh WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = hh.doc_id AND b.pos_at = hh.pos_at))
SELECT doc_id, section, md5(max_by(text, pos_at)) AS text_md5 FROM a GROUP BY doc_id, section"""
)
def day_sections(spark, d):
    ln = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t"))
    p = F.col("i") + 1
    text = F.when(p % 4 == 2, F.concat(F.lit("Day "), F.floor(p / 8).cast("string"))).otherwise(F.col("t"))
    s = chunks.day_sections(ln.select("doc_id", p.alias("p"), text.alias("text")), "doc_id", "p")
    return s.select("doc_id", "section", F.md5("text").alias("text_md5"))


_CHAIN = f"""{_FILES}, {_L}, {_R}, {_MERGE},
few AS (SELECT audio_stem FROM mg GROUP BY audio_stem HAVING count(*) >= 5),
am AS (SELECT mg.* FROM mg JOIN few USING (audio_stem)), {_band_sql("am")},
cc AS (SELECT * FROM k WHERE inside OR (NOT any_inside AND place <= 3)), {_lis_sql("cc")},
st AS (SELECT *, time - lag(time) OVER w AS dt, word_idx - lag(word_idx) OVER w AS dw FROM lis WINDOW w AS (PARTITION BY audio_stem ORDER BY pos)),
me AS (SELECT audio_stem, count(*) AS n, max_by(time, pos) - min_by(time, pos) AS span, max_by(word_idx, pos) - min_by(word_idx, pos) AS words,
 count(CASE WHEN dt > 0 THEN 1 END) AS steps, stddev_pop(CASE WHEN dt > 0 THEN dw / dt END) AS spread, count(DISTINCT word) AS kinds, avg(confidence) AS mean FROM st GROUP BY audio_stem),
sc AS (SELECT audio_stem, 0.3 * least(1.0, (n - 5) / CAST(15 AS DOUBLE) + 0.5) + 0.25 * CASE WHEN words / span BETWEEN 1 AND 5 THEN 1 - abs(words / span - 2.5) / 2.5 ELSE 0.3 END
 + 0.2 * greatest(0.0, 1 - CASE WHEN steps >= 2 THEN spread ELSE 0.0 END / 2) + 0.15 * kinds / n + 0.1 * mean AS conf FROM me WHERE n >= 2 AND span > 0 AND words > 0),
pr AS (SELECT st.audio_stem, pos, time AS a, word_idx AS wa, lead(time) OVER w AS b, lead(word_idx) OVER w AS wb, conf FROM st JOIN sc ON sc.audio_stem = st.audio_stem AND conf >= 0.4 WINDOW w AS (PARTITION BY st.audio_stem ORDER BY pos)),
p1 AS (SELECT *, b - a AS dt, wb - wa + 1 AS nw FROM pr WHERE wb > wa AND b > a),
p2 AS (SELECT *, CASE WHEN dt <= 15 AND nw <= 30 THEN 1 ELSE greatest(2, CAST(floor(dt / 15) AS INTEGER) + 1, CAST(floor(nw / 30) AS INTEGER) + 1) END AS n FROM p1 WHERE nw / dt BETWEEN 0.5 AND 6.0),
p3 AS (SELECT *, unnest(range(0, n)) AS sl FROM p2), p4 AS (SELECT *, CASE WHEN sl = n - 1 THEN nw - (nw // n) * sl ELSE nw // n END AS sz, wa + sl * (nw // n) AS w0 FROM p3),
tx AS (SELECT p4.audio_stem, p4.pos, sl, string_agg(lower(w.w), ' ' ORDER BY w.word_idx) AS text FROM p4 JOIN f ON f.audio_stem = p4.audio_stem
 JOIN (SELECT session, row_number() OVER (PARTITION BY session ORDER BY doc_id, p) - 1 AS word_idx, w FROM tw1) w ON w.session = f.session AND w.word_idx >= w0 AND w.word_idx < w0 + sz GROUP BY ALL)"""


@query(
    f"""WITH RECURSIVE {_CHAIN} SELECT audio_stem, CAST(pos AS INTEGER) AS pos, CAST(sl AS INTEGER) AS slice, text, round(a + sl * dt / n, 5) AS "start", round(CASE WHEN sl = n - 1 THEN b ELSE a + (sl + 1) * dt / n END, 5) AS "end",
 round(conf - CASE WHEN nw / dt < 1 OR nw / dt > 4.5 THEN 0.1 ELSE 0 END - CASE WHEN n > 1 THEN 0.05 ELSE 0 END, 8) AS confidence FROM p4 JOIN tx USING (audio_stem, pos, sl) WHERE sz > 0"""
)
def alignment_pipeline(spark, d):
    """The whole chain: hits, merge, candidates, sequences, scores, segments."""
    from speechmart.plans.alignment import segments_of

    s = segments_of(_merged(spark, d), _files(spark, d), _transcript(spark, d), KEYWORDS, least=0.0)
    return s.select("audio_stem", "pos", "slice", "text", F.round("start", 5).alias("start"), F.round("end", 5).alias("end"), F.round("confidence", 8).alias("confidence"))


@query()
def forced_alignment(spark, d):
    """Words of all turns laid on the frames of a stand-in model."""
    clips = spelled_clips(spark, d)
    words = ctc.align_words(clips, spelling_model, SPELLING["|"], "clip")
    return words.withColumns({c: F.round(c, 6) for c in ("start", "end", "score")})


def _vad_sql(frames: str, reach: int, least: int, gap: int) -> str:
    """Speech regions of ``fr`` (audio_path, frame, energy); bounds in frames."""
    return f"""WITH {frames},
md AS (SELECT audio_path, quantile_disc(energy, 0.5) AS med FROM fr GROUP BY audio_path),
sp AS (SELECT fr.audio_path, frame, max(CASE WHEN energy > 2 * med THEN 1 ELSE 0 END) OVER (PARTITION BY fr.audio_path ORDER BY frame ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS speech FROM fr JOIN md ON md.audio_path = fr.audio_path),
ed AS (SELECT *, CASE WHEN speech = 1 AND coalesce(lag(speech) OVER (PARTITION BY audio_path ORDER BY frame), 0) = 0 THEN 1 ELSE 0 END AS st FROM sp),
rn AS (SELECT *, sum(st) OVER (PARTITION BY audio_path ORDER BY frame) AS run FROM ed),
rg AS (SELECT audio_path, run, min(frame) AS a, max(frame) + 1 AS b FROM rn WHERE speech = 1 GROUP BY audio_path, run HAVING max(frame) + 1 - min(frame) >= {least}),
mg AS (SELECT *, CASE WHEN coalesce(a - lag(b) OVER (PARTITION BY audio_path ORDER BY a) < {gap}, false) THEN 0 ELSE 1 END AS nw FROM rg),
g2 AS (SELECT *, sum(nw) OVER (PARTITION BY audio_path ORDER BY a) - 1 AS region FROM mg)
SELECT audio_path, CAST(region AS BIGINT) AS region, round(min(a) * CAST(0.01 AS DOUBLE), 6) AS "start", round(max(b) * CAST(0.01 AS DOUBLE), 6) AS "end" FROM g2 GROUP BY audio_path, region"""


@query(
    _vad_sql(
        """em AS (SELECT vec_id AS audio_path, embedding AS x, unnest(range((len(embedding) - 10) // 4 + 1)) AS frame FROM embeddings WHERE len(embedding) >= 10),
fr AS (SELECT audio_path, frame, list_sum(list_transform(x[frame * 4 + 1 : frame * 4 + 10], lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))) / 10 AS energy FROM em)""",
        1, 3, 2,
    )
)
def voiced_regions(spark, d):
    """Vectors as waveforms of 400 samples a second: their frames' energies, and the regions that stand out."""
    audio = read(spark, d, "embeddings").select(F.col("vec_id").alias("audio_path"), F.col("embedding").alias("samples"))
    regions = vad.speech_regions(vad.frame_energies(audio, rate=400), reach=1, least=0.03, gap=0.02)
    return regions.select("audio_path", "region", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(
    f"""WITH RECURSIVE {EVENTS_SQL}, w AS (SELECT audio_path % 10 AS block, audio_path, row_number() OVER (PARTITION BY audio_path % 10 ORDER BY audio_path, "start", word) - 1 AS pos, "start", "end", word FROM ev),
c AS (SELECT block, pos, audio_path, "start", "end", word, CAST(0 AS BIGINT) AS piece, "start" AS began FROM w WHERE pos = 0
 UNION ALL SELECT w.block, w.pos, w.audio_path, w."start", w."end", w.word,
  CASE WHEN w."start" - c."end" > 3600 OR w."end" - c.began > 14400 OR w.audio_path <> c.audio_path THEN c.piece + 1 ELSE c.piece END,
  CASE WHEN w."start" - c."end" > 3600 OR w."end" - c.began > 14400 OR w.audio_path <> c.audio_path THEN w."start" ELSE c.began END
 FROM c JOIN w ON w.block = c.block AND w.pos = c.pos + 1)
SELECT block, piece, audio_path, string_agg(word, ' ' ORDER BY pos) AS text, min("start") AS "start", arg_max("end", pos) AS "end" FROM c GROUP BY block, piece, audio_path"""
)
def split_runs(spark, d):
    """Events of ten users a block, cut at an hour's gap, at four hours and where the user changes."""
    words = timed_words(spark, d).withColumn("block", F.col("audio_path") % 10)
    placed = ranking.positions(words, ["block"], ["audio_path", "start", "word"], "pos")
    return segments.split_runs(placed, max_gap=3600.0, max_seconds=14400.0)


@query(
    f"""WITH {_TW}, {EVENTS_SQL}, r AS (SELECT audio_path, 'src' || audio_path % 20 AS session, "start", CAST(greatest(3, floor((2 + "start" % 7) * 2.5)) AS BIGINT) AS n_words FROM ev),
b AS (SELECT *, coalesce(sum(n_words) OVER (PARTITION BY audio_path ORDER BY "start" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_word FROM r),
x AS (SELECT session, row_number() OVER (PARTITION BY session ORDER BY doc_id, p) - 1 AS word_idx, w AS word FROM tw1)
SELECT audio_path, "start", count(*) AS words, md5(string_agg(word, ' ' ORDER BY word_idx)) AS text_md5 FROM b JOIN x ON x.session = b.session AND x.word_idx >= first_word AND x.word_idx < first_word + n_words GROUP BY ALL HAVING count(*) >= 3"""
)
def budget_texts(spark, d):
    """Events as speech regions, each with the next words of its session's transcript."""
    w = timed_words(spark, d).select("audio_path", "start", (F.col("start") + F.round(2 + F.col("start") % 7, 6)).alias("end"))
    w = w.withColumn("session", F.concat(F.lit("src"), (F.col("audio_path") % 20).cast("string")))
    b = segments.budget_words(w, F.lit(2.5))
    t = segments.budget_text(b, _transcript(spark, d, segments.words_asked(b, "session")), "session")
    return t.select("audio_path", "start", F.size(T.words(F.col("text"))).cast("long").alias("words"), F.md5("text").alias("text_md5"))
