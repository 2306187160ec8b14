"""Queries over scores, tiers, splits, reports and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechmart.operators import corrections, quality, scoring, splits, tiers
from speechmart.queries.adapters import SEGMENT_IDS, SEGMENT_ORDER, SEGMENTS_SQL, read, segments

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_TIER = """CASE WHEN llm_score >= 0.7 AND align_score >= 0.6 THEN 'high_confidence' WHEN llm_score >= 0.5 AND align_score >= 0.5 AND wps BETWEEN 1.0 AND 4.5 THEN 'usable'
 WHEN llm_score >= 0.4 AND align_score >= 0.4 THEN 'rough_patch' ELSE 'rejected' END"""
_TIERED = f"""{SEGMENTS_SQL}, t AS (SELECT *, {_TIER} AS tier FROM seg)"""


@query(f"WITH {_TIERED} SELECT tier, count(*) AS n FROM t GROUP BY tier")
def tier_counts(spark, d):
    s = segments(spark, d)
    return tiers.tier_counts(s.withColumn("tier", tiers.tier(F.col("llm_score"), F.col("align_score"), F.col("wps"))))


_ORDER_SQL = '"start", l_partkey, l_suppkey, l_shipdate, l_extendedprice, wps, confidence, llm_score'
_NEAR = f"""n AS (SELECT *, count(*) OVER w - 1 AS k, sum(confidence) OVER w - confidence AS s FROM t WINDOW w AS (PARTITION BY audio_path ORDER BY {_ORDER_SQL} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
m AS (SELECT *, CASE WHEN k > 0 THEN s / k ELSE 0.0 END AS near FROM n)"""


@query(f"WITH {_TIERED}, {_NEAR} SELECT audio_path, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(near, 6) AS neighbor_score FROM m")
def neighbor_score(spark, d):
    s = segments(spark, d)
    return s.select(*SEGMENT_IDS, F.round(tiers.neighbor_score(SEGMENT_ORDER), 6).alias("neighbor_score"))


@query(
    f"""WITH {_TIERED}, {_NEAR}
SELECT tier, CASE WHEN tier = 'rough_patch' AND near >= 0.6 + 1e-9 THEN 'bridge_segment' ELSE tier END AS label,
 tier IN ('high_confidence', 'usable') OR (tier = 'rough_patch' AND near >= 0.6 + 1e-9) AS included, count(*) AS n FROM m GROUP BY ALL"""
)
def bridge_inclusion(spark, d):
    a = tiers.assign(segments(spark, d), SEGMENT_ORDER, bridge=0.6 + 1e-9)
    return a.groupBy("tier", "label", "included").agg(F.count("*").alias("n"))


@query(f"""WITH {SEGMENTS_SQL} SELECT count(*) AS segments, round(sum("end" - "start") / 3600, 4) AS hours, round(avg(wps), 6) AS mean_wps, round(avg(confidence), 6) AS mean_confidence FROM seg""")
def quality_summary(spark, d):
    s = quality.summary(segments(spark, d))
    return s.select("segments", F.round("hours", 4).alias("hours"), F.round("mean_wps", 6).alias("mean_wps"), F.round("mean_confidence", 6).alias("mean_confidence"))


@query(f"WITH {SEGMENTS_SQL} SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.7 THEN 'good' WHEN confidence >= 0.6 THEN 'fair' ELSE 'low' END AS band, count(*) AS n FROM seg GROUP BY 1")
def confidence_histogram(spark, d):
    return quality.histogram(segments(spark, d), quality.confidence_band(F.col("confidence")))


@query(f"WITH {SEGMENTS_SQL} SELECT CASE WHEN wps < 1 THEN 'very_slow' WHEN wps < 1.5 THEN 'slow' WHEN wps < 3.5 THEN 'normal' WHEN wps < 4.5 THEN 'fast' ELSE 'very_fast' END AS band, count(*) AS n FROM seg GROUP BY 1")
def pace_histogram(spark, d):
    return quality.histogram(segments(spark, d), quality.pace_band(F.col("wps")))


@query(
    f"""WITH {SEGMENTS_SQL}, f AS (SELECT array_to_string(list_filter([CASE WHEN wps < 1 THEN 'very_slow_wps' END, CASE WHEN wps > 4.5 THEN 'very_fast_wps' END,
 CASE WHEN confidence < CAST(0.55 AS DOUBLE) THEN 'low_confidence' END, CASE WHEN "end" - "start" < 1 THEN 'very_short' END, CASE WHEN "end" - "start" > 12 THEN 'very_long' END], lambda x: x IS NOT NULL), ',') AS flags FROM seg)
SELECT flags, count(*) AS n FROM f WHERE flags <> '' GROUP BY flags"""
)
def flag_combinations(spark, d):
    s = segments(spark, d)
    f = s.select(F.array_join(quality.flags(F.col("start"), F.col("end"), F.col("wps"), F.col("confidence"), F.col("text")), ",").alias("flags"))
    return f.filter("flags <> ''").groupBy("flags").agg(F.count("*").alias("n"))


_FULL_ORDER = 'audio_path, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, wps, confidence, llm_score'


@query(
    f"""WITH {SEGMENTS_SQL}, f AS (SELECT * FROM seg WHERE wps < 1 OR wps > 4.5 OR confidence < CAST(0.55 AS DOUBLE) OR "end" - "start" < 1 OR "end" - "start" > 12)
SELECT audio_path, l_linenumber, l_partkey, (SELECT count(*) FROM f) AS flagged_count FROM f ORDER BY {_FULL_ORDER} LIMIT 50"""
)
def flagged_report(spark, d):
    r = quality.flagged_report(segments(spark, d), [c.strip() for c in _FULL_ORDER.split(",")])
    return r.select("audio_path", "l_linenumber", "l_partkey", "flagged_count")


@query(
    f"""WITH {SEGMENTS_SQL} SELECT count(*) FILTER (confidence >= 0.8) AS from_08, count(*) FILTER (confidence >= 0.6 AND confidence < 0.8) AS from_06,
 count(*) FILTER (confidence >= 0.4 AND confidence < 0.6) AS from_04, count(*) FILTER (confidence < 0.4) AS below_04, count(*) FILTER (confidence >= 0.6) AS usable FROM seg"""
)
def merged_distribution(spark, d):
    return quality.merged_distribution(segments(spark, d))


@query(
    f"""WITH {SEGMENTS_SQL} SELECT count(*) FILTER (align_score >= 0.6) AS align_high, count(*) FILTER (align_score >= 0.4 AND align_score < 0.6) AS align_medium, count(*) FILTER (align_score < 0.4) AS align_low,
 count(*) FILTER (confidence >= 0.7) AS confidence_high, count(*) FILTER (confidence >= 0.6 AND confidence < 0.7) AS confidence_medium, count(*) FILTER (llm_score >= 0.7) AS llm_high, count(*) FILTER (llm_score >= 0.5 AND llm_score < 0.7) AS llm_medium FROM seg"""
)
def score_distribution(spark, d):
    return quality.score_distribution(segments(spark, d))


@query(f"""WITH {SEGMENTS_SQL} SELECT audio_path, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round_even(0.4 * CAST(align_score AS DOUBLE) + 0.6 * CAST(llm_score AS DOUBLE), 3) AS combined FROM seg""")
def combined_confidence(spark, d):
    s = segments(spark, d)
    return s.select(*SEGMENT_IDS, scoring.combined_confidence(F.col("align_score"), F.col("llm_score")).alias("combined"))


def _corrections(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as corrections: quality 1 to 5 by id, 12 characters a second."""
    labels, docs = read(spark, d, "labels"), read(spark, d, "documents")
    c = docs.join(labels.select("doc_id"), "doc_id")
    q = F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise(1 + F.col("doc_id") % 5).cast("int")
    return c.select("doc_id", F.lit(0.0).alias("start"), (F.length("text") / 100).alias("end"), F.col("text").alias("corrected_text"), q.alias("quality"), F.when(F.col("doc_id") % 3 == 0, "auto").alias("source"))


_CORR = """corr AS (SELECT d.doc_id, CAST(0 AS DOUBLE) AS "start", length(d.text) / CAST(100 AS DOUBLE) AS "end", d.text AS corrected_text,
 CASE WHEN d.doc_id % 7 = 0 THEN NULL ELSE 1 + d.doc_id % 5 END AS quality, CASE WHEN d.doc_id % 3 = 0 THEN 'auto' END AS source FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


@query(f"WITH {_CORR} SELECT CAST(coalesce(quality, 0) AS INTEGER) AS quality, count(*) AS n FROM corr GROUP BY 1")
def quality_breakdown(spark, d):
    return quality.quality_counts(_corrections(spark, d))


@query(f"""WITH {_CORR} SELECT count(*) AS n, round(sum("end" - "start"), 4) AS seconds FROM corr WHERE quality >= 4""")
def training_ready(spark, d):
    return quality.training_ready(_corrections(spark, d)).select("n", F.round("seconds", 4).alias("seconds"))


@query(f"WITH {_CORR}, a AS (SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM corr) AS corrected) SELECT total, corrected, total - corrected AS remaining, round(corrected * CAST(100 AS DOUBLE) / total, 6) AS percent FROM a")
def progress(spark, d):
    return quality.progress(read(spark, d, "documents"), _corrections(spark, d)).withColumn("percent", F.round("percent", 6))


@query(f"WITH {_CORR} SELECT coalesce(source, 'manual') AS source, count(*) AS n FROM corr GROUP BY 1")
def source_counts(spark, d):
    return quality.source_counts(_corrections(spark, d))


@query(
    f"""WITH {_CORR}, n AS (SELECT *, trim(regexp_replace(regexp_replace(replace(lower(corrected_text), '`', ''''), '[^a-z '']', ' ', 'g'), ' +', ' ', 'g')) AS text FROM corr)
SELECT doc_id, CAST(quality AS INTEGER) AS quality, round("end" - "start", 6) AS duration, md5(text) AS text_md5 FROM n WHERE quality >= 3 AND trim(corrected_text) <> '' AND "end" - "start" BETWEEN 1 AND 30 AND text <> ''"""
)
def correction_to_training(spark, d):
    t = corrections.training_rows(_corrections(spark, d))
    return t.select("doc_id", "quality", F.round("duration", 6).alias("duration"), F.md5("text").alias("text_md5"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def uncorrected_anti_join(spark, d):
    return corrections.uncorrected(read(spark, d, "documents"), read(spark, d, "labels"), ["doc_id"]).select("doc_id", "source")


@query(
    """WITH s AS (SELECT doc_id AS id, n_chars % 100 / CAST(100 AS DOUBLE) AS align_score FROM documents),
x AS (SELECT doc_id AS id, (doc_id * 7 + f) % 11 / CAST(10 AS DOUBLE) AS score, 'f' || f AS file, doc_id AS row_idx FROM labels, (SELECT unnest([1, 2, 3]) AS f) WHERE (doc_id + f) % 3 <> 0),
l AS (SELECT id, max_by(score, file) AS score FROM x GROUP BY id)
SELECT s.id, round(coalesce(l.score, s.align_score, 0.5), 6) AS llm_score FROM s LEFT JOIN l ON l.id = s.id"""
)
def merge_scores_last_wins(spark, d):
    s = read(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") % 100 / 100.0).alias("align_score"))
    f = read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])).alias("f"))
    x = f.filter((F.col("id") + F.col("f")) % 3 != 0)
    x = x.select("id", ((F.col("id") * 7 + F.col("f")) % 11 / 10.0).alias("score"), F.concat(F.lit("f"), F.col("f").cast("string")).alias("file"), F.col("id").alias("row_idx"))
    return scoring.merge_scores(s, x).select("id", F.round("llm_score", 6).alias("llm_score"))


@query(
    """WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS id, length(text) % 10 / CAST(10 AS DOUBLE) AS old FROM conversations)
SELECT conv_id, turn, old AS sequence_confidence, CASE WHEN id % 2 = 0 THEN id / CAST(8 AS DOUBLE) ELSE old END AS confidence FROM s"""
)
def merge_scores_by_position(spark, d):
    c = read(spark, d, "conversations").select("conv_id", "turn", (F.length("text") % 10 / 10.0).alias("confidence"))
    turns = c.groupBy("conv_id").agg(F.count("*").alias("n"))
    sc = turns.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(2).cast("long"))).alias("id"))
    sc = sc.withColumn("llm_confidence", F.col("id") / 8.0)
    return scoring.merge_scores_by_position(c, sc, ["turn"], "conv_id").select("conv_id", "turn", "sequence_confidence", "confidence")


@query("""WITH r AS (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5 AS batch_idx FROM documents) SELECT source, doc_id, batch_idx FROM r""")
def batch_rows(spark, d):
    return scoring.batches(read(spark, d, "documents").select("source", "doc_id"), ["doc_id"], 5, "source")


def _split_sql(cut: str, part: str = "") -> str:
    ids = "concat_ws('-', '42', audio_path, l_linenumber, l_partkey, l_suppkey, l_shipdate_s, wps_s, confidence_s, llm_s)"
    return f"""WITH {_TIERED}, u AS (SELECT *, CAST(epoch_us(l_shipdate) AS VARCHAR) AS l_shipdate_s, CAST(CAST(round(wps * 10) AS BIGINT) AS VARCHAR) AS wps_s,
 CAST(CAST(round(confidence * 100) AS BIGINT) AS VARCHAR) AS confidence_s, CAST(CAST(round(llm_score * 1000) AS BIGINT) AS VARCHAR) AS llm_s FROM t),
r AS (SELECT *, row_number() OVER ({part} ORDER BY md5({ids}), l_extendedprice) AS rank, count(*) OVER ({part}) AS n FROM u)
SELECT audio_path, l_linenumber, l_partkey, l_suppkey, l_extendedprice, {cut} AS split FROM r"""


def _split_rows(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    s = s.withColumn("tier", tiers.tier(F.col("llm_score"), F.col("align_score"), F.col("wps")))
    return s.withColumns(
        {
            "ship_us": F.unix_micros(F.col("l_shipdate").cast("timestamp")),
            "wps_i": F.round(F.col("wps") * 10).cast("long"),
            "conf_i": F.round(F.col("confidence") * 100).cast("long"),
            "llm_i": F.round(F.col("llm_score") * 1000).cast("long"),
        }
    )


_SPLIT_IDS = ["audio_path", "l_linenumber", "l_partkey", "l_suppkey", "ship_us", "wps_i", "conf_i", "llm_i"]
_TIES = ["l_extendedprice"]


@query(_split_sql("CASE WHEN rank <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' WHEN rank <= floor(n * CAST(0.9 AS DOUBLE)) THEN 'val' ELSE 'test' END"))
def split_80_10_10(spark, d):
    return splits.split_80_10_10(_split_rows(spark, d), _SPLIT_IDS, ties=_TIES).select(*SEGMENT_IDS, "split")


@query(_split_sql("CASE WHEN rank <= least(floor(n * CAST(0.05 AS DOUBLE)), 500) THEN 'test' WHEN rank <= 2 * least(floor(n * CAST(0.05 AS DOUBLE)), 500) THEN 'valid' ELSE 'train' END"))
def split_capped(spark, d):
    return splits.split_capped(_split_rows(spark, d), _SPLIT_IDS, ties=_TIES).select(*SEGMENT_IDS, "split")


@query(_split_sql("CASE WHEN rank <= greatest(1, floor(n * CAST(0.05 AS DOUBLE))) THEN 'test' WHEN rank <= 2 * greatest(1, floor(n * CAST(0.05 AS DOUBLE))) THEN 'valid' ELSE 'train' END", "PARTITION BY tier"))
def split_stratified(spark, d):
    return splits.split_stratified(_split_rows(spark, d), _SPLIT_IDS, ties=_TIES).select(*SEGMENT_IDS, "split")


@query(
    """WITH d AS (SELECT doc_id, n_chars % 100 / CAST(100 AS DOUBLE) AS confidence FROM documents),
b AS (SELECT *, CASE WHEN confidence >= 0.7 THEN 0 WHEN confidence >= 0.6 THEN 1 ELSE 2 END AS band, md5('42-' || doc_id) AS h FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY h, doc_id) AS place FROM b),
k AS (SELECT *, row_number() OVER (ORDER BY band, place) AS pick FROM p WHERE place <= CASE WHEN band = 0 THEN 10 ELSE 20 END)
SELECT doc_id, band, CAST(pick AS INTEGER) AS pick FROM k WHERE pick <= 20"""
)
def stratified_sample(spark, d):
    s = read(spark, d, "documents").select("doc_id", (F.col("n_chars") % 100 / 100.0).alias("confidence"))
    return splits.review_sample(s, ["doc_id"]).select("doc_id", "band", "pick")


@query(
    f"""WITH {SEGMENTS_SQL} SELECT audio_path, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM seg WHERE confidence >= 0.6 AND "end" - "start" BETWEEN 0.5 AND 30"""
)
def clip_filter(spark, d):
    return tiers.keep_clips(segments(spark, d)).select(*SEGMENT_IDS)


@query(
    """WITH n AS (SELECT DISTINCT c_name AS name FROM customer), o AS (SELECT DISTINCT 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS other FROM supplier)
SELECT name, min(other) AS other FROM n JOIN o ON contains(lower(replace(name, '_', '')), lower(replace(other, '_', ''))) OR contains(lower(replace(other, '_', '')), lower(replace(name, '_', ''))) GROUP BY name"""
)
def fuzzy_name_join(spark, d):
    n = read(spark, d, "customer").select(F.col("c_name").alias("name"))
    o = read(spark, d, "supplier").select(F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("other"))
    return scoring.fuzzy_name_join(n, o, "name", "other")


def _dataset(spark, d):
    from speechmart.plans.alignment import dataset

    return dataset(_split_rows(spark, d), SEGMENT_ORDER, _SPLIT_IDS, bridge=0.6 + 1e-9)


_SPLIT_KEYS = "concat_ws('-', '42', audio_path, l_linenumber, l_partkey, l_suppkey, CAST(epoch_us(l_shipdate) AS VARCHAR), CAST(CAST(round(wps * 10) AS BIGINT) AS VARCHAR), CAST(CAST(round(confidence * 100) AS BIGINT) AS VARCHAR), CAST(CAST(round(llm_score * 1000) AS BIGINT) AS VARCHAR))"


@query(
    f"""WITH {_TIERED}, {_NEAR}, lb AS (SELECT *, CASE WHEN tier = 'rough_patch' AND near >= 0.6 + 1e-9 THEN 'bridge_segment' ELSE tier END AS label FROM m),
inc AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY md5({_SPLIT_KEYS})) AS rank, count(*) OVER (PARTITION BY tier) AS tn FROM lb WHERE label IN ('high_confidence', 'usable', 'bridge_segment')),
sp AS (SELECT *, greatest(1, floor(tn * CAST(0.05 AS DOUBLE))) AS share FROM inc)
SELECT label, CASE WHEN rank <= share THEN 'test' WHEN rank <= 2 * share THEN 'valid' ELSE 'train' END AS split, count(*) AS n FROM sp GROUP BY ALL"""
)
def tiered_dataset(spark, d):
    """The dataset chain: tiers, neighbours, inclusion and stratified splits, counted by label and split."""
    return _dataset(spark, d).groupBy("label", "split").agg(F.count("*").alias("n"))


