"""Queries that run their operator as a stream over all that is there, and return the written table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechmart.sources.shared import shared_dir
from speechmart.queries.adapters import EVENTS_SQL, timed_words
from speechmart.streaming.streams import new_files, regrid_stream, session_stream, utterance_stream

QUERIES, SQL = {}, {}


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Runs a complete-mode stream until its input is read, and gives its last result as a table."""
    spark = stream.sparkSession
    place = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/table")

    q = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/table")


def _events(spark: SparkSession, d: str) -> DataFrame:
    path = f"{d}/events.parquet"
    e = new_files(spark, f"{d}/events.parque[t]", spark.read.parquet(path).schema)  # a pattern, since a source may not be one file
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_regrid(spark: SparkSession, d: str) -> DataFrame:
    g = drain(regrid_stream(_events(spark, d), "user_id", size="6 hours"), "regrid")
    return g.select("user_id", F.unix_micros("start").alias("start_us"), "n", F.round("total", 4).alias("total"))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    # data at rest come in no order of time: a watermark would lose the rows of later batches
    s = drain(session_stream(_events(spark, d), "user_id", gap="12 hours", late=None), "sessions")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


#: State with lists and timers is kept in this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_utterances(spark: SparkSession, d: str) -> DataFrame:
    """Events as words that come as files in any order; a last file moves the watermark beyond all of them."""
    place = f"{shared_dir(spark)}/utterances-{uuid.uuid4().hex}"
    words = timed_words(spark, d).withColumn("ts", F.timestamp_micros((F.col("start") * 1_000_000).cast("long")))
    words.write.parquet(f"{place}/words")
    end = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in words.schema if f.name != "ts"], F.lit("9999-01-01").cast("timestamp").alias("ts"))
    end.write.mode("append").parquet(f"{place}/words")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    try:
        groups = utterance_stream(new_files(spark, f"{place}/words", words.schema, 1_000), late="100000 days", max_gap=40_000.0, max_seconds=400_000.0)
        q = groups.writeStream.outputMode("append").option("checkpointLocation", f"{place}/progress").trigger(availableNow=True).format("parquet").option("path", f"{place}/table").start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = spark.read.schema(groups.schema).parquet(f"{place}/table")
    return got.withColumnRenamed("audio_path", "user_id")


QUERIES |= {"stream_regrid": stream_regrid, "stream_sessions": stream_sessions, "stream_utterances": stream_utterances}
SQL |= {
    "stream_regrid": """SELECT user_id, epoch_us(ts) // 21600000000 * 21600000000 AS start_us, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""",
    "stream_sessions": """WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 43200000000 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t) AS run FROM g) SELECT user_id, min(t) AS start_us, max(t) + 43200000000 AS end_us, count(*) AS n FROM r GROUP BY user_id, run""",
    "stream_utterances": f"""WITH RECURSIVE {EVENTS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY audio_path ORDER BY "start", word) AS i FROM ev WHERE score > -5),
u AS (SELECT audio_path, i, "start", "end", word, 1 AS g, "start" AS began FROM k WHERE i = 1
 UNION ALL SELECT k.audio_path, k.i, k."start", k."end", k.word, CASE WHEN k."start" - u."end" > 40000 OR k."end" - u.began > 400000 THEN u.g + 1 ELSE u.g END, CASE WHEN k."start" - u."end" > 40000 OR k."end" - u.began > 400000 THEN k."start" ELSE u.began END
 FROM u JOIN k ON k.audio_path = u.audio_path AND k.i = u.i + 1)
SELECT audio_path AS user_id, string_agg(word, ' ' ORDER BY i) AS text, min("start") AS "start", arg_max("end", i) AS "end", CAST(count(*) AS INTEGER) AS word_count FROM u GROUP BY audio_path, g HAVING count(*) >= 3""",
}
