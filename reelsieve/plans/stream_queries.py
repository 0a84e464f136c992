"""Streaming forms run over the whole events table as a finished stream; their SQL is the batch form's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsieve.functions import plugins
from reelsieve.plans.base import FRAMES_SQL, Registry, frames
from reelsieve.plans.frame_queries import SQL as FRAME_SQL
from reelsieve.session import shared_dir, shared_table, table
from reelsieve.streaming import gates

query = Registry()


def _finished(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to its end into a table in the shared folder, and read that."""
    out, state = shared_table(spark, "stream"), shared_table(spark, "stream-state")
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _stream(spark: SparkSession, d: str) -> DataFrame:
    shared_dir(spark)
    path = f"{d}/events.parquet"
    # as a pattern, so that the table may be one file or a folder of files
    t = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/events.parque[t]")
    hours = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / F.lit(3600000000.0)
    return t.select(F.col("user_id").alias("video"), F.col("event_id").alias("frame"), "value", hours.alias("t"))


@query(FRAME_SQL["b8_candidate_frames"])
def r1_streaming_gate(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a stream, with two numbers of state a key: the same as in batch."""
    return _finished(spark, gates.gated(_stream(spark, d), "video", "frame", "t", "value", 6.0, 20.0).select("video", "frame"))


@query(FRAME_SQL["w2_b7_adaptive_threshold"])
def r2_r5_streaming_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Adaptive thresholds of a stream, with a bounded history a key: the same as in batch."""
    out = gates.adaptive(_stream(spark, d), "video", "frame", "t", "value")
    return _finished(spark, out.select("video", "frame", F.round("threshold", 6).alias("threshold")))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events), h AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM h GROUP BY user_id, s""")
def r4_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of rows less than half a day apart; the same operator runs over streams."""
    return gates.sessions(table(spark, d, "events").select("user_id", "ts"), "user_id", "ts", "12 hours")


@query("SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS \"end\", count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def r3_r7_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Counts and means by day; the same operator runs over streams, where late rows count up to the watermark."""
    t = gates.tumbling(table(spark, d, "events").select("user_id", "ts", "value"), "user_id", "ts", "value", "1 day")
    return t.withColumn("mean", F.round("mean", 6))


@query("SELECT DISTINCT doc_id, length(coalesce(text, ''))::INT AS prompt_length, true AS answered FROM documents")
def e31_a21_mock_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Every text sent to the mock client, one client a partition, its reply parsed."""
    t = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    r = plugins.extract(t, "doc_id", "text")
    return r.select("doc_id", F.try_variant_get("parsed", "$.prompt_length", "int").alias("prompt_length"), F.col("error").isNull().alias("answered"))


@query(f"""WITH {FRAMES_SQL}, g AS (SELECT video, max(t) AS dur FROM f GROUP BY video) SELECT video, i::INT AS sample_no, i * 6 AS at FROM g, LATERAL (SELECT unnest(range(ceil(dur / 6)::BIGINT)) AS i) WHERE i * 6 < dur""")
def a5_sample_grid(spark: SparkSession, d: str) -> DataFrame:
    """Sampling times of a video below its duration."""
    from reelsieve.sources.files import sample_grid

    g = frames(spark, d).groupBy("video").agg(F.max("t").alias("dur"))
    return sample_grid(g, "dur", 6000).select("video", "sample_no", (F.col("sample_no") * 6).cast("bigint").alias("at"))


@query("""WITH b AS (SELECT p_partkey, (p_size % 31)::DOUBLE AS fps, p_partkey % 900 AS n, p_size * 30 AS w, p_partkey % 7 * 100 AS h FROM part)
    SELECT p_partkey, round(CASE WHEN fps > 0 THEN n / fps ELSE 0 END, 9) AS duration, round(CASE WHEN h > 0 THEN w / h::DOUBLE ELSE 0 END, 9) AS aspect_ratio FROM b""")
def a3_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Duration and aspect ratio with their guards."""
    from reelsieve.sources.files import video_metadata

    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 31).cast("double").alias("fps"), (F.col("p_partkey") % 900).alias("frame_count"), (F.col("p_size") * 30).alias("width"), (F.col("p_partkey") % 7 * 100).alias("height"))
    return video_metadata(p).select("p_partkey", F.round("duration", 9).alias("duration"), F.round("aspect_ratio", 9).alias("aspect_ratio"))


QUERIES, SQL = query.queries, query.sql
