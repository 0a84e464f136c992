"""Registering queries with their SQL, and the views both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsieve.session import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None):
        def add(f: Query) -> Query:
            self.queries[name or f.__name__] = f
            if sql:
                self.sql[name or f.__name__] = sql
            return f

        return add


#: The events of a user as the frames of a video, time in hours since the first day.
FRAMES_SQL = "f AS (SELECT user_id AS video, event_id AS frame, event_type AS kind, value, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0::DOUBLE AS t FROM events)"


def frames(spark: SparkSession, d: str) -> DataFrame:
    hours = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / F.lit(3600000000.0)
    return table(spark, d, "events").select(F.col("user_id").alias("video"), F.col("event_id").alias("frame"), F.col("event_type").alias("kind"), "value", hours.alias("t"))


#: The newest row of each candidate that has a video, a time, a finite score and a usable embedding.
CANDIDATES_SQL = """c0 AS (SELECT * FROM (SELECT candidate_id, video_id, ts, scene_id, embedding, importance_score,
        row_number() OVER (PARTITION BY candidate_id ORDER BY ingested_at DESC) AS k FROM frame_candidates) WHERE k = 1),
    c AS (SELECT candidate_id, video_id, ts, scene_id, importance_score, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM c0
        WHERE video_id IS NOT NULL AND ts IS NOT NULL AND isfinite(importance_score) AND len(embedding) = 64
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""


def candidates(spark: SparkSession, d: str, with_embedding: bool = True) -> DataFrame:
    cols = ["candidate_id", "video_id", "ts", "scene_id", "embedding", "importance_score", "ingested_at"]
    t = table(spark, d, "frame_candidates").select(*cols)
    ok = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    usable = ok & (F.size("embedding") == 64) & F.exists("embedding", lambda x: x != 0)
    rest = [c for c in cols if c not in ("candidate_id", "ingested_at", "embedding")]
    # the embedding takes part in the shuffle only where it is used
    carried = F.col("embedding") if with_embedding else F.lit(None).cast("array<float>")
    row = F.max(F.struct("ingested_at", *rest, usable.alias("usable"), carried.alias("embedding"))).alias("r")
    t = t.groupBy("candidate_id").agg(row).select("candidate_id", *[f"r.{c}" for c in rest], "r.usable", "r.embedding")
    score = F.col("importance_score")
    t = t.where(F.col("usable") & F.col("video_id").isNotNull() & F.col("ts").isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))).drop("usable")
    return t if with_embedding else t.drop("embedding")


SCENES_SQL = "s AS (SELECT DISTINCT video_id, scene_id, start_s, end_s FROM scenes WHERE start_s IS NOT NULL AND end_s IS NOT NULL)"


def scenes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scenes").where("start_s IS NOT NULL AND end_s IS NOT NULL").distinct()
