"""Queries of the llm problems, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsieve.llm import bpe, canonical, clusters, mixing, spans, topn
from reelsieve.session import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = clusters.linkage(table(spark, d, "frame_candidates").select("candidate_id", "embedding"), "candidate_id", "embedding")
    whole = found.where("all_alike AND NOT alike_outside AND id <> cluster_id")
    return whole.select(F.col("cluster_id").alias("first_candidate_id"), F.col("id").alias("candidate_id"))


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each clustered candidate with its new cluster, the cluster's size and its most typical members."""
    found = clusters.clusters(table(spark, d, "frame_candidates").select("candidate_id", "embedding"), "candidate_id", "embedding")
    return found.select(F.col("id").alias("candidate_id"), "cluster_id", "cluster_size", F.round("typicality", 6).alias("typicality"), "is_representative")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "frame_candidates").select("candidate_id", "video_id", "scene_id", "ts", "importance_score", "ingested_at")
    rows = topn.latest(rows, "candidate_id", "ingested_at").drop("ingested_at")
    return topn.top_n(rows, 3, ["video_id", "scene_id"], "importance_score", ["ts", "candidate_id"]).select("video_id", "scene_id", "candidate_id")


P4_SQL = """
WITH newest AS (SELECT * FROM (SELECT candidate_id, video_id, scene_id, ts, importance_score,
        row_number() OVER (PARTITION BY candidate_id ORDER BY ingested_at DESC NULLS LAST) AS k FROM frame_candidates) WHERE k = 1),
ranked AS (SELECT video_id, scene_id, candidate_id,
        row_number() OVER (PARTITION BY video_id, scene_id ORDER BY importance_score DESC, ts ASC NULLS LAST, candidate_id) AS r
    FROM newest WHERE video_id IS NOT NULL AND scene_id IS NOT NULL AND importance_score IS NOT NULL AND NOT isnan(importance_score))
SELECT video_id, scene_id, candidate_id FROM ranked WHERE r <= 3
"""


def _typed(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ablation_metrics").select("metric_id", F.col("extraction_data.brand.brand_name_text").alias("brand"), F.col("extraction_data.product.industry").alias("industry"))
    both = F.array(*[F.struct(F.lit(c).alias("list_name"), F.col(c).alias("value")) for c in ("brand", "industry")])
    return t.select("metric_id", F.inline(both)).where(F.regexp_replace("value", r"(?U)\s+", "") != "")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    typed = _typed(spark, d)
    mapped = canonical.map_values(typed, table(spark, d, "canonical_entries"))
    return typed.join(mapped, ["list_name", "value"]).select("metric_id", F.col("list_name").alias("field_name"), "entry_id").distinct()


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that name no entry, and how often they were typed."""
    typed = _typed(spark, d)
    mapped = canonical.map_values(typed, table(spark, d, "canonical_entries"))
    return typed.join(mapped.where("entry_id = 0"), ["list_name", "value"]).groupBy(F.col("list_name").alias("field_name"), "value").agg(F.count_distinct("metric_id").alias("n_metrics"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), "doc_id", "text")


def _counted(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), "doc_id", "text", counts_only=True, carry=["source"])


def p7_tokens_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each source and language."""
    counted = bpe.encode(table(spark, d, "documents"), "doc_id", "text", counts_only=True, carry=["source", "lang"])
    return counted.groupBy("source", "lang").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents drawn, each with its number of copies."""
    return mixing.draw(_counted(spark, d), table(spark, d, "mix_targets"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """The shares really reached."""
    docs, targets = cut(_counted(spark, d)), table(spark, d, "mix_targets")
    return mixing.report(docs, targets, mixing.draw(docs, targets))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = spans.shared_pairs(table(spark, d, "documents"), "doc_id", "text")
    return pairs.select(F.col("doc_a").alias("doc_id_a"), F.col("doc_b").alias("doc_id_b"))


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document also stands elsewhere."""
    found = spans.coverage(table(spark, d, "documents"), "doc_id", "text")
    share = F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(0.0)
    return found.select(F.col("doc").alias("doc_id"), "n_chars", "shared_chars", "n_spans", share.alias("share"))


# All pairs by brute force: a cluster's members have the same neighbours, themselves among them, and are all of these.
P1_SQL = """
WITH u AS (SELECT DISTINCT ON (candidate_id) candidate_id AS i, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM frame_candidates WHERE candidate_id IS NOT NULL AND len(embedding) = 64
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT a.i, list_sort(list(b.i)) AS near FROM u a JOIN u b ON list_cosine_similarity(a.e, b.e) >= 0.85 - 1e-9 GROUP BY a.i),
k AS (SELECT near, count(*) AS members FROM n GROUP BY near)
SELECT near[1] AS first_candidate_id, n.i AS candidate_id FROM n JOIN k USING (near) WHERE members = len(near) AND members > 1 AND n.i <> near[1]
"""

# Every window of 200 characters of every text.
_WINDOWS = """d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 200),
w AS (SELECT doc_id, k, substring(text, k, 200) AS s FROM d, LATERAL (SELECT unnest(range(1, length(text) - 198)) AS k)),
m AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) < max(doc_id))"""
P9_SQL = f"WITH {_WINDOWS}, x AS (SELECT DISTINCT doc_id, s FROM w SEMI JOIN m USING (s)) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM x a JOIN x b USING (s) WHERE a.doc_id < b.doc_id"
P9_SHARED_SQL = f"""WITH {_WINDOWS}, x AS (SELECT doc_id, k, lead(k) OVER (PARTITION BY doc_id ORDER BY k) AS nx, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS pv FROM w SEMI JOIN m USING (s)),
c AS (SELECT doc_id, sum(least(200, coalesce(nx - k, 200)))::BIGINT AS shared_chars, count_if(pv IS NULL OR k - pv > 200) AS n_spans FROM x GROUP BY 1)
SELECT DISTINCT a.doc_id, coalesce(length(text), 0)::BIGINT AS n_chars, coalesce(shared_chars, 0) AS shared_chars, coalesce(n_spans, 0) AS n_spans, CASE WHEN length(text) > 0 THEN round(coalesce(shared_chars, 0) / length(text)::DOUBLE, 6) ELSE 0.0 END AS share FROM documents a LEFT JOIN c USING (doc_id)"""


QUERIES = {"p5_found": p5_found, "p5_unmatched": p5_unmatched, "p1_found": p1_found, "p1_clusters": p1_clusters, "p9_found": p9_found, "p9_shared": p9_shared, "p4_found": p4_found, "p7_ids": p7_ids, "p7_tokens_by_source": p7_tokens_by_source, "p8_mix": p8_mix, "p8_report": p8_report}
SQL = {"p1_found": P1_SQL, "p4_found": P4_SQL, "p9_found": P9_SQL, "p9_shared": P9_SHARED_SQL}
