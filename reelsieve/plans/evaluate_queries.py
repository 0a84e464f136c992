"""Evaluation: rollups of benchmark rows, accuracy against a truth, comparisons, set operations, text rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelsieve.functions import expr as X
from reelsieve.functions import taxonomy
from reelsieve.operators.diff import latest_per_key
from reelsieve.plans.base import FRAMES_SQL, Registry, frames
from reelsieve.session import table
from reelsieve.sources.files import sample_grid

query = Registry()
EV = f"WITH {FRAMES_SQL}"
_BARE = r"regexp_replace(regexp_replace(video, '^.*[/\\]', ''), '\.mp4$', '')"
_TRIM = "lower(trim(method, e' \\t\\n\\r'))"


def _newest_sql(t: str, name: str) -> str:
    return f"{name} AS (SELECT * EXCLUDE (k, video, method), v AS video, m AS method FROM (SELECT *, {_BARE} AS v, {_TRIM} AS m, row_number() OVER (PARTITION BY {_BARE}, {_TRIM} ORDER BY loaded_at DESC) AS k FROM {t}) WHERE k = 1)"


BENCH = _newest_sql("benchmark_results", "b")
TRUTH = _newest_sql("benchmark_results_copy", "g")
ABLATION = "a AS (SELECT DISTINCT ON (metric_id) * FROM ablation_metrics)"


def _newest(spark: SparkSession, d: str, name: str = "benchmark_results") -> DataFrame:
    t = table(spark, d, name)
    video = F.regexp_replace(F.regexp_replace("video", r"^.*[/\\]", ""), r"\.mp4$", "")
    t = t.withColumns({"video": video, "method": F.lower(F.regexp_replace("method", r"(?U)^\s+|\s+$", ""))})
    return latest_per_key(t, ["video", "method"], "loaded_at")


def _ablation(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row a metric; repeated rows are equal."""
    t = table(spark, d, "ablation_metrics").select("metric_id", *columns)
    return t.groupBy("metric_id").agg(F.max(F.struct(*[c.split(".")[-1] for c in columns])).alias("r")).select("metric_id", "r.*")


_CHECKS = ("brand_match", "promo_detected", "cta_detected", "topic_match")


@query(f"WITH {BENCH} " + " UNION ALL ".join(f"SELECT method, '{m}' AS mode, count(*) AS n, count({m}_error) AS errors, " + ", ".join(f"count_if({m}_{c}) AS {c}_true, count({m}_{c}) AS {c}_total" for c in _CHECKS) + f", round(sum(CASE WHEN {m}_error IS NULL THEN {m}_effectiveness END) / nullif(count(*) - count({m}_error), 0), 6) AS effectiveness FROM b GROUP BY method" for m in ("bare", "full")))
def d7_method_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Checks passed and made by method and mode; nulls are in neither. One aggregation for both modes."""
    b = _newest(spark, d)
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(f"{m}_error").alias("error"), F.col(f"{m}_effectiveness").alias("eff"), *[F.col(f"{m}_{c}").alias(c) for c in _CHECKS]) for m in ("bare", "full")])
    u = b.select("method", F.inline(modes))
    counts = [x for c in _CHECKS for x in (F.count_if(F.col(c)).alias(f"{c}_true"), F.count(c).alias(f"{c}_total"))]
    eff = F.sum(F.when(F.col("error").isNull(), F.col("eff"))) / F.nullif(F.count("*") - F.count("error"), F.lit(0))
    return u.groupBy("method", "mode").agg(F.count("*").alias("n"), F.count("error").alias("errors"), *counts, F.round(eff, 6).alias("effectiveness"))


@query(f"WITH {BENCH} SELECT method, round(coalesce(avg(CASE WHEN compression_ratio <> 0 THEN 1 - 1 / compression_ratio END), 0), 9) AS reduction, round(coalesce(avg(latency_s), 0), 9) AS latency, round(coalesce(avg(full_effectiveness), 0), 9) AS effectiveness, round(coalesce(avg(vlm_cost_usd), 0), 9) AS cost FROM b GROUP BY method")
def d8_method_averages(spark: SparkSession, d: str) -> DataFrame:
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 9)
    r = F.when(F.col("compression_ratio") != 0, 1 - 1 / F.col("compression_ratio"))
    return _newest(spark, d).groupBy("method").agg(mean(r).alias("reduction"), mean("latency_s").alias("latency"), mean("full_effectiveness").alias("effectiveness"), mean("vlm_cost_usd").alias("cost"))


@query(f"WITH {ABLATION} SELECT coalesce(lower(extraction_data.visual_elements.text_density), 'unknown') AS kind, count(*) AS n, round(avg(nullif(extraction_data.engagement_metrics.effectiveness_score, 0)), 9) AS effectiveness FROM a GROUP BY 1")
def d9_d15_value_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by kind with a default; scores that are 0 or null don't count."""
    a = _ablation(spark, d, "extraction_data.visual_elements.text_density", "extraction_data.engagement_metrics.effectiveness_score")
    return a.groupBy(F.coalesce(F.lower("text_density"), F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"), F.round(F.avg(F.nullif("effectiveness_score", F.lit(0))), 9).alias("effectiveness"))


@query(f"WITH {ABLATION}, m AS (SELECT video, method, avg(total_time_s) AS t, sum(num_frames) AS n FROM a GROUP BY ALL) SELECT x.video, round(x.t, 9) AS time_a, round(y.t, 9) AS time_b, round(y.t - x.t, 9) AS delta, round(x.n / y.n::DOUBLE, 9) AS frames_ratio FROM m x JOIN m y USING (video) WHERE x.method = 'uniform_1.0fps' AND y.method = 'scene_midpoint'")
def c15_d10_head_to_head(spark: SparkSession, d: str) -> DataFrame:
    """Two methods on the videos both have."""
    m = _ablation(spark, d, "video", "method", "total_time_s", "num_frames").groupBy("video", "method").agg(F.avg("total_time_s").alias("t"), F.sum("num_frames").alias("n"))
    side = lambda n, x: m.where(F.col("method") == n).select("video", F.col("t").alias(f"t{x}"), F.col("n").alias(f"n{x}"))
    r = lambda c: F.round(c, 9)
    j = side("uniform_1.0fps", 1).join(side("scene_midpoint", 2), "video")
    return j.select("video", r(F.col("t1")).alias("time_a"), r(F.col("t2")).alias("time_b"), r(F.col("t2") - F.col("t1")).alias("delta"), r(F.col("n1") / F.col("n2")).alias("frames_ratio"))


@query(f"WITH {BENCH}, {TRUTH} SELECT b.method, count(g.full_topic_match) AS n_truth, count_if(b.full_topic_match = g.full_topic_match) AS correct, round(avg(CASE WHEN g.bare_effectiveness IS NOT NULL AND g.full_effectiveness IS NOT NULL THEN abs(coalesce(b.full_effectiveness, 0) - g.full_effectiveness) END), 9) AS mae, round(avg(CASE WHEN b.full_effectiveness IS NOT NULL AND g.full_effectiveness IS NOT NULL THEN pow(b.full_effectiveness - g.full_effectiveness, 2) END), 9) AS mse FROM b LEFT JOIN g USING (video, method) GROUP BY b.method")
def c12_c13_d11_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Predictions against a truth: a missing truth doesn't count, a missing prediction is wrong or 0."""
    b, g = _newest(spark, d).alias("b"), _newest(spark, d, "benchmark_results_copy").alias("g")
    j = b.join(g, ["video", "method"], "left")
    p, t = F.col("b.full_effectiveness"), F.col("g.full_effectiveness")
    both = F.col("g.bare_effectiveness").isNotNull() & t.isNotNull()
    return j.groupBy("method").agg(
        F.count("g.full_topic_match").alias("n_truth"), F.count_if(F.col("b.full_topic_match") == F.col("g.full_topic_match")).alias("correct"),
        F.round(F.avg(F.when(both, F.abs(F.coalesce(p, F.lit(0.0)) - t))), 9).alias("mae"), F.round(F.avg(F.when(p.isNotNull() & t.isNotNull(), F.pow(p - t, 2))), 9).alias("mse"),
    )


@query(f"WITH {ABLATION} SELECT method, round(avg(total_time_s), 9) AS avg_time, max(total_time_s) AS most_time, min(total_time_s) AS least_time, round(sum(num_frames / nullif(1 - compression_ratio, 0)) / sum(num_frames), 6) AS frames_ratio FROM a WHERE num_frames > 0 GROUP BY method")
def d10_compare_report(spark: SparkSession, d: str) -> DataFrame:
    """Times of each method, and frames before to frames after as a ratio of sums, not a mean of ratios."""
    a = _ablation(spark, d, "method", "total_time_s", "num_frames", "compression_ratio").where("num_frames > 0")
    before = F.col("num_frames") / F.nullif(1 - F.col("compression_ratio"), F.lit(0.0))
    t = F.col("total_time_s")
    return a.groupBy("method").agg(F.round(F.avg(t), 9).alias("avg_time"), F.max(t).alias("most_time"), F.min(t).alias("least_time"), F.round(F.sum(before) / F.sum("num_frames"), 6).alias("frames_ratio"))


@query(f"""WITH {ABLATION}, g AS (SELECT video, min(extraction_data.sentiment.primary_sentiment_id) AS sentiment, min(extraction_data.engagement_metrics.is_funny) AS funny, min(extraction_data.engagement_metrics.is_exciting) AS exciting, min(extraction_data.engagement_metrics.effectiveness_score) AS effective FROM a WHERE method = 'scene_midpoint' GROUP BY 1)
    SELECT a.method, count(*) AS n, count(g.sentiment) AS valid, count_if(coalesce(a.extraction_data.sentiment.primary_sentiment_id, -1)::VARCHAR = g.sentiment::VARCHAR) AS correct,
      count_if(g.funny IS NOT NULL AND g.exciting IS NOT NULL AND g.effective IS NOT NULL) AS scored, round(avg(CASE WHEN g.funny IS NOT NULL AND g.exciting IS NOT NULL AND g.effective IS NOT NULL THEN abs(coalesce(a.extraction_data.engagement_metrics.is_funny, 0.0) - g.funny) END), 9) AS funny_mae,
      round(avg(CASE WHEN g.funny IS NOT NULL AND g.exciting IS NOT NULL AND g.effective IS NOT NULL THEN abs(coalesce(a.extraction_data.engagement_metrics.is_exciting, 0.0) - g.exciting) END), 9) AS exciting_mae, round(avg(CASE WHEN g.funny IS NOT NULL AND g.exciting IS NOT NULL AND g.effective IS NOT NULL THEN abs(coalesce(a.extraction_data.engagement_metrics.effectiveness_score, 0) - g.effective)::DOUBLE END), 9) AS effective_mae
    FROM a LEFT JOIN g USING (video) WHERE a.method <> 'scene_midpoint' GROUP BY a.method""")
def d11_truth_errors(spark: SparkSession, d: str) -> DataFrame:
    """Numbers compared as texts, a missing prediction being -1; errors where all three truths are there, a missing score
    being 0. One method's records stand in for the truth."""
    cols = {"sentiment": "sentiment.primary_sentiment_id", "funny": "engagement_metrics.is_funny", "exciting": "engagement_metrics.is_exciting", "effective": "engagement_metrics.effectiveness_score"}
    t = table(spark, d, "ablation_metrics").select("metric_id", "video", "method", *[F.col(f"extraction_data.{p}").alias(n) for n, p in cols.items()])
    t = t.groupBy("metric_id").agg(F.max(F.struct("video", "method", *cols)).alias("r")).select("r.*")
    g = t.where("method = 'scene_midpoint'").groupBy("video").agg(*[F.min(n).alias(f"g_{n}") for n in cols])
    j = t.where("method <> 'scene_midpoint'").join(g, "video", "left")
    all_three = F.col("g_funny").isNotNull() & F.col("g_exciting").isNotNull() & F.col("g_effective").isNotNull()
    mae = lambda n: F.round(F.avg(F.when(all_three, F.abs(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) - F.col(f"g_{n}")))), 9).alias(f"{n}_mae")
    same = F.coalesce("sentiment", F.lit(-1)).cast("string") == F.col("g_sentiment").cast("string")
    return j.groupBy("method").agg(F.count("*").alias("n"), F.count("g_sentiment").alias("valid"), F.count_if(same).alias("correct"), F.count_if(all_three).alias("scored"), mae("funny"), mae("exciting"), mae("effective"))


_CONFUSION = f"WITH {BENCH}, {TRUTH}, j AS (SELECT g.full_cta_detected::VARCHAR AS t, b.full_cta_detected::VARCHAR AS p, count(*) AS n FROM b JOIN g USING (video, method) WHERE b.full_cta_detected IS NOT NULL AND g.full_cta_detected IS NOT NULL GROUP BY ALL)"


def _confusion(spark: SparkSession, d: str) -> DataFrame:
    b = _newest(spark, d).select("video", "method", F.col("full_cta_detected").cast("string").alias("p"))
    g = _newest(spark, d, "benchmark_results_copy").select("video", "method", F.col("full_cta_detected").cast("string").alias("t"))
    return b.join(g, ["video", "method"]).where("p IS NOT NULL AND t IS NOT NULL").groupBy("t", "p").agg(F.count("*").alias("n"))


@query(f"{_CONFUSION} SELECT t AS truth, p AS predicted, n FROM j")
def d12_confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _confusion(spark, d).select(F.col("t").alias("truth"), F.col("p").alias("predicted"), "n")


@query(f"""{_CONFUSION}, k AS (SELECT t AS label, sum(n)::DOUBLE AS support, sum(CASE WHEN p = t THEN n ELSE 0 END)::DOUBLE AS tp, (SELECT sum(n)::DOUBLE FROM j x WHERE x.p = j.t) AS predicted FROM j GROUP BY t),
    l AS (SELECT label, support, coalesce(tp / predicted, 0) AS precision, tp / support AS recall, 2.0::DOUBLE * tp / (coalesce(predicted, 0) + support) AS f1 FROM k)
    SELECT label, support::BIGINT AS support, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM l UNION ALL SELECT 'macro avg', sum(support)::BIGINT, round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9) FROM l
    UNION ALL SELECT 'weighted avg', sum(support)::BIGINT, round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9) FROM l""")
def d12_classification_report(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of each class, their means, and their means by support, from one confusion table."""
    sides = _confusion(spark, d).select(F.inline(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("s"), F.when(F.col("p") == F.col("t"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("q")), F.struct(F.col("p").alias("label"), F.lit(0).alias("s"), F.lit(0).alias("tp"), F.col("n").alias("q")))))
    k = sides.groupBy("label").agg(F.sum("s").alias("support"), F.sum("tp").alias("tp"), F.sum("q").alias("q")).where("support > 0")
    k = k.select("label", "support", F.coalesce(F.col("tp") / F.nullif("q", F.lit(0)), F.lit(0.0)).alias("precision"), (F.col("tp") / F.col("support")).alias("recall"), (F.lit(2.0) * F.col("tp") / (F.col("q") + F.col("support"))).alias("f1"))
    marks = ("precision", "recall", "f1")
    whole = k.agg(F.sum("support").alias("support"), *[F.avg(m).alias(f"m_{m}") for m in marks], *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"w_{m}") for m in marks])
    means = whole.select(F.inline(F.array(*[F.struct(F.lit(n).alias("label"), "support", *[F.col(f"{x}_{m}").alias(m) for m in marks]) for n, x in (("macro avg", "m"), ("weighted avg", "w"))])))
    return k.unionByName(means).select("label", "support", *[F.round(m, 9).alias(m) for m in marks])


_NUM = ("compression_ratio", "latency_s", "info_density", "vlm_cost_usd")


@query(f"WITH {BENCH} " + " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, round(corr({x}, {y}), 6) AS r FROM b" for x in _NUM for y in _NUM if x < y))
def d13_correlations(spark: SparkSession, d: str) -> DataFrame:
    b = _newest(spark, d)
    pairs = [(x, y) for x in _NUM for y in _NUM if x < y]
    one = b.agg(*[F.round(F.corr(x, y), 6).alias(f"r{i}") for i, (x, y) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"r{i}").alias("r")) for i, (x, y) in enumerate(pairs)])))


@query(f"WITH {ABLATION} SELECT method, count(*) AS n, round(avg(num_frames), 9) AS frames, round(avg(compression_ratio), 9) AS compression, round(avg(sampling_time_s), 9) AS sampling, round(avg(sampling_time_s + num_frames * 2.0::DOUBLE), 9) AS latency_model FROM a WHERE extraction_error IS NULL GROUP BY method")
def d14_d16_ablation_summary(spark: SparkSession, d: str) -> DataFrame:
    """Means by method without failed rows, and modelled latency of two seconds a frame."""
    a = _ablation(spark, d, "method", "num_frames", "compression_ratio", "sampling_time_s", "extraction_error").where("extraction_error IS NULL")
    r = lambda c: F.round(F.avg(c), 9)
    return a.groupBy("method").agg(F.count("*").alias("n"), r("num_frames").alias("frames"), r("compression_ratio").alias("compression"), r("sampling_time_s").alias("sampling"), r(F.col("sampling_time_s") + F.col("num_frames") * F.lit(2.0)).alias("latency_model"))


@query(f"WITH {ABLATION} SELECT count(*) AS n, count_if(extraction_success) AS succeeded, round(1 - sum(num_frames) / sum(num_frames / nullif(1 - compression_ratio, 0)), 6) AS reduction, round(sum(total_time_s) / count(*), 6) AS seconds_each FROM a")
def d17_batch_summary(spark: SparkSession, d: str) -> DataFrame:
    a = _ablation(spark, d, "extraction_success", "num_frames", "compression_ratio", "total_time_s")
    before = F.col("num_frames") / F.nullif(1 - F.col("compression_ratio"), F.lit(0.0))
    return a.agg(F.count("*").alias("n"), F.count_if("extraction_success").alias("succeeded"), F.round(1 - F.sum("num_frames") / F.sum(before), 6).alias("reduction"), F.round(F.sum("total_time_s") / F.count("*"), 6).alias("seconds_each"))


@query(f"WITH {ABLATION} SELECT metric_id, round(CASE WHEN total_time_s > 0 THEN sampling_time_s / total_time_s * 100 ELSE 0 END, 6) AS sampling_percent, round(CASE WHEN total_time_s > 0 THEN extraction_time_s / total_time_s * 100 ELSE 0 END, 6) AS extraction_percent FROM a")
def d20_stage_percent(spark: SparkSession, d: str) -> DataFrame:
    a = _ablation(spark, d, "sampling_time_s", "extraction_time_s", "total_time_s")
    p = lambda c: F.round(F.when(F.col("total_time_s") > 0, F.col(c) / F.col("total_time_s") * 100).otherwise(0.0), 6)
    return a.select("metric_id", p("sampling_time_s").alias("sampling_percent"), p("extraction_time_s").alias("extraction_percent"))


def leaves(kind: T.DataType, at: str) -> list[tuple[str, T.DataType]]:
    """Leaf columns of a struct; lists are leaves, members that begin with ``_`` are left out."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields if not f.name.startswith("_") for x in leaves(f.dataType, f"{at}.{f.name}")]
    return [(at, kind)]


_LEAVES = {
    "brand": ["brand_name_text", "logo_visible", "logo_timestamps", "brand_text_contrast"], "product": ["product_name", "industry"], "promotion": ["promo_present", "promo_text", "promo_deadline", "price_value"],
    "call_to_action": ["cta_present", "cta_type"], "message": ["primary_message", "tagline"], "visual_elements": ["text_density", "dominant_colors", "text_overlays"], "target_audience": ["age_group", "interests"],
    "sentiment": ["primary_sentiment_id", "secondary_sentiments", "sentiment_intensity"], "engagement_metrics": ["is_funny", "is_exciting", "effectiveness_score"], "demo_details": ["features_demonstrated", "demo_steps"],
}
_PATHS = [f"extraction_data.{g}.{f}" for g, fs in _LEAVES.items() for f in fs] + ["extraction_data.persuasion_techniques"]
_FILLED = " + ".join(f"coalesce(({p} IS NOT NULL AND {p}::VARCHAR NOT IN ('', '[]'))::INT, 0)" for p in _PATHS)


@query(f"WITH {ABLATION}, k AS (SELECT metric_id, num_frames, extraction_data IS NULL AS failed, {len(_PATHS)} AS total, {_FILLED} AS filled FROM a) SELECT metric_id, filled::INT AS filled, round(CASE WHEN failed THEN 0 ELSE least(1.0, 0.5 * filled / total + CASE WHEN num_frames >= 5 THEN 0.25 WHEN num_frames >= 3 THEN 0.15 WHEN num_frames >= 1 THEN 0.05 ELSE 0 END) END::DOUBLE, 6) AS confidence FROM k")
def e24_d19_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Filled leaves of the nested record, from its schema, and the confidence they give."""
    a = _ablation(spark, d, "num_frames", "extraction_data")
    own = leaves(a.schema["extraction_data"].dataType, "extraction_data")
    full = lambda p, k: F.col(p).isNotNull() & (F.size(p) > 0 if isinstance(k, T.ArrayType) else F.col(p) != "" if isinstance(k, T.StringType) else F.lit(True))
    filled = reduce(lambda x, y: x + y, [F.when(full(p, k), 1).otherwise(0) for p, k in own])
    a = a.withColumns({"filled": filled, "failed": F.col("extraction_data").isNull()})
    c = X.confidence(F.lit(len(own)), F.col("filled"), [], F.col("num_frames"), F.col("failed"))
    return a.select("metric_id", "filled", F.round(c, 6).alias("confidence"))


_SENT = ", ".join(f"({i}, '{n}')" for i, n in enumerate(taxonomy.SENTIMENTS, 1))


@query(f"WITH {ABLATION}, s(id, sentiment) AS (VALUES {_SENT}) SELECT metric_id, coalesce(s.sentiment, 'unknown') AS sentiment FROM a LEFT JOIN s ON s.id = extraction_data.sentiment.primary_sentiment_id")
def c19_taxonomy_lookup(spark: SparkSession, d: str) -> DataFrame:
    a = _ablation(spark, d, "extraction_data.sentiment.primary_sentiment_id")
    names = taxonomy.names(spark, taxonomy.SENTIMENTS, "sentiment")  # 30 rows
    j = a.join(F.broadcast(names), a["primary_sentiment_id"] == names["id"], "left")
    return j.select("metric_id", F.coalesce("sentiment", F.lit("unknown")).alias("sentiment"))


@query(f"WITH {BENCH}, r AS (SELECT video, max(CASE WHEN method = 'hib_pipeline' THEN selected_count END) AS k, max(compression_ratio) AS dur FROM b GROUP BY video) SELECT b.video, b.method, coalesce(nullif(r.k, 0), greatest(1, floor(r.dur)))::BIGINT AS k FROM b LEFT JOIN r USING (video)")
def c14_reference_count(spark: SparkSession, d: str) -> DataFrame:
    """Each baseline's number of frames from the reference method, else from the duration."""
    b = _newest(spark, d).select("video", "method", "selected_count", "compression_ratio")
    r = b.groupBy("video").agg(F.max(F.when(F.col("method") == "hib_pipeline", F.col("selected_count"))).alias("k"), F.max("compression_ratio").alias("dur"))
    return b.join(r, "video", "left").select("video", "method", F.coalesce(F.nullif("k", F.lit(0)), F.greatest(F.lit(1), F.floor("dur"))).cast("bigint").alias("k"))


@query("SELECT DISTINCT d.video_id FROM documents d WHERE d.video_id IS NOT NULL AND d.video_id NOT IN (SELECT video FROM ablation_metrics WHERE extraction_success AND video IS NOT NULL) AND d.video_id NOT IN (SELECT video FROM ablation_metrics WHERE NOT extraction_success AND video IS NOT NULL)")
def c16_c17_u5_pending(spark: SparkSession, d: str) -> DataFrame:
    """All minus processed minus failed, by two anti-joins."""
    a = table(spark, d, "ablation_metrics")
    done = lambda ok: a.where(F.col("extraction_success") == ok).select(F.col("video").alias("video_id"))
    return table(spark, d, "documents").select("video_id").where("video_id IS NOT NULL").distinct().join(done(True), "video_id", "left_anti").join(done(False), "video_id", "left_anti")


@query(f"WITH {BENCH} SELECT 'u1' AS op, count(*) AS n FROM (SELECT video FROM b WHERE method = 'orb' UNION ALL SELECT video FROM b WHERE method = 'random') UNION ALL SELECT 'u2', count(*) FROM (SELECT video FROM b WHERE method = 'orb' UNION SELECT video FROM b WHERE method = 'random') UNION ALL SELECT 'u3', count(*) FROM (SELECT video FROM b WHERE method = 'orb' INTERSECT SELECT video FROM b WHERE method = 'random') UNION ALL SELECT 'u4', count(*) FROM (SELECT video FROM b WHERE method = 'orb' EXCEPT SELECT video FROM b WHERE method = 'random')")
def u1_u4_set_operations(spark: SparkSession, d: str) -> DataFrame:
    b = _newest(spark, d)
    x, y = (b.where(F.col("method") == m).select("video") for m in ("orb", "random"))
    sets = {"u1": x.unionByName(y), "u2": x.union(y).distinct(), "u3": x.intersect(y), "u4": x.subtract(y)}
    return reduce(DataFrame.unionAll, [s.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, s in sets.items()])


_ID = "regexp_replace(regexp_replace(video, '^.*[/\\\\]', ''), '\\.mp4$', '')"


@query(f"""WITH v AS (SELECT DISTINCT video, {_ID} AS x FROM benchmark_results_copy), k AS (SELECT DISTINCT video_id FROM documents WHERE video_id IS NOT NULL)
    SELECT video, CASE WHEN CASE WHEN length(x) <> 11 THEN regexp_replace(x, '_', '-') ELSE x END IN (SELECT video_id FROM k) THEN CASE WHEN length(x) <> 11 THEN regexp_replace(x, '_', '-') ELSE x END
    WHEN right(x, 11) IN (SELECT video_id FROM k) THEN right(x, 11) WHEN regexp_replace(x, '_', '') IN (SELECT video_id FROM k) THEN regexp_replace(x, '_', '') END AS video_id FROM v""")
def b18_id_chain(spark: SparkSession, d: str) -> DataFrame:
    """Names to known ids: as it is, its last eleven characters, without its first underscore; the first known wins."""
    x = F.regexp_replace(F.regexp_replace("video", r"^.*[/\\]", ""), r"\.mp4$", "")
    v = table(spark, d, "benchmark_results_copy").select("video", x.alias("x")).distinct()
    first_ = lambda to: F.concat(F.substring_index("x", "_", 1), F.when(F.instr("x", "_") > 0, F.lit(to)).otherwise(""), F.expr("substring(x, length(substring_index(x, '_', 1)) + 2)"))
    tries = F.array(F.when(F.length("x") != 11, first_("-")).otherwise(F.col("x")), F.expr("right(x, 11)"), first_(""))
    known = table(spark, d, "documents").select(F.col("video_id").alias("try")).where("try IS NOT NULL").distinct()
    hit = v.select("video", F.posexplode(tries).alias("pos", "try")).join(known, "try").groupBy("video").agg(F.min_by("try", "pos").alias("video_id"))
    return v.select("video").join(hit, "video", "left")


@query(f"WITH {ABLATION} SELECT metric_id, CASE WHEN extraction_data.engagement_metrics.is_funny >= 0.7 THEN 1 WHEN extraction_data.engagement_metrics.is_funny <= 0.3 THEN 0 END AS label FROM a WHERE extraction_data.engagement_metrics.is_funny >= 0.7 OR extraction_data.engagement_metrics.is_funny <= 0.3")
def b19_unambiguous(spark: SparkSession, d: str) -> DataFrame:
    """Scores as two classes; those between, which are neither, are left out."""
    a = _ablation(spark, d, "extraction_data.engagement_metrics.is_funny").where("is_funny IS NOT NULL")
    return a.select("metric_id", X.binary_label(F.col("is_funny")).alias("label")).where("label <> -1")


@query(f"WITH {BENCH} SELECT video, method, coalesce(bare_error, full_error) AS error, CASE " + " ".join(f"WHEN contains(coalesce(bare_error, full_error), '{c}') THEN '{c}'" for c in X.ERROR_CODES) + " END AS code FROM b WHERE bare_error IS NOT NULL OR full_error IS NOT NULL")
def b16_b17_a20_error_audit(spark: SparkSession, d: str) -> DataFrame:
    """The rows that failed, for the audit table, with the code their message holds."""
    b = _newest(spark, d).where("bare_error IS NOT NULL OR full_error IS NOT NULL")
    e = F.coalesce("bare_error", "full_error")
    return b.select("video", "method", e.alias("error"), X.error_code(e).alias("code"))


_KEYS = "[" + ", ".join(f"'{k}'" for k in taxonomy.KEYWORDS) + "]"


@query(f"SELECT doc_id, list_filter({_KEYS}, lambda k: contains(lower(text), k))[1] AS keyword FROM documents WHERE text IS NOT NULL")
def c6_key_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The first keyword of the list that stands anywhere in the text."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.first_keyword(F.col("text"), taxonomy.KEYWORDS).alias("keyword"))


@query("""SELECT DISTINCT metric_id, contains(lower(trim(y)), lower(trim(x))) OR contains(lower(trim(x)), lower(trim(y))) AS matches
    FROM (SELECT metric_id, extraction_data.brand.brand_name_text AS x, extraction_data.product.product_name AS y FROM ablation_metrics)""")
def f_names_match(spark: SparkSession, d: str) -> DataFrame:
    """Whether either of two names holds the other; three-valued."""
    a = table(spark, d, "ablation_metrics").select("metric_id", F.col("extraction_data.brand.brand_name_text").alias("x"), F.col("extraction_data.product.product_name").alias("y"))
    return a.select("metric_id", X.names_match(F.col("x"), F.col("y")).alias("matches")).distinct()


@query(f"""{EV}, v AS (SELECT video, max(t) AS dur FROM f GROUP BY 1), g AS (SELECT video, unnest(range(ceil(dur / 12)::BIGINT)) AS i, dur FROM v), n AS (SELECT video, floor(t / 6)::BIGINT AS frame_no, arg_min(frame, (t, frame)) AS frame FROM f GROUP BY ALL)
    SELECT g.video, i * 12 AS at, n.frame FROM g JOIN n ON n.video = g.video AND n.frame_no = floor(i * 12 / 6)::BIGINT WHERE i * 12 < dur""")
def a6_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The frames at sampled times, by frame number: an equi-join; times at which there is none are skipped."""
    f = frames(spark, d)
    g = sample_grid(f.groupBy("video").agg(F.max("t").alias("dur")), "dur", 12_000).select("video", (F.col("sample_no") * 12).cast("bigint").alias("at"))
    n = f.groupBy("video", F.floor(F.col("t") / 6).alias("frame_no")).agg(F.min_by("frame", F.struct("t", "frame")).alias("frame"))
    return g.withColumn("frame_no", F.floor(F.col("at") / 6)).join(n, ["video", "frame_no"]).select("video", "at", "frame")


QUERIES, SQL = query.queries, query.sql
