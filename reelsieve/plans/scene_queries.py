"""Queries over candidates and their scenes: joins by range, selection within scenes and videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelsieve.functions import expr as X
from reelsieve.operators import selection as S
from reelsieve.operators.joins import first_match, range_join
from reelsieve.plans.base import CANDIDATES_SQL, SCENES_SQL, Registry, candidates, scenes
from reelsieve.session import table

query = Registry()
BUCKET = 8.0
_POINTS = "c1 AS (SELECT DISTINCT candidate_id, video_id, ts FROM frame_candidates WHERE video_id IS NOT NULL AND ts IS NOT NULL)"
_ASSIGNED = """hit AS (SELECT candidate_id, min(s.scene_id) AS scene FROM c1 JOIN s ON s.video_id = c1.video_id AND ts >= start_s AND ts < end_s GROUP BY 1),
    far AS (SELECT candidate_id, arg_min(s.scene_id, (least(abs(ts - start_s), abs(ts - end_s)), s.scene_id)) AS scene FROM c1 JOIN s USING (video_id) GROUP BY 1),
    a AS (SELECT c1.candidate_id, c1.video_id, ts, coalesce(hit.scene, far.scene) AS scene FROM c1 LEFT JOIN hit USING (candidate_id) LEFT JOIN far USING (candidate_id))"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "frame_candidates").where("video_id IS NOT NULL AND ts IS NOT NULL").select("candidate_id", "video_id", "ts").distinct()


@query(f"WITH {_POINTS}, {SCENES_SQL}, {_ASSIGNED} SELECT candidate_id, scene FROM a")
def c1_c2_scene_assignment(spark: SparkSession, d: str) -> DataFrame:
    """The first scene that holds the frame, else the nearest by its bounds; none without scenes."""
    s = scenes(spark, d).withColumnRenamed("scene_id", "scene")
    return first_match(_points(spark, d), s, ["video_id"], "candidate_id", "ts", "start_s", "end_s", "scene", BUCKET).select("candidate_id", "scene")


@query(f"WITH {_POINTS}, {SCENES_SQL} SELECT s.video_id, s.scene_id, count(*) AS n_frames, min(ts) AS first_ts, max(ts) AS last_ts FROM c1 JOIN s ON s.video_id = c1.video_id AND ts >= start_s AND ts < end_s GROUP BY ALL")
def c18_frames_per_scene(spark: SparkSession, d: str) -> DataFrame:
    """All scenes a frame lies in; scenes without frames don't appear."""
    j = range_join(_points(spark, d), scenes(spark, d), ["video_id"], "ts", "start_s", "end_s", BUCKET)
    return j.groupBy("video_id", "scene_id").agg(F.count("*").alias("n_frames"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query(f"""WITH {SCENES_SQL}, c1 AS (SELECT DISTINCT candidate_id, video_id, scene_id, ts FROM frame_candidates WHERE video_id IS NOT NULL AND ts IS NOT NULL)
    SELECT candidate_id, s.start_s, round(CASE WHEN s.end_s - s.start_s > 0 THEN CASE WHEN (ts - s.start_s) / (s.end_s - s.start_s) < 0.15 THEN 1.4 WHEN (ts - s.start_s) / (s.end_s - s.start_s) > 0.85 THEN 1.2 ELSE 1.0 END ELSE 1.0 END::DOUBLE, 6) AS scene_factor
    FROM c1 LEFT JOIN s ON s.video_id = c1.video_id AND s.scene_id = c1.scene_id""")
def c7_c8_scene_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The scene's bounds by its number, and the factor of the place within it."""
    c = table(spark, d, "frame_candidates").where("video_id IS NOT NULL AND ts IS NOT NULL").select("candidate_id", "video_id", "scene_id", "ts").distinct()
    j = c.join(scenes(spark, d), ["video_id", "scene_id"], "left")
    return j.select("candidate_id", "start_s", F.round(X.scene_score(F.col("ts"), F.col("start_s"), F.col("end_s")), 6).alias("scene_factor"))


@query(f"WITH {CANDIDATES_SQL}, a AS (SELECT min(importance_score) AS lo, max(importance_score) AS hi, avg(importance_score) AS mean, stddev_pop(importance_score) AS sd, count(*) AS n, video_id FROM c GROUP BY video_id) SELECT video_id, n, lo, hi, round(mean, 9) AS mean, round(sd, 9) AS sd, round(top / mean, 9) AS lift FROM a JOIN (SELECT video_id, avg(importance_score) AS top FROM c WHERE importance_score >= 1.3 GROUP BY video_id) USING (video_id)")
def d4_selection_stats(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all and of the selected rows of a video, and how much higher the latter are."""
    s = F.col("importance_score")
    g = candidates(spark, d, False).groupBy("video_id").agg(F.count("*").alias("n"), F.min(s).alias("lo"), F.max(s).alias("hi"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("sd"), F.avg(F.when(s >= 1.3, s)).alias("top"))
    return g.where("top IS NOT NULL").select("video_id", "n", "lo", "hi", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"), F.round(F.col("top") / F.col("mean"), 9).alias("lift"))


#: Sounds and visual features stand in for detectors', which the tables don't have: sounds around the
#: bounds of some scenes, text and faces on some candidates.
_SCORED = f"""{CANDIDATES_SQL},
    s AS (SELECT video_id, scene_id, min(start_s) AS start_s, max(end_s) AS end_s FROM scenes WHERE start_s IS NOT NULL AND end_s IS NOT NULL GROUP BY ALL),
    hit AS (SELECT candidate_id, min(s.scene_id) AS scene FROM c JOIN s ON s.video_id = c.video_id AND ts >= start_s AND ts < end_s GROUP BY 1),
    far AS (SELECT candidate_id, arg_min(s.scene_id, (least(abs(ts - start_s), abs(ts - end_s)), s.scene_id)) AS scene FROM c JOIN s USING (video_id) GROUP BY 1),
    ve AS (SELECT video_id, min(ts) AS first_ts, max(ts) AS last_ts, arg_min(candidate_id, (ts, candidate_id)) AS first_id, arg_min(candidate_id, (-ts, candidate_id)) AS last_id FROM c GROUP BY 1),
    vs AS (SELECT video_id, max(end_s) AS over, count(*) AS n_scenes FROM s GROUP BY 1),
    w AS (SELECT c.*, coalesce(hit.scene, far.scene) AS sc, greatest(last_ts, over) AS dur, coalesce(n_scenes, 0) AS n_scenes, ts = first_ts OR ts = last_ts AS forced, candidate_id = first_id AS is_first, candidate_id = last_id AS is_last,
        list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM c LEFT JOIN hit USING (candidate_id) LEFT JOIN far USING (candidate_id) JOIN ve ON ve.video_id = c.video_id LEFT JOIN vs ON vs.video_id = c.video_id),
    im AS (SELECT candidate_id, w.video_id, coalesce(sc, 0) AS scene, ts, e, u, dur, n_scenes, forced, importance_score
        * (CASE WHEN dur <= 0 THEN 1.0 WHEN ts / dur < 0.1 THEN 1.5 WHEN ts / dur > 0.9 THEN 1.4 WHEN ts / dur > 0.4 AND ts / dur < 0.6 THEN 1.1 ELSE 1.0 END::DOUBLE
        * CASE WHEN s.end_s - s.start_s > 0 THEN CASE WHEN (ts - s.start_s) / (s.end_s - s.start_s) < 0.15 THEN 1.4 WHEN (ts - s.start_s) / (s.end_s - s.start_s) > 0.85 THEN 1.2 ELSE 1.0 END ELSE 1.0 END::DOUBLE
        * (CASE WHEN candidate_id % 3 = 0 THEN 1.3 ELSE 1.0 END::DOUBLE * CASE WHEN candidate_id % 5 = 0 THEN 1.2 ELSE 1.0 END::DOUBLE)
        * (CASE WHEN EXISTS (FROM s x WHERE x.video_id = w.video_id AND x.scene_id % 4 = 0 AND abs(w.ts - x.start_s) < 0.5) THEN 1.3 ELSE 1.0 END::DOUBLE
         * CASE WHEN EXISTS (FROM s x WHERE x.video_id = w.video_id AND x.scene_id % 3 = 0 AND w.ts >= x.start_s AND w.ts < x.start_s + 0.5) THEN 1.4 ELSE 1.0 END::DOUBLE
         * coalesce((SELECT arg_min(CASE WHEN abs(w.ts - (x.start_s + 0.2)) < 0.5 THEN 1.2 ELSE 1.15 END::DOUBLE, x.scene_id) FROM s x WHERE x.video_id = w.video_id AND x.scene_id % 2 = 0 AND (abs(w.ts - (x.start_s + 0.2)) < 0.5 OR abs(w.ts - x.end_s) < 0.5)), 1.0)
         * CASE WHEN EXISTS (FROM s x WHERE x.video_id = w.video_id AND x.scene_id % 5 = 0 AND abs(w.ts - CASE WHEN x.scene_id % 10 <> 0 THEN (x.start_s + x.end_s) / 2 ELSE x.start_s END) < 0.5) THEN 1.5 ELSE 1.0 END::DOUBLE))
        * (CASE WHEN is_first THEN 2.0 ELSE 1.0 END::DOUBLE * CASE WHEN is_last THEN 1.8 ELSE 1.0 END::DOUBLE) AS imp
        FROM w LEFT JOIN s ON s.video_id = w.video_id AND s.scene_id = w.sc)"""
_ALLOCATED = f"""{_SCORED},
    g0 AS (SELECT *, row_number() OVER (PARTITION BY video_id, scene ORDER BY ts, candidate_id) - 1 AS i, count(*) OVER (PARTITION BY video_id, scene) AS cnt FROM im),
    g1 AS (SELECT *, lag(u) OVER (PARTITION BY video_id, scene ORDER BY ts, candidate_id) AS p FROM g0 WHERE cnt <= 10 OR i % greatest(1, cnt // 10) = 0),
    g2 AS (SELECT video_id, scene, avg(list_sum(list_transform(range(1, 65), lambda k: abs(u[k] - p[k]))) / 64) AS variance FROM g1 WHERE p IS NOT NULL GROUP BY ALL),
    g3 AS (SELECT video_id, scene, count(*) AS cnt, greatest(max(ts) - min(ts), 0.1) AS span, max(imp) AS top FROM im GROUP BY ALL),
    g4 AS (SELECT video_id, scene, cnt, greatest(2, least(greatest(1, floor(span * CASE WHEN cnt < 2 THEN 0.25::DOUBLE ELSE 0.25::DOUBLE * CASE WHEN coalesce(variance, 0) > 0.15 THEN 1.3 WHEN coalesce(variance, 0) < 0.05 THEN 0.7 ELSE 1.0 END::DOUBLE * CASE WHEN top > 1.5 THEN 1.2 ELSE 1.0 END::DOUBLE END)), 10, cnt)) AS n FROM g3 LEFT JOIN g2 USING (video_id, scene)),
    fo AS (SELECT video_id, scene, list(e) AS ends FROM im WHERE forced GROUP BY ALL),
    al AS (SELECT im.*, n, cnt <= n AS whole, row_number() OVER (PARTITION BY im.video_id, im.scene ORDER BY NOT forced, imp + CASE WHEN ends IS NULL OR forced THEN 0 ELSE 0.1::DOUBLE * (1 - least(1.0::DOUBLE, list_min(list_transform(ends, lambda y: list_cosine_similarity(e, y))))) END DESC, ts, candidate_id) AS rn
        FROM im JOIN g4 USING (video_id, scene) LEFT JOIN fo USING (video_id, scene))"""
_KEPT = f"""{_ALLOCATED},
    r AS (SELECT video_id, scene, candidate_id, ts, imp, rn, [{{'t': ts, 'e': e}}] AS ks, true AS kept FROM al WHERE rn = 1 UNION ALL
    SELECT al.video_id, al.scene, al.candidate_id, al.ts, al.imp, al.rn, CASE WHEN z THEN list_append(r.ks, {{'t': al.ts, 'e': al.e}}) ELSE r.ks END, z
    FROM r JOIN al ON al.video_id = r.video_id AND al.scene = r.scene AND al.rn = r.rn + 1,
    LATERAL (SELECT al.forced OR al.whole OR (len(r.ks) < al.n AND len(list_filter(r.ks, lambda k: abs(k.t - al.ts) < 0.5 OR list_cosine_similarity(k.e, al.e) > 0.88::DOUBLE * (1 + 0.3::DOUBLE * (1 - exp(-abs(k.t - al.ts) / 5))))) = 0) AS z)),
    one AS (SELECT video_id, ts, arg_min(candidate_id, (scene, candidate_id)) AS candidate_id, arg_min(imp, (scene, candidate_id)) AS imp FROM r WHERE kept GROUP BY ALL)"""
_BUDGET = f"""{_KEPT},
    st AS (SELECT video_id, dur, n_scenes, imp, u, lag(u) OVER (PARTITION BY video_id ORDER BY ts, candidate_id) AS p FROM im),
    b0 AS (SELECT video_id, any_value(dur) AS dur, greatest(5, greatest(any_value(n_scenes), 1) + 1) AS base, avg(imp) AS ep, count(*) AS m, avg(sqrt(list_sum(list_transform(range(1, 65), lambda k: (u[k] - p[k]) * (u[k] - p[k]))))) FILTER (WHERE p IS NOT NULL) AS step FROM st GROUP BY 1),
    b AS (SELECT video_id, dur, least(floor(base + 1.5::DOUBLE * CASE WHEN m > 2 THEN greatest(1, m // 5) ELSE 1 END), greatest(base, floor(base + dur * 0.25::DOUBLE * CASE WHEN step IS NULL THEN 1.0 ELSE greatest(0.2, 2.5::DOUBLE * step) END::DOUBLE * ep))) AS budget, least(greatest(5, floor(dur * 0.25::DOUBLE)), 25) AS static_budget FROM b0),
    q AS (SELECT one.*, budget, static_budget, row_number() OVER (PARTITION BY one.video_id ORDER BY imp DESC, ts, candidate_id) AS k FROM one JOIN b USING (video_id))"""


def sounds(spark: SparkSession, d: str) -> DataFrame:
    """The sounds that stand in for a detector's: video_id, kind, start, end, ord."""
    s = S.video_scenes(scenes(spark, d))
    start, end, i = F.col("start_s"), F.col("end_s"), F.col("scene_id")
    null = F.lit(None).cast("double")
    one = lambda kind, by, a, b: F.when(i % by == 0, F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"), i.alias("ord")))
    kinds = F.array_compact(F.array(one("peak", 4, start, null), one("silence", 3, start - 1, start), one("speech", 2, start + 0.2, end), one("phrase", 5, start, F.when(i % 10 != 0, (start + end) / 2))))
    return s.select("video_id", F.inline(kinds))


def features() -> Column:
    """The factor of the visual features that stand in for a detector's."""
    i = F.col("candidate_id")
    return X.visual_score(i % 3 == 0, i % 5 == 0, F.lit(False))


def _chain(spark: SparkSession, d: str, **options) -> DataFrame:
    c = candidates(spark, d).drop("scene_id")
    return S.select_frames(c, scenes(spark, d), sounds(spark, d), features(), **options)


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """Scored frames with their scene's allocation and their vectors."""
    c = candidates(spark, d).drop("scene_id")
    v = c.select("candidate_id", F.col("embedding").alias("v"))
    rows = S.scored(c.drop("embedding"), scenes(spark, d), sounds(spark, d), features())
    return S.with_vectors(S.allocated(rows, v), v)


@query(f"WITH {_SCORED} SELECT candidate_id, scene, round(imp + 1e-9, 6) AS importance FROM im")
def e8_c3_c6_frame_importance(spark: SparkSession, d: str) -> DataFrame:
    """Importance of every candidate from place, scene, sound and visual features, with the ends' boost."""
    rows = S.scored(candidates(spark, d, False).drop("scene_id"), scenes(spark, d), sounds(spark, d), features())
    return rows.select("candidate_id", "scene", F.round(F.col("imp") + 1e-9, 6).alias("importance"))


@query(f"WITH {_ALLOCATED} SELECT DISTINCT video_id, scene, n::BIGINT AS n, whole FROM al")
def e10_e11_adaptive_allocation(spark: SparkSession, d: str) -> DataFrame:
    """What each scene may keep, from its length, change and importance."""
    c = candidates(spark, d).drop("scene_id")
    rows = S.scored(c.drop("embedding"), scenes(spark, d), sounds(spark, d), features())
    return S.allocated(rows, c.select("candidate_id", F.col("embedding").alias("v"))).select("video_id", "scene", "n", "whole").distinct()


@query(f"WITH RECURSIVE {_KEPT} SELECT video_id, scene, candidate_id FROM r WHERE kept")
def e12_suppression_in_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Suppression by time and by a likeness that falls with the distance in time, forced ends first, within each scene."""
    return S.suppressed(_placed(spark, d)).select("video_id", "scene", "candidate_id")


@query(f"""WITH {_ALLOCATED}, m AS (SELECT *, count(*) OVER w AS m, n - (SELECT count(*) FROM al x WHERE x.video_id = al.video_id AND x.scene = al.scene AND x.forced) AS slots, row_number() OVER (w ORDER BY ts, candidate_id) - 1 AS i FROM al WHERE NOT forced AND NOT whole WINDOW w AS (PARTITION BY video_id, scene)),
    h AS (SELECT *, ceil((i + 1) * least(slots, m) / m::DOUBLE) - 1 AS part FROM m WHERE slots > 0),
    u1 AS (SELECT video_id, scene, candidate_id, ts FROM al WHERE forced OR whole UNION ALL SELECT video_id, scene, candidate_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY video_id, scene, part ORDER BY imp DESC, ts, candidate_id) AS k FROM h) WHERE k = 1)
    SELECT video_id, ts, arg_min(candidate_id, (scene, candidate_id)) AS candidate_id FROM u1 GROUP BY ALL""")
def e15_e16_unknown_method(spark: SparkSession, d: str) -> DataFrame:
    """Selection by a method that isn't known: forced ends and the best of even segments of each scene."""
    return S.selected(_placed(spark, d), "transnet").select("video_id", "ts", "candidate_id")


@query(f"WITH RECURSIVE {_BUDGET} SELECT video_id, candidate_id, round(imp + 1e-9, 6) AS importance FROM q WHERE k <= budget")
def e19_fallback_dimension(spark: SparkSession, d: str) -> DataFrame:
    """The whole selection with the dimension's fallback, a fifth of the frames, as where it can't be solved."""
    return _chain(spark, d, budget="fallback").select("video_id", "candidate_id", F.round(F.col("imp") + 1e-9, 6).alias("importance"))


@query()
def e19_select_frames(spark: SparkSession, d: str) -> DataFrame:
    """The whole selection of every video: scenes, importance, ends, suppression, information budget."""
    return _chain(spark, d).select("video_id", "candidate_id", F.round(F.col("imp") + 1e-9, 6).alias("importance"))


@query(f"WITH RECURSIVE {_BUDGET} SELECT video_id, budget::INT AS budget FROM b")
def e17_fallback_budget(spark: SparkSession, d: str) -> DataFrame:
    """The information budget of each video, with the dimension's fallback."""
    c = candidates(spark, d).drop("scene_id")
    rows = S.scored(c.drop("embedding"), scenes(spark, d), sounds(spark, d), features())
    return S.budgets(rows, c.select("candidate_id", F.col("embedding").alias("v")), svd=False).select("video_id", "budget")


@query()
def e17_information_budget(spark: SparkSession, d: str) -> DataFrame:
    """The information budget of each video, and what it is made of."""
    c = candidates(spark, d).drop("scene_id")
    rows = S.scored(c.drop("embedding"), scenes(spark, d), sounds(spark, d), features())
    found = S.budgets(rows, c.select("candidate_id", F.col("embedding").alias("v")))
    return found.select("video_id", "budget", "dimension", F.round("mean_step", 6).alias("mean_step"), F.round("mean_importance", 6).alias("mean_importance"))


_GAP = "round(list_sum(list_transform(range(1, 65), lambda i: (v[i] - y[i]) * (v[i] - y[i]))), 12)"
#: Labels of the rows ``x`` (label, vec_id, v, k): fr (label, vec_id, cluster, far).
_LABELS = f"""r0 AS (SELECT label, 0 AS rank, min(vec_id) AS vec_id, [arg_min(v, vec_id)] AS cs FROM x GROUP BY label UNION ALL
    SELECT label, rank + 1, arg_min(vec_id, (-near, vec_id)), list_append(any_value(cs), arg_min(v, (-near, vec_id))) FROM (SELECT x.label, x.vec_id, x.v, r0.rank, r0.cs, list_min(list_transform(r0.cs, lambda y: round(1 - list_cosine_similarity(x.v, y), 9))) AS near FROM r0 JOIN x ON x.label = r0.label WHERE r0.rank + 1 < x.k)
    WHERE near > 0 GROUP BY label, rank),
    l0 AS (SELECT label, 0 AS turn, arg_max(cs, rank) AS cs FROM r0 GROUP BY label UNION ALL
    SELECT label, turn + 1, list(c ORDER BY cluster) FROM (SELECT label, turn, cluster, list(m ORDER BY pos) AS c FROM (SELECT label, turn, cluster, pos, avg(z) AS m FROM (SELECT label, turn, list_position(d, list_min(d)) AS cluster, unnest(range(1, 65)) AS pos, unnest(v) AS z
      FROM (SELECT l0.label, l0.turn, x.v, list_transform(l0.cs, lambda y: {_GAP}) AS d FROM l0 JOIN x ON x.label = l0.label WHERE l0.turn < 10)) GROUP BY ALL) GROUP BY ALL) GROUP BY label, turn),
    fr AS (SELECT label, vec_id, list_position(d, list_min(d)) AS cluster, sqrt(list_min(d)) AS far FROM (SELECT x.label, x.vec_id, list_transform(l0.cs, lambda y: {_GAP}) AS d FROM l0 JOIN x ON x.label = l0.label WHERE l0.turn = 10))"""
_ONE = "SELECT video_id, arg_min(scene, (scene, candidate_id)) AS scene, arg_min(candidate_id, (scene, candidate_id)) AS candidate_id FROM u1 GROUP BY video_id, ts"


@query(f"""WITH RECURSIVE {_ALLOCATED}, rg AS (SELECT *, count(*) OVER (PARTITION BY video_id, scene) AS m, n - (SELECT count(*) FROM al y WHERE y.video_id = al.video_id AND y.scene = al.scene AND y.forced) AS slots FROM al WHERE NOT forced AND NOT whole),
    x AS (SELECT concat(video_id, '/', scene) AS label, candidate_id AS vec_id, e AS v, least(slots, m)::BIGINT AS k, imp, ts, video_id, scene FROM rg WHERE slots > 0), {_LABELS},
    mx AS (SELECT label, cluster, max(far) AS most FROM fr GROUP BY ALL),
    p1 AS (SELECT video_id, scene, vec_id AS candidate_id, ts, row_number() OVER (PARTITION BY label, cluster ORDER BY round(0.6::DOUBLE * imp + 0.4::DOUBLE * (1 - far / CASE WHEN most > 0 THEN most ELSE 1 END), 9) DESC, ts, vec_id) AS q FROM fr JOIN mx USING (label, cluster) JOIN x USING (label, vec_id)),
    u1 AS (SELECT video_id, scene, candidate_id, ts FROM al WHERE forced OR whole UNION ALL SELECT video_id, scene, candidate_id, ts FROM p1 WHERE q = 1) {_ONE}""")
def e13_e16_kmeans_in_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Selection by k-means within scenes."""
    return S.selected(_placed(spark, d), "kmeans").select("video_id", "scene", "candidate_id")


@query(f"""WITH RECURSIVE {_KEPT}, x AS (SELECT concat(video_id, '/', scene) AS label, candidate_id AS vec_id, e AS v, least(n, count(*) OVER (PARTITION BY video_id, scene))::BIGINT AS k, imp, ts, video_id, scene, forced FROM al WHERE NOT whole), {_LABELS},
    lb AS (SELECT fr.*, x.imp, x.forced, r.kept FROM fr JOIN x USING (label, vec_id) JOIN r ON r.candidate_id = fr.vec_id),
    ms AS (SELECT label, list(b ORDER BY b.s DESC, b.i) AS missing FROM (SELECT label, cluster, arg_max({{'s': imp, 'i': vec_id}}, (imp, -vec_id)) FILTER (WHERE NOT forced) AS b, bool_or(kept) AS have FROM lb GROUP BY ALL) WHERE NOT have AND b IS NOT NULL GROUP BY label),
    pk AS (SELECT label, list({{'s': imp, 'i': vec_id}} ORDER BY imp, vec_id) AS picks FROM lb WHERE kept AND NOT forced GROUP BY label),
    sw AS (SELECT label, CASE WHEN missing IS NULL THEN picks ELSE list_reduce(missing, lambda acc, b: CASE WHEN len(acc) > 0 AND b.s >= 0.7::DOUBLE * acc[1].s THEN list_sort(list_append(acc[2:], b)) ELSE acc END, picks) END AS done FROM pk LEFT JOIN ms USING (label)),
    u0 AS (SELECT candidate_id FROM al WHERE forced OR whole UNION SELECT d.i FROM (SELECT unnest(done) AS d FROM sw)), u1 AS (SELECT video_id, scene, candidate_id, ts FROM al WHERE candidate_id IN (FROM u0)) {_ONE}""")
def e14_e16_hybrid_in_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Selection by suppression with clusters it misses exchanged in, within scenes."""
    return S.selected(_placed(spark, d), "hybrid").select("video_id", "scene", "candidate_id")


@query(f"""WITH RECURSIVE {_KEPT}, f AS (SELECT video_id, count(*) AS final FROM one GROUP BY 1), a AS (SELECT video_id, count(*) AS total FROM im GROUP BY 1)
    SELECT video_id, total, final, round(1 - final / total::DOUBLE, 6) AS reduction_rate, round(total / final::DOUBLE, 2) AS compression, floor((final * 11475 + 50) / 100) / 10000.0::DOUBLE AS cost FROM f JOIN a USING (video_id)""")
def d1_d2_d5_selection_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per video: frames before and after, reduction, compression, cost."""
    q = S.selected(_placed(spark, d)).groupBy("video_id").agg(F.count("*").alias("final"))
    g = candidates(spark, d, False).groupBy("video_id").agg(F.count("*").alias("total")).join(q, "video_id")
    total, final = F.col("total"), F.col("final")
    return g.select("video_id", "total", "final", F.round(X.reduction_rate(total, final), 6).alias("reduction_rate"), F.round(total / final, 2).alias("compression"), (F.floor((final * 11475 + 50) / 100) / F.lit(10000.0)).alias("cost"))


@query(f"WITH RECURSIVE {_BUDGET} SELECT 'hib_pipeline' AS method, video_id, count(*) AS n FROM q WHERE k <= budget GROUP BY ALL UNION ALL SELECT 'static_pipeline', video_id, count(*) FROM q WHERE k <= static_budget GROUP BY ALL")
def e32_variants(spark: SparkSession, d: str) -> DataFrame:
    """Both pipeline variants, each with its own budget: by information (with the dimension's fallback) and static."""
    one = lambda name, budget: _chain(spark, d, budget=budget).groupBy("video_id").agg(F.count("*").alias("n")).select(F.lit(name).alias("method"), "video_id", "n")
    return one("hib_pipeline", "fallback").unionAll(one("static_pipeline", "static"))


@query("WITH c1 AS (SELECT DISTINCT candidate_id, video_id, ts FROM frame_candidates WHERE video_id IS NOT NULL AND ts IS NOT NULL) SELECT video_id, ts, min(candidate_id) AS candidate_id FROM c1 GROUP BY ALL")
def d18_first_at_each_time(spark: SparkSession, d: str) -> DataFrame:
    """Of rows with the same time the first counts: an aggregate, so it combines before the shuffle."""
    return _points(spark, d).groupBy("video_id", "ts").agg(F.min("candidate_id").alias("candidate_id"))


QUERIES, SQL = query.queries, query.sql
