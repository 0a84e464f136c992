"""Change gates, windows, islands, samplers and scores over ordered frames (events of a user)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelsieve.functions import expr as X
from reelsieve.operators import islands
from reelsieve.operators.joins import band_factors
from reelsieve.operators.walk import Apart, BoxesKept, Chain, Changed, Gate, walk
from reelsieve.plans.base import FRAMES_SQL, Registry, frames
from reelsieve.session import table

query = Registry()
def V():  # noqa: N802
    return Window.partitionBy("video").orderBy("t", "frame")


def ALL():  # noqa: N802
    return Window.partitionBy("video")



def _walk(f: DataFrame, state, order=None, **inputs) -> DataFrame:
    """(video, frame) that the state keeps, in order of time or of ``order``."""
    order = order or [F.col("t"), F.col("frame")]
    return walk(f, ["video"], order, state, ["frame"], **inputs).select("video", "frame")


EV = f"WITH {FRAMES_SQL}"
REC = f"WITH RECURSIVE {FRAMES_SQL}"


@query(f"{EV} SELECT video, frame, abs(value - p) AS change, abs(value - p) > 80 AS significant FROM (SELECT *, lag(value) OVER (PARTITION BY video ORDER BY t, frame) AS p FROM f) WHERE p IS NOT NULL")
def w1_b5_significant_change(spark: SparkSession, d: str) -> DataFrame:
    """Change to the frame before (lag 1), significant if strictly above the threshold."""
    f = frames(spark, d).withColumn("p", F.lag("value").over(V())).where("p IS NOT NULL")
    change = F.abs(F.col("value") - F.col("p"))
    return f.select("video", "frame", change.alias("change"), (change > 80).alias("significant"))


@query(f"""{EV}, g AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY video ORDER BY t, frame)) / 255 AS c FROM f),
    h AS (SELECT *, row_number() OVER w AS n, avg(c) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS m, stddev_pop(c) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS s
    FROM g WHERE c IS NOT NULL WINDOW w AS (PARTITION BY video ORDER BY t, frame))
    SELECT video, frame, round(CASE WHEN n < 30 THEN 0.15 ELSE least(0.3, greatest(0.075, m + s)) END, 6) AS threshold FROM h""")
def w2_b7_adaptive_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Threshold from mean and spread of the last 30 changes, the base before that."""
    f = frames(spark, d).withColumn("c", F.abs(F.col("value") - F.lag("value").over(V())) / 255).where("c IS NOT NULL")
    last = V().rowsBetween(-29, 0)
    t = X.adaptive_threshold(F.avg("c").over(last), F.stddev_pop("c").over(last), F.row_number().over(V()))
    return f.select("video", "frame", F.round(t, 6).alias("threshold"))


@query(f"""{REC}, o AS (SELECT *, row_number() OVER w AS rn, lag(value) OVER w AS p FROM f WINDOW w AS (PARTITION BY video ORDER BY t, frame)),
    r AS (SELECT video, frame, rn, t AS last, true AS kept FROM o WHERE rn = 1 UNION ALL
    SELECT o.video, o.frame, o.rn, CASE WHEN o.t - r.last >= 6 AND abs(o.value - o.p) > 20 THEN o.t ELSE r.last END, o.t - r.last >= 6 AND abs(o.value - o.p) > 20 FROM r JOIN o ON o.video = r.video AND o.rn = r.rn + 1)
    SELECT video, frame FROM r WHERE kept""")
def b8_candidate_frames(spark: SparkSession, d: str) -> DataFrame:
    """The first frame, then frames far enough from the last kept one whose change passes the threshold."""
    return _walk(frames(spark, d), lambda: Gate(6.0, 20.0), t=F.col("t"), x=F.col("value"))


@query("SELECT DISTINCT video_id, scene_id, start_s, end_s FROM scenes WHERE end_s - start_s >= 0.5")
def b9_scene_min_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "scenes").where("end_s - start_s >= 0.5").distinct()


@query(f"""{EV}, g AS (SELECT *, CASE WHEN max(t) OVER (PARTITION BY video) > 0 THEN t / max(t) OVER (PARTITION BY video) ELSE 0 END AS q FROM f)
    SELECT video, frame, CASE WHEN q < 0.15 THEN 'OPENING' WHEN q > 0.85 THEN 'CLOSING' WHEN q > 0.4 AND q < 0.6 THEN 'MIDDLE' END AS label FROM g""")
def b10_position_label(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).select("video", "frame", X.position_label(F.col("t"), F.max("t").over(ALL())).alias("label"))


@query(f"{EV} SELECT CASE WHEN value / 560 > 0.15 THEN 'high' WHEN value / 560 > 0.05 THEN 'medium' ELSE 'low' END AS density, count(*) AS n FROM f GROUP BY 1")
def b13_text_density(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).groupBy(X.text_density(F.col("value") / 560).alias("density")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT p_partkey, p_size * 37 AS w, floor(p_retailprice)::BIGINT AS h FROM part)
    SELECT p_partkey, CASE WHEN h > 480 THEN floor(w * (480.0::DOUBLE / h))::BIGINT ELSE w END AS width, least(h, 480) AS height,
    CASE WHEN greatest(w, h) > 512 THEN floor(w * (512.0::DOUBLE / greatest(w, h)))::BIGINT ELSE w END AS width_512, CASE WHEN greatest(w, h) > 512 THEN floor(h * (512.0::DOUBLE / greatest(w, h)))::BIGINT ELSE h END AS height_512 FROM b""")
def b1_resize(spark: SparkSession, d: str) -> DataFrame:
    """Sizes after fitting to a largest height, and to a largest side."""
    b = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 37).cast("bigint").alias("w"), F.floor("p_retailprice").alias("h"))
    side = F.greatest("w", "h")
    fit = lambda c: F.when(side > 512, F.floor(F.col(c) * (F.lit(512.0) / side))).otherwise(F.col(c))
    return b.select("p_partkey", F.when(F.col("h") > 480, F.floor(F.col("w") * (F.lit(480.0) / F.col("h")))).otherwise(F.col("w")).alias("width"), F.least("h", F.lit(480)).cast("bigint").alias("height"), fit("w").alias("width_512"), fit("h").alias("height_512"))


@query("""WITH b AS (SELECT p_partkey, p_size AS w, (p_partkey % 90 + 1)::INT AS h FROM part)
    SELECT p_partkey, w, h FROM b WHERE w * h BETWEEN 100 AND 50000 AND w::DOUBLE / h > 0.1 AND w::DOUBLE / h < 15 AND h > 5""")
def b15_text_regions(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a plausible area and shape."""
    b = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("w"), (F.col("p_partkey") % 90 + 1).cast("int").alias("h"))
    ratio = F.col("w") / F.col("h")
    return b.where((F.col("w") * F.col("h")).between(100, 50000) & (ratio > 0.1) & (ratio < 15) & (F.col("h") > 5))


@query(f"{EV} SELECT video, frame, t - lag(t) OVER (PARTITION BY video ORDER BY t, frame) AS delta FROM f WHERE kind = 'view'")
def w3_time_delta(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).where("kind = 'view'")
    return f.select("video", "frame", (F.col("t") - F.lag("t").over(V())).alias("delta"))


def _runs_sql(inside: str, least: str, keep_last: bool) -> str:
    return f"""{EV}, i AS (SELECT video, t, {inside} AS ok, lead(t) OVER (PARTITION BY video ORDER BY t) AS nx FROM f),
    j AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t) - row_number() OVER (PARTITION BY video, ok ORDER BY t) AS g FROM i),
    k AS (SELECT video, g, min(t) AS s, max(t) AS l, arg_max(coalesce(nx, -1), t) AS a FROM j WHERE ok GROUP BY video, g)
    SELECT video, s AS "start", CASE WHEN a >= 0 THEN a ELSE l END AS "end" FROM k WHERE (a >= 0 OR {str(keep_last).lower()}) AND CASE WHEN a >= 0 THEN a ELSE l END - s {least}"""


@query(_runs_sql("value < 40", ">= 6", True))
def w4_silence_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs below the level; each ends at the first row above it, the last at the last row."""
    return islands.runs(frames(spark, d), "video", "t", F.col("value") < 40, 6.0)


@query(_runs_sql("value > quantile_cont(value, 0.5) OVER (PARTITION BY video) + stddev_pop(value) OVER (PARTITION BY video)", "> 6", False))
def w5_speech_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs above median plus spread, longer than the least; a run at the end is dropped."""
    f = frames(spark, d)
    level = f.groupBy("video").agg((F.percentile("value", F.lit(0.5)) + F.stddev_pop("value")).alias("level"))
    return islands.runs(f.join(level, "video"), "video", "t", F.col("value") > F.col("level"), 6.0, strict=True, close_last=False)


@query(_runs_sql("kind IN ('view', 'click')", ">= 0", True))
def w6_voice_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of rows that a detector marked, of any length; the last is closed at the end."""
    return islands.runs(frames(spark, d), "video", "t", F.col("kind").isin("view", "click"), 0.0)


@query(f"""{REC}, p AS (SELECT video, quantile_cont(value, 0.9) AS p90 FROM f GROUP BY video),
    m AS (SELECT f.video, f.frame, f.value, row_number() OVER w AS n, max(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS mx, avg(value) OVER (w ROWS BETWEEN 3 PRECEDING AND 4 FOLLOWING) AS av FROM f WINDOW w AS (PARTITION BY video ORDER BY t, frame)),
    q AS (SELECT m.*, row_number() OVER (PARTITION BY m.video ORDER BY n) AS rn FROM m JOIN p USING (video) WHERE value = mx AND value >= av + 0.1 * p90),
    r AS (SELECT video, frame, rn, n AS last, true AS kept FROM q WHERE rn = 1 UNION ALL SELECT q.video, q.frame, q.rn, CASE WHEN q.n > r.last + 10 THEN q.n ELSE r.last END, q.n > r.last + 10 FROM r JOIN q ON q.video = r.video AND q.rn = r.rn + 1)
    SELECT video, frame FROM r WHERE kept""")
def w7_energy_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Local maxima above the local mean by a part of the 90th percentile, at least so many rows apart."""
    f = frames(spark, d)
    m = f.select("video", "frame", "value", F.row_number().over(V()).alias("n"), F.max("value").over(V().rowsBetween(-3, 2)).alias("mx"), F.avg("value").over(V().rowsBetween(-3, 4)).alias("av"))
    m = m.join(f.groupBy("video").agg(F.percentile("value", F.lit(0.9)).alias("p90")), "video").where("value = mx AND value >= av + 0.1 * p90")
    return _walk(m, lambda: Changed(10), [F.col("n")], x=F.col("n"))


@query(f"{EV} SELECT video, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.85), 6) AS p85 FROM f GROUP BY video")
def w8_percentile(spark: SparkSession, d: str) -> DataFrame:
    p = lambda x: F.round(F.percentile("value", F.lit(x)), 6)
    return frames(spark, d).groupBy("video").agg(p(0.9).alias("p90"), p(0.85).alias("p85"))


@query(f"""{EV}, g AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t, frame) - 1 AS i, count(*) OVER (PARTITION BY video) AS n FROM f),
    h AS (SELECT g.*, k, row_number() OVER (PARTITION BY video, k ORDER BY value DESC, t, frame) AS r FROM g, range(8) q(k) WHERE i >= floor(k * n / 8) AND i < floor((k + 1) * n / 8))
    SELECT video, frame, k::INT AS segment FROM h WHERE r = 1""")
def w11_e15_uniform_segments(spark: SparkSession, d: str) -> DataFrame:
    """Eight segments of nearly equal counts by index, the best frame of each (the first of equals)."""
    f = frames(spark, d).withColumns({"i": F.row_number().over(V()) - 1, "n": F.count("*").over(ALL())})
    # the segment k with floor(k n / 8) <= i < floor((k + 1) n / 8)
    k = F.ceil((F.col("i") + 1) * 8 / F.col("n")).cast("int") - 1
    best = F.max_by("frame", F.struct("value", -F.col("t"), -F.col("frame")))
    return f.groupBy("video", k.alias("segment")).agg(best.alias("frame")).select("video", "frame", "segment")


@query(f"{EV} SELECT video, arg_min(frame, t) AS first_frame, arg_max(frame, t) AS last_frame FROM f GROUP BY video")
def w12_u6_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return frames(spark, d).groupBy("video").agg(F.min_by("frame", F.struct("t", "frame")).alias("first_frame"), F.max_by("frame", F.struct("t", -F.col("frame"))).alias("last_frame"))


@query(f"{EV}, g AS (SELECT video, t - lag(t) OVER (PARTITION BY video ORDER BY t, frame) AS gap FROM f) SELECT video, round(stddev_pop(gap) / avg(gap), 6) AS gap_cv FROM g WHERE gap IS NOT NULL GROUP BY video")
def w14_gap_variation(spark: SparkSession, d: str) -> DataFrame:
    g = frames(spark, d).withColumn("gap", F.col("t") - F.lag("t").over(V())).where("gap IS NOT NULL")
    return g.groupBy("video").agg(F.round(F.stddev_pop("gap") / F.avg("gap"), 6).alias("gap_cv"))


@query(f"{EV} SELECT video, frame FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY value DESC, t, frame) AS r, max(t) OVER (PARTITION BY video) AS dur FROM f) WHERE r <= least(greatest(5, floor(dur * 0.01)), 25)")
def t1_e18_budget_top(spark: SparkSession, d: str) -> DataFrame:
    """The best frames up to the static budget of the duration; of equal scores the earlier."""
    best = Window.partitionBy("video").orderBy(F.desc("value"), "t", "frame")
    f = frames(spark, d).withColumns({"r": F.row_number().over(best), "dur": F.max("t").over(ALL())})
    return f.where(F.col("r") <= X.static_budget(F.col("dur"), 0.01)).select("video", "frame")


@query(f"{EV} SELECT video, frame FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t, frame) - 1 AS i FROM f) WHERE i % greatest(1, round_even(2.5, 0)::INT) = 0")
def t2_a7_uniform_stride(spark: SparkSession, d: str) -> DataFrame:
    """Every so-manieth frame, the step rounded half to even."""
    step = F.greatest(F.lit(1), F.bround(F.lit(2.5)).cast("int"))
    return frames(spark, d).withColumn("i", F.row_number().over(V()) - 1).where(F.pmod("i", step) == 0).select("video", "frame")


@query(f"{EV} SELECT video, frame FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY md5(concat(frame::VARCHAR, ':42')), frame) AS r FROM f) WHERE r <= 7")
def t3_random_sample(spark: SparkSession, d: str) -> DataFrame:
    """So many frames without replacement, by a seeded hash: the same at any partitioning."""
    order = Window.partitionBy("video").orderBy(F.md5(F.concat(F.col("frame").cast("string"), F.lit(":42"))), "frame")
    return frames(spark, d).withColumn("r", F.row_number().over(order)).where("r <= 7").select("video", "frame")


@query(f"""{EV}, g AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t, frame) - 1 AS i, count(*) OVER (PARTITION BY video) AS n FROM f)
    SELECT DISTINCT video, frame, m AS sampler FROM g, LATERAL (SELECT 'count_10' AS m WHERE i IN (SELECT floor(k * (n - 1) / 9.0::DOUBLE)::BIGINT FROM range(10) x(k))
    UNION ALL SELECT 'first_last_mid' WHERE i IN (0, n // 2, n - 1) UNION ALL SELECT 'quartiles' WHERE i IN (0, n // 4, n // 2, 3 * n // 4, n - 1) UNION ALL SELECT 'stride_7' WHERE i % 7 = 0)""")
def t4_fixed_samplers(spark: SparkSession, d: str) -> DataFrame:
    """Evenly spaced counts, first-middle-last with quartiles, and strides, by index arithmetic."""
    g = frames(spark, d).withColumns({"i": (F.row_number().over(V()) - 1).cast("bigint"), "n": F.count("*").over(ALL())})
    half = lambda a, b: F.floor(F.col("n") * a / b)
    even = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.floor(k * (F.col("n") - 1) / F.lit(9.0)))
    picks = [("count_10", F.array_contains(even, F.col("i"))), ("first_last_mid", F.col("i").isin(0) | (F.col("i") == half(1, 2)) | (F.col("i") == F.col("n") - 1))]
    picks += [("quartiles", (F.col("i") == 0) | (F.col("i") == half(1, 4)) | (F.col("i") == half(1, 2)) | (F.col("i") == half(3, 4)) | (F.col("i") == F.col("n") - 1)), ("stride_7", F.pmod("i", F.lit(7)) == 0)]
    names = F.filter(F.array(*[F.when(c, n) for n, c in picks]), lambda x: x.isNotNull())
    return g.select("video", "frame", F.explode(names).alias("sampler")).distinct()


#: Places within a scene for one to five frames of it.
PLACES = {1: (0.5,), 2: (0.25, 0.75), 3: (0.1, 0.5, 0.9), 4: (0.1, 0.4, 0.6, 0.9), 5: (0.1, 0.3, 0.5, 0.7, 0.9)}
_PLACES = ", ".join(f"({n}, {i}, {p}::DOUBLE)" for n, ps in PLACES.items() for i, p in enumerate(ps))


@query(f"""WITH s AS (SELECT DISTINCT video_id, scene_id, start_s, end_s FROM scenes WHERE end_s > start_s), x(per_scene, part, place) AS (VALUES {_PLACES}) SELECT video_id, scene_id, start_s, per_scene, part, floor((start_s + (end_s - start_s) * place) * 30)::BIGINT AS frame_no FROM s, x""")
def t5_scene_points(spark: SparkSession, d: str) -> DataFrame:
    """The frames of every scene at its middle, and at the places for two to five frames a scene."""
    place = F.explode(F.array(*[F.struct(F.lit(n).alias("per_scene"), F.lit(i).alias("part"), F.lit(p).alias("place")) for n, ps in PLACES.items() for i, p in enumerate(ps)]))
    s = table(spark, d, "scenes").where("end_s > start_s").distinct().withColumn("x", place)
    at = F.col("start_s") + (F.col("end_s") - F.col("start_s")) * F.col("x.place")
    return s.select("video_id", "scene_id", "start_s", "x.per_scene", "x.part", F.floor(at * 30).alias("frame_no"))


@query(f"""{REC}, o AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t, frame) AS rn, count(*) OVER (PARTITION BY video) AS n FROM f),
    r AS (SELECT video, frame, rn, n, value AS last, rn AS at, 1 AS k, true AS kept FROM o WHERE rn = 1 UNION ALL
    SELECT o.video, o.frame, o.rn, o.n, CASE WHEN z THEN o.value ELSE r.last END, CASE WHEN z THEN o.rn ELSE r.at END, r.k + z::INT, z
    FROM r JOIN o ON o.video = r.video AND o.rn = r.rn + 1, LATERAL (SELECT abs(o.value - r.last) > 40 AND o.rn - r.at >= 3 AND r.k < 20 AS z))
    SELECT video, frame FROM r WHERE kept OR rn = n""")
def t6_histogram_sampler(spark: SparkSession, d: str) -> DataFrame:
    """Frames that differ from the last kept one, so far apart and up to so many, and the last frame."""
    f = frames(spark, d)
    last = f.groupBy("video").agg(F.max_by("frame", F.struct("t", "frame")).alias("frame"))
    return _walk(f, lambda: Changed(40.0, apart=3, most=20), x=F.col("value")).union(last).distinct()


@query(f"""{EV}, g AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY video ORDER BY t, frame)) AS m FROM f),
    h AS (SELECT video, frame, t FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY m DESC, t) AS r FROM g WHERE m > 30) WHERE r <= 7 UNION SELECT video, frame, t FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY m, t) AS r FROM g WHERE m < 5) WHERE r <= 7)
    SELECT video, frame FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t) AS r FROM h) WHERE r <= 15""")
def t7_motion_sampler(spark: SparkSession, d: str) -> DataFrame:
    """The strongest and the calmest motions of each video, in time order up to a cap."""
    g = frames(spark, d).withColumn("m", F.abs(F.col("value") - F.lag("value").over(V())))
    high = Window.partitionBy("video", "side").orderBy(F.when(F.col("side") == "high", -F.col("m")).otherwise(F.col("m")), "t")
    g = g.withColumn("side", F.when(F.col("m") > 30, "high").when(F.col("m") < 5, "low")).where("side IS NOT NULL")
    h = g.withColumn("r", F.row_number().over(high)).where("r <= 7")
    return h.withColumn("r", F.row_number().over(V())).where("r <= 15").select("video", "frame")


@query(f"""{EV}, p AS (SELECT video, quantile_cont(value, 0.85) AS p85, min(t) AS a, max(t) AS b FROM f GROUP BY video) SELECT f.video, frame FROM f JOIN p USING (video) WHERE value >= p85 OR t = a OR t = b""")
def t9_flow_peaks(spark: SparkSession, d: str) -> DataFrame:
    """Frames from the 85th percentile on, with the first and the last."""
    f = frames(spark, d)
    p = f.groupBy("video").agg(F.percentile("value", F.lit(0.85)).alias("p85"), F.min("t").alias("a"), F.max("t").alias("b"))
    return f.join(p, "video").where("value >= p85 OR t = a OR t = b").select("video", "frame")


@query(f"""{EV}, g AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t, frame) - 1 AS i, count(*) OVER (PARTITION BY video) AS n FROM f) SELECT DISTINCT video, frame FROM g, range(30) q(k) WHERE i = CASE WHEN n <= 30 THEN k ELSE floor(k * n / 30.0::DOUBLE) END AND i < n""")
def t10_even_cap(spark: SparkSession, d: str) -> DataFrame:
    """At most 30 frames, at the indices int(i n / 30)."""
    g = frames(spark, d).withColumns({"i": (F.row_number().over(V()) - 1).cast("bigint"), "n": F.count("*").over(ALL())})
    at = F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: F.floor(k * F.col("n") / F.lit(30.0)))
    return g.where((F.col("n") <= 30) | F.array_contains(at, F.col("i"))).select("video", "frame")


@query("SELECT DISTINCT doc_id, array_to_string(string_split(text, ' ')[1:10], ' ') AS head FROM documents WHERE text IS NOT NULL")
def t11_first_ten(spark: SparkSession, d: str) -> DataFrame:
    """The first ten elements of a list, here the words of a text."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.select("doc_id", F.array_join(F.slice(F.split("text", " ", -1), 1, 10), " ").alias("head")).distinct()


@query("SELECT p_partkey, w * h AS area, row_number() OVER (PARTITION BY p_brand ORDER BY w * h DESC, p_partkey) AS place FROM (SELECT p_partkey, p_size AS w, (p_partkey % 90 + 1)::INT AS h, p_brand FROM part) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY w * h DESC, p_partkey) <= 15")
def t11_t12_boxes_by_area(spark: SparkSession, d: str) -> DataFrame:
    """The 15 largest boxes of each group, largest first."""
    b = table(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_size") * (F.col("p_partkey") % 90 + 1).cast("int")).alias("area"))
    order = Window.partitionBy("p_brand").orderBy(F.desc("area"), "p_partkey")
    return b.withColumn("place", F.row_number().over(order)).where("place <= 15").select("p_partkey", "area", "place")


@query(f"""{REC}, o AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t, frame) AS rn FROM f),
    r AS (SELECT video, frame, rn, [value] AS ks, true AS kept FROM o WHERE rn = 1 UNION ALL SELECT o.video, o.frame, o.rn, CASE WHEN z THEN list_append(r.ks, o.value) ELSE r.ks END, z
    FROM r JOIN o ON o.video = r.video AND o.rn = r.rn + 1, LATERAL (SELECT len(list_filter(r.ks, lambda y: abs(y - o.value) < 12)) = 0 AS z))
    SELECT video, frame FROM r WHERE kept""")
def e1_keep_unlike(spark: SparkSession, d: str) -> DataFrame:
    """Greedy deduplication in time order: dropped if like any kept frame."""
    return _walk(frames(spark, d), lambda: Apart(12.0), x=F.col("value"))


@query(f"""{REC}, o AS (SELECT *, kind = 'error' AS blank, row_number() OVER (PARTITION BY video ORDER BY t, frame) AS rn FROM f),
    r AS (SELECT video, frame, rn, CASE WHEN blank THEN NULL ELSE value END AS last, true AS kept FROM o WHERE rn = 1 UNION ALL
    SELECT o.video, o.frame, o.rn, CASE WHEN o.blank THEN NULL WHEN z THEN o.value ELSE r.last END, z FROM r JOIN o ON o.video = r.video AND o.rn = r.rn + 1, LATERAL (SELECT o.blank OR r.last IS NULL OR abs(o.value - r.last) > 40 AS z))
    SELECT video, frame FROM r WHERE kept""")
def e6_keep_changed(spark: SparkSession, d: str) -> DataFrame:
    """Kept if different from the last kept frame; one without features (here: an error) is kept and starts anew."""
    return _walk(frames(spark, d), lambda: Changed(40.0), x=F.col("value"), blank=F.col("kind") == "error")


@query(f"""{REC}, o AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY value DESC, t, frame) AS rn FROM f),
    r AS (SELECT video, frame, rn, [t] AS ks, true AS kept FROM o WHERE rn = 1 UNION ALL SELECT o.video, o.frame, o.rn, CASE WHEN z THEN list_append(r.ks, o.t) ELSE r.ks END, z
    FROM r JOIN o ON o.video = r.video AND o.rn = r.rn + 1, LATERAL (SELECT len(r.ks) < 6 AND len(list_filter(r.ks, lambda y: abs(y - o.t) < 48)) = 0 AS z))
    SELECT video, frame FROM r WHERE kept""")
def e12_time_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Non-maximum suppression in time: best first, none within the gap of a selected one, six at most."""
    return _walk(frames(spark, d), lambda: Apart(48.0, 6), [-F.col("value"), F.col("t"), F.col("frame")], x=F.col("t"))


@query("""WITH RECURSIVE b AS (SELECT p_brand, p_partkey, p_partkey % 200 AS x, p_partkey // 10 % 100 AS y, p_size AS w, p_partkey % 37 + 4 AS h FROM part),
    o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY w * h DESC, p_partkey) AS rn FROM b),
    r AS (SELECT p_brand, p_partkey, rn, [{'x': x, 'y': y, 'w': w, 'h': h}] AS ks, true AS kept FROM o WHERE rn = 1 UNION ALL
    SELECT o.p_brand, o.p_partkey, o.rn, CASE WHEN z THEN list_append(r.ks, {'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h}) ELSE r.ks END, z FROM r JOIN o ON o.p_brand = r.p_brand AND o.rn = r.rn + 1,
    LATERAL (SELECT len(list_filter(r.ks, lambda k: greatest(0, least(k.x + k.w, o.x + o.w) - greatest(k.x, o.x)) * greatest(0, least(k.y + k.h, o.y + o.h) - greatest(k.y, o.y)) / (o.w * o.h)::DOUBLE > 0.3)) = 0 AS z))
    SELECT p_brand, p_partkey FROM r WHERE kept""")
def e23_box_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Boxes by area, dropped where too much of them lies in a kept one."""
    k = F.col("p_partkey")
    b = table(spark, d, "part").select("p_brand", "p_partkey", (k % 200).alias("x"), (F.floor(k / 10) % 100).alias("y"), F.col("p_size").cast("bigint").alias("w"), (k % 37 + 4).alias("h"))
    return walk(b, ["p_brand"], [-F.col("w") * F.col("h"), k], lambda: BoxesKept(0.3), ["p_partkey"], x=F.col("x"), y=F.col("y"), w=F.col("w"), h=F.col("h"))


_AUDIO = """p AS (SELECT video, t FROM f WHERE kind = 'purchase'), z AS (SELECT video, t AS s, t + 2 AS e FROM f WHERE kind = 'error'),
    h AS (SELECT video, t AS s, t + 5 AS e FROM f WHERE kind = 'signup'), q AS (SELECT video, t + 1 AS t FROM f WHERE kind = 'signup')"""


@query(f"""{EV}, {_AUDIO}, g AS (SELECT f.*, max(t) OVER (PARTITION BY video) AS dur FROM f)
    SELECT video, frame, round(CASE WHEN dur <= 0 THEN 1.0 WHEN t / dur < 0.1 THEN 1.5 WHEN t / dur > 0.9 THEN 1.4 WHEN t / dur > 0.4 AND t / dur < 0.6 THEN 1.1 ELSE 1.0 END::DOUBLE
      * CASE WHEN (t - 24 * floor(t / 24)) / 24 < 0.15 THEN 1.4 WHEN (t - 24 * floor(t / 24)) / 24 > 0.85 THEN 1.2 ELSE 1.0 END::DOUBLE
      * CASE WHEN EXISTS (FROM p WHERE p.video = g.video AND abs(g.t - p.t) < 3) THEN 1.3 ELSE 1.0 END::DOUBLE
      * CASE WHEN EXISTS (FROM z WHERE z.video = g.video AND g.t >= z.e AND g.t < z.e + 3) THEN 1.4 ELSE 1.0 END::DOUBLE
      * coalesce((SELECT arg_min(CASE WHEN abs(g.t - h.s) < 3 THEN 1.2 ELSE 1.15 END::DOUBLE, h.s) FROM h WHERE h.video = g.video AND (abs(g.t - h.s) < 3 OR abs(g.t - h.e) < 3)), 1.0)
      * CASE WHEN EXISTS (FROM q WHERE q.video = g.video AND abs(g.t - q.t) < 3) THEN 1.5 ELSE 1.0 END::DOUBLE, 6) AS importance FROM g WHERE kind IN ('view', 'click')""")
def e8_importance(spark: SparkSession, d: str) -> DataFrame:
    """Importance as the product of position, scene and sound factors (C3-C6 as one join on time buckets)."""
    f = frames(spark, d)
    null = F.lit(None).cast("double")
    t = F.col("t")
    sound = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"), t.alias("ord"))
    kinds = F.when(F.col("kind") == "purchase", F.array(sound("peak", t, null))).when(F.col("kind") == "error", F.array(sound("silence", t, t + 2))).when(F.col("kind") == "signup", F.array(sound("speech", t, t + 5), sound("phrase", null, t + 1)))
    near = band_factors(f, f.select("video", F.inline(kinds)), "frame", "video", "t", 3.0)
    g = f.where("kind IN ('view', 'click')").join(f.groupBy("video").agg(F.max("t").alias("dur")), "video").join(near, "frame", "left")
    day = F.floor(t / 24) * 24
    score = X.position_score(t, F.col("dur")) * X.scene_score(t, day, day + 24) * F.coalesce("sound", F.lit(1.0))
    return g.select("video", "frame", F.round(score, 6).alias("importance"))


@query(f"{EV} SELECT video, frame, value * CASE WHEN row_number() OVER (PARTITION BY video ORDER BY t, frame) = 1 THEN 2.0 ELSE 1.0 END::DOUBLE * CASE WHEN row_number() OVER (PARTITION BY video ORDER BY t DESC, frame) = 1 THEN 1.8 ELSE 1.0 END::DOUBLE AS boosted FROM f")
def e9_endpoint_boost(spark: SparkSession, d: str) -> DataFrame:
    first, last = F.row_number().over(V()), F.row_number().over(Window.partitionBy("video").orderBy(F.desc("t"), "frame"))
    return frames(spark, d).select("video", "frame", (F.col("value") * F.when(first == 1, 2.0).otherwise(1.0) * F.when(last == 1, 1.8).otherwise(1.0)).alias("boosted"))


@query(f"""{EV}, g AS (SELECT video, floor(t / 24)::BIGINT AS scene, count(*) AS n, greatest(max(t) - min(t), 0.1) AS dur FROM f GROUP BY ALL),
    h AS (SELECT *, greatest(2, least(greatest(1, floor(dur * 0.25)), 10, n)) AS k FROM g) SELECT video, scene, n, (CASE WHEN n <= k THEN n ELSE k END)::BIGINT AS allocated FROM h""")
def e11_scene_allocation(spark: SparkSession, d: str) -> DataFrame:
    g = frames(spark, d).groupBy("video", F.floor(F.col("t") / 24).alias("scene")).agg(F.count("*").alias("n"), F.greatest(F.max("t") - F.min("t"), F.lit(0.1)).alias("dur"))
    return g.select("video", "scene", "n", X.scene_allocation(F.col("dur"), F.lit(0.25), F.col("n")).cast("bigint").alias("allocated"))


@query(f"""{EV}, g AS (SELECT video, 60 + avg(value) * 1.5 AS tempo, stddev_pop(value) / 1000 AS rms, max(value) * 6 AS br FROM f GROUP BY video)
    SELECT video, CASE WHEN tempo > 140 AND rms > 0.05 THEN 'energetic' WHEN tempo > 120 AND br > 2000 THEN 'upbeat' WHEN tempo < 80 AND rms < 0.03 THEN 'calm' WHEN rms > 0.08 THEN 'dramatic' WHEN tempo < 90 THEN 'melancholic' ELSE 'neutral' END AS mood FROM g""")
def e25_mood(spark: SparkSession, d: str) -> DataFrame:
    g = frames(spark, d).groupBy("video").agg((60 + F.avg("value") * 1.5).alias("tempo"), (F.stddev_pop("value") / 1000).alias("rms"), (F.max("value") * 6).alias("br"))
    return g.select("video", X.mood(F.col("tempo"), F.col("rms"), F.col("br")).alias("mood"))


@query(f"""{EV}, g AS (SELECT video, max(t) AS dur FROM f GROUP BY video) SELECT video, k::INT AS scene, k * 10.0::DOUBLE AS "start", least((k + 1) * 10.0::DOUBLE, dur) AS "end" FROM g, LATERAL (SELECT unnest(range(greatest(1, ceil(dur / 10)::BIGINT))) AS k)""")
def e30_r3_tumbling_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Scenes of ten units where none were found, the last cut at the end."""
    g = frames(spark, d).groupBy("video").agg(F.max("t").alias("dur"))
    n = F.greatest(F.lit(1), F.ceil(F.col("dur") / 10)).cast("int")
    g = g.withColumn("scene", F.explode(F.sequence(F.lit(0), n - 1)))
    return g.select("video", "scene", (F.col("scene") * F.lit(10.0)).alias("start"), F.least((F.col("scene") + 1) * F.lit(10.0), F.col("dur")).alias("end"))


@query(f"""{EV}, h AS (SELECT video, floor(t / 24)::BIGINT AS day, least(15, floor(value / 35))::INT AS bin, count(*) AS n FROM f GROUP BY ALL),
    m AS (SELECT video, day, sqrt(sum(n * n)) AS len FROM h GROUP BY ALL), k AS (SELECT *, lag(day) OVER (PARTITION BY video ORDER BY day) AS pd FROM m)
    SELECT k.video, k.day, round((SELECT sum(CASE WHEN a.n IS NULL THEN 0 ELSE pow(a.n / p.len - coalesce(b.n, 0) / k.len, 2) / (a.n / p.len) END)
      FROM (SELECT bin, n FROM h WHERE h.video = k.video AND h.day = k.pd) a LEFT JOIN (SELECT bin, n FROM h WHERE h.video = k.video AND h.day = k.day) b USING (bin)), 6) AS change
    FROM k JOIN m p ON p.video = k.video AND p.day = k.pd""")
def b3_histogram_change(spark: SparkSession, d: str) -> DataFrame:
    """Chi-square of a day's histogram of 16 bins against the day before, both of unit length."""
    b = F.least(F.lit(15), F.floor(F.col("value") / 35)).cast("int")
    h = frames(spark, d).groupBy("video", F.floor(F.col("t") / 24).alias("day")).agg(*[F.count_if(b == i).cast("double").alias(f"b{i}") for i in range(16)])
    h = h.select("video", "day", X.l2_normalised(F.array(*[f"b{i}" for i in range(16)])).alias("hist"))
    h = h.withColumn("p", F.lag("hist").over(Window.partitionBy("video").orderBy("day"))).where("p IS NOT NULL")
    return h.select("video", "day", F.round(X.chi_square(F.col("p"), F.col("hist")), 6).alias("change"))



@query(f"""{REC}, o1 AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t, frame) AS rn FROM f),
    r1 AS (SELECT video, frame, t, value, rn, value AS last, true AS kept FROM o1 WHERE rn = 1 UNION ALL SELECT o1.video, o1.frame, o1.t, o1.value, o1.rn, CASE WHEN abs(o1.value - r1.last) > 10 THEN o1.value ELSE r1.last END, abs(o1.value - r1.last) > 10 FROM r1 JOIN o1 ON o1.video = r1.video AND o1.rn = r1.rn + 1),
    k1 AS (SELECT video, frame, t, value FROM r1 WHERE kept), o2 AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t, frame) AS rn FROM k1),
    r2 AS (SELECT video, frame, t, value, rn, value AS last, true AS kept FROM o2 WHERE rn = 1 UNION ALL SELECT o2.video, o2.frame, o2.t, o2.value, o2.rn, CASE WHEN abs(o2.value - r2.last) > 20 THEN o2.value ELSE r2.last END, abs(o2.value - r2.last) > 20 FROM r2 JOIN o2 ON o2.video = r2.video AND o2.rn = r2.rn + 1),
    k2 AS (SELECT video, frame, t, value FROM r2 WHERE kept), o3 AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY t, frame) AS rn FROM k2),
    r3 AS (SELECT video, frame, t, value, rn, value AS last, true AS kept FROM o3 WHERE rn = 1 UNION ALL SELECT o3.video, o3.frame, o3.t, o3.value, o3.rn, CASE WHEN abs(o3.value - r3.last) > 30 THEN o3.value ELSE r3.last END, abs(o3.value - r3.last) > 30 FROM r3 JOIN o3 ON o3.video = r3.video AND o3.rn = r3.rn + 1),
    k3 AS (SELECT r3.video, r3.frame, r3.t, r3.value, o1.rn AS i FROM r3 JOIN o1 USING (video, frame) WHERE kept),
    sc AS (SELECT *, greatest(abs(value - lag(value) OVER w), abs(value - lead(value) OVER w), 0) AS score FROM k3 WINDOW w AS (PARTITION BY video ORDER BY i)),
    o4 AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY score DESC, i DESC) AS rn FROM sc),
    r4 AS (SELECT video, frame, rn, [i] AS ks, true AS kept FROM o4 WHERE rn = 1 UNION ALL SELECT o4.video, o4.frame, o4.rn, CASE WHEN z THEN list_append(r4.ks, o4.i) ELSE r4.ks END, z
    FROM r4 JOIN o4 ON o4.video = r4.video AND o4.rn = r4.rn + 1, LATERAL (SELECT len(list_filter(r4.ks, lambda y: abs(y - o4.i) < 5)) = 0 AS z))
    SELECT video, frame FROM r4 WHERE kept""")
def e22_change_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Three keep-if-changed stages in one walk, then the best of what is left by its neighbours, none within five frames of another."""
    f = frames(spark, d).withColumn("i", F.row_number().over(V()))
    kept = walk(f, ["video"], [F.col("t"), F.col("frame")], lambda: Chain([Changed(10.0), Changed(20.0), Changed(30.0)]), ["frame", "i", "value"], mark="passed", x=F.col("value")).where("passed = 3")
    by = Window.partitionBy("video").orderBy("i")
    score = F.greatest(F.abs(F.col("value") - F.lag("value").over(by)), F.abs(F.col("value") - F.lead("value").over(by)), F.lit(0.0))
    return _walk(kept.withColumn("score", score), lambda: Apart(5), [-F.col("score"), -F.col("i")], x=F.col("i"))


QUERIES, SQL = query.queries, query.sql
