"""Queries over vectors: differences, signatures, cascades, densities (embeddings of a label in order)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelsieve.functions import expr as X
from reelsieve.operators.group_models import farthest_points, intrinsic_dimension, kmeans_picks
from reelsieve.operators.walk import AlikeKept, Chain, NearKept, UnlikeKept, VotesKept, walk
from reelsieve.plans.base import CANDIDATES_SQL, Registry, candidates
from reelsieve.session import table

query = Registry()
E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
LAGGED = f"WITH {E}, g AS (SELECT *, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM e)"
DOT = "list_dot_product(a, b)"


def _e(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))


def _w():
    return Window.partitionBy("label").orderBy("vec_id")


@query(f"{LAGGED} SELECT label, vec_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(v[i] - p[i]))) / 64, 6) AS change FROM g WHERE p IS NOT NULL")
def b2_frame_difference(spark: SparkSession, d: str) -> DataFrame:
    g = _e(spark, d).withColumn("p", F.lag("v").over(_w())).where("p IS NOT NULL")
    return g.select("label", "vec_id", F.round(X.mean_abs_diff(F.col("v"), F.col("p")), 6).alias("change"))


@query(f"""{LAGGED}, h AS (SELECT label, vec_id, len(list_filter(range(1, 65), lambda i: (v[i] > 0) <> (p[i] > 0))) AS x, len(list_filter(v, lambda y: y > 0)) AS a, len(list_filter(p, lambda y: y > 0)) AS b FROM g WHERE p IS NOT NULL)
    SELECT label, vec_id, round(x / greatest(a, b, 1)::DOUBLE, 6) AS change FROM h""")
def b4_edge_change(spark: SparkSession, d: str) -> DataFrame:
    """Changed bits of a mask against the larger mask."""
    g = _e(spark, d).withColumn("m", X.pack_bits(F.transform("v", lambda x: x > 0)))
    g = g.withColumn("p", F.lag("m").over(_w())).where("p IS NOT NULL")
    return g.select("label", "vec_id", F.round(X.edge_change(F.col("m"), F.col("p")), 6).alias("change"))


@query(f"""WITH {CANDIDATES_SQL}, f AS (SELECT candidate_id, video_id, row_number() OVER (PARTITION BY video_id ORDER BY ts, candidate_id) AS i FROM c),
    v AS (SELECT candidate_id AS vector_of, video_id, row_number() OVER (PARTITION BY video_id ORDER BY ts, candidate_id) AS i, e[1] AS head FROM c WHERE candidate_id % 4 <> 0) SELECT f.candidate_id, vector_of, round(head, 6) AS head FROM f LEFT JOIN v USING (video_id, i)""")
def c9_attach_by_position(spark: SparkSession, d: str) -> DataFrame:
    """The i-th vector of a video's list goes to its i-th frame; frames beyond the list (which is shorter here) get none."""
    k = candidates(spark, d)
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("ts", "candidate_id"))
    f = k.select("candidate_id", "video_id", place.alias("i"))
    v = k.where("candidate_id % 4 <> 0").select(F.col("candidate_id").alias("vector_of"), "video_id", place.alias("i"), F.round(F.col("embedding")[0].cast("double"), 6).alias("head"))
    return f.join(v, ["video_id", "i"], "left").select("candidate_id", "vector_of", "head")


@query(f"""WITH {E} SELECT a.label, round(1 - avg(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))), 5) AS info_density FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label""")
def e7_d6_c11_info_density(spark: SparkSession, d: str) -> DataFrame:
    """One minus the mean cosine of all pairs, in closed form: linear in the vectors, no pair is made."""
    n = X.norm(F.col("v"))
    e = _e(spark, d).select("label", F.posexplode(F.transform("v", lambda x: x / n)))
    by_place = e.groupBy("label", "pos").agg(F.sum("col").alias("s"), F.sum(F.col("col") * F.col("col")).alias("q"), F.count("*").alias("n"))
    g = by_place.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("q"), F.max("n").alias("n"))
    density = F.when(F.col("n") < 2, 0.0).otherwise(1 - (F.col("ss") - F.col("q")) / (F.col("n") * (F.col("n") - 1)))
    return g.select("label", F.round(density, 5).alias("info_density"))


@query(f"{LAGGED} SELECT label, round(avg(sqrt(list_sum(list_transform(range(1, 65), lambda i: (v[i] - p[i]) * (v[i] - p[i]))))), 6) AS mean_step FROM g WHERE p IS NOT NULL GROUP BY label")
def w10_mean_step(spark: SparkSession, d: str) -> DataFrame:
    g = _e(spark, d).withColumn("p", F.lag("v").over(_w())).where("p IS NOT NULL")
    return g.groupBy("label").agg(F.round(F.avg(X.euclidean(F.col("v"), F.col("p"))), 6).alias("mean_step"))


@query(f"""{LAGGED}, h AS (SELECT *, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS q FROM g) SELECT label, vec_id, round(greatest(1 - list_cosine_similarity(v, p), 1 - list_cosine_similarity(v, q)), 6) AS score FROM h""")
def w13_neighbour_score(spark: SparkSession, d: str) -> DataFrame:
    """The larger distance to the neighbours before and after."""
    g = _e(spark, d).withColumns({"p": F.lag("v").over(_w()), "q": F.lead("v").over(_w())})
    return g.select("label", "vec_id", F.round(F.greatest(1 - X.cosine(F.col("v"), F.col("p")), 1 - X.cosine(F.col("v"), F.col("q"))), 6).alias("score"))


@query(f"""WITH {E}, n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM e),
    s AS (SELECT *, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM n WHERE n <= 10 OR i % greatest(1, n // 10) = 0)
    SELECT label, round(avg(list_sum(list_transform(range(1, 65), lambda k: abs(v[k] - p[k]))) / 64), 6) AS variance FROM s WHERE p IS NOT NULL GROUP BY label""")
def d21_frame_variance(spark: SparkSession, d: str) -> DataFrame:
    """Mean change between neighbours; groups of more than ten rows are strided first."""
    n = _e(spark, d).withColumns({"i": F.row_number().over(_w()) - 1, "n": F.count("*").over(Window.partitionBy("label"))})
    s = n.where((F.col("n") <= 10) | (F.pmod("i", F.greatest(F.lit(1), F.floor(F.col("n") / 10))) == 0))
    s = s.withColumn("p", F.lag("v").over(_w())).where("p IS NOT NULL")
    return s.groupBy("label").agg(F.round(F.avg(X.mean_abs_diff(F.col("v"), F.col("p"))), 6).alias("variance"))


#: The frames of a video in order of time, with their vectors: what the cascade runs over.
K = f"{CANDIDATES_SQL}, e AS (SELECT candidate_id AS vec_id, video_id AS label, ts, e AS v FROM c)"
_BITS = f"""{K}, h AS (SELECT vec_id, label, ts, v, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u,
    list_sum(list_transform(range(0, 56), lambda i: CASE WHEN v[i // 7 * 8 + i % 7 + 2] > v[i // 7 * 8 + i % 7 + 1] THEN 1::HUGEINT << i ELSE 0::HUGEINT END))::HUGEINT AS dh,
    list_sum(list_transform(range(0, 56), lambda i: CASE WHEN v[i + 9] > v[i + 1] THEN 1::HUGEINT << i ELSE 0::HUGEINT END))::HUGEINT AS vh,
    list_sum(list_transform(range(0, 64), lambda i: CASE WHEN v[i + 1] > 0 THEN 1::HUGEINT << i ELSE 0::HUGEINT END))::HUGEINT AS sh FROM e)"""
_VOTE = "((bit_count(xor(k.dh, o.dh)) < 8)::INT + (bit_count(xor(k.vh, o.vh)) < 8)::INT + (bit_count(xor(k.sh, o.sh)) < 8)::INT) >= 2"


def _stage(name: str, of: str, like: str) -> str:
    """A greedy stage over the rows of ``of``: ``{name}`` holds what it keeps."""
    o, r = f"{name}_o", f"{name}_r"
    kept = "{'dh': o.dh, 'vh': o.vh, 'sh': o.sh, 'u': o.u}"
    return f"""{o} AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ts, vec_id) AS rn FROM {of}),
    {r} AS (SELECT label, vec_id, rn, [{kept}] AS ks, true AS kept FROM {o} o WHERE rn = 1 UNION ALL
    SELECT o.label, o.vec_id, o.rn, CASE WHEN z THEN list_append(r.ks, {kept}) ELSE r.ks END, z FROM {r} r JOIN {o} o ON o.label = r.label AND o.rn = r.rn + 1, LATERAL (SELECT len(list_filter(r.ks, lambda k: {like})) = 0 AS z)),
    {name} AS (SELECT h.* FROM {r} r JOIN h USING (label, vec_id) WHERE r.kept)"""


_NEAR = "list_sum(list_transform(range(1, 65), lambda i: abs(k.u[i] - o.u[i]))) / 64 < 0.03"
_COSINE = "list_dot_product(k.u, o.u) > 0.9"


def _signatures(e: DataFrame) -> DataFrame:
    """Gradient and sign bits of the vector as a grid of 8 by 8."""
    at = lambda i: F.get("v", i)
    side = F.transform(F.sequence(F.lit(0), F.lit(55)), lambda i: at(F.floor(i / 7) * 8 + i % 7 + 1) > at(F.floor(i / 7) * 8 + i % 7))
    down = F.transform(F.sequence(F.lit(0), F.lit(55)), lambda i: at(i + 8) > at(i))
    return e.select("*", X.pack_bits(side).alias("dh"), X.pack_bits(down).alias("vh"), X.pack_bits(F.transform("v", lambda x: x > 0)).alias("sh"))


def _k(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select(F.col("candidate_id").alias("vec_id"), F.col("video_id").alias("label"), "ts", F.col("embedding").alias("v"))


_IN_TIME = lambda: [F.col("ts"), F.col("vec_id")]


@query(f"WITH RECURSIVE {_BITS}, {_stage('k1', 'h', _VOTE)} SELECT label, vec_id FROM k1")
def e2_hash_votes(spark: SparkSession, d: str) -> DataFrame:
    """Dropped if two of three signatures are near those of a kept frame of the video."""
    s = _signatures(_k(spark, d))
    return walk(s, ["label"], _IN_TIME(), lambda: VotesKept(8, 2), ["vec_id"], dh=F.col("dh"), vh=F.col("vh"), sh=F.col("sh"))


@query(f"WITH RECURSIVE {_BITS}, {_stage('k1', 'h', _COSINE)} SELECT label, vec_id FROM k1")
def e4_c10_cosine_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Greedy deduplication of a video's frames by cosine, in order, streamed."""
    return walk(_k(spark, d), ["label"], _IN_TIME(), lambda: UnlikeKept(0.9), ["vec_id"], v=F.col("v"))


_CELLS = "[" + ", ".join("[" + ", ".join(str((r + i) * 8 + c + j + 1) for i in range(7) for j in range(7)) + "]" for r in (0, 1) for c in (0, 1)) + "]"
_SSIM = "list_sum(list_transform(range(1, 5), lambda w: ((2 * k.m[w] * o.m[w] + 0.0001::DOUBLE) * (2 * 49 / 48.0::DOUBLE * (list_sum(list_transform(cells[w], lambda i: k.v[i] * o.v[i])) / 49 - k.m[w] * o.m[w]) + 0.0009::DOUBLE)) / ((k.m[w] * k.m[w] + o.m[w] * o.m[w] + 0.0001::DOUBLE) * (k.q[w] + o.q[w] + 0.0009::DOUBLE)))) / 4 > 0.92"


@query(f"""WITH RECURSIVE {K}, g AS (SELECT *, {_CELLS} AS cells FROM e), h0 AS (SELECT *, list_transform(cells, lambda c: list_sum(list_transform(c, lambda i: v[i])) / 49) AS m FROM g),
    h AS (SELECT *, list_transform(range(1, 5), lambda w: 49 / 48.0::DOUBLE * (list_sum(list_transform(cells[w], lambda i: v[i] * v[i])) / 49 - m[w] * m[w])) AS q, row_number() OVER (PARTITION BY label ORDER BY ts, vec_id) AS rn FROM h0),
    r AS (SELECT label, vec_id, rn, [{{'v': v, 'm': m, 'q': q}}] AS ks, true AS kept FROM h WHERE rn = 1 UNION ALL
    SELECT o.label, o.vec_id, o.rn, CASE WHEN z THEN list_append(r.ks, {{'v': o.v, 'm': o.m, 'q': o.q}}) ELSE r.ks END, z FROM r JOIN h o ON o.label = r.label AND o.rn = r.rn + 1, LATERAL (SELECT len(list_filter(r.ks, lambda k: {_SSIM.replace("cells[w]", "o.cells[w]")})) = 0 AS z))
    SELECT label, vec_id FROM r WHERE kept""")
def e5_structural_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Greedy deduplication by structural similarity, the vector as a grid of 8 by 8."""
    return walk(_k(spark, d), ["label"], _IN_TIME(), lambda: AlikeKept(0.92, 8, 1.0), ["vec_id"], v=F.col("v"))


@query(f"""WITH RECURSIVE {_BITS}, {_stage('k1', 'h', _VOTE)}, {_stage('k2', 'k1', _NEAR)}, {_stage('k3', 'k2', _COSINE)},
    n AS (SELECT label, count(*) AS n_in, (SELECT count(*) FROM k1 WHERE k1.label = h.label) AS a, (SELECT count(*) FROM k2 WHERE k2.label = h.label) AS b, (SELECT count(*) FROM k3 WHERE k3.label = h.label) AS c FROM h GROUP BY label)
    SELECT label, n_in, CASE WHEN n_in > 1 THEN a END AS after_hash, NULL::BIGINT AS after_structure, CASE WHEN a > 1 THEN b END AS after_distance, CASE WHEN b > 1 THEN c END AS after_cosine, c AS n_out FROM n""")
def e3_d3_cascade_counts(spark: SparkSession, d: str) -> DataFrame:
    """Frames left after each stage of the cascade, cheap signatures first, all in one walk. A stage that is
    off (structure, as by default) or has a single frame to look at is skipped and has no count."""
    stages = lambda: Chain([VotesKept(8, 2), NearKept(0.03), UnlikeKept(0.9)])
    s = walk(_signatures(_k(spark, d)), ["label"], _IN_TIME(), stages, ["vec_id"], mark="passed", dh=F.col("dh"), vh=F.col("vh"), sh=F.col("sh"), v=F.col("v"))
    g = s.groupBy("label").agg(F.count("*").alias("n_in"), *[F.count_if(F.col("passed") >= i).alias(f"k{i}") for i in (1, 2, 3)])
    seen = lambda before, c: F.when(F.col(before) > 1, F.col(c))
    return g.select("label", "n_in", seen("n_in", "k1").alias("after_hash"), F.lit(None).cast("bigint").alias("after_structure"), seen("k1", "k2").alias("after_distance"), seen("k2", "k3").alias("after_cosine"), F.col("k3").alias("n_out"))


@query(f"""{LAGGED}, s AS (SELECT label, avg(list_sum(list_transform(range(1, 65), lambda i: abs(v[i] - p[i]))) / 64) AS variance, max(v[1]) * 6 AS most, count(*) + 1 AS n FROM g WHERE p IS NOT NULL GROUP BY label)
    SELECT label, round(CASE WHEN n < 2 THEN 0.25 ELSE 0.25 * CASE WHEN variance > 0.15 THEN 1.3 WHEN variance < 0.05 THEN 0.7 ELSE 1.0 END * CASE WHEN most > 1.5 THEN 1.2 ELSE 1.0 END END::DOUBLE, 6) AS density FROM s""")
def e10_adaptive_density(spark: SparkSession, d: str) -> DataFrame:
    g = _e(spark, d).withColumn("p", F.lag("v").over(_w())).where("p IS NOT NULL")
    s = g.groupBy("label").agg(F.avg(X.mean_abs_diff(F.col("v"), F.col("p"))).alias("variance"), (F.max(F.col("v")[0].cast("double")) * 6).alias("most"), (F.count("*") + 1).alias("n"))
    return s.select("label", F.round(X.adaptive_density(0.25, F.col("variance"), F.col("most"), F.col("n")), 6).alias("density"))


@query(f"""WITH RECURSIVE {E}, r AS (SELECT label, 0 AS rank, min(vec_id) AS vec_id, [arg_min(v, vec_id)] AS cs FROM e GROUP BY label UNION ALL
    SELECT label, rank + 1, arg_min(vec_id, (-near, vec_id)), list_append(any_value(cs), arg_min(v, (-near, vec_id))) FROM (SELECT e.label, e.vec_id, e.v, r.rank, r.cs, list_min(list_transform(r.cs, lambda y: round(1 - list_cosine_similarity(e.v, y), 9))) AS near FROM r JOIN e ON e.label = r.label WHERE r.rank < 9)
    WHERE near > 0 GROUP BY label, rank) SELECT label, vec_id, rank FROM r""")
def t8_e20_farthest_points(spark: SparkSession, d: str) -> DataFrame:
    """Ten rows of each label, each the farthest from those before it, from the first on."""
    return farthest_points(_e(spark, d), "label", "vec_id", "v", 10)


@query()
def e17_w9_intrinsic_dimension(spark: SparkSession, d: str) -> DataFrame:
    """How many components explain 90 percent of the variance."""
    return intrinsic_dimension(_e(spark, d), "label", "v")


_GAP = "round(list_sum(list_transform(range(1, 65), lambda i: (v[i] - y[i]) * (v[i] - y[i]))), 12)"


@query(f"""WITH RECURSIVE {E}, kk AS (SELECT label, greatest(5, least(20, count(*) // 3)) AS k FROM e GROUP BY 1),
    r AS (SELECT label, 0 AS rank, min(vec_id) AS vec_id, [arg_min(v, vec_id)] AS cs FROM e GROUP BY label UNION ALL
    SELECT label, rank + 1, arg_min(vec_id, (-near, vec_id)), list_append(any_value(cs), arg_min(v, (-near, vec_id))) FROM (SELECT e.label, e.vec_id, e.v, r.rank, r.cs, list_min(list_transform(r.cs, lambda y: round(1 - list_cosine_similarity(e.v, y), 9))) AS near FROM r JOIN e ON e.label = r.label JOIN kk ON kk.label = r.label WHERE r.rank + 1 < k)
    WHERE near > 0 GROUP BY label, rank),
    l AS (SELECT label, 0 AS turn, arg_max(cs, rank) AS cs FROM r GROUP BY label UNION ALL
    SELECT label, turn + 1, list(c ORDER BY cluster) FROM (SELECT label, turn, cluster, list(m ORDER BY pos) AS c FROM (SELECT label, turn, cluster, pos, avg(x) AS m FROM (SELECT label, turn, list_position(d, list_min(d)) AS cluster, unnest(range(1, 65)) AS pos, unnest(v) AS x
      FROM (SELECT l.label, l.turn, e.v, list_transform(l.cs, lambda y: {_GAP}) AS d FROM l JOIN e ON e.label = l.label WHERE l.turn < 10)) GROUP BY ALL) GROUP BY ALL) GROUP BY label, turn),
    f AS (SELECT e.label, e.vec_id, list_transform(l.cs, lambda y: {_GAP}) AS d FROM l JOIN e ON e.label = l.label WHERE l.turn = 10)
    SELECT label, arg_min(vec_id, (round(sqrt(list_min(d)), 9), vec_id)) AS vec_id, (list_position(d, list_min(d)) - 1)::INT AS cluster FROM f GROUP BY label, list_position(d, list_min(d))""")
def e21_kmeans_picks(spark: SparkSession, d: str) -> DataFrame:
    """The row nearest to each centre of k-means within a label: one cluster for three rows, five to twenty."""
    e = _e(spark, d)
    n = e.groupBy("label").agg(F.greatest(F.lit(5), F.least(F.lit(20), F.floor(F.count("*") / 3))).alias("k"))
    return kmeans_picks(e.join(n, "label"), "label", "vec_id", "v", F.col("k"))


QUERIES, SQL = query.queries, query.sql
