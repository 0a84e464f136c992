"""Extraction records: prompts, replies, comparisons, contexts assembled from child tables, scenes with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelsieve.functions import expr as X
from reelsieve.functions import prompts as P
from reelsieve.functions import taxonomy
from reelsieve.operators.joins import range_join
from reelsieve.operators.walk import Gate, walk
from reelsieve.plans.base import CANDIDATES_SQL, FRAMES_SQL, SCENES_SQL, Registry, candidates, frames, scenes
from reelsieve.session import table

query = Registry()
EV = f"WITH {FRAMES_SQL}"
ABLATION = "a AS (SELECT DISTINCT ON (metric_id) * FROM ablation_metrics)"
_LABEL = "CASE WHEN q < 0.15 THEN 'OPENING' WHEN q > 0.85 THEN 'CLOSING' WHEN q > 0.4 AND q < 0.6 THEN 'MIDDLE' END"
tenth = lambda c: F.floor(c * 10) / F.lit(10.0)


def _records(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ablation_metrics")
    return t.dropDuplicates(["metric_id"])


# ---- prompts


@query(f"""{EV}, g AS (SELECT video, frame, floor(t * 10) / 10.0::DOUBLE AS ts, max(t) OVER (PARTITION BY video) AS dur, t / max(t) OVER (PARTITION BY video) AS q, kind FROM f),
    h AS (SELECT *, row_number() OVER w AS n, lag(ts) OVER w AS p, {_LABEL} AS label FROM g WHERE kind = 'signup' WINDOW w AS (PARTITION BY video ORDER BY ts, frame))
    SELECT video, concat('A video of ', printf('%.1f', floor(any_value(dur) * 10) / 10.0::DOUBLE), ' seconds in ', count(*), ' frames in order of time.', chr(10), chr(10),
      string_agg(concat('Frame ', n, ' @ ', printf('%.1fs', ts), CASE WHEN n > 1 THEN printf(' (Δ%.1fs)', ts - p) ELSE '' END, CASE WHEN label IS NOT NULL THEN concat(' [', label, ']') ELSE '' END), chr(10) ORDER BY n), chr(10), chr(10), 'Answer with valid JSON only.') AS prompt FROM h GROUP BY video""")
def f_temporal_prompt(spark: SparkSession, d: str) -> DataFrame:
    """A prompt with the selected frames of a video (here: signups) in order, with times, gaps and labels."""
    f = frames(spark, d)
    dur = f.groupBy("video").agg(F.max("t").alias("dur"))
    one = f.where("kind = 'signup'").join(dur, "video").select("video", "dur", F.struct(tenth(F.col("t")).alias("ts"), "frame", X.position_label(F.col("t"), F.col("dur")).alias("label")).alias("x"))
    g = one.groupBy("video").agg(F.max("dur").alias("dur"), F.array_sort(F.collect_list("x")).alias("xs"))
    return g.select("video", P.prompt(tenth(F.col("dur")), F.size("xs"), P.frame_lines(F.col("xs"))).alias("prompt"))


_SCENES_AT = "s AS (SELECT video_id, scene_id, min(start_s) AS start_s, max(end_s) AS end_s FROM scenes WHERE start_s IS NOT NULL AND end_s IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY scene_id) AS no FROM s)"


@query(f"""WITH {CANDIDATES_SQL}, {_SCENES_AT}, l AS (SELECT video_id, max(end_s) AS dur FROM s GROUP BY 1),
    j AS (SELECT k.*, dur, ts, candidate_id, CASE WHEN dur > 0 THEN ts / dur ELSE 0 END AS q FROM c JOIN k ON k.video_id = c.video_id AND ts >= start_s AND ts < end_s JOIN l ON l.video_id = k.video_id WHERE candidate_id % 9 = 0),
    b AS (SELECT video_id, no, dur, count(*) AS n, concat('--- SCENE ', no, ' (', printf('%.1fs', floor(start_s * 10) / 10.0::DOUBLE), ' - ', printf('%.1fs', floor(end_s * 10) / 10.0::DOUBLE), ') ---', chr(10),
      string_agg(concat('  Frame @ ', printf('%.1fs', floor(ts * 10) / 10.0::DOUBLE), CASE WHEN {_LABEL} IS NOT NULL THEN concat(' [', {_LABEL}, ']') ELSE '' END), chr(10) ORDER BY ts, candidate_id)) AS block FROM j GROUP BY video_id, no, dur, start_s, end_s)
    SELECT video_id, concat('A video of ', printf('%.1f', floor(dur * 10) / 10.0::DOUBLE), ' seconds in ', sum(n)::BIGINT, ' frames in order of time.', chr(10), chr(10), string_agg(block, chr(10) || chr(10) ORDER BY no), chr(10), chr(10), 'Answer with valid JSON only.') AS prompt FROM b GROUP BY video_id, dur""")
def f_c18_segmented_prompt(spark: SparkSession, d: str) -> DataFrame:
    """A prompt with frames grouped by all scenes they lie in; scenes without frames are left out. A ninth of the
    candidates stand in for the selected frames."""
    s = scenes(spark, d).groupBy("video_id", "scene_id").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    s = s.withColumn("no", F.row_number().over(Window.partitionBy("video_id").orderBy("scene_id")))
    length = s.groupBy("video_id").agg(F.max("end_s").alias("dur"))
    c = candidates(spark, d, False).where("candidate_id % 9 = 0").select("candidate_id", "video_id", "ts")
    j = range_join(c, s, ["video_id"], "ts", "start_s", "end_s", 8.0).join(length, "video_id")
    x = F.struct(F.col("ts").alias("t"), "candidate_id", tenth(F.col("ts")).alias("ts"), X.position_label(F.col("ts"), F.col("dur")).alias("label"))
    b = j.groupBy("video_id", "no", "dur", "start_s", "end_s").agg(F.array_sort(F.collect_list(x)).alias("xs"))
    b = b.select("video_id", "dur", "no", F.size("xs").alias("n"), P.scene_block(F.col("no"), tenth(F.col("start_s")), tenth(F.col("end_s")), F.col("xs")).alias("block"))
    g = b.groupBy("video_id", "dur").agg(F.sum("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("no", "block"))), lambda y: y["block"]).alias("blocks"))
    return g.select("video_id", P.prompt(tenth(F.col("dur")), F.col("n"), F.array_join("blocks", "\n\n")).alias("prompt"))


@query("""WITH b AS (SELECT p_brand, p_partkey, (p_partkey % 600) / 10.0::DOUBLE AS ts, (p_size % 4)::INT AS n, (p_partkey % 997) / 1000.0::DOUBLE AS cov FROM part)
    SELECT p_brand, coalesce('TEXT DETECTION (OCR Pre-Processing):' || chr(10) || string_agg(printf('  Frame @ %.1fs: %d text regions, %.1f%% coverage', ts, n, cov * 100) || chr(10), '' ORDER BY ts, p_partkey) FILTER (WHERE n > 0), '') AS context FROM b GROUP BY p_brand""")
def f_text_context(spark: SparkSession, d: str) -> DataFrame:
    """What detectors found of text in a group's frames (here: parts of a brand), as lines of a prompt."""
    k = F.col("p_partkey")
    n = (F.col("p_size") % 4).cast("int")
    x = F.struct(((k % 600) / F.lit(10.0)).alias("ts"), k.alias("k"), (n > 0).alias("has_text"), n.alias("regions"), ((k % 997) / F.lit(1000.0)).alias("coverage"))
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(x)).alias("xs")).select("p_brand", P.text_found(F.col("xs")).alias("context"))


# ---- replies


_REPLY = """r AS (SELECT result_id, CASE result_id % 6 WHEN 0 THEN result_doc WHEN 1 THEN concat('```json', chr(10), result_doc, chr(10), '```') WHEN 2 THEN concat('Here it is: ', result_doc, ' That is all.')
    WHEN 3 THEN concat('Result: {"items": [1, 2,], "id": ', result_id, ', }') WHEN 4 THEN 'nothing to be found' ELSE concat('```', chr(10), '{"a": {"b": ', result_id, '}}', '```') END AS reply FROM (SELECT DISTINCT result_id, result_doc FROM video_results WHERE result_doc IS NOT NULL))"""


@query(f"""WITH {_REPLY}, t AS (SELECT result_id, reply, regexp_extract(reply, '(?s)```(?:json)?\\s*(.*?)```', 1) AS fenced, regexp_extract(reply, '(?s)(\\{{.*\\}})', 1) AS braces FROM r)
    SELECT result_id, CASE WHEN reply <> '' AND json_valid(reply) THEN 1 WHEN fenced <> '' AND json_valid(fenced) THEN 2 WHEN braces <> '' AND json_valid(braces) AND NOT regexp_matches(braces, ',\\s*[}}\\]]') THEN 3
    WHEN braces <> '' AND json_valid(regexp_replace(braces, ',\\s*([}}\\]])', '\\1', 'g')) THEN 4 ELSE 0 END AS tier FROM t""")
def f_parse_reply(spark: SparkSession, d: str) -> DataFrame:
    """Which of the four ways a reply can be read: as it is, its fenced block, its braces, without trailing commas; 0 for none.
    The documents, wrapped in different ways, stand in for replies."""
    v = table(spark, d, "video_results").where("result_doc IS NOT NULL").select("result_id", "result_doc").distinct()
    i, doc = F.col("result_id"), F.col("result_doc")
    text = lambda *x: F.concat(*[y if isinstance(y, Column) else F.lit(y) for y in x])
    ways = [doc, text("```json\n", doc, "\n```"), text("Here it is: ", doc, " That is all."), text('Result: {"items": [1, 2,], "id": ', i.cast("string"), ", }"), F.lit("nothing to be found"), text('```\n{"a": {"b": ', i.cast("string"), "}}```")]
    reply = F.element_at(F.array(*ways), (i % 6 + 1).cast("int"))
    return v.select("result_id", X.reply_tier(reply).alias("tier"))


_PAIR = f"""{ABLATION}, m AS (SELECT * FROM a WHERE method = 'uniform_1.0fps' QUALIFY row_number() OVER (PARTITION BY video ORDER BY metric_id) = 1),
    g AS (SELECT * FROM a WHERE method = 'scene_midpoint' QUALIFY row_number() OVER (PARTITION BY video ORDER BY metric_id) = 1)"""


@query(f"""WITH {_PAIR} SELECT m.metric_id, CASE WHEN e IS NULL THEN contains(x, y) OR contains(y, x) END AS brand_match, CASE WHEN e IS NULL THEN m.extraction_data.promotion.promo_present END AS promo_detected, CASE WHEN e IS NULL THEN m.extraction_data.call_to_action.cta_present END AS cta_detected,
    CASE WHEN e IS NULL THEN m.extraction_data.sentiment.primary_sentiment_id = g.extraction_data.sentiment.primary_sentiment_id END AS topic_match, CASE WHEN e IS NULL THEN m.extraction_data.engagement_metrics.effectiveness_score END AS effectiveness, e AS error
    FROM (SELECT *, CASE WHEN extraction_data IS NULL OR extraction_error IS NOT NULL THEN coalesce(extraction_error, 'unknown') END AS e, lower(trim(extraction_data.brand.brand_name_text)) AS x FROM m) m JOIN (SELECT *, lower(trim(extraction_data.brand.brand_name_text)) AS y FROM g) g USING (video)""")
def f_compare_extractions(spark: SparkSession, d: str) -> DataFrame:
    """A method's record beside the reference's: five fields, or nulls and the error of a failed one. The sentiment's
    number stands in for the topic's."""
    a = _records(spark, d).select("metric_id", "video", "method", "extraction_error", F.col("extraction_data").alias("x"))
    first = lambda m: a.where(F.col("method") == m).groupBy("video").agg(F.min_by(F.struct("metric_id", "extraction_error", "x"), "metric_id").alias("r"))
    j = first("uniform_1.0fps").alias("m").join(first("scene_midpoint").alias("g"), "video")
    x, y = F.col("m.r.x"), F.col("g.r.x")
    error = F.when(x.isNull() | F.col("m.r.extraction_error").isNotNull(), F.coalesce("m.r.extraction_error", F.lit("unknown")))
    return j.select(F.col("m.r.metric_id").alias("metric_id"), *X.compared(x, y, error, x["sentiment"]["primary_sentiment_id"], y["sentiment"]["primary_sentiment_id"]))


@query(f"""WITH {ABLATION} SELECT metric_id, CASE WHEN method LIKE 'uniform%' THEN 'uniform' ELSE method END AS ad_type, extraction_data.brand.brand_name_text AS brand_name, extraction_data.product.product_name AS product_name, extraction_data.product.industry AS industry,
    extraction_data.message.primary_message AS primary_message, extraction_data.call_to_action.cta_type AS cta_type, array_to_string(coalesce(extraction_data.visual_elements.text_overlays, []), '|') AS text_overlays, len(coalesce(extraction_data.visual_elements.text_overlays, []))::INT AS text_overlays_count,
    array_to_string(coalesce(extraction_data.persuasion_techniques, []), '|') AS persuasion_techniques, extraction_data.promotion.promo_present AS promo_present, extraction_data.promotion.promo_text AS promo_text FROM a WHERE extraction_data IS NOT NULL""")
def f_key_fields(spark: SparkSession, d: str) -> DataFrame:
    """The eleven fields of a record that are compared by eye; lists that are missing are empty."""
    a = _records(spark, d).where("extraction_data IS NOT NULL")
    kind = F.when(F.col("method").startswith("uniform"), "uniform").otherwise(F.col("method"))
    cols = X.key_fields(F.col("extraction_data"), kind)
    joined = lambda n, c: F.array_join(c, "|").alias(n) if n in ("text_overlays", "persuasion_techniques") else c.alias(n)
    return a.select("metric_id", *[joined(n, c) for n, c in cols.items()])


_TOPIC = ", ".join(f"({i}, '{n}')" for i, n in enumerate(taxonomy.TOPICS, 1))


@query(f"WITH t(id, topic) AS (VALUES {_TOPIC}) SELECT DISTINCT metric_id, coalesce(topic, 'Unknown') AS topic, TRY_CAST(concat(metric_id % 45, CASE WHEN metric_id % 7 = 0 THEN 'x' ELSE '' END) AS INT) = (metric_id % 3)::INT AS matches FROM ablation_metrics LEFT JOIN t ON t.id = metric_id % 45")
def c19_f_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics by number, unknown ones named so; numbers that don't read as such match nothing."""
    i = F.col("metric_id")
    a = table(spark, d, "ablation_metrics").select("metric_id").distinct()
    names = taxonomy.names(spark, taxonomy.TOPICS, "topic")  # 38 rows
    typed = F.concat((i % 45).cast("string"), F.when(i % 7 == 0, "x").otherwise(""))
    j = a.join(F.broadcast(names), (i % 45) == names["id"], "left")
    return j.select("metric_id", F.coalesce("topic", F.lit("Unknown")).alias("topic"), X.same_integer(typed, (i % 3).cast("string")).alias("matches"))


_AD = "[" + ", ".join(f"'{k}'" for k in taxonomy.AD_TYPES) + "]"


@query(f"""WITH x AS (SELECT DISTINCT method, replace(lower(trim(method)), ' ', '_') AS m FROM benchmark_results WHERE method IS NOT NULL UNION SELECT ' Product Demo', 'product_demo' UNION SELECT 'a tutorial', 'a_tutorial' UNION SELECT 'brand', 'brand')
    SELECT method, CASE WHEN list_contains({_AD}, m) THEN m WHEN m <> '' THEN coalesce(list_filter({_AD}, lambda a: contains(m, a) OR contains(a, m))[1], 'brand_awareness') ELSE 'brand_awareness' END AS ad_type FROM x""")
def f_ad_types(spark: SparkSession, d: str) -> DataFrame:
    """Free names as one of the known types: exact after normalising, else the first that holds it or is in it, else a default."""
    own = table(spark, d, "benchmark_results").where("method IS NOT NULL").select("method").distinct()
    x = own.unionAll(spark.createDataFrame([(" Product Demo",), ("a tutorial",), ("brand",)], "method string")).distinct()
    return x.select("method", X.one_of(F.col("method"), taxonomy.AD_TYPES, "brand_awareness").alias("ad_type"))


_KEYS = "[" + ", ".join(f"'{k}'" for k in taxonomy.KEYWORDS) + "]"


@query(f"""WITH x AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, unnest(range(len(string_split(text, '. ')))) AS i, string_split(text, '. ') AS parts FROM x)
    SELECT doc_id, i::INT AS segment, i + 0.5::DOUBLE AS at, list_filter({_KEYS}, lambda k: contains(lower(parts[i + 1]), k))[1] AS keyword FROM g WHERE len(list_filter({_KEYS}, lambda k: contains(lower(parts[i + 1]), k))) > 0""")
def f_key_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The first keyword of each segment of a transcript, at the middle of its time; one at most a segment.
    Sentences stand in for segments of a second each."""
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text").distinct()
    s = t.select("doc_id", F.posexplode(F.split("text", r"\. ", -1)).alias("segment", "said"))
    return s.select("doc_id", "segment", (F.col("segment") + F.lit(0.5)).alias("at"), X.first_keyword(F.col("said"), taxonomy.KEYWORDS).alias("keyword")).where("keyword IS NOT NULL")


@query("SELECT DISTINCT doc_id, base64(encode(text)) AS encoded FROM documents WHERE text IS NOT NULL")
def f_base64(spark: SparkSession, d: str) -> DataFrame:
    """Contents as base64, as they go into a request."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.replace(F.base64(F.encode("text", "UTF-8")), F.lit("\r\n"), F.lit("")).alias("encoded")).distinct()


# ---- features, contexts


_AREA = "(1280 * 720)::DOUBLE"


@query(f"""WITH b AS (SELECT p_brand, p_partkey, p_size * 6 AS w, p_partkey % 40 + 1 AS h FROM part) SELECT p_brand, count_if(w / greatest(h, 1)::DOUBLE > 1.5 AND w * h / {_AREA} > 0.001 AND w * h / {_AREA} < 0.3 AND h > 8 AND w > 20) AS regions, count_if(w / greatest(h, 1)::DOUBLE > 1.5 AND w * h / {_AREA} > 0.001 AND w * h / {_AREA} < 0.3 AND h > 8 AND w > 20) >= 1 AS has_text FROM b GROUP BY p_brand""")
def b11_text_presence(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of a frame (here: parts of a brand) that look like text by shape and share of the frame; one is enough."""
    b = table(spark, d, "part").select("p_brand", (F.col("p_size") * 6).alias("w"), (F.col("p_partkey") % 40 + 1).alias("h"))
    n = F.count_if(X.text_region(F.col("w"), F.col("h"), 1280.0 * 720.0))
    return b.groupBy("p_brand").agg(n.alias("regions"), (n >= 1).alias("has_text"))


@query(f"""WITH {CANDIDATES_SQL}, v AS (SELECT video_id, floor(ts * 30)::BIGINT AS frame_no, bool_or(candidate_id % 3 = 0) AS has_text, bool_or(candidate_id % 5 = 0) AS has_face, max(CASE WHEN importance_score > 1.5 THEN 'medium' ELSE 'low' END) AS text_density FROM c WHERE candidate_id % 4 <> 0 GROUP BY ALL)
    SELECT candidate_id, coalesce(has_text, false) AS has_text, coalesce(has_face, false) AS has_face, coalesce(text_density, 'low') AS text_density FROM c LEFT JOIN v ON v.video_id = c.video_id AND v.frame_no = floor(c.ts * 30)""")
def b14_c8_feature_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Features of a frame by video and frame number; a frame whose detection failed has the defaults."""
    c = candidates(spark, d, False).withColumn("frame_no", F.floor(F.col("ts") * 30))
    i = F.col("candidate_id")
    v = c.where(i % 4 != 0).groupBy("video_id", "frame_no").agg(F.bool_or(i % 3 == 0).alias("has_text"), F.bool_or(i % 5 == 0).alias("has_face"), F.max(F.when(F.col("importance_score") > 1.5, "medium").otherwise("low")).alias("text_density"))
    return c.join(v, ["video_id", "frame_no"], "left").select("candidate_id", *X.features_or_default("has_text", "has_face", "text_density"))


@query(f"WITH {CANDIDATES_SQL}, best AS (SELECT candidate_id FROM c QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY importance_score DESC, candidate_id) <= 3) SELECT candidate_id, round(sqrt(list_dot_product(e, e)), 5) AS length FROM best JOIN c USING (candidate_id)")
def a14_late_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Selection over narrow rows; only what is selected is then read with its vector, by key."""
    order = Window.partitionBy("video_id").orderBy(F.desc("importance_score"), "candidate_id")
    best = candidates(spark, d, False).withColumn("k", F.row_number().over(order)).where("k <= 3").select("candidate_id")
    full = candidates(spark, d).select("candidate_id", "embedding")
    return best.join(full, "candidate_id").select("candidate_id", F.round(X.norm(F.col("embedding")), 5).alias("length"))


@query(f"""{EV}, v AS (SELECT DISTINCT video FROM f), g AS (SELECT video, count_if(kind = 'purchase') AS n_peaks, count_if(kind = 'error') AS n_silences, count_if(kind = 'signup') AS n_speech, min(t) FILTER (WHERE kind = 'purchase') AS first_peak, max(t + 5) FILTER (WHERE kind = 'signup') AS speech_until, avg(value) AS m, stddev_pop(value) / 1000 AS rms, max(value) * 6 AS br, bool_or(kind = 'click') AS heard FROM f GROUP BY 1)
    SELECT video, n_peaks, n_silences, n_speech, n_speech > 0 AS has_speech, first_peak, speech_until, CASE WHEN NOT heard THEN 'unknown' WHEN 60 + m * 1.5 > 140 AND rms > 0.05 THEN 'energetic' WHEN 60 + m * 1.5 > 120 AND br > 2000 THEN 'upbeat' WHEN 60 + m * 1.5 < 80 AND rms < 0.03 THEN 'calm' WHEN rms > 0.08 THEN 'dramatic' WHEN 60 + m * 1.5 < 90 THEN 'melancholic' ELSE 'neutral' END AS mood FROM g""")
def e28_audio_context(spark: SparkSession, d: str) -> DataFrame:
    """The context of each video's sound, assembled from child tables: empty lists where nothing was found, an
    unknown mood where the sound couldn't be read (here: videos without a click). Event kinds stand in for sounds."""
    f = frames(spark, d)
    t = F.col("t")
    segment = lambda n: F.struct(t.alias("start"), (t + n).alias("end"))
    of = lambda kind: f.where(F.col("kind") == kind)
    moods = f.groupBy("video").agg(X.mood(60 + F.avg("value") * 1.5, F.stddev_pop("value") / 1000, F.max("value") * 6).alias("mood")).join(of("click").select("video").distinct(), "video", "left_semi")
    c = audio_context(f.select("video").distinct(), "video", of("purchase").select("video", "t"), of("error").select("video", segment(2).alias("s")), of("signup").select("video", segment(5).alias("s")), moods)
    last = F.array_max(F.transform("speech", lambda s: s["end"]))
    return c.select("video", F.size("peaks").cast("bigint").alias("n_peaks"), F.size("silences").cast("bigint").alias("n_silences"), F.size("speech").cast("bigint").alias("n_speech"), "has_speech", F.array_min("peaks").alias("first_peak"), last.alias("speech_until"), "mood")


def audio_context(videos: DataFrame, key: str, peaks: DataFrame, silences: DataFrame, speech: DataFrame, moods: DataFrame) -> DataFrame:
    """(key, peaks, silences, speech, has_speech, mood): one row a video, its children as sorted arrays.

    A video's sounds are one row by definition; each child table is aggregated by itself.
    """
    listed = lambda c, x, n: c.groupBy(key).agg(F.array_sort(F.collect_list(x)).alias(n))
    out = videos.join(listed(peaks, "t", "peaks"), key, "left").join(listed(silences, "s", "silences"), key, "left").join(listed(speech, "s", "speech"), key, "left").join(moods, key, "left")
    empty = lambda n: F.coalesce(n, F.array().cast(out.schema[n].dataType)).alias(n)
    return out.select(key, empty("peaks"), empty("silences"), empty("speech"), (F.coalesce(F.size("speech"), F.lit(0)) > 0).alias("has_speech"), F.coalesce("mood", F.lit("unknown")).alias("mood"))


# ---- scenes


def _bounds_sql(name: str, threshold: float) -> str:
    return f"""{name} AS (SELECT video, frame, rn, 0.0::DOUBLE AS last, false AS cut, t FROM o WHERE rn = 1 UNION ALL SELECT o.video, o.frame, o.rn, CASE WHEN z THEN o.t ELSE r.last END, z, o.t FROM {name} r JOIN o ON o.video = r.video AND o.rn = r.rn + 1, LATERAL (SELECT abs(o.value - o.p) > {threshold} AND o.t - r.last >= 12 AS z))"""


_O = "o AS (SELECT *, row_number() OVER w AS rn, lag(value) OVER w AS p FROM f WINDOW w AS (PARTITION BY video ORDER BY t, frame)), v AS (SELECT video, max(t) AS dur FROM f GROUP BY 1)"


def _scenes_sql(name: str, of: str) -> str:
    return f"{name} AS (SELECT video, b AS start, coalesce(lead(b) OVER (PARTITION BY video ORDER BY b), dur) AS \"end\" FROM (SELECT video, t AS b FROM {of} WHERE cut UNION ALL SELECT video, 0.0::DOUBLE FROM v) JOIN v USING (video))"


def boundaries(f: DataFrame, threshold: float, least: float) -> DataFrame:
    """(video, t): times of changes above the threshold, at least ``least`` after the boundary before; 0 is the first."""
    def start() -> Gate:
        g = Gate(least, threshold)
        g.last, g.before = 0.0, float("nan")  # nothing is compared with the first frame
        return g

    return walk(f, ["video"], [F.col("t"), F.col("frame")], start, ["at"], t=F.col("t"), x=F.col("value")).select("video", F.col("at").alias("t"))


def as_scenes(bounds: DataFrame, lengths: DataFrame) -> DataFrame:
    """(video, start, end): from each boundary, 0 among them, to the next, the last to the end."""
    every = bounds.select("video", F.col("t").alias("start")).unionByName(lengths.select("video", F.lit(0.0).alias("start")))
    end = F.lead("start").over(Window.partitionBy("video").orderBy("start"))
    return every.join(lengths, "video").select("video", "start", F.coalesce(end, F.col("dur")).alias("end"))


@query(f"WITH RECURSIVE {FRAMES_SQL}, {_O}, {_bounds_sql('r', 120)}, {_scenes_sql('s', 'r')} SELECT * FROM s")
def e29_fallback_scenes(spark: SparkSession, d: str) -> DataFrame:
    """Scenes from changes alone, where no detector answers: a hard threshold and a least length."""
    f = frames(spark, d)
    return as_scenes(boundaries(f.withColumn("at", F.col("t")), 120.0, 12.0), f.groupBy("video").agg(F.max("t").alias("dur")))


@query(f"""WITH RECURSIVE {FRAMES_SQL}, {_O}, {_bounds_sql('r1', 250)}, {_bounds_sql('r2', 200)}, {_scenes_sql('s1', 'r1')}, {_scenes_sql('s2', 'r2')},
    h1 AS (SELECT DISTINCT video FROM r1 WHERE cut), h2 AS (SELECT DISTINCT video FROM r2 WHERE cut)
    SELECT 1 AS tier, * FROM s1 WHERE video IN (FROM h1) UNION ALL SELECT 2, * FROM s2 WHERE video IN (FROM h2) AND video NOT IN (FROM h1)
    UNION ALL SELECT 3, video, k * 10.0::DOUBLE, least((k + 1) * 10.0::DOUBLE, dur) FROM v, LATERAL (SELECT unnest(range(greatest(1, ceil(dur / 10)::BIGINT))) AS k) WHERE video NOT IN (FROM h1) AND video NOT IN (FROM h2)""")
def e30_scene_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Scenes by the usual threshold; for videos without any by a lower one; for those still without in chunks of ten."""
    f = frames(spark, d).withColumn("at", F.col("t"))
    lengths = f.groupBy("video").agg(F.max("t").alias("dur"))
    one, two = boundaries(f, 250.0, 12.0), boundaries(f, 200.0, 12.0)
    h1, h2 = one.select("video").distinct(), two.select("video").distinct()
    s1 = as_scenes(one, lengths).join(h1, "video", "left_semi")
    s2 = as_scenes(two, lengths).join(h2, "video", "left_semi").join(h1, "video", "left_anti")
    rest = lengths.join(h1, "video", "left_anti").join(h2, "video", "left_anti")
    k = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("dur") / 10)).cast("int") - 1))
    s3 = rest.select("video", "dur", k.alias("k")).select("video", (F.col("k") * F.lit(10.0)).alias("start"), F.least((F.col("k") + 1) * F.lit(10.0), F.col("dur")).alias("end"))
    tier = lambda s, n: s.select(F.lit(n).alias("tier"), "video", "start", "end")
    return tier(s1, 1).unionAll(tier(s2, 2)).unionAll(tier(s3, 3))


QUERIES, SQL = query.queries, query.sql
