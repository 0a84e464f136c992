"""Pure Column expressions: vectors, signatures, thresholds, scores, text rules. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for null vectors, 0 where one has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).when(n.isNotNull(), 0.0)


def euclidean(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return norm(d)


def mean_abs_diff(a: Column, b: Column, scale: float = 1.0) -> Column:
    d = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return d / F.size(a) / scale


def chi_square(previous: Column, current: Column) -> Column:
    """Sum of (p - c)^2 / p over bins where p is not 0: asymmetric, the earlier histogram divides."""
    parts = F.zip_with(previous, current, lambda p, c: F.when(p != 0, (p - c) * (p - c) / p).otherwise(0.0))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def l2_normalised(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(0.0))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two arrays; null where one is constant."""
    n = F.size(a)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    ma, mb = total(a) / n, total(b) / n
    da, db = F.transform(a, lambda x: x - ma), F.transform(b, lambda x: x - mb)
    n2 = F.sqrt(dot(da, da) * dot(db, db))
    return F.when(n2 > 0, dot(da, db) / n2)


# ---- bit signatures


def pack_bits(flags: Column) -> Column:
    """An array of booleans (64 at most) as one BIGINT, the first flag in the highest place."""
    return F.aggregate(flags, F.lit(0).cast("bigint"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(F.when(b, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint"))))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def edge_change(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) / F.greatest(F.bit_count(a), F.bit_count(b), F.lit(1))


def votes(pairs: Sequence[tuple[Column, Column, int]], min_votes: int = 2) -> Column:
    """Whether enough signatures are nearer than their thresholds (strictly); min_votes within 1..all."""
    need = max(1, min(min_votes, len(pairs)))
    total = sum((F.when(hamming(a, b) < t, 1).otherwise(0) for a, b, t in pairs), F.lit(0))
    return total >= need


# ---- thresholds and scores


def decay_threshold(dt: Column, base: float = 0.88, scale: float = 0.3, tau: float = 5.0) -> Column:
    """Similarity needed to suppress: grows with the distance in time, above 1 nothing is suppressed."""
    return F.lit(base) * (1 + scale * (1 - F.exp(-dt / tau)))


def adaptive_threshold(mean: Column, spread: Column, seen: Column, base: float = 0.15, window: int = 30) -> Column:
    return F.when(seen < window, F.lit(base)).otherwise(F.least(F.lit(2 * base), F.greatest(F.lit(base / 2), mean + spread)))


def relative_position(ts: Column, duration: Column) -> Column:
    return F.when(duration > 0, ts / duration)


def position_score(ts: Column, duration: Column) -> Column:
    p = relative_position(ts, duration)
    return F.when(p.isNull(), 1.0).when(p < 0.1, 1.5).when(p > 0.9, 1.4).when((p > 0.4) & (p < 0.6), 1.1).otherwise(1.0)


def position_label(ts: Column, duration: Column) -> Column:
    p = F.coalesce(relative_position(ts, duration), F.lit(0.0))
    return F.when(p < 0.15, "OPENING").when(p > 0.85, "CLOSING").when((p > 0.4) & (p < 0.6), "MIDDLE")


def scene_score(ts: Column, start: Column, end: Column) -> Column:
    length = end - start
    p = F.when(length > 0, (ts - start) / length)
    return F.when(p.isNull(), 1.0).when(p < 0.15, 1.4).when(p > 0.85, 1.2).otherwise(1.0)


def near_peak(ts: Column, peaks: Column, within: float) -> Column:
    return F.exists(peaks, lambda p: F.abs(ts - p) < within)


def after_silence(ts: Column, segments: Column, within: float) -> Column:
    return F.exists(segments, lambda s: (ts >= s["end"]) & (ts < s["end"] + within))


def speech_boundary(ts: Column, segments: Column, within: float) -> Column:
    """Factor of the first segment in list order that starts or ends near: 1.2 for its start, else 1.15."""
    near = lambda s: F.when(F.abs(ts - s["start"]) < within, 1.2).when(F.abs(ts - s["end"]) < within, 1.15)
    hit = F.get(F.filter(F.transform(segments, near), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(hit, F.lit(1.0))


def audio_score(ts: Column, peaks: Column, silences: Column, speech: Column, phrases: Column, within: float = 0.5, phrase_boost: float = 1.5) -> Column:
    return (
        F.when(F.coalesce(near_peak(ts, peaks, within), F.lit(False)), 1.3).otherwise(1.0)
        * F.when(F.coalesce(after_silence(ts, silences, within), F.lit(False)), 1.4).otherwise(1.0)
        * speech_boundary(ts, F.coalesce(speech, F.slice(silences, 1, 0)), within)
        * F.when(F.coalesce(near_peak(ts, phrases, within), F.lit(False)), phrase_boost).otherwise(1.0)
    )


def visual_score(has_text: Column, has_face: Column, has_logo: Column) -> Column:
    one = lambda c, f: F.when(c, f).otherwise(1.0)
    return one(has_text, 1.3) * one(has_face, 1.2) * one(has_logo, 1.4)


def text_density(edge_ratio: Column) -> Column:
    return F.when(edge_ratio > 0.15, "high").when(edge_ratio > 0.05, "medium").otherwise("low")


def scene_allocation(duration: Column, density: Column, count: Column, least: int = 2, most: int = 10) -> Column:
    """Frames a scene gets: its time times the density within limits, never more than it has."""
    want = F.greatest(F.lit(1), F.floor(duration * density))
    return F.when(count <= F.greatest(F.lit(least), F.least(want, F.lit(most), count)), count).otherwise(F.greatest(F.lit(least), F.least(want, F.lit(most), count)))


def adaptive_density(base: float, variance: Column, most_important: Column, count: Column) -> Column:
    d = F.lit(base) * F.when(variance > 0.15, 1.3).when(variance < 0.05, 0.7).otherwise(1.0)
    return F.when(count < 2, F.lit(base)).otherwise(d * F.when(most_important > 1.5, 1.2).otherwise(1.0))


def static_budget(duration: Column, density: float = 0.25, most: int = 25) -> Column:
    return F.least(F.greatest(F.lit(5), F.floor(duration * density)), F.lit(most))


def dynamic_budget(scenes: Column, duration: Column, density: float, mean_step: Column, mean_importance: Column, dimension: Column) -> Column:
    """Budget from intrinsic dimension, motion and importance, never under a base of scenes + 1 or 5.

    Without two frames (a null step) the motion counts as 1.
    """
    base = F.greatest(F.lit(5), scenes + 1)
    motion = F.when(mean_step.isNull(), 1.0).otherwise(F.greatest(F.lit(0.2), 2.5 * mean_step))
    raw = base + duration * density * motion * mean_importance
    return F.least((base + 1.5 * dimension).cast("int"), F.greatest(base, raw.cast("int"))).cast("int")


def reduction_rate(total: Column, final: Column) -> Column:
    return F.when(total > 0, 1 - final / total).otherwise(0.0)


def confidence(total: Column, filled: Column, has_audio: Sequence[Column], frames: Column, failed: Column) -> Column:
    complete = F.when(total > 0, filled / total).otherwise(0.0)
    audio = sum((F.when(c, w).otherwise(0.0) for c, w in zip(has_audio, (0.1, 0.1, 0.05))), F.lit(0.0))
    by_frames = F.when(frames >= 5, 0.25).when(frames >= 3, 0.15).when(frames >= 1, 0.05).otherwise(0.0)
    return F.when(failed, 0.0).otherwise(F.least(F.lit(1.0), 0.5 * complete + audio + by_frames))


def mood(tempo: Column, loudness: Column, brightness: Column) -> Column:
    return (
        F.when((tempo > 140) & (loudness > 0.05), "energetic")
        .when((tempo > 120) & (brightness > 2000), "upbeat")
        .when((tempo < 80) & (loudness < 0.03), "calm")
        .when(loudness > 0.08, "dramatic")
        .when(tempo < 90, "melancholic")
        .otherwise("neutral")
    )


# ---- text

#: Codes looked for in error messages, in this order.
ERROR_CODES = ("429", "504", "503", "500", "403", "401")


def error_code(message: Column) -> Column:
    out = F.lit(None).cast("string")
    for code in reversed(ERROR_CODES):
        out = F.when(message.contains(code), code).otherwise(out)
    return out


def names_match(a: Column, b: Column) -> Column:
    """Either name, trimmed and in lower case, holds the other; null if one is null. An empty name is in all."""
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    return F.contains(x, y) | F.contains(y, x)


def same_integer(a: Column, b: Column) -> Column:
    return a.try_cast("int") == b.try_cast("int")


def binary_label(score: Column) -> Column:
    return F.when(score >= 0.7, 1).when(score <= 0.3, 0).otherwise(-1)


def first_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """The first keyword of the list, in its order, that stands in the text."""
    low = F.lower(text)
    return F.get(F.filter(F.array(*map(F.lit, keywords)), lambda k: low.contains(k)), F.lit(0))


def one_of(value: Column, allowed: Sequence[str], default: str) -> Column:
    """The allowed name a free value means: exact after normalising, else the first that holds it or is in it."""
    x = F.replace(F.lower(F.trim(value)), F.lit(" "), F.lit("_"))
    exact = F.when(x.isin(*allowed), x)
    near = F.get(F.filter(F.array(*map(F.lit, allowed)), lambda a: x.contains(a) | a.contains(x)), F.lit(0))
    return F.coalesce(exact, F.when(x != "", near), F.lit(default))


def _readings(text: Column) -> list[Column]:
    """A reply as it is, its fenced block, its outermost braces, and these without trailing commas; null where there are none."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    fixed = F.regexp_replace(braces, r",\s*([}\]])", "$1")
    return [F.nullif(t, F.lit("")) for t in (text, fenced, braces, fixed)]


def parse_reply(text: Column) -> Column:
    """A model's reply as VARIANT, by the first reading that is JSON; null if none is."""
    return F.coalesce(*[F.try_parse_json(t) for t in _readings(text)])


def reply_tier(text: Column) -> Column:
    """Which reading of a reply is JSON, from 1; 0 if none is."""
    tiers = [F.when(F.try_parse_json(t).isNotNull(), i) for i, t in enumerate(_readings(text), 1)]
    return F.coalesce(*tiers, F.lit(0))


def compared(own: Column, reference: Column, error: Column, topic: Column, reference_topic: Column) -> list[Column]:
    """Five fields of a record beside the reference's: whether brands and topics match, what was found; nulls with an error."""
    ok = lambda c, n: F.when(error.isNull(), c).alias(n)
    return [
        ok(names_match(own["brand"]["brand_name_text"], reference["brand"]["brand_name_text"]), "brand_match"),
        ok(own["promotion"]["promo_present"], "promo_detected"),
        ok(own["call_to_action"]["cta_present"], "cta_detected"),
        ok(same_integer(topic.cast("string"), reference_topic.cast("string")), "topic_match"),
        ok(own["engagement_metrics"]["effectiveness_score"], "effectiveness"),
        error.alias("error"),
    ]


def key_fields(x: Column, kind: Column) -> dict[str, Column]:
    """The fields of a record that are set beside each other; missing lists are empty."""
    none = F.array().cast("array<string>")
    overlays, persuasion = F.coalesce(x["visual_elements"]["text_overlays"], none), F.coalesce(x["persuasion_techniques"], none)
    return {
        "ad_type": kind, "brand_name": x["brand"]["brand_name_text"], "product_name": x["product"]["product_name"], "industry": x["product"]["industry"],
        "primary_message": x["message"]["primary_message"], "cta_type": x["call_to_action"]["cta_type"], "text_overlays": overlays, "text_overlays_count": F.size(overlays),
        "persuasion_techniques": persuasion, "promo_present": x["promotion"]["promo_present"], "promo_text": x["promotion"]["promo_text"],
    }


def text_region(width: Column, height: Column, area: float) -> Column:
    """Whether a box looks like text: wide, neither tiny nor most of the frame."""
    share = width * height / F.lit(area)
    return (width / F.greatest(height, F.lit(1)) > 1.5) & (share > 0.001) & (share < 0.3) & (height > 8) & (width > 20)


def features_or_default(has_text: str, has_face: str, density: str) -> list[Column]:
    """Detected features, or what a failed detection counts as."""
    return [F.coalesce(has_text, F.lit(False)).alias(has_text), F.coalesce(has_face, F.lit(False)).alias(has_face), F.coalesce(density, F.lit("low")).alias(density)]


def unwrap_list(value: Column) -> Column:
    """JSON text of a reply that came as a list: its only object, else an object with the list as items."""
    as_text = F.to_json(value)
    is_list = F.schema_of_variant(value).startswith("ARRAY")
    n = F.json_array_length(as_text)
    only = F.try_variant_get(value, "$[0]", "variant")
    return F.when(~is_list, as_text).when((n == 1) & F.schema_of_variant(only).startswith("OBJECT"), F.to_json(only)).otherwise(F.concat(F.lit('{"items":'), as_text, F.lit("}")))
