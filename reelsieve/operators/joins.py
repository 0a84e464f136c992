"""Range and nearest joins as equi-joins on buckets, so that Spark never plans a nested loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Every pair of a point and an interval of equal keys with start <= at < end.

    Intervals stand in all buckets of ``width`` they touch, points in one; a bucket of about the
    typical interval keeps both small. Null bounds and points match nothing.
    """
    i = intervals.where(F.col(start).isNotNull() & (F.col(end) > F.col(start)))
    i = i.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    return p.join(i, [*keys, "__b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__b")


def first_match(points: DataFrame, intervals: DataFrame, keys: Sequence[str], row: str, at: str, start: str, end: str, label: str, width: float, nearest: bool = True) -> DataFrame:
    """Each point with the least label of the intervals that hold it; else of the nearest one by its bounds.

    The fallback runs over the points without a match only: the bounds before and after a point are found
    in one pass over points and bounds in order, so no point meets more than two of them. Of intervals
    equally near the least label counts. Keys without intervals, and null points, give null.
    """
    hit = range_join(points.select(*keys, row, at), intervals.select(*keys, start, end, label), keys, at, start, end, width)
    hit = hit.groupBy(row).agg(F.min(label).alias(label))
    out = points.join(hit, row, "left")
    if not nearest:
        return out
    far = out.where(F.col(label).isNull() & F.col(at).isNotNull()).select(*keys, F.col(at).alias("__t"), F.col(row).alias("__row"))
    bounds = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, F.explode(F.array(start, end)).alias("__t"), F.col(label).alias("__l")).groupBy(*keys, "__t").agg(F.min("__l").alias("__l"))
    none = F.lit(None)
    both = far.select(*keys, "__t", "__row", none.cast("double").alias("__b"), none.cast(intervals.schema[label].dataType).alias("__l")).unionByName(bounds.select(*keys, "__t", none.cast(points.schema[row].dataType).alias("__row"), F.col("__t").cast("double").alias("__b"), "__l"))
    # a bound at the point's own time comes before it, whichever way the rows are passed
    bound = F.when(F.col("__l").isNotNull(), F.struct("__b", "__l"))
    up, down = (Window.partitionBy(*keys).orderBy(o, F.col("__l").isNull()).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("__t"), F.desc("__t")))
    both = both.withColumn("__x", bound).withColumn("__low", F.last("__x", True).over(up)).withColumn("__high", F.last("__x", True).over(down)).where("__row IS NOT NULL")
    gap = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.struct(F.abs(F.col("__t") - F.col(f"{n}.__b")).alias("d"), F.col(f"{n}.__l").alias("l"))) for n in ("__low", "__high")]))
    far = both.select(F.col("__row").alias(row), F.array_min(gap)["l"].alias("__near"))
    return out.join(far, row, "left").withColumn(label, F.coalesce(label, "__near")).drop("__near")


def band_factors(points: DataFrame, audio: DataFrame, row: str, key: str, at: str, within: float, phrase_boost: float = 1.5, width: float = 8.0) -> DataFrame:
    """(row, sound): the product of the factors of the sounds near each point; points near none have no row.

    ``audio``: key, kind, start, end, ord. Near a peak (its start) 1.3; up to ``within`` after a silence
    1.4; near a bound of the first speech in order that has one near 1.2 for its start, else 1.15; near a
    phrase (its ``end`` as the time of the words, else its start, else 0) ``phrase_boost``. "Near" is
    strictly less than ``within``. One equi-join on time buckets: a point meets the sounds around it only.
    """
    kind, start, end = F.col("kind"), F.col("start").cast("double"), F.col("end").cast("double")
    said = F.coalesce(end, start, F.lit(0.0))
    spot = lambda t, f: F.struct(t.alias("t"), F.lit(f).alias("f"))
    spots = F.when(kind == "peak", F.array(spot(start, 1.3))).when(kind == "silence", F.array(spot(end, 1.4))).when(kind == "speech", F.array(spot(start, 1.2), spot(end, 1.15))).when(kind == "phrase", F.array(spot(said, phrase_boost)))
    a = audio.select(F.col(key), "kind", F.col("ord").alias("ord"), F.inline(spots)).where("t IS NOT NULL")
    low = F.when(F.col("kind") == "silence", F.col("t")).otherwise(F.col("t") - within)
    a = a.withColumn("__b", F.explode(F.sequence(F.floor(low / width), F.floor((F.col("t") + within) / width))))
    p = points.select(row, key, F.col(at).alias("__at")).where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("__b", F.floor(F.col("__at") / width))
    gap = F.col("__at") - F.col("t")
    near = p.join(a, [key, "__b"]).where(F.when(F.col("kind") == "silence", (F.col("__at") >= F.col("t")) & (F.col("__at") < F.col("t") + within)).otherwise(F.abs(gap) < within))
    has = lambda n, f: F.when(F.count_if(F.col("kind") == n) > 0, f).otherwise(1.0)
    speech = F.min(F.when(F.col("kind") == "speech", F.struct("ord", (-F.col("f")).alias("f"))))["f"]
    return near.groupBy(row).agg((has("peak", 1.3) * has("silence", 1.4) * F.coalesce(-speech, F.lit(1.0)) * has("phrase", phrase_boost)).alias("sound"))
