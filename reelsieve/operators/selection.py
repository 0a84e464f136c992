"""Frame selection of whole videos: scenes, importance, ends, selection within scenes, budget.

Scores and counts are worked out without the embeddings; these are joined to them by candidate, by
which they are partitioned already, and move once more for the walk by scene and once for the
numbers of a video, which are sums over stretches of its time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelsieve.functions import expr as X
from reelsieve.operators.group_models import kmeans_labels, select_hybrid
from reelsieve.operators.joins import band_factors, first_match
from reelsieve.operators.walk import Suppress, stretches, vectors, walk
from reelsieve.session import cut

#: Seconds of a bucket of the joins by range.
BUCKET = 8.0
#: Seconds of a video whose numbers are summed in one task.
STRETCH = 600.0
LEAST, MOST, DENSITY, GAP, ALIKE, SCALE, TAU, BONUS = 2, 10, 0.25, 0.5, 0.88, 0.3, 5.0, 0.1
METHODS = ("nms", "hybrid", "kmeans", "uniform")


def video_scenes(scenes: DataFrame) -> DataFrame:
    """(video_id, scene_id, start_s, end_s): one row a scene, from the first of its starts to the last of its ends."""
    return scenes.groupBy("video_id", "scene_id").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))


def scored(c: DataFrame, scenes: DataFrame, audio: DataFrame | None = None, visual: Column | None = None) -> DataFrame:
    """(candidate_id, video_id, ts, scene, imp, dur, n_scenes, first, last): importance with the ends' boost.

    ``c``: candidate_id, video_id, ts, importance_score. A frame belongs to the first scene that holds
    it, else to the nearest; without scenes to scene 0, whose place within it counts for nothing.
    ``audio``: video_id, kind (peak, silence, speech, phrase), start, end, ord; ``visual``: a factor.
    ``first`` and ``last``: frames at the times of the video's ends, which are always selected. Only the
    first frame at each of these times by id is boosted, by 2.0 and 1.8.
    """
    s = video_scenes(scenes)
    at = first_match(c, s.withColumnRenamed("scene_id", "scene"), ["video_id"], "candidate_id", "ts", "start_s", "end_s", "scene", BUCKET)
    ends = c.groupBy("video_id").agg(F.max("ts").alias("last_ts"), F.min("ts").alias("first_ts"), F.max_by("candidate_id", F.struct("ts", -F.col("candidate_id"))).alias("last_id"), F.min_by("candidate_id", F.struct("ts", "candidate_id")).alias("first_id"))
    per_video = ends.join(s.groupBy("video_id").agg(F.max("end_s").alias("end"), F.count("*").alias("n_scenes")), "video_id", "left")
    per_video = per_video.withColumn("dur", F.greatest("last_ts", "end")).drop("end")
    at = at.join(s.withColumnRenamed("scene_id", "scene"), ["video_id", "scene"], "left").join(per_video, "video_id")
    factor = X.position_score(F.col("ts"), F.col("dur")) * X.scene_score(F.col("ts"), F.col("start_s"), F.col("end_s"))
    if visual is not None:
        factor = factor * visual
    if audio is not None:
        at = at.join(band_factors(c, audio, "candidate_id", "video_id", "ts", GAP), "candidate_id", "left")
        factor = factor * F.coalesce("sound", F.lit(1.0))
    boost = F.when(F.col("candidate_id") == F.col("first_id"), 2.0).otherwise(1.0) * F.when(F.col("candidate_id") == F.col("last_id"), 1.8).otherwise(1.0)
    return at.select(
        "candidate_id", "video_id", "ts", F.coalesce("scene", F.lit(0)).alias("scene"), (F.col("importance_score") * factor * boost).alias("imp"), "dur",
        F.coalesce("n_scenes", F.lit(0)).alias("n_scenes"), (F.col("ts") == F.col("first_ts")).alias("first"), (F.col("ts") == F.col("last_ts")).alias("last"),
    )


def _changes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(video_id, scene, total, n): sums of the mean absolute change between neighbours of a scene, in order.

    A scene's rows follow each other; one that goes on in the next batch has several rows of sums.
    """
    last_key, last = None, None
    for batch in batches:
        u = vectors(batch.column(2))
        runs = stretches(batch, 2)
        found = []
        for key, a, b in runs:
            part = u[a:b] if key != last_key else np.concatenate([last, u[a:b]])
            if len(part) > 1:
                found.append((*key, float(np.abs(np.diff(part, axis=0)).mean(axis=1).sum()), len(part) - 1))
            last_key, last = key, u[b - 1 : b]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate((pa.string(), batch.column(1).type, pa.float64(), pa.int64()))], names=["video_id", "scene", "total", "n"])


def allocated(rows: DataFrame, vectors_of: DataFrame, density: float = DENSITY, adaptive: bool = True) -> DataFrame:
    """``rows`` with ``n``, the frames their scene may keep, and ``whole``: it has no more than that.

    The density of a scene follows the mean change between its frames, of which about ten in equal steps
    are taken, and its highest importance; only those frames' vectors are looked at.
    """
    by_scene = Window.partitionBy("video_id", "scene")
    per = rows.groupBy("video_id", "scene").agg(F.count("*").alias("count"), F.greatest(F.max("ts") - F.min("ts"), F.lit(0.1)).alias("span"), F.max("imp").alias("top"))
    d = F.lit(density)
    if adaptive:
        i = F.row_number().over(by_scene.orderBy("ts", "candidate_id")) - 1
        some = rows.select("candidate_id", "video_id", "scene", "ts").withColumn("i", i).join(per.select("video_id", "scene", "count"), ["video_id", "scene"])
        some = some.where((F.col("count") <= 10) | (F.pmod("i", F.greatest(F.lit(1), F.floor(F.col("count") / 10))) == 0))
        some = some.join(vectors_of, "candidate_id").repartition(F.xxhash64(F.lit(17), "video_id", "scene")).sortWithinPartitions("video_id", "scene", "ts", "candidate_id")
        kind = rows.schema["scene"].dataType.simpleString()
        change = some.select("video_id", "scene", "v").mapInArrow(_changes, f"video_id string, scene {kind}, total double, n bigint")
        change = change.groupBy("video_id", "scene").agg((F.sum("total") / F.sum("n")).alias("variance"))
        per = per.join(change, ["video_id", "scene"], "left")
        d = X.adaptive_density(density, F.coalesce("variance", F.lit(0.0)), F.col("top"), F.col("count"))
    want = F.greatest(F.lit(1), F.floor(F.col("span") * d))
    n = F.greatest(F.lit(LEAST), F.least(want, F.lit(MOST), F.col("count")))
    per = per.select("video_id", "scene", n.cast("bigint").alias("n"), (F.col("count") <= n).alias("whole"))
    return rows.join(per, ["video_id", "scene"])


def with_vectors(rows: DataFrame, vectors_of: DataFrame) -> DataFrame:
    """Rows with their vector and ``eff``: importance, and a tenth of the largest distance to their scene's forced frames."""
    forced = rows.where(F.col("first") | F.col("last"))
    ends = forced.select("candidate_id", "video_id", "scene").join(vectors_of, "candidate_id").groupBy("video_id", "scene").agg(F.collect_list("v").alias("ends"))
    out = rows.join(ends, ["video_id", "scene"], "left").join(vectors_of, "candidate_id")
    nearest = F.array_min(F.transform("ends", lambda e: X.cosine(F.col("v"), e)))
    bonus = F.when(F.col("ends").isNull() | F.col("first") | F.col("last"), 0.0).otherwise(BONUS * (1 - F.least(F.lit(1.0), nearest)))
    return out.withColumn("eff", F.col("imp") + bonus).drop("ends")


KEPT = ["candidate_id", "ts", "imp", "dur", "n_scenes", "first", "last", "n"]


def suppressed(rows: DataFrame, scale: float = SCALE) -> DataFrame:
    """Suppression within each scene: forced frames first, then by effective score, up to ``n``; whole scenes stay."""
    order = [~(F.col("first") | F.col("last")), -F.col("eff"), F.col("ts"), F.col("candidate_id")]
    return walk(rows, ["video_id", "scene"], order, lambda: Suppress(GAP, ALIKE, scale, TAU), KEPT, v=F.col("v"), t=F.col("ts"), limit=F.when(F.col("whole"), F.lit(2**62)).otherwise(F.col("n")), forced=F.col("first") | F.col("last") | F.col("whole"))


def uniform(rows: DataFrame) -> DataFrame:
    """Forced frames, and the best frame of each of so many segments of nearly equal counts."""
    forced = F.col("first") | F.col("last") | F.col("whole")
    scene = Window.partitionBy("video_id", "scene")
    slots = rows.groupBy("video_id", "scene").agg((F.max("n") - F.count_if(forced)).alias("slots"), F.count_if(~forced).alias("regular"))
    rest = rows.where(~forced).join(slots.where("slots > 0"), ["video_id", "scene"]).withColumn("k", F.least("slots", "regular"))
    i = F.row_number().over(scene.orderBy("ts", "candidate_id")) - 1
    # the segment q with int(q m / k) <= i < int((q + 1) m / k)
    rest = rest.withColumn("i", i).withColumn("part", F.ceil((F.col("i") + 1) * F.col("k") / F.col("regular")) - 1)
    best = rest.groupBy("video_id", "scene", "part").agg(F.max_by(F.struct(*KEPT), F.struct("imp", -F.col("ts"), -F.col("candidate_id"))).alias("r"))
    return rows.where(forced).select("video_id", "scene", *KEPT).unionByName(best.select("video_id", "scene", "r.*"))


def kmeans(rows: DataFrame) -> DataFrame:
    """Forced frames, and of each of so many clusters the frame with 0.6 of importance and 0.4 of nearness to the centre."""
    rows = cut(rows)  # used several times below
    forced = F.col("first") | F.col("last") | F.col("whole")
    slots = rows.groupBy("video_id", "scene").agg((F.max("n") - F.count_if(forced)).alias("slots"), F.count_if(~forced).alias("regular"))
    rest = rows.where(~forced).join(slots.where("slots > 0"), ["video_id", "scene"]).withColumn("k", F.least("slots", "regular").cast("int"))
    own = F.struct("video_id", "scene").alias("g")
    labels = kmeans_labels(rest.select(own, "candidate_id", "v", "k"), "g", "candidate_id", "v", MOST)
    rest = cut(rest.drop("v").join(labels.select("candidate_id", "cluster", "far"), "candidate_id"))
    wide = rest.groupBy("video_id", "scene", "cluster").agg(F.max("far").alias("most"))
    score = 0.6 * F.col("imp") + 0.4 * (1 - F.col("far") / F.when(F.col("most") > 0, F.col("most")).otherwise(1.0))
    best = rest.join(wide, ["video_id", "scene", "cluster"]).groupBy("video_id", "scene", "cluster").agg(F.max_by(F.struct(*KEPT), F.struct(F.round(score, 9), -F.col("ts"), -F.col("candidate_id"))).alias("r"))
    return rows.where(forced).select("video_id", "scene", *KEPT).unionByName(best.select("video_id", "scene", "r.*"))


def hybrid(rows: DataFrame, scale: float = SCALE) -> DataFrame:
    """Suppression's frames; the best frame of each cluster without one takes the place of the worst, unless it is much worse."""
    rows = cut(rows)  # used several times below
    picks = cut(suppressed(rows, scale))
    size = rows.groupBy("video_id", "scene").agg(F.count("*").alias("m"))
    g = F.struct("video_id", "scene")
    loose = rows.where(~F.col("whole")).join(size, ["video_id", "scene"]).withColumn("k", F.least("n", "m").cast("int")).where("k >= 2")
    labels = kmeans_labels(loose.select(g.alias("g"), "candidate_id", "v", "k"), "g", "candidate_id", "v", MOST).select("candidate_id", "cluster")
    labelled = loose.drop("v").join(labels, "candidate_id").select(g.alias("g"), "candidate_id", F.col("imp").alias("score"), "cluster", (F.col("first") | F.col("last")).alias("forced"))
    labelled = cut(labelled)
    out = select_hybrid(picks.select(g.alias("g"), "candidate_id"), labelled, "g", "candidate_id", "score").select("candidate_id")
    chosen = picks.join(labelled.select("candidate_id"), "candidate_id", "left_anti").select("candidate_id").unionAll(out)
    return rows.join(chosen, "candidate_id", "left_semi").select("video_id", "scene", *KEPT)


def selected(rows: DataFrame, method: str = "nms", scale: float = SCALE, have_vectors: bool = True) -> DataFrame:
    """Frames selected in each scene by the method, one at each time of a video; an unknown method is ``uniform``."""
    method = method.lower()
    if method in ("kmeans", "hybrid") and not have_vectors:
        method = "nms"
    found = suppressed(rows, scale) if method == "nms" else hybrid(rows, scale) if method == "hybrid" else kmeans(rows) if method == "kmeans" else uniform(rows)
    return found.groupBy("video_id", "ts").agg(F.min(F.struct("scene", *KEPT)).alias("r")).select("video_id", "r.*")


def _stretch(grams: bool):
    """Sums over one stretch of a video; its rows follow each other in time: video_id, stretch, v."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, steps, first, last, gram = None, 0, 0.0, None, None, None

        def out() -> pa.RecordBatch:
            flat = [gram.tobytes()] if grams else [None]
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int64()), pa.array([n], pa.int64()), pa.array([steps]), pa.array([first.tolist()], pa.list_(pa.float64())), pa.array([last.tolist()], pa.list_(pa.float64())), pa.array(flat, pa.binary())], names=["video_id", "stretch", "n", "steps", "first", "last", "gram"])

        for batch in batches:
            u = vectors(batch.column(2))
            for key, a, b in stretches(batch, 2):
                if key != now:
                    if now is not None:
                        yield out()
                    now, n, steps, first, last, gram = key, 0, 0.0, u[a], None, np.zeros((u.shape[1] + 1, u.shape[1] + 1))
                part = u[a:b]
                if last is not None:
                    steps += float(np.linalg.norm(part[0] - last))
                steps += float(np.linalg.norm(np.diff(part, axis=0), axis=1).sum())
                n, last = n + len(part), part[-1]
                if grams:
                    one = np.c_[np.ones(len(part)), part]
                    gram += one.T @ one
        if now is not None:
            yield out()

    return run


def explained_by(gram: np.ndarray, explained: float = 0.9) -> int:
    """How many components explain the share of the variance, from sums of outer products with a leading 1."""
    n = gram[0, 0]
    if n <= 2:
        return 1
    mean = gram[0, 1:] / n
    values = np.clip(np.linalg.eigvalsh(gram[1:, 1:] - n * np.outer(mean, mean))[::-1], 0, None)
    share = np.cumsum(values / (values.sum() + 1e-9))
    return int(np.argmax(share >= explained)) + 1


def _whole_videos(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(video_id, n, mean_step, dimension) from a video's stretches in order."""
    now, n, steps, last, gram = None, 0, 0.0, None, None

    def out() -> tuple:
        return now, n, steps / (n - 1) if n > 1 else None, max(1, n // 5) if gram is None and n > 2 else 1 if gram is None else explained_by(gram)

    for batch in batches:
        found = []
        for video, _, m, s, a, b, g in zip(*[c.to_pylist() for c in batch.columns]):
            if video != now:
                if now is not None:
                    found.append(out())
                now, n, steps, last, gram = video, 0, 0.0, None, None
            if last is not None:
                steps += float(np.linalg.norm(np.array(a) - last))
            n, steps, last = n + m, steps + s, np.array(b)
            if g is not None:
                side = len(a) + 1
                gram = (0 if gram is None else gram) + np.frombuffer(g).reshape(side, side)
        if found:
            yield _numbers(found)
    if now is not None:
        yield _numbers([out()])


def _numbers(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.float64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=["video_id", "n", "mean_step", "dimension"])


def video_numbers(rows: DataFrame, vectors_of: DataFrame, svd: bool = True, stretch: float = STRETCH) -> DataFrame:
    """(video_id, n, mean_step, dimension) from unit vectors in order of time.

    A long video is summed in stretches of its time, whose ends are joined afterwards, so it is never
    in one task. Without ``svd`` the dimension is a fifth of the frames, as where it can't be solved.
    """
    of = rows.select("candidate_id", "video_id", "ts").join(vectors_of, "candidate_id").withColumn("stretch", F.floor(F.col("ts") / stretch))
    at = of.repartition(F.xxhash64(F.lit(17), "video_id", "stretch")).sortWithinPartitions("video_id", "stretch", "ts", "candidate_id").select("video_id", "stretch", "v")
    sums = at.mapInArrow(_stretch(svd), "video_id string, stretch bigint, n bigint, steps double, first array<double>, last array<double>, gram binary")
    return sums.repartition(F.xxhash64(F.lit(17), "video_id")).sortWithinPartitions("video_id", "stretch").mapInArrow(_whole_videos, "video_id string, n bigint, mean_step double, dimension int")


def budgets(rows: DataFrame, vectors_of: DataFrame, density: float = DENSITY, svd: bool = True) -> DataFrame:
    """(video_id, budget, dimension, mean_step, mean_importance) of the information budget, which has no fixed ceiling."""
    per = rows.groupBy("video_id").agg(F.avg("imp").alias("mean_importance"), F.max("dur").alias("dur"), F.max("n_scenes").alias("n_scenes"))
    per = per.join(video_numbers(rows, vectors_of, svd=svd), "video_id")
    budget = X.dynamic_budget(F.greatest("n_scenes", F.lit(1)), F.col("dur"), density, F.col("mean_step"), F.col("mean_importance"), F.col("dimension"))
    return per.select("video_id", budget.alias("budget"), "dimension", "mean_step", "mean_importance")


def select_frames(c: DataFrame, scenes: DataFrame, audio: DataFrame | None = None, visual: Column | None = None, method: str = "nms", budget: str = "information", density: float = DENSITY, most: int = 25) -> DataFrame:
    """The frames kept of each video: (video_id, scene, candidate_id, ts, imp, ...).

    ``c``: candidate_id, video_id, ts, importance_score, embedding, one row a candidate. Scenes, scores,
    the ends' boost, selection within scenes, then the best up to the budget: ``information`` from
    scenes, motion, importance and intrinsic dimension (``fallback``: a fifth of the frames in its
    place), ``static`` from the duration with a ceiling.
    """
    v = c.select("candidate_id", F.col("embedding").alias("v"))
    # narrow rows, used for the allocation, the selection and the budget
    rows = cut(scored(c.drop("embedding"), scenes, audio, visual))
    kept = selected(with_vectors(allocated(rows, v, density), v), method)
    if budget == "static":
        kept = kept.withColumn("budget", X.static_budget(F.col("dur"), density, most))
    else:
        kept = kept.join(budgets(rows, v, density, svd=budget == "information").select("video_id", "budget"), "video_id")
    best = Window.partitionBy("video_id").orderBy(F.desc("imp"), "ts", "candidate_id")
    return kept.withColumn("r", F.row_number().over(best)).where(F.col("r") <= F.col("budget")).drop("r")
