"""Numeric models within a group, from sums that combine before the shuffle, or in driver-planned rounds.

No group is collected: the intrinsic dimension needs a group's Gram matrix, which is an aggregate of
fixed size; farthest points and k-means go in rounds of one aggregation each, over all groups at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelsieve.functions import expr as X
from reelsieve.operators.walk import stretches
from reelsieve.session import cut


def intrinsic_dimension(df: DataFrame, key: str, vector: str, explained: float = 0.9) -> DataFrame:
    """(key, n, dimension): components up to the first at or above the share of variance explained.

    At most two rows give 1. Each task sums its rows' outer products by group, so what is shuffled is
    one matrix a group and task, whatever the number of rows.
    """
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(vector).alias("v"))

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            keys = np.array(b.column(0).to_pylist(), object)
            x = np.array(b.column(1).to_pylist(), np.float64)
            for k in set(keys.tolist()):
                own = x[keys == k]
                one = np.c_[np.ones(len(own)), own]
                sums[k] = sums.get(k, 0) + one.T @ one
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.ravel().tolist() for s in sums.values()], pa.list_(pa.float64()))], names=["k", "m"])

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        m = np.sum(np.stack(p["m"].to_numpy()), axis=0)
        w = int(round(np.sqrt(len(m))))
        m = m.reshape(w, w)
        n = int(m[0, 0])
        if n <= 2:
            return pd.DataFrame({key: p["k"].iloc[:1], "n": [n], "dimension": [1]})
        mean = m[0, 1:] / n
        values = np.clip(np.linalg.eigvalsh(m[1:, 1:] - n * np.outer(mean, mean))[::-1], 0, None)
        share = np.cumsum(values) / max(values.sum(), 1e-300)
        return pd.DataFrame({key: p["k"].iloc[:1], "n": [n], "dimension": [int(np.argmax(share >= explained)) + 1 if values.sum() > 0 else 1]})

    out = rows.mapInArrow(partial, "k string, m array<double>").groupBy("k").applyInPandas(solve, f"{key} string, n bigint, dimension int")
    return out.withColumn(key, F.col(key).cast(df.schema[key].dataType))


def farthest_points(df: DataFrame, key: str, row: str, vector: str, count: int, own: Column | None = None) -> DataFrame:
    """(key, row, rank): from the first row on, each next one has the largest distance to those chosen.

    One aggregation a round for all groups at once: every row keeps its distance to the nearest chosen
    row. Ties go to the least row; groups with fewer rows come out whole. ``own``: a group's own count,
    where that is less.
    """
    x = df.select(key, row, F.col(vector).alias("v"), F.lit(count) if own is None else own.alias("own")).toDF(key, row, "v", "own")
    state = x.withColumn("near", F.lit(float("inf")))
    chosen = []
    for rank in range(count):
        pick = state.where(F.col("near") > 0).where(F.col("own") > rank).groupBy(key).agg(F.min(F.struct((-F.col("near")).alias("far"), F.col(row).alias("r"), F.col("v").alias("c"))).alias("b"))
        pick = cut(pick.select(key, F.col("b.r").alias("r"), F.col("b.c").alias("c")))
        chosen.append(pick.select(key, F.col("r").alias(row), F.lit(rank).alias("rank")))
        if rank + 1 < count:
            near = F.least(F.col("near"), F.round(1 - X.cosine(F.col("v"), F.col("c")), 9))
            state = cut(state.join(pick, key).select(key, row, "v", "own", F.when(F.col(row) == F.col("r"), 0.0).otherwise(near).alias("near")))
    out = chosen[0]
    for c in chosen[1:]:
        out = out.unionAll(c)
    return out


def kmeans_group(v: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, distance to its centre) of the rows of one group, in order of their keys; as ``kmeans_labels``."""
    unit = v / np.where((n := np.linalg.norm(v, axis=1, keepdims=True)) > 0, n, 1)
    near, chosen = np.full(len(v), np.inf), []
    while len(chosen) < k and near.max() > 0:
        at = int(near.argmax())
        chosen.append(at)
        near = np.minimum(near, np.round(1 - unit @ unit[at], 9))
        near[at] = 0
    centre = v[chosen]
    for turn in range(rounds + 1):
        d = np.round(((v[:, None, :] - centre[None, :, :]) ** 2).sum(axis=2), 12)
        label = d.argmin(axis=1)
        if turn == rounds:
            return label, np.sqrt(d.min(axis=1))
        kept = np.unique(label)
        centre = np.stack([v[label == c].mean(axis=0) for c in kept])
    raise AssertionError


def _kmeans_groups(rounds: int):
    """Labels of whole groups; a group's rows follow each other: key, row, vector, k."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None

        def out() -> pa.RecordBatch:
            rows = pa.concat_batches(held)
            label, far = kmeans_group(np.array(rows.column(2).to_pylist(), np.float64), rows.column(3)[0].as_py(), rounds)
            return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(label.astype(np.int32)), pa.array(far)], names=[*rows.schema.names[:2], "cluster", "far"])

        for batch in batches:
            for key, a, b in stretches(batch, 1):
                if held and key != now:
                    yield out()
                    held = []
                now = key
                held.append(batch.slice(a, b - a))
        if held:
            yield out()

    return run


#: Rows of a group that one task solves; larger ones go through rounds of aggregations with the same result.
GROUP_ROWS = 20_000


def kmeans_labels(df: DataFrame, key: str, row: str, vector: str, most: int, rounds: int = 10, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(key, row, cluster, far): the cluster of each row by Lloyd's rounds within its group, and its distance to the centre.

    ``k`` is the group's number of clusters, at most ``most``. Centres begin at farthest points, so the
    result depends on the rows only; clusters that lose all rows are dropped. Groups up to ``group_rows``
    are solved where they meet; a larger one never meets in one task.
    """
    x = df.select(key, row, F.col(vector).alias("v"), "k")
    large = x.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > group_rows).select(key)
    small, rest = x, None
    if not (large := cut(large)).isEmpty():
        small, rest = x.join(large, key, "left_anti"), x.join(large, key, "left_semi")
    kind = {f.name: f.dataType.simpleString() for f in x.schema.fields}
    at = small.repartition(F.xxhash64(F.lit(17), key)).sortWithinPartitions(key, row)
    found = at.mapInArrow(_kmeans_groups(rounds), f"{key} {kind[key]}, {row} {kind[row]}, cluster int, far double")
    return found if rest is None else found.unionByName(_kmeans_rounds(rest, key, row, most, rounds))


def _kmeans_rounds(x: DataFrame, key: str, row: str, most: int, rounds: int) -> DataFrame:
    """``kmeans_labels`` of groups too large for one task; ``x``: key, row, v, k.

    A round sums each cluster's vectors where they are read; the centres of a group, at most ``most``
    vectors, travel as one row.
    """
    start = farthest_points(x, key, row, "v", most, F.col("k")).join(x.select(row, "v"), row)
    centres = cut(start.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "v"))).alias("cs")).select(key, F.transform("cs", lambda c: F.transform(c["v"], lambda y: y.cast("double"))).alias("cs")))
    gap = lambda v, c: F.aggregate(F.zip_with(v, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, y: s + y)
    x = x.drop("k")
    for turn in range(rounds + 1):
        at = x.join(centres, key).withColumn("d", F.transform("cs", lambda c: F.round(gap(F.col("v"), c), 12)))
        at = at.withColumns({"cluster": (F.array_position("d", F.array_min("d")) - 1).cast("int"), "far": F.sqrt(F.array_min("d"))})
        if turn == rounds:
            return at.select(key, row, "cluster", "far")
        means = at.select(key, "cluster", F.posexplode("v")).groupBy(key, "cluster", "pos").agg(F.avg(F.col("col").cast("double")).alias("m"))
        one = means.groupBy(key, "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("c"))
        centres = cut(one.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "c"))), lambda s: s["c"]).alias("cs")))
    raise AssertionError


def kmeans_picks(df: DataFrame, key: str, row: str, vector: str, k: Column | int, rounds: int = 10, most: int = 20) -> DataFrame:
    """(key, row, cluster): the row nearest to each of ``k`` centres of the group."""
    k = F.lit(k) if isinstance(k, int) else k
    labels = kmeans_labels(df.select(key, row, vector, F.least(k, F.lit(most)).cast("int").alias("k")), key, row, vector, most, rounds)
    return labels.groupBy(key, "cluster").agg(F.min_by(row, F.struct(F.round("far", 9), F.col(row))).alias(row)).select(key, row, "cluster")


def select_hybrid(suppressed: DataFrame, labelled: DataFrame, key: str, row: str, score: str) -> DataFrame:
    """Suppression's picks, and for each cluster that none of them is in, its best row if that has at
    least 0.7 of the worst pick's score; it takes that pick's place.

    ``suppressed``: picks (key, row); ``labelled``: all rows (key, row, score, cluster, and forced where some are). Missing
    clusters come in order of their best row; each exchanges the worst pick left that isn't forced. What
    meets in one row of a group are its picks and one row a cluster.
    """
    labelled = labelled if "forced" in labelled.columns else labelled.withColumn("forced", F.lit(False))
    all_ = labelled.join(suppressed.select(row).withColumn("picked", F.lit(True)), row, "left").withColumn("picked", F.coalesce("picked", F.lit(False)))
    best = F.max_by(F.struct((-F.col(score)).alias("s"), row, "cluster"), F.struct(score, (-F.col(row)).alias("r")))
    of = all_.groupBy(key, "cluster").agg(F.max("picked").alias("have"))
    free = all_.where(~F.col("forced")).groupBy(key, "cluster").agg(best.alias("best"))
    missing = of.where(~F.col("have")).select(key, "cluster").join(free, [key, "cluster"]).groupBy(key).agg(F.array_sort(F.collect_list("best")).alias("missing"))
    picks = all_.where("picked").groupBy(key).agg(F.sort_array(F.collect_list(F.when(~F.col("forced"), F.struct(score, row)))).alias("picks"), F.collect_list(F.when(F.col("forced"), F.col(row))).alias("fixed"))
    g = picks.join(missing, key, "left")
    swap = lambda k, x: F.when((F.size(k) > 0) & (-x["s"] >= 0.7 * F.get(k, F.lit(0))[score]), F.sort_array(F.concat(F.slice(k, 2, F.size(k)), F.array(F.struct((-x["s"]).alias(score), x[row].alias(row)))))).otherwise(k)
    done = F.when(F.col("missing").isNull(), F.col("picks")).otherwise(F.aggregate("missing", F.col("picks"), swap))
    return g.select(key, F.explode(F.concat(F.transform(done, lambda p: p[row]), F.col("fixed"))).alias(row))
