"""Runs of consecutive rows that satisfy a condition (gaps and islands), by window functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, key: str, order: str, inside: Column, least: float, strict: bool = False, close_last: bool = True) -> DataFrame:
    """(key, start, end) of each run: ``end`` is the time of the first row after it.

    A run that reaches the last row ends there if ``close_last``, else it is dropped. Runs shorter
    than ``least`` are dropped (with ``strict`` also those exactly as long).
    """
    w = Window.partitionBy(key).orderBy(order)
    rows = df.select(key, order, F.coalesce(inside, F.lit(False)).alias("__in"))
    rows = rows.withColumns({"__next": F.lead(order).over(w), "__new": F.when(F.coalesce(F.lag("__in").over(w), F.lit(False)) != F.col("__in"), 1).otherwise(0)})
    rows = rows.withColumn("__run", F.sum("__new").over(w))
    out = rows.where("__in").groupBy(key, "__run").agg(F.min(order).alias("start"), F.max(order).alias("__last"), F.max_by("__next", order).alias("__after"))
    end = F.coalesce("__after", "__last") if close_last else F.col("__after")
    out = out.select(key, "start", end.alias("end")).where(F.col("end").isNotNull())
    length = F.col("end") - F.col("start")
    return out.where(length > least if strict else length >= least)
