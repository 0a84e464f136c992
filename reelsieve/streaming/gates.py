"""Streaming forms of the stateful operators; over a finished stream they give what the batch forms give."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def gated(stream: DataFrame, key: str, row: str, at: str, signal: str, least_gap: float, threshold: float, idle_ms: int | None = None) -> DataFrame:
    """(key, row, at): the first frame, then those far enough from the last kept one whose change passes.

    State of a key: time of the last kept frame and the last signal, two numbers. With ``idle_ms`` it is
    dropped when the key has been idle so long; such a stream goes on making batches, so it must be
    started on a processing-time trigger, not run to its end. Rows of a key arrive in order between batches and are sorted within one.
    """
    kind = {f.name: f.dataType.simpleString() for f in stream.schema.fields}

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, signal_before = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).sort_values([at, row])
        kept = []
        for r, t, v in zip(rows[row], rows[at], rows[signal]):
            if last is None or (t - last >= least_gap and abs(v - signal_before) > threshold):
                kept.append((k[0], r, t))
                last = t
            signal_before = v
        state.update((float(last), float(signal_before)))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(kept, columns=[key, row, at])

    return stream.select(key, row, at, signal).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind[key]}, {row} {kind[row]}, {at} double", "last double, signal double", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    )


def adaptive(stream: DataFrame, key: str, row: str, at: str, signal: str, base: float = 0.15, window: int = 30) -> DataFrame:
    """(key, row, threshold): from the last ``window`` changes of the key, which is all its state holds."""
    kind = {f.name: f.dataType.simpleString() for f in stream.schema.fields}

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, seen, history = state.get if state.exists else (None, 0, [])
        rows = pd.concat(list(parts)).sort_values([at, row])
        x = rows[signal].to_numpy(np.float64)
        change = np.abs(np.diff(x if before is None else np.r_[before, x])) / 255
        # mean and spread of the last changes at every row, from one view of windows
        line = np.r_[np.array(history or [], np.float64), change]
        upto = np.arange(len(line) - len(change), len(line))
        at_all = int(seen) + 1 + np.arange(len(change))
        threshold = np.full(len(change), base)
        full = at_all >= window
        if full.any():
            view = np.lib.stride_tricks.sliding_window_view(line, window)[upto[full] - window + 1]
            threshold[full] = np.minimum(2 * base, np.maximum(base / 2, view.mean(axis=1) + view.std(axis=1)))
        state.update((float(x[-1]), int(seen) + len(change), line[-window:].tolist()))
        yield pd.DataFrame({key: k[0], row: rows[row].to_numpy()[len(x) - len(change) :], "threshold": threshold})

    return stream.select(key, row, at, signal).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind[key]}, {row} {kind[row]}, threshold double", "before double, seen bigint, history array<double>", "append", GroupStateTimeout.NoTimeout
    )


def tumbling(stream: DataFrame, key: str, at: str, value: str, width: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Counts and means by key and window; late rows count up to the watermark."""
    return stream.withWatermark(at, late).groupBy(key, F.window(at, width)).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(key, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean")


def sessions(stream: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 minute") -> DataFrame:
    """Runs of rows with no gap as long as ``gap``."""
    return stream.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_new(stream: DataFrame, path: str, key: str, checkpoint: str, within: str | None = None, **trigger: Any):
    """A sink that takes each key once. A batch is a folder of its own that a repeated batch replaces, so a batch
    costs its own size, whatever the sink holds, and a restart writes nothing twice.

    Keys already taken are the stream's state; with ``within``, the name of a time column with a watermark,
    they are kept no longer than the watermark needs.
    """
    once = stream.dropDuplicates([key]) if within is None else stream.dropDuplicatesWithinWatermark([key])

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def progress(spark: SparkSession, path: str) -> DataFrame:
    """(batch, n): what a sink of ``append_new`` has taken so far."""
    return spark.read.parquet(path).groupBy("batch").agg(F.count("*").alias("n"))
