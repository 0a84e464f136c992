"""Reading and writing: files by extension, frame volumes, sound, JSON results, CSV, resumable sinks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Extensions of videos.
EXTENSIONS = (".mp4", ".mov", ".avi", ".mkv", ".webm", ".m4v")


def find_files(spark: SparkSession, folder: str, extensions: Sequence[str] = EXTENSIONS, recursive: bool = False, most: int | None = None) -> DataFrame:
    """(path, name, length, modificationTime) of files with one of the extensions, in any case, by path.

    Contents aren't read: the column isn't selected. Files of no length aren't listed, as Spark's scan
    leaves them out. ``most`` is the caller's limit, a feature.
    """
    t = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length", "modificationTime")
    t = t.withColumn("name", F.element_at(F.split("path", "/"), -1))
    t = t.where(F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1)).isin(*[e.lower() for e in extensions])).select("path", "name", "length", "modificationTime")
    return t.orderBy("path").limit(most) if most is not None else t.orderBy("path")


def accepted(files: DataFrame, extensions: Sequence[str] = EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): files of an allowed kind with content, and the others with the reason."""
    kind = F.lower(F.regexp_extract("name", r"(\.[^.]+)$", 1))
    reason = F.when(~kind.isin(*extensions), "extension").when(F.col("length") <= 0, "empty")
    t = files.withColumn("reason", reason)
    return t.where("reason IS NULL").drop("reason"), t.where("reason IS NOT NULL")


def video_metadata(df: DataFrame, fps: str = "fps", frames: str = "frame_count", width: str = "width", height: str = "height", default_fps: float | None = None) -> DataFrame:
    """duration (0 where fps is not above 0, or by the default fps) and aspect_ratio (0 without a height)."""
    rate = F.col(fps) if default_fps is None else F.coalesce(F.nullif(F.col(fps), F.lit(0.0)), F.lit(default_fps))
    return df.withColumns({"duration": F.when(rate > 0, F.col(frames) / rate).otherwise(0.0), "aspect_ratio": F.when(F.col(height) > 0, F.col(width) / F.col(height)).otherwise(0.0)})


def sample_grid(df: DataFrame, duration: str, interval_ms: int = 100) -> DataFrame:
    """A row for each sampling time below the duration: frame number and ts."""
    n = F.ceil(F.col(duration) * 1000 / interval_ms).cast("int")
    grid = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return df.withColumn("sample_no", F.explode(grid)).withColumn("ts", F.col("sample_no") * F.lit(interval_ms) / F.lit(1000.0)).where(F.col("ts") < F.col(duration))


def strided(df: DataFrame, index: str, fps: str, interval_ms: int) -> DataFrame:
    """Every frame whose index is a multiple of the step, the step rounded half to even, at least 1."""
    step = F.greatest(F.lit(1), F.bround(F.col(fps) * F.lit(interval_ms) / F.lit(1000.0)).cast("int"))
    return df.where(F.pmod(F.col(index), step) == 0)


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, Any]):
        self.path, self.interval, self.fps = options["path"], int(options.get("interval_ms", 100)), float(options.get("fps", 10))
        self.most = options.get("max_height")

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        found = sorted(glob.glob(os.path.join(self.path, "*.npy"))) if os.path.isdir(self.path) else [self.path]
        return [_Part(p) for p in found]

    def read(self, partition: _Part) -> Iterator[tuple]:
        import os

        volume = np.load(partition.path, mmap_mode="r")  # frames, height, width, channels; one frame at a time is read
        step = max(1, round(self.fps * self.interval / 1000))
        name = os.path.splitext(os.path.basename(partition.path))[0]
        for i in range(0, len(volume), step):
            frame = np.asarray(volume[i])
            h, w = frame.shape[:2]
            if self.most is not None and h > int(self.most):
                scale = int(self.most) / h
                rows = np.minimum((np.arange(int(self.most)) / scale).astype(int), h - 1)
                cols = np.minimum((np.arange(int(w * scale)) / scale).astype(int), w - 1)
                frame = frame[rows][:, cols]
                h, w = frame.shape[:2]
            yield (name, i, i / self.fps, h, w, np.ascontiguousarray(frame, np.uint8).tobytes())


class FrameSource(DataSource):
    """Frames of decoded volumes (one ``.npy`` a video): video_id, frame_no, ts, height, width, pixels.

    Options: path, fps, interval_ms, max_height. A volume is one partition and is mapped, not loaded.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "video_id string, frame_no bigint, ts double, height int, width int, pixels binary"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return FrameReader(self.options)


def load_sound(files: DataFrame, rate: int = 16000) -> DataFrame:
    """(path, ts, rms): loudness of mono sound from PCM WAV contents, in steps of 512 samples; null on failure.

    ``files``: path, content. Other rates are resampled linearly.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import wave

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    with wave.open(io.BytesIO(content.as_py())) as w:
                        raw = np.frombuffer(w.readframes(w.getnframes()), {1: np.uint8, 2: np.int16, 4: np.int32}[w.getsampwidth()]).astype(np.float64)
                        raw = (raw - 128) / 128 if w.getsampwidth() == 1 else raw / float(2 ** (8 * w.getsampwidth() - 1))
                        y = raw.reshape(-1, w.getnchannels()).mean(axis=1)
                        if w.getframerate() != rate and len(y):
                            y = np.interp(np.arange(0, len(y), w.getframerate() / rate), np.arange(len(y)), y)
                    n = -(-len(y) // 512)
                    rms = np.sqrt(np.square(np.pad(y, (0, n * 512 - len(y)))).reshape(n, 512).mean(axis=1)) if n else np.zeros(0)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(np.arange(n) * 512 / rate), pa.array(rms)], names=["path", "ts", "rms"])
                except Exception:
                    yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([None], pa.float64()), pa.array([None], pa.float64())], names=["path", "ts", "rms"])

    return files.select("path", "content").mapInArrow(run, "path string, ts double, rms double")


def deep_merge(base: dict, over: dict) -> dict:
    """``over`` wins, member by member; everything else is kept."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(path: str | None, overrides: dict | None = None, default: dict | None = None) -> dict:
    """A YAML file over the defaults, and the overrides over both; a missing file leaves the defaults."""
    import os

    out = dict(default or {})
    if path and os.path.exists(path):
        import yaml

        with open(path, encoding="utf-8") as f:
            out = deep_merge(out, yaml.safe_load(f) or {})
    return deep_merge(out, overrides or {})


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result documents {"results": [...]} as one row a video; of repeated videos the last counts."""
    t = spark.read.schema(f"results array<{schema}>").json(path, multiLine=True)
    x = t.select(F.posexplode("results").alias("pos", "r")).select("pos", "r.*")
    name = F.coalesce("video_name", F.element_at(F.split("video_path", "[/\\\\]"), -1))
    rest = [c for c in x.columns if c not in ("pos", "video_name")]
    return x.groupBy(name.alias("video_name")).agg(F.max_by(F.struct(*rest), "pos").alias("r")).select("video_name", "r.*")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(video_id, value) from a file that is one JSON object."""
    t = spark.read.text(path, wholetext=True)
    return t.select(F.explode(F.from_json("value", "map<string,string>")).alias("video_id", "value"))


def read_table(spark: SparkSession, path: str, header: bool = True, schema: str | None = None) -> DataFrame:
    """CSV with quoted line breaks; all columns are texts unless a schema says otherwise."""
    r = spark.read.option("header", header).option("multiLine", True).option("escape", '"')
    return (r.schema(schema) if schema else r).csv(path)


def clean_ids(df: DataFrame, column: str, length: int = 11) -> DataFrame:
    """Ids without quotes and blanks, of the right length only."""
    return df.withColumn(column, F.regexp_replace(column, r"^[\s'\"]+|[\s'\"]+$", "")).where(F.length(column) == length)


def write_results(df: DataFrame, path: str, kind: str = "parquet", by: str | None = None, mode: str = "append") -> None:
    """Results as parquet, json or csv, optionally a folder for each value of a column."""
    w = df.write.mode(mode)
    w = w.partitionBy(by) if by else w
    (w.option("header", True).option("escape", '"') if kind == "csv" else w).format(kind).save(path)


def result_counts(results: DataFrame, error: str = "error") -> DataFrame:
    """(total, succeeded, failed) of results whose failures are rows with an error."""
    return results.agg(F.count("*").alias("total"), F.count_if(F.col(error).isNull()).alias("succeeded"), F.count(error).alias("failed"))


def union_columns(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows with differing columns as one table; missing ones are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def pending(work: DataFrame, key: str, *done: DataFrame) -> DataFrame:
    """Work that none of the written tables holds yet."""
    for t in done:
        work = work.join(t.select(key), key, "left_anti")
    return work


def resume(spark: SparkSession, work: DataFrame, key: str, path: str, process, kind: str = "parquet") -> int:
    """Process what ``path`` doesn't hold yet and append it; returns how many rows were pending.

    A key is in the sink or it isn't: a run that fails leaves committed files only, the next takes the rest.
    """
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    left = pending(work, key, spark.read.format(kind).load(path)) if there else work
    n = left.count()
    if n:
        process(left).write.mode("append").format(kind).save(path)
    return n
