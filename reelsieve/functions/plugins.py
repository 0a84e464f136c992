"""Plug-in points: change detectors, deduplicators, samplers, model clients; registries by name.

A detector is a Column over the earlier and the current signal, a deduplicator's likeness a Column
over two structs, a client a function from a prompt to a reply that is made once for each partition.
"""

from __future__ import annotations

import hashlib
import json
import shutil
import subprocess
import time
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema as arrow_schema

from reelsieve.functions import expr as X

DETECTORS: dict[str, Callable] = {
    "frame_diff": lambda p, c: X.mean_abs_diff(p, c, 255.0),
    "histogram": X.chi_square,
    "edge": X.edge_change,
}


def detector(name: str) -> Callable:
    return named(DETECTORS, name, "detector")


class MockClient:
    """Answers every prompt with a small record that names the prompt's length."""

    def __call__(self, prompt: str) -> str:
        return json.dumps({"brand": {"brand_name_text": "Mock"}, "engagement_metrics": {"effectiveness_score": 3}, "prompt_length": len(prompt)})


CLIENTS: dict[str, Callable[[], Callable[[str], str]]] = {"mock": MockClient}


def client(name: str) -> Callable[[str], str]:
    return named(CLIENTS, name, "client")()


class HashedVectors:
    """Stands in for a neural embedder offline: a unit vector drawn from the content's digest; equal contents, equal vectors."""

    def __init__(self, width: int = 64):
        self.width = width

    def __call__(self, contents: Sequence[bytes | None]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for c in contents:
            if c is None:
                out.append(None)
                continue
            v = np.random.default_rng(int.from_bytes(hashlib.sha256(c).digest()[:8], "big")).standard_normal(self.width)
            out.append((v / np.linalg.norm(v)).tolist())
        return out


def mean_difference(kept: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Stands in for a learned perceptual distance offline: the mean absolute difference to each kept row."""
    return np.abs(kept - row).mean(axis=1)


#: Models by name: made once a partition. Embedders take contents, distances kept rows and a row; sound models take (samples, rate).
EMBEDDERS: dict[str, Callable[[], Callable]] = {"hashed": HashedVectors}
DISTANCES: dict[str, Callable] = {"mean_difference": mean_difference}
SOUND_MODELS: dict[str, Callable[[], Callable]] = {}
#: Take the path of a video and give (samples, rate); feature detectors take (height, width, pixels) and give a dict.
SOUND_EXTRACTORS: dict[str, Callable] = {}
FEATURES: dict[str, Callable[[], Callable]] = {}
NO_FEATURES = {"has_text": False, "has_face": False, "text_density": "low"}


def named(registry: dict[str, Callable], name: str, what: str) -> Callable:
    """The entry of a registry; an unknown name says which there are."""
    if name not in registry:
        raise ValueError(f"no {what} {name!r}; there are {', '.join(sorted(registry)) or 'none'}")
    return registry[name]


def embed(df: DataFrame, key: str, content: str, model: str = "hashed") -> DataFrame:
    """(key, embedding) of binary contents, in Arrow batches, by a model made once a partition; null contents give null."""
    make = named(EMBEDDERS, model, "embedder")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of(b.column(1).to_pylist()), pa.list_(pa.float32()))], names=[key, "embedding"])

    return df.select(key, content).mapInArrow(run, f"{key} {kind}, embedding array<float>")


def from_sound(df: DataFrame, key: str, samples: str, rate: str, model: str, schema: str) -> DataFrame:
    """What a sound model (tempo, mood, transcript) finds in each row's samples; a failure is a null, never a failed job.

    The model gives a dict with the columns of ``schema`` or a list of them.
    """
    make = named(SOUND_MODELS, model, "sound model")
    kind = df.schema[key].dataType.simpleString()
    out = T.StructType.fromDDL(f"{key} {kind}, {schema}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        kinds = arrow_schema(out)
        for b in batches:
            rows = []
            for k, x, r in zip(*[c.to_pylist() for c in b.columns]):
                try:
                    found = of(x, r)
                except Exception:
                    found = {}
                rows += [{key: k, **f} for f in (found if isinstance(found, list) else [found])]
            yield pa.RecordBatch.from_pylist([{f.name: row.get(f.name) for f in out} for row in rows], schema=kinds)

    return df.select(key, samples, rate).mapInArrow(run, out)


def ffmpeg_sound(path: str, rate: int = 16_000) -> tuple[list[float], int] | None:
    """The sound of a video as one channel of samples, by the ffmpeg program where there is one; None on any failure."""
    program = shutil.which("ffmpeg")
    if program is None:
        return None
    done = subprocess.run([program, "-v", "error", "-i", path, "-vn", "-ac", "1", "-ar", str(rate), "-f", "s16le", "-"], capture_output=True, timeout=600)
    return (np.frombuffer(done.stdout, "<i2") / 32768).tolist() if done.returncode == 0 else None, rate


SOUND_EXTRACTORS["ffmpeg"] = ffmpeg_sound


def sound_of(df: DataFrame, key: str, path: str, extractor: str = "ffmpeg") -> DataFrame:
    """(key, samples, rate) of videos by their paths; a video without sound, or whose sound can't be read, has nulls."""
    take = named(SOUND_EXTRACTORS, extractor, "extractor")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for p in b.column(1).to_pylist():
                try:
                    found.append((take(p) if p is not None else None) or (None, None))
                except Exception:
                    found.append((None, None))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.list_(pa.float32())), pa.array([r for _, r in found], pa.int32())], names=[key, "samples", "rate"])

    return df.select(key, path).mapInArrow(run, f"{key} {kind}, samples array<float>, rate int")


def detect_features(df: DataFrame, key: str, height: str, width: str, pixels: str, model: str) -> DataFrame:
    """(key, has_text, has_face, text_density) of frames, by a model made once a partition; what fails has the defaults."""
    make = named(FEATURES, model, "feature detector")
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for b in batches:
            found = []
            for h, w, p in zip(*[c.to_pylist() for c in b.columns[1:]]):
                try:
                    found.append(NO_FEATURES | of(h, w, p))
                except Exception:
                    found.append(NO_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([f[n] for f in found], k) for n, k in (("has_text", pa.bool_()), ("has_face", pa.bool_()), ("text_density", pa.string()))]], names=[key, *NO_FEATURES])

    return df.select(key, height, width, pixels).mapInArrow(run, f"{key} {kind}, has_text boolean, has_face boolean, text_density string")


def should_retry(error: Exception) -> bool:
    text = str(error).lower()
    return isinstance(error, (ConnectionError, TimeoutError, OSError)) or any(x in text for x in ("429", "500", "502", "503", "504", "rate limit", "overloaded", "timeout"))


def with_retry(call: Callable[[str], str], prompt: str, retries: int = 3, base: float = 1.0, most: float = 30.0, sleep=time.sleep) -> str:
    """Waits base * 2^n, at most ``most`` seconds, between tries; errors that can't pass are raised at once."""
    for n in range(retries + 1):
        try:
            return call(prompt)
        except Exception as e:
            if n == retries or not should_retry(e):
                raise
            sleep(min(base * 2**n, most))
    raise AssertionError


def extract(prompts: DataFrame, key: str, prompt: str, provider: str = "mock", retries: int = 3, base: float = 1.0) -> DataFrame:
    """(key, reply, error): one client a partition; a failure is a row with its error, never a failed job."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = client(provider)
        for b in batches:
            replies, errors = [], []
            for p in b.column(1).to_pylist():
                try:
                    replies.append(with_retry(ask, p or "", retries, base))
                    errors.append(None)
                except Exception as e:
                    replies.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=[key, "reply", "error"])

    kind = prompts.schema[key].dataType.simpleString()
    out = prompts.select(key, prompt).mapInArrow(run, f"{key} {kind}, reply string, error string")
    return out.withColumn("parsed", X.parse_reply(F.col("reply")))
