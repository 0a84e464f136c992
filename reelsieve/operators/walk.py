"""Sequential operators over sorted groups, streamed: a task holds what a group has kept, never the group.

The partition is sorted by group and order; rows pass by in Arrow batches and a state per group
decides which stay. A hot group costs time in its task, not memory.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelsieve.functions.plugins import mean_difference, named


def stretches(batch: pa.RecordBatch, keys: int) -> list[tuple[tuple, int, int]]:
    """(key, from, to) of runs of rows with equal first ``keys`` columns."""
    cols = [batch.column(i).to_pylist() for i in range(keys)]
    rows = list(zip(*cols))
    cut = [0, *[i for i in range(1, len(rows)) if rows[i] != rows[i - 1]], len(rows)]
    return [(rows[a], a, b) for a, b in zip(cut, cut[1:])] if rows else []


def vectors(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of unit length (zero rows stay zero)."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = x.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


class UnlikeKept:
    """Greedy deduplication by cosine: a row stays unless it is above the threshold to a kept one."""

    def __init__(self, threshold: float):
        self.threshold, self.kept, self.n = threshold, np.zeros((0, 0)), 0

    def _add(self, x: np.ndarray) -> None:
        if self.n == len(self.kept):
            grown = np.zeros((max(64, 2 * self.n), len(x)))
            grown[: self.n] = self.kept[: self.n] if self.n else 0
            self.kept = grown
        self.kept[self.n] = x
        self.n += 1

    def take(self, batch: pa.RecordBatch) -> np.ndarray:
        u = vectors(batch.column("v"))
        keep = np.zeros(len(u), bool)
        for b in range(0, len(u), 256):
            part = u[b : b + 256]
            free = ~((part @ self.kept[: self.n].T) > self.threshold).any(axis=1) if self.n else np.ones(len(part), bool)
            own = part @ part.T > self.threshold
            chosen: list[int] = []
            for i in np.flatnonzero(free):
                if not own[i, chosen].any():
                    chosen.append(i)
                    keep[b + i] = True
            for i in chosen:
                self._add(part[i])
        return keep


class Suppress:
    """Non-maximum suppression of rows in descending score: none within ``gap`` in time of a kept one,
    none more similar to a kept one than the threshold, which may grow with the distance in time.

    Rows with ``forced`` come first and always stay; the others stay until there are ``limit``.
    """

    def __init__(self, gap: float, threshold: float, scale: float = 0.0, tau: float = 5.0):
        self.gap, self.threshold, self.scale, self.tau = gap, threshold, scale, tau
        self.times, self.kept, self.n = np.zeros(16), np.zeros((16, 0)), 0

    def _add(self, t: float, u: np.ndarray) -> None:
        if self.kept.shape[1] != len(u):
            self.kept = np.zeros((len(self.times), len(u)))
        if self.n == len(self.times):
            self.times, self.kept = np.concatenate([self.times, np.zeros_like(self.times)]), np.concatenate([self.kept, np.zeros_like(self.kept)])
        self.times[self.n], self.kept[self.n] = t, u
        self.n += 1

    def take(self, batch: pa.RecordBatch) -> np.ndarray:
        u, t = vectors(batch.column("v")), batch.column("t").to_numpy(zero_copy_only=False)
        limit = batch.column("limit").to_numpy(zero_copy_only=False)
        forced = batch.column("forced").to_numpy(zero_copy_only=False) if "forced" in batch.schema.names else np.zeros(len(t), bool)
        keep = np.zeros(len(t), bool)
        for i in range(len(t)):
            if not forced[i]:
                if self.n >= limit[i]:
                    break
                dt = np.abs(self.times[: self.n] - t[i])
                need = self.threshold * (1 + self.scale * (1 - np.exp(-dt / self.tau)))
                if (dt < self.gap).any() or (self.n and (self.kept[: self.n] @ u[i] > need).any()):
                    continue
            keep[i] = True
            self._add(float(t[i]), u[i])
        return keep


class Changed:
    """A row stays if it differs from the last kept one by more than the threshold; the first does.

    At least ``apart`` rows lie between kept ones, at most ``most`` are kept. A row marked ``blank`` has
    nothing to compare: it stays, and so does the next that isn't.
    """

    def __init__(self, threshold: float, apart: int = 1, most: int = 2**62):
        self.threshold, self.apart, self.most = threshold, apart, most
        self.last, self.at, self.seen, self.kept = None, 0, 0, 0

    def take(self, batch: pa.RecordBatch) -> np.ndarray:
        x = batch.column("x").to_pylist()
        blank = batch.column("blank").to_pylist() if "blank" in batch.schema.names else [False] * len(x)
        keep = np.zeros(len(x), bool)
        for i, (v, b) in enumerate(zip(x, blank)):
            self.seen += 1
            if b or self.last is None or (abs(v - self.last) > self.threshold and self.seen - self.at >= self.apart and self.kept < self.most):
                keep[i] = True
                self.last, self.at, self.kept = None if b else v, self.seen, self.kept + 1
        return keep


class Gate:
    """The first row, then rows at least ``gap`` after the last kept one whose change to the row before passes the threshold."""

    def __init__(self, gap: float, threshold: float):
        self.gap, self.threshold, self.last, self.before = gap, threshold, None, None

    def take(self, batch: pa.RecordBatch) -> np.ndarray:
        keep = np.zeros(batch.num_rows, bool)
        for i, (t, v) in enumerate(zip(batch.column("t").to_pylist(), batch.column("x").to_pylist())):
            if self.last is None or (t - self.last >= self.gap and abs(v - self.before) > self.threshold):
                keep[i], self.last = True, t
            self.before = v
        return keep


class Apart:
    """A row stays if no kept one is nearer than ``gap`` on the line, up to ``most`` rows; kept places are held sorted."""

    def __init__(self, gap: float, most: int = 2**62):
        self.gap, self.most, self.kept = gap, most, []

    def take(self, batch: pa.RecordBatch) -> np.ndarray:
        keep = np.zeros(batch.num_rows, bool)
        for i, x in enumerate(batch.column("x").to_pylist()):
            if len(self.kept) >= self.most:
                break
            at = bisect.bisect_left(self.kept, x)
            if (at == 0 or x - self.kept[at - 1] >= self.gap) and (at == len(self.kept) or self.kept[at] - x >= self.gap):
                self.kept.insert(at, x)
                keep[i] = True
        return keep


class Kept:
    """Greedy deduplication: a row stays unless it is like a kept one. ``like`` sees all kept rows at once."""

    def __init__(self):
        self.rows, self.n = np.zeros((0, 0)), 0

    def read(self, batch: pa.RecordBatch) -> np.ndarray:
        return vectors(batch.column("v"))

    def like(self, kept: np.ndarray, row: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def take(self, batch: pa.RecordBatch) -> np.ndarray:
        rows = self.read(batch)
        keep = np.zeros(len(rows), bool)
        for i, row in enumerate(rows):
            if self.n and self.like(self.rows[: self.n], row).any():
                continue
            if self.n == len(self.rows):
                grown = np.zeros((max(16, 2 * self.n), rows.shape[1]), rows.dtype)
                grown[: self.n] = self.rows[: self.n] if self.n else 0
                self.rows = grown
            self.rows[self.n] = row
            self.n += 1
            keep[i] = True
        return keep


class VotesKept(Kept):
    """Like: enough signatures are less than ``within`` bits apart."""

    def __init__(self, within: int = 8, min_votes: int = 2, columns: Sequence[str] = ("dh", "vh", "sh")):
        super().__init__()
        self.within, self.votes, self.columns = within, max(1, min(min_votes, len(columns))), columns

    def read(self, batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in self.columns], axis=1).astype(np.int64).view(np.uint64)

    def like(self, kept: np.ndarray, row: np.ndarray) -> np.ndarray:
        return (np.bitwise_count(kept ^ row) < self.within).sum(axis=1) >= self.votes


class NearKept(Kept):
    """Like: a distance between unit vectors below the threshold; the mean absolute difference stands in for a learned one."""

    def __init__(self, threshold: float, distance: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
        super().__init__()
        self.threshold, self.distance = threshold, distance or mean_difference

    def like(self, kept: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.distance(kept, row) < self.threshold


class AlikeKept(Kept):
    """Like: a structural similarity of square grids above the threshold.

    It is a mean over windows, none above 1, so with few windows none of a like pair is below ``floor``. A window's similarity
    is at most the cosine of its cells without their mean and with a constant: one product of matrices finds the pairs that can
    be alike in the first window, and only those are compared. Grids of more windows are compared with every kept one.
    """

    def __init__(self, threshold: float, side: int, top: float):
        super().__init__()
        self.threshold, self.side, self.top = threshold, side, top
        width = min(7, side)
        count = side - width + 1
        self.floor = 1 - count * count * (1 - threshold) if count <= 4 else 0
        if self.floor > 0:
            band = np.tril(np.triu(np.ones((count, side))), width - 1)
            self.windows = np.kron(band, band)  # a row for each window: 1 for its cells
            self.c1, self.c2, self.fix = (0.01 * top) ** 2, (0.03 * top) ** 2, width**2 / max(1, width**2 - 1)
            self.described: list[np.ndarray] = []

    def read(self, batch: pa.RecordBatch) -> np.ndarray:
        x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return x.reshape(batch.num_rows, -1)

    def like(self, kept: np.ndarray, row: np.ndarray) -> np.ndarray:
        from reelsieve.functions.kernels import structural_similarity

        grid = lambda x: x.reshape(self.side, self.side)
        return np.array([structural_similarity(grid(k), grid(row), top=self.top) for k in kept]) > self.threshold

    def _describe(self, rows: np.ndarray) -> list[np.ndarray]:
        """The rows, means and variances of their windows, and their first windows as unit vectors for the product."""
        n = self.windows[0].sum()
        m = rows @ self.windows.T / n
        q = self.fix * ((rows * rows) @ self.windows.T / n - m * m)
        first = rows[:, self.windows[0] > 0]
        first = (first - first.mean(axis=1, keepdims=True)) * np.sqrt(self.fix / n)
        first = np.column_stack([first, np.full(len(rows), np.sqrt(self.c2 / 2))])
        return [rows, m, q, (first / np.linalg.norm(first, axis=1, keepdims=True)).astype(np.float32)]

    def _similarity(self, products: np.ndarray, ma: np.ndarray, mb: np.ndarray, qa: np.ndarray, qb: np.ndarray) -> np.ndarray:
        """Of windows, from the sums of their cells' products (which are written over), their means and variances."""
        both = 2 * ma * mb
        products *= 2 * self.fix / self.windows[0].sum()
        products -= self.fix * both
        products += self.c2
        both += self.c1
        products *= both
        products /= ((ma * ma + self.c1) + mb * mb) * ((qa + self.c2) + qb)
        return products

    def _alike(self, these: list[np.ndarray], those: list[np.ndarray]) -> np.ndarray:
        """Each of these rows with each of those."""
        (x, mx, qx, fx), (y, my, qy, fy) = these, those
        near = fx @ fy.T
        alike = np.abs(near, out=near) > self.floor - 1e-4  # far beyond the product's rounding
        if 16 * np.count_nonzero(alike) <= alike.size:
            i, j = np.divmod(np.flatnonzero(alike), max(1, len(y)))
            s = self._similarity((x[i] * y[j]) @ self.windows.T, mx[i], my[j], qx[i], qy[j]).mean(axis=1)
            alike[i, j] = s > self.threshold
            close = np.abs(s - self.threshold) < 1e-9
            i, j = i[close], j[close]
        else:
            s = sum(self._similarity(x[:, w] @ y[:, w].T, mx[:, k, None], my[:, k], qx[:, k, None], qy[:, k]) for k, w in enumerate(self.windows > 0))
            s /= len(self.windows)
            alike = s > self.threshold
            s -= self.threshold
            i, j = np.nonzero(np.abs(s, out=s) < 1e-9)
        for a, b in zip(i, j):  # rounding must not depend on the way taken
            alike[a, b] = self.like(y[b, None], x[a])[0]
        return alike

    def take(self, batch: pa.RecordBatch) -> np.ndarray:
        if self.floor <= 0:
            return super().take(batch)
        rows = self.read(batch)
        keep = np.zeros(len(rows), bool)
        for b in range(0, len(rows), 256):
            part, free = self._describe(rows[b : b + 256]), np.arange(len(rows[b : b + 256]))
            for k in range(0, self.n, 512):
                free = free[~self._alike([x[free] for x in part], [x[k : min(k + 512, self.n)] for x in self.described]).any(axis=1)]
                if not len(free):
                    break
            part = [x[free] for x in part]
            own, chosen = self._alike(part, part), []
            for i in range(len(free)):
                if not own[i, chosen].any():
                    chosen.append(i)
            keep[b + free[chosen]] = True
            self._add([x[chosen] for x in part])
        return keep

    def _add(self, part: list[np.ndarray]) -> None:
        n = self.n + len(part[0])
        if not self.described or n > len(self.described[0]):
            grown = [np.zeros((max(16, n, 2 * self.n), x.shape[1]), x.dtype) for x in part]
            for g, x in zip(grown, self.described):
                g[: self.n] = x[: self.n]
            self.described = grown
        for x, p in zip(self.described, part):
            x[self.n : n] = p
        self.n = n


class BoxesKept(Kept):
    """Like: more than a share of the box's own area lies in a kept one. Columns x, y, w, h."""

    def __init__(self, share: float):
        super().__init__()
        self.share = share

    def read(self, batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xywh"], axis=1).astype(np.float64)

    def like(self, kept: np.ndarray, row: np.ndarray) -> np.ndarray:
        low, high = np.maximum(kept[:, :2], row[:2]), np.minimum(kept[:, :2] + kept[:, 2:], row[:2] + row[2:])
        return np.maximum(0, high - low).prod(axis=1) / max(row[2] * row[3], 1e-300) > self.share


#: Greedy deduplicators by name, each a state of a walk.
DEDUPLICATORS: dict[str, Callable[..., object]] = {"hash": VotesKept, "structure": AlikeKept, "distance": NearKept, "cosine": UnlikeKept}


def deduplicator(name: str) -> Callable[..., object]:
    return named(DEDUPLICATORS, name, "deduplicator")


class Chain:
    """Stages one after another, each over what the one before kept: how many of them a row passed."""

    def __init__(self, stages: Sequence[object]):
        self.stages = stages

    def take(self, batch: pa.RecordBatch) -> np.ndarray:
        passed = np.zeros(batch.num_rows, np.int64)
        left = np.arange(batch.num_rows)
        for stage in self.stages:
            if not len(left):
                break
            left = left[stage.take(batch.take(pa.array(left)))]
            passed[left] += 1
        return passed


def walk(df: DataFrame, keys: Sequence[str], order: Sequence[Column], state: Callable[[], object], keep: Sequence[str], mark: str | None = None, **inputs: Column) -> DataFrame:
    """The rows that ``state().take`` keeps in each group, in order; ``inputs`` are the columns it reads.

    With ``mark`` all rows come out, with what ``take`` gave for them in that column.
    """
    plain = df.select(*keys, *keep, *[c.alias(n) for n, c in inputs.items()], *[c.alias(f"__o{i}") for i, c in enumerate(order)])
    at = [f"__o{i}" for i in range(len(order))]
    rows = plain.repartition(F.xxhash64(F.lit(17), *keys)).sortWithinPartitions(*keys, *at).drop(*at)
    width = len(keys)
    out = plain.select(*keys, *keep).schema
    names = [f.name for f in out]
    if mark:
        out = T.StructType(out.fields + [T.StructField(mark, T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, current = None, None
        for batch in batches:
            found = []
            for key, a, b in stretches(batch, width):
                if current is None or key != now:
                    now, current = key, state()
                found.append(current.take(batch.slice(a, b - a)))
            if not found:
                continue
            took = pa.array(np.concatenate(found))
            if mark:
                yield pa.RecordBatch.from_arrays([*batch.select(names).columns, took], names=[*names, mark])
            elif (chosen := batch.select(names).filter(took)).num_rows:
                yield chosen

    return rows.mapInArrow(run, out)
