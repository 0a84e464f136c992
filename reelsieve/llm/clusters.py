"""Clusters of mutually similar records by reciprocal-nearest-neighbour average linkage on a sparse graph.

1. Sparse graph. Every vector is sent to the cells of the few random directions (pivots) it is nearest
   to; within a cell, blocks of rows are compared with blocks of rows and each row is linked to the
   least row of its cell it is connected to by pairs at or above the threshold. That is one link a row
   and cell (a row and pair of blocks, where a cell is cut into blocks), never all pairs.
   Of a cell that is cut, the rows like its leader are linked to it without being compared with each other.
2. Components of that graph. Average linkage at a threshold never merges across them: an average of
   pairs at or above it needs one pair that is.
3. Linkage. Equal vectors are one weighted row from the start (their cosine is the largest there is, so
   they merge first). Then all mutual best pairs of clusters merge in parallel, round after round, until
   none is at or above the threshold. The average cosine of two clusters of unit vectors is the product
   of their mean vectors, so a round needs sums and sizes only. Each cluster keeps its best partner from
   round to round: an average to a merged cluster is never above the larger of its two parts', so only
   new clusters and those whose partner was merged look for one again, and a cluster that has no
   partner at the threshold is finished. Equal averages are ordered by a hash of the pair, the same from
   both sides, so ties merge in parallel too.

A component whose members all lie within half the threshold's angle of their mean is one cluster
without a round: any two of them are within the whole angle.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelsieve.operators.components import connected_components
from reelsieve.session import clustered, cut

THRESHOLD = 0.85
#: Nearest pivots a vector is sent to. Recall of the alike pairs is measured in the tests.
PROBES = 5
#: Vectors a cell should hold on average, per probe.
CELL_ROWS = 400
#: Most pivots; beyond about 3 million vectors cells grow, and above BLOCK_ROWS they are cut into blocks.
MOST_PIVOTS = 8192
#: Rows from which the sizes of cells are estimated.
SAMPLE_ROWS = 100_000
#: Rows of a block: a cell or component above it is cut into several.
BLOCK_ROWS = 16_384
STEP = 1024


def pivots(count: int, width: int, seed: int) -> np.ndarray:
    g = np.random.default_rng(seed).standard_normal((count, width)).astype(np.float32)
    return g / np.linalg.norm(g, axis=1, keepdims=True)


def unit_rows(ids: pa.Array, column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors as 64-bit floats) of the usable rows: ``width`` finite numbers, not all zero.

    A vector is scaled by its largest number first, so that no square overflows or vanishes.
    """
    import pyarrow.compute as pc

    fits = pc.and_(pc.equal(pc.list_value_length(column), width), pc.is_valid(ids)).fill_null(False)
    ids, column = ids.filter(fits), column.filter(fits)
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)
    most = np.abs(x).max(axis=1) if len(x) else np.zeros(0)
    good = np.isfinite(most) & (most > 0)
    x = x[good] / most[good, None]
    return ids.to_numpy(zero_copy_only=False)[good], x / np.linalg.norm(x, axis=1, keepdims=True)


#: In cells vectors travel as bytes of 8 bits a number; two of them are off by less than this.
ROUNDED = 0.01


def _cells(count: int, width: int, seed: int, probes: int):
    """(cell, id, rounded vector) for each of a vector's nearest pivots."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = pivots(count, width, seed).T
        k = min(probes, count)
        for batch in batches:
            ids, u = unit_rows(batch.column(0), batch.column(1), width)
            u = u.astype(np.float32)
            for i in range(0, len(u), 2048):
                part = u[i : i + 2048]
                near = np.argpartition(part @ g, count - k, axis=1)[:, count - k :]
                raw = np.rint(part * (127 / np.abs(part).max(axis=1, keepdims=True))).astype(np.int8).tobytes()
                rows = pa.array([raw[j : j + width] for j in range(0, len(raw), width)], pa.binary())
                take = np.repeat(np.arange(len(part)), k)
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), pa.array(ids[i : i + 2048][take]), rows.take(pa.array(take))], names=["cell", "id", "v"])

    return run


#: Rows sent on at once where a row of a cut cell is repeated for each pair of its block.
SENT_ROWS = 65_536


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each id (the finalizer of splitmix64)."""
    x = ids.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hot:
    """What the tasks know of the cells that are cut: a leader row each, and blocks by distance from it.

    ``blocks``: blocks of the rows unlike the leader; ``star``: (blocks of rows like it) by band of their
    angle. At most one leader a cell; cells that aren't cut have none.
    """

    def __init__(self, threshold: float):
        self.angle = math.degrees(math.acos(max(-1.0, min(1.0, threshold))))
        self.threshold = threshold
        self.leader: dict[int, tuple[int, np.ndarray]] = {}
        self.blocks: dict[int, int] = {}
        self.star: dict[int, dict[int, int]] = {}

    def angles(self, cell: int, v: np.ndarray) -> np.ndarray:
        """Angles to the cell's leader of rounded vectors, in degrees."""
        u = v.astype(np.float32)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        return np.degrees(np.arccos(np.clip(u @ self.leader[cell][1], -1, 1)))


#: Width of a band of angles, in degrees, and what rounding may add to an angle.
BAND, SLACK = 4.0, 1.5


def _paired_cells(count: int, width: int, seed: int, probes: int, hot: Hot):
    """(cell, i, j, lower, id, rounded vector): the groups in which rows of a cell are compared.

    A cell that isn't cut is the group (0, 0). In a cut one the rows like the leader are linked to it
    and need no comparison with each other: each goes to one block of its band (-1 - band, block). The
    others go once to every pair of their block with a block of others (i <= j; ``lower``: the row's block
    is i), and to the blocks of those bands that can hold a row like them (``lower``).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cells(count, width, seed, probes)(batches):
            cell = batch.column(0).to_numpy()
            cut_ = np.isin(cell, list(hot.leader)) if hot.leader else np.zeros(len(cell), bool)
            n = int((~cut_).sum())
            if n:
                whole = batch.filter(pa.array(~cut_))
                zero = pa.array(np.zeros(n, np.int32))
                yield pa.RecordBatch.from_arrays([whole.column(0), zero, zero, pa.array(np.ones(n, bool)), whole.column(1), whole.column(2)], names=["cell", "i", "j", "lower", "id", "v"])
            for c in np.unique(cell[cut_]).tolist():
                rows = batch.filter(pa.array(cell == c))
                ids = rows.column(1).to_numpy()
                far = hot.angles(c, np.frombuffer(b"".join(rows.column(2).to_pylist()), np.int8).reshape(-1, width))
                mixed, star = _mixed(ids), hot.star[c]
                like = far <= hot.angle
                take, i, j, lower = [], [], [], []

                def add(at, first, second, low):
                    take.append(at), i.append(np.broadcast_to(first, at.shape)), j.append(np.broadcast_to(second, at.shape)), lower.append(np.broadcast_to(low, at.shape))

                band = (far / BAND).astype(np.int64)
                for b, m in star.items():
                    at = np.flatnonzero(like & (np.minimum(band, max(star)) == b))
                    add(at, -1 - b, (mixed[at] % np.uint64(m)).astype(np.int64), False)
                    top = 180.0 if b == max(star) else (b + 1) * BAND
                    near = np.flatnonzero(~like & (far <= top + hot.angle + SLACK))
                    for k in range(m):
                        add(near, -1 - b, k, True)
                rest = np.flatnonzero(~like)
                blocks = hot.blocks[c]
                mine = (mixed[rest] % np.uint64(blocks)).astype(np.int64)
                for k in range(blocks):
                    add(rest, np.minimum(mine, k), np.maximum(mine, k), mine <= k)
                at = np.concatenate(take)
                columns = [np.concatenate(x) for x in (i, j, lower)]
                for b in range(0, len(at), SENT_ROWS):
                    part = rows.take(pa.array(at[b : b + SENT_ROWS]))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(columns[0][b : b + SENT_ROWS].astype(np.int32)), pa.array(columns[1][b : b + SENT_ROWS].astype(np.int32)), pa.array(columns[2][b : b + SENT_ROWS]), part.column(1), part.column(2)], names=["cell", "i", "j", "lower", "id", "v"])

    return run


def links_within(ids: np.ndarray, u: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id of its connected group), for ids that have a pair at or above the threshold.

    Rows come in order of id; each block is compared with all rows up to it. ``group`` holds the
    place of the least row known to be connected; a row that links several groups unites them.
    """
    n = len(ids)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for b in range(0, n, STEP):
        e = min(n, b + STEP)
        near = (u[b:e] @ u[:e].T) >= threshold
        near[np.arange(e - b), np.arange(b, e)] = False
        r, c = np.nonzero(near)
        lower = c < r + b
        r, c = r[lower], c[lower]
        if not len(r):
            continue
        while (up := parent[parent]).tobytes() != parent.tobytes():
            parent = up
        # one link to each different group a row of the block touches
        pair = np.unique(r.astype(np.int64) * n + parent[c])
        for x, y in zip((pair // n + b).tolist(), (pair % n).tolist()):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
    while (up := parent[parent]).tobytes() != parent.tobytes():
        parent = up
    linked = ids[parent] != ids  # a repeated id is no link to itself
    return ids[linked], ids[parent[linked]]


def links_across(ids: np.ndarray, u: np.ndarray, lower: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """As links_within, by the pairs of a row of one block (``lower``) and one of another only."""
    n = len(ids)
    label = np.arange(n)
    x, y = np.flatnonzero(lower), np.flatnonzero(~lower)
    other, b, step = u[y].T, 0, 8
    while b < len(x):
        # few rows first: they unite the groups of a dense cell, so that the rest touches few of them
        rows = x[b : b + step]
        b, step = b + step, min(2 * step, 256)
        r, c = np.nonzero(u[rows] @ other >= threshold)
        if not len(r):
            continue
        pair = np.unique(label[rows[r]] * n + label[y[c]])
        parent = {}

        def root(i: int) -> int:
            while (up := parent.get(i, i)) != i:
                parent[i] = parent.get(up, up)
                i = up
            return i

        for p, q in zip((pair // n).tolist(), (pair % n).tolist()):
            p, q = root(p), root(q)
            if p != q:
                parent[max(p, q)] = min(p, q)
        if parent:
            to = np.arange(n)
            to[list(parent)] = [root(i) for i in list(parent)]
            label = to[label]
    linked = ids[label] != ids
    return ids[linked], ids[label[linked]]


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows with equal first ``keys`` columns; the partition is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cut = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut, cut[1:]):
            now = tuple(k[:, a].tolist())
            if held and now != last:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield held


def _joined(held: list[pa.RecordBatch], i: int) -> pa.Array:
    return held[0].column(i) if len(held) == 1 else pa.concat_arrays([h.column(i) for h in held])


def _link_cells(width: int, threshold: float, hot: Hot):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in sorted_groups(batches, 3):
            cell, i, j = (held[0].column(k)[0].as_py() for k in range(3))
            ids = _joined(held, 4).to_numpy(zero_copy_only=False)
            lower = _joined(held, 3).to_numpy(zero_copy_only=False)
            found = []
            if i < 0:
                star = ids[~lower]
                found.append((star, np.full(len(star), hot.leader[cell][0])))
            if len(ids) > 1 and (i >= 0 or (lower.any() and not lower.all())):
                u = np.frombuffer(b"".join(_joined(held, 5).to_pylist()), np.int8).reshape(-1, width).astype(np.float32)
                u /= np.linalg.norm(u, axis=1, keepdims=True)
                order = np.argsort(ids, kind="stable")
                found.append(links_within(ids[order], u[order], threshold - ROUNDED) if i == j else links_across(ids[order], u[order], lower[order], threshold - ROUNDED))
            a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(2))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), cell, np.int32)), pa.array(a), pa.array(b)], names=["cell", "a", "b"])

    return run


def _pair_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair of ids, the same from both sides: the order among equal averages."""
    x, y = _mixed(a), _mixed(b)
    return _mixed((x ^ y) + x * y)


def best_of(mean: np.ndarray, ids: np.ndarray, rows: np.ndarray, others: np.ndarray, other_ids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(place of the best other cluster or -1, average cosine) of some clusters, those below the threshold having none.

    ``rows`` are places in ``mean`` and ``ids``; ``others`` are the mean vectors to choose from, with
    their ids. A cluster is never its own partner.
    """
    best, score = np.full(len(rows), -1), np.full(len(rows), -np.inf)
    step = max(16, 4_000_000 // max(1, len(others)))
    for b in range(0, len(rows), step):
        at = rows[b : b + step]
        s = np.round(mean[at] @ others.T, 12)
        s[ids[at][:, None] == other_ids[None, :]] = -np.inf
        top = s.max(axis=1)
        choice = s.argmax(axis=1)
        for i in np.flatnonzero(((s == top[:, None]).sum(axis=1) > 1) & (top >= threshold - 1e-12)):
            tied = np.flatnonzero(s[i] == top[i])
            choice[i] = tied[_pair_order(np.full(len(tied), ids[at[i]]), other_ids[tied]).argmin()]
        ok = top >= threshold - 1e-12
        best[b : b + step], score[b : b + step] = np.where(ok, choice, -1), np.where(ok, top, -np.inf)
    return best, score


def link_rounds(total: np.ndarray, size: np.ndarray, threshold: float, ids: np.ndarray | None = None) -> np.ndarray:
    """The cluster (place of its first member) of each of some clusters, given by sums and sizes."""
    n = len(size)
    ids = np.arange(n) if ids is None else ids
    label, best = np.arange(n), np.full(n, -1)
    total, size = total.astype(np.float64).copy(), size.astype(np.float64).copy()
    mean = total / size[:, None]
    alive = stale = np.arange(n)
    while len(alive) > 1:
        found, _ = best_of(mean, ids, stale, mean[alive], ids[alive], threshold)
        best[stale] = np.where(found >= 0, alive[found], -1)
        alive = alive[best[alive] >= 0]
        if not len(alive):
            break
        merge = alive[(best[best[alive]] == alive) & (alive < best[alive])]
        if not len(merge):
            # a kept partner can tie with a new cluster; looked up afresh, the first of all pairs is mutual
            if len(stale) == len(alive):
                break
            stale = alive
            continue
        gone = best[merge]
        np.add.at(total, merge, total[gone])
        np.add.at(size, merge, size[gone])
        mean[merge] = total[merge] / size[merge, None]
        label[gone] = merge
        ended = np.zeros(n, bool)
        ended[gone] = True
        alive = alive[~ended[alive]]
        changed = ended
        changed[merge] = True
        stale = alive[changed[alive] | changed[best[alive]]]
    while (up := label[label]).tobytes() != label.tobytes():
        label = up
    return label


def half_angle(threshold: float) -> float:
    """The cosine of half the threshold's angle, a little above it for rounding."""
    return math.sqrt((1 + threshold) / 2) + 1e-9


RESULT = "id bigint, cluster_id bigint, typicality double, all_alike boolean, alike_outside boolean"


def judge(u: np.ndarray, count: np.ndarray, label: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(typicality, all alike within, alike to one outside) of each different vector, pair by pair in blocks."""
    n = len(u)
    total = np.zeros_like(u)
    np.add.at(total, label, u * count[:, None])
    norm = np.linalg.norm(total[label], axis=1)
    typical = np.einsum("ij,ij->i", u, total[label]) / np.where(norm > 0, norm, 1)
    least, most = np.ones(n), np.full(n, -1.0)
    step = max(16, 4_000_000 // n)
    for b in range(0, n, step):
        s = u[b : b + step] @ u.T
        same = label[b : b + step, None] == label[None, :]
        least[b : b + step] = np.where(same, s, 1.0).min(axis=1)
        most[b : b + step] = np.where(same, -1.0, s).max(axis=1)
    inside, outside = np.ones(n, bool), np.zeros(n, bool)
    np.logical_and.at(inside, label, least >= threshold - 1e-9)
    np.logical_or.at(outside, label, most >= threshold - 1e-9)
    return typical, inside[label], outside[label]


def link_component(ids: np.ndarray, u: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, typicality, all alike within, alike to one outside) of one component's rows in order of id."""
    n = len(ids)
    mean = u.sum(axis=0)
    to_mean = u @ (mean / max(np.linalg.norm(mean), 1e-300))
    if to_mean.min() >= half_angle(threshold):
        return np.zeros(n, np.int64), to_mean, np.ones(n, bool), np.zeros(n, bool)
    one, first, of, count = np.unique(np.round(u, 12), axis=0, return_index=True, return_inverse=True, return_counts=True)
    # equal vectors as one row of that size, in order of the least id
    order = np.argsort(first)
    one, first, count, of = one[order], first[order], count[order].astype(np.float64), np.argsort(order)[of.ravel()]
    if len(one) <= 2048 and (one @ one.T).min() >= threshold - 1e-9:
        # every pair is alike, so every average is: linkage ends in one cluster
        return np.zeros(n, np.int64), to_mean, np.ones(n, bool), np.zeros(n, bool)
    label = link_rounds(one * count[:, None], count, threshold, ids[first])
    typical, inside, outside = judge(one, count, label, threshold)
    return first[label][of], typical[of], inside[of], outside[of]


def _link_components(width: int, threshold: float):
    """Linkage of each whole component; its rows follow each other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in sorted_groups(batches, 1):
            ids, u = unit_rows(_joined(held, 1), _joined(held, 2), width)
            order = np.lexsort((*u.T[::-1], ids))
            ids, u = ids[order], u[order]
            new = np.r_[True, ids[1:] != ids[:-1]][: len(ids)]
            ids, u = ids[new], u[new]  # a repeated id counts once, with its least vector
            if not len(ids):
                continue
            label, typical, inside, outside = link_component(ids, u, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label]), pa.array(np.round(typical, 9)), pa.array(inside), pa.array(outside)], names=["id", "cluster_id", "typicality", "all_alike", "alike_outside"])

    return run


def _pack(x: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(x).tobytes()
    w = x.shape[1] * x.itemsize
    return pa.array([raw[i : i + w] for i in range(0, len(raw), w)], pa.binary())


def _unpack(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _unit(width: int):
    """(component, id, unit vector) in the form the rounds below take."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = pa.array(np.arange(b.num_rows))
            keep, u = unit_rows(at, b.column(2), width)
            t = b.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), _pack(np.round(u, 12) + 0.0)], names=["component", "id", "v"])

    return run


def _least_of_each(width: int):
    """The row with the least vector of each id, as in _link_components; an id's rows follow each other."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in sorted_groups(batches, 2):
            rows = pa.concat_batches(held)
            yield rows.slice(int(np.lexsort(_unpack(rows.column(2), width).T[::-1])[0]), 1)

    return run


def _weighted(width: int):
    """(component, id, total, size) of rows component, id, v, size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = _unpack(b.column(2), width) * b.column(3).to_numpy(zero_copy_only=False)[:, None]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _pack(total), b.column(3)], names=["component", "id", "total", "size"])

    return run


def _sums(width: int):
    """(key, sum of size times vector, size) of the batch's keys: the map side of a sum of vectors.

    Rows: key, vector, size. A partition keeps one sum a key it meets.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        total, size = np.zeros((64, width)), np.zeros(64)
        for b in batches:
            keys, at = np.unique(b.column(0).to_numpy(), return_inverse=True)
            place = np.array([held.setdefault(k, len(held)) for k in keys.tolist()], np.int64)
            while len(held) > len(size):
                total, size = np.concatenate([total, np.zeros_like(total)]), np.concatenate([size, np.zeros_like(size)])
            n = b.column(2).to_numpy(zero_copy_only=False)
            np.add.at(total, place[at], _unpack(b.column(1), width) * n[:, None])
            np.add.at(size, place[at], n)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), _pack(total[: len(held)]), pa.array(size[: len(held)])], names=["key", "total", "size"])

    return run


def _added(width: int):
    """The sums of equal keys; a key's rows follow each other, in any number of batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in sorted_groups(batches, 1):
            total = sum(_unpack(h.column(1), width).sum(axis=0) for h in held)
            size = sum(float(h.column(2).to_numpy(zero_copy_only=False).sum()) for h in held)
            yield pa.RecordBatch.from_arrays([held[0].column(0).slice(0, 1), _pack(total[None, :]), pa.array([size])], names=["key", "total", "size"])

    return run


def sum_vectors(rows: DataFrame, width: int) -> DataFrame:
    """(key, total, size) of rows (key, v, size): partial sums first, so a hot key is no hot task."""
    kind = "key bigint, total binary, size double"
    return clustered(rows.mapInArrow(_sums(width), kind), "key").mapInArrow(_added(width), kind)


def _merge_blocks(width: int, threshold: float):
    """(id, cluster) of the clusters of one whole component, merged to the end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in sorted_groups(batches, 1):
            ids = _joined(held, 1).to_numpy(zero_copy_only=False)
            order = np.argsort(ids)
            label = link_rounds(_unpack(_joined(held, 2), width)[order], _joined(held, 3).to_numpy(zero_copy_only=False)[order], threshold, ids[order])
            yield pa.RecordBatch.from_arrays([pa.array(ids[order]), pa.array(ids[order][label])], names=["id", "cluster"])

    return run


def _best_partners(width: int, threshold: float):
    """(id, partner, order, score): the best partner of each asking cluster within one pair of blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in sorted_groups(batches, 3):
            ids = _joined(held, 3).to_numpy(zero_copy_only=False)
            asks = _joined(held, 4).to_numpy(zero_copy_only=False)
            mean = _unpack(_joined(held, 5), width) / _joined(held, 6).to_numpy(zero_copy_only=False)[:, None]
            at, own = np.flatnonzero(asks), np.flatnonzero(~asks)
            if not len(at) or not len(own):
                continue
            best, score = best_of(mean, ids, at, mean[own], ids[own], threshold)
            ok = best >= 0
            a, b = ids[at[ok]], ids[own[best[ok]]]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(_pair_order(a, b).view(np.int64) ^ np.int64(-(2**63))), pa.array(score[ok])], names=["id", "partner", "tie", "score"])

    return run


def _block_of(blocks: str):
    return F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")


def _asked(state: DataFrame, stale: DataFrame, block_rows: int) -> DataFrame:
    """(component, i, j, id, asks, total, size): each stale cluster for every block of its component, each
    cluster once for every block of stale ones. The pairs of blocks are compared, no pair is made."""
    asking = state.join(stale, "id", "left_semi")
    have = state.groupBy("component").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n"))
    want = asking.groupBy("component").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("m"))
    size = have.join(want, "component")
    left = asking.join(size, "component").withColumns({"i": _block_of("m"), "asks": F.lit(True)}).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    right = state.join(size, "component").withColumns({"j": _block_of("n"), "asks": F.lit(False)}).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    cols = ["component", "i", "j", "id", "asks", "total", "size"]
    return left.select(*cols).unionAll(right.select(*cols))


def _pair_limits(width: int):
    """(id, least within the cluster, most across clusters) within one pair of blocks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in sorted_groups(batches, 3):
            ids = _joined(held, 3).to_numpy(zero_copy_only=False)
            u, label = _unpack(_joined(held, 4), width), _joined(held, 5).to_numpy(zero_copy_only=False)
            step = max(16, 4_000_000 // len(ids))
            for b in range(0, len(ids), step):
                s = u[b : b + step] @ u.T
                same = label[b : b + step, None] == label[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(ids[b : b + step]), pa.array(np.where(same, s, 1.0).min(axis=1)), pa.array(np.where(same, -1.0, s).max(axis=1))], names=["id", "least", "most"])

    return run


def _to_centre(width: int):
    """(id, cluster, cosine to the cluster's centre) of rows id, cluster, v, centre."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, c = _unpack(b.column(2), width), _unpack(b.column(3), width)
            t = np.einsum("ij,ij->i", u, c) / np.maximum(np.linalg.norm(c, axis=1), 1e-300)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(t)], names=["id", "cluster", "typicality"])

    return run


def _centred(rows: DataFrame, width: int) -> DataFrame:
    """(id, cluster, typicality) of rows (id, cluster, v, size)."""
    centre = sum_vectors(rows.select(F.col("cluster").alias("key"), "v", "size"), width).select(F.col("key").alias("cluster"), F.col("total").alias("centre"))
    return rows.join(centre, "cluster").select("id", "cluster", "v", "centre").mapInArrow(_to_centre(width), "id bigint, cluster bigint, typicality double")


STATE = "component bigint, id bigint, total binary, size double"


def _giant_components(members: DataFrame, width: int, threshold: float, block_rows: int) -> DataFrame:
    """Linkage of components too large for one task; ``members``: (component, id, v).

    The same rounds as link_rounds, over all pairs of blocks of a component, so the clusters are those
    that one task would find. A component ends in one task as soon as the clusters that still have a
    partner fit a block; sums and sizes are all that a round needs.
    """
    kind = "component bigint, id bigint, v binary"
    every = cut(clustered(members.mapInArrow(_unit(width), kind), "component", "id").mapInArrow(_least_of_each(width), kind))
    # equal vectors are one row of their number, known by the least id; this combines before the shuffle
    units = cut(every.groupBy("component", "v").agg(F.min("id").alias("id"), F.count("*").cast("double").alias("size")))
    known = units.select("component", "v", F.col("id").alias("unit"))
    of_unit = every.join(known, ["component", "v"]).select("id", "unit")

    # components within half the angle of their mean are whole clusters
    whole = cut(_centred(units.select("id", F.col("component").alias("cluster"), "v", "size"), width).groupBy("cluster").agg(F.min("typicality").alias("t")).where(F.col("t") >= half_angle(threshold)).select(F.col("cluster").alias("component")))
    loose = units.join(whole, "component", "left_anti")
    state = cut(loose.select("component", "id", "v", "size").mapInArrow(_weighted(width), STATE))
    of = state.select("id", F.col("id").alias("cluster"))
    best, stale = None, state.select("id")

    def apply(step: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Clusters and membership after the merges (id, cluster) of ``step``."""
        moved = cut(of.withColumnRenamed("cluster", "old").join(step.withColumnRenamed("id", "old"), "old", "left").select("id", F.coalesce("cluster", "old").alias("cluster")))
        merged = step.join(state, "id")
        sums = sum_vectors(merged.select(F.col("cluster").alias("key"), F.col("total").alias("v"), F.lit(1.0).alias("size")), width).select(F.col("key").alias("id"), "total")
        sizes = merged.groupBy(F.col("cluster").alias("id")).agg(F.min("component").alias("component"), F.sum("size").alias("size"))
        rest = state.join(step, "id", "left_anti")
        return cut(rest.unionByName(sums.join(sizes, "id").select("component", "id", "total", "size"))), moved

    while True:
        counts = cut(state.groupBy("component").agg(F.count("*").alias("n")))
        if (counts.agg(F.max("n")).first()[0] or 0) <= block_rows:
            break
        fresh = clustered(_asked(state, stale, block_rows), "component", "i", "j").mapInArrow(_best_partners(width, threshold), "id bigint, partner bigint, tie bigint, score double")
        fresh = fresh.groupBy("id").agg(F.max_by("partner", F.struct("score", (-F.col("tie")).alias("t"))).alias("partner"))
        best = cut(fresh if best is None else best.join(stale, "id", "left_anti").unionByName(fresh))
        # what has no partner at the threshold never gets one
        state = cut(state.join(best, "id", "left_semi"))
        back = best.select(F.col("id").alias("partner"), F.col("partner").alias("id"))
        merge = cut(best.join(back, ["id", "partner"]).where("id > partner"))
        if merge.isEmpty():
            if best.isEmpty() or state.join(stale, "id", "left_anti").isEmpty():
                break
            stale, best = state.select("id"), None
            continue
        pair = merge.select("id", F.col("partner").alias("cluster")).unionAll(merge.select(F.col("partner").alias("id"), F.col("partner").alias("cluster")))
        touched = pair.select(F.col("id").alias("t"))
        state, of = apply(pair)
        lost = best.join(touched, best["partner"] == touched["t"], "left_semi").select("id")
        stale = cut(lost.unionAll(merge.select(F.col("partner").alias("id"))).distinct().join(state, "id", "left_semi"))
        best = cut(best.join(state, "id", "left_semi"))
    fits = counts.where(F.col("n") <= block_rows).select("component")
    step = clustered(state.join(fits, "component").select("component", "id", "total", "size"), "component").mapInArrow(_merge_blocks(width, threshold), "id bigint, cluster bigint")
    moved = of.withColumnRenamed("cluster", "old").join(step.withColumnRenamed("id", "old"), "old", "left").select("id", F.coalesce("cluster", "old").alias("cluster"))
    least = units.join(whole, "component").groupBy("component").agg(F.min("id").alias("cluster"))
    moved = moved.unionByName(units.join(least, "component").select("id", "cluster"))
    placed = cut(units.join(moved, "id").select("component", "id", "v", "size", "cluster"))

    scored = _centred(placed.select("id", "cluster", "v", "size"), width)
    rows = placed.join(whole, "component", "left_anti")
    blocks = rows.groupBy("component").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n"))
    at = rows.join(blocks, "component").withColumn("mine", _block_of("n")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = at.select("component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "id", F.col("v").alias("total"), "cluster")
    limits = clustered(pairs, "component", "i", "j").mapInArrow(_pair_limits(width), "id bigint, least double, most double")
    limits = limits.groupBy("id").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    flags = rows.select("id", "cluster").join(limits, "id").groupBy("cluster").agg((F.min("least") >= threshold - 1e-9).alias("all_alike"), (F.max("most") >= threshold - 1e-9).alias("alike_outside"))
    out = scored.join(flags, "cluster", "left").select(F.col("id").alias("unit"), F.col("cluster").alias("cluster_id"), F.round("typicality", 9).alias("typicality"), F.coalesce("all_alike", F.lit(True)).alias("all_alike"), F.coalesce("alike_outside", F.lit(False)).alias("alike_outside"))
    return of_unit.join(out, "unit").select("id", "cluster_id", "typicality", "all_alike", "alike_outside")


def pivot_count(rows: int) -> int:
    return int(min(MOST_PIVOTS, max(8, 2 ** math.ceil(math.log2(max(1, rows / CELL_ROWS))))))


def sparse_links(df: DataFrame, id_column: str, vector_column: str, threshold: float = THRESHOLD, width: int = 64, seed: int = 7, probes: int = PROBES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): links that connect, cell by cell, what is connected by alike pairs.

    A cell with more rows than ``block_rows`` is cut. One of its rows, the leader, is compared with all:
    those like it are linked to it, so a hot group of like rows costs its size, not its square. Only the
    others are compared with each other, block by block, and with those near enough to be like them.
    """
    rows = df.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{vector_column}`").alias("v"))
    n = df.count()
    count = pivot_count(n)
    hot = hot_cells(rows, n, count, width, seed, probes, threshold, block_rows) if n > block_rows else Hot(threshold)
    cells = rows.mapInArrow(_paired_cells(count, width, seed, probes, hot), "cell int, i int, j int, lower boolean, id bigint, v binary")
    links = clustered(cells, "cell", "i", "j").mapInArrow(_link_cells(width, threshold, hot), "cell int, a bigint, b bigint")
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def hot_cells(rows: DataFrame, n: int, count: int, width: int, seed: int, probes: int, threshold: float, block_rows: int) -> Hot:
    """The cells that are cut, from a sample of at most about SAMPLE_ROWS rows.

    Whatever comes out only spreads the work: with any leader and any number of blocks the same rows end up
    connected. The driver sees sums of one row a cell, at most MOST_PIVOTS of them.
    """
    hot = Hot(threshold)
    share = min(1.0, SAMPLE_ROWS / n)
    some = rows if share == 1.0 else rows.sample(share, seed)
    sizes = some.mapInArrow(_cells_only(count, width, seed, probes), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    cut_ = [r["cell"] for r in sizes.where(F.col("n") / share > block_rows).collect()]
    if not cut_:
        return hot
    sums = sum_vectors(some.mapInArrow(_sums_of(count, width, seed, probes, cut_), "key bigint, v binary, size double"), width)
    wanted = {r["key"]: np.frombuffer(r["total"]) for r in sums.collect()}
    best = some.mapInArrow(_nearest(count, width, seed, probes, wanted), "cell int, id bigint, v binary, far double")
    for r in best.groupBy("cell").agg(F.min_by(F.struct("id", "v"), F.struct("far", "id")).alias("r")).collect():
        v = np.frombuffer(r["r"]["v"], np.int8).astype(np.float32)
        hot.leader[r["cell"]] = (r["r"]["id"], v / np.linalg.norm(v))
    found = some.mapInArrow(_bands(count, width, seed, probes, hot), "cell int, band int, n bigint").groupBy("cell", "band").agg(F.sum("n").alias("n")).collect()
    blocks = lambda k: max(1, math.ceil(k / share / block_rows))
    for c in hot.leader:
        own = {r["band"]: r["n"] for r in found if r["cell"] == c}
        hot.blocks[c] = blocks(own.pop(-1, 0))
        hot.star[c] = {b: blocks(own.get(b, 0)) for b in range(int(hot.angle / BAND) + 1)}
    return hot


def _cells_of(batches: Iterable[pa.RecordBatch], count: int, width: int, seed: int, probes: int, wanted) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(cell, rows, rounded vectors) of the rows in some cells."""
    for b in _cells(count, width, seed, probes)(batches):
        cell = b.column(0).to_numpy()
        for c in np.intersect1d(cell, list(wanted)).tolist():
            rows = b.filter(pa.array(cell == c))
            yield c, rows, np.frombuffer(b"".join(rows.column(2).to_pylist()), np.int8).reshape(-1, width)


def _nearest(count: int, width: int, seed: int, probes: int, wanted: dict[int, np.ndarray]):
    """A task's row nearest to each cell's mean."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, int, bytes]] = {}
        for c, rows, v in _cells_of(batches, count, width, seed, probes, wanted):
            u = v / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
            at = int((u @ wanted[c]).argmax())
            one = (-float(u[at] @ wanted[c]), rows.column(1)[at].as_py(), v[at].tobytes())
            best[c] = min(best.get(c, one), one)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int32()), pa.array([x[1] for x in best.values()], pa.int64()), pa.array([x[2] for x in best.values()], pa.binary()), pa.array([x[0] for x in best.values()], pa.float64())], names=["cell", "id", "v", "far"])

    return run


def _bands(count: int, width: int, seed: int, probes: int, hot: Hot):
    """A task's rows of each cut cell by band of their angle to the leader; -1 for those unlike it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for c, _, v in _cells_of(batches, count, width, seed, probes, hot.leader):
            far = hot.angles(c, v)
            for b, k in zip(*np.unique(np.where(far <= hot.angle, (far / BAND).astype(np.int64), -1), return_counts=True)):
                seen[c, int(b)] = seen.get((c, int(b)), 0) + int(k)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in seen], pa.int32()), pa.array([b for _, b in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["cell", "band", "n"])

    return run


def _cells_only(count: int, width: int, seed: int, probes: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(count, np.int64)
        for b in _cells(count, width, seed, probes)(batches):
            total += np.bincount(b.column(0).to_numpy(), minlength=count)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    return run


def _sums_of(count: int, width: int, seed: int, probes: int, wanted: list[int]):
    """(cell, sum of its unit vectors, 1) of a task's rows in some cells."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for c, _, v in _cells_of(batches, count, width, seed, probes, wanted):
            total[c] = total.get(c, 0) + (v / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)).sum(axis=0)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), _pack(np.stack(list(total.values()))), pa.array(np.ones(len(total)))], names=["key", "v", "size"])

    return run


def linkage(df: DataFrame, id_column: str, vector_column: str, threshold: float = THRESHOLD, width: int = 64, seed: int = 7, probes: int = PROBES, block_rows: int = BLOCK_ROWS, component_rows: int = 8192) -> DataFrame:
    """(id, cluster_id, typicality, all_alike, alike_outside) of each id that has a link.

    ``cluster_id`` is the least id of the cluster, ``typicality`` the cosine to its mean.
    ``all_alike``: all pairs of the cluster are at or above the threshold; ``alike_outside``: some
    pair with one outside is. Both come from the vectors themselves, pair by pair within components.
    """
    links = sparse_links(df, id_column, vector_column, threshold, width, seed, probes, block_rows)
    component = connected_components(links, "a", "b")
    sizes = component.groupBy("component").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    rows = df.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{vector_column}`").alias("v"))
    members = rows.join(component, rows["id"] == component["node"]).select("component", "id", "v")
    small, giant = members, None
    if most > component_rows:
        large = sizes.where(F.col("n") > component_rows).select("component")
        small, giant = members.join(large, "component", "left_anti"), members.join(large, "component", "left_semi")
    found = clustered(small, "component").mapInArrow(_link_components(width, threshold), RESULT)
    return found if giant is None else found.unionByName(_giant_components(giant, width, threshold, component_rows))


def clusters(df: DataFrame, id_column: str, vector_column: str, representatives: int = 3, **options) -> DataFrame:
    """(id, cluster_id, cluster_size, typicality, is_representative, all_alike, alike_outside).

    One row for each id with a usable vector (``width`` finite numbers, not all zero, of any length)
    that is in a cluster with another; repeated ids count once (of differing vectors of an id the
    least). The ``representatives`` most typical members, of equals the least ids, are its
    ``is_representative`` ones. Rows with null ids or unusable vectors are in no cluster; an empty
    table gives no row. Other columns aren't read. ``options`` as for ``linkage``.
    """
    found = cut(linkage(df, id_column, vector_column, **options))
    sizes = found.groupBy("cluster_id").agg(F.count("*").alias("cluster_size")).where("cluster_size > 1")
    # the filter on the rank limits each cluster before the shuffle, so a hot cluster is never sorted whole
    order = Window.partitionBy("cluster_id").orderBy(F.desc("typicality"), "id")
    best = found.select("id", "cluster_id", "typicality").withColumn("k", F.row_number().over(order)).where(F.col("k") <= representatives)
    out = found.join(sizes, "cluster_id").join(best.select("id", F.lit(True).alias("best")), "id", "left")
    return out.select("id", "cluster_id", "cluster_size", "typicality", F.coalesce("best", F.lit(False)).alias("is_representative"), "all_alike", "alike_outside")
