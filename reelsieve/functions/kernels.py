"""Numeric kernels over small pixel grids, as Arrow UDFs: perceptual hashes and structural similarity.

They take grey grids as arrays; decoding and neural models stay behind the registry in ``plugins``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _bits(flags: np.ndarray) -> int:
    n = 0
    for b in flags.ravel().tolist():
        n = n << 1 | bool(b)
    return n - 2**64 if n >= 2**63 else n


def dct_hash(grid: np.ndarray) -> int:
    """Low frequencies of the cosine transform above their median, 64 bits."""
    n = len(grid)
    k = np.arange(n)
    c = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (c @ grid @ c.T)[:8, :8]
    return _bits(low > np.median(low))


def gradient_hash(grid: np.ndarray) -> int:
    """Whether brightness rises to the right, on a grid of 8 rows and 9 columns."""
    rows = np.linspace(0, grid.shape[0] - 1, 8).round().astype(int)
    cols = np.linspace(0, grid.shape[1] - 1, 9).round().astype(int)
    g = grid[np.ix_(rows, cols)]
    return _bits(g[:, 1:] > g[:, :-1])


def haar_hash(grid: np.ndarray) -> int:
    """Coarsest averages of the Haar transform above their median, 64 bits."""
    g = grid.astype(float)
    while min(g.shape) >= 16:
        g = (g[0::2, 0::2] + g[1::2, 0::2] + g[0::2, 1::2] + g[1::2, 1::2]) / 4
    g = g[:8, :8]
    return _bits(g > np.median(g))


def structural_similarity(a: np.ndarray, b: np.ndarray, window: int = 7, top: float = 255.0) -> float:
    """Mean structural similarity over windows of equal weights; grids smaller than one are one window."""
    w = min(window, *a.shape)
    view = lambda x: np.lib.stride_tricks.sliding_window_view(x.astype(float), (w, w))
    x, y = view(a), view(b)
    n = w * w
    mx, my = x.mean((-1, -2)), y.mean((-1, -2))
    fix = n / max(1, n - 1)
    vx, vy = fix * ((x * x).mean((-1, -2)) - mx * mx), fix * ((y * y).mean((-1, -2)) - my * my)
    cov = fix * ((x * y).mean((-1, -2)) - mx * my)
    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2
    return float(((2 * mx * my + c1) * (2 * cov + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean())


def hash_udf(kernel, side: int):
    """A hash kernel over arrays of side x side grey values; null for other lengths."""

    @F.pandas_udf("bigint")
    def run(grids: pd.Series) -> pd.Series:
        return grids.map(lambda g: kernel(np.asarray(g, float).reshape(side, side)) if g is not None and len(g) == side * side else None).astype("Int64")

    return run
