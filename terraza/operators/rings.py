"""Rings of points with fewer corners: Douglas-Peucker from the point that lies farthest from the first.

All rings of a block are split side by side, each round cutting every open side of every ring at once, so numpy runs once a round and
not once a side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

AT_ONCE = 65_536  #: points of a block of rings; a larger ring is a block of its own


def keep(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a ring (n, 2), without its closing point, stay; all where fewer than three would."""
    return kept(points, np.array([len(points)]), tolerance)


def kept(points: np.ndarray, sizes: np.ndarray, tolerance: float) -> np.ndarray:
    """The same for rings of these sizes that follow one another in points."""
    out, ends = np.ones(len(points), bool), np.cumsum(sizes)
    if tolerance <= 0 or not len(sizes):
        return out
    for rings in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(ends // AT_ONCE)) + 1):
        own, n = slice(ends[rings[0]] - sizes[rings[0]], ends[rings[-1]]), sizes[rings]
        if (n > 3).any():
            block, large = out[own], np.repeat(n > 3, n)
            block[large] = _split(points[own][large], n[n > 3], tolerance)
    return out


def _split(points: np.ndarray, sizes: np.ndarray, tolerance: float) -> np.ndarray:
    """The same for rings of more than three points."""
    ends = np.cumsum(sizes)
    x, y = np.insert(points, ends, points[ends - sizes], axis=0).T.astype(float)  # each ring with its closing point
    a = ends - sizes + np.arange(len(sizes))
    b, stays, least = a + sizes, np.zeros(len(x), bool), -np.inf
    closing = b
    stays[a] = True
    while len(a):
        # In the first round a side is a whole ring, both its ends one point, and is cut in any case.
        inner = b - a - 1
        first = np.cumsum(inner) - inner
        at = np.repeat(a + 1 - first, inner) + np.arange(inner.sum())
        with np.errstate(invalid="ignore", over="ignore"):
            dx, dy = x[b] - x[a], y[b] - y[a]
            square = dx * dx + dy * dy
            ax, ay, dx, dy, square = (np.repeat(v, inner) for v in (x[a], y[a], dx, dy, np.where(square > 0, square, 1)))
            t = np.clip(((x[at] - ax) * dx + (y[at] - ay) * dy) / square, 0, 1)
            away = np.hypot(x[at] - (ax + t * dx), y[at] - (ay + t * dy))
        away = np.where(away >= 0, away, -1)  # no number is nearer than any
        most = np.maximum.reduceat(away, first)
        corner = np.minimum.reduceat(np.where(away == np.repeat(most, inner), at, len(x)), first)
        cut = most > least
        a, corner, b, least = a[cut], corner[cut], b[cut], tolerance
        stays[corner] = True
        a, b = np.concatenate([a, corner]), np.concatenate([corner, b])
        a, b = a[b - a > 1], b[b - a > 1]
    stays = np.delete(stays, closing)
    return stays | np.repeat(np.add.reduceat(stays, ends - sizes, dtype=int) < 3, sizes)


def simplified(ring: Column, tolerance: float) -> Column:
    """An array of (x, y) structs, its closing point left out, without the corners that lie within the tolerance."""

    @F.arrow_udf("array<struct<x:double,y:double>>")
    def drop(column: pa.Array) -> pa.Array:
        sizes, flat = column.value_lengths().fill_null(0).to_numpy(), column.flatten()
        points = np.stack([flat.field(k).to_numpy(zero_copy_only=False) for k in "xy"], 1)
        mask = kept(points, sizes, tolerance)
        ends = np.concatenate([[0], np.concatenate([[0], np.cumsum(mask)])[np.cumsum(sizes)]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), flat.filter(pa.array(mask)))

    return drop(ring)
