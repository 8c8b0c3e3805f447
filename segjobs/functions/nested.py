"""Nested Arrow lists of rings as flat numpy arrays, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
RINGS = pa.list_(pa.list_(POINT))
PARTS = pa.list_(RINGS)


def sizes(lists: pa.Array) -> np.ndarray:
    """Lengths of lists, 0 for null ones."""
    return np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)


def flat_points(points: pa.Array) -> np.ndarray:
    """x and y of an array of points, NaN where they or the points are null."""
    if not len(points):
        return np.empty((0, 2))
    out = np.stack([points.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)], axis=1).astype(np.float64)
    if points.null_count:
        out[~points.is_valid().to_numpy(zero_copy_only=False)] = np.nan
    return out


def offsets(count: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))


def points_array(points: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays(
        [pa.array(np.ascontiguousarray(points[:, k], np.float64)) for k in (0, 1)], fields=list(POINT)
    )


def rings_array(polygons: list[list[np.ndarray]]) -> pa.Array:
    """One list of rings for each polygon."""
    rings = [r for p in polygons for r in p]
    points = points_array(np.concatenate(rings) if rings else np.empty((0, 2)))
    by_ring = pa.ListArray.from_arrays(offsets(np.array([len(r) for r in rings], np.int64)), points)
    return pa.ListArray.from_arrays(offsets(np.array([len(p) for p in polygons], np.int64)), by_ring)
