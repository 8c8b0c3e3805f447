"""What the text operators share: the shared folder, checked broadcasts and hashes."""

from __future__ import annotations

import numpy as np

from segjobs.functions.shared import discard, shared_folder, small, stored, table

__all__ = ["discard", "mixed", "run_hashes", "shared_folder", "small", "stored", "table"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (multiply and shift, twice)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` neighbouring words, in place order; none if there are fewer."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = mixed(out + hashes[i : n + i] + np.uint64(i + 1))
    return out
