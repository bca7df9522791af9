"""Repeatable chance numbers from ids."""

from __future__ import annotations

import numpy as np


def unit(ids: np.ndarray) -> np.ndarray:
    """A number in (0, 1] for each id."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
