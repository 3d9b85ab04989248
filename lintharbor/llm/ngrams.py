"""Hashed character n-grams of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

from .common import mix

BITS = 16
ORDERS = (1, 2, 3)


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def letters_only(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Code points with each run of other characters as one space."""
    letter = table[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, points, np.uint32(32))[keep]


def buckets(points: np.ndarray) -> np.ndarray:
    """Hash buckets (16 bits) of all n-grams of the code points, in no particular order."""
    p = points.astype(np.uint64)
    out, rolled = [], np.zeros(len(p), dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(p) < n:
            break
        rolled = rolled[: len(p) - n + 1] * np.uint64(0x100000001B3) + p[n - 1:] + np.uint64(1)
        if n in ORDERS:
            out.append((mix(rolled) >> np.uint64(64 - BITS)).astype(np.uint16))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint16)


def counts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    b = np.sort(buckets(points))
    if not len(b):
        return b.astype(np.int64), np.zeros(0)
    first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    return b[first].astype(np.int64), np.diff(np.concatenate([first, [len(b)]])) / len(b)
