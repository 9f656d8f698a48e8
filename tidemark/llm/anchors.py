"""Content-defined anchors: equal windows have equal anchors.

The anchor of a window is the leftmost of its k-grams with the smallest hash. Runs
of consecutive windows with one anchor are its segments. Anchors are sparse, so
that asking whether an anchor is met elsewhere costs little, and a window whose
anchor is met nowhere else is met nowhere else.
"""

from __future__ import annotations

import numpy as np

from . import text as T


class Segments:
    """Segments of one block, in order: `start` (first window), `count` (windows), `at` (anchor position), `anchor` (hash), `row`."""

    def __init__(self, grams: np.ndarray, rows: np.ndarray, window: int, k: int):
        """grams: hashes of the k-grams at each position; rows: bounds of the documents in positions; window and k in positions."""
        n = int(rows[-1])
        width = window - k + 1
        keys = (grams >> T.U(32) << T.U(32)) | np.arange(len(grams), dtype=T.U)
        low = (T.sliding_min(keys, width) & T.U(0xFFFFFFFF)).astype(np.int64)
        last = rows[1:] - window  # a document's last window
        first_of = rows[:-1]
        ok = last >= first_of
        starts = np.zeros(0, np.int64)
        if ok.any():
            sizes = (last - first_of + 1)[ok]
            starts = np.repeat(first_of[ok] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        self.windows = starts
        row = np.repeat(np.flatnonzero(ok), (last - first_of + 1)[ok]) if ok.any() else starts
        at = low[starts] if len(starts) else starts
        new = np.ones(len(starts), bool)
        if len(starts):
            new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        cut = np.flatnonzero(new)
        self.start, self.at, self.row = starts[cut], at[cut], row[cut]
        self.count = np.diff(np.append(cut, len(starts)))
        self.anchor = grams[self.at]
        self.n = n

    def each(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every window of the chosen segments: its segment, and its start."""
        size = self.count[chosen]
        total = int(size.sum())
        seg = np.repeat(chosen, size)
        return seg, np.repeat(self.start[chosen] - (np.cumsum(size) - size), size) + np.arange(total)
