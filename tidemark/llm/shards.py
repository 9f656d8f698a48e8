"""A shard of surroundings on disk, divided until each part fits in memory.

Equal windows have the same anchor at the same offset. Too large a shard is dealt
by anchor; surroundings of one anchor are dealt by halves of that offset's range and
by the bytes that all windows of a half have in common, which are more of the window
the smaller the range is. So windows that are equal meet in one part. Of equal
pieces that a division meets one goes on, marked as met more than once, and the others
take over what its sort finds.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

from . import text as T

#: A piece: its place in the shard's bytes, windows, anchor after that place, place of its first flag, routing key, times met (2 at most).
_ITEM = np.dtype([("pos", "<i8"), ("n", "<i4"), ("at", "<i4"), ("flag", "<i8"), ("key", "<u8"), ("times", "u1")])
_CHUNK, _FILES = 1 << 12, 256
#: Flags of a window: it repeats; its piece is met more than once.
_AGAIN, _OFTEN = 1, 2
#: A piece left out by a division: place of its first flag, that of its equal's, windows.
_LEFT_OUT = np.dtype([("flag", "<i8"), ("equal", "<i8"), ("n", "<i8")])


class Shard:
    """`add` pieces, `solve`, then read each piece's flags in order. `sort(pieces, times)` tells which windows of different pieces repeat, each met `times` times; it gets `limit` bytes at most."""

    def __init__(self, folder: str, window: int, limit: int, sort: Callable[[list[bytes], list[int]], list[np.ndarray]]):
        self.folder, self.window, self.limit, self.sort = folder, window, max(limit, 4 * window), sort
        self.file, self.index = open(f"{folder}/bytes", "w+b"), open(f"{folder}/items", "w+b")
        self.size = self.windows = 0

    def add(self, times: np.ndarray, sizes: np.ndarray, at: np.ndarray, anchor: np.ndarray, content: memoryview) -> None:
        x = np.zeros(len(sizes), _ITEM)
        n = sizes.astype(np.int64) - self.window + 1
        x["pos"], x["flag"] = self.size + np.cumsum(sizes, dtype=np.int64) - sizes, self.windows + np.cumsum(n) - n
        x["n"], x["at"], x["key"], x["times"] = n, at, anchor, times
        self.file.write(content)
        self.index.write(x.tobytes())
        self.size, self.windows = self.size + len(content), self.windows + int(n.sum())

    def solve(self) -> None:
        self.file.flush()
        self.index.flush()
        self.again = np.asarray(np.memmap(f"{self.folder}/flags", np.uint8, "w+", shape=max(1, self.windows)))  # without a mapped array's checks at each access
        if self.windows:
            with open(f"{self.folder}/equal", "w+b") as self.equal:
                self._solve(self.index.name, 0, 0)
                self.equal.flush()
                k = os.path.getsize(self.equal.name) // _LEFT_OUT.itemsize
                while k:  # the last ones first: a piece that others equal may have been left out later
                    a = max(0, k - _CHUNK)
                    for flag, equal, n in np.fromfile(self.equal.name, _LEFT_OUT, k - a, offset=a * _LEFT_OUT.itemsize)[::-1].tolist():
                        self.again[flag : flag + n] |= self.again[equal : equal + n] & _AGAIN
                    k = a

    def flags(self, first: int, count: int) -> Iterator[np.ndarray]:
        """Flags of `count` pieces from the piece `first`."""
        for x in self._items(self.index.name, first, count):
            for a, n in zip(x["flag"].tolist(), x["n"].tolist(), strict=True):
                yield self.again[a : a + n] & _AGAIN

    def close(self) -> None:
        self.file.close()
        self.index.close()

    def _items(self, path: str, first: int = 0, count: int | None = None) -> Iterator[np.ndarray]:
        count = os.path.getsize(path) // _ITEM.itemsize - first if count is None else count
        for k in range(0, count, _CHUNK):
            yield np.fromfile(path, _ITEM, min(_CHUNK, count - k), offset=(first + k) * _ITEM.itemsize)

    def _bytes(self, pos: int, n: int) -> bytes:
        return os.pread(self.file.fileno(), n, pos)

    def _solve(self, path: str, low: int, high: int) -> None:
        """low, high: range of the anchor's offset in all windows of the file's pieces; high is 0 before pieces are dealt by anchor."""
        size = sum(int(x["n"].sum()) + len(x) * (self.window - 1) for x in self._items(path))
        if size <= self.limit:
            self._sort(path)
            return
        if not high:
            ranges = [(0, self.window)]
        elif high - low > 1:
            ranges = [(low, (low + high) // 2), ((low + high) // 2, high)]
        else:
            ranges = [(low, high)]
        for a, z in ranges:
            with tempfile.TemporaryDirectory(dir=self.folder) as own:
                k = min(_FILES, 2 * -(-size // self.limit))
                for p in self._divide(path, own, a, z, k, bool(high)):
                    self._solve(p, a, z)
                    os.unlink(p)

    def _divide(self, path: str, folder: str, low: int, high: int, k: int, core: bool) -> list[str]:
        """The windows with the anchor's offset in [low, high), dealt to k files; by common bytes, else by key."""
        names = [f"{folder}/{j}" for j in range(k)]
        salt = int.from_bytes(os.urandom(7), "little")
        files: dict[int, object] = {}
        seen: dict[bytes, tuple[int, int, int]] = {}
        most = self.limit // self.window
        try:
            for x in self._items(path):
                # the window at place w has the anchor's offset at - w
                first, last = np.maximum(0, x["at"] - high + 1), np.minimum(x["n"], x["at"] - low + 1)
                live = np.flatnonzero(last > first)
                x, first, last = x[live].copy(), first[live], last[live]
                x["pos"] += first
                x["flag"] += first
                x["at"] -= first
                x["n"] = last - first
                keep = np.ones(len(x), bool)
                for j, (pos, n, at, flag, _, _) in enumerate(x.tolist()):
                    raw = self._bytes(pos, n + self.window - 1)
                    name = hashlib.blake2b(raw, digest_size=16).digest()
                    known = seen.get(name)
                    if known and known[1] == n and self._bytes(known[0], len(raw)) == raw:
                        self.equal.write(np.array([(flag, known[2], n)], _LEFT_OUT).tobytes())
                        self.again[known[2] : known[2] + n] |= _OFTEN
                        keep[j] = False
                        continue
                    if not known and len(seen) < most:
                        seen[name] = (pos, n, flag)
                    if core:  # all windows hold the bytes from the start of the last possible one to the end of the first
                        x["key"][j] = int.from_bytes(hashlib.blake2b(raw[max(0, at - low) : at - high + 1 + self.window], digest_size=8).digest(), "little")
                x = x[keep]
                part = (T.mix(x["key"] ^ T.U(salt)) % T.U(k)).astype(np.int64)
                for p in np.unique(part).tolist():
                    if p not in files:
                        files[p] = open(names[p], "wb")
                    files[p].write(x[part == p].tobytes())
        finally:
            for f in files.values():
                f.close()
        return [names[p] for p in sorted(files)]

    def _sort(self, path: str) -> None:
        known: dict[bytes, int] = {}
        total: list[int] = []
        places: list[tuple[int, int, int]] = []
        for x in self._items(path):
            for pos, n, _, flag, _, times in x.tolist():
                slot = known.setdefault(self._bytes(pos, n + self.window - 1), len(known))
                if slot == len(total):
                    total.append(0)
                total[slot] += times + int(self.again[flag] & _OFTEN)
                places.append((slot, flag, n))
        found = self.sort(list(known), total)
        for slot, flag, n in places:
            self.again[flag : flag + n] |= found[slot]
