"""Vectorised word splitting and hashing over Arrow text buffers.

A text column's bytes are one NumPy array; words, their 64-bit hashes and the
hashes of windows come from prefix sums over it, without a Python loop over
words. Hashes are polynomials modulo 2**64 over fixed random byte values, mixed
at the end, and alike on every machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE, _INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
#: ASCII white space: space and \x09-\x0D.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(separators: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes separate words, and each byte's value in hashes."""
    sep = np.zeros(256, bool)
    sep[list(separators)] = True
    values = _VALUES.copy()
    if lower:
        values[65:91] = values[97:123]
    return sep, values


PLAIN = table(SPACES, lower=False)
LOWER = table(SPACES, lower=True)
#: Words of letters, digits and what lies beyond ASCII.
ALNUM = table(bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)), lower=True)

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, U)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_binary column without nulls, and the rows' n + 1 offsets into them."""
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def prefix(buf: np.ndarray, values: np.ndarray = _VALUES) -> np.ndarray:
    """Sums of byte values times powers, from which any substring's hash follows."""
    c = np.empty(len(buf) + 1, U)
    c[0] = 0
    np.cumsum(values[buf] * powers(len(buf))[0], out=c[1:])
    return c


def spans_hash(c: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each [start, end)."""
    return mix((c[end] - c[start]) * powers(len(c))[1][start] + (end - start).astype(U))


def grams_hash(c: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive bytes, as `spans_hash` gives it."""
    n = max(len(c) - k, 0)
    return mix((c[k:] - c[:n]) * powers(len(c))[1][:n] + U(k))


class Words:
    """start and end (bytes) of each word, its hash, and each row's first word at `rows` (n + 1)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, kind: tuple[np.ndarray, np.ndarray], hashes: bool = True):
        sep, values = kind
        inside = ~sep[buf]
        before = np.zeros(len(buf), bool)
        before[1:] = inside[:-1]
        after = np.zeros(len(buf), bool)
        after[:-1] = inside[1:]
        full = offs[:-1] < offs[1:]
        before[offs[:-1][full]] = False
        after[offs[1:][full] - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.rows = np.searchsorted(self.start, offs)
        self.hash = spans_hash(prefix(buf, values), self.start, self.end) if hashes else None

    def row_of(self) -> np.ndarray:
        """Each word's row."""
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive items; position i stands for items i to i + k - 1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out, done, power, width = np.zeros(n, U), 0, h, 1
    while width <= k:  # binary expansion of k: `power` holds windows of `width` items
        if k & width:
            out = out + power[done : done + n] * U(pow(int(_BASE), done, 1 << 64))
            done += width
        power = power[:-width] + power[width:] * U(pow(int(_BASE), width, 1 << 64)) if len(power) > width else power[:0]
        width *= 2
    return mix(out)


def starts_inside(rows: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the positions 0 to n - 1 begin k items that lie within one row."""
    ends = np.repeat(rows[1:], np.diff(rows))[: max(n, 0)]
    return np.arange(len(ends)) + k <= ends


def covered(starts: np.ndarray, length: int | np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie within `length` of any start."""
    d = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(starts + length, n), minlength=n + 1)[: n + 1]
    return np.cumsum(d[:-1]) > 0


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by block-wise running minima."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    if w == 1:
        return x
    pad = -len(x) % w
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]) if pad else x
    blocks = full.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])
