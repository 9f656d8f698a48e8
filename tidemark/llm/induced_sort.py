"""External induced sorting of suffixes, with common-prefix values.

Suffixes whose type is S and that follow an L suffix (S* suffixes) are named by
the order of the pieces of text between them; if names repeat, the string of names
is sorted by recursion. From the S* suffixes all L suffixes are induced in
ascending order, and from these all S suffixes in descending order. Induction goes
through a priority queue of suffix tuples (position, common prefix with the tuple
before it in its bucket). As tuples arrive in order of their rank, the queue is one
first-in-first-out bucket for each symbol; buckets move to disk when the queue is
larger than its share of memory. The common prefix of two induced suffixes is one
more than the smallest value between their sources, which a stack of running
minima gives.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

_TUPLE = np.dtype([("p", "<i8"), ("h", "<i4")])
_FAR = np.iinfo(np.int32).max
#: Tuples that one step of the induction takes at least, where there are as many.
_JOIN = 1 << 15
#: Bytes that sorting an S* suffix by doubling takes.
_STAR = 32


class _Queue:
    """One bucket of tuples for each symbol, on disk beyond `memory` bytes."""

    def __init__(self, path: str, memory: int):
        self.file = open(path, "w+b")
        self.memory, self.held = memory, 0
        self.buckets: dict[int, list[np.ndarray | tuple[int, int]]] = {}

    def push(self, symbol: int, rows: np.ndarray) -> None:
        self.buckets.setdefault(symbol, []).append(rows)
        self.held += rows.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        for pieces in self.buckets.values():
            for k, piece in enumerate(pieces):
                if isinstance(piece, np.ndarray):
                    at = self.file.seek(0, os.SEEK_END)
                    self.file.write(piece.tobytes())
                    pieces[k] = (at, len(piece))
        self.held = 0

    def _load(self, piece: np.ndarray | tuple[int, int]) -> np.ndarray:
        if isinstance(piece, np.ndarray):
            return piece
        self.file.flush()
        self.file.seek(piece[0])
        return np.frombuffer(self.file.read(piece[1] * _TUPLE.itemsize), _TUPLE)

    def pieces(self, symbol: int, back: bool = False) -> Iterator[np.ndarray]:
        """The bucket's tuples, small arrivals joined; going forward, also those that arrive meanwhile."""
        own = self.buckets.setdefault(symbol, [])
        k = len(own) - 1 if back else 0
        while 0 <= k < len(own):
            joined, size = [], 0
            while 0 <= k < len(own) and size < _JOIN:
                joined.append(self._load(own[k])[:: -1 if back else 1])
                size += len(joined[-1])
                k += -1 if back else 1
            yield joined[0] if len(joined) == 1 else np.concatenate(joined)

    def close(self) -> None:
        self.file.close()
        os.unlink(self.file.name)


class _Minima:
    """Smallest value since any moment of a stream, by a stack of running minima from its end."""

    def __init__(self) -> None:
        self.at, self.low, self.now = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def since(self, moment: np.ndarray) -> np.ndarray:
        """Minimum of the values that came after each moment, until now."""
        k = np.searchsorted(self.at, moment, side="right")
        return np.append(self.low, _FAR)[k]

    def add(self, values: np.ndarray) -> None:
        back = np.minimum.accumulate(values[::-1])[::-1]
        last = np.append(back[1:] != back[:-1], True)  # where a running minimum from the end begins
        keep = self.low < back[0]
        at = self.now + np.flatnonzero(last)
        self.at, self.low = np.concatenate([self.at[keep], at]), np.concatenate([self.low[keep], back[last]])
        self.now += len(values)


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low:high + 1] for each pair, by a sparse table."""
    level = np.floor(np.log2(np.maximum(high - low + 1, 1))).astype(np.int64)
    out, table, k = np.empty(len(low), np.int64), values.astype(np.int64), 0
    while True:
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
        if k >= (int(level.max()) if len(level) else 0):
            return out
        table = np.minimum(table[: -(1 << k)], table[1 << k :])
        k += 1


class _Induction:
    """Feeds sources in order of rank and pushes what they induce."""

    def __init__(self, text: np.ndarray, queue: _Queue, top: int, ascending: bool):
        self.text, self.queue, self.ascending = text, queue, ascending
        self.minima, self.last = _Minima(), np.full(top + 1, -1, np.int64)

    def feed(self, rows: np.ndarray, strict: bool) -> None:
        """rows: sources with the common prefix of each with the source before it. strict: an equal symbol before a source isn't of the wanted type."""
        pos, h = rows["p"], rows["h"].astype(np.int64)
        if not len(pos):
            return
        start = self.minima.now
        before, here = self.text[np.maximum(pos - 1, 0)].astype(np.int64), self.text[pos].astype(np.int64)
        if self.ascending:
            ok = before > here if strict else before >= here
        else:
            ok = before < here if strict else before <= here
        at = np.flatnonzero(ok & (pos > 0))
        if len(at):
            symbol = self.text[pos[at] - 1]  # 16-bit symbols are sorted by radix
            order = np.argsort(symbol, kind="stable")
            at, symbol = at[order], symbol[order]
            head = np.ones(len(at), bool)
            head[1:] = symbol[1:] != symbol[:-1]
            value = np.empty(len(at), np.int64)
            inner = np.flatnonzero(~head)
            value[inner] = _range_min(h, at[inner - 1] + 1, at[inner])
            first = np.flatnonzero(head)
            seen = self.last[symbol[first]]
            run = np.minimum.accumulate(h)
            value[first] = np.minimum(self.minima.since(seen), run[at[first]])
            value[first] = np.where(seen < 0, -1, value[first])
            out = np.empty(len(at), _TUPLE)
            out["p"], out["h"] = pos[at] - 1, np.minimum(value + 1, _FAR - 1)
            ends = np.append(first[1:], len(at))
            for a, z, s in zip(first.tolist(), ends.tolist(), symbol[first].tolist(), strict=True):
                self.queue.push(s, out[a:z])
            self.last[symbol[first]] = start + at[ends - 1]
        self.minima.add(h)


def _run_length(text: np.ndarray, pos: int) -> int:
    """How often the symbol at pos repeats from there."""
    c, at = text[pos], pos
    while at < len(text):
        part = text[at : at + 4096]
        other = np.flatnonzero(part != c)
        if len(other):
            return at + int(other[0]) - pos
        at += len(part)
    return len(text) - pos


def _stars(text: np.ndarray, memory: int) -> np.ndarray:
    """Positions of the S* suffixes in order, found from the end in pieces; the last is the terminator."""
    end, step = len(text) - 1, max(1024, memory // 64)
    found = [np.array([end])]
    type_after = True  # the terminator is S
    while end > 0:
        a = max(0, end - step)
        x = text[a : end + 1].astype(np.int64)
        up, m = np.sign(np.diff(x)), end - a  # 1: S, -1: L, 0: as the suffix after it
        after = np.minimum.accumulate(np.where(up != 0, np.arange(m), m)[::-1])[::-1]
        is_s = np.where(after < m, up[np.minimum(after, m - 1)] > 0, type_after)
        star = np.flatnonzero(~is_s & np.append(is_s[1:], type_after)) + 1 + a
        found.append(star[star < len(text) - 1][::-1])
        type_after, end = bool(is_s[0]), a
    return np.concatenate(found)[::-1]


def _names(text: np.ndarray, stars: np.ndarray) -> tuple[np.ndarray, int]:
    """Name of each S* piece (text up to and with the next S* position), by order; and how many there are.

    Pieces of one first symbol are sorted together, by words of a few symbols; only
    those that tie go on. A piece that ends where another goes on is the larger.
    """
    length = np.append(np.diff(stars) + 1, 1)
    step, bits = (3, 16) if text.dtype.itemsize == 2 else (1, 32)
    pad = np.uint64((1 << bits) - 1)
    names, used = np.zeros(len(stars), np.int64), 0
    first = text[stars]
    by_first = np.argsort(first, kind="stable")
    cuts = np.flatnonzero(np.diff(first[by_first].astype(np.int64), prepend=-1))
    for a, z in zip(cuts, [*cuts[1:], len(by_first)], strict=True):
        order = by_first[a:z].copy()
        group, depth = np.zeros(len(order), np.int64), 0  # a group's number is the place of its first member
        open_ = np.arange(len(order))
        while len(open_):
            rows = order[open_]
            key = np.zeros(len(rows), np.uint64)
            for off in range(depth, depth + step):
                symbol = text[np.minimum(stars[rows] + off, len(text) - 1)].astype(np.uint64)
                key = (key << np.uint64(bits)) | np.where(off < length[rows], symbol, pad)
            ended = depth + step >= length[rows]
            key = (key << np.uint64(1)) | ended.astype(np.uint64)
            rank = np.lexsort((key, group[open_]))
            g, k = group[open_][rank], key[rank]
            head = np.ones(len(rank), bool)
            head[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
            at = np.cumsum(head) - 1
            order[open_] = rows[rank]
            group[open_] = open_[np.flatnonzero(head)[at]]
            open_ = open_[(np.bincount(at)[at] > 1) & ~ended[rank]]
            depth += step
        fresh = np.ones(len(order), bool)
        fresh[1:] = group[1:] != group[:-1]
        names[order] = used + np.cumsum(fresh) - 1
        used += int(fresh.sum())
    return names, used


def _doubling(x: np.ndarray) -> np.ndarray:
    """Suffixes of names that fit in memory, in order.

    A suffix's rank is the place of the first of those alike so far. Only suffixes that
    tie go on, whole groups of them at a time: group, rank of the rest and place are one
    number, so that numbers are sorted, not places by them.
    """
    n = len(x)
    bits = np.uint64(n.bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    key = np.sort((x.astype(np.uint64) << bits) | np.arange(n, dtype=np.uint64))
    order = (key & mask).astype(np.int32)
    key >>= bits
    rank = np.empty(n, np.int32)

    def heads(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted keys: each one's first equal, and which tie."""
        new = np.append(True, key[1:] != key[:-1])
        first = np.arange(len(key), dtype=np.int32)
        first[~new] = 0
        return np.maximum.accumulate(first, out=first), ~(new & np.append(new[1:], True))

    first, tie = heads(key)
    rank[order] = first
    open_, k = np.flatnonzero(tie).astype(np.int32), 1
    del key, first, tie
    while len(open_):
        group = rank[order[open_]]
        cuts = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(open_))  # bounds of the groups
        left, g = [], 0
        while g < len(cuts) - 1:
            until = max(g + 1, int(np.searchsorted(cuts, cuts[g] + _JOIN, side="right")) - 1)
            mine = open_[cuts[g] : cuts[until]]
            rows = order[mine]
            rest = rows.astype(np.int64) + k
            second = np.where(rest < n, rank[np.minimum(rest, n - 1)] + 1, 0).astype(np.uint64)
            own = np.repeat(np.arange(until - g, dtype=np.uint64), np.diff(cuts[g : until + 1]))
            low = np.uint64(len(mine).bit_length())
            key = np.sort((((own << bits) | second) << low) | np.arange(len(mine), dtype=np.uint64))
            rows = rows[(key & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)]
            first, tie = heads(key >> low)
            order[mine], rank[rows] = rows, mine[first]
            left.append(mine[tie])
            g = until
        open_ = np.concatenate(left)
        k *= 2
    return order


def _sorted_stars(text: np.ndarray, stars: np.ndarray, folder: str, memory: int) -> np.ndarray:
    """The S* suffixes in order."""
    names, used = _names(text, stars)
    if used == len(stars):
        return stars[np.argsort(names)]
    if len(stars) * _STAR <= memory:
        return stars[_doubling(names)]
    text = np.memmap(os.path.join(folder, f"names-{len(stars)}"), np.uint32, "w+", shape=len(stars))
    text[:] = names
    order = [p for p, _ in sorted_suffixes(text, folder, memory, 0)]
    os.unlink(text.filename)
    return stars[np.concatenate(order)]


def _prefixes(text: np.ndarray, pos: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each S* suffix with the one before it; values of `limit` or more are only known to be so.

    One suffix in 16, in order of text, is compared from its start. Those after it begin
    with what is left of its prefix, if that holds the whole next piece too: then the
    same place of the other suffix is of type S* as well, and sorts before.
    """
    h = np.zeros(len(pos), np.int32)
    width = 16
    tail = max(0, len(text) - 2 * width)
    last = np.append(text[tail:], np.zeros(width, text.dtype))  # the last strings of `width`; only one of two holds the terminator
    strings, last = (np.lib.stride_tricks.sliding_window_view(x, width) if len(x) >= width else None for x in (text, last))

    def at(place: np.ndarray) -> np.ndarray:
        late = place > len(text) - width
        if not late.any():
            return strings[place]
        out = np.empty((len(place), width), text.dtype)
        out[late] = last[place[late] - tail]
        if not late.all():
            out[~late] = strings[place[~late]]
        return out

    def compare(ranks: np.ndarray) -> None:
        for a in range(0, len(ranks), 1 << 14):
            mine = ranks[a : a + (1 << 14)]
            while len(mine):
                other = at(pos[mine] + h[mine]) != at(pos[mine - 1] + h[mine])
                n = np.argmax(other, axis=1)
                n[~other[np.arange(len(n)), n]] = width
                h[mine] += n.astype(np.int32)
                mine = mine[(n == width) & (h[mine] < limit)]

    order = np.argsort(pos)  # in order of text
    place, k = pos[order], np.arange(len(pos))
    lead = k - k % width
    compare(order[k[(lead == k) & (order > 0)]])
    follow = k[(lead != k) & (order > 0)]
    least, after = h[order[lead[follow]]], place[np.minimum(follow + 1, len(k) - 1)]
    known = (follow + 1 < len(k)) & (after - place[lead[follow]] < least)
    h[order[follow]] = np.where(known, least - (place[follow] - place[lead[follow]]), 0)
    compare(order[follow])
    return h


def sorted_suffixes(text: np.ndarray, folder: str, memory: int, limit: int = _FAR) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffix positions of `text` in order and the common prefix of each with the one before it, in pieces.

    text: 16-bit numbers below 65,535, of which only the last is 0 (32-bit ones in
    recursion); it may be mapped from a file. `folder` takes the buckets that exceed `memory` bytes. Common prefixes of
    `limit` or more are only known to be so. An array of the terminator alone gives
    that one suffix.
    """
    text = np.asarray(text)  # as mapped, without the checks of a mapped array at each access
    top = int(text.max()) if len(text) else 0
    stars = _sorted_stars(text, _stars(text, memory), folder, memory)
    h = _prefixes(text, stars, limit)
    first = text[stars].astype(np.int64)
    small, large = (_Queue(os.path.join(folder, f"queue-{kind}-{len(text)}"), memory // 4) for kind in "LS")
    counts = np.bincount(np.asarray(text), minlength=top + 1) if len(text) * 2 <= memory else sum(np.bincount(text[k : k + (memory // 8)], minlength=top + 1) for k in range(0, len(text), memory // 8))
    symbols = np.flatnonzero(counts).tolist()
    seeds = np.empty(len(stars), _TUPLE)
    seeds["p"], seeds["h"] = stars, h
    bounds = np.searchsorted(first, [*symbols, top + 1])

    def seam(a: int, b: int) -> int:
        return min(_run_length(text, a), _run_length(text, b))

    try:
        up = _Induction(text, small, top, True)
        last_small: dict[int, int] = {}
        for k, c in enumerate(symbols):
            for piece in small.pieces(c):
                up.feed(piece, False)
                last_small[c] = int(piece["p"][-1])
            own = seeds[bounds[k] : bounds[k + 1]].copy()
            if len(own):
                own["h"][0] = seam(last_small[c], int(own["p"][0])) if c in last_small else 0
                up.feed(own, True)
        down = _Induction(text, large, top, False)
        large.push(0, np.array([(len(text) - 1, 0)], _TUPLE))  # the terminator
        last_large: dict[int, int] = {}
        for c in reversed(symbols):
            for piece in large.pieces(c):
                down.feed(piece, False)
                last_large[c] = int(piece["p"][-1])
            joint = seam(last_large[c], last_small[c]) if c in last_large and c in last_small else 0
            for piece in small.pieces(c, back=True):
                own = piece.copy()
                own["h"][0], own["h"][1:] = joint, piece["h"][:-1]
                joint = int(piece["h"][-1])
                down.feed(own, True)
        for c in symbols:
            for piece in small.pieces(c):
                yield piece["p"], piece["h"]
            joint = seam(last_large[c], last_small[c]) if c in last_large and c in last_small else 0
            for piece in large.pieces(c, back=True):
                own = np.empty(len(piece), np.int32)
                own[0], own[1:] = joint, piece["h"][:-1]
                joint = int(piece["h"][-1])
                yield piece["p"], own
    finally:
        small.close()
        large.close()
