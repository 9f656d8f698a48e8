"""Exact deduplication of long byte strings by external suffix sorting.

Every byte goes that a string of `window` bytes covers which also starts elsewhere.
Blocks of documents first ask about the cores of their windows (an anchor and what
surrounds it in all windows of a range); a window can repeat only if its core does.
Surroundings whose cores are met more than once go to their anchor's shard, each
distinct one once with its count, and the shard's suffixes are sorted by external induction. Suffixes that share `window` bytes with a
neighbour repeat, and those of a surrounding that counts more than one. A shard lies
on disk; one larger than a fixed share of memory is divided first, and queues go to
disk beyond theirs. Hashes only bring candidates together: surroundings count as
alike where their bytes are.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from . import text as T
from .anchors import Segments
from .common import SLICE_BYTES, Workspace, parts, text_bytes
from .induced_sort import sorted_suffixes
from .shards import Shard
from .substring_dedup import differing

WINDOW, GRAM = 400, 64
#: Ranges of the anchor's offset in a window.
RANGES = 4
MEMORY = 192 << 20
#: Bytes sorted together are memory / SHARE at most: positions, names and seeds take many times as much.
SHARE = 12
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: Parts two surroundings in a shard's text; bytes are numbered after it.
_BREAK = 1


class _State:
    """Segments of a block: start, count of windows, anchor (hash), place of the anchor after the start; and what it asks about them.

    Windows that have the anchor within one range of offsets have a core in common, the
    bytes from the start of the last possible one to the end of the first: a window can
    repeat only if the core of its range does. `asked`: the distinct cores (hashes), and
    `times` each is met (2 at most).
    """

    def __init__(self, d: X.Documents, window: int, gram: int):
        self.d, self.window = d, window
        bounds = np.linspace(0, window - gram + 1, min(RANGES, window - gram + 1) + 1).astype(np.int64).tolist()
        found: list[tuple[np.ndarray, ...]] = []
        cores: list[tuple[np.ndarray, ...]] = []
        n = 0
        for base, buf, offs in self._slices():
            if len(buf) >= window:
                c = T.prefix(buf)
                s = Segments(T.grams_hash(c, gram), offs, window, gram)
                at = s.at - s.start
                found.append((s.start + base, s.count, s.anchor, at))
                for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                    first, last = np.maximum(0, at - high + 1), np.minimum(s.count, at - low + 1)
                    mine = np.flatnonzero(last > first)
                    cores.append((T.spans_hash(c, s.at[mine] - low, s.at[mine] - high + 1 + window) + T.U(low), mine + n, first[mine], last[mine]))
                n += len(at)
        self.start, self.count, self.anchor, self.at = (np.concatenate([f[k] for f in found] or [np.zeros(0, t)]) for k, t in enumerate((np.int64, np.int64, T.U, np.int64)))
        core, self.segment, self.first, self.last = (np.concatenate([f[k] for f in cores] or [np.zeros(0, t)]) for k, t in enumerate((T.U, np.int64, np.int64, np.int64)))
        order = np.argsort(core)
        head = np.ones(len(order), bool)
        head[1:] = core[order[1:]] != core[order[:-1]]
        at = np.flatnonzero(head)
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(head) - 1
        self.asked = core[order[at]]
        self.times = np.minimum(np.diff(np.append(at, len(order))), 2).astype("u1")

    def _slices(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Some documents at a time: where they begin, their bytes, and their bounds in these."""
        d, a = self.d, 0
        while a < len(d.doc):
            z = max(a + 1, int(np.searchsorted(d.offs, d.offs[a] + SLICE_BYTES, side="right")) - 1)
            base = int(d.offs[a])
            yield base, d.buf[base : d.offs[z]], d.offs[a : z + 1] - base
            a = z

    def open(self, flag: np.ndarray) -> None:
        """Keep the windows from the first to the last of a segment whose cores have a flag, and hash these surroundings."""
        hit = np.flatnonzero(flag[self.group]) if len(self.group) else self.group
        first, last = np.full(len(self.start), np.iinfo(np.int64).max), np.zeros(len(self.start), np.int64)
        np.minimum.at(first, self.segment[hit], self.first[hit])
        np.maximum.at(last, self.segment[hit], self.last[hit])
        kept = np.flatnonzero(last)
        first = first[kept]
        self.start, self.count, self.at, self.anchor = self.start[kept] + first, last[kept] - first, self.at[kept] - first, self.anchor[kept]
        self.content = np.zeros(len(kept), T.U)
        for base, buf, _ in self._slices():
            a, z = np.searchsorted(self.start, [base, base + len(buf)])
            if z > a:
                start = self.start[a:z] - base
                self.content[a:z] = T.mix(T.spans_hash(T.prefix(buf), start, start + self.count[a:z] + self.window - 1) + self.at[a:z].astype(T.U))

    def distinct(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the chosen segments: one of each content, how often it occurs (2 at most), and each one's content."""
        _, first, back = np.unique(self.content[chosen], return_index=True, return_inverse=True)
        alike = chosen[first][back]
        odd = (self.count[alike] != self.count[chosen]) | (self.at[alike] != self.at[chosen]) | (self.anchor[alike] != self.anchor[chosen])
        same = np.flatnonzero(~odd)
        odd[same] = differing(self.d.buf, self.start[chosen[same]], self.start[alike[same]], self.count[chosen[same]] + self.window - 1)
        alike[odd] = chosen[odd]  # equal hashes of different bytes: each stands for itself
        one, back, times = np.unique(alike, return_inverse=True, return_counts=True)
        return one, np.minimum(times, 2).astype("u1"), back


def _serve_cores(rows: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes]]:
    """0: the core occurs once; 1: more often."""
    got = [X.unpack(b, "u8", "u1") for _, _, b in rows]
    a, times = (np.concatenate([g[k] for g in got]) for k in range(2))
    order = np.argsort(a, kind="stable")
    head = np.ones(len(a), bool)
    head[1:] = a[order][1:] != a[order][:-1]
    at = np.flatnonzero(head)
    group = np.empty(len(a), np.int64)
    group[order] = np.cumsum(head) - 1
    flag = (np.add.reduceat(times[order].astype(np.int64), at) > 1).astype("u1")[group]
    cuts = np.cumsum([0, *(len(g[0]) for g in got)])
    return [(r[0], 1, X.pack(flag[x:y])) for r, x, y in zip(rows, cuts[:-1], cuts[1:], strict=True)]


def repeated_windows(pieces: list[bytes], window: int, memory: int = MEMORY, times: list[int] | None = None) -> list[np.ndarray]:
    """For each of several different pieces, which of its windows also start elsewhere, by sorting the suffixes of all; times: how often each piece is met."""
    sizes = np.array([len(p) + 1 for p in pieces])
    offs = np.concatenate([[0], np.cumsum(sizes)])
    with tempfile.TemporaryDirectory(prefix="suffixes-") as folder:
        text = np.asarray(np.memmap(f"{folder}/text", np.uint16, "w+", shape=int(offs[-1]) + 1))  # without a mapped array's checks at each access
        for p, a in zip(pieces, offs[:-1].tolist(), strict=True):
            text[a : a + len(p)] = np.frombuffer(p, np.uint8)
            text[a : a + len(p)] += _BREAK + 1
            text[a + len(p)] = _BREAK
        text[-1] = 0
        often = np.append(np.repeat(np.array(times or [1] * len(pieces)) > 1, sizes), False)
        again = np.zeros(len(text), bool)
        before = -1
        for pos, h in sorted_suffixes(text, folder, memory, window):
            hit = np.flatnonzero(h >= window)
            again[pos[often[pos]]] = True
            again[pos[hit]] = True
            again[np.where(hit > 0, pos[np.maximum(hit - 1, 0)], before)] = True
            before = int(pos[-1])
        del text
    return [again[a : a + max(len(p) - window + 1, 0)] for p, a in zip(pieces, offs[:-1].tolist(), strict=True)]


def _serve_shard(window: int, memory: int):
    def serve(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
        """For each content that a block sent, which of its windows repeat (bits)."""
        with tempfile.TemporaryDirectory(prefix="shard-") as folder:
            shard = Shard(folder, window, memory // SHARE, lambda pieces, times: repeated_windows(pieces, window, memory, times))
            sent = []
            for block, _, blob in rows:
                raw = X.unsqueeze(blob)
                n = int.from_bytes(raw[:4], "little")
                times, sizes = np.frombuffer(raw, "u1", n, 4), np.frombuffer(raw, "<u4", n, 4 + n)
                at, anchor = np.frombuffer(raw, "<u4", n, 4 + 5 * n), np.frombuffer(raw, "<u8", n, 4 + 9 * n)
                shard.add(times, sizes, at, anchor, memoryview(raw)[4 + 17 * n :])
                sent.append((block, n))
            shard.solve()
            first = 0
            for block, n in sent:
                yield block, 2, X.squeeze(b"".join(np.packbits(f).tobytes() for f in shard.flags(first, n)))
                first += n
            shard.close()

    return serve


def dedup(spark: SparkSession, docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM, memory: int = MEMORY, block_bytes: int = X.BLOCK_BYTES) -> DataFrame:
    """One row for each row of `docs`; only doc_id and text are read.

    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the
    remaining bytes). A null text is empty. Strings are judged on the input, within
    rows; every row's text counts, also where rows repeat or lack a doc_id.
    """
    ws = Workspace(spark)
    src = docs.select("doc_id", F.col(text).alias("text"))
    n = parts(spark, text_bytes(src))
    blocks = X.blocked(ws, src, block_bytes, n)

    def ask_cores(d: X.Documents, _: pa.Table) -> pa.Table:
        s = _State(d, window, gram)
        return X.packed_table(list(X.deal(d.block, 1, s.asked, n, s.asked, s.times)))

    known = ws.write(X.ask(X.per_block(blocks, None, ask_cores, X.PACKED), _serve_cores), "cores")

    def opened(d: X.Documents, answers: pa.Table) -> tuple[_State, np.ndarray, np.ndarray, np.ndarray]:
        """Segments with the windows whose cores are met more than once; one of each content, its times, and each one's content."""
        s = _State(d, window, gram)
        s.open(X.collected(answers, 1, s.asked, n, "u1")[0])
        return (s, *s.distinct(np.arange(len(s.start))))

    def ask_shards(d: X.Documents, answers: pa.Table) -> pa.Table:
        s, one, times, _ = opened(d, answers)
        rows = []
        part = (s.anchor[one] % T.U(n)).astype(np.int64)
        for p in np.unique(part).tolist():
            mine = np.flatnonzero(part == p)
            size = (s.count[one[mine]] + window - 1).astype("<u4")
            content = b"".join(d.buf[a : a + k].tobytes() for a, k in zip(s.start[one[mine]].tolist(), size.tolist(), strict=True))
            rows.append((p, d.block, 2, X.squeeze(len(mine).to_bytes(4, "little") + times[mine].tobytes() + size.tobytes() + s.at[one[mine]].astype("<u4").tobytes() + s.anchor[one[mine]].tobytes() + content)))
        return X.packed_table(rows)

    shards = X.ask_streamed(X.per_block(blocks, known, ask_shards, X.PACKED), _serve_shard(window, memory))

    def finish(d: X.Documents, answers: pa.Table) -> pa.Table:
        s, one, _, back = opened(d, answers)
        edge = np.zeros(len(d.buf) + 1, np.int32)  # removed stretches: +1 where one begins, -1 after its end
        bits: dict[int, np.ndarray] = {p: np.frombuffer(X.unsqueeze(b), np.uint8) for p, k, b in zip(answers["part"].to_pylist(), answers["kind"].to_pylist(), answers["blob"].to_pylist(), strict=True) if k == 2}
        part, at = (s.anchor[one] % T.U(n)).astype(np.int64).tolist(), dict.fromkeys(bits, 0)
        first, end = [], []  # runs of windows that repeat, of each content
        for p, count in zip(part, s.count[one].tolist(), strict=True):
            size = (count + 7) // 8
            turn = np.diff(np.unpackbits(bits[p][at[p] : at[p] + size], count=count).astype(np.int8), prepend=0, append=0)
            first.append(np.flatnonzero(turn == 1))
            end.append(np.flatnonzero(turn == -1) + window - 1)
            at[p] += size
        n_runs = np.array([len(f) for f in first], np.int64)
        mine = n_runs[back]
        at_run = np.repeat((np.cumsum(n_runs) - n_runs)[back], mine) + np.arange(mine.sum()) - np.repeat(np.cumsum(mine) - mine, mine)
        start = np.repeat(s.start, mine)
        if len(at_run):
            np.add.at(edge, start + np.concatenate(first)[at_run], 1)
            np.add.at(edge, start + np.concatenate(end)[at_run], -1)
        gone = np.cumsum(edge[:-1]) > 0
        n_gone, n_spans, sha = [], [], []
        for a, z in zip(d.offs[:-1].tolist(), d.offs[1:].tolist(), strict=True):
            cut, raw = gone[a:z], d.buf[a:z]
            k = int(cut.sum())
            n_gone.append(k)
            n_spans.append(int(np.count_nonzero(np.diff(cut.astype(np.int8), prepend=0) == 1)) if k else 0)
            sha.append(hashlib.sha256((raw[~cut] if k else raw).tobytes()).hexdigest())
        return pa.table({"doc_id": d.ids, "n_bytes": pa.array(np.diff(d.offs), pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return ws.close(X.per_block(blocks, known.unionByName(shards), finish, OUT))
