"""Substring deduplication by relative Lempel-Ziv parsing.

The corpus is its own reference, in blocks: a reference block holds all passages
around the seeds (word 4-grams) that are dealt to it, and indexes their windows.
Every passage is factored greedily against the block: where a window has its first
occurrence in an earlier document, the match is extended word by word to its end in
that source; the next factor is looked for from the first window that crosses the
end of the last one, so that no duplicate hides at a boundary. Factors have `window`
words at least. They, and nothing else, are the duplicate spans.

Seeds are content-defined anchors: each window has one, equal windows have the same,
and a seed that only one document has needs no factoring. (1) Blocks of documents ask
which of their seeds occur in several documents. (2) They send the passages around
these to the seed's reference block, which answers with the words that factors cover.
Text that several documents of a block have is sent once, with its two smallest
doc_ids: it is factored once for each, and what holds for the second document holds
for all later ones. Passages around a seed with very many of them go window by window,
dealt by the window, so that no block grows with a common passage.

Hashes only bring candidates together: words and passages are compared by their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from . import text as T
from .anchors import Segments
from .common import Workspace, parts, squeeze, text_bytes, unsqueeze

WINDOW, GRAM = 13, 4
#: Passages of one seed that go to one reference block, roughly; those of more common seeds are dealt window by window.
HOT = 2048
OUT = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string"
#: Bytes that one comparison takes at a time.
_STEP = 1 << 20


def differing(buf: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of the pieces [a, a + length) and [b, b + length) of buf differ."""
    out = np.zeros(len(a), bool)
    far = np.flatnonzero(a != b)
    ends = np.cumsum(length[far])
    cut = 0
    while cut < len(far):
        z = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + _STEP, side="right")))
        at, n = far[cut:z], length[far[cut:z]]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        other = buf[np.repeat(a[at], n) + inner] != buf[np.repeat(b[at], n) + inner]
        out[at] = np.bincount(np.repeat(np.arange(len(at)), n), weights=other, minlength=len(at)) > 0
        cut = z
    return out


def word_ids(buf: np.ndarray, start: np.ndarray, length: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Numbers of words, alike only for words of the same bytes."""
    _, first, ids = np.unique(h, return_index=True, return_inverse=True)
    alike = first[ids]
    if (length != length[alike]).any() or differing(buf, start, start[alike], length).any():  # two words of one hash
        known: dict[bytes, int] = {}
        raw = buf.tobytes()
        ids = np.array([known.setdefault(raw[s : s + n], len(known)) for s, n in zip(start.tolist(), length.tolist(), strict=True)], np.int64)
    return ids


class ReferenceBlock:
    """Passages as numbers of words (`words`, passage k at rows[k] to rows[k + 1]) with their documents, indexed by windows."""

    def __init__(self, words: np.ndarray, rows: np.ndarray, doc: np.ndarray, window: int):
        self.window, self.rows, self.doc = window, rows, doc
        n, m = len(words), len(rows) - 1
        # a break of its own after each passage, so that no match leaves one
        at = np.arange(n) + np.repeat(np.arange(m), np.diff(rows))
        x = np.empty(n + m, np.int64)
        x[at] = words
        x[rows[1:] + np.arange(m)] = (int(words.max()) + 1 if n else 0) + np.arange(m)
        self.begin = rows[:-1] + np.arange(m)
        self.levels = [x]  # numbers of the strings of 1, 2, 4 ... words that begin at each place
        while 2 ** len(self.levels) <= window:
            self.levels.append(self._pairs(self.levels[-1], self.levels[-1], 2 ** (len(self.levels) - 1)))
        key, done = x * 0, 0
        for k in range(len(self.levels) - 1, -1, -1):
            if window >> k & 1:
                key = self._pairs(key, self.levels[k], done) if done else self.levels[k]
                done += 2**k
        size = np.maximum(np.diff(rows) - window + 1, 0)
        self.size = size
        self.passage = np.repeat(np.arange(m), size)
        self.at = self.begin[self.passage] + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        # the source of each window: its occurrence in the earliest document
        w, d = key[self.at], doc[self.passage]
        order = np.lexsort((d, w))
        head = np.ones(len(w), bool)
        head[1:] = w[order][1:] != w[order][:-1]
        first = order[head][np.cumsum(head) - 1]
        self.source, self.earliest = np.empty(len(w), np.int64), np.empty(len(w), np.int64)
        self.source[order], self.earliest[order] = self.at[first], d[first]

    @staticmethod
    def _pairs(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """Numbers of the pairs (a[i], b[i + step]); places without a second half get 0, and are never compared."""
        out = np.zeros(len(a), np.int64)
        if len(a) > step:
            out[: len(a) - step] = np.unique(a[: len(a) - step] * (int(b.max()) + 1) + b[step:], return_inverse=True)[1]
        return out

    def extended(self, place: np.ndarray, source: np.ndarray) -> np.ndarray:
        """Length of the match that begins at each place and source, `window` words of which are known to be equal."""
        length, top = np.full(len(place), self.window, np.int64), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            step, number, going = 2**k, self.levels[k], np.arange(len(place))
            while len(going):
                p, q = place[going] + length[going], source[going] + length[going]
                ok = (np.maximum(p, q) + step <= top) & (number[np.minimum(p, top - 1)] == number[np.minimum(q, top - 1)])
                length[going[ok]] += step
                going = going[ok]
        return length

    def factors(self, doc: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Passage-wise greedy factors against earlier documents: first word (place in `words`) and length of each.

        doc: the documents that have the passages, where other copies than the indexed ones are to be factored.
        """
        doc = self.doc if doc is None else doc
        first = np.cumsum(self.size) - self.size
        end = first + self.size
        far = len(self.at)
        # the next window at or after each that an earlier document has
        hit = self.earliest < doc[self.passage]
        follow = np.minimum.accumulate(np.where(hit, np.arange(far), far)[::-1])[::-1] if far else np.zeros(0, np.int64)
        starts, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        live, now = np.flatnonzero(self.size > 0), first[self.size > 0]
        while len(live):
            i = follow[now]
            ok = i < end[live]
            live, i = live[ok], i[ok]
            if not len(live):
                break
            n = end[live] - i + self.window - 1  # to the passage's end, if the source is the indexed copy of the passage
            other = self.source[i] != self.at[i]
            n[other] = self.extended(self.at[i[other]], self.source[i[other]])
            starts.append(self.at[i] - live)  # the breaks before it aside
            lengths.append(n)
            now = i + n - self.window + 1  # the first window that crosses the factor's end
            ok = now < end[live]
            live, now = live[ok], now[ok]
        return np.concatenate(starts), np.concatenate(lengths)


class _State:
    """Passages of a block: first word, number of words, document, key and content (hash); made again from its text in each round."""

    def __init__(self, d: X.Documents, window: int, gram: int):
        self.d, self.window = d, window
        w = self.w = T.Words(d.buf, d.offs, T.PLAIN)
        self.win = T.rolling(w.hash, window)
        s = self.s = Segments(T.rolling(w.hash, gram), w.rows, window, gram)
        self.doc = d.doc[s.row]
        # up to `window` windows: the first and the last cover all words
        last = s.start + s.count - 1
        self.content = T.mix(self.win[s.start] + T.mix(self.win[last] + s.count.astype(T.U)) + (s.at - s.start).astype(T.U)) if len(s.start) else np.zeros(0, T.U)
        order = np.lexsort((self.content, s.anchor))
        a, c = s.anchor[order], self.content[order]
        head = np.ones(len(a), bool)
        head[1:] = a[1:] != a[:-1]
        fresh = head.copy()
        fresh[1:] |= c[1:] != c[:-1]
        self.order, self.group = order, np.cumsum(head) - 1
        at = np.flatnonzero(head)
        self.anchors, doc = a[at], self.doc[order]
        self.low, self.high = (np.minimum.reduceat(doc, at), np.maximum.reduceat(doc, at)) if len(at) else (doc, doc)
        self.times = np.minimum(np.add.reduceat(fresh.astype(np.int64), at), 255).astype("u1") if len(at) else np.zeros(0, "u1")

    def open(self, answers: pa.Table, parts: int) -> "_Passages":
        flag = np.empty(len(self.order), "u1")
        flag[self.order] = X.collected(answers, 1, self.anchors, parts, "u1")[0][self.group]
        s = self.s
        whole = np.flatnonzero(flag == 1)
        seg, start = s.each(np.flatnonzero(flag == 2))
        return _Passages(
            self,
            np.concatenate([s.start[whole], start]),
            np.concatenate([s.count[whole] + self.window - 1, np.full(len(start), self.window)]),
            np.concatenate([self.doc[whole], self.doc[seg]]),
            np.concatenate([s.anchor[whole], self.win[start]]),
            np.concatenate([self.content[whole], self.win[start]]),
        )


class _Passages:
    """Open passages of a block; `one` lists one of each content, that of the earliest document, `back` leads to it, and `later` is the next document that has it (else the same)."""

    def __init__(self, state: _State, start: np.ndarray, size: np.ndarray, doc: np.ndarray, key: np.ndarray, content: np.ndarray):
        self.state, self.start, self.size, self.doc = state, start, size, doc
        order = np.lexsort((doc, content))
        head = np.ones(len(order), bool)
        head[1:] = content[order][1:] != content[order][:-1]
        first = order[head][np.cumsum(head) - 1]
        alike = np.empty(len(order), np.int64)
        alike[order] = first
        own = self._other(alike)  # equal hashes of different words: each stands for itself
        alike[own] = own
        self.one, self.back = np.unique(alike, return_inverse=True)
        self.key = key[self.one]
        low = doc[self.one]
        after = np.flatnonzero(doc > low[self.back])
        self.later = np.full(len(low), X.NO_ID, np.int64)
        np.minimum.at(self.later, self.back[after], doc[after])
        self.again = np.zeros(len(low), bool)
        self.again[self.back[after]] = True
        self.later[~self.again] = low[~self.again]

    def _other(self, alike: np.ndarray) -> np.ndarray:
        """Passages that differ in words from the one that has the same hash."""
        w = self.state.w
        at = np.flatnonzero((alike != np.arange(len(alike))) & (self.size == self.size[alike]))
        odd = np.flatnonzero(self.size != self.size[alike])
        n = self.size[at]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = np.repeat(self.start[at], n) + inner, np.repeat(self.start[alike[at]], n) + inner
        length = w.end - w.start
        bad = length[a] != length[b]
        bad[~bad] = differing(self.state.d.buf, w.start[a][~bad], w.start[b][~bad], length[a][~bad])
        return np.union1d(odd, at[np.unique(np.repeat(np.arange(len(at)), n)[bad])])

    def dealt(self, parts: int) -> list[np.ndarray]:
        """The passages of `one` for each part, in order of part."""
        part = (self.key % T.U(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order))
        return [order[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]

    def sent(self, parts: int) -> list[tuple[int, int, int, bytes]]:
        w, buf, rows = self.state.w, self.state.d.buf, []
        for mine in self.dealt(parts):
            at = self.one[mine]
            a, z = w.start[self.start[at]], w.end[self.start[at] + self.size[at] - 1]
            head = X.pack((z - a).astype("<u4"), self.doc[at], self.later[mine])
            content = squeeze(b"".join([buf[x:y].tobytes() for x, y in zip(a.tolist(), z.tolist(), strict=True)]))
            rows.append((int(self.key[mine[0]] % T.U(parts)), self.state.d.block, 2, len(head).to_bytes(8, "little") + head + content))
        return rows

    def gone(self, answers: pa.Table, parts: int) -> np.ndarray:
        """Which words of the block factors cover."""
        bits = {p: b for p, k, b in zip(answers["part"].to_pylist(), answers["kind"].to_pylist(), answers["blob"].to_pylist(), strict=True) if k == 2}
        size = self.size[self.one]
        first = np.cumsum(size) - size
        flags = np.zeros((2, int(size.sum())), bool)  # for the earliest document that has the words, and for later ones
        for mine in self.dealt(parts):
            n = size[mine]
            at = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            more = at[np.repeat(self.again[mine], n)]
            got = np.unpackbits(np.frombuffer(unsqueeze(bits[int(self.key[mine[0]] % T.U(parts))]), np.uint8), count=len(at) + len(more))
            flags[0, at], flags[1, more] = got[: len(at)], got[len(at) :]
        n = self.size
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        is_later = np.repeat((self.doc > self.doc[self.one][self.back]).astype(np.int64), n)
        covered = flags[is_later, np.repeat(first[self.back], n) + inner]
        gone = np.zeros(int(self.state.w.rows[-1]), bool)
        gone[(np.repeat(self.start, n) + inner)[covered]] = True
        return gone


def _serve_anchors(most: int):
    def serve(rows: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes]]:
        """0: one document has the seed; 1: several; 2: several, in more than `most` passages."""
        got = [X.unpack(b, "u8", "i8", "i8", "u1") for _, _, b in rows]
        a, low, high, times = (np.concatenate([g[k] for g in got]) for k in range(4))
        order = np.argsort(a, kind="stable")
        head = np.ones(len(a), bool)
        head[1:] = a[order][1:] != a[order][:-1]
        at = np.flatnonzero(head)
        several = np.minimum.reduceat(low[order], at) < np.maximum.reduceat(high[order], at)
        hot = np.add.reduceat(times[order].astype(np.int64), at) > most
        flag = np.empty(len(a), "u1")
        flag[order] = np.where(several, 1 + hot, 0).astype("u1")[np.cumsum(head) - 1]
        cuts = np.cumsum([0, *(len(g[0]) for g in got)])
        return [(r[0], 1, X.pack(flag[x:y])) for r, x, y in zip(rows, cuts[:-1], cuts[1:], strict=True)]

    return serve


def _serve_passages(window: int):
    def serve(rows: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes]]:
        """A reference block: factors all its passages, and gives each block the words of its own that factors cover (bits).

        Bits for the earliest document of a block come first, then those for later ones, of the passages that have any.
        """
        bufs, starts, lengths, hashes, counts, docs, later, base = [], [], [], [], [], [], [], 0
        for _, _, blob in rows:
            end = 8 + int.from_bytes(blob[:8], "little")
            size, doc, follow = X.unpack(blob[8:end], "<u4", "i8", "i8")
            buf = np.frombuffer(unsqueeze(blob[end:]), np.uint8)
            w = T.Words(buf, np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), T.PLAIN)
            bufs.append(buf)
            starts.append(w.start + base)
            lengths.append(w.end - w.start)
            hashes.append(w.hash)
            counts.append(np.diff(w.rows))
            docs.append(doc)
            later.append(follow)
            base += len(buf)
        words = word_ids(np.concatenate(bufs), np.concatenate(starts), np.concatenate(lengths), np.concatenate(hashes))
        count, doc, follow = np.concatenate(counts), np.concatenate(docs), np.concatenate(later)
        block = ReferenceBlock(words, np.concatenate([[0], np.cumsum(count)]), doc, window)
        mine, others = T.covered(*block.factors(), len(words)), T.covered(*block.factors(follow), len(words))
        again = np.repeat(follow > doc, count)
        cuts = np.cumsum([0, *(len(h) for h in hashes)])
        return [(r[0], 2, squeeze(np.packbits(np.concatenate([mine[x:y], others[x:y][again[x:y]]])).tobytes())) for r, x, y in zip(rows, cuts[:-1], cuts[1:], strict=True)]

    return serve


def dedup(spark: SparkSession, docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM, block_bytes: int = X.BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """One row for each row of `docs`; only doc_id and text are read.

    doc_id, n_words, n_removed, n_spans (maximal removed runs), kept_sha256 (of the
    kept words, joined by one space). A word goes if a window of `window` words covers
    it that also starts in a document with a smaller doc_id. Rows with one doc_id are
    one document in this: they remove nothing from each other. A row without doc_id
    counts as coming after all others. A null text has no words. An empty table gives
    no rows.
    """
    ws = Workspace(spark)
    src = docs.select("doc_id", F.col(text).alias("text"))
    n = parts(spark, 2 * text_bytes(src))
    blocks = X.blocked(ws, src, block_bytes, n)

    def ask_anchors(d: X.Documents, _: pa.Table) -> pa.Table:
        s = _State(d, window, gram)
        return X.packed_table(list(X.deal(d.block, 1, s.anchors, n, s.anchors, s.low, s.high, s.times)))

    known = ws.write(X.ask(X.per_block(blocks, None, ask_anchors, X.PACKED), _serve_anchors(hot)), "anchors")

    def send_passages(d: X.Documents, answers: pa.Table) -> pa.Table:
        return X.packed_table(_State(d, window, gram).open(answers, n).sent(n))

    covered = X.ask(X.per_block(blocks, known, send_passages, X.PACKED), _serve_passages(window))

    def finish(d: X.Documents, answers: pa.Table) -> pa.Table:
        s = _State(d, window, gram)
        gone, rows = s.open(answers, n).gone(answers, n), s.w.rows
        n_gone, n_spans, sha, raw = [], [], [], d.buf.tobytes()
        for r, (a, z) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
            words, cut = raw[d.offs[r] : d.offs[r + 1]].split(), gone[a:z]
            k = int(cut.sum())
            if k:
                words = [words[i] for i in np.flatnonzero(~cut).tolist()]
            n_gone.append(k)
            n_spans.append(int(np.count_nonzero(np.diff(cut.astype(np.int8), prepend=0) == 1)) if k else 0)
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.table({"doc_id": d.ids, "n_words": pa.array(np.diff(rows), pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return ws.close(X.per_block(blocks, known.unionByName(covered), finish, OUT))
