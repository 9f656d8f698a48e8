"""Benchmark decontamination with an FM-index for each shard of documents.

A shard is a bounded slice of a partition. Of its words, only runs made of
benchmark words and long enough to hold a test phrase can match; their word ids,
parted by a separator, are the shard's text: what is indexed is these runs, not
words that no phrase has. Its FM-index is a wavelet matrix
over the Burrows-Wheeler transform with every sixteenth suffix position kept.
Test phrases are searched backward, all at once; occurrences are located by
walking to the next sampled position; their spans merge into the words to remove.

Phrases lie in blocks of bounded size in files that every worker reads one at a
time, so that neither a long benchmark nor a large corpus has to fit in memory.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as st

from . import text as T
from .common import slices

WINDOW = 10
#: Words of benchmark items in one block of phrases; a longer item is a block of its own.
BLOCK_WORDS = 1 << 20
SHARD_BYTES = 2 << 20
ADDED = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")
SAMPLE = 16


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Suffixes of x in order, by prefix doubling; the end sorts before everything."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: max(n - k, 0)] = rank[k:]
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[1], (np.diff(key[order]) != 0).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n or k >= n:
            return order
        k *= 2


class WaveletMatrix:
    """Ranks over a sequence of numbers below 2**bits: how often a symbol occurs before a position."""

    def __init__(self, x: np.ndarray, bits: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for b in range(bits - 1, -1, -1):
            ones = (x >> b) & 1
            counts = np.zeros(len(x) + 1, np.int32)
            np.cumsum(ones, out=counts[1:])
            zeros = len(x) - int(counts[-1])
            self.levels.append((b, counts, zeros))
            x = np.concatenate([x[ones == 0], x[ones == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for b, counts, zeros in self.levels:
            one = ((symbol >> b) & 1).astype(bool)
            low = np.where(one, zeros + counts[low], low - counts[low])
            high = np.where(one, zeros + counts[high], high - counts[high])
        return high - low


class FMIndex:
    """Index of a sequence of word ids (0 parts runs). A terminator below every id is added at the end."""

    def __init__(self, x: np.ndarray):
        x = np.concatenate([x + 1, [0]]).astype(np.int32)
        sa = suffix_array(x).astype(np.int32)
        self.bwt = x[sa - 1]
        top = int(x.max())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=top + 1))])
        self.tree = WaveletMatrix(self.bwt, max(1, top.bit_length()))
        self.kept = sa % SAMPLE == 0
        self.slot = np.cumsum(self.kept, dtype=np.int32) - 1
        self.samples = sa[self.kept]
        self.n, self.top = len(x), top

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of each row of `phrases` (ids), by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = (phrases < self.top).all(axis=1)  # ids above the text's largest don't occur
        high[~live] = 0
        for j in range(phrases.shape[1] - 1, -1, -1):
            at = np.flatnonzero(high > low)
            if not len(at):
                break
            c = phrases[at, j].astype(np.int64) + 1
            base = self.first[c]
            low[at], high[at] = base + self.tree.rank(c, low[at]), base + self.tree.rank(c, high[at])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row: steps back until a sampled one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.kept[rows[open_]]
            at = open_[done]
            out[at] = self.samples[self.slot[rows[at]]] + steps[at]
            open_ = open_[~done]
            c = self.bwt[rows[open_]]
            rows[open_] = self.first[c] + self.tree.rank(c, rows[open_])
            steps[open_] += 1
        return out


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> list[str]:
    """Phrase files on the driver: vocabulary (hashes in order), phrases by length, and the items of each phrase."""
    folder = tempfile.mkdtemp(prefix="phrases-")
    paths: list[str] = []
    ids: list = []
    words: list[np.ndarray] = []

    def flush() -> None:
        if not ids:
            return
        vocab = np.unique(np.concatenate(words))
        by_length: dict[int, tuple[list, list]] = {}
        for k, h in enumerate(words):
            x = np.searchsorted(vocab, h) + 1
            n = min(window, len(x))
            rows, items = by_length.setdefault(n, ([], []))
            rows.append(np.lib.stride_tricks.sliding_window_view(x, n))
            items.append(np.full(len(x) - n + 1, k))
        phrases = []
        for n, (rows, items) in by_length.items():
            distinct, back = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
            order = np.argsort(back.ravel(), kind="stable")
            starts = np.concatenate([[0], np.cumsum(np.bincount(back.ravel(), minlength=len(distinct)))])
            phrases.append((n, distinct.astype(np.int32), starts, np.concatenate(items)[order]))
        path = os.path.join(folder, f"phrases-{uuid.uuid4().hex}.bin")
        with open(path, "wb") as f:
            pickle.dump({"vocab": vocab, "phrases": phrases, "items": [None if i is None else str(i) for i in ids]}, f)
        paths.append(path)
        ids.clear()
        words.clear()

    held = 0
    for row in benchmark.toLocalIterator():  # one partition at a time
        buf = np.frombuffer((row["text"] or "").encode("utf-8", "surrogatepass"), np.uint8)
        h = T.Words(buf, np.array([0, len(buf)]), T.ALNUM).hash
        if not len(h):
            continue
        if held and held + len(h) > block_words:
            flush()
            held = 0
        ids.append(row["item_id"])
        words.append(h)
        held += len(h)
    flush()
    return paths


def _hits(w: T.Words, block: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of phrases: the length, start word and phrase of all occurrences in a shard, and where the items of each phrase lie (first, owner)."""
    vocab = block["vocab"]
    at = np.minimum(np.searchsorted(vocab, w.hash), len(vocab) - 1)
    ids = np.where(vocab[at] == w.hash, at + 1, 0)
    # maximal runs of benchmark words within a row
    edge = np.zeros(len(ids) + 1, bool)
    edge[w.rows] = True
    known = ids > 0
    start = np.flatnonzero(known & (np.concatenate([[True], ~known[:-1]]) | edge[:-1]))
    end = np.flatnonzero(known & (np.concatenate([~known[1:], [True]]) | edge[1:])) + 1
    long = end - start >= min(n for n, *_ in block["phrases"])
    start, end = start[long], end[long]
    if not len(start):
        return
    size = end - start
    # text position -> word position: runs one after another, a separator after each
    offs = np.concatenate([[0], np.cumsum(size + 1)])
    x, place = np.zeros(offs[-1], np.int64), np.full(offs[-1], -1, np.int64)
    inner = np.arange(offs[-1]) - np.repeat(offs[:-1], size + 1)
    real = inner < np.repeat(size, size + 1)
    place[real] = (np.repeat(start, size + 1) + inner)[real]
    x[real] = ids[place[real]]
    index = FMIndex(x)
    for n, rows, first, owner in block["phrases"]:
        low, high = index.search(rows)
        found = np.flatnonzero(high > low)
        times = (high - low)[found]
        if len(found):
            flat = np.repeat(low[found], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            yield n, place[index.locate(flat)], np.repeat(found, times), first, owner


def _ship(spark: SparkSession, benchmark: DataFrame, window: int, block_words: int) -> list[str]:
    """Send the phrase files to every executor, later ones too; gives their names for SparkFiles."""
    names = []
    for path in _blocks(benchmark, window, block_words):
        spark.sparkContext.addFile(path)
        names.append(os.path.basename(path))
    return names


class _Shard:
    """The words of a slice of rows, which of them are hit, and each row's items and number of hits."""

    def __init__(self, column: pa.Array, names: list[str], loaded: dict[str, dict]):
        """loaded: phrase blocks read so far; several are read again for each shard, one at a time."""
        self.buf, self.offs = T.packed(column)
        w = self.words = T.Words(self.buf, self.offs, T.ALNUM)
        self.hit = np.zeros(len(w.hash), bool)
        #: arrays of item ids for each row; rows with the same phrases share one array
        self.items: list[list[np.ndarray]] = [[] for _ in range(len(column))]
        for name in names if len(w.hash) else ():
            if name not in loaded:
                if len(names) > 1:
                    loaded.clear()
                with open(SparkFiles.get(name), "rb") as f:
                    loaded[name] = pickle.load(f)
            block = loaded[name]
            ids = np.array(block["items"], object)
            for n, start, phrase, first, owner in _hits(w, block):
                self.hit |= T.covered(start, n, len(self.hit))
                # occurrences fold to a row's distinct phrases before any phrase becomes its items
                met = np.unique(np.stack([np.searchsorted(w.rows, start, side="right") - 1, phrase], axis=1), axis=0)
                edges = np.flatnonzero(np.diff(met[:, 0], prepend=-1, append=-1))
                same: dict[bytes, np.ndarray] = {}
                for a, z in zip(edges[:-1], edges[1:], strict=True):
                    key = met[a:z, 1].tobytes()
                    if key not in same:
                        seen = np.zeros(len(ids), bool)
                        for p in met[a:z, 1].tolist():
                            seen[owner[first[p] : first[p + 1]]] = True
                        same[key] = ids[seen]
                    self.items[met[a, 0]].append(same[key])
        counts = np.zeros(len(self.hit) + 1, np.int64)
        np.cumsum(self.hit, out=counts[1:])
        self.n_hit = counts[w.rows[1:]] - counts[w.rows[:-1]]
        self.n_words = np.diff(w.rows)

    def listed(self) -> list[tuple[int, str]]:
        """Of each row, the number of distinct items with an id and the digest of their sorted ids."""
        known: dict[tuple[int, ...], tuple[int, str]] = {}
        out = []
        for arrays in self.items:
            key = tuple(map(id, arrays))
            if key not in known:
                names = sorted({x for a in arrays for x in a.tolist() if x is not None})
                known[key] = len(names), hashlib.sha256(",".join(names).encode()).hexdigest()
            out.append(known[key])
        return out

    def spans(self, r: int) -> list[tuple[int, int]]:
        """Merged removal spans of a row, in bytes."""
        w, a, z = self.words, self.words.rows[r], self.words.rows[r + 1]
        turn = np.flatnonzero(np.diff(np.concatenate([[False], self.hit[a:z], [False]]).astype(np.int8)))
        return [(int(w.start[a + s] - self.offs[r]), int(w.end[a + e - 1] - self.offs[r])) for s, e in zip(turn[::2], turn[1::2], strict=True)]


def annotate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row for each row of `docs`: its columns without the text, then n_words, n_hit, n_items, items_sha256, contaminated and spans.

    `spans` lists the merged removal spans as (start, end) in bytes of the UTF-8
    text. Columns of `docs` with one of these names give way to them. A null text
    has no words; an item without words has no window, one with fewer than `window`
    words is one window. Windows of an item without id hit like others, but it
    isn't counted or listed. Items that repeat an id count once. An empty benchmark
    leaves all documents clean, an empty `docs` gives no rows. Words are compared by
    64-bit hashes.
    """
    names = _ship(spark, benchmark, window, block_words)
    kept = [c for c in docs.columns if c != text and c not in ADDED]
    span = st.StructType([st.StructField("start", st.IntegerType()), st.StructField("end", st.IntegerType())])
    kinds = (st.LongType(), st.LongType(), st.LongType(), st.StringType(), st.BooleanType(), st.ArrayType(span))
    schema = st.StructType([*(docs.schema[c] for c in kept), *(st.StructField(n, k) for n, k in zip(ADDED, kinds, strict=True))])
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, dict] = {}
        for b in slices(batches, "__text", SHARD_BYTES):
            s = _Shard(b.column("__text"), names, loaded)
            spans = [[{"start": a, "end": z} for a, z in s.spans(r)] if k else [] for r, k in enumerate(s.n_hit.tolist())]
            n_items, sha = zip(*s.listed(), strict=True)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in kept), pa.array(s.n_words, pa.int64()), pa.array(s.n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha), pa.array(s.n_hit > 0), pa.array(spans, spans_type)],
                names=schema.names,
            )

    return docs.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, most: float = 0.8, window: int = WINDOW) -> DataFrame:
    """`docs` with the removal spans cut out of `text` (n_chars follows); a document of which more than `most` of its words are hit goes altogether.

    Clean documents stay as they are, null texts among them. An empty table gives
    no rows. Texts travel to Python once.
    """
    names = _ship(spark, benchmark, window, BLOCK_WORDS)
    plain = docs.withColumnsRenamed({c: f"__{k}" for k, c in enumerate(docs.columns)})  # no name clashes with the slice's own
    at, count = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    columns = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: dict[str, dict] = {}
        for b in slices(batches, "text", SHARD_BYTES, columns[at]):
            s = _Shard(b.column("text"), names, loaded)
            b = b.select(columns)
            dirty = np.flatnonzero((s.n_hit > 0) & (s.n_hit <= most * s.n_words)).tolist()
            if dirty:
                texts = b.column(at).to_pylist()
                for r in dirty:
                    raw, cut, parts = s.buf[s.offs[r] : s.offs[r + 1]].tobytes(), 0, []
                    for a, z in s.spans(r):
                        parts.append(raw[cut:a])
                        cut = z
                    texts[r] = b"".join([*parts, raw[cut:]]).decode("utf-8", "surrogatepass")
                b = b.set_column(at, columns[at], pa.array(texts, b.column(at).type))
                if count is not None:
                    n = b.column(count).to_pylist()
                    for r in dirty:
                        n[r] = len(texts[r])
                    b = b.set_column(count, columns[count], pa.array(n, b.column(count).type))
            yield b.filter(pa.array(s.n_hit <= most * s.n_words))

    out = plain.mapInArrow(run, plain.schema)
    return out.select(*(F.col(v).alias(c) for c, v in zip(docs.columns, columns, strict=True)))
