"""URL filters over a sorted digest array.

Keys (host and path prefix, as one string) are hashed with 64-bit xxHash and
sorted; the array, the verdicts and the full strings lie in one file that each
worker maps into memory, so that all of its processes share one copy. A URL gives
its candidate keys (each parent domain, with each prefix length in use), which a
vectorised binary search looks up; the stored string is compared before a match
counts, so that colliding digests do no harm. The longest matching key wins.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ://."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    for k, ch in enumerate(rest):
        if ch in "/?#":
            break
    else:
        k = len(rest)
    host = rest[:k].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    path = rest[k:]
    if not path.startswith("/"):
        return host, ""
    return host, path.partition("#")[0].partition("?")[0]


class DigestArray:
    """A file of sorted 64-bit digests with their strings and verdicts, mapped into memory.

    Layout, little-endian: number of keys n, number of lengths m (u64 each), the m
    path lengths in use, n digests (u64), n + 1 string offsets (u64), n verdict
    bytes, the strings.
    """

    def __init__(self, path: str):
        self.data = np.memmap(path, np.uint8, "r")
        n, m = (int(x) for x in self.data[:16].view(np.uint64))
        at = 16
        self.lengths = self.data[at : at + 8 * m].view(np.uint64).astype(int)
        at += 8 * m
        self.keys = self.data[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        self.offs = self.data[at : at + 8 * (n + 1)].view(np.uint64)
        at += 8 * (n + 1)
        self.verdict = self.data[at : at + n]
        self.strings = self.data[at + n :]

    @staticmethod
    def write(path: str, rules: Iterable[tuple[str, str]]) -> None:
        """rules: (verdict, key), a key being host, slash and path prefix. Of repeated keys the last counts."""
        last = {key.encode(): verdict == BLOCK for verdict, key in rules}
        rows = sorted((xxhash.xxh64_intdigest(k), k, v) for k, v in last.items())
        lengths = sorted({len(k) - k.index(b"/") for _, k, _ in rows})
        offs = np.cumsum([0, *(len(k) for _, k, _ in rows)])
        with open(path, "wb") as f:
            for x in ([len(rows), len(lengths)], lengths, [h for h, _, _ in rows], offs):
                f.write(np.array(x, np.uint64).tobytes())
            f.write(np.array([v for _, _, v in rows], np.uint8).tobytes())
            f.write(b"".join(k for _, k, _ in rows))

    def candidates(self, host: bytes, path: bytes) -> list[bytes]:
        """The keys that a URL could fit."""
        tails, h = [], host
        while h:
            tails.append(h)
            _, dot, h = h.partition(b".")
            if not dot:
                break
        return [t + path[:n] for t in tails for n in self.lengths if n <= len(path)]

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """Each key's row, or -1."""
        out = np.full(len(keys), -1)
        if not len(self.keys) or not keys:
            return out
        digests = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        left, right = np.searchsorted(self.keys, digests), np.searchsorted(self.keys, digests, "right")
        for i in np.flatnonzero(right > left).tolist():
            for r in range(int(left[i]), int(right[i])):  # over one only where digests collide
                if self.strings[int(self.offs[r]) : int(self.offs[r + 1])].tobytes() == keys[i]:
                    out[i] = r
        return out

    def match(self, urls: list[tuple[bytes, bytes]]) -> list[tuple[str, str] | None]:
        """Longest fitting key and its verdict for each (host, path)."""
        keys: list[bytes] = []
        owner: list[int] = []
        for i, (host, path) in enumerate(urls):
            c = self.candidates(host, path)
            keys += c
            owner += [i] * len(c)
        best: list[tuple[int, int, int] | None] = [None] * len(urls)
        rows = self.probe(keys)
        for j in np.flatnonzero(rows >= 0).tolist():
            rank = (len(keys[j]), keys[j].index(b"/"), int(rows[j]))
            i = owner[j]
            if best[i] is None or rank > best[i]:
                best[i] = rank
        out: list[tuple[str, str] | None] = []
        for b in best:
            r = b and b[2]
            out.append(None if b is None else (self.strings[int(self.offs[r]) : int(self.offs[r + 1])].tobytes().decode(), BLOCK if self.verdict[r] else ALLOW))
        return out


def ship(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> str:
    """Write a digest file on the driver and send it to every executor, later ones too; gives its name for SparkFiles."""
    name = f"digests-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="digests-"), name)
    DigestArray.write(path, rules)
    spark.sparkContext.addFile(path)
    return name


def judge(spark: SparkSession, pages: DataFrame, rules: Iterable[tuple[str, str]], blocklist: Iterable[str] = (), url: str = "url", id_col: str = "page_id") -> DataFrame:
    """One row for each row of `pages`; only id and url are read.

    page_id, host, path, rule (the longest key of `rules` that fits, else null),
    verdict (the rule's; without one, block if a key of `blocklist` fits, else
    allow), listed (the blocklist's key, else null). A rule fits its host and all
    subdomains whose path starts with its own. Of equally long keys, the one with
    the longer host wins. A null url, or one without ://, has an empty host and
    path and is allowed. Repeated rows are judged each.
    """
    own, lists = ship(spark, rules), ship(spark, ((BLOCK, k) for k in blocklist))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = DigestArray(SparkFiles.get(own)), DigestArray(SparkFiles.get(lists))
        for b in batches:
            pairs = [split_url(u) for u in b.column("url").to_pylist()]
            raw = [(h.encode("utf-8", "surrogatepass"), p.encode("utf-8", "surrogatepass")) for h, p in pairs]
            rule, listed = first.match(raw), second.match(raw)
            verdict = [r[1] if r else (BLOCK if x else ALLOW) for r, x in zip(rule, listed, strict=True)]
            cols = [[p[0] for p in pairs], [p[1] for p in pairs], [r and r[0] for r in rule], verdict, [x and x[0] for x in listed]]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(c, pa.string()) for c in cols)], names=["page_id", "host", "path", "rule", "verdict", "listed"])

    src = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"))
    schema = src.select("page_id").schema
    for n in ("host", "path", "rule", "verdict", "listed"):
        schema = schema.add(n, "string")
    return src.mapInArrow(run, schema)
