"""Spelling variants: words one edit apart, by a positional q-gram inverted index with a count filter.

Of two words one edit apart, the shorter of c code points, either the first or the last c // 2
are the same. Words are dealt by these halves, so that a pair meets where it shares one; a
half that very many words have is dealt again by halves of what is left. What is left of a
word, with a code point on either side, gives positional bigrams. An index maps each bigram
and position to the words of c code points that have it. A word's posting lists (its own
positions for words as long as itself, these and those one before for words one shorter) are
merged by a heap; one edit changes two bigrams at most, so only words in all but two
lists of the longer word can be near, and the merge jumps over ids that fewer lists can
reach. What passes is verified.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence
from heapq import heapify, heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, parts, text_bytes

#: Code points and occurrences of a word at least; how often its form must be as frequent.
LEAST_CHARS, LEAST_TIMES, RATIO = 7, 2, 10
#: One occurrence in so many loses a code point.
SLIPS = 31
#: Words of one half, above which they are dealt again; code points that must be left for that.
HOT, LEAST_LEFT = 4096, 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DEALT = "key string, word string, n long"
_EDGE = "\0"


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n: the distinct words with their occurrences. A null doc_id counts as an empty one in the sum that decides which code point an occurrence loses."""
    runs = F.regexp_extract_all(F.translate(F.col(text), _UPPER, _LOWER), F.lit(r"[a-zÀ-ÿ]{%d,}" % LEAST_CHARS), F.lit(0))
    met = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat_ws(":", "doc", "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % SLIPS == 0, slipped).otherwise(F.col("run"))
    words = met.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= LEAST_CHARS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TIMES)


def halves(word: str, c: int, path: str, lo: int, hi: int) -> Iterator[str]:
    """Keys of a word among words of c and c + 1 code points, of which the first lo and the last hi are dealt by already."""
    half = (c - lo - hi) // 2
    end = len(word) - hi
    yield f"{c}:{path}p:{word[: lo + half]}:{word[end:]}"
    yield f"{c}:{path}s:{word[:lo]}:{word[end - half :]}"


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each word, as the shorter and as the longer of a pair."""
    for b in batches:
        rows = [(k, w, n) for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True) for c in (len(w), len(w) - 1) if c >= LEAST_CHARS for k in halves(w, c, "", 0, 0)]
        yield _batch(rows)


def _deal_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for key, w, n in zip(*(b.column(c).to_pylist() for c in ("key", "word", "n")), strict=True):
            c, path, pre, suf = key.split(":")
            rows += [(k, w, n) for k in halves(w, int(c), path, len(pre), len(suf))]
        yield _batch(rows)


def _batch(rows: Sequence[tuple[str, str, int]]) -> pa.RecordBatch:
    key, word, n = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["key", "word", "n"])


def merged(lists: list[list[int]], least: int) -> Iterator[int]:
    """Ids that at least `least` of these ascending lists have, by a heap of the lists' next ids; where fewer meet, lists jump to the next id that enough can reach."""
    heap = [(ids[0], k, 0) for k, ids in enumerate(lists)]
    heapify(heap)
    while len(heap) >= least:
        top, taken = heap[0][0], []
        while heap and heap[0][0] == top:
            taken.append(heappop(heap))
        if len(taken) >= least:
            yield top
            to = top + 1
        else:
            while len(taken) < least - 1:
                taken.append(heappop(heap))
            to = heap[0][0]
        for _, k, at in taken:
            ids = lists[k]
            at = bisect_left(ids, to, at)
            if at < len(ids):
                heappush(heap, (ids[at], k, at))


def one_edit(a: str, b: str) -> bool:
    """Whether b (as long as a, or one longer) is a with exactly one code point replaced or inserted."""
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a != b and a[k + (len(a) == len(b)) :] == b[k + 1 :]


def near_in_key(key: str, words: list[tuple[str, int]]) -> Iterator[tuple[str, int, str, int]]:
    """Near pairs among the words of one key, but for those that the keys of a first half find."""
    c, path, pre, suf = key.split(":")
    size, lo, hi, first = int(c), 0, 0, []
    for side in path:
        half = (size - lo - hi) // 2
        if side == "p":
            lo += half
        else:
            first.append((lo, lo + half))
            hi += half
    left, right, grams = pre[-1:] or _EDGE, suf[:1] or _EDGE, size - lo - hi + 1
    index: dict[tuple[int, str], list[int]] = defaultdict(list)
    words.sort(key=lambda x: len(x[0]))
    for i, (w, n) in enumerate(words):
        rest = left + w[lo : len(w) - hi] + right
        longer = len(w) > size
        mine = [(p, rest[p : p + 2]) for p in range(grams + longer)]
        lists = [index[g] for g in mine if g in index]
        if longer:
            lists += [index[g] for g in ((p - 1, x) for p, x in mine[1:]) if g in index]
        least = grams + longer - 2
        if len(lists) >= least:
            for j in merged(lists, least):
                v, m = words[j]
                if one_edit(v, w) and all(v[a:z] != w[a:z] for a, z in first):
                    yield v, m, w, n
        if not longer:
            for g in mine:
                index[g].append(i)


def _near(table: pa.Table) -> pa.Table:
    table = table.sort_by("key")
    rows = zip(*(table[c].to_pylist() for c in ("key", "word", "n")), strict=True)
    found = []
    for key, own in groupby(rows, lambda r: r[0]):
        words = [(w, n) for _, w, n in own]
        if len(words) > 1:
            found += near_in_key(key, words)
    cols = zip(*found, strict=True) if found else ((), (), (), ())
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["a", "na", "b", "nb"])


def near_pairs(ws: Workspace, words: DataFrame, hot: int = HOT) -> DataFrame:
    """a, na, b, nb: each pair of words (word, n) one edit apart, once."""
    n_shards = parts(ws.spark, 16 * text_bytes(words, "word"))
    dealt = ws.write(words.mapInArrow(_deal, _DEALT), "dealt-0")
    cool, level = None, 0
    while True:
        many = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > hot)
        c, pre, suf = (F.split_part("key", F.lit(":"), F.lit(k)) for k in (1, 3, 4))
        many = ws.write(many.where(c.cast("int") - F.length(pre) - F.length(suf) >= LEAST_LEFT).select("key"), f"many-{level}")
        rest = dealt.join(many, "key", "left_anti")
        cool = rest if cool is None else cool.unionByName(rest)
        if many.isEmpty():
            break
        level += 1
        dealt = ws.write(dealt.join(many, "key", "left_semi").mapInArrow(_deal_again, _DEALT), f"dealt-{level}")
    shard = F.pmod(F.xxhash64("key"), F.lit(n_shards)).alias("shard")
    return cool.select(shard, *(x.split()[0] for x in _DEALT.split(", "))).groupBy("shard").applyInArrow(_near, "a string, na long, b string, nb long")


def variants(spark: SparkSession, docs: DataFrame, text: str = "text", hot: int = HOT) -> DataFrame:
    """The distinct words of `docs` with their near words and forms; only doc_id and the text are read.

    word, n (occurrences), n_near (words one edit apart), form (the near word with the most
    occurrences, the first in code-point order among equals, if it has RATIO times as many;
    else null), form_n, root (where forms lead to; the word itself without one). A null text
    has no words; repeated rows count each. An empty table gives no rows.
    """
    ws = Workspace(spark)
    words = ws.write(word_counts(docs, text), "words")
    pairs = ws.write(near_pairs(ws, words, hot), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("x"))
    fits = -F.col("x.m") >= RATIO * F.col("n")
    forms = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("x.other")).alias("form"), F.when(fits, -F.col("x.m")).alias("form_n"))
    forms = ws.write(forms, "forms")
    # each form is RATIO times as frequent as its word, so chains are short; every round doubles what they span
    most = forms.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]
    roots, steps = forms.where("form is not null").select("word", F.col("form").alias("root")), 1
    while LEAST_TIMES * RATIO ** (steps + 1) <= most:
        roots = ws.write(roots.join(roots.toDF("root", "next"), "root", "left").select("word", F.coalesce("next", "root").alias("root")), f"roots-{steps}")
        steps *= 2
    out = forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    return ws.close(out)
