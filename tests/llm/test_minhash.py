"""Bottom-k near-duplicates against brute-force Jaccard, with groups of many near copies."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import minhash_dedup as M

R = random.Random(5)
VOCAB = ["".join(R.choice("abcdefghijklmn") for _ in range(R.randint(2, 7))) for _ in range(1500)]
DOCS = "doc_id long, text string, cls int, n string, v long, hashes string"


def prose(n):
    return [R.choice(VOCAB) for _ in range(n)]


def changed(words, edits):
    words = list(words)
    for _ in range(edits):
        words[R.randrange(len(words))] = R.choice(VOCAB) + "X"
    return words


def shingles(t, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    names = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min(names[find(i)], default=None)
        out.append((d, len(sets[i]), c, c is None or d == c))
    return out


def corpus():
    texts = [prose(R.randint(1, 300)) for _ in range(60)]
    base, near, long = prose(260), prose(40), prose(3000)
    texts += [changed(base, R.randint(1, 16)) for _ in range(150)]  # many copies, some below the threshold
    texts += [changed(near, R.randint(0, 3)) for _ in range(60)] + [changed(long, e) for e in (0, 90, 120, 150, 170, 200)]
    boilerplate = prose(60)
    texts += [boilerplate + prose(R.randint(5, 120)) for _ in range(80)]  # one passage that many share
    for n in (40, 63, 64, 65, 66, 70, 100):  # around the size of a sketch
        one = prose(n + 3)
        texts += [one, one + prose(n // 5), one + prose(n // 4), one + prose(n // 4 + 1), one[n // 10 :]]
    rows = [(k if k % 41 else None, " ".join(t)) for k, t in enumerate(texts)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE two"), (1005, "one two three four"), (5, rows[5][1]), (None, rows[7][1]), (1006, rows[9][1].upper()), (1007, "y " * 20_000)]
    R.shuffle(rows)
    return rows


@pytest.mark.parametrize("block_bytes, canopy", [(M.BLOCK_BYTES, M.CANOPY), (3_000, 20_000)])
def test_components_equal_brute_force(spark, monkeypatch, block_bytes, canopy):
    monkeypatch.setattr(M, "CANOPY", canopy)  # canopies of several chunks
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "n", 2, "h") for r in rows], DOCS)
    got = M.dedup(spark, docs, block_bytes=block_bytes).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 1, "n", 2, "h")], DOCS)
    assert [tuple(r)[:2] + tuple(r)[3:] for r in M.dedup(spark, docs).collect()] == [(1, 0, 1, True)]
    assert M.dedup(spark, docs.where("false")).collect() == []


def test_estimates_are_exact_for_whole_sketches_and_bounded_for_others():
    rng = np.random.default_rng(1)
    for n, m in ((30, 30), (64, 60), (64, 75), (400, 400), (400, 330), (70, 64)):
        for share in (0.5, 0.8, 0.95):
            common = rng.integers(0, 1 << 63, int(share * min(n, m)), dtype=np.uint64)
            a = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, n - len(common), dtype=np.uint64)]))
            b = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, m - len(common), dtype=np.uint64)]))
            x, y = a[: M.SKETCH], b[: M.SKETCH]
            passed = bool(M.estimated(x, len(a), y, np.zeros(len(y), int), np.array([len(b)]))[0])
            union = np.union1d(a, b)
            if max(n, m) > M.SKETCH:
                limit = min(s[-1] if len(full) > M.SKETCH else np.iinfo(np.uint64).max for s, full in ((x, a), (y, b)))
                union = union[union <= limit]
            both = len(np.intersect1d(np.intersect1d(a, b), union))
            assert passed == (100 * both >= (M.ESTIMATE if max(n, m) > M.SKETCH else M.LEAST) * len(union))
            if share == 0.95 and n == m:
                assert passed
