"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tidemark.llm import spelling as S

R = random.Random(9)
DOCS = "doc_id long, text string, word string, n int, key string"


def edited(w, letters="abé"):
    k, kind = R.randrange(len(w) + 1), R.randrange(3)
    return w[:k] + R.choice(letters) + w[k:] if kind == 0 else w[: max(k - 1, 0)] + w[max(k, 1) :] if kind == 1 else w[: max(k - 1, 0)] + R.choice(letters) + w[max(k, 1) :]


def near(a, b):
    s, w = sorted((a, b), key=len)
    if len(s) == len(w):
        return sum(x != y for x, y in zip(s, w, strict=True)) == 1
    return len(w) == len(s) + 1 and any(w[:k] + w[k + 1 :] == s for k in range(len(w)))


def brute(rows):
    count = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= 7
    words = {w: n for w, n in count.items() if n >= 2}
    form, out = {}, {}
    for w, n in words.items():
        others = [x for x in words if abs(len(x) - len(w)) < 2 and near(x, w)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * n else None
        out[w] = [len(others), form[w], words[best] if form[w] else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, words[w], out[w][0], out[w][2])
    return sorted(out.values())


@pytest.fixture(scope="module")
def rows():
    vocab = ["".join(R.choice("ab") for _ in range(R.randint(7, 9))) for _ in range(30)]
    vocab += ["".join(R.choice("abcdefgéÿ×") for _ in range(R.randint(7, 16))) for _ in range(60)]
    vocab += [edited(w) for w in vocab for _ in range(3)] + ["zzzz" + "".join(R.choice("abcd") for _ in range(4)) for _ in range(120)]
    often = ["commonword", "commonwords", "commonwordsé"]
    texts = [" ".join(R.choice(vocab) for _ in range(R.randint(0, 120))) for _ in range(60)]
    texts += [" ".join([often[0]] * 400 + [often[1]] * 38 + [often[2]] * 3), None, "", "1234567 short WORDS", "A" * 3000, vocab[0].upper() + "-" + vocab[1] + "Œ" + vocab[2], "COMMONWORD " * 30_000]
    rows = [(k if k % 19 else None, t) for k, t in enumerate(texts)]
    return rows + rows[:3]


@pytest.mark.parametrize("hot", [S.HOT, 12])
def test_variants_equal_brute_force(spark, rows, hot):
    docs = spark.createDataFrame([(*r, "w", 1, "k") for r in rows], DOCS)
    got = sorted(tuple(r) for r in S.variants(spark, docs, hot=hot).collect())
    want = brute(rows)
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 5 for r in want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, "w", 1, "k"), (2, "no long one", "w", 1, "k")], DOCS)
    assert S.variants(spark, docs).collect() == [] == S.variants(spark, docs.where("false")).collect()


def test_merge_equals_counting():
    for _ in range(300):
        lists = [sorted(R.sample(range(40), R.randint(1, 20))) for _ in range(R.randint(1, 9))]
        least = R.randint(1, 5)
        count = Counter(x for ids in lists for x in ids)
        assert list(S.merged(lists, least)) == sorted(x for x, c in count.items() if c >= least)


def test_one_edit():
    for a in ("abcabca", "aaaaaaa", "abababab"):
        for _ in range(200):
            b = edited(edited(a, "ab"), "ab") if R.random() < 0.5 else edited(a, "ab")
            s, w = sorted((a, b), key=len)
            if len(w) - len(s) < 2:
                assert S.one_edit(s, w) == near(s, w)
