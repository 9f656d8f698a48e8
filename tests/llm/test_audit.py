"""The filter audit against a brute-force walk through all orders."""

import random
import re
from collections import Counter
from itertools import permutations

from tidemark.llm import filter_audit

R = random.Random(3)
VOCAB = ["".join(R.choice("abcdefgh") for _ in range(R.randint(2, 7))) for _ in range(400)]


def prose(n, vocab=VOCAB):
    return " ".join(R.choice(vocab) for _ in range(n))


TEXTS = [prose(R.randint(60, 180), VOCAB[: R.choice((60, 400))]) for _ in range(40)]
TEXTS += [None, "", " \n\t", "x" * 30_000, prose(120).upper(), prose(120) + " 5 % | off", prose(20).upper() + " &", "É" * 9 + " A", "A" + "b" * 9, "AA" + "b" * 9]


def rows_of():
    rows = [(k, t, R.choice(("en", "de", None, "")), 1, "x") for k, t in enumerate(TEXTS)]
    rows += [(100 + k, TEXTS[k % 7], R.choice(("en", "de")), 1, "y") for k in range(30)]  # copies
    rows += [(3, TEXTS[3], "en", 1, "z"), (None, TEXTS[4], "en", 1, "z"), (None, TEXTS[9] + " new", "fr", 1, "z"), (None, TEXTS[9] + " new", "fr", 1, "z")]
    return rows


def brute(rows, labels):
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    first = {}
    for d, t, *_ in rows:
        first[t or ""] = min(first.get(t or "", 1 << 63), (1 << 63) - 1 if d is None else d)
    parts = {}
    for d, t, lang, *_ in rows:
        t, w = t or "", re.findall(r"[^\x20\x09-\x0D]+", t or "")
        bad = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), ((1 << 63) - 1 if d is None else d) > first[t]]
        parts.setdefault(lang or "", []).append(({f for f, b in zip("ABCDE", bad, strict=True) if b}, d in good, d in toxic))
    out = {}
    for part, docs in parts.items():
        sums = Counter()
        for order in permutations("ABCDE"):
            left, removed_before = docs, []
            for step, f in enumerate(order, 1):
                gone, left = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in x[0] for x in removed_before), sum(x[0] == {f} for x in docs), sum(x[1] for x in gone), sum(x[2] for x in gone)]
                removed_before += gone
                sums[f] += len(gone)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(sums[f])
    return out


DOCS = "doc_id long, text string, lang string, n long, mask string"
LABELS = "doc_id long, quality int, toxic int, text string, part string"


def test_audit_equals_a_walk_through_all_orders(spark):
    rows = rows_of()
    labels = [(k, R.choice((0, 1, None)), R.choice((0, 1)), "t", "p") for k in range(0, 120, 2)] + [(4, 1, 0, "t", "p"), (None, 1, 1, "t", "p"), (9_999, 1, 1, "t", "p")]
    got = filter_audit.audit(spark, spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert {tuple(r[:3]): list(r[3:]) for r in got} == brute(rows, labels)
    assert len(got) == 600 * len({r.part for r in got})


def test_audit_on_empty_tables(spark):
    docs, labels = spark.createDataFrame(rows_of()[:6], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(spark, docs.where("false"), labels).collect() == []
    got = filter_audit.audit(spark, docs, labels).collect()
    assert got and all(r.good_lost == r.toxic_lost == 0 for r in got)


def test_polynomial_of_removals():
    poly = filter_audit.removal_polynomial({0: 5, 1: 2, 3: 4, 6: 1}, 3)
    assert [filter_audit.corner(poly, s) for s in range(8)] == [0, 6, 5, 7, 1, 7, 5, 7]
    assert [filter_audit.shapley(poly, k) for k in range(3)] == [4, 2.5, 0.5]
