"""How five filters share and shadow each other's removals, by the multilinear extension of their union.

Every document has a mask of the filters that it fails. For a part of the table with
c(m) documents of mask m, the number that a set of filters removes is the value, at the
set's corner of the unit cube, of the removal polynomial

    f(x) = sum over m of c(m) * (1 - product over i in m of (1 - x_i)).

Corners give what an order of filters keeps and removes step by step; the integral of
a partial derivative along the diagonal is the filter's Shapley value. Only the counts of
masks leave the cluster's rows: 32 for each part, whatever its size.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: A: fewest words. B: percent of distinct words at least. C: percent of capital letters at most. D: symbols.
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, SYMBOLS = 100, 80, 10, "[#$%&*|]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LAST = (1 << 63) - 1
_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: str = "text") -> Column:
    """The bits of the filters that a text itself fails (A 1, B 2, C 4, D 8); a null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    upper = F.length(t) - F.length(F.translate(t, _UPPER, ""))
    failed = (n < LEAST_WORDS, 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n, 100 * upper > MOST_UPPER * F.length(t), t.rlike(SYMBOLS))
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(failed)), F.lit(0))


def mask_counts(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """part (lang, null as empty), mask, n, good, toxic: how many documents fail exactly these filters, and how many of these are labelled so.

    E, the copy of a smaller doc_id's text, is decided on digests: a text's documents are
    first counted by part, with the smallest doc_id and its rows apart, so that a text
    that a third of all rows hold leaves one row for each part.
    """
    label = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), text_mask(text).alias("own"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"))
    known = rows.where("doc_id is not null").join(label, "doc_id", "left")
    rows = known.unionByName(rows.where("doc_id is null"), allowMissingColumns=True).fillna(0, ["good", "toxic"]).withColumn("doc_id", F.coalesce("doc_id", F.lit(_LAST)))
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    same = rows.withColumn("n", F.lit(1)).groupBy("digest", "own", "part", "doc_id").agg(*sums)
    texts = same.groupBy("digest", "own", "part").agg(*sums, F.min(F.struct("doc_id", "n", "good", "toxic")).alias("low"))
    first = texts.groupBy("digest").agg(F.min("low.doc_id").alias("first"))
    judged = texts.join(first, "digest")
    at = F.col("low.doc_id") == F.col("first")
    kept = [F.when(at, F.col(f"low.{c}")).otherwise(F.lit(0)).alias(c) for c in ("n", "good", "toxic")]
    copies = [(F.col(c) - F.when(at, F.col(f"low.{c}")).otherwise(F.lit(0))).alias(c) for c in ("n", "good", "toxic")]
    both = F.array(F.struct(F.col("own").alias("mask"), *kept), F.struct((F.col("own") + 16).alias("mask"), *copies))
    return judged.select("part", F.explode(both).alias("x")).select("part", "x.*").where("n > 0").groupBy("part", "mask").agg(*sums)


def removal_polynomial(counts: dict[int, int], n_filters: int) -> dict[int, int]:
    """Coefficient of each monomial (set of filters as bits) of the polynomial of removals."""
    out = {}
    for t in range(1, 1 << n_filters):
        sign = 1 if t.bit_count() % 2 else -1
        if c := sign * sum(n for m, n in counts.items() if m & t == t):
            out[t] = c
    return out


def corner(poly: dict[int, int], filters: int) -> int:
    """Value where the filters of a set are 1 and the others 0: how many documents the set removes."""
    return sum(c for t, c in poly.items() if t & filters == t)


def shapley(poly: dict[int, int], k: int) -> Fraction:
    """Integral of the derivative by filter k along the diagonal from 0 to 1."""
    return sum((Fraction(c, t.bit_count()) for t, c in poly.items() if t >> k & 1), Fraction(0))


def _audited(table: pa.Table) -> pa.Table:
    """All orders and steps of one part, from its counts of masks."""
    k, mask = len(FILTERS), table["mask"].to_pylist()
    total, good, toxic = (removal_polynomial(dict(zip(mask, table[c].to_pylist(), strict=True)), k) for c in ("n", "good", "toxic"))
    size, part, every = sum(table["n"].to_pylist()), table["part"][0].as_py(), (1 << k) - 1
    shares = [shapley(total, i) * factorial(k) for i in range(k)]
    if any(s.denominator != 1 for s in shares):
        raise ArithmeticError("a sum over all orders is a whole number")
    gone, good_gone, toxic_gone = ([corner(p, s) for s in range(every + 1)] for p in (total, good, toxic))
    rows = []
    for order in permutations(range(k)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed = gone[after] - gone[before]
            rows.append((part, "".join(FILTERS[j] for j in order), step, size - gone[after], removed, gone[1 << i] - removed, gone[every] - gone[every ^ 1 << i], good_gone[after] - good_gone[before], toxic_gone[after] - toxic_gone[before], int(shares[i])))
            before = after
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """For each part (lang; null as empty), order of the filters and step: what the step keeps and removes.

    part, filter_order, step, kept, removed, redundant (fail the step's filter, but were
    removed before), unique_fails (fail this filter only), good_lost, toxic_lost (removed
    here and labelled so), shapley (the filter's removals summed over all orders). Of
    `docs` only doc_id, lang and the text are read. A null text is empty: it fails A. A row
    without doc_id comes after all others: it is a copy if any row with one has its text.
    Repeated rows count each; those that share the smallest doc_id of a text are no copies.
    A doc_id that `labels` holds more than once is good (toxic) if any of its rows is.
    An empty table has no parts, so no rows.
    """
    return mask_counts(docs, labels, text).groupBy("part").applyInArrow(_audited, _SCHEMA)
