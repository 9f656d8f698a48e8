"""Quality rules with adaptive thresholds.

Each rule compares one rate of a document with a limit that comes from a
mergeable quantile sketch of its language and source: counts of values rounded
down to six significant bits, so that sketches merge by adding counts, in any
order, with a relative error below 1/32. The quartiles of a group are drawn toward
those of its language, and these toward those of all documents, as if PRIOR
documents more had them: a small group borrows much, a large one next to nothing,
without a step between. The limits are joined to the documents, which then pass or
fail.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, slices
from .stats import text_stats
from .text import packed

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_upper", "n_lines", "n_distinct")


@dataclass(frozen=True)
class Rule:
    """`rate` (a SQL expression, in thousandths) may lie `reach` spreads beyond the quartiles; a spread is the distance of the quartiles, `least` at least."""

    name: str
    rate: str
    least: int
    reach: float = 6.0
    low: bool = False


#: The default rules; rates are whole numbers, so that every engine gets the same.
RULES = (
    Rule("symbols", "1000 * n_symbols div greatest(n_words, 1)", 15),
    Rule("upper", "1000 * n_upper div greatest(word_chars, 1)", 25),
    Rule("dup_lines", "1000 * n_dup_lines div greatest(n_lines, 1)", 60),
    Rule("repeats", "1000 * n_repeat_words div greatest(n_words, 1)", 60),
    Rule("long_words", "1000 * word_chars div greatest(n_words, 1)", 1000),
    Rule("short_words", "1000 * word_chars div greatest(n_words, 1)", 600, low=True),
)
#: So many documents of the language (of all) count beside a group's (a language's) own.
PRIOR = 30


def counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The counts of text_stats for each row, beside the columns of `keep`; null texts count as empty."""
    names = BASE + EXTRA
    kept = [f for f in docs.schema.fields if f.name in keep]
    out = docs.select(*keep).schema
    for n in names:
        out = out.add(n, "long", False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text", source=text if text in keep else None):
            s = text_stats(*packed(b.column("__text")))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *(pa.array(s[n], pa.int64()) for n in names)], names=[*(f.name for f in kept), *names])

    kept = [docs.schema[k] for k in keep]
    return (docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias("__text"))).mapInArrow(run, out)


def rounded(v: Column) -> Column:
    """A value's bucket: itself without all but its six highest bits."""
    e = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, e), e)


def sketches(rates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rule, value, n: one sketch for each key and rule. They merge by summing n."""
    each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), rounded(F.col(f"r_{r.name}")).alias("value")) for r in RULES)))
    return rates.select(*keys, each.alias("e")).groupBy(*keys, "e.rule", "e.value").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rule, size, q1, q3 of each sketch."""
    w = Window.partitionBy(*keys, "rule")
    up = w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    at = sketch.select(*keys, "rule", "value", F.sum("n").over(up).alias("upto"), F.sum("n").over(w).alias("size"))

    def q(k: int) -> Column:
        return F.min(F.when(4 * F.col("upto") >= k * F.col("size"), F.col("value")))

    return at.groupBy(*keys, "rule").agg(F.max("size").alias("size"), q(1).alias("q1"), q(3).alias("q3"))


def limits(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """lang, source and, for each rule, its limit."""
    own = quartiles(sketch, ["lang", "source"])
    lang = quartiles(sketch.groupBy("lang", "rule", "value").agg(F.sum("n").alias("n")), ["lang"])
    whole = quartiles(sketch.groupBy("rule", "value").agg(F.sum("n").alias("n")), [])
    o, g, a = own.alias("o"), lang.alias("g"), whole.alias("a")
    joined = o.join(g, F.col("o.rule").eqNullSafe(F.col("g.rule")) & F.col("o.lang").eqNullSafe(F.col("g.lang"))).join(a, F.col("o.rule") == F.col("a.rule"))

    def drawn(c: str) -> Column:
        language = (F.col("g.size") * F.col(f"g.{c}") + prior * F.col(f"a.{c}")) / (F.col("g.size") + prior).cast("double")
        return (F.col("o.size") * F.col(f"o.{c}") + prior * language) / (F.col("o.size") + prior).cast("double")

    q = joined.select("o.lang", "o.source", "o.rule", drawn("q1").alias("q1"), drawn("q3").alias("q3"))
    bound = F.lit(None).cast("double")
    for r in RULES:
        reach = F.lit(r.reach) * F.greatest(F.col("q3") - F.col("q1"), F.lit(r.least))
        bound = F.when(F.col("rule") == r.name, F.col("q1") - reach if r.low else F.col("q3") + reach).otherwise(bound)
    return q.groupBy("lang", "source").agg(*(F.max(F.when(F.col("rule") == r.name, bound)).alias(f"limit_{r.name}") for r in RULES))


def judge(spark: SparkSession, docs: DataFrame, text: str = "text", id_col: str = "doc_id", prior: int = PRIOR) -> DataFrame:
    """One row for each row of `docs` (doc_id, text, lang, source; other columns are not read).

    doc_id, the base counts, base_failed, failed_rules (names of the adaptive rules
    that a document fails) and kept. A null text is an empty one, which fails the
    base rule; null languages and sources are groups of their own; repeated rows
    are judged each. An empty table gives no rows.
    """
    ws = Workspace(spark)
    base = ws.write(counts(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"), "lang", "source")), "counts")
    rates = base.withColumns({f"r_{r.name}": F.expr(r.rate) for r in RULES})
    bound = ws.write(limits(sketches(rates, ["lang", "source"]), prior), "limits")
    out = _verdicts(rates, bound).select("doc_id", "lang", "source", *BASE, "base_failed", "failed_rules", "kept")
    return ws.close(out)


def _verdicts(rates: DataFrame, bound: DataFrame) -> DataFrame:
    """The rows of `rates` with base_failed, failed_rules and kept, by the limits of their language and source."""
    b, m = rates.alias("b"), bound.withColumnsRenamed({"lang": "__lang", "source": "__source"})
    joined = b.join(m, F.col("b.lang").eqNullSafe(F.col("__lang")) & F.col("b.source").eqNullSafe(F.col("__source")), "left").drop("__lang", "__source")
    fails = [F.when(F.col(f"r_{r.name}") < F.col(f"limit_{r.name}") if r.low else F.col(f"r_{r.name}") > F.col(f"limit_{r.name}"), F.lit(r.name)) for r in RULES]
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = joined.withColumns({"base_failed": base_failed, "failed_rules": F.array_compact(F.array(*fails))})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def passing(spark: SparkSession, docs: DataFrame, prior: int = PRIOR) -> DataFrame:
    """The rows of `docs` that pass, with their columns; of an empty table none. Null texts fail, repeated rows are judged each. Limits come from a first reading; the second judges each row beside its text, which doesn't move."""
    ws = Workspace(spark)
    first = counts(docs.select("doc_id", "text", "lang", "source"))
    rated = {f"r_{r.name}": F.expr(r.rate) for r in RULES}
    bound = ws.close(limits(sketches(first.withColumns(rated), ["lang", "source"]), prior))  # a row for each language and source
    # columns travel under other names, so that none clashes with a count
    names = {c: c if c in ("text", "lang", "source") else f"__{k}" for k, c in enumerate(docs.columns)}
    every = counts(docs.withColumnsRenamed(names), keep=tuple(names.values())).withColumns(rated)
    return _verdicts(every, bound).where("kept").select(*(F.col(v).alias(c) for c, v in names.items()))
