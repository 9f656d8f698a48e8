"""Scalar column expressions. None of them leaves the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Exchange prefixes of six-digit codes, and indices that break the rule.
INDEX_SUFFIX = {"000300": "SS", "000905": "SS", "000852": "SS"}
PREFIX_SUFFIX = (("BJ", "^(4|8|92)"), ("SS", "^[569]"), ("SZ", "^[0-3]"))
#: Quarter -> month and day of its snapshot, and days until it is public.
PUBLICATION = {2: (6, 30, 60), 4: (12, 31, 90)}


def symbol6(value: Column) -> Column:
    """Six-digit code that stands alone in a text, or null."""
    code = F.regexp_extract(value, r"(?<!\d)(\d{6})(?!\d)", 1)
    return F.when(code != "", code)


def symbol_strict(value: Column) -> Column:
    """First digits of a text, padded to six places; raises where there are none."""
    code = F.regexp_extract(value, r"(\d{1,6})", 1)
    return F.when(code != "", F.lpad(code, 6, "0")).otherwise(F.raise_error(F.concat(F.lit("no code in "), F.coalesce(value, F.lit("null")))))


def exchange_suffix(code: Column, indices: Mapping[str, str] = INDEX_SUFFIX) -> Column:
    """Exchange of a six-digit code, or null. Codes of `indices` have theirs whatever their prefix; none where all codes are securities'."""
    out = F.lit(None).cast("string")
    for suffix, pattern in reversed(PREFIX_SUFFIX):
        out = F.when(code.rlike(pattern), suffix).otherwise(out)
    for index, suffix in indices.items():
        out = F.when(code == index, suffix).otherwise(out)
    return out


def quarter_of(label: Column, fallback_year: Column) -> tuple[Column, Column]:
    """(year, quarter) of labels such as `2024年2季度` or `2024 Q2`; a missing year is the fallback's."""
    q = F.coalesce(F.nullif(F.regexp_extract(label, r"([1-4])\s*季度", 1), F.lit("")), F.nullif(F.regexp_extract(F.upper(label), r"Q\s*([1-4])", 1), F.lit("")))
    y = F.nullif(F.regexp_extract(label, r"(20\d{2})", 1), F.lit(""))
    return F.when(q.isNotNull(), F.coalesce(y.cast("int"), fallback_year)), q.cast("int")


def period_dates(year: Column, quarter: Column) -> tuple[Column, Column]:
    """Snapshot date of a second or fourth quarter, and the day on which it is public; raises for others."""
    day = days = F.raise_error(F.lit("only the second and fourth quarters have snapshots"))
    day, days = day.cast("date"), days.cast("int")
    for q, (m, d, wait) in PUBLICATION.items():
        day, days = F.when(quarter == q, F.make_date(year, F.lit(m), F.lit(d))).otherwise(day), F.when(quarter == q, F.lit(wait)).otherwise(days)
    return day, F.date_add(day, days)


def number(value: Column) -> Column:
    """A number in a text, percent signs and thousands separators aside; else null."""
    return finite(F.regexp_replace(value.cast("string"), "[%,]", "").try_cast("double"))


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(n: Column, d: Column) -> Column:
    """n / d where d > 0, else null."""
    return F.when(d > 0, n / d)


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    """x between low and high; null stays null."""
    bound = [b if isinstance(b, Column) else F.lit(b) for b in (low, high)]
    return F.when(x.isNotNull(), F.least(F.greatest(x, bound[0]), bound[1]))


def row_mean(*cols: Column) -> Column:
    """Mean of the values that are not null."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    return total / F.nullif(filled(*cols), F.lit(0))


def filled(*cols: Column) -> Column:
    """How many of the values are not null."""
    return sum((c.isNotNull().cast("int") for c in cols), F.lit(0))


def coverage(*cols: Column) -> Column:
    return filled(*cols) / F.lit(float(len(cols)))


def first_of(df: DataFrame, names: Sequence[str]) -> Column:
    """The first value that is not null among the columns that exist; null if none does."""
    there = [finite(F.col(n).cast("double")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("double")


def split_label(day: Column, design_end: str, validation_end: str) -> Column:
    """Chronological research split of a date."""
    return F.when(day <= F.lit(design_end).cast("date"), "design").when(day <= F.lit(validation_end).cast("date"), "validation").otherwise("final_holdout")


def included(flag: Column) -> Column:
    """Boolean of true/false/1/0 in any case; raises for anything else."""
    t = F.lower(F.trim(flag.cast("string")))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False).otherwise(F.raise_error(F.lit("an include flag is neither true nor false")).cast("boolean"))


def half_life(phi: Column) -> Column:
    """Periods in which an AR(1) deviation halves; null unless 0 < phi < 1."""
    return F.when((phi > 0) & (phi < 1), -F.lit(0.6931471805599453) / F.ln(phi))


def shock_to_profit(material: Column, beta: Column, shock: Column, passed_on: Column) -> Column:
    """Profit change of a price shock on a material cost, of which a share is passed on."""
    return -material * beta * shock * (1 - passed_on)


def percent(x: Column, digits: int = 2) -> Column:
    return F.concat(F.format_number(x * 100, digits), F.lit("%"))
