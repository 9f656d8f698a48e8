"""Normalisers of provider frames. Providers are injected as DataFrames; nothing here opens a connection."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.checks import first_present, require_columns
from ..operators.windows import latest, top_n

# Columns of providers in the order in which they are looked for.
HOLDING_CODE = ("股票代码", "symbol", "code")
HOLDING_NAME = ("股票名称", "name")
HOLDING_WEIGHT = ("占净值比例", "weight_pct", "weight")
HOLDING_PERIOD = ("季度", "quarter", "period")
MARKET_NAMES = {"日期": "date", "开盘": "open", "最高": "high", "最低": "low", "收盘": "close", "成交量": "volume", "成交额": "amount"}


def membership_snapshots(holdings: DataFrame, fund: str, cutoff: str, top: int = 50, year_col: str = "year") -> DataFrame:
    """The `top` holdings of every second and fourth quarter that is public at the cutoff."""
    code, weight, period = (first_present(holdings, c, "holdings") for c in (HOLDING_CODE, HOLDING_WEIGHT, HOLDING_PERIOD))
    name = next((c for c in HOLDING_NAME if c in holdings.columns), None)
    year, quarter = S.quarter_of(F.col(period).cast("string"), F.col(year_col) if year_col in holdings.columns else F.lit(None).cast("int"))
    rows = holdings.select(S.symbol6(F.col(code).cast("string")).alias("symbol"), (F.col(name) if name else F.lit(None)).cast("string").alias("name"), S.number(F.col(weight)).alias("weight_pct"), year.alias("year"), quarter.alias("quarter"))
    rows = rows.where("symbol is not null and weight_pct is not null and quarter in (2, 4)")
    day, public = S.period_dates(F.col("year"), F.col("quarter"))
    rows = rows.withColumns({"snapshot_date": day, "available_date": public}).where(F.col("available_date") <= F.lit(cutoff).cast("date"))
    one = latest(rows, ("snapshot_date", "symbol"), [F.desc("weight_pct"), F.asc("name")])
    best = top_n(one, ("snapshot_date",), [F.desc("weight_pct"), F.asc("symbol")], top)
    w = F.row_number().over(Window.partitionBy("snapshot_date").orderBy(F.desc("weight_pct"), F.asc("symbol")))
    return best.select(F.lit(fund).alias("fund_symbol"), "snapshot_date", "available_date", "year", "quarter", w.alias("rank"), "symbol", "name", "weight_pct")


def member_symbols(members: DataFrame) -> DataFrame:
    """Distinct padded codes."""
    return members.select(F.lpad(F.col("symbol").cast("string"), 6, "0").alias("symbol")).where("symbol is not null").distinct()


def utc_date(text: Column) -> Column:
    """The day in UTC of a timestamp's text, whatever its offset; null where it can't be read."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(F.try_to_timestamp(text)) / 86_400).cast("int"))


def long_prices(wide: DataFrame, fields: Sequence[str], day: str = "date", sep: str = "__") -> DataFrame:
    """A wide frame with columns field__ticker as date, ticker, and a column for each field."""
    cols = [c for c in wide.columns if sep in c]
    long = wide.unpivot(day, cols, "__name", "__value") if cols else None
    if long is None:
        raise ValueError("no column names a field and a ticker")
    parts = long.select((utc_date(F.col(day)) if dict(wide.dtypes)[day] == "string" else F.to_date(day)).alias("date"), F.split("__name", sep)[0].alias("field"), F.split("__name", sep)[1].alias("ticker"), F.col("__value").cast("double").alias("value"))
    return parts.groupBy("date", "ticker").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields))


def joined_prices(raw: DataFrame, adjusted: DataFrame, tickers: DataFrame, start: str, end: str) -> DataFrame:
    """Raw and adjusted bars of both kinds, by date and ticker, with codes (tickers: ticker, symbol) and the adjustment factor."""
    r = raw.select("date", "ticker", *(F.col(c).alias(f"{c}_raw") for c in ("open", "high", "low", "close", "volume")))
    a = adjusted.select("date", "ticker", *(F.col(c).alias(f"{c}_adjusted") for c in ("open", "high", "low", "close", "volume")))
    both = r.join(a, ["date", "ticker"]).where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & (F.col("close_raw") > 0))
    out = both.join(tickers, "ticker").withColumn("adjustment_factor", F.col("close_adjusted") / F.col("close_raw"))
    return latest(out, ("date", "symbol"), [F.asc("ticker")])


def with_fallback(wanted: DataFrame, primary: DataFrame, fallback: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Primary bars, and the fallback's for codes that they lack; raises if some are still missing."""
    lacking = wanted.join(primary.select("symbol").distinct(), "symbol", "left_anti")
    out = primary.unionByName(fallback(lacking), allowMissingColumns=True)
    still = [r.symbol for r in wanted.join(out.select("symbol").distinct(), "symbol", "left_anti").limit(20).collect()]
    if still:
        raise ValueError(f"no prices for: {still}")
    return out


def fallback_prices(wanted: DataFrame, raw: DataFrame, adjusted: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Bars of the wanted symbols (raw and adjusted frames by symbol), and the symbols that failed, with the reason."""
    own = [f.join(wanted, "symbol", "left_semi").withColumnRenamed("symbol", "ticker") for f in (raw, adjusted)]
    bars = joined_prices(*own, wanted.select(F.col("symbol").alias("ticker"), "symbol"), start, end)
    seen = [f.select(F.col("ticker").alias("symbol")).distinct().withColumn(n, F.lit(True)) for f, n in zip(own, ("__raw", "__adjusted"), strict=True)]
    lacking = wanted.join(bars.select("symbol").distinct(), "symbol", "left_anti").join(seen[0], "symbol", "left").join(seen[1], "symbol", "left")
    reason = F.when(F.col("__raw").isNull(), "no raw prices").when(F.col("__adjusted").isNull(), "no adjusted prices").otherwise("no common days in the window")
    return bars, lacking.select("symbol", reason.alias("reason"))


def from_providers(wanted: DataFrame, providers: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Each symbol's rows from the first provider that has any, and the ledger (symbol, provider; null where none has)."""
    every = None
    for k, (name, frame) in enumerate(providers.items()):
        one = frame.join(wanted, "symbol", "left_semi").withColumns({"__k": F.lit(k), "provider": F.lit(name)})
        every = one if every is None else every.unionByName(one, allowMissingColumns=True)
    best = every.withColumn("__best", F.min("__k").over(Window.partitionBy("symbol"))).where("__k = __best").drop("__k", "__best")
    return best, wanted.join(best.select("symbol", "provider").distinct(), "symbol", "left")


def futures_series(frame: DataFrame, symbol: str, variety: str, start: str, end: str, rule: str = "main_continuous") -> DataFrame:
    """A provider's continuous contract: the window of days, numbers from text, a row a day."""
    out = frame.withColumnsRenamed({"hold": "open_interest"})
    numbers = ("open", "high", "low", "close", "volume", "open_interest", "settle")
    require_columns(out, ("date", *numbers), symbol)
    out = out.select(F.to_date("date").alias("date"), *(F.col(c).cast("string").try_cast("double").alias(c) for c in numbers))
    out = out.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return latest(out, ("date",), [F.asc(c) for c in numbers]).withColumns({"symbol": F.lit(symbol), "variety": F.lit(variety), "selection_rule": F.lit(rule)})


def fundamentals(frame: DataFrame, names: dict[str, str], cutoff: str, numbers: Iterable[str]) -> DataFrame:
    """Filings under canonical names; text becomes numbers, what isn't public at the cutoff goes, of repeated versions one stays."""
    out = frame.withColumnsRenamed(names)
    require_columns(out, ("symbol", "report_date", "notice_date"), "fundamentals")
    out = out.withColumns({"symbol": S.symbol6(F.col("symbol").cast("string")), **{c: F.to_date(c) for c in ("report_date", "notice_date")}, **{c: S.number(F.col(c)) for c in numbers if c in out.columns}})
    out = out.withColumn("available_date", F.col("notice_date")).where(F.greatest("report_date", "notice_date") <= F.lit(cutoff).cast("date"))
    return latest(out, ("symbol", "report_date", "notice_date"), [F.asc(c) for c in out.columns])


def market_frame(frame: DataFrame, symbol: str, name: str, segment: str) -> DataFrame:
    """A provider's daily frame under canonical names, dated, numeric, a row a day."""
    out = frame.withColumnsRenamed({k: v for k, v in MARKET_NAMES.items() if k in frame.columns})
    require_columns(out, ("date", "open", "high", "low", "close", "volume"), symbol)
    cols = [c for c in ("open", "high", "low", "close", "volume", "amount") if c in out.columns]
    out = out.select(F.to_date("date").alias("date"), *(S.number(F.col(c)).alias(c) for c in cols), F.lit(symbol).alias("symbol"), F.lit(name).alias("name"), F.lit(segment).alias("segment"))
    return latest(out.where("date is not null and close is not null"), ("date",), [F.asc(c) for c in cols])


def annual_reports(frame: DataFrame, cutoff: str, first: str = "2022-12-31") -> DataFrame:
    """Year-end reports from `first` on, public at the cutoff."""
    day = F.to_date("report_date")
    return frame.where((F.month(day) == 12) & (F.dayofmonth(day) == 31) & (day >= F.lit(first).cast("date")) & (F.greatest(day, F.to_date("notice_date")) <= F.lit(cutoff).cast("date")))


def grouped_members(members: DataFrame, groups: DataFrame | None) -> DataFrame:
    """Members with their group; excluded ones go. Without a table of groups all are unclassified. groups: symbol, industry_group, include."""
    if groups is None:
        return members.withColumn("industry_group", F.lit("unclassified"))
    flags = groups.select("symbol", "industry_group", S.included(F.col("include")).alias("__in"))
    joined = members.join(flags, "symbol", "left").where(F.coalesce("__in", F.lit(True))).drop("__in")
    return joined.withColumn("industry_group", F.coalesce("industry_group", F.lit("unclassified")))


def date_chunks(df: DataFrame, start: str, end: str, days: int = 10) -> DataFrame:
    """a, z: a span of dates in chunks of some days, the last one shorter."""
    s = F.explode(F.sequence(F.col(start), F.col(end), F.expr(f"interval {days} days"))).alias("a")
    return df.select(s, F.col(end).alias("__e")).select("a", F.least(F.date_add("a", days - 1), F.col("__e")).alias("z"))
