"""The monthly feature panel, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import asof, cross_section, windows

# Names of features, which outputs carry, and the families that they form.
PRICE = ("momentum_12_1", "momentum_6_1", "volatility_3m", "beta_6m", "idio_volatility_6m", "adv_20d", "amihud_20d")
FUNDAMENTAL = ("gross_profitability", "accrual_quality", "leverage_quality", "quality_raw", "growth_raw", "fundamental_momentum_raw")
BETA = ("beta_6m", "idio_volatility_6m")
NEUTRALISED = ("momentum_12_1", "momentum_6_1", "volatility_3m", "beta_6m", "idio_volatility_6m", "amihud_20d", "quality_raw", "growth_raw", "fundamental_momentum_raw")
FAMILIES = {"price_momentum": ("momentum_12_1_z", "momentum_6_1_z"), "low_risk": ("volatility_3m_z", "beta_6m_z", "idio_volatility_6m_z"), "quality": ("quality_raw_z",), "fundamental_momentum": ("growth_raw_z", "fundamental_momentum_raw_z")}

#: What names a version of the members.
VERSION = ["snapshot_date", "available_date"]

# Accounting items under all names that filings use.
ITEMS = {
    "assets": ("total_assets", "assets"),
    "revenue": ("revenue", "total_revenue"),
    "cogs": ("cost_of_goods_sold", "cost_of_sales", "cogs"),
    "gross": ("gross_profit",),
    "income": ("net_income", "net_profit"),
    "cash": ("operating_cash_flow", "cfo"),
    "liabilities": ("total_liabilities", "liabilities"),
    "revenue_pct": ("revenue_growth_pct", "revenue_yoy_pct"),
    "income_pct": ("net_profit_growth_pct", "net_profit_yoy_pct"),
    "roe": ("roe_pct",),
    "gross_margin": ("gross_margin_pct",),
    "net_margin": ("net_margin_pct",),
    "debt": ("debt_ratio_pct",),
}


@dataclass(frozen=True)
class Features:
    """Windows in bars; the defaults are days."""

    long: int = 252
    medium: int = 126
    skip: int = 21
    volatility: int = 63
    beta: int = 126
    liquidity: int = 20
    min_volatility: int = 50
    min_beta: int = 100
    min_liquidity: int = 15
    yearly: int = 252
    clip: float = 5.0
    min_cross_section: int = 10
    min_coverage: float = 0.6
    min_row_coverage: float = 0.7
    lag: int = 1

    def __post_init__(self) -> None:
        bad = [f.name for f in fields(self) if getattr(self, f.name) <= 0 and f.name != "lag"]
        if bad or self.lag < 0 or self.skip >= self.medium or self.medium > self.long:
            raise ValueError(f"feature windows are out of order: {bad or 'skip, medium, long'}")


#: For weekly bars.
WEEKLY = Features(long=52, medium=26, skip=4, volatility=13, beta=26, liquidity=4, min_volatility=10, min_beta=20, min_liquidity=3, yearly=52)


def items(filings: DataFrame) -> DataFrame:
    """symbol, dates and the accounting ITEMS under one name each, whichever of their names exist."""
    days = [c for c in ("symbol", "report_date", "notice_date", "available_date") if c in filings.columns]
    return filings.select(*days, *(S.first_of(filings, names).alias(k) for k, names in ITEMS.items()))


def quality(df: DataFrame, p: str) -> dict[str, "F.Column"]:
    """Quality components of the struct column p."""
    c = {k: F.col(f"{p}.{k}") for k in ITEMS}
    gross = F.coalesce(c["gross"], c["revenue"] - c["cogs"])
    parts = [S.ratio(gross, c["assets"]), S.ratio(-(c["income"] - c["cash"]), c["assets"]), S.ratio(-c["liabilities"], c["assets"])]
    spare = S.row_mean(c["roe"] / 100, c["gross_margin"] / 100, c["net_margin"] / 100, -c["debt"] / 100)
    return {"gross_profitability": parts[0], "accrual_quality": parts[1], "leverage_quality": parts[2], "quality_raw": F.coalesce(S.row_mean(*parts), spare)}


def fundamental_features(known: DataFrame) -> DataFrame:
    """Features of current and prior filings (structs of ITEMS)."""
    now, before = quality(known, "current"), quality(known, "prior")
    growth = F.coalesce(S.ratio(F.col("current.revenue"), F.col("prior.revenue")) - 1, F.col("current.revenue_pct") / 100)
    profit = F.coalesce(S.ratio(F.col("current.income") - F.col("prior.income"), F.col("prior.assets")), F.col("current.income_pct") / 100)
    return known.withColumns({**now, "revenue_growth_yoy": growth, "profit_change_to_assets": profit, "growth_raw": S.row_mean(growth, profit), "fundamental_momentum_raw": now["quality_raw"] - before["quality_raw"]})


def price_features(market: DataFrame, benchmark: str | None, f: Features) -> DataFrame:
    """Every bar with its rolling features; the benchmark's return joins by date. Without a benchmark symbol beta and its companions are left to `member_betas`."""
    bars = windows.with_returns(market)
    if benchmark:
        index = bars.where(F.col("symbol") == benchmark).select("date", F.col("simple_return").alias("benchmark_return"))
        bars = bars.join(index, "date", "left")
    bars = windows.momentum(windows.momentum(windows.history(bars), "momentum_12_1", f.long, f.skip), "momentum_6_1", f.medium, f.skip)
    bars = windows.liquidity(windows.volatility(bars, f.volatility, f.min_volatility, f.yearly), f.liquidity, f.min_liquidity)
    return windows.beta(bars, f.beta, f.min_beta, f.yearly) if benchmark else bars


#: Dates of a benchmark up to which it is sent to every task; a longer one is joined by shuffle.
BROADCAST_DATES = 1_000_000


def with_benchmark(bars: DataFrame, benchmark: str) -> DataFrame:
    """Bars (with simple_return) of all other symbols with benchmark_return by date.

    Bars stay where they lie as long as the benchmark's dates, which are counted first
    (one bucket of a stored market), are few enough to be sent.
    """
    index = bars.where(F.col("symbol") == benchmark).select("date", F.col("simple_return").alias("benchmark_return"))
    few = bars.where(F.col("symbol") == benchmark).limit(BROADCAST_DATES + 1).count() <= BROADCAST_DATES
    return bars.where(F.col("symbol") != benchmark).join(F.broadcast(index) if few else index, "date", "left")


def member_benchmark(market: DataFrame, members: DataFrame) -> DataFrame:
    """signal_date, date, benchmark_return: the members' weighted return, weights renewed over those that have one that day.

    members: signal_date, symbol, benchmark_weight, snapshot_date, available_date.
    Returns are weighted once for each version of the members, not for each month.
    Weights that sum to zero count as equal.
    """
    bars = windows.with_returns(market).select("date", "symbol", "simple_return")
    joined = version_weights(members, bars).join(bars, "symbol")
    there = F.col("simple_return").isNotNull()
    weight = F.sum(F.when(there, F.col("weight")))
    daily = joined.groupBy(*VERSION, "date").agg(F.when(weight > 0, F.sum(F.col("simple_return") * F.col("weight")) / weight).alias("benchmark_return"))
    return members.select("signal_date", *VERSION).distinct().join(daily, VERSION).where("date <= signal_date").select("signal_date", "date", "benchmark_return")


def version_weights(members: DataFrame, bars: DataFrame) -> DataFrame:
    """snapshot_date, available_date, symbol, weight of the members that have bars at all; equal weights where a version's don't sum to a positive number."""
    held = members.select(*VERSION, "symbol", "benchmark_weight").distinct().join(bars.select("symbol").distinct(), "symbol", "left_semi")
    total = F.sum("benchmark_weight").over(windows.Window.partitionBy(*VERSION))
    return held.select(*VERSION, "symbol", F.when((total > 0) & (total < float("inf")), F.col("benchmark_weight")).otherwise(1.0).alias("weight"))


def member_betas(market: DataFrame, known: DataFrame, f: Features) -> DataFrame:
    """signal_date, symbol, beta_6m, idio_volatility_6m, beta_observations: each member against the return of the members known at that date.

    known: signal_date, symbol, benchmark_weight, snapshot_date, available_date. The benchmark
    changes with the version of the members, so each version has a series of its own, of the
    days that its months look back on and no others: from the bar `beta` bars before a member's
    first signal date. (All days, where a version has a weight of zero: a day on which only such
    members have returns is no joint bar, so that windows reach further back.) A window is then
    the last `beta` joint bars up to the signal date.
    """
    numbers = windows.Window.partitionBy("symbol").orderBy("date")
    bars = windows.with_returns(market).where("simple_return is not null").select("date", "symbol", "simple_return", F.row_number().over(numbers).alias("k"))
    months = known.select("signal_date", *VERSION, "symbol").distinct()
    weights = version_weights(known, bars)
    some = weights.groupBy(*VERSION).agg(F.min("weight").alias("least"))
    spans = months.groupBy(*VERSION, "symbol").agg(F.min("signal_date").alias("first"), F.max("signal_date").alias("last")).join(some, VERSION)
    at = asof.nearest(bars, spans, ["k"], "first", "at")
    back = F.when(F.col("least") > 0, F.greatest(F.col("at.k") - f.beta + 1, F.lit(1))).otherwise(1)
    begun = at.withColumn("k", back).join(bars.select("symbol", "k", "date"), ["symbol", "k"], "left")
    days = begun.groupBy(*VERSION).agg(F.min(F.coalesce("date", "first")).alias("low"), F.max("last").alias("high"))
    month = F.explode(F.sequence(F.trunc("low", "MM"), F.trunc("high", "MM"), F.expr("interval 1 month")))
    asked = weights.join(days, VERSION).withColumn("month", month)
    met = asked.join(bars.withColumn("month", F.trunc("date", "MM")), ["symbol", "month"]).where(F.col("date").between(F.col("low"), F.col("high")))
    day = windows.Window.partitionBy(*VERSION, "date")
    total = F.sum("weight").over(day)
    joint = met.select(*VERSION, "symbol", "date", "simple_return", F.when(total > 0, F.sum(F.col("simple_return") * F.col("weight")).over(day) / total).alias("benchmark_return")).where("benchmark_return is not null")
    w = windows.Window.partitionBy(*VERSION, "symbol").orderBy("date").rowsBetween(-(f.beta - 1), 0)
    rolled = joint.withColumn("s", windows.joint_sums(w))
    out = asof.nearest(rolled, months, ["s"], "signal_date", "x", (*VERSION, "symbol"))
    return windows.beta_of(out.select("signal_date", "symbol", F.col("x.s").alias("s")), "s", f.min_beta, f.yearly)


def labels(rows: DataFrame, market: DataFrame, benchmark: str | None) -> DataFrame:
    """forward_return, benchmark_forward_return and forward_excess_return between exact execution dates. Without a benchmark symbol, the weighted mean of the members that have a label."""
    out = asof.close_on(asof.close_on(rows, market, "execution_date", "label_start_close_adj"), market, "next_execution_date", "label_end_close_adj")
    out = out.withColumn("forward_return", F.when(F.col("label_start_close_adj") > 0, F.col("label_end_close_adj") / F.col("label_start_close_adj") - 1))
    if benchmark:
        point = market.where(F.col("symbol") == benchmark).select(F.col("date"), F.col("close_adj"))
        out = out.join(point.toDF("execution_date", "__a"), "execution_date", "left").join(point.toDF("next_execution_date", "__z"), "next_execution_date", "left")
        out = out.withColumn("benchmark_forward_return", F.when(F.col("__a") > 0, F.col("__z") / F.col("__a") - 1)).drop("__a", "__z")
    else:
        out = out.withColumn("benchmark_forward_return", weighted_mean("forward_return", "benchmark_weight", "execution_date"))
    return out.withColumn("forward_excess_return", F.col("forward_return") - F.col("benchmark_forward_return"))


def weighted_mean(value: str, weight: str, key: str) -> "F.Column":
    """Mean over the rows of a key that have the value; weights that sum to zero count as equal."""
    w = windows.Window.partitionBy(key)
    there = F.col(value).isNotNull()
    total = F.sum(F.when(there, F.col(weight))).over(w)
    return F.when(total > 0, F.sum(F.col(value) * F.col(weight)).over(w) / total).otherwise(F.avg(value).over(w))


def build(market: DataFrame, filings: DataFrame, members: DataFrame, benchmark: str | None, f: Features, group: str | None = "industry_group") -> DataFrame:
    """One row for each month and member: features known at the signal date, labels between execution dates, scores across the month. Without a benchmark symbol the members known at the signal date, by their weights, are the benchmark of beta and labels."""
    calendar = windows.month_calendar(market.select("date"), f.lag)
    known = asof.membership_asof(calendar, members)
    own = [*PRICE, "beta_observations"] if benchmark else [c for c in PRICE if c not in BETA]
    bars = asof.last_known(calendar, price_features(market, benchmark, f)).select("signal_date", "symbol", "market_history_days", *own, "liquidity_observations")
    rows = known.join(bars, ["signal_date", "symbol"])
    if not benchmark:
        rows = rows.join(member_betas(market, known, f), ["signal_date", "symbol"], "left")
    tidy = asof.with_effective_date(items(filings))
    books = fundamental_features(asof.fundamentals_asof(calendar, tidy, list(ITEMS))).select("signal_date", "symbol", "report_count", F.col("current.report_date").alias("financial_report_date"), *FUNDAMENTAL, "revenue_growth_yoy", "profit_change_to_assets")
    out = labels(rows.join(books, ["signal_date", "symbol"], "left"), market, benchmark)
    out = out.withColumns({"price_history_ok": S.filled(*map(F.col, PRICE)) == len(PRICE), "fundamental_history_ok": S.filled(*map(F.col, FUNDAMENTAL)) == len(FUNDAMENTAL), "raw_feature_coverage": S.coverage(*map(F.col, (*NEUTRALISED, "adv_20d")))})
    out = out.withColumns({"minimum_history_ok": F.col("price_history_ok") & F.col("fundamental_history_ok"), "row_coverage_ok": F.col("raw_feature_coverage") >= f.min_row_coverage})
    return scored(out, f, group)


def scored(rows: DataFrame, f: Features, group: str | None) -> DataFrame:
    """<feature>_z of every neutralised feature that enough of the month's rows have, and eligible_for_scoring.

    Features are unpivoted, so that one set of windows by month and feature scores them all; the
    other columns travel with the first one only. A row that is there twice comes back once.
    """
    day = ["execution_date"]
    rows = cross_section.robust_z(rows, "adv_20d", day, "adv_20d_z", f.clip)
    whole = F.struct(*rows.columns)
    each = [F.struct(F.lit(c).alias("__feature"), F.col(c).alias("__value"), (whole if k == 0 else F.lit(None).cast(rows.select(whole.alias("w")).schema["w"].dataType)).alias("__row")) for k, c in enumerate(NEUTRALISED)]
    own = [*day, "symbol", "adv_20d", *([group] if group else [])]
    long = rows.select(*own, F.explode(F.array(*each)).alias("__e")).select(*own, "__e.*")
    keys = [*day, "__feature"]
    long = long.withColumn("__share", cross_section.coverage(long, "__value", keys))
    long = cross_section.neutralised(long, "__value", "adv_20d", keys, "__score", group, f.clip, f.min_cross_section)
    shares = [F.max(F.when(F.col("__feature") == c, F.col("__share"))).alias(f"cs_coverage_{c}") for c in NEUTRALISED]
    scores = [F.max(F.when((F.col("__feature") == c) & (F.col("__share") >= f.min_coverage), F.col("__score"))).alias(f"{c}_z") for c in NEUTRALISED]
    wide = long.groupBy(*day, "symbol").agg(F.first("__row", ignorenulls=True).alias("__row"), *shares, *scores)
    out = wide.select("__row.*", *(f"cs_coverage_{c}" for c in NEUTRALISED), *(f"{c}_z" for c in NEUTRALISED))
    full = S.filled(*(F.col(f"{c}_z") for c in NEUTRALISED)) == len(NEUTRALISED)
    return out.withColumn("eligible_for_scoring", F.col("minimum_history_ok") & F.col("row_coverage_ok") & full)


def composite(panel: DataFrame, min_history: int, min_adv: float, coverage: float = 0.6, families: int = 3, yearly: int = 252) -> DataFrame:
    """Family scores, composite_score, systematic_eligible and the names that the portfolio reads."""
    out = cross_section.composite(panel, FAMILIES, dict.fromkeys(FAMILIES, 0.25), coverage, families)
    fit = F.coalesce((F.col("market_history_days") >= min_history) & (F.col("adv_20d") >= min_adv) & F.col("composite_score").isNotNull(), F.lit(False))
    return out.withColumns({"systematic_eligible": fit, "market_beta_126d": F.col("beta_6m"), "adv20_rmb": F.col("adv_20d"), "volatility_63d": F.col("volatility_3m") / F.sqrt(F.lit(float(yearly)))})
