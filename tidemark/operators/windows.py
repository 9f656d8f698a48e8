"""Rolling operators over one series for each symbol; each is one shuffle by symbol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(symbol: str = "symbol", day: str = "date") -> Window:
    return Window.partitionBy(symbol).orderBy(day)


def with_returns(market: DataFrame) -> DataFrame:
    """simple_return (no fill over gaps) and dollar_volume."""
    last = F.lag("close_adj").over(by())
    return market.withColumns({"simple_return": F.when(last > 0, F.col("close_adj") / last - 1), "dollar_volume": F.col("close_raw") * F.col("volume")})


def momentum(bars: DataFrame, name: str, long: int, skip: int) -> DataFrame:
    """ln of the price `skip` bars ago over that `long` bars ago, counted on bars that have a price; needs long + 1 of them. Rows without a price keep the last value."""
    w = by()
    seen = F.count("close_adj").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = bars.withColumn("__seen", seen)
    full = Window.partitionBy("symbol", F.col("close_adj").isNotNull()).orderBy("date")
    value = F.ln(F.lag("close_adj", skip).over(full) / F.lag("close_adj", long).over(full))
    out = out.withColumn("__m", F.when(F.col("close_adj").isNotNull() & (F.col("__seen") > long), value))
    return out.withColumn(name, F.last("__m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__m", "__seen")


def history(bars: DataFrame) -> DataFrame:
    """market_history_days: bars with a price so far."""
    return bars.withColumn("market_history_days", F.count("close_adj").over(by().rowsBetween(Window.unboundedPreceding, 0)))


def volatility(bars: DataFrame, n: int, least: int, yearly: int, name: str = "volatility_3m") -> DataFrame:
    """Annualised deviation of the last n returns that are not null."""
    there = Window.partitionBy("symbol", F.col("simple_return").isNotNull()).orderBy("date").rowsBetween(-(n - 1), 0)
    value = F.when(F.col("simple_return").isNotNull() & (F.count("simple_return").over(there) >= least), F.stddev_samp("simple_return").over(there) * F.sqrt(F.lit(float(yearly))))
    out = bars.withColumn("__v", value)
    return out.withColumn(name, F.last("__v", ignorenulls=True).over(by().rowsBetween(Window.unboundedPreceding, 0))).drop("__v")


def liquidity(bars: DataFrame, n: int, least: int) -> DataFrame:
    """adv_20d, amihud_20d and liquidity_observations over the last n rows, null rows among them."""
    w = by().rowsBetween(-(n - 1), 0)
    dollars = F.when(F.col("dollar_volume") > 0, F.col("dollar_volume"))
    impact = F.when(F.col("dollar_volume") > 0, F.abs("simple_return") / F.col("dollar_volume"))
    return bars.withColumns(
        {
            "adv_20d": F.when(F.count(dollars).over(w) >= least, F.avg(dollars).over(w)),
            "amihud_20d": F.when(F.count(impact).over(w) >= least, F.avg(impact).over(w)),
            "liquidity_observations": F.count(impact).over(w),
        }
    )


def beta(bars: DataFrame, n: int, least: int, yearly: int) -> DataFrame:
    """beta_6m, idio_volatility_6m and beta_observations over the last n bars where both returns exist.

    bars: simple_return and benchmark_return. The residuals' sum of squares follows
    from the window's centred sums, which Spark keeps without cancellation.
    """
    both = F.col("simple_return").isNotNull() & F.col("benchmark_return").isNotNull()
    w = Window.partitionBy("symbol", both).orderBy("date").rowsBetween(-(n - 1), 0)
    out = bars.withColumn("__s", F.when(both, joint_sums(w)))
    out = out.withColumn("__s", F.last("__s", ignorenulls=True).over(by().rowsBetween(Window.unboundedPreceding, 0)))
    return beta_of(out, "__s", least, yearly)


def joint_sums(w: Window) -> Column:
    """Count and centred sums of simple_return and benchmark_return over a window of rows that have both."""
    pair = ("simple_return", "benchmark_return")
    return F.struct(F.count(F.lit(1)).over(w).alias("n"), F.regr_sxx(*pair).over(w).alias("xx"), F.regr_sxy(*pair).over(w).alias("xy"), F.regr_syy(*pair).over(w).alias("yy"))


def beta_of(out: DataFrame, sums: str, least: int, yearly: int) -> DataFrame:
    """beta_6m, idio_volatility_6m and beta_observations from a column of `joint_sums`, which goes."""
    xx, xy, yy, seen = (F.col(f"{sums}.{c}") for c in ("xx", "xy", "yy", "n"))
    ok = (seen >= least) & (xx > 0)
    idio = F.sqrt(F.greatest(yy - xy * xy / xx, F.lit(0.0)) / (seen - 1)) * F.sqrt(F.lit(float(yearly)))
    return out.withColumns({"beta_6m": F.when(ok, xy / xx), "idio_volatility_6m": F.when(ok, idio), "beta_observations": F.coalesce(seen, F.lit(0))}).drop(sums)


def month_calendar(days: DataFrame, lag: int = 1) -> DataFrame:
    """signal_date, execution_date, next_execution_date: the last day of each month, the day `lag` trading days before it, and the next month's last day. One row a month; months whose lag reaches before the first day are left out."""
    every = days.select(F.col("date").cast("date").alias("date")).distinct()
    months = every.groupBy(F.trunc("date", "MM").alias("month")).agg(F.max("date").alias("execution_date"))
    everything = Window.partitionBy(F.lit(0)).orderBy("date")  # a few thousand days, whatever the number of rows
    ranked = every.withColumns({"signal_date": F.lag("date", lag).over(everything), "k": F.row_number().over(everything)})
    ends = months.join(ranked, months.execution_date == ranked.date).select("signal_date", "execution_date")
    out = ends.withColumn("next_execution_date", F.lead("execution_date").over(Window.partitionBy(F.lit(0)).orderBy("execution_date")))
    return out.where("signal_date is not null")


def weekly_last(series: DataFrame, value: str) -> DataFrame:
    """symbol, week (its Friday), value: the last value of each week that is not null; weeks without one are there, with null, between a symbol's first and last."""
    week = F.next_day(F.date_sub("date", 1), "FRI")
    points = series.groupBy("symbol", week.alias("week")).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("date"))).alias(value))
    span = points.groupBy("symbol").agg(F.min("week").alias("a"), F.max("week").alias("z"))
    weeks = span.select("symbol", F.explode(F.sequence("a", "z", F.expr("interval 7 days"))).alias("week"))
    return weeks.join(points, ["symbol", "week"], "left")


def log_return(series: DataFrame, value: str, name: str = "log_return", order: str = "week") -> DataFrame:
    """ln of each value over the one before it in the calendar; null beside a gap."""
    return series.withColumn(name, F.ln(F.col(value) / F.lag(value).over(Window.partitionBy("symbol").orderBy(order))))


#: Of a sketch: ranks are right to one part in so many.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, value: str, cuts: Sequence[float], keys: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """keys and q: the exact quantiles (linear between neighbours) of a column for each key, in the order of `cuts`; keys without a value have no row.

    A sketch brackets each quantile. Of the values below and above a bracket only the count and
    the nearest are kept; those inside are counted by value and ranked. So a task holds the few
    ten-thousandths of a key's values that lie in a bracket, not all. A sketch that missed by
    more than its margin would be an error.
    """
    own = {k: f"__k{i}" for i, k in enumerate(keys)}
    names, margin = list(own.values()), 2.0 / accuracy
    there = df.where(F.col(value).isNotNull()).select(*(F.col(k).alias(x) for k, x in own.items()), F.col(value).cast("double").alias("__v"))
    ends = [max(c - margin, 0.0) for c in cuts] + [min(c + margin, 1.0) for c in cuts]
    sketch = there.groupBy(*names).agg(F.percentile_approx("__v", ends, accuracy).alias("__b"), F.count(F.lit(1)).alias("__n"))
    if names:
        other = sketch.withColumnsRenamed({x: f"{x}s" for x in names})
        met = there.join(other, [F.col(x).eqNullSafe(F.col(f"{x}s")) for x in names])
    else:
        met = there.join(F.broadcast(sketch))  # one row
    cells = []
    for i, c in enumerate(cuts):
        side = F.when(F.col("__v") < F.col("__b")[i], -1).when(F.col("__v") > F.col("__b")[len(cuts) + i], 1).otherwise(0)
        cells.append(F.struct(F.lit(i).alias("cut"), ((F.col("__n") - 1) * c).alias("at"), side.alias("side"), F.when(side == 0, F.col("__v")).alias("u")))
    each = met.select(*names, "__v", F.explode(F.array(*cells)).alias("x")).select(*names, "__v", "x.*")
    counted = each.groupBy(*names, "cut", "at", "side", "u").agg(F.count(F.lit(1)).alias("times"), F.min("__v").alias("least"), F.max("__v").alias("most"))
    upto = F.sum("times").over(Window.partitionBy(*names, "cut").orderBy("side", "u"))
    ranked = counted.withColumn("upto", upto).withColumn("start", F.col("upto") - F.col("times"))

    def of_rank(r: Column) -> Column:
        """The value of a rank: one inside, the last below or the first above."""
        here = (F.col("start") <= r) & (r < F.col("upto"))
        return F.max(F.when(here & ((F.col("side") <= 0) & ((F.col("side") == 0) | (r == F.col("upto") - 1))), F.col("most")).when(here & (F.col("side") > 0) & (r == F.col("start")), F.col("least")))

    lower, upper = of_rank(F.floor("at")), of_rank(F.ceil("at"))
    missed = lower.isNull() | upper.isNull()
    found = ranked.groupBy(*names, "cut", "at").agg(F.when(missed, F.raise_error(F.lit("a sketch missed its quantile")).cast("double")).otherwise(lower + (upper - lower) * (F.col("at") - F.floor("at"))).alias("v"))
    out = found.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("cut", "v"))), lambda x: x["v"]).alias("q"))
    return out.withColumnsRenamed({x: k for k, x in own.items()})


def winsorised(df: DataFrame, value: str, low: float, high: float, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """value clipped to its exact quantiles (linear between neighbours), over all rows or each key; a null key has its own. Null values stay null."""
    own = {f"__w{i}": F.col(k) for i, k in enumerate(keys)}
    q = exact_quantiles(df, value, (low, high), keys).toDF(*own, "__q")
    if keys:
        joined = df.withColumns(own).alias("l").join(q.alias("r"), [F.col(f"l.{x}").eqNullSafe(F.col(f"r.{x}")) for x in own], "left").select("l.*", "r.__q").drop(*own)
    else:
        joined = df.join(F.broadcast(q), how="left")  # one row at most
    return joined.withColumn(name, F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), F.col("__q")[0]), F.col("__q")[1]))).drop("__q")


def equity(df: DataFrame, ret: str, keys: tuple[str, ...], order: str) -> DataFrame:
    """equity (product of 1 + return so far), peak and drawdown; null returns are zero. The first peak is the first period's equity."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("equity", F.product(1 + F.coalesce(ret, F.lit(0.0))).over(w))
    out = out.withColumn("peak", F.max("equity").over(w))
    return out.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def rebased(df: DataFrame, log_ret: str, keys: tuple[str, ...], order: str) -> DataFrame:
    """index_level: exponential of summed log returns, 1 in the first row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("__e", F.exp(F.sum(F.coalesce(log_ret, F.lit(0.0))).over(w)))
    return out.withColumn("index_level", F.col("__e") / F.first("__e").over(w)).drop("__e")


def average_rank(value: str, keys: tuple[str, ...]) -> Column:
    """Rank by value in each key, ties getting their mean."""
    w = Window.partitionBy(*keys).orderBy(value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / F.lit(2.0)


def top_n(df: DataFrame, keys: tuple[str, ...], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; `order` must be total, so that results don't depend on row order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def latest(df: DataFrame, keys: tuple[str, ...], order: list[Column]) -> DataFrame:
    """One row of each key, the first by `order`."""
    return top_n(df, keys, order, 1)
