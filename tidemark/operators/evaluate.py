"""Signal diagnostics: information coefficients, quantile portfolios, Newey-West tests and false-discovery rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.probability import correlation_p, normal_p
from .cross_section import bucket
from .windows import average_rank

MONTHS = 12


def melted(panel: DataFrame, signals: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """keep, signal, value: one row for each signal; infinities and NaN are null."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), S.finite(F.col(s).cast("double")).alias("value")) for s in signals)))
    return panel.select(*keep, each.alias("__s")).select(*keep, "__s.signal", "__s.value")


def correlation(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; null, not an error, where either side is constant."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def information_coefficients(panel: DataFrame, signals: Sequence[str], target: str = "forward_excess_return", day: str = "execution_date", least: int = 10, p_values: bool = True) -> DataFrame:
    """day, signal, observations, pearson_ic, rank_ic (and their p-values) of each date and signal with enough rows and three distinct values."""
    long = melted(panel.withColumn("__t", S.finite(F.col(target).cast("double"))), signals, [day, "__t"]).where("value is not null and __t is not null")
    keys = (day, "signal")
    ranked = long.withColumns({"__rv": average_rank("value", keys), "__rt": average_rank("__t", keys)})
    out = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), F.countDistinct("value").alias("__d"), correlation("value", "__t").alias("pearson_ic"), correlation("__rv", "__rt").alias("rank_ic"))
    out = out.where((F.col("observations") >= least) & (F.col("__d") >= 3)).drop("__d")
    if p_values:
        out = out.withColumns({"pearson_p_value": correlation_p("pearson_ic", "observations"), "rank_ic_p_value": correlation_p("rank_ic", "observations")})
    return out


def hac_mean(df: DataFrame, value: str, keys: Sequence[str], order: str, lags: int = 3) -> DataFrame:
    """keys, n, mean, hac_t: Newey-West test of the mean, by sums of lagged products. hac_t is null for short series."""
    there = df.where(F.col(value).isNotNull())
    w = Window.partitionBy(*keys)
    dev = there.withColumn("__u", F.col(value) - F.avg(value).over(w)).withColumn("__n", F.count(F.lit(1)).over(w))
    ordered = w.orderBy(order)
    dev = dev.withColumns({f"__l{k}": F.col("__u") * F.lag("__u", k).over(ordered) for k in range(1, lags + 1)})
    sums = dev.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.sum(F.col("__u") * F.col("__u")).alias("__s0"), *(F.sum(f"__l{k}").alias(f"__s{k}") for k in range(1, lags + 1)))
    most = F.least(F.lit(lags), F.col("n") - 2)
    total = F.col("__s0")
    for k in range(1, lags + 1):
        total = total + F.when(most >= k, 2 * (1 - k / (most + 1.0)) * F.coalesce(f"__s{k}", F.lit(0.0))).otherwise(0.0)
    se = F.sqrt(F.when(total > 0, total)) / F.col("n")
    return sums.withColumn("hac_t", F.when(F.col("n") >= max(6, lags + 3), F.col("mean") / se)).select(*keys, "n", "mean", "hac_t")


def benjamini_hochberg(df: DataFrame, p: str, keys: Sequence[str], name: str = "bh_fdr_p_value") -> DataFrame:
    """Adjusted p-values within each key; null p-values stay null and don't count."""
    there = Window.partitionBy(*keys, F.col(p).isNotNull())
    rank = F.row_number().over(there.orderBy(p))
    out = df.withColumn("__a", F.when(F.col(p).isNotNull(), F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0)) * F.count(p).over(there) / rank))
    down = there.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.min("__a").over(down), F.lit(1.0)))).drop("__a")


def with_overall(df: DataFrame, split: str = "research_split") -> DataFrame:
    """Every row twice: in its own split, and in `all`. One pass; a union would read the input again."""
    return df.withColumn(split, F.explode(F.array_distinct(F.array(F.lit("all"), F.col(split)))))


def ic_summary(ic: DataFrame, day: str = "execution_date", lags: int = 3, p_values: bool = True) -> DataFrame:
    """For each split (and all) and signal: months, mean, deviation, ratio, share above zero, Newey-West t (p, adjusted p)."""
    both = with_overall(ic)
    keys = ["research_split", "signal"]
    base = both.groupBy(*keys).agg(F.count("rank_ic").alias("months"), F.avg("rank_ic").alias("mean_rank_ic"), F.stddev_samp("rank_ic").alias("rank_ic_std"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive_rank_ic_ratio"))
    tests = hac_mean(both, "rank_ic", keys, day, lags).select(*keys, F.col("hac_t").alias("hac_t_stat"))
    out = base.join(tests, keys, "left").withColumn("rank_ic_ir", F.when(F.col("rank_ic_std") > 0, F.col("mean_rank_ic") / F.col("rank_ic_std")))
    if p_values:
        out = benjamini_hochberg(out.withColumn("hac_p_value", normal_p("hac_t_stat")), "hac_p_value", ["research_split"])
    return out


def quantile_returns(panel: DataFrame, signals: Sequence[str], ret: str = "forward_return", day: str = "execution_date", tie: str = "symbol", quantiles: int = 5, least: int = 15) -> DataFrame:
    """day, signal, quantiles, leg, leg_return, names: mean return of each bucket, and of the top less the bottom one. Fewer than five rows for each bucket give three buckets."""
    long = melted(panel.withColumn("__t", S.finite(F.col(ret).cast("double"))), signals, [day, tie, "__t"]).where("value is not null and __t is not null")
    w = Window.partitionBy(day, "signal")
    sized = long.withColumns({"__n": F.count(F.lit(1)).over(w), "__r": F.row_number().over(w.orderBy("value", tie))}).where(F.col("__n") >= least)
    q = F.when(F.col("__n") >= quantiles * 5, F.lit(quantiles)).otherwise(F.lit(3))
    legs = sized.withColumns({"quantiles": q, "bucket": bucket(F.col("__r"), F.col("__n"), q)}).groupBy(day, "signal", "quantiles", "bucket").agg(F.avg("__t").alias("leg_return"), F.count(F.lit(1)).alias("names"))
    named = legs.select(day, "signal", "quantiles", F.concat(F.lit("Q"), F.col("bucket").cast("string")).alias("leg"), "leg_return", "names")
    edge = legs.groupBy(day, "signal", "quantiles").agg((F.max(F.when(F.col("bucket") == F.col("quantiles"), F.col("leg_return"))) - F.max(F.when(F.col("bucket") == 1, F.col("leg_return")))).alias("leg_return"), F.sum("names").alias("names"))
    return named.unionByName(edge.withColumn("leg", F.lit("top_minus_bottom")))


def quantile_summary(legs: DataFrame, day: str = "execution_date", lags: int = 3, p_values: bool = True) -> DataFrame:
    """For each split (and all), signal and leg: months, mean, yearly return and deviation, Newey-West t (p), share above zero."""
    both = with_overall(legs)
    keys = ["research_split", "signal", "leg"]
    base = both.groupBy(*keys).agg(F.count("leg_return").alias("months"), F.avg("leg_return").alias("mean_monthly_return"), (F.avg("leg_return") * MONTHS).alias("annualized_arithmetic_return"), (F.stddev_samp("leg_return") * F.sqrt(F.lit(float(MONTHS)))).alias("annualized_volatility"), F.avg((F.col("leg_return") > 0).cast("double")).alias("positive_month_ratio"))
    tests = hac_mean(both, "leg_return", keys, day, lags).select(*keys, F.col("hac_t").alias("hac_t_stat"))
    out = base.join(tests, keys, "left")
    return out.withColumn("hac_p_value", normal_p("hac_t_stat")) if p_values else out


def metric(df: DataFrame, column: str, **where: str) -> DataFrame:
    """One row, `value`: the first value that is not null under the given equalities; null if there is none."""
    found = df
    for k, v in where.items():
        found = found.where(F.col(k) == v)
    return found.agg(F.first(F.col(column), ignorenulls=True).alias("value"))
