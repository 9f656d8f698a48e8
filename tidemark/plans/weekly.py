"""Weekly analyses of a single series: attribution, rolling regressions, AR(1), bootstrap and scenario grids.

Cross products are summed across the cluster; only systems of a few unknowns, and
series of a few hundred weeks, are solved in one task each.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import scalars as S
from ..functions.probability import correlation_p
from ..operators import asof, cross_section
from ..operators.windows import average_rank, exact_quantiles
from .regression import unit_root_statistic

def rolling_slope(df: DataFrame, y: str, x: str, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """slope, intercept of y on x over the last n rows, once n are there."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    full = F.count(F.lit(1)).over(w) >= n
    return df.withColumns({"slope": F.when(full, F.regr_slope(y, x).over(w)), "intercept": F.when(full, F.regr_intercept(y, x).over(w))})


def walk_forward(df: DataFrame, y: str, x: str, keys: Sequence[str], order: str, train: int) -> DataFrame:
    """predicted y of each row from a fit on the `train` rows before it, and error."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-train, -1)
    full = F.count(F.lit(1)).over(w) >= train
    out = df.withColumns({"__b": F.when(full, F.regr_slope(y, x).over(w)), "__a": F.when(full, F.regr_intercept(y, x).over(w))})
    out = out.withColumn("predicted", F.col("__a") + F.col("__b") * F.col(x)).drop("__a", "__b")
    return out.withColumn("error", F.col(y) - F.col("predicted"))


def _solved(products: list[list[Column]], right: list[Column]) -> list[Column]:
    """Solution of a small symmetric system, by elimination in column expressions; null where it is singular."""
    k = len(right)
    m = [[*row, r] for row, r in zip(products, right, strict=True)]
    for i in range(k):
        pivot = F.nullif(m[i][i], F.lit(0.0))
        for j in range(i + 1, k):
            ratio = m[j][i] / pivot
            m[j] = [m[j][c] - ratio * m[i][c] if c > i else F.lit(0.0) for c in range(k + 1)]
    out: list[Column] = [F.lit(None).cast("double")] * k
    for i in range(k - 1, -1, -1):
        rest = m[i][k]
        for j in range(i + 1, k):
            rest = rest - m[i][j] * out[j]
        out[i] = rest / F.nullif(m[i][i], F.lit(0.0))
    return out


def window_fit(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], order: str, first: int, last: int) -> DataFrame:
    """beta_<x> of each factor and beta_const of a least-squares fit of y over the rows `first` to `last` around each one, where all of them are there.

    Covariances of the window give the normal equations, so that a fit of k factors
    costs k (k + 3) / 2 window sums and no Python. Rows with nulls must be gone.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(first, last)
    names = [*xs, y]
    sums = {f"__c{i}_{j}": F.covar_pop(names[i], names[j]).over(w) for i in range(len(xs)) for j in range(i, len(names))}
    means = {f"__m{i}": F.avg(c).over(w) for i, c in enumerate(names)}
    out = df.withColumns({**sums, **means, "__n": F.count(F.lit(1)).over(w)})
    k = len(xs)
    out = out.withColumn("__full", F.col("__n") >= last - first + 1)
    slopes = _solved([[F.col(f"__c{min(i, j)}_{max(i, j)}") for j in range(k)] for i in range(k)], [F.col(f"__c{i}_{k}") for i in range(k)])
    out = out.withColumns({f"beta_{x}": F.when(F.col("__full"), b) for x, b in zip(xs, slopes, strict=True)})
    const = F.col(f"__m{k}") - sum((F.col(f"beta_{x}") * F.col(f"__m{i}") for i, x in enumerate(xs)), F.lit(0.0))
    return out.withColumn("beta_const", F.when(F.col("__full"), const)).drop(*sums, *means, "__n", "__full")


def rolling_fit(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str], order: str, n: int = 52) -> DataFrame:
    """A fit on the last n rows of each row."""
    return window_fit(df, y, xs, keys, order, -(n - 1), 0)


def walk_forward_models(df: DataFrame, y: str, models: dict[str, Sequence[str]], keys: Sequence[str], order: str, train: int = 78) -> DataFrame:
    """predicted_<model> of each row from a fit on the `train` rows before it; rows without one go."""
    out = df
    for name, xs in models.items():
        fitted = window_fit(out, y, xs, keys, order, -train, -1)
        predicted = F.col("beta_const") + sum((F.col(f"beta_{x}") * F.col(x) for x in xs), F.lit(0.0))
        out = fitted.withColumn(f"predicted_{name}", predicted).drop("beta_const", *(f"beta_{x}" for x in xs))
    return out.where(" and ".join(f"predicted_{name} is not null" for name in models))


def compared(df: DataFrame, keys: Sequence[str], actual: str, small: str, large: str) -> DataFrame:
    """Errors of two nested models out of sample, the larger one's gain, and shares of right directions, that of always betting on a rise among them."""
    e, e0 = (F.col(actual) - F.col(f"predicted_{m}") for m in (large, small))

    def right(m: str) -> Column:
        return F.avg((F.signum(actual) == F.signum(f"predicted_{m}")).cast("double"))

    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"),
        F.sqrt(F.avg(e0 * e0)).alias(f"{small}_rmse"),
        F.sqrt(F.avg(e * e)).alias(f"{large}_rmse"),
        (1 - F.sum(e * e) / F.nullif(F.sum(e0 * e0), F.lit(0.0))).alias("incremental_oos_r2"),
        right(small).alias(f"{small}_directional_accuracy"),
        right(large).alias(f"{large}_directional_accuracy"),
        F.avg((F.col(actual) > 0).cast("double")).alias("naive_positive_directional_accuracy"),
    )


def accuracy(df: DataFrame, keys: Sequence[str], actual: str, predicted: str, base: str) -> DataFrame:
    """Root mean squared errors of a forecast and a base forecast, out-of-sample gain, share of right directions."""
    e, e0 = F.col(actual) - F.col(predicted), F.col(actual) - F.col(base)
    there = df.where(F.col(predicted).isNotNull() & F.col(base).isNotNull() & F.col(actual).isNotNull())
    return there.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.avg(e0 * e0)).alias("base_rmse"), (1 - F.sum(e * e) / F.nullif(F.sum(e0 * e0), F.lit(0.0))).alias("incremental_r2"), F.avg((F.signum(actual) == F.signum(predicted)).cast("double")).alias("directional_accuracy"))


def peer_scores(df: DataFrame, key: str, good: Sequence[str], growth: Sequence[str], bad: Sequence[str], name: str = "symbol") -> DataFrame:
    """quality, growth and balance scores of each key's peers from clipped z-scores, their mean, rank and universe size (all peers, scored or not)."""
    out = df
    for c in (*good, *growth, *bad):
        out = cross_section.quantile_z(out, c, [key], f"{c}_z")
    out = out.withColumns({"quality_score": S.row_mean(*(F.col(f"{c}_z") for c in good)), "growth_score": S.row_mean(*(F.col(f"{c}_z") for c in growth)), "balance_score": -S.row_mean(*(F.col(f"{c}_z") for c in bad))})
    out = out.withColumn("operating_score", S.row_mean(F.col("quality_score"), F.col("growth_score"), F.col("balance_score")))
    w = Window.partitionBy(key)
    return out.withColumns({"score_rank": F.rank().over(w.orderBy(F.desc_nulls_last("operating_score"))), "universe": F.count(F.lit(1)).over(w)})


def rank_correlation(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """key, n, rank_ic of x and y."""
    there = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = there.withColumns({"__x": average_rank(x, (key,)), "__y": average_rank(y, (key,))})
    return r.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.covar_pop("__x", "__y") / F.nullif(F.stddev_pop("__x") * F.stddev_pop("__y"), F.lit(0.0))).alias("rank_ic"))


#: Days after the first of May of the next year over which a report's scores are held against returns.
EVALUATED = 183


def validated(scores: DataFrame, prices: DataFrame, benchmark: str, cutoff: str, p_values: bool = True) -> DataFrame:
    """report_date, evaluation_start, evaluation_end, companies, rank_ic (p_value): how the scores of each report date rank the peers' later returns in excess of the benchmark.

    scores: report_date, symbol, operating_score. The window begins on the first of May after the
    report's year and ends EVALUATED days later, at the cutoff at the latest; report dates whose
    window has not begun by then are left out. Peers without a score or a price don't count.
    """
    last = F.to_date(F.lit(cutoff))
    windows = scores.select("report_date").distinct().withColumn("start", F.make_date(F.year("report_date") + 1, F.lit(5), F.lit(1))).where(F.col("start") <= last)
    windows = windows.withColumn("end", F.least(F.date_add("start", EVALUATED), last))
    asked = scores.select("report_date", "symbol", "operating_score").join(windows, "report_date")
    market = windows.select("report_date", F.lit(benchmark).alias("symbol"), F.lit(None).cast("double").alias("operating_score"), "start", "end")
    held = asof.forward_return(prices, asked.unionByName(market))
    index = held.where(F.col("symbol") == benchmark).select("report_date", F.col("span_return").alias("market_return"))
    excess = held.where(F.col("symbol") != benchmark).join(index, "report_date").withColumn("excess", F.col("span_return") - F.col("market_return"))
    ic = windows.join(rank_correlation(excess, "report_date", "operating_score", "excess"), "report_date", "left")
    out = ic.select("report_date", F.col("start").alias("evaluation_start"), F.col("end").alias("evaluation_end"), F.coalesce("n", F.lit(0)).alias("companies"), "rank_ic")
    return out.withColumn("p_value", correlation_p("rank_ic", F.col("companies").cast("double"))) if p_values else out


def bridge(df: DataFrame, year: str, volume: str, price: str, keys: Sequence[str] = ()) -> DataFrame:
    """Symmetric bridge of value from each year to the next: effect of volume at mean price, of price at mean volume, and their sum."""
    last = df.select(*keys, (F.col(year) + 1).alias(year), F.col(volume).alias("__v"), F.col(price).alias("__p"))
    j = df.join(last, [*keys, year])
    out = j.select(*keys, year, ((F.col(volume) - F.col("__v")) * (F.col(price) + F.col("__p")) / 2).alias("volume_effect"), ((F.col(price) - F.col("__p")) * (F.col(volume) + F.col("__v")) / 2).alias("price_effect"))
    return out.withColumn("total_effect", F.col("volume_effect") + F.col("price_effect"))


def hhi(df: DataFrame, share_pct: str) -> DataFrame:
    return df.agg(F.sum(F.pow(F.col(share_pct) / 100, F.lit(2.0))).alias("hhi"), F.sum(share_pct).alias("share_sum"))


def ar1(df: DataFrame, value: str, keys: Sequence[str], order: str) -> DataFrame:
    """phi, intercept, n and half_life of each series' regression on its own last value."""
    lagged = df.withColumn("__l", F.lag(value).over(Window.partitionBy(*keys).orderBy(order))).where(F.col(value).isNotNull() & F.col("__l").isNotNull())
    out = lagged.groupBy(*keys).agg(F.regr_slope(value, "__l").alias("phi"), F.regr_intercept(value, "__l").alias("intercept"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("half_life", S.half_life(F.col("phi")))


# Response surface of the unit-root test with a constant (published by MacKinnon, 1994 and 2010).
ADF_RANGE = (-18.83, 2.74, -1.61)
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def adf_p(t: float) -> float:
    """Approximate p-value of a unit-root statistic."""
    low, high, turn = ADF_RANGE
    if t > high:
        return 1.0
    if t < low:
        return 0.0
    z = sum(c * t**k for k, c in enumerate(ADF_SMALL if t <= turn else ADF_LARGE))
    return 0.5 * math.erfc(-z / math.sqrt(2))


@F.pandas_udf(DoubleType())
def unit_root_p(stat: pd.Series) -> pd.Series:
    """`adf_p` of a column; null stays null."""
    return stat.map(adf_p, na_action="ignore").astype(float)


def unit_root(df: DataFrame, value: str, keys: Sequence[str], order: str) -> DataFrame:
    """adf_stat, adf_p_value, lags, n of each series."""
    out = unit_root_statistic(df, value, keys, order)
    return out.select(*keys, "adf_stat", unit_root_p("adf_stat").alias("adf_p_value"), "lags", "n")


def simulated_paths(spark: SparkSession, returns: np.ndarray, simulations: int, horizon: int, seed: int, block: int = 4, phi: float | None = None, intercept: float = 0.0, sigma: float = 0.0, start: float = 0.0) -> DataFrame:
    """path, total: moving-block bootstrap of returns, or AR(1) levels if phi is given. Chunks of a thousand paths have seeds of their own, so results don't depend on the number of tasks."""

    def run(it):
        for pdf in it:
            for chunk in pdf["id"]:
                rng = np.random.default_rng([seed, int(chunk)])
                n = min(1000, simulations - 1000 * int(chunk))
                if phi is None:
                    starts = rng.integers(0, max(len(returns) - block + 1, 1), (n, -(-horizon // block)))
                    total = returns[(starts[:, :, None] + np.arange(block)).reshape(n, -1)[:, :horizon]].sum(axis=1)
                else:
                    level = np.full(n, start)
                    for _ in range(horizon):
                        level = intercept + phi * level + rng.normal(0, sigma, n)
                    total = level - start
                yield pd.DataFrame({"path": 1000 * int(chunk) + np.arange(n), "total": total})

    chunks = -(-simulations // 1000)
    return spark.range(0, chunks, 1, min(chunks, 64)).mapInPandas(run, "path long, total double")


def scenario_grid(spark: SparkSession, paths: DataFrame, material: float, betas: Sequence[float], passed: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """beta, pass_through, quantile, profit_change and the endpoint shock that gives it, for each of `keys`: quantiles of the profit change, not of the shock. The grid is a short list of literals.

    The profit change is linear in the shock, so its quantile is that of the shock, from the
    other end where the slope is negative.
    """
    cuts = (0.05, 0.5, 0.95)
    q = exact_quantiles(paths.withColumn("__shock", F.exp("total") - 1), "__shock", cuts, keys).withColumnRenamed("q", "__q")
    out = q.withColumn("beta", F.explode(F.array(*map(F.lit, betas)))).withColumn("pass_through", F.explode(F.array(*map(F.lit, passed))))
    out = out.withColumn("__k", F.explode(F.array(*map(F.lit, range(len(cuts))))))
    slope = S.shock_to_profit(F.lit(material), F.col("beta"), F.lit(1.0), F.col("pass_through"))
    shock = F.element_at("__q", F.when(slope < 0, len(cuts) - F.col("__k")).otherwise(F.col("__k") + 1))
    out = out.withColumns({"quantile": F.element_at(F.array(*map(F.lit, cuts)), F.col("__k") + 1), "shock": shock}).drop("__q", "__k")
    return out.withColumn("profit_change", S.shock_to_profit(F.lit(material), F.col("beta"), F.col("shock"), F.col("pass_through")))


def chosen_model(adf_p_value: float, ar_rmse: float, walk_rmse: float, phi: float) -> str:
    """`ar1` only if the series looks stationary, beats a random walk and reverts."""
    return "ar1" if adf_p_value < 0.10 and ar_rmse < walk_rmse and 0 < phi < 1 else "block_bootstrap"
