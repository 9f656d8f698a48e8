"""Shrunk covariance, active risk and the group-neutral projection of score tilts."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .asof import last_known


def recent_returns(market: DataFrame, months: DataFrame, lookback: int) -> DataFrame:
    """signal_date, symbol, date, r: simple returns of each month's symbols (months: signal_date, symbol) over the last `lookback` return days up to it, on the union of their dates.

    A date among the last of the union is among the last of each symbol that has it,
    so only that many bars of a symbol are looked up, by their numbers.
    """
    own = market.join(months.select("symbol").distinct(), "symbol", "left_semi").select("symbol", "date", "close_adj")
    bars = own.withColumn("__k", F.row_number().over(Window.partitionBy("symbol").orderBy("date")))
    last = last_known(months, bars.select("symbol", "date", "__k")).join(months, ["signal_date", "symbol"], "left_semi")
    each = last.select("signal_date", "symbol", F.explode(F.sequence(F.greatest(F.col("__k") - lookback, F.lit(1)), F.col("__k"))).alias("__k"))
    near = each.join(bars, ["symbol", "__k"]).select("signal_date", "symbol", "date", "close_adj")
    dates = near.select("signal_date", "date").distinct()
    kept = dates.withColumn("__n", F.row_number().over(Window.partitionBy("signal_date").orderBy(F.desc("date")))).where(F.col("__n") <= lookback + 1).drop("__n")
    grid = months.select("signal_date", "symbol").join(kept, "signal_date").join(near, ["signal_date", "symbol", "date"], "left")
    before = F.lag("close_adj").over(Window.partitionBy("signal_date", "symbol").orderBy("date"))
    return grid.withColumn("r", F.when(before > 0, F.col("close_adj") / before - 1)).select("signal_date", "symbol", "date", "r")


#: Symbols of a tile.
TILE = 256


def gram(table: pa.Table) -> pa.Table:
    """sym_i, sym_j (in order of name), c: the pairwise-complete covariances between the symbols of two tiles (own: which one) of a month, and n, the dates that they share.

    With returns X, centred and zero where missing, and M marking those that are there, X'X,
    X'M, M'X and M'M hold all sums that a covariance over shared dates needs.
    """
    table = table.sort_by("symbol").combine_chunks()
    days, values = (table[c].combine_chunks() for c in ("days", "values"))
    size = np.diff(days.offsets.to_numpy())
    row, day = np.repeat(np.arange(len(size)), size), days.flatten().to_numpy(zero_copy_only=False)
    every, column = np.unique(day, return_inverse=True)
    x, m = np.zeros((len(size), len(every))), np.zeros((len(size), len(every)))
    x[row, column], m[row, column] = values.flatten().to_numpy(zero_copy_only=False), 1.0
    x -= m * (x.sum(1) / np.maximum(m.sum(1), 1))[:, None]
    own, first, second = (table[c].to_numpy() for c in ("own", "first", "second"))
    a, b = np.flatnonzero(own == first), np.flatnonzero(own == second)
    n = m[a] @ m[b].T
    with np.errstate(divide="ignore", invalid="ignore"):
        c = (x[a] @ x[b].T - (x[a] @ m[b].T) * (m[a] @ x[b].T) / n) / (n - 1)
    i, j = np.triu_indices(len(a)) if first[0] == second[0] else np.indices(c.shape).reshape(2, -1)
    c, n, i, j = c[i, j], n[i, j].astype(np.int64), a[i], b[j]
    names = table["symbol"].combine_chunks()
    return pa.table({"signal_date": pa.array([table["signal_date"][0].as_py()] * len(c), pa.date32()), "sym_i": names.take(pa.array(np.minimum(i, j))), "sym_j": names.take(pa.array(np.maximum(i, j))), "c": pa.array(c, pa.float64(), mask=~np.isfinite(c)), "n": n})


def covariance(returns: DataFrame, lookback: int, shrinkage: float, yearly: int, tile: int = TILE) -> DataFrame:
    """signal_date, sym_i, sym_j, cov for i <= j: pairwise-complete sample covariance, diagonal shrinkage, annualised.

    Pairs with too little overlap count as zero; a missing own variance becomes the
    month's median variance, and none falls below 1e-8. A month's symbols are dealt to tiles of
    about `tile`; a task multiplies two tiles' returns. A symbol's returns travel once for each
    tile of its month, as one row, so what is shuffled doesn't grow with names squared times dates.
    """
    least = max(20, lookback // 2)
    there = F.when(F.col("r").isNotNull(), F.struct(F.unix_date("date").alias("day"), "r"))
    series = returns.groupBy("signal_date", "symbol").agg(F.collect_list(there).alias("x"))
    tiles = series.groupBy("signal_date").agg(F.ceil(F.count(F.lit(1)) / tile).alias("tiles"))
    each = series.join(tiles, "signal_date").withColumn("own", F.pmod(F.xxhash64("symbol"), F.col("tiles")))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    each = each.select("signal_date", "symbol", F.col("x.day").alias("days"), F.col("x.r").alias("values"), "own", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"))
    found = each.groupBy("signal_date", "first", "second").applyInArrow(gram, "signal_date date, sym_i string, sym_j string, c double, n long")
    full = found.withColumn("c", F.when(F.col("n") >= least, F.col("c")))
    middle = full.where("sym_i = sym_j").groupBy("signal_date").agg(F.median("c").alias("__m"))
    full = full.join(middle, "signal_date", "left")
    own = F.greatest(F.coalesce("c", "__m", F.lit(1e-8)), F.lit(1e-8))
    value = F.when(F.col("sym_i") == F.col("sym_j"), own).otherwise((1 - shrinkage) * F.coalesce("c", F.lit(0.0)))
    return full.select("signal_date", "sym_i", "sym_j", (value * yearly).alias("cov"))


def normalised(df: DataFrame, weight: str, keys: list[str], name: str) -> DataFrame:
    """Weights below zero count as zero and sum to one for each key; all-zero weights become equal ones."""
    w = Window.partitionBy(*keys)
    pos = F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0))
    total = F.sum(pos).over(w)
    return df.withColumn(name, F.when(total > 0, pos / total).otherwise(1 / F.count(F.lit(1)).over(w)))


def score_tilt(df: DataFrame, keys: list[str], kappa: float, weight: str = "benchmark", score: str = "composite_score", group: str = "industry_group") -> DataFrame:
    """raw_weight: weight times exp(kappa * score), the score clipped at 4, renewed so that each group keeps its share."""
    s = F.least(F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(-4.0)), F.lit(4.0))
    out = df.withColumns({"__g": F.coalesce(group, F.lit("unknown")), "__t": F.col(weight) * F.exp(kappa * s)})
    cell = Window.partitionBy(*keys, "__g")
    out = out.withColumn("raw_weight", F.when(F.sum("__t").over(cell) > 0, F.col("__t") * F.sum(weight).over(cell) / F.sum("__t").over(cell)).otherwise(F.col("__t")))
    return normalised(out, "raw_weight", keys, "raw_weight").drop("__g", "__t")


def box_projection(raw: np.ndarray, low: np.ndarray, high: np.ndarray, total: float) -> np.ndarray | None:
    """Closest point to raw with low <= w <= high and sum `total`: raw less one shift, clipped. The sum is piecewise linear in the shift, so the shift is exact. None if infeasible."""
    if total < low.sum() - 1e-9 or total > high.sum() + 1e-9:
        return None
    knots = np.unique(np.concatenate([raw - high, raw - low]))
    sums = np.clip(raw[None, :] - knots[:, None], low, high).sum(axis=1)  # falls as the shift grows
    k = int(np.searchsorted(-sums, -total))
    if k == 0:
        return np.clip(raw - knots[0], low, high)
    if k == len(knots):
        return np.clip(raw - knots[-1], low, high)
    a, z = sums[k - 1], sums[k]
    share = 0.0 if a == z else (a - total) / (a - z)
    return np.clip(raw - (knots[k - 1] + share * (knots[k] - knots[k - 1])), low, high)


def projected(df: DataFrame, keys: list[str], max_weight: float, max_active: float, weight: str = "benchmark", group: str = "industry_group") -> DataFrame:
    """target: the closest portfolio to raw_weight in which every group keeps its weight and every name its bounds; the plain weights where that is impossible. Dates are independent tasks."""
    schema = StructType([*df.schema.fields, StructField("target", DoubleType())])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        b, raw = pdf[weight].to_numpy(float), pdf["raw_weight"].to_numpy(float)
        high = np.minimum(max_weight, b + max_active)
        if high.sum() < 1 - 1e-8:
            high = np.maximum(high, b)
        low = np.maximum(0.0, b - max_active)
        out = b.copy()
        for g in pdf[group].fillna("unknown").unique():
            m = (pdf[group].fillna("unknown") == g).to_numpy()
            w = box_projection(raw[m], low[m], high[m], float(b[m].sum()))
            if w is None:
                return pdf.assign(target=b)
            out[m] = w
        return pdf.assign(target=out)

    return df.groupBy(*keys).applyInPandas(one, schema)


def active_risk(weights: DataFrame, cov: DataFrame, target: str = "target", weight: str = "benchmark", beta: str = "market_beta_126d") -> DataFrame:
    """signal_date, tracking_error, active_beta of target less weight. A missing beta counts as one."""
    act = weights.select("signal_date", "symbol", (F.col(target) - F.col(weight)).alias("a"), F.coalesce(beta, F.lit(1.0)).alias("b"))
    i, j = act.select("signal_date", F.col("symbol").alias("sym_i"), F.col("a").alias("ai")), act.select("signal_date", F.col("symbol").alias("sym_j"), F.col("a").alias("aj"))
    twice = F.when(F.col("sym_i") == F.col("sym_j"), 1.0).otherwise(2.0)
    var = cov.join(i, ["signal_date", "sym_i"]).join(j, ["signal_date", "sym_j"]).groupBy("signal_date").agg(F.sum(twice * F.col("ai") * F.col("aj") * F.col("cov")).alias("v"))
    bet = act.groupBy("signal_date").agg(F.sum(F.col("a") * F.col("b")).alias("active_beta"))
    return bet.join(var, "signal_date", "left").select("signal_date", F.sqrt(F.greatest(F.coalesce("v", F.lit(0.0)), F.lit(0.0))).alias("tracking_error"), "active_beta")


def factor_risk(weights: DataFrame, factors: Mapping[str, float], own: str, target: str = "target", weight: str = "benchmark", beta: str = "market_beta_126d") -> DataFrame:
    """`active_risk` where the covariance has the form of a factor model: uncorrelated factors (column of loadings -> variance) and a column of own variances.

    Then a'Ca is the sum of variance times squared active loading over the factors, and of own
    variance times squared active weight over the names: sums over names, no pairs of them.
    """
    act = weights.withColumns({"__a": F.col(target) - F.col(weight), "__b": F.coalesce(beta, F.lit(1.0))})
    parts = [F.pow(F.sum(F.col("__a") * F.col(c)), F.lit(2.0)) * v for c, v in factors.items()]
    var = sum((F.coalesce(x, F.lit(0.0)) for x in (*parts, F.sum(F.col(own) * F.col("__a") * F.col("__a")))), F.lit(0.0))
    out = act.groupBy("signal_date").agg(var.alias("__v"), F.sum(F.col("__a") * F.col("__b")).alias("active_beta"))
    return out.select("signal_date", F.sqrt(F.greatest("__v", F.lit(0.0))).alias("tracking_error"), "active_beta")


def scaled(weights: DataFrame, risk: DataFrame, te_cap: float, beta_cap: float, target: str = "target", weight: str = "benchmark") -> DataFrame:
    """target pulled toward weight by one factor a date, so that tracking error and active beta keep their caps; with the risk after scaling."""
    one = F.lit(1.0)
    by_te = F.when((F.col("tracking_error") > te_cap) & (F.lit(te_cap) > 0), te_cap / F.col("tracking_error")).otherwise(one)
    by_beta = F.when((F.abs("active_beta") > beta_cap) & (F.lit(beta_cap) > 0), beta_cap / F.abs("active_beta")).otherwise(one)
    factor = risk.withColumn("__k", F.least(one, by_te, by_beta))
    out = weights.join(factor, "signal_date").withColumn(target, F.col(weight) + F.col("__k") * (F.col(target) - F.col(weight)))
    return out.withColumns({"target_ex_ante_tracking_error": F.col("tracking_error") * F.col("__k"), "target_active_market_beta": F.col("active_beta") * F.col("__k")}).drop("__k", "tracking_error", "active_beta")
