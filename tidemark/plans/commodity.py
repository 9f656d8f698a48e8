"""The study of price series: unit root, AR(1) against a random walk, the simulation that the fit chooses, and scenarios.

All series are studied in one plan. Fits are aggregates; a simulation's tasks each hold one
series' weekly returns and a thousand paths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import weekly

#: Paths of one task; weeks of a block that the bootstrap draws.
CHUNK, BLOCK = 1000, 4
#: Share of a series that fits the model to be tried on the rest, and its points at least.
TRAIN, LEAST_TRAIN = 0.8, 20
AR1, BOOTSTRAP = "ar1", "block_bootstrap"


def points(series: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """keys, order, y (log value), x (that before it, over gaps), k (1 to n) and n; null values are left out."""
    w = Window.partitionBy(*keys).orderBy(order)
    seen = series.where(F.col(value).isNotNull()).select(*keys, order, F.ln(value).alias("y"))
    return seen.withColumns({"x": F.lag("y").over(w), "k": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy(*keys))})


def ar1_against_walk(series: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """n, phi, intercept, sigma (of all points), half_life, last_level; ar_rmse and walk_rmse of one-step forecasts of the last points by a fit on those before them."""
    rows = points(series, keys, value, order)
    cut = F.greatest(F.lit(LEAST_TRAIN), F.floor(F.col("n") * TRAIN))
    train = F.col("k") <= cut
    early = [F.when(train, F.col(c)) for c in ("y", "x")]
    left = F.regr_syy("y", "x") - F.regr_sxy("y", "x") * F.regr_sxy("y", "x") / F.nullif(F.regr_sxx("y", "x"), F.lit(0.0))
    fit = rows.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.regr_slope("y", "x").alias("phi"),
        F.regr_intercept("y", "x").alias("intercept"),
        F.sqrt(F.greatest(left, F.lit(0.0)) / F.nullif(F.regr_count("y", "x") - 1, F.lit(0))).alias("sigma"),
        F.max_by("y", "k").alias("last_level"),
        F.regr_slope(*early).alias("train_phi"),
        F.regr_intercept(*early).alias("train_intercept"),
    )
    error = F.col("y") - (F.col("train_intercept") + F.col("train_phi") * F.col("x"))
    step = F.col("y") - F.col("x")
    tried = rows.where(~train).join(fit, list(keys)).groupBy(*keys).agg(F.sqrt(F.avg(error * error)).alias("ar_rmse"), F.sqrt(F.avg(step * step)).alias("walk_rmse"))
    return fit.drop("train_phi", "train_intercept").withColumn("half_life", S.half_life(F.col("phi"))).join(tried, list(keys), "left")


def method(p_value: Column, ar_rmse: Column, walk_rmse: Column, phi: Column) -> Column:
    """The simulation: AR(1) if the series looks stationary, the fit beats a walk and reverts; else, or where any of it is unknown, blocks of returns."""
    return F.when((p_value < 0.10) & (ar_rmse < walk_rmse) & (phi > 0) & (phi < 1), F.lit(AR1)).otherwise(F.lit(BOOTSTRAP))


def fits(series: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """`ar1_against_walk` with the unit-root test of log values (adf_stat, adf_p_value, lags) and the method that follows."""
    tested = weekly.unit_root(points(series, keys, value, order), "y", keys, order).drop("n")
    out = ar1_against_walk(series, keys, value, order).join(tested, list(keys))
    return out.withColumn("method", method(*(F.col(c) for c in ("adf_p_value", "ar_rmse", "walk_rmse", "phi"))))


def endpoints(method: str, returns: np.ndarray, phi: float, intercept: float, sigma: float, start: float, n: int, horizon: int, rng: np.random.Generator) -> np.ndarray:
    """Summed log returns at the horizon of n paths."""
    if method == AR1:
        level = np.full(n, start)
        for _ in range(horizon):
            level = intercept + phi * level + rng.normal(0, sigma, n)
        return level - start
    block = min(BLOCK, len(returns))
    starts = rng.integers(0, len(returns) - block + 1, (n, -(-horizon // block)))
    return returns[(starts[:, :, None] + np.arange(block)).reshape(n, -1)[:, :horizon]].sum(axis=1)


def simulated(series: DataFrame, fitted: DataFrame, keys: Sequence[str], value: str, order: str, simulations: int, horizon: int, seed: int) -> DataFrame:
    """keys, method, path, total: the log return at the horizon of each path of each series, by the method of its fit.

    A task draws one chunk of one series, from a seed made of `seed`, the keys and the chunk, so
    results depend neither on tasks nor on the other series. Series of one point have no paths.
    """
    rows = points(series, keys, value, order).where("x is not null")
    returns = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", (F.col("y") - F.col("x")).alias("r")))).alias("z")).select(*keys, F.col("z.r").alias("returns"))
    tasks = fitted.join(returns, list(keys)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(-(-simulations // CHUNK) - 1))))
    tasks = tasks.select(*keys, "method", "phi", "intercept", "sigma", "last_level", "returns", "chunk").repartition(*keys, "chunk")
    schema = ", ".join(f"{k} {series.schema[k].dataType.simpleString()}" for k in keys) + ", method string, path long, total double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.to_dict("records"):
                n = min(CHUNK, simulations - CHUNK * t["chunk"])
                rng = np.random.default_rng([seed, zlib.crc32("\0".join(str(t[k]) for k in keys).encode()), t["chunk"]])
                total = endpoints(t["method"], np.asarray(t["returns"]), t["phi"], t["intercept"], t["sigma"], t["last_level"], n, horizon, rng)
                yield pd.DataFrame({**{k: [t[k]] * n for k in keys}, "method": t["method"], "path": CHUNK * t["chunk"] + np.arange(n), "total": total})

    return tasks.mapInPandas(run, schema)
