"""Least squares of several factors as aggregates and column expressions: Newey-West errors, attribution, unit roots.

Sums of outer products are aggregated across the cluster; small systems are solved inside
expressions, by elimination over an array of arrays, so any number of factors, models and
series goes through one plan and no Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import normal_p

#: Lagged differences that a unit-root test looks at, at most; series of a million points ask for no more.
MOST_LAGS = 120


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def times(m: Column, v: Column) -> Column:
    """Matrix times vector; with a symmetric matrix for v's place, use `product`."""
    return F.transform(m, lambda row: dot(row, v))


def product(a: Column, b: Column) -> Column:
    """Matrix times a symmetric matrix."""
    return F.transform(a, lambda row: F.transform(b, lambda other: dot(row, other)))


def leading(m: Column, k: Column) -> Column:
    """The first k rows and columns."""
    return F.transform(F.slice(m, F.lit(1), k), lambda row: F.slice(row, F.lit(1), k))


def inverse(m: Column) -> Column:
    """Inverse of a symmetric positive matrix (array of rows); nulls where it is singular."""
    k = F.size(m)
    start = F.transform(m, lambda row, i: F.concat(row, F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.when(i == j, 1.0).otherwise(0.0))))

    def step(a: Column, p: Column) -> Column:
        pivot = F.transform(F.get(a, p), lambda x: x / F.nullif(F.get(F.get(a, p), p), F.lit(0.0)))
        return F.transform(a, lambda row, i: F.when(i == p, pivot).otherwise(F.zip_with(row, pivot, lambda x, y: x - F.get(row, p) * y)))

    solved = F.aggregate(F.sequence(F.lit(0), k - 1), start, step)
    return F.transform(solved, lambda row: F.slice(row, k + 1, k))


def outer_sums(rows: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """keys, n and m: the summed outer products of an array column, as an array of rows. Vectors of a key have one length."""
    each = rows.select(*keys, vector, F.posexplode(vector).alias("__i", "__x")).select(*keys, "__i", "__x", F.posexplode(vector).alias("__j", "__y"))
    cells = each.groupBy(*keys, "__i", "__j").agg(F.sum(F.col("__x") * F.col("__y")).alias("__s"), F.count(F.lit(1)).alias("n"))
    line = cells.groupBy(*keys, "__i").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("__j", "__s"))).alias("__r"))
    return line.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("__i", F.col("__r.__s").alias("s")))), lambda r: r["s"]).alias("m"))


def _own(keys: Sequence[str]) -> dict[str, str]:
    """Names for the caller's keys that no column made here has."""
    return {k: f"__key{i}" for i, k in enumerate(keys)}


def _named(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({own: k for k, own in _own(keys).items()})


def designed(df: DataFrame, models: dict[str, Sequence[str]], y: str, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """The keys under names of our own, __order, model, terms, y, z: a row of each model's design, with its intercept, where nothing of it is null."""
    own = [F.col(k).alias(name) for k, name in _own(keys).items()]
    each = [F.struct(F.lit(m).alias("model"), F.array(F.lit("const"), *map(F.lit, xs)).alias("terms"), F.array(F.lit(1.0), *(F.col(x).cast("double") for x in xs)).alias("z")) for m, xs in models.items()]
    rows = df.select(*own, F.col(order).alias("__order"), F.col(y).cast("double").alias("y"), F.explode(F.array(*each)).alias("d")).select(*_own(keys).values(), "__order", "y", "d.*")
    return rows.where(F.col("y").isNotNull() & ~F.exists("z", lambda x: x.isNull()))


def _scaled(weight: float) -> Callable[[Column], Column]:
    return lambda x: x * weight


def hac_models(df: DataFrame, models: dict[str, Sequence[str]], y: str, order: str, lags: int = 4, keys: Sequence[str] = (), p_values: bool = True) -> DataFrame:
    """For each of `keys` and models, a row for each term: coefficient, Newey-West error (Bartlett weights, no small-sample factor), t (p), n, r_squared, adj_r_squared, aic.

    The middle of the sandwich is a sum of outer products of the scores with themselves and
    with their weighted lags. A model with no more rows than terms has no fit.
    """
    own = [*_own(keys).values(), "model"]
    rows = designed(df, models, y, order, keys)
    sums = outer_sums(rows.withColumn("v", F.concat("z", F.array("y"))), [*own, "terms"], "v")
    spread = rows.groupBy(*own).agg((F.var_pop("y") * F.count(F.lit(1))).alias("sst"))
    k = F.size("terms")
    fit = sums.where(F.col("n") > k).withColumn("inv", inverse(leading(F.col("m"), k)))
    fit = fit.withColumn("b", times(F.col("inv"), F.slice(F.element_at("m", -1), F.lit(1), k))).drop("m").join(spread, own)
    left = rows.join(fit.select(*own, "b"), own).withColumn("e", F.col("y") - dot(F.col("z"), F.col("b")))
    scores = left.select(*own, "__order", "e", F.transform("z", lambda x: x * F.col("e")).alias("g"))
    w = Window.partitionBy(*own).orderBy("__order")
    scores = scores.withColumns({f"g{lag}": F.lag("g", lag).over(w) for lag in range(1, lags + 1)})
    none = F.transform("g", lambda x: F.lit(0.0))
    lagged = none
    for lag in range(1, lags + 1):
        share = F.transform(F.coalesce(F.col(f"g{lag}"), none), _scaled(1 - lag / (lags + 1)))
        lagged = F.zip_with(lagged, share, lambda a, b: a + b)
    # with g and its lags L in one vector, the blocks g'g, g'L and L'g hold the middle
    middle = outer_sums(scores.select(*own, F.concat("g", lagged).alias("v")), own, "v").drop("n")
    ssr = scores.groupBy(*own).agg(F.sum(F.col("e") * F.col("e")).alias("ssr"))
    out = fit.join(middle, own).join(ssr, own)
    top = leading(F.col("m"), k)
    cross = F.transform(F.slice("m", F.lit(1), k), lambda row: F.slice(row, k + 1, k))
    down = F.transform(F.slice("m", k + 1, k), lambda row: F.slice(row, F.lit(1), k))
    s = F.zip_with(top, F.zip_with(cross, down, lambda a, b: F.zip_with(a, b, lambda x, y: x + y)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    out = out.withColumn("s", s).withColumn("cov", product(product(F.col("inv"), F.col("s")), F.col("inv")))
    se = F.transform("cov", lambda row, i: F.sqrt(F.greatest(F.get(row, i), F.lit(0.0))))
    n = F.col("n")
    r2 = 1 - F.col("ssr") / F.nullif(F.col("sst"), F.lit(0.0))
    facts = out.select(*own, n, k.alias("k"), r2.alias("r_squared"), "ssr", F.explode(F.arrays_zip("terms", "b", se.alias("se"))).alias("t"))
    facts = facts.select(*own, F.col("t.terms").alias("term"), F.col("t.b").alias("coefficient"), F.col("t.se").alias("hac_se"), (F.col("t.b") / F.nullif(F.col("t.se"), F.lit(0.0))).alias("hac_t"), "n", "r_squared", (1 - (1 - F.col("r_squared")) * (n - 1) / (n - F.col("k"))).alias("adj_r_squared"), (n * math.log(2 * math.pi) + n * F.ln(F.greatest("ssr", F.lit(1e-300)) / n) + n + 2 * F.col("k")).alias("aic"))
    return _named(facts.withColumn("p_value", normal_p("hac_t")) if p_values else facts, keys)


def attribution(df: DataFrame, fitted: DataFrame, factors: Sequence[str], y: str, start: str, end: str, day: str) -> DataFrame:
    """model, component, contribution to the summed return of a window: each factor's, by its fitted coefficient, the intercept's, the rest, and the total.

    fitted: model, term, coefficient (of `hac_models`). Factors are unpivoted and met by their
    terms, so that fit and attribution are one plan. A window without rows has no components.
    """
    days = df.where(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    pairs = [F.struct(F.lit(c).alias("term"), F.col(c).alias("x")) for c in factors]
    pairs += [F.struct(F.lit("const").alias("term"), F.lit(1.0).alias("x")), F.struct(F.lit("total").alias("term"), F.col(y).alias("x"))]
    sums = days.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.term").agg(F.sum("p.x").alias("x"))
    terms = fitted.select("model", "term", "coefficient")
    terms = terms.unionByName(terms.select("model", F.lit("total").alias("term"), F.lit(1.0).alias("coefficient")).distinct())
    name = F.when(F.col("term") == "const", F.lit("intercept")).otherwise(F.col("term"))
    parts = terms.join(sums, "term").select("model", name.alias("component"), (F.col("coefficient") * F.col("x")).alias("contribution"))
    sign = F.when(F.col("component") == "total", 1.0).otherwise(-1.0)
    return parts.unionByName(parts.groupBy("model").agg(F.sum(sign * F.col("contribution")).alias("contribution")).withColumn("component", F.lit("residual")))


def unit_root_statistic(df: DataFrame, value: str, keys: Sequence[str], order: str) -> DataFrame:
    """keys, n, lags, adf_stat: the unit-root statistic with a constant, at the lag order with the best AIC over the rows that all orders have; null for series of 20 points or fewer.

    One matrix of sums holds the normal equations of every order, as leading blocks; the
    chosen order is fitted again on all rows it leaves.
    """
    own = list(_own(keys).values())
    w, whole = Window.partitionBy(*own).orderBy("__order"), Window.partitionBy(*own)
    seen = df.where(F.col(value).isNotNull()).select(*(F.col(k).alias(name) for k, name in _own(keys).items()), F.col(order).alias("__order"), F.col(value).cast("double").alias("y"))
    seen = seen.withColumns({"n": F.count(F.lit(1)).over(whole), "y": F.col("y") - F.avg("y").over(whole)})
    seen = seen.withColumns({"d": F.col("y") - F.lag("y").over(w), "before": F.lag("y").over(w)})
    past = F.reverse(F.collect_list("d").over(w.rowsBetween(-MOST_LAGS, -1)))
    bound = F.least(F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))), F.floor((F.col("n") - 1) / 2) - 2, F.lit(MOST_LAGS))
    rows = seen.withColumns({"past": past, "most": F.greatest(bound, F.lit(0)).cast("int")}).where("d is not null")
    sizes = seen.groupBy(*own).agg(F.max("n").alias("n"))
    rows = rows.where("n > 20")

    def vector(p: Column) -> Column:
        return F.concat(F.array(F.lit(1.0), F.col("before")), F.slice("past", F.lit(1), p), F.array("d"))

    def solved(sums: DataFrame, p: Column) -> DataFrame:
        k, right = p + 2, F.element_at("m", -1)
        out = sums.withColumn("inv", inverse(leading(F.col("m"), k))).withColumn("zt", F.slice(right, F.lit(1), k)).withColumn("b", times(F.col("inv"), F.col("zt")))
        return out.withColumn("ssr", F.greatest(F.element_at(right, -1) - dot(F.col("b"), F.col("zt")), F.lit(1e-300)))

    common = rows.where(F.size("past") >= F.col("most")).select(*own, "most", vector(F.col("most")).alias("v"))
    orders = outer_sums(common, [*own, "most"], "v").withColumnRenamed("n", "rows").withColumn("lags", F.explode(F.sequence(F.lit(0), F.col("most"))))
    tried = solved(orders, F.col("lags"))
    aic = F.col("rows") * F.ln(F.col("ssr") / F.col("rows")) + 2 * (F.col("lags") + 2)
    chosen = tried.groupBy(*own).agg(F.min_by("lags", F.struct(aic.alias("aic"), "lags")).alias("lags"))
    again = rows.join(chosen, own).where(F.size("past") >= F.col("lags")).select(*own, "lags", vector(F.col("lags")).alias("v"))
    last = solved(outer_sums(again, [*own, "lags"], "v").withColumnRenamed("n", "rows"), F.col("lags"))
    spare = F.col("ssr") / (F.col("rows") - F.col("lags") - 2) * F.get(F.get("inv", F.lit(1)), F.lit(1))
    stat = last.select(*own, F.col("lags").cast("long").alias("lags"), (F.get("b", F.lit(1)) / F.sqrt(F.greatest(spare, F.lit(1e-300)))).alias("adf_stat"))
    return _named(sizes.join(stat, own, "left"), keys)
