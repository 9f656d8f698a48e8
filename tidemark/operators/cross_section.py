"""Statistics across the rows of one date. All are windows by date, or two aggregates joined back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

MAD_SCALE = 1.4826


def _per(keys: Sequence[str]) -> Window:
    return Window.partitionBy(*keys)


def standard(value: Column, w: Window) -> Column:
    """Population z-score; zero where nothing varies."""
    sd = F.stddev_pop(value).over(w)
    return F.when(value.isNotNull(), F.when(sd > 0, (value - F.avg(value).over(w)) / sd).otherwise(0.0))


def robust_z(df: DataFrame, value: str, keys: Sequence[str], name: str, reach: float = 5.0) -> DataFrame:
    """Values clipped at `reach` robust deviations from the median, then standardised. A spread of zero falls back to the plain deviation, and then to zeros."""
    w = _per(keys)
    out = df.withColumn("__med", F.median(value).over(w))
    out = out.withColumn("__mad", F.median(F.abs(F.col(value) - F.col("__med"))).over(w) * MAD_SCALE)
    out = out.withColumn("__scale", F.when(F.col("__mad") > 0, F.col("__mad")).otherwise(F.stddev_pop(value).over(w)))
    inside = S.clip(F.col(value), F.col("__med") - reach * F.col("__scale"), F.col("__med") + reach * F.col("__scale"))
    out = out.withColumn("__c", F.when(F.col("__scale") > 0, inside).otherwise(F.col(value) * 0.0))
    return out.withColumn(name, standard(F.col("__c"), w)).drop("__med", "__mad", "__scale", "__c")


def neutralised(df: DataFrame, value: str, adv: str, keys: Sequence[str], name: str, group: str | None = None, reach: float = 5.0, least: int = 10) -> DataFrame:
    """Residual of the robust score on log trading value and group dummies, standardised.

    By the theorem of Frisch, Waugh and Lovell the residual follows from one slope
    between deviations from group means, so no solver is needed.
    """
    out = robust_z(df, value, keys, "__z", reach)
    valid = F.col("__z").isNotNull() & (F.col(adv) > 0) & (F.col(group).isNotNull() if group else F.lit(True))
    out = out.withColumns({"__ok": F.coalesce(valid, F.lit(False))})
    out = out.withColumns({"__x": F.when(F.col("__ok"), F.ln(adv)), "__y": F.when(F.col("__ok"), F.col("__z"))})
    cell = _per([*keys, group] if group else keys)
    out = out.withColumns({"__dx": F.col("__x") - F.avg("__x").over(cell), "__dy": F.col("__y") - F.avg("__y").over(cell)})
    w = _per(keys)
    groups = F.size(F.collect_set(F.when(F.col("__ok"), F.col(group))).over(w)) if group else F.lit(1)
    out = out.withColumns({"__n": F.count_if("__ok").over(w), "__xx": F.sum(F.col("__dx") * F.col("__dx")).over(w), "__xy": F.sum(F.col("__dx") * F.col("__dy")).over(w), "__g": groups})
    sloped = F.col("__xx") > 1e-12
    out = out.withColumn("__r", F.col("__dy") - F.when(sloped, F.col("__xy") / F.col("__xx")).otherwise(0.0) * F.col("__dx"))
    enough = (F.col("__n") >= least) & (F.col("__n") > F.col("__g") + sloped.cast("int"))
    sd = F.stddev_pop("__r").over(w)
    out = out.withColumn(name, F.when(enough & F.col("__ok"), F.when(sd > 1e-12, (F.col("__r") - F.avg("__r").over(w)) / sd).otherwise(0.0)))
    return out.drop("__z", "__ok", "__x", "__y", "__dx", "__dy", "__n", "__xx", "__xy", "__g", "__r")


def quantile_z(df: DataFrame, value: str, keys: Sequence[str], name: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Values clipped to their exact quantiles, then population z-scores; null with fewer than three values."""
    w = _per(keys)
    out = df.withColumn("__q", F.percentile(value, F.array(F.lit(low), F.lit(high))).over(w))
    out = out.withColumn("__c", S.clip(F.col(value), F.col("__q")[0], F.col("__q")[1]))
    return out.withColumn(name, F.when(F.count(value).over(w) >= 3, standard(F.col("__c"), w))).drop("__q", "__c")


def coverage(df: DataFrame, value: str, keys: Sequence[str]) -> Column:
    """Share of the date's rows that have the value."""
    w = _per(keys)
    return F.count(value).over(w) / F.count(F.lit(1)).over(w)


def composite(df: DataFrame, families: Mapping[str, Sequence[str]], weights: Mapping[str, float], least_coverage: float, least_families: int, inverted: Sequence[str] = ("low_risk",)) -> DataFrame:
    """<family>_score and <family>_coverage, available_signal_families and composite_score.

    A family's score is the mean of its values that exist, if they cover enough;
    inverted families change sign. Weights are renewed over the families that exist.
    """
    missing = set(families) - set(weights)
    if missing or any(w < 0 for w in weights.values()) or sum(weights.values()) <= 0:
        raise ValueError("family weights must cover all families, not be negative, and have a positive sum")
    scores, shares = {}, {}
    for family, names in families.items():
        cols = [F.col(n) for n in names]
        share = S.coverage(*cols)
        mean = S.row_mean(*cols) * (-1.0 if family in inverted else 1.0)
        shares[f"{family}_coverage"] = share
        scores[f"{family}_score"] = F.when(share >= least_coverage, mean)
    out = df.withColumns({**shares, **scores})
    total = sum((F.coalesce(F.col(f"{f}_score") * weights[f], F.lit(0.0)) for f in families), F.lit(0.0))
    held = sum((F.when(F.col(f"{f}_score").isNotNull(), F.lit(weights[f])).otherwise(0.0) for f in families), F.lit(0.0))
    out = out.withColumn("available_signal_families", S.filled(*(F.col(f"{f}_score") for f in families)))
    return out.withColumn("composite_score", F.when(F.col("available_signal_families") >= least_families, total / F.nullif(held, F.lit(0.0))))


def bucket(rank: Column, n: Column, q: Column) -> Column:
    """Equal-count bucket (1 to q) of a rank (1 to n), by whole numbers: a plain ntile differs at edges.

    A rank on an edge belongs to the bucket below it; of three buckets, to that above, as the
    reference values have it, whose thirds are a little too small. A single row is in bucket 1.
    """
    steps = F.greatest(n - 1, F.lit(1))
    below = F.greatest(F.lit(1), (((rank - 1) * q + steps - 1) / steps).cast("int"))
    three = F.least(F.lit(3), ((rank - 1) * 3 / steps).cast("int") + 1)
    return F.when(q == 3, three).otherwise(below)
