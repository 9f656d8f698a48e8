"""Point-in-time joins.

What is known changes on a few days: a version holds from the day on which it becomes
visible until the next one does. Such intervals are turned into the months that they
touch, and join the calendar by month, an equality; no table is compared with all
dates. `calendar` has one row a month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import require_unique


def _month(day: str | Column) -> Column:
    return F.trunc(day, "MM")


def at_signals(calendar: DataFrame, held: DataFrame, start: str = "__from", until: str = "__until") -> DataFrame:
    """Rows of `held` for each signal date in [start, until); a null `until` means for ever."""
    days = calendar.select("signal_date").distinct()
    last = days.agg(F.date_add(F.max("signal_date"), 1).alias("__last"))  # one row
    ends = held.join(F.broadcast(last)).withColumn(until, F.coalesce(until, F.greatest("__last", F.date_add(start, 1)))).where(F.col(start) < F.col(until))
    months = F.sequence(_month(start), _month(F.date_sub(until, 1)), F.expr("interval 1 month"))
    each = ends.withColumn("__month", F.explode(months))
    joined = each.join(days.withColumn("__month", _month("signal_date")), "__month")
    return joined.where((F.col(start) <= F.col("signal_date")) & (F.col("signal_date") < F.col(until))).drop("__month", "__last", start, until)


def membership_asof(calendar: DataFrame, members: DataFrame) -> DataFrame:
    """Members of the version known at each signal date: of those with available_date and snapshot_date up to it, the largest (snapshot_date, available_date). An older snapshot published later never wins."""
    versions = members.select("snapshot_date", "available_date").distinct().withColumn("__from", F.greatest("snapshot_date", "available_date"))
    order = Window.partitionBy(F.lit(0)).orderBy("__from")  # a few versions a year
    best = versions.withColumns({"__v": F.max(F.struct("snapshot_date", "available_date")).over(order.rangeBetween(Window.unboundedPreceding, 0)), "__until": F.lead("__from").over(order)})
    known = at_signals(calendar, best.select("__from", "__until", "__v")).select("signal_date", F.col("__v.snapshot_date").alias("snapshot_date"), F.col("__v.available_date").alias("available_date"))
    return members.join(calendar.join(known, "signal_date"), ["snapshot_date", "available_date"])


def with_effective_date(filings: DataFrame) -> DataFrame:
    """effective_date: the later of notice and availability."""
    return filings.withColumn("effective_date", F.greatest("notice_date", "available_date") if "available_date" in filings.columns else F.col("notice_date"))


def fundamentals_asof(calendar: DataFrame, filings: DataFrame, values: list[str]) -> DataFrame:
    """signal_date, symbol, current, prior (structs of `values` and dates), report_count.

    Of each report the last version that is effective at the signal date counts;
    the current report is the latest, the prior one exactly a year older.
    """
    fields = F.struct("report_date", "notice_date", "effective_date", *values)
    versions = filings.select("symbol", "report_date", "effective_date", F.greatest("report_date", "effective_date").alias("__from"), fields.alias("__v")).where("__from is not null")
    # the version of a report: until its next one
    report = Window.partitionBy("symbol", "report_date").orderBy("__from", "effective_date")
    versions = versions.withColumns({"__first": F.row_number().over(report) == 1, "__later": F.lead("__from").over(report)})
    # the latest report of a symbol: until anything new of it is visible
    symbol = Window.partitionBy("symbol").orderBy("__from")
    so_far = symbol.rangeBetween(Window.unboundedPreceding, 0)
    state = versions.select(
        "symbol",
        "__from",
        F.lead("__from").over(symbol).alias("__until"),
        F.max_by("__v", F.struct("report_date", "effective_date")).over(so_far).alias("current"),
        F.sum(F.col("__first").cast("long")).over(so_far).alias("report_count"),
    )
    current = at_signals(calendar, state).withColumn("__before", F.add_months(F.col("current.report_date"), -12))
    prior = versions.select(F.col("symbol").alias("__s"), F.col("report_date").alias("__r"), F.col("__from").alias("__a"), F.col("__later").alias("__z"), F.col("__v").alias("prior"))
    match = (F.col("symbol") == F.col("__s")) & (F.col("__before") == F.col("__r")) & (F.col("__a") <= F.col("signal_date")) & (F.col("__z").isNull() | (F.col("signal_date") < F.col("__z")))
    return current.join(prior, match, "left").select("signal_date", "symbol", "current", "report_count", "prior")


def last_known(calendar: DataFrame, bars: DataFrame) -> DataFrame:
    """Each symbol's last bar up to each signal date: a bar holds from its date until the next one."""
    until = bars.withColumns({"__from": F.col("date"), "__until": F.lead("date").over(Window.partitionBy("symbol").orderBy("date"))})
    return at_signals(calendar, until)


def reindexed(keys: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    """The rows in the frame of `keys`: a key without a row has nulls, a row without a key goes."""
    return keys.join(rows, on, "left")


def one_to_one(left: DataFrame, right: DataFrame, on: list[str], label: str) -> DataFrame:
    """Left join of frames whose keys are both unique; raises where one repeats a key."""
    return require_unique(left, on, f"{label}, left").join(require_unique(right, on, f"{label}, right"), on, "left")


def close_on(rows: DataFrame, market: DataFrame, day: str, name: str) -> DataFrame:
    """The close on exactly that day; null if there is no bar (never filled forward)."""
    point = market.select(F.col("date").alias(day), "symbol", F.col("close_adj").alias(name))
    return rows.join(point, [day, "symbol"], "left")


def nearest(points: DataFrame, probes: DataFrame, values: list[str], day: str, name: str, on: tuple[str, ...] = ("symbol",), forward: bool = False) -> DataFrame:
    """The probes with `name`, a struct of the values of the last point (date) up to their `day`, or `forward` of the first from it on, with the same `on`; null without one.

    A sort-merge join: both sides together are sorted by key and day, and filled over
    a window, however long the gap; rows are neither compared in pairs nor dealt to months.
    """
    p = points.select(*on, F.col("date").cast("date").alias("__t"), F.lit(0).alias("__side"), F.struct(*values).alias("__p"))
    q = probes.select(*on, F.col(day).cast("date").alias("__t"), F.lit(1).alias("__side"), F.struct(*probes.columns).alias("__q"))
    order = F.desc("__t") if forward else F.asc("__t")
    w = Window.partitionBy(*on).orderBy(order, "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = F.when(F.col("__t").isNotNull(), F.last("__p", ignorenulls=True).over(w))
    return p.unionByName(q, allowMissingColumns=True).withColumn(name, found).where("__side = 1").select("__q.*", name)


def forward_return(prices: DataFrame, spans: DataFrame) -> DataFrame:
    """spans (symbol, start, end) with first_close (the first price at or after start), last_close (the last at or before end) and span_return; a single bar gives zero."""
    priced = prices.where("close_adj is not null")
    begun = nearest(priced, spans, ["close_adj"], "start", "__a", forward=True)
    out = nearest(priced, begun, ["close_adj"], "end", "__z")
    out = out.withColumns({"first_close": F.col("__a.close_adj"), "last_close": F.col("__z.close_adj")}).drop("__a", "__z")
    return out.withColumn("span_return", F.col("last_close") / F.nullif(F.col("first_close"), F.lit(0.0)) - 1)
