"""Buckets, ties, zero weights, single bars, member benchmarks, Gram covariances, the streamed ledger and the study of price series."""

import datetime as dt
import math
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import brute
from tidemark.operators import asof, cross_section, portfolio, risk, windows
from tidemark.plans import commodity, panel, regression, weekly

DAY = dt.date(2020, 1, 1)
RNG = np.random.default_rng(4)


def day(k):
    return DAY + dt.timedelta(days=int(k))


@pytest.mark.parametrize("q", [2, 4, 5, 7, 10])
def test_buckets_of_any_number(spark, q):
    rows = [(n, r) for n in (1, 2, 13, 27, 42) for r in range(1, n + 1)]
    got = spark.createDataFrame(rows, "n int, r int").withColumn("b", cross_section.bucket(F.col("r"), F.col("n"), F.lit(q))).collect()
    for n in (13, 27, 42):
        want = pd.qcut(np.arange(1, n + 1), q, labels=False) + 1
        edges = [(r - 1) * q % (n - 1) for r in range(1, n + 1)]
        assert [x.b for x, e in zip([x for x in got if x.n == n], edges, strict=True) if e] == [w for w, e in zip(want, edges, strict=True) if e]
    assert all(1 <= x.b <= q for x in got)


def test_of_equal_contributors_the_first_name_is_on_top(spark):
    rows = [("s", 1.0, day(0), s, "final_holdout", True, 0.1, r, "g") for s, r in (("z", 0.1), ("a", -0.1), ("m", 0.05))]
    ledger = spark.createDataFrame(rows, "scenario string, cost_multiplier double, execution_date date, symbol string, research_split string, in_current_universe boolean, active_weight double, forward_return double, industry_group string")
    assert portfolio.concentration(ledger).first()["top_symbol"] == "a"


def test_universe_counts_peers_without_a_score(spark):
    rows = [("k", "a", 1.0), ("k", "b", 2.0), ("k", "c", 4.0), ("k", "d", None)]
    df = spark.createDataFrame(rows, "k string, symbol string, x double")
    out = weekly.peer_scores(df, "k", ["x"], ["x"], ["x"]).collect()
    assert {r.universe for r in out} == {4} and [r.symbol for r in out if r.operating_score is None] == ["d"]


def test_span_returns_by_brute_force(spark):
    prices = [("a", day(10), 5.0), ("b", day(3), 2.0), ("b", day(9), 3.0), ("b", day(40), None), ("b", day(400), 6.0), ("c", day(50), 1.0)]
    spans = [(s, day(a), day(z)) for s in "abcd" for a, z in ((0, 20), (3, 9), (4, 8), (9, 500), (60, 70), (0, 2))]
    spans.append(("b", None, day(9)))
    got = asof.forward_return(spark.createDataFrame(prices, "symbol string, date date, close_adj double"), spark.createDataFrame(spans, "symbol string, start date, end date")).collect()
    assert len(got) == len(spans)
    for r in got:
        own = [(d, p) for s, d, p in prices if s == r.symbol and p is not None]
        a = [p for d, p in own if r.start and d >= r.start]
        z = [p for d, p in own if d <= r.end]
        assert (r.span_return is None) == (not (a and z))
        if a and z:
            assert r.span_return == pytest.approx(z[-1] / a[0] - 1)


def test_quantiles_are_those_of_the_profit(spark):
    totals = RNG.normal(0, 0.3, 501)
    paths = spark.createDataFrame([(float(t),) for t in totals], "total double")
    for material in (1000.0, -1000.0):
        for r in weekly.scenario_grid(spark, paths, material, [0.3], [0.0, 0.5]).collect():
            impact = -material * 0.3 * (np.exp(totals) - 1) * (1 - r.pass_through)
            assert r.profit_change == pytest.approx(np.quantile(impact, r.quantile))


def market(spark, n=90, gaps=True):
    rows = []
    for s, skip in (("a", 0), ("b", 7), ("c", 3), ("d", 0), ("e", 0)):
        p = 10.0
        for k in range(n):
            p *= math.exp(RNG.normal(0, 0.02))
            if not (gaps and skip and k % skip == 1) and not (s == "d" and k < 30) and not (s == "e" and 40 <= k < 60):
                rows.append((day(k), s, p, p, 1000.0))
    return spark.createDataFrame(rows, "date date, symbol string, close_adj double, close_raw double, volume double")


MEMBERS = "snapshot_date date, available_date date, symbol string, benchmark_weight double, industry_group string"


def members(spark, weights):
    rows = [(day(1), day(20), s, w, "g") for s, w in weights[0].items()] + [(day(45), day(50), s, w, "g") for s, w in weights[1].items()]
    return spark.createDataFrame(rows, MEMBERS)


def brute_returns(bars):
    wide = bars.toPandas().pivot(index="date", columns="symbol", values="close_adj").sort_index()
    return pd.DataFrame({s: wide[s].dropna().pct_change() for s in wide}).reindex(wide.index)


def brute_benchmark(returns, weights):
    w = pd.Series({s: x for s, x in weights.items() if s in returns}, dtype=float)
    if w.sum() <= 0:
        w[:] = 1.0
    m = returns[w.index]
    below = m.notna().mul(w, axis=1).sum(axis=1)
    return m.mul(w, axis=1).sum(axis=1, min_count=1) / below.where(below > 0)


WEIGHTS = [
    ({"a": 0.5, "b": 0.3, "d": 0.2, "nobars": 0.4}, {"a": 0.2, "c": 0.8, "e": 0.1}),
    ({"a": 0.0, "b": 0.0, "e": 0.0}, {"a": 1.0, "c": 0.0, "b": 0.5}),  # all zero; single zeros
]


@pytest.mark.parametrize("weights", WEIGHTS)
def test_member_betas_by_brute_force(spark, weights):
    f = panel.Features(long=20, medium=10, skip=2, beta=12, min_beta=6)
    bars = market(spark)
    calendar = spark.createDataFrame([(day(k),) for k in (25, 33, 47, 55, 65, 80, 89)], "signal_date date")
    known = asof.membership_asof(calendar, members(spark, weights))
    got = {(r.signal_date, r.symbol): r for r in panel.member_betas(bars, known, f).collect()}
    returns = brute_returns(bars)
    seen = 0
    for k in (25, 33, 47, 55, 65, 80, 89):
        own = weights[0] if k < 50 else weights[1]
        bench = brute_benchmark(returns, own)
        assert {s for d, s in got if d == day(k)} == set(own)
        for s in own:
            r = got[day(k), s]
            if s not in returns:
                assert r.beta_observations == 0 and r.beta_6m is None
                continue
            both = pd.concat([returns[s].rename("y"), bench.rename("x")], axis=1).loc[: day(k)].dropna().tail(f.beta)
            assert r.beta_observations == len(both), (k, s)
            if len(both) < f.min_beta or both.x.var(ddof=0) == 0:
                assert r.beta_6m is None
                continue
            b, a = np.polyfit(both.x, both.y, 1)
            assert r.beta_6m == pytest.approx(b)
            assert r.idio_volatility_6m == pytest.approx((both.y - a - b * both.x).std(ddof=1) * math.sqrt(f.yearly), abs=1e-9)
            seen += 1
    assert seen > 8
    daily = panel.member_benchmark(bars, known).where(F.col("signal_date") == day(89)).collect()
    want = brute_benchmark(returns, weights[1]).dropna()
    assert {r.date: pytest.approx(r.benchmark_return) for r in daily if r.benchmark_return is not None} == want.to_dict()


def test_panel_with_the_members_as_benchmark(spark):
    f = panel.Features(long=20, medium=10, skip=2, volatility=10, min_volatility=5, beta=12, min_beta=6, liquidity=5, min_liquidity=3, min_cross_section=2)
    bars = market(spark, 150, gaps=False)
    filings = spark.createDataFrame([], "symbol string, report_date date, notice_date date, available_date date, revenue double, total_assets double")
    out = panel.build(bars, filings, members(spark, WEIGHTS[0]), None, f).collect()
    returns = brute_returns(bars)
    assert {r.symbol for r in out} == {"a", "b", "c", "e"}  # d has no bar before its months
    by_month = {}
    for r in out:
        by_month.setdefault(r.execution_date, []).append(r)
        own = WEIGHTS[0][0] if r.signal_date < day(50) else WEIGHTS[0][1]
        both = pd.concat([returns[r.symbol].rename("y"), brute_benchmark(returns, own).rename("x")], axis=1).loc[: r.signal_date].dropna().tail(f.beta)
        assert r.beta_6m == pytest.approx(np.polyfit(both.x, both.y, 1)[0]) if len(both) >= f.min_beta else r.beta_6m is None
    for rows in by_month.values():
        there = [r for r in rows if r.forward_return is not None]
        if there:
            want = np.average([r.forward_return for r in there], weights=[r.benchmark_weight for r in there])
            assert all(r.benchmark_forward_return == pytest.approx(want) for r in rows)


@pytest.mark.parametrize("tile", [2, 256])
def test_covariances_of_tiles_by_brute_force(spark, tile):
    x = RNG.normal(0, 0.02, (60, 7))
    x[RNG.random((60, 7)) < 0.2] = np.nan
    x[:, 5], x[:, 6] = np.nan, 0.01
    x[10:, 4] = np.nan
    rows = [(day(500 + m), f"s{j}", day(k), None if np.isnan(x[k, j]) else float(x[k, j] * (1 + m))) for m in (0, 1) for k in range(60) for j in range(7)]
    got = risk.covariance(spark.createDataFrame(rows, "signal_date date, symbol string, date date, r double"), 60, 0.25, 12, tile).collect()
    for m in (0, 1):
        frame = pd.DataFrame(x * (1 + m), columns=[f"s{j}" for j in range(7)])
        c = frame.cov(min_periods=30)
        own = np.diag(c).copy()
        own = np.maximum(np.where(np.isnan(own), np.nanmedian(own), own), 1e-8)
        want = {(a, b): 12 * (own[i] if i == j else 0.75 * (0.0 if np.isnan(c.loc[a, b]) else c.loc[a, b])) for i, a in enumerate(frame) for j, b in enumerate(frame) if i <= j}
        mine = {(r.sym_i, r.sym_j): r.cov for r in got if r.signal_date == day(500 + m)}
        assert mine.keys() == want.keys() and all(mine[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def targets(spark, months=7):
    rows = []
    for m in range(months):
        names = [f"n{k}" for k in range(12) if (k + m) % 5]
        w = RNG.dirichlet(np.ones(len(names)))
        for multiplier in (0.5, 2.0):
            rows += [("base", multiplier, day(30 * m), day(30 * m - 1), s, 1 / len(names), float(x), float(RNG.normal(0, 0.05)), 0.1, 1e6 if k else None, 0.02, 1.0, "g", "design") for k, (s, x) in enumerate(zip(names, w, strict=True))]
    schema = "scenario string, cost_multiplier double, execution_date date, signal_date date, symbol string, benchmark double, target double, forward_return double, composite_score double, adv20_rmb double, volatility_63d double, market_beta_126d double, industry_group string, research_split string"
    return spark.createDataFrame(rows, schema).repartition(5)


def test_a_ledger_folds_month_by_month_whatever_the_batches(spark):
    df, mandate = targets(spark), portfolio.Mandate(min_holdings=3, aum=1e5)
    want = {}
    for (s, c), rows in df.toPandas().sort_values(["execution_date", "symbol"]).groupby(["scenario", "cost_multiplier"]):
        account = portfolio.Account(s, c, mandate)
        for _, month in rows.groupby("execution_date", sort=True):
            want |= {(c, x[2], x[4]): x for x in account.trade(month.reset_index(drop=True))}
    assert len(want) > 100 and any(x[7] for x in want.values())
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for batch in ("3", "1000"):  # fewer rows than a month has, and more
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = portfolio.backtest(df, mandate).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert len(got) == len(want)
        for r in got:
            x = want[r.cost_multiplier, r.execution_date, r.symbol]
            assert r.implemented_weight == pytest.approx(x[11]) and r.total_cost == pytest.approx(x[26]) and r.cash_weight == pytest.approx(x[20]) and r.forced_exit == x[7]


def series(spark):
    out = []
    for name, phi in (("reverting", 0.6), ("walk", 1.0)):
        y = 2.0
        for k in range(200):
            y = (2.0 if phi < 1 else 0.0) * (1 - phi) + phi * y + RNG.normal(0, 0.05)
            out.append((name, day(7 * k), None if k % 31 == 5 else math.exp(y)))
    out += [("short", day(7 * k), 1.0 + k) for k in range(9)] + [("one", day(0), 3.0)]
    return spark.createDataFrame(out, "symbol string, week date, close double"), out


def test_study_of_price_series_by_brute_force(spark):
    df, rows = series(spark)
    fitted = {r.symbol: r for r in commodity.fits(df, ["symbol"], "close", "week").collect()}
    assert fitted["reverting"].method == commodity.AR1 and fitted["short"].method == fitted["one"].method == commodity.BOOTSTRAP
    for name in ("reverting", "walk"):
        y = np.log([p for s, _, p in rows if s == name and p is not None])
        b, a = np.polyfit(y[:-1], y[1:], 1)
        e = y[1:] - a - b * y[:-1]
        cut = max(20, int(len(y) * 0.8))
        tb, ta = np.polyfit(y[: cut - 1], y[1:cut], 1)
        r = fitted[name]
        assert (r.n, r.phi, r.intercept, r.sigma) == (len(y), pytest.approx(b), pytest.approx(a), pytest.approx(e.std(ddof=1)))
        assert r.ar_rmse == pytest.approx(np.sqrt(np.mean((y[cut:] - ta - tb * y[cut - 1 : -1]) ** 2)))
        assert r.walk_rmse == pytest.approx(np.sqrt(np.mean((y[cut:] - y[cut - 1 : -1]) ** 2)))
        stat, lags = brute.adf(y)
        assert (r.adf_stat, r.adf_p_value, r.lags) == (pytest.approx(stat), pytest.approx(weekly.adf_p(stat)), lags)
    fits = commodity.fits(df, ["symbol"], "close", "week")
    paths = commodity.simulated(df, fits, ["symbol"], "close", "week", 1500, 10, 5)
    got = paths.toPandas()
    assert got.groupby("symbol").size().to_dict() == {"reverting": 1500, "walk": 1500, "short": 1500}
    again = commodity.simulated(df.where("symbol <> 'walk'").repartition(7), fits, ["symbol"], "close", "week", 1500, 10, 5).toPandas()
    for name in ("reverting", "short"):  # no other series and no number of tasks changes a series' paths
        own = got[got.symbol == name].sort_values("path")
        assert np.allclose(own.total, again[again.symbol == name].sort_values("path").total)
        y = np.log([p for s, _, p in rows if s == name and p is not None])
        want = []
        for chunk, n in ((0, 1000), (1, 500)):
            rng, r = np.random.default_rng([5, zlib.crc32(name.encode()), chunk]), fitted[name]
            if r.method == commodity.AR1:
                level = np.full(n, y[-1])
                for _ in range(10):
                    level = r.intercept + r.phi * level + rng.normal(0, r.sigma, n)
                want += list(level - y[-1])
            else:
                d = np.diff(y)
                want += [sum([x for s in starts for x in d[s : s + 4]][:10]) for starts in rng.integers(0, len(d) - 3, (n, 3))]
        assert np.allclose(own.total, want)
    grid = weekly.scenario_grid(spark, paths, 100.0, [0.5], [0.0], ["symbol"]).collect()
    assert len(grid) == 9


def test_unit_roots_by_brute_force(spark):
    rows, want = [], {}
    for n in (9, 21, 24, 60, 333):
        for kind in ("noise", "walk", "lagged"):
            e = RNG.normal(size=n)
            y = 50 + (e if kind == "noise" else np.cumsum(e) if kind == "walk" else np.convolve(e, [1, 0.6, -0.5, 0.4], "same"))
            rows += [(f"{kind}{n}", k, float(x)) for k, x in enumerate(y)] + [(f"{kind}{n}", n, None)]
            want[f"{kind}{n}"] = brute.adf(y) if n > 20 else (None, None)
    got = regression.unit_root_statistic(spark.createDataFrame(rows, "s string, k long, y double"), "y", ["s"], "k").collect()
    assert len(got) == len(want) and any(lags for _, lags in want.values())
    for r in got:
        assert (r.adf_stat, r.lags) == (pytest.approx(want[r.s][0], rel=1e-6) if r.n > 20 else None, want[r.s][1]), r


def test_newey_west_and_attribution_by_brute_force(spark):
    models = {"one": ["a"], "two": ["b", "a"], "four": ["a", "b", "c", "d"]}
    rows, data = [], {}
    for s in ("x", "y"):
        z = RNG.normal(size=(60, 4))
        y = z @ [0.5, -0.2, 0.0, 0.1] + np.convolve(RNG.normal(size=60), [1, 0.7], "same") + 0.3
        data[s] = (y, z)
        rows += [(s, day(7 * k), float(y[k]), *map(float, z[k])) for k in range(60)] + [(s, day(-7), None, 1.0, 1.0, 1.0, 1.0), (s, day(-14), 1.0, 1.0, None, 1.0, 1.0)]
    rows += [("few", day(7 * k), 1.0, *map(float, RNG.normal(size=4))) for k in range(2)]
    df = spark.createDataFrame(rows, "s string, week date, y double, a double, b double, c double, d double").repartition(3)
    got = {(r.s, r.model, r.term): r for r in regression.hac_models(df, models, "y", "week", 3, ["s"]).collect()}
    assert not any(s == "few" for s, _, _ in got)
    for s, (y, z) in data.items():
        for m, xs in models.items():
            use, x = y, z[:, ["abcd".index(c) for c in xs]]
            if "b" not in xs:  # the row without b counts in models that don't need it
                use, x = np.append(1.0, y), np.vstack([np.ones((1, len(xs))), x])
            b, se, r2, adj, aic = brute.ols(use, x, 3)
            for k, term in enumerate(["const", *xs]):
                r = got[s, m, term]
                assert (r.n, r.coefficient, r.hac_se) == (len(use), pytest.approx(b[k]), pytest.approx(se[k]))
                assert (r.r_squared, r.adj_r_squared, r.aic) == (pytest.approx(r2), pytest.approx(adj), pytest.approx(aic))
                assert r.p_value == pytest.approx(math.erfc(abs(b[k] / se[k]) / math.sqrt(2)))
    one = df.where("s = 'x' and y is not null and b is not null")
    fitted = regression.hac_models(one, models, "y", "week", 3, p_values=False)
    parts = {(r.model, r.component): r.contribution for r in regression.attribution(one, fitted, ["a", "b", "c", "d"], "y", str(day(70)), str(day(140)), "week").collect()}
    y, z = data["x"]
    for m, xs in models.items():
        b = brute.ols(y, z[:, ["abcd".index(c) for c in xs]], 3)[0]
        want = {"intercept": b[0] * 11, "total": y[10:21].sum()} | {c: b[k] * z[10:21, "abcd".index(c)].sum() for k, c in enumerate(xs, 1)}
        want["residual"] = want["total"] - sum(v for c, v in want.items() if c != "total")
        assert {c: v for (k, c), v in parts.items() if k == m} == pytest.approx(want)
    assert regression.attribution(one, fitted, ["a"], "y", "1990-01-01", "1990-02-01", "week").where("contribution is not null").count() == 0


@pytest.mark.parametrize("accuracy", [20, 200, 10_000])
def test_quantiles_are_exact_whatever_the_sketch(spark, accuracy):
    groups = {"normal": RNG.normal(size=3000), "ties": RNG.integers(0, 5, 2000).astype(float), "one": np.array([3.0]), "two": np.array([1.0, 2.0]), "same": np.full(500, 7.0), "skewed": np.exp(RNG.normal(0, 3, 1501)), None: RNG.normal(size=90)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("normal", None), ("empty", None)]
    df = spark.createDataFrame(rows, "q string, v double").repartition(7)
    cuts = (0.0, 0.01, 0.05, 0.5, 0.95, 0.999, 1.0)
    got = {r[0]: r[1] for r in windows.exact_quantiles(df.withColumnRenamed("q", "k"), "v", cuts, ["k"], accuracy).collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        assert got[k] == pytest.approx(np.quantile(v, cuts).tolist())
    every = np.concatenate(list(groups.values()))
    assert windows.exact_quantiles(df, "v", cuts, (), accuracy).first()[0] == pytest.approx(np.quantile(every, cuts).tolist())
    out = windows.winsorised(df, "v", 0.05, 0.95, "w", ("q",)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.w is None if r.v is None else r.w == pytest.approx(np.clip(r.v, *np.quantile(groups[r.q], [0.05, 0.95])))
    assert windows.winsorised(df.where("v is null"), "v", 0.05, 0.95, "w").count() == 2


def test_peer_validation_by_brute_force(spark):
    symbols = [f"p{k}" for k in range(7)] + ["M"]
    prices = [(s, dt.date(2021, 4, 20) + dt.timedelta(days=9 * k), float(x)) for s in symbols for k, x in enumerate(np.exp(np.cumsum(RNG.normal(0, 0.1, 90))))]
    prices = [x for x in prices if x[0] != "p6"]
    scores = [(dt.date(y, 12, 31), s, None if s == "p5" and y == 2020 else float(RNG.integers(0, 4))) for y in (2020, 2021, 2023) for s in symbols[:7]]
    cutoff = dt.date(2022, 8, 1)
    got = weekly.validated(spark.createDataFrame(scores, "report_date date, symbol string, operating_score double"), spark.createDataFrame(prices, "symbol string, date date, close_adj double"), "M", str(cutoff)).collect()
    assert {r.report_date.year for r in got} == {2020, 2021}
    for r in got:
        start = dt.date(r.report_date.year + 1, 5, 1)
        end = min(start + dt.timedelta(days=183), cutoff)
        assert (r.evaluation_start, r.evaluation_end) == (start, end)

        def back(s, start=start, end=end):
            own = [(d, p) for x, d, p in prices if x == s]
            a, z = [p for d, p in own if d >= start], [p for d, p in own if d <= end]
            return z[-1] / a[0] - 1 if a and z else None

        pairs = [(x, back(s) - back("M")) for d, s, x in scores if d == r.report_date and x is not None and back(s) is not None]
        x, y = (pd.Series(c).rank() for c in zip(*pairs, strict=True))
        assert (r.companies, r.rank_ic) == (len(pairs), pytest.approx(x.corr(y))) and 0 <= r.p_value <= 1


def jobs_of(spark, name, call):
    spark.sparkContext.setJobGroup(name, name)
    try:
        call()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_checks_ride_on_the_write(spark, tmp_path):
    from tidemark.operators.watch import Watch

    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("day"))
    names = spark.range(7).select(F.col("id").alias("v"), F.concat(F.lit("n"), "id").alias("name"))
    plain = jobs_of(spark, "plain", lambda: df.join(names.groupBy("v").agg(F.any_value("name").alias("name")), "v", "left").write.parquet(str(tmp_path / "plain")))

    def checked(limit, cutoff, right, path):
        w = Watch()
        rows = w.point_in_time(w.domain(df, {"small": F.col("v") < limit, "there": F.col("k") >= 0}, "rows"), "day", cutoff, "rows")
        return w.write(w.many_to_one(rows, right, ["v"], "names"), str(tmp_path / path))

    assert jobs_of(spark, "checked", lambda: checked(7, "2021-01-01", names, "good")) == plain
    good = spark.read.parquet(str(tmp_path / "good"))
    assert good.count() == 100 and good.where("name is null").count() == 0
    twice = names.unionByName(names.limit(1))
    for bad, message in (((6, "2021-01-01", names), "rows breaks rules: {'small': 14}"), ((7, "2020-02-01", names), "dates after 2020-02-01 in: rows"), ((7, "2021-01-01", twice), r"names, right repeats the key \['v'\]")):
        with pytest.raises(ValueError, match=message):
            checked(*bad, "good")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["good", "plain"]
    assert spark.read.parquet(str(tmp_path / "good")).count() == 100  # what was there stays


def test_checks_of_frames_that_are_left_out_or_empty(spark, tmp_path):
    from tidemark.operators.watch import Watch

    n, none = spark.range(5).withColumn("x", F.lit(1)), spark.range(0).withColumn("y", F.lit(1))
    w = Watch()
    assert w.write(w.one_to_one(n, none, ["id"], "n"), str(tmp_path / "a")).count() == 5
    w = Watch()
    w.domain(n.where("false"), {"x": F.col("x") > 5}, "empty").write.format("noop").mode("overwrite").save()
    w.settle()
    w = Watch()
    twice = w.unique(n.unionByName(n), ["id"], "n").join(none, "id")
    with pytest.raises(ValueError, match="n repeats the key"):
        w.write(twice, str(tmp_path / "b"))
    nulls = spark.createDataFrame([(None, 1), (None, 2)], "id long, x int")
    w = Watch()
    with pytest.raises(ValueError, match="repeats"):
        w.write(w.unique(nulls, ["id"], "nulls"), str(tmp_path / "c"))


def test_windows_on_the_stored_layout_move_no_bars(spark, tmp_path):
    from tidemark.sources import layout

    rows = [(s, day(k), float(10 + (k * 7 + i) % 13), 5.0 + k % 3) for i, s in enumerate("abcM") for k in range(80)]
    market = spark.createDataFrame(rows, "symbol string, date date, close_adj double, volume double").withColumn("close_raw", F.col("close_adj"))
    stored = layout.store_by_symbol(market, str(tmp_path / "market"), "market_test", buckets=4)

    def features(df):
        bars = windows.liquidity(windows.volatility(windows.momentum(windows.history(windows.with_returns(df)), "m", 20, 4), 13, 10, 52), 4, 3)
        return windows.beta(panel.with_benchmark(bars, "M"), 26, 20, 52)

    names = sorted(features(market).columns)
    got, want = (sorted(features(df).select(names).collect(), key=lambda r: (r.symbol, r.date)) for df in (stored, market))
    for a, b in zip(got, want, strict=True):
        assert a.asDict() == pytest.approx(b.asDict(), nan_ok=True)
    plan = features(stored)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(symbol" not in plan and "Bucketed: true" in plan
    assert "Exchange hashpartitioning(symbol" in features(market)._jdf.queryExecution().executedPlan().toString()
    layout.drop(spark, "market_test", str(tmp_path / "market"))
    assert not (tmp_path / "market").exists()
