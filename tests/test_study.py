"""No look-ahead, invariance under partitions, as-of joins against brute force, fits against NumPy, and the command line."""

import datetime as dt
import json
import os
import random

import numpy as np
import pandas as pd
import pytest

from tidemark import cli
from tidemark.operators import asof, risk
from tidemark.plans import panel, study, weekly

R = random.Random(3)
DAY = dt.date(2020, 1, 1)
DATA = "/root/testdata/sf0.001"


def market_rows(n=420):
    rows = []
    for s, seed in (("A", 1), ("B", 2), ("M", 3)):
        rng, price = np.random.default_rng(seed), 100.0
        for k in range(n):
            price *= 1 + rng.normal(0, 0.01)
            if rng.random() > 0.05:  # some days have no bar
                rows.append((DAY + dt.timedelta(days=k), s, price, price, float(1000 + k)))
    return rows


MARKET = "date date, symbol string, close_adj double, close_raw double, volume double"


def test_features_know_nothing_of_the_future(spark):
    f = panel.Features(long=60, medium=30, skip=5, volatility=20, beta=30, liquidity=10, min_volatility=10, min_beta=15, min_liquidity=5)
    full, cut = spark.createDataFrame(market_rows(), MARKET), DAY + dt.timedelta(days=300)
    names = ["date", "symbol", *panel.PRICE]
    whole = panel.price_features(full, "M", f).where(f"date <= '{cut}'").select(*names)
    early = panel.price_features(full.where(f"date <= '{cut}'").repartition(5), "M", f).select(*names)
    a, b = (sorted(map(tuple, df.collect())) for df in (whole, early))
    assert a == b and any(x[names.index("beta_6m")] is not None for x in a)


def test_fundamentals_as_of_by_brute_force(spark):
    rows = []
    for s in "AB":
        for q in range(12):
            report = dt.date(2019 + q // 4, 3 * (q % 4) + 3, 28)
            for _ in range(R.choice([1, 1, 2, 3])):
                rows.append((s, report, report + dt.timedelta(days=R.randint(-5, 200)), R.random()))
    rows = list({(s, r, e): (s, r, e, v) for s, r, e, v in rows}.values())
    filings = spark.createDataFrame([(s, r, e, e, v) for s, r, e, v in rows], "symbol string, report_date date, notice_date date, effective_date date, revenue double")
    signals = [dt.date(2019, 1, 30) + dt.timedelta(days=30 * k) for k in range(36)]
    got = asof.fundamentals_asof(spark.createDataFrame([(d,) for d in signals], "signal_date date"), filings, ["revenue"]).collect()
    want = {}
    for d in signals:
        for s in "AB":
            last = {}
            for x in sorted((x for x in rows if x[0] == s and x[1] <= d and x[2] <= d), key=lambda x: x[2]):
                last[x[1]] = x[3]
            if last:
                now = max(last)
                want[d, s] = (now, last[now], last.get(now.replace(year=now.year - 1)), len(last))
    assert {(r.signal_date, r.symbol): (r.current.report_date, r.current.revenue, r.prior and r.prior.revenue, r.report_count) for r in got} == want


def test_prices_and_members_as_of_by_brute_force(spark):
    bars = [(s, d) for d, s, *_ in market_rows(200)]
    signals = [DAY + dt.timedelta(days=25 * k - 10) for k in range(12)]
    calendar = spark.createDataFrame([(d,) for d in signals], "signal_date date")
    got = {(r.signal_date, r.symbol): r.date for r in asof.last_known(calendar, spark.createDataFrame(bars, "symbol string, date date")).collect()}
    want = {(d, s): max(x for t, x in bars if t == s and x <= d) for d in signals for s in "ABM" if any(t == s and x <= d for t, x in bars)}
    assert got == want
    versions = [(DAY + dt.timedelta(days=30 * k), DAY + dt.timedelta(days=30 * k + w), f"s{k}") for k, w in enumerate((40, 10, 95, 10, 5))]
    members = spark.createDataFrame(versions, "snapshot_date date, available_date date, symbol string")
    got = {r.signal_date: r.symbol for r in asof.membership_asof(calendar, members).collect()}
    assert got == {d: max(v for v in versions if v[0] <= d and v[1] <= d)[2] for d in signals if any(v[0] <= d and v[1] <= d for v in versions)}


def test_recent_returns_by_brute_force(spark):
    rows = market_rows(150)
    close = {(s, d): c for d, s, c, *_ in rows}
    months = [(DAY + dt.timedelta(days=k), s) for k in (5, 60, 149) for s in "AB"]
    got = risk.recent_returns(spark.createDataFrame(rows, MARKET), spark.createDataFrame(months, "signal_date date, symbol string"), 20).collect()
    want = {}
    for d in {m for m, _ in months}:
        days = sorted({x for s, x in close if s in "AB" and x <= d})[-21:]
        for s in "AB":
            for before, x in zip([None, *days], days, strict=False):
                a, z = close.get((s, before)), close.get((s, x))
                want[d, s, x] = z / a - 1 if a and z else None
    assert {(r.signal_date, r.symbol, r.date): r.r for r in got} == pytest.approx(want)


def test_fits_of_several_factors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(140, 3))
    y = x @ [0.5, -1.0, 2.0] + 0.3 + rng.normal(0, 0.1, 140)
    df = spark.createDataFrame([(1, k, float(y[k]), *map(float, x[k])) for k in range(140)], "study int, week int, y double, a double, b double, c double")

    def solved(rows, cols):
        return np.linalg.lstsq(np.column_stack([np.ones(len(rows)), x[rows][:, cols]]), y[rows], rcond=None)[0]

    fit = {r.week: r for r in weekly.rolling_fit(df, "y", ["a", "b", "c"], ["study"], "week", 52).collect()}
    assert fit[50].beta_a is None
    for k in (51, 90, 139):
        assert [fit[k].beta_const, fit[k].beta_a, fit[k].beta_b, fit[k].beta_c] == pytest.approx(solved(np.arange(k - 51, k + 1), [0, 1, 2]).tolist())
    p = {r.week: r for r in weekly.walk_forward_models(df, "y", {"small": ["a"], "large": ["a", "b", "c"]}, ["study"], "week", 78).collect()}
    assert min(p) == 78 and len(p) == 62
    for k in (78, 139):
        rows = np.arange(k - 78, k)
        assert p[k].predicted_small == pytest.approx(float(solved(rows, [0]) @ [1, x[k, 0]])) and p[k].predicted_large == pytest.approx(float(solved(rows, [0, 1, 2]) @ [1, *x[k]]))
    twin = df.selectExpr("study", "week", "y", "a", "a as b")
    assert {r.beta_b for r in weekly.rolling_fit(twin, "y", ["a", "b"], ["study"], "week", 20).collect()} <= {None}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the order tables")
def test_command_line_is_reproducible(spark, tmp_path):
    found = []
    for run in ("one", "two"):
        config = tmp_path / f"{run}.yaml"
        config.write_text(f"project:\n  input: {DATA}\n  output: {tmp_path}/{run}\n")
        for command in ("download", "build", "analyze", "report"):
            cli.main([command, "--config", str(config)], spark)
        found.append((json.loads((tmp_path / run / "analysis.json").read_text()), (tmp_path / run / "report.md").read_text()))
        assert json.loads((tmp_path / run / "manifest.json").read_text())["daily"]["sha256"]
    assert found[0] == found[1] and found[0][1].startswith("# Weekly study")
    summary = found[0][0]
    assert {r["component"] for r in summary["attribution"]} == {"market", "peer", "material", "intercept", "residual", "total"}
    assert all(r["companies"] > 5 and r["p_value"] is not None for r in summary["peer_validation"]) and len(summary["price_models"]) == 5
    built = json.loads((tmp_path / "one" / "build_diagnostics.json").read_text())
    assert built["model_weeks"] == summary["weeks"] <= built["weeks"] and 0 < built["hhi"] < built["share_sum"] / 100 < 1
    assert all(f"## {title}" in found[0][1] for title in ("Attribution", "Peers", "Price series", "Scenarios", "Revenue bridge"))
    with pytest.raises(ValueError, match="evaluation"):
        cli.main(["systematic-run", "--config", str(config)], spark)


def test_weekly_panel_and_bridge_by_brute_force(spark):
    roles = study.Roles("f", "b", ("p", "q"), "m")
    rng = np.random.default_rng(8)
    rows = [(s, dt.date(2020, 1, 3) + dt.timedelta(days=7 * k), float(rng.uniform(5, 9)), None if k == 0 or (s, k) in (("p", 4), ("q", 4), ("q", 7), ("f", 9)) else float(rng.normal())) for s in "fbpqmx" for k in range(40)]
    weeks = spark.createDataFrame(rows, "symbol string, week date, close_adj double, log_return double")
    panel_ = study.weekly_panel(weeks, roles)
    wide = pd.DataFrame(rows, columns=["symbol", "week", "close", "r"]).pivot(index="week", columns="symbol", values="r")
    low, high = wide["m"].dropna().quantile([0.01, 0.99])
    want = pd.DataFrame({"focal_return": wide["f"], "market_return": wide["b"], "peer_return": wide[["p", "q"]].mean(axis=1), "material_return": wide["m"].clip(low, high), "focal_excess": wide["f"] - wide["b"]})
    got = pd.DataFrame([r.asDict() for r in panel_.collect()]).set_index("week").sort_index()
    assert np.allclose(got[want.columns].astype(float), want, equal_nan=True)
    assert study.model_rows(panel_).count() == len(want.dropna()) == 37
    d = study.diagnostics(panel_).first()
    assert (d.weeks, d.model_weeks) == (40, 37) and (d.clip_low, d.clip_high) == pytest.approx((low, high))
    assert study.weekly_panel(weeks.where("false"), roles).count() == 0
    sales = spark.createDataFrame([("a", 2000, 10.0, 2.0), ("a", 2001, 12.0, 3.0), ("a", 2003, 1.0, 1.0), ("b", 2001, 5.0, 5.0)], "segment string, year int, volume double, price double")
    assert sorted(map(tuple, study.revenue_bridge(sales).collect())) == [("a", 2001, "net", 16.0), ("a", 2001, "price", 11.0), ("a", 2001, "volume", 5.0)]
    revenue = spark.createDataFrame([(k, x) for k, x in enumerate((50.0, 30.0, 10.0, 5.0, 3.0, 2.0))], "k int, x double")
    assert tuple(study.concentration(revenue, "k", "x").first()) == pytest.approx((0.25 + 0.09 + 0.01 + 0.0025 + 0.0009, 98.0))
