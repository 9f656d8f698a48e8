"""Closed forms and invariants of the panel operators on small frames."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import probability
from tidemark.operators import asof, checks, cross_section, evaluate, portfolio, risk, windows
from tidemark.plans import weekly
from tidemark.sources import files


def day(k):
    return dt.date(2022, 1, 3) + dt.timedelta(days=k)


@pytest.fixture(scope="module")
def bars(spark):
    rows, base, own = [], 100.0, 50.0
    for k in range(160):
        r = 0.0002 + 0.004 * math.sin(k / 9)
        base, own = base * (1 + r), own * (1 + 0.0003 + 1.5 * r)
        rows += [(day(k), "BM", base, base, 1e6), (day(k), "A", own, own, 1e6)]
    return spark.createDataFrame(rows, "date date, symbol string, close_adj double, close_raw double, volume double")


def test_beta_of_a_linear_series_is_exact(bars):
    ret = windows.with_returns(bars)
    bm = ret.where("symbol = 'BM'").select("date", F.col("simple_return").alias("benchmark_return"))
    last = windows.beta(ret.where("symbol = 'A'").join(bm, "date", "left"), 126, 100, 252).orderBy(F.desc("date")).first()
    assert last.beta_6m == pytest.approx(1.5, abs=1e-9) and last.idio_volatility_6m < 1e-9 and last.beta_observations == 126


def test_momentum_and_volatility(bars):
    p = bars.where("symbol = 'A'").orderBy("date").toPandas()["close_adj"]
    out = windows.volatility(windows.momentum(windows.with_returns(bars), "m", 100, 20), 30, 20, 252).where("symbol = 'A'").orderBy(F.desc("date")).first()
    assert out.m == pytest.approx(math.log(p.iloc[-21] / p.iloc[-101]))
    assert out.volatility_3m == pytest.approx(p.pct_change().tail(30).std() * math.sqrt(252))


def test_an_older_snapshot_published_later_never_wins(spark):
    cal = spark.createDataFrame([(day(100), day(101), None)], "signal_date date, execution_date date, next_execution_date date")
    m = spark.createDataFrame([(day(50), day(60), "new"), (day(10), day(90), "late"), (day(80), day(200), "future")], "snapshot_date date, available_date date, symbol string")
    assert [r.symbol for r in asof.membership_asof(cal, m).collect()] == ["new"]


def test_restatements_count_from_their_own_date(spark):
    cal = spark.createDataFrame([(day(50),), (day(90),)], "signal_date date")
    f = spark.createDataFrame([("A", day(0), day(40), day(40), 1.0), ("A", day(0), day(40), day(80), 2.0)], "symbol string, report_date date, notice_date date, effective_date date, v double")
    got = {r.signal_date: r.current.v for r in asof.fundamentals_asof(cal, f, ["v"]).collect()}
    assert got == {day(50): 1.0, day(90): 2.0}


def test_neutral_scores_are_standard_and_orthogonal(spark):
    rng = np.random.default_rng(3)
    rows = [("m", f"s{k}", "ab"[k % 2], float(np.exp(rng.normal(10, 1)))) for k in range(40)]
    df = spark.createDataFrame([(m, s, g, a, 2 * math.log(a) + (3 if g == "a" else 0) + float(rng.normal())) for m, s, g, a in rows], "month string, symbol string, grp string, adv double, x double")
    out = cross_section.neutralised(df, "x", "adv", ["month"], "z", "grp").toPandas()
    assert out.z.mean() == pytest.approx(0, abs=1e-9) and out.z.std(ddof=0) == pytest.approx(1)
    assert np.dot(out.z, np.log(out.adv)) == pytest.approx(0, abs=1e-6)
    assert out.groupby("grp").z.mean().abs().max() < 1e-9


def test_perfect_signal_and_spread(spark):
    rows = [(day(30 * m), f"s{k:02d}", float(k), k / 1000) for m in range(4) for k in range(25)]
    df = spark.createDataFrame(rows, "execution_date date, symbol string, s double, r double")
    ic = evaluate.information_coefficients(df, ["s"], "r").collect()
    assert len(ic) == 4 and all(x.rank_ic == pytest.approx(1) and x.rank_ic_p_value == pytest.approx(0) for x in ic)
    spread = evaluate.quantile_returns(df, ["s"], "r").where("leg = 'top_minus_bottom'").collect()
    assert all(x.leg_return == pytest.approx(0.020) for x in spread)


def test_adjusted_p_values_are_bounded_and_monotone(spark):
    df = spark.createDataFrame([("a", 0.01), ("a", 0.04), ("a", 0.2), ("a", None)], "k string, p double")
    got = [r.q for r in evaluate.benjamini_hochberg(df, "p", ["k"], "q").orderBy(F.asc_nulls_last("p")).collect()]
    assert got[:3] == pytest.approx([0.03, 0.06, 0.2]) and got[3] is None


def test_student_t_tail():
    assert probability.t_two_sided(-0.7714 * math.sqrt(4 / (1 - 0.7714**2)), 4) == pytest.approx(0.0724, abs=1e-4)


def test_projection_is_feasible_and_closest():
    raw, low, high = np.array([0.5, 0.3, 0.1]), np.zeros(3), np.array([0.4, 0.4, 0.4])
    w = risk.box_projection(raw, low, high, 1.0)
    assert w.sum() == pytest.approx(1) and (w <= high + 1e-12).all()
    assert risk.box_projection(raw, low, high, 1.3) is None


def test_costs_scale_and_stamp_is_on_sales_only():
    t, adv, vol = np.array([0.1, -0.1]), np.array([1e9, 1e9]), np.array([0.02, 0.02])
    one = portfolio.trade_costs(t, adv, vol, pd.Timestamp("2024-01-02"), portfolio.Costs(), 1e8, 1.0)
    two = portfolio.trade_costs(t, adv, vol, pd.Timestamp("2024-01-02"), portfolio.Costs(), 1e8, 2.0)
    assert two["total_cost"] == pytest.approx(2 * one["total_cost"])
    assert one["stamp_duty_cost"] == pytest.approx(0.1 * 5 / 1e4)


def test_turnover_cap_and_unknown_volume():
    target, now = np.array([0.8, 0.2]), np.array([0.2, 0.8])
    done, wish, real = portfolio.limited(target, now, np.array([1e12, 1e12]), 0.25, 1e8, 0.1)
    assert wish == pytest.approx(0.6) and real == pytest.approx(0.25) and done.sum() == pytest.approx(1)
    assert portfolio.limited(target, now, np.array([np.nan, 1e12]), 0.25, 1e8, 0.1)[2] == 0


def test_a_forced_exit_reaches_trades_and_cash(spark):
    rows = [(m, s, b, f) for m, names in ((0, "AB"), (31, "BC"), (62, "BC")) for s, b, f in zip(names, (0.5, 0.5), (0.1 if m == 31 else 0.0, 0.0), strict=True)]
    df = spark.createDataFrame([("s", 1.0, day(m), day(m), s, b, b, f, 0.0, 1e12, 0.02, 1.0, "g", "design") for m, s, b, f in rows], "scenario string, cost_multiplier double, execution_date date, signal_date date, symbol string, benchmark double, target double, forward_return double, composite_score double, adv20_rmb double, volatility_63d double, market_beta_126d double, industry_group string, research_split string")
    free = portfolio.Mandate(min_holdings=1, turnover_cap=0.5, costs=portfolio.Costs(0, 0, 0, 0, 0))
    led = portfolio.backtest(df, free)
    out = {(r.execution_date, r.symbol): r for r in led.collect()}
    assert out[day(31), "A"].trade_weight == pytest.approx(-0.5) and out[day(31), "A"].forced_exit
    second = portfolio.monthly(led, 0.5).where(F.col("execution_date") == day(31)).first()
    assert second.forced_exit_count == 1 and second.post_trade_risky_weight + second.cash_weight == pytest.approx(1)
    perf = {r.research_split: r for r in portfolio.performance(portfolio.monthly(led, 0.5)).collect()}
    assert perf["all"].months == 3 and perf["all"].cumulative_net_return == pytest.approx(0.05)


def test_checks_name_what_is_wrong(spark):
    df = spark.createDataFrame([(day(0), "A"), (day(0), "A")], "date date, symbol string")
    with pytest.raises(ValueError, match="repeats"):
        checks.require_unique(df, ["date", "symbol"], "market")
    with pytest.raises(ValueError, match="notice"):
        checks.require_point_in_time({"notice": (df, "date")}, "2021-12-31")


def test_digest_ignores_order_but_counts_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    b = spark.createDataFrame([(None, 2), ("x", 1)], "v string, k int")
    assert files.content_digest(a).first().digest == files.content_digest(b).first().digest
    assert files.content_digest(a.unionByName(a)).first().digest != files.content_digest(a).first().digest


def test_manifest_merges(tmp_path):
    path = str(tmp_path / "m.json")
    files.write_manifest(path, {"a": {"x": float("nan")}})
    files.update_manifest(path, "b", {"y": 1})
    import json

    got = json.loads(open(path).read())
    assert got["a"]["x"] is None and set(got) == {"a", "b"}


def test_retries_back_off():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return {}

    assert files.with_retries(flaky, dict, 3, 1.0, waits.append) == {} and waits == [1.0, 2.0]


def test_unit_root_tells_walks_from_noise(spark):
    rng = np.random.default_rng(1)
    rows = [("noise", k, float(x)) for k, x in enumerate(rng.normal(size=300))] + [("walk", k, float(x)) for k, x in enumerate(np.cumsum(rng.normal(size=300)))]
    p = {r.s: r.adf_p_value for r in weekly.unit_root(spark.createDataFrame(rows, "s string, k long, y double"), "y", ["s"], "k").collect()}
    assert p["noise"] < 0.01 < 0.2 < p["walk"]


def test_queries_and_sql_have_the_same_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_covariances_of_every_signal_month(spark):
    import tidemark.queries as q

    d = "/root/testdata/sf0.001"
    got = {(r.signal_date, r.sym_i, r.sym_j): r["cov"] for r in q.queries()["a8_a9_j14_covariance_all_months"](spark, d).collect()}
    close = {(r.symbol, r.date): r.close_adj for r in q._market(spark, d).collect()}
    members: dict = {}
    for r in asof.membership_asof(q._calendar(spark, d), q.adapter.memberships(spark, d)).collect():
        members.setdefault(r.signal_date, set()).add(r.symbol)
    assert min(members) < dt.date(1997, 1, 1) and max(members) > dt.date(1998, 12, 31)
    assert set(got) == {(s, a, b) for s, m in members.items() for a in m for b in m if a <= b}
    for s, names in members.items():
        dates = sorted({x for n, x in close if n in names and x <= s})[-41:]
        own = pd.DataFrame({n: [close.get((n, x), np.nan) for x in dates] for n in sorted(names)}).pct_change(fill_method=None)
        c = own.cov(min_periods=20)
        middle = np.nanmedian(np.diag(c)) if not c.isna().all().all() else 1e-8
        for a in c:
            for b in c:
                if a <= b:
                    v = c.loc[a, b]
                    want = max(middle if np.isnan(v) else v, 1e-8) if a == b else 0.65 * (0 if np.isnan(v) else v)
                    assert abs(got[s, a, b] - want * 52) < 2e-5
