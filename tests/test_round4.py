"""What larger tables showed: codes of indices among made-up securities, pairs of names, repeated readings."""

import duckdb
import numpy as np
import pytest

from tidemark import queries as q
from tidemark.functions import scalars as S
from tidemark.operators import risk
from tidemark.plans import adapter


def test_symbols_equal_their_sql_where_a_key_gives_an_index_code(spark, tmp_path):
    rows = [(k,) for k in (1, 54388, 610700, 808945, 999999, 1234567)]
    spark.createDataFrame(rows, "s_suppkey long").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    want = con.execute(q.oracle_sql()["c1_c2_symbols"]).fetchall()
    got = [tuple(r) for r in q.queries()["c1_c2_symbols"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("code, suffix", [("000852", "SS"), ("000851", "SZ"), ("920001", "BJ"), ("910001", "SS"), ("700001", None)])
def test_indices_keep_their_exchange(spark, code, suffix):
    assert spark.createDataFrame([(code,)], "c string").select(S.exchange_suffix(S.F.col("c")).alias("x")).first()["x"] == suffix


def test_factor_risk_is_active_risk_of_the_covariance_that_the_factors_make(spark):
    rng = np.random.default_rng(5)
    names, dates, variance = [f"s{k:02d}" for k in range(12)], (1, 2), {"f": 0.01, "g": 0.04}
    rows = [(t, s, float(rng.random()), float(rng.random()), None if k % 4 == 0 else float(rng.random()), float(rng.normal()), float(rng.normal()), float(rng.random())) for t in dates for k, s in enumerate(names)]
    w = spark.createDataFrame(rows, "signal_date int, symbol string, target double, benchmark double, market_beta_126d double, f double, g double, own double")
    pairs = [(a[0], a[1], b[1], 0.01 * a[5] * b[5] + 0.04 * a[6] * b[6] + (a[7] if a[1] == b[1] else 0.0)) for a in rows for b in rows if a[0] == b[0] and a[1] <= b[1]]
    cov = spark.createDataFrame(pairs, "signal_date int, sym_i string, sym_j string, cov double")
    want = {r["signal_date"]: (r["tracking_error"], r["active_beta"]) for r in risk.active_risk(w, cov).collect()}
    got = {r["signal_date"]: (r["tracking_error"], r["active_beta"]) for r in risk.factor_risk(w, variance, "own").collect()}
    assert set(got) == set(dates) and all(got[t] == pytest.approx(want[t], rel=1e-12) for t in dates)


def test_active_risk_of_the_suppliers_meets_no_pairs_and_equals_its_sql(spark, tmp_path):
    rows = [(k, k % 3 if k % 50 else None, float(k * 7919 % 11000 - 1000)) for k in range(1, 400)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{tmp_path}/supplier.parquet/*.parquet')")
    want = sorted(con.execute(q.oracle_sql()["a24_active_risk"]).fetchall())
    df = q.queries()["a24_active_risk"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in df.collect()) == want and len(want) == 3
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def _read(spark, monkeypatch):
    """A counter of the order lines that tasks read, whatever plan reads them."""
    seen, lines = spark.sparkContext.accumulator(0), adapter.lines

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    def watched(session, d):
        df = lines(session, d)
        return df.mapInArrow(counted, df.schema)

    monkeypatch.setattr(adapter, "lines", watched)
    return seen


@pytest.mark.parametrize("name", ["a23_x7_performance", "a25_concentration", "a26_f16_failure_gates", "x1_x2_projected_targets"])
def test_a_run_reads_the_order_lines_once(spark, monkeypatch, name):
    d = "/root/testdata/sf0.01"
    whole, seen = adapter.lines(spark, d).count(), _read(spark, monkeypatch)
    assert q.queries()[name](spark, d).count() > 0
    assert seen.value == whole


def test_market_filings_and_members_of_the_days_are_those_of_the_lines(spark):
    d = "/root/testdata/sf0.001"
    by_day, lines = adapter.days(spark, d), adapter.lines(spark, d)
    week = S.F.date_trunc("week", "day").cast("date").alias("date")
    want = lines.groupBy(week, "symbol").agg((S.F.sum("price") / 100.0 / S.F.sum("qty")).alias("close_adj"), S.F.max(S.F.col("price") / 100.0 / S.F.col("qty")).alias("high_raw"), S.F.sum("qty").cast("double").alias("volume"))
    got = adapter.market(spark, d, by_day).where(S.F.col("symbol") != adapter.BENCHMARK).select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    for table in (adapter.fundamentals(spark, d, by_day), adapter.memberships(spark, d, by_day=by_day)):
        assert table.count() > 0
