"""Hand-made edge cases of the analytics operators."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import control, impact, kappa, quotes, rates, report, score, series, simulate, windows
from tidemark.operators.asof import asof

QUOTE = "symbol string, us long, sequence long, bid_price_0 double, ask_price_0 double"
TRADE = "symbol string, us long, side string, price double, trade_id long"
ETH = {"symbol": "ETH", "kappa_p": 8.54373712363063, "kappa_m": 4.195726955538045, "epsilon_p": 0.07000000000002729, "epsilon_m": 0.04285714285729877, "lambda_p": 0.36418718893812874, "lambda_m": 0.17005047555026997, "mid": 3000.0}


def us(s):
    return round(s * 1e6)


def test_asof_with_lag(spark):
    q = spark.createDataFrame([("A", us(t), s, b, a) for t, s, b, a in [(0.0, 1, 99.0, 101.0), (1.0, 2, 100.0, 102.0), (1.0, 3, 100.0, 103.0), (2.0, 4, 100.0, None)]], QUOTE)
    rows = [(0.4, "buy", 101.0), (0.5, "buy", 101.0), (1.4, "sell", 98.0), (1.5, "buy", 105.0), (1.6, "buy", 102.5), (1.7, "x", 99.0), (2.5, "buy", 110.0)]
    t = spark.createDataFrame([("A", us(x), s, p, i) for i, (x, s, p) in enumerate(rows)], TRADE)
    got = {r["trade_id"]: (r["sequence"], r["depth"], r["side"]) for r in kappa.trade_depths(t, q).collect()}
    assert got == {1: (1, 0.0, "buy"), 2: (1, 1.0, "sell"), 3: (3, 2.0, "buy"), 5: (3, 1.0, "sell")}


def test_interval_joins(spark):
    times = [9.799999, 9.8, 9.9, 10.0, 10.1, 10.2, 10.200001]
    t = spark.createDataFrame([("A", us(10.0), "buy", 1.0, 0)], TRADE)

    def found(keep):
        q = spark.createDataFrame([("A", us(x), i, float(i), float(i)) for i, x in enumerate(times) if i in keep], QUOTE)
        pre = asof(t, q, "e", ["sequence"], within_us=200_000, inclusive=False).first()["e"]
        post = asof(t, q, "e", ["sequence"], within_us=200_000, inclusive=False, forward=True).first()["e"]
        return pre and pre["sequence"], post and post["sequence"]

    assert found({3}) == (None, None)
    assert found({0, 6}) == (None, None)
    assert found({1, 5}) == (1, 5)
    assert found({1, 2, 4, 5}) == (2, 4)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("AB"), st.integers(0, 60)), max_size=25), st.lists(st.tuples(st.sampled_from("AB"), st.integers(0, 60)), max_size=25), st.booleans(), st.booleans())
def test_asof_is_a_nested_loop(spark, trades, quotes_, inclusive, forward):
    t = spark.createDataFrame([(s, u, "buy", 1.0, i) for i, (s, u) in enumerate(trades)], TRADE)
    q = spark.createDataFrame([(s, u, i, 1.0, 1.0) for i, (s, u) in enumerate(quotes_)], QUOTE)
    got = {r["trade_id"]: r["e"] and r["e"]["sequence"] for r in asof(t, q, "e", ["sequence"], lag_us=0 if forward else 3, inclusive=inclusive, forward=forward, bucket_us=7).collect()}
    for i, (s, u) in enumerate(trades):
        if forward:
            ok = [(v, j) for j, (z, v) in enumerate(quotes_) if z == s and (v > u or inclusive and v == u)]
            want = min(ok)[1] if ok else None
        else:
            ok = [(v, j) for j, (z, v) in enumerate(quotes_) if z == s and (v + 3 < u or inclusive and v + 3 == u)]
            want = max(ok)[1] if ok else None
        assert got[i] == want
    assert len(got) == len(trades)


def depths_frame(spark, values):
    return spark.createDataFrame([("A", "buy", float(v)) for v in values], "symbol string, side string, depth double")


def test_histogram_and_fit(spark):
    d = depths_frame(spark, [0] * 6 + [0.1] * 4 + [0.2] * 3 + [0.3] * 2 + [0.4])
    hist = kappa.histogram(d, 4, 1800)
    assert [r["count"] for r in hist.orderBy("bin").collect()] == [6, 4, 3, 2]
    f = kappa.fit(hist).first()
    assert (f["kappa"], f["lambda_0"], f["r2"], f["n_points"]) == pytest.approx((4.787917789702671, 0.003948430038058797, 0.9955177617832406, 4))
    assert kappa.histogram(depths_frame(spark, range(9)), 4, 1800).count() == 0
    zero = kappa.histogram(depths_frame(spark, [0] * 12), 4, 1800)
    assert [r["count"] for r in zero.orderBy("bin").collect()] == [0, 0, 0, 12]
    assert kappa.fit(zero).first()["kappa"] is None
    rising = kappa.fit(kappa.histogram(depths_frame(spark, [0.1] * 2 + [0.3] * 4 + [0.5] * 8 + [0.7] * 16), 4, 1800)).first()
    assert rising["kappa"] == 0.0 and rising["lambda_0"] > 0


def test_fit_recovers_truth(spark):
    lam, k = 0.8, 6.0
    rows = [("A", "buy", i, 0.02 * i + 0.01, 1000, lam * math.exp(-k * (0.02 * i + 0.01))) for i in range(20)]
    hist = spark.createDataFrame(rows, "symbol string, side string, bin int, center double, count long, intensity double")
    for f in (kappa.fit(hist), kappa.fit_ols(hist), kappa.fit_nonlinear(hist)):
        r = f.first()
        assert (r["kappa"], r["lambda_0"]) == pytest.approx((k, lam), rel=1e-4)


def test_fit_errors(spark):
    """The slope's p-value against simulation-free values of Student's t; kappa's error against a finite difference."""
    # Two-sided tails that are known in closed form: df 1 is Cauchy's law, df 2 is 1 - t / sqrt(t^2 + 2).
    rows = spark.range(1).select(kappa.t_two_sided(F.lit(-1.7), F.lit(1)), kappa.t_two_sided(F.lit(1.7), F.lit(2)), kappa.t_two_sided(F.lit(2.228139), F.lit(10)), kappa.t_two_sided(F.lit(2.109816), F.lit(17)), kappa.t_two_sided(F.lit(0.0), F.lit(5))).first()
    assert list(rows) == pytest.approx([1 - 2 / math.pi * math.atan(1.7), 1 - 1.7 / math.sqrt(1.7**2 + 2), 0.05, 0.05, 1.0], abs=1e-6)
    x = np.array([0.1, 0.3, 0.5, 0.7, 0.9])
    y = 2.0 * np.exp(-3 * x) * np.array([1.02, 0.97, 1.01, 1.04, 0.95])
    hist = spark.createDataFrame([("A", "buy", i, float(a), 10, float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "symbol string, side string, bin int, center double, count long, intensity double")
    f = kappa.fit_nonlinear(hist).first()
    model = lambda a, k: a * np.exp(-k * x)
    e = 1e-6
    j = np.stack([(model(f["lambda_0"] + e, f["kappa"]) - model(f["lambda_0"] - e, f["kappa"])) / (2 * e), (model(f["lambda_0"], f["kappa"] + e) - model(f["lambda_0"], f["kappa"] - e)) / (2 * e)], axis=1)
    cov = np.linalg.inv(j.T @ j) * ((y - model(f["lambda_0"], f["kappa"])) ** 2).sum() / 3
    assert f["std_error"] == pytest.approx(math.sqrt(cov[1, 1]), rel=1e-4)
    o = kappa.fit_ols(hist).first()
    assert 0 < o["p_value"] < 0.001 and o["n_points"] == 5
    few = kappa.fit_ols(hist.limit(2)).first()
    assert (few["kappa"], few["p_value"], few["n_points"]) == (None, None, 0) and kappa.fit(hist.limit(2)).first()["n_points"] == 0


def test_impact_plots(spark):
    rows = [("A", "buy", i, v, float(i)) for i, v in enumerate([0.0, 0.1, 0.1, 0.2, 1.0])] + [("A", "sell", 9, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, side string, trade_id long, impact double, size double")
    got = impact.impact_histogram(df, 5).orderBy("side", "bin").collect()
    assert [r["count"] for r in got] == [3, 1, 0, 0, 1, 0, 0, 1, 0, 0] and (got[0]["low"], got[4]["high"], got[5]["low"]) == (0.0, 1.0, 1.5)
    line = impact.size_impact(df).first()
    z = np.polyfit(np.sqrt(np.arange(5.0)), [0.0, 0.1, 0.1, 0.2, 1.0], 1)
    assert (line["slope"], line["intercept"], line["n"]) == (pytest.approx(z[0]), pytest.approx(z[1]), 5)


def test_trimmed_impacts(spark):
    rows = [("A", "buy", i, 0.01 * (i + 1)) for i in range(19)] + [("A", "buy", 19, 5.0)]
    e = impact.estimates(spark.createDataFrame(rows, "symbol string, side string, trade_id long, impact double"))
    got = {r["side"]: r for r in e.collect()}
    b = got["buy"]
    assert (b["n"], b["mean"], b["median"], b["std"], b["epsilon"]) == pytest.approx((19, 0.1, 0.1, 0.0547722558, 0.095))
    s = got["sell"]
    assert (s["n"], s["mean"], s["epsilon"]) == (0, 0.0, 0.0)
    same = impact.estimates(spark.createDataFrame([("A", "buy", i, 1.0) for i in range(2)], "symbol string, side string, trade_id long, impact double"))
    assert same.where("side = 'buy'").first()["n"] == 2


def test_toxicity_and_spread(spark):
    rows = [(str(x), x, 1.0, 1.0, 0.5, 0.0) for x in (0.999, 1.0, 1.999, 2.0)]
    p = spark.createDataFrame(rows, "symbol string, kappa_p double, kappa_m double, epsilon_p double, epsilon_m double, mid double")
    assert {r["symbol"]: r["toxicity"] for r in impact.toxicity(p).collect()} == {"0.999": "manageable", "1.0": "competitive", "1.999": "competitive", "2.0": "toxic"}
    assert impact.static_spread(p).first()["pct_p"] is None


def test_raw_lambda(spark):
    df = lambda rows: spark.createDataFrame(rows, "symbol string, us long, side string")
    assert rates.raw_lambda(df([("A", 5, "BUY")])).first()["lambda_p"] == pytest.approx(1e6)
    r = rates.raw_lambda(df([("A", 0, "buy"), ("A", us(10), "x"), ("A", us(5), "sell")])).first()
    assert (r["n_buy"], r["n_sell"], r["n_total"], r["lambda_total"]) == (1, 1, 3, pytest.approx(0.3))


def test_latest_mid(spark):
    rows = [("A", "2", 5, 1, "ask", 11.0), ("A", "1", 9, 2, "ask", 12.0), ("A", "1", 8, 3, "bid", 9.0), ("A", "1", 8, 4, "bid", 8.0), ("B", "1", 1, 5, "ask", 3.0)]
    got = rates.latest_mid(spark.createDataFrame(rows, "symbol string, file_name string, us long, sequence long, side string, price double")).collect()
    assert [(r["symbol"], r["mid"]) for r in got] == [("A", 10.0)]


def test_windows(spark):
    t = spark.createDataFrame([("A", us(60 * m)) for m in range(0, 100, 10)], "symbol string, us long")
    q = spark.createDataFrame([("A", us(60 * m)) for m in range(65, 120, 5)], "symbol string, us long")
    b = windows.bounds(t, q, 30).first()
    assert (b["start_us"], b["end_us"]) == (us(3600), us(5400))
    t2, q2 = windows.calibration_inputs(t, q, 30)
    assert sorted(r["us"] // us(60) for r in t2.collect()) == [70, 80, 90]
    assert (q2.agg(F.min("us")).first()[0], q2.agg(F.max("us")).first()[0]) == (us(65 * 60), us(90 * 60))


GOLDEN = {
    "symmetric": [(-1.934721, 0.226992, -0.227972), (-1.506899, 0.654814, -0.199243), (-1.107806, 0.626085, -0.165504), (-0.742453, 0.592346, -0.122261), (-0.420343, 0.549103, -0.061731), (-0.158762, 0.488573, 0.041087), (0.0, 0.385755, 0.199850)],
    "clamp": [(-2.452043, 0.187045, -0.246546), (-1.924302, 0.714785, -0.225640), (-1.417468, 0.693879, -0.180157), (-0.956116, 0.648397, -0.123725), (-0.551197, 0.591964, -0.049338), (-0.220664, 0.517578, 0.060531), (0.0, 0.407708, 0.281195)],
    "indicator": [(-2.187958, 0.187045, -0.241917), (-1.664847, 0.710156, -0.199641), (-1.184011, 0.667881, -0.148347), (-0.754469, 0.616587, -0.082693), (-0.390581, 0.550932, 0.008852), (-0.118238, 0.459388, 0.162957), (0.0, 0.305283, 0.281195)],
}


def eth(spark, **change):
    row = ETH | change
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if k == 'symbol' else 'double'}" for k in row))


@pytest.mark.parametrize("kind", GOLDEN)
def test_golden_depths(spark, kind):
    grid = control.symmetric(eth(spark)) if kind == "symmetric" else control.asymmetric(eth(spark), boundary=kind)
    got = [(r["h"], r["delta_plus"], r["delta_minus"]) for r in grid.orderBy("q").collect()]
    assert np.allclose(got, GOLDEN[kind], atol=1e-5)


def test_depth_invariants(spark):
    even = dict(kappa_p=5.0, kappa_m=5.0, epsilon_p=0.05, epsilon_m=0.05, lambda_p=0.2, lambda_m=0.2)
    a = [(r["h"], r["delta_plus"], r["delta_minus"]) for r in control.symmetric(eth(spark, **even), 1800.0).orderBy("q").collect()]
    assert np.allclose([x[0] for x in a], [x[0] for x in a[::-1]]) and np.allclose([x[1] for x in a], [x[2] for x in a[::-1]])
    assert np.allclose([a[i][1] + a[i - 1][2] for i in range(1, 7)], 2 / 5 + 0.1)
    same = eth(spark, kappa_p=6.0, kappa_m=6.0)
    b = [r["h"] for r in control.symmetric(same).orderBy("q").collect()]
    c = [r["h"] for r in control.asymmetric(same, boundary="indicator").orderBy("q").collect()]
    assert np.allclose(b, c, atol=1e-4)
    start = control.surface(same, 60.0, 10).where("n = 0").orderBy("q").collect()
    top = max(r["h"] for r in start)
    assert np.allclose([r["h"] - top for r in start], b, atol=1e-6) and math.isinf(start[0]["delta_plus"]) and math.isinf(start[-1]["delta_minus"])


def test_ladder_and_bot_quotes(spark):
    p = eth(spark)
    grid = control.symmetric(p).cache()
    r = quotes.ladder(grid, p).where("q = 0").first()
    assert (r["bid_px"], r["ask_px"]) == pytest.approx((3000 + 0.122261 - 0.9, 3000 + 0.592346 + 0.9), abs=1e-5)
    asked = [("ETH", 9, 3000.0, False, 1.0, 2.0), ("ETH", 0, 3000.0, True, 1.0, 2.0), ("X", 0, 0.0, False, 1.0, 2.0)]
    got = quotes.bot_quotes(spark.createDataFrame(asked, "symbol string, q int, mid double, is_short boolean, proposed_rate double, current_order_rate double"), grid)
    rows = {(x["symbol"], x["q"]): x for x in got.collect()}
    assert rows["ETH", 9]["q_used"] == 3 and rows["ETH", 9]["entry_price"] == pytest.approx(3000 - 0.19985 - 0.9, abs=1e-4)
    assert rows["ETH", 0]["exit_price"] is None
    # A symbol without a grid: null, the proposed rate, the current order's rate.
    x = rows["X", 0]
    assert (x["entry_price"], x["exit_price"], x["adjust_price"], x["bid_bps"]) == (None, 1.0, 2.0, None)
    assert math.isnan(spark.range(1).select(quotes.spread_bps(F.lit(1.0), F.lit(0.0))).first()[0])


def test_journal_report(spark):
    rows = [(1, "a", "s", 0, 5.0, 0.1, "2024-01-01", "2024-01-02"), (2, "a", "s", 0, 0.0, 0.0, "2024-01-01", "2024-01-01"), (3, None, "s", 0, 5.0, 0.2, "2024-01-01", "2024-01-03"), (4, "b", "t", 1, None, None, "2024-01-01", None)]
    j = spark.createDataFrame(rows, "id long, pair string, strategy string, is_open int, close_profit_abs double, close_profit double, o string, c string")
    j = j.withColumns({"open_date": F.to_timestamp("o"), "close_date": F.to_timestamp("c"), "is_short": F.lit(False), "stake_amount": F.lit(1.005), "open_rate": F.lit(2.0)})
    s = report.summary(j).first()
    assert (s["wins"], s["losses"], s["open"], s["profit_pct"], s["mean_duration"]) == (2, 1, 1, pytest.approx(30.0), "1d 0s")
    e = {r["kind"]: r["id"] for r in report.extremes(j).collect()}
    assert e == {"best": 1, "worst": 2}
    assert [r["pair"] for r in report.by_pair(j).collect()] == ["a"]
    assert report.open_trades(j.drop("open_rate")).columns == ["id", "pair", "open_date", "stake_amount", "is_short"]
    empty = report.summary(j.limit(0)).first()
    assert empty["total"] == 0 and empty["win_rate"] is None


def results(spark, rows):
    df = spark.createDataFrame([(i, d, float(p), float(r)) for i, (d, p, r) in enumerate(rows)], "id long, d string, profit_abs double, profit_ratio double")
    return df.withColumn("close_date", F.to_timestamp("d"))


def test_sharpe_loss(spark):
    r = score.sharpe_loss(results(spark, [("2024-01-01", 1, 0.0005), ("2024-01-02", 1, 0.0005)])).first()
    assert r["loss"] == 200.0
    assert math.isnan(score.sharpe_loss(results(spark, [("2024-01-01", 1, 0.1)])).first()["loss"])
    days = score.daily_returns(results(spark, [("2024-01-01", 1, 0.1), ("2024-01-04", 1, 0.1)])).orderBy("day").collect()
    assert [x["ret"] for x in days] == pytest.approx([0.0995, 0, 0, 0.0995])


def test_drawdown(spark):
    r = score.drawdown(results(spark, [("2024-01-01", 10, 0.1), ("2024-01-01", -30, -0.1), ("2024-01-02", 5, 0.1), ("2024-01-03", -10, 0.0)]), 100.0).first()
    assert (r["max_drawdown"], r["max_relative"]) == (35.0, pytest.approx(35 / 110))
    assert score.drawdown(results(spark, [("2024-01-01", -30, 0.1)]), 100.0).first()["max_drawdown"] == 30.0


def test_series(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([float("nan"), None, 2.0, float("inf"), 5.0])], "k int, n int, x double")
    assert [r["x"] for r in series.fill(df, "x", ["k"], "n").orderBy("n").collect()] == [2.0, 2.0, 2.0, 2.0, 5.0]
    n = series.neighbours(df.select("k", "n", F.col("n").cast("double").alias("y")), "y", ["k"], "n").orderBy("n").collect()
    assert (n[0]["y_below"], n[0]["y_above"], n[4]["y_above"]) == (0.0, 1.0, 4.0)
    flat = spark.createDataFrame([(1, i, 3.0, -i, 1, 0) for i in range(4)], "path_id int, n int, pnl double, q int, fills_p int, fills_m int")
    m = series.simulation_metrics(flat, 10.0).first()
    assert (m["final_pnl"], m["fills"], m["max_inventory"], m["sharpe"]) == (3.0, 4, 3, 0.0)
    at = series.sample_times(spark.range(100).select(F.col("id").cast("int").alias("n")), 10.0, 100).select("n", "sample_t")
    assert at.count() == 50 and at.agg(F.max("n")).first()[0] == 99


def test_simulation(spark):
    grid = control.surface(eth(spark), 10.0, 20).cache()
    market = spark.createDataFrame([("ETH", 100.0, 0.1, 5.0, 5.0, 5.0, 5.0, 0.01, 0.01)], "symbol string, " + ", ".join(f"{c} double" for c in simulate.MARKET))
    a = simulate.paths(grid, market, 5, 10.0, 20, 3).orderBy("path_id", "n").toPandas()
    b = simulate.paths(grid, market, 5, 10.0, 20, 3).orderBy("path_id", "n").toPandas()
    assert a.equals(b) and len(a) == 105 and np.allclose(a.pnl, a.x + a.q * a.s)
    last = a[a.n == 20].set_index("path_id").q
    assert (last == (a.groupby("path_id").fills_m.sum() - a.groupby("path_id").fills_p.sum())).all()
    assert a.fills_p.sum() and a.fills_m.sum() and a[a.n == 0].s.eq(100.0).all()
    drawn = spark.range(20_000).select(simulate.poisson(F.lit(3.5), simulate.uniform(1, F.col("id"))).alias("k"), simulate.normal(2, F.col("id")).alias("z"))
    m = drawn.agg(F.avg("k"), F.variance("k"), F.avg("z"), F.stddev("z"), F.min("k")).first()
    assert np.allclose(m, (3.5, 3.5, 0.0, 1.0, 0), atol=0.1)
    lines = series.dashboard(simulate.paths(grid, market, 2, 10.0, 20, 3), 10.0, 20).toPandas()
    assert len(lines) == 42 and lines.t.max() == 10.0 and (lines.groupby("path_id").sold.max() == a[a.path_id < 2].groupby("path_id").fills_p.sum()).all()
    shown = series.surface_samples(grid, 10.0, 20, 5)
    assert shown.select("sample_t").distinct().count() == 5 and shown.where("q = -3 and delta_plus is null").count() == 5
    assert {r["q"] for r in series.depth_lines(grid, -3, 3).select("q").distinct().collect()} == {-3, -2, 0, 1, 3}
    fit = simulate.calibrate(simulate.observations(spark, 50.0, 60.0, 0.02, 1), simulate.jumps(spark, 0.005, 0.02, 3)).first()
    assert fit["kappa"] == pytest.approx(60, rel=0.1) and fit["lambda"] == pytest.approx(50, rel=0.1) and fit["epsilon"] == pytest.approx(0.005, rel=0.4)
    p = spark.range(1).select(simulate.fill_probability(F.lit(-1.0), F.lit(2.0)), simulate.fill_probability(F.lit(1.0), F.lit(2.0))).first()
    assert p[0] == 1.0 and p[1] == pytest.approx(math.exp(-2))


def test_scalars(spark):
    r = spark.range(1).select(scalars.duration_text(F.lit(93784)), scalars.duration_text(F.lit(0)), scalars.sign_class(F.lit("-1.5 USDC")), scalars.sign_class(F.lit("n/a")), scalars.name_list(F.lit("a, ,b")), scalars.linspace(F.lit(0.0), F.lit(1.0), 5), scalars.clip(F.lit(9.0), 0.0, 1.0)).first()
    assert list(r) == ["1d 2h 3m 4s", "0s", "loss", None, ["a", "b"], [0.0, 0.25, 0.5, 0.75, 1.0], 1.0]
