"""Registered queries of the analytics library over the test tables, and the SQL that each is held against.

Ticks are stand-ins (see ``tidemark.sources.standin``): gaps are minutes, so lags are 500 s and impact windows an hour.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import control, impact, kappa, normalise, quotes, rates, report, score, series, simulate, windows
from tidemark.sources import standin, ticks

MINUTES = 30 * 24 * 60
LAG_US = 500_000_000
HOUR_US = 3_600_000_000
BALANCE = 1_000_000.0
HORIZON, STEPS, PATHS = 30.0, 50, 16


def _r(c: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """Rounded, without a negative zero."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, digits) + F.lit(0.0)).alias(name or c)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[_r(c, digits) if t == "double" else F.col(c) for c, t in df.dtypes])


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return windows.calibration_inputs(standin.trades(spark, d), standin.quotes(spark, d), MINUTES)


def _depths(spark, d):
    return kappa.trade_depths(*_inputs(spark, d), LAG_US)


def _hist(spark, d):
    return kappa.histogram(_depths(spark, d), 20, MINUTES * 60)


def _impacts(spark, d):
    return impact.impacts(*_inputs(spark, d), HOUR_US, HOUR_US)


def raw_lambda(spark, d):
    t = standin.trades(spark, d)
    return _rounded(rates.raw_lambda(windows.within(t, windows.bounds(t, None, MINUTES))), 9)


def latest_mid(spark, d):
    return _rounded(rates.latest_mid(ticks.newest_shards(standin.prices(spark, d))))


def newest_shards(spark, d):
    return ticks.newest_shards(standin.prices(spark, d), 3).groupBy("symbol", "file_name", "side").agg(F.count("*").alias("n"), F.max("us").alias("last_us"))


def window_bounds(spark, d):
    t, q = standin.trades(spark, d), standin.quotes(spark, d)
    wide = windows.bounds(t, q, MINUTES)
    shared = windows.overlap(*windows.last_minutes(t, q, MINUTES))
    return wide.join(shared.select("symbol", F.col("start_us").alias("overlap_start_us"), F.col("end_us").alias("overlap_end_us")), "symbol")


def trade_depths(spark, d):
    return _rounded(_depths(spark, d))


def depth_histogram(spark, d):
    return _rounded(_hist(spark, d), 9)


def kappa_fit(spark, d):
    return _rounded(kappa.fit(_hist(spark, d)))


def kappa_fit_ols(spark, d):
    return _rounded(kappa.fit_ols(_hist(spark, d)))


def kappa_fit_nonlinear(spark, d):
    return kappa.fit_nonlinear(_hist(spark, d)).select("symbol", "side", *[_r(c, 4) for c in ("kappa", "lambda_0", "r2")], _r("std_error", 1), "n_points")


def impacts(spark, d):
    return _rounded(_impacts(spark, d))


def epsilon_estimates(spark, d):
    return _rounded(impact.estimates(_impacts(spark, d)))


def impact_histogram(spark, d):
    return _rounded(impact.impact_histogram(_impacts(spark, d)))


def size_impact(spark, d):
    t, q = _inputs(spark, d)
    sized = t.withColumn("size", (F.col("trade_id") % 9 + 1).cast("double"))
    return _rounded(impact.size_impact(impact.impacts(sized, q, HOUR_US, HOUR_US, ("size",))))


def parameter_join(spark, d):
    """Symbols that lack one side's kappa, epsilon or rates."""
    p = standin.params(spark, d).withColumn("k", F.substring("symbol", 2, 9).cast("int"))
    some = lambda c, rest: F.when(F.col("k") % 6 != rest, F.col(c)).alias(c)
    k, e = p.select("symbol", some("kappa_p", 1), "kappa_m"), p.select("symbol", "epsilon_p", some("epsilon_m", 2))
    return _rounded(quotes.parameters(k, e, p.where("k % 6 <> 3").select("symbol", some("lambda_p", 4), "lambda_m"), p.where("k % 6 <> 5")))


def spread_log_bps(spark, d):
    mid = F.col("mid") - 100
    return standin.params(spark, d).select("symbol", (F.isnan(quotes.spread_bps(F.col("epsilon_p"), mid))).alias("undefined"), _r(series.finite(quotes.spread_bps(F.col("epsilon_p"), mid)), 6, "bps"))


def toxicity(spark, d):
    return _rounded(impact.toxicity(standin.params(spark, d)))


def static_spread(spark, d):
    return _rounded(impact.static_spread(standin.params(spark, d)))


def one_side_optimum(spark, d):
    p = standin.params(spark, d)
    dh = (F.col("mid") - 100) / 400
    free, clipped = (control.one_side(F.col("lambda_p"), F.col("kappa_p"), F.col("epsilon_p"), dh, c) for c in (False, True))
    return _rounded(p.select("symbol", free[0].alias("depth"), free[1].alias("value"), clipped[0].alias("clipped_depth"), clipped[1].alias("clipped_value")))


def hjb_symmetric(spark, d):
    return _rounded(control.symmetric(standin.params(spark, d)))


def hjb_asymmetric(spark, d):
    return _rounded(control.asymmetric(standin.params(spark, d)))


def _finite(df: DataFrame) -> DataFrame:
    return _rounded(df.select(*[series.finite(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]))


def hjb_surface(spark, d):
    return _finite(control.surface(standin.params(spark, d), HORIZON, STEPS))


def time_samples(spark, d):
    return _rounded(series.surface_samples(control.surface(standin.params(spark, d), HORIZON, STEPS), HORIZON, STEPS, 20))


def depth_lines(spark, d):
    return _rounded(series.depth_lines(control.surface(standin.params(spark, d), HORIZON, STEPS), -3, 3))


def quote_ladder(spark, d):
    p = standin.params(spark, d)
    return _rounded(quotes.ladder(control.symmetric(p), p))


def bot_quotes(spark, d):
    p = standin.params(spark, d)
    key = F.substring("symbol", 2, 9).cast("int")
    asked = p.select("symbol", F.explode(F.sequence(F.lit(-5), F.lit(5))).alias("q"), "mid", (key % 5 == 0).alias("is_short"), (F.col("mid") * 1.01).alias("proposed_rate"), (F.col("mid") * 0.99).alias("current_order_rate"))
    return _rounded(quotes.bot_quotes(asked, control.symmetric(p)))


def entry_signals(spark, d):
    key = F.substring("symbol", 2, 9).cast("int")
    p = standin.params(spark, d).select("symbol", key.alias("k"))
    ready = p.where("k % 7 <> 6").select("symbol", (F.col("k") % 2 == 0).alias("kappa"), (F.col("k") % 3 != 0).alias("epsilon"), F.lit(True).alias("depths"), (F.col("k") < 20).alias("data"))
    return quotes.entry_signals(p.select("symbol"), ready)


def inventory_level(spark, d):
    return quotes.inventory_level(standin.journal(spark, d))


def trade_summary(spark, d):
    return _rounded(report.summary(standin.journal(spark, d)), 2)


def trade_extremes(spark, d):
    return _rounded(report.extremes(standin.journal(spark, d)), 2)


def pnl_by_pair(spark, d):
    return report.by_pair(standin.journal(spark, d)).select("pair", _r("total_profit", 2), "n", _r("mean_profit"))


def pnl_by_strategy(spark, d):
    return report.by_strategy(standin.journal(spark, d)).select("strategy", _r("total_profit", 2), "n")


def open_trades(spark, d):
    return report.open_trades(standin.journal(spark, d))


def _results(spark, d):
    j = standin.journal(spark, d).where("is_open = 0")
    return j.select("id", F.col("close_profit_abs").alias("profit_abs"), F.col("close_profit").alias("profit_ratio"), "close_date")


def daily_returns(spark, d):
    return score.daily_returns(_results(spark, d)).select(F.col("day").cast("string").alias("day"), _r("ret"))


def sharpe_loss(spark, d):
    return score.sharpe_loss(_results(spark, d)).select("n_trades", _r("sharpe"), _r("loss", 3))


def drawdown(spark, d):
    return score.drawdown(_results(spark, d), BALANCE).select(*[_r(c, n) for c, n in (("total_profit", 1), ("median_ratio", 6), ("win_rate", 6), ("max_drawdown", 1), ("max_relative", 6), ("profit_pc", 5), ("ddc", 5))])


def _messages(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.concat(F.lit("S"), F.col("user_id") % 4).alias("symbol"))


def _level(factor: float, k: int = 0) -> Column:
    return F.struct((F.col("value") * factor + k).cast("string").alias("px"), (F.col("event_id") % 10).cast("string").alias("sz"))


def bbo_explode(spark, d):
    m = _messages(spark, d).where("event_type in ('view', 'click')")
    data = F.struct(F.col("symbol").alias("coin"), F.col("us").alias("time"), F.array(_level(0.999), _level(1.001)).alias("bbo"))
    channel = F.to_json(F.struct(F.lit("bbo").alias("channel"), data.alias("data")))
    direct = F.to_json(F.struct(F.col("symbol").alias("coin"), F.col("us").alias("time"), F.when(F.col("event_id") % 3 != 0, _level(0.999)).alias("bid"), _level(1.001).alias("ask")))
    raw = m.select((F.col("us") / 1e6).alias("timestamp"), F.when(F.col("event_type") == "view", channel).otherwise(direct).alias("value"))
    return normalise.bbo_rows(raw).select("symbol", "exchange_timestamp", "side", _r("price"), _r("size"))


def trade_normalise(spark, d):
    m = _messages(spark, d).where("event_type in ('purchase', 'signup')")
    t = F.struct(F.col("symbol").alias("coin"), F.when(F.col("event_type") == "signup", "A").otherwise("B").alias("side"), F.col("value").cast("string").alias("px"), F.lit("1.5").alias("sz"), F.when(F.col("event_id") % 4 != 0, F.col("event_id")).alias("tid"), F.col("us").alias("time"))
    many = F.to_json(F.struct(F.lit("trades").alias("channel"), F.array(t, t).alias("data")))
    raw = m.select((F.col("us") / 1e6).alias("timestamp"), F.when(F.col("event_id") % 2 == 0, many).otherwise(F.to_json(F.array(t))).alias("value"))
    return normalise.trade_rows(raw).select("symbol", "exchange_timestamp", "side", "trade_id", _r("price"), _r("size"))


def book_flatten(spark, d):
    m = _messages(spark, d).where("event_type = 'view'")
    bids, asks = F.array(_level(0.999), _level(0.999, -1)), F.array(_level(1.001), _level(1.001, 1), _level(1.001, 2), _level(1.001, 3))
    data = F.struct(F.col("symbol").alias("coin"), F.col("us").alias("time"), F.array(bids, asks).alias("levels"))
    raw = m.select((F.col("us") / 1e6).alias("timestamp"), F.to_json(F.struct(F.lit("l2Book").alias("channel"), data.alias("data"))).alias("value"))
    return _rounded(normalise.book_rows(raw, 3).drop("timestamp"))


def ingest_rates(spark, d):
    m = _messages(spark, d).select("symbol", "us", F.when(F.col("event_type").isin("view", "click"), "prices").otherwise("trades").alias("kind"))
    return _rounded(rates.ingest_rates(m))


def _series(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 4).alias("path_id"), F.col("event_id").alias("n"), "value")


def fill_ffill(spark, d):
    s = _series(spark, d)
    holes = F.when(F.col("n") % 5 == 0, float("nan")).when(F.col("n") % 7 == 0, float("inf")).when(F.col("n") % 11 != 0, F.col("value"))
    return _rounded(series.fill(s.select("path_id", "n", holes.alias("x")), "x", ["path_id"], "n"))


def neighbour_shift(spark, d):
    return _rounded(series.neighbours(_series(spark, d), "value", ["path_id"], "n"))


def _paths(spark, d):
    return _series(spark, d).select("path_id", "n", F.col("value").alias("pnl"), (F.col("n") % 7 - 3).alias("q"), (F.col("n") % 2).alias("fills_p"), (F.col("n") % 3).alias("fills_m"))


def cumulative_fills(spark, d):
    return series.cumulative(_paths(spark, d), ["fills_p", "fills_m"], ["path_id"], "n").select("path_id", "n", "cum_fills_p", "cum_fills_m")


def sim_metrics(spark, d):
    return _rounded(series.simulation_metrics(_paths(spark, d), 30.0))


def _simulated(spark, d):
    p = standin.params(spark, d)
    markets = p.withColumns({"s0": F.col("mid"), "sigma": F.lit(0.01)})
    return simulate.paths(control.surface(p, HORIZON, STEPS), markets, PATHS, HORIZON, STEPS, 7)


def simulated_paths(spark, d):
    return _rounded(series.simulation_metrics(_simulated(spark, d), HORIZON, ("symbol", "path_id")))


def dashboard_series(spark, d):
    return _rounded(series.dashboard(_simulated(spark, d), HORIZON, STEPS))


_SYNTHETIC = (50.0, 60.0, 0.1, 1)


def synthetic_calibration(spark, d):
    return simulate.calibrate(simulate.observations(spark, *_SYNTHETIC), simulate.jumps(spark, 0.005, 0.1, 3)).select(_r("kappa", 4), _r("lambda", 4), _r("epsilon", 9))


def model_curves(spark, d):
    return _rounded(series.model_curves(simulate.observations(spark, *_SYNTHETIC), F.lit(49.5), F.lit(59.8)), 9)


def fill_probability(spark, d):
    p = standin.params(spark, d)
    return _rounded(p.select("symbol", simulate.fill_probability((F.col("mid") - 100) / 200, F.col("kappa_p")).alias("prob")))


def scalar_functions(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    text = F.concat(F.round(F.col("o_totalprice") - 250000).cast("long").cast("string"), F.when(k % 2 == 0, "%").otherwise(" USDC"))
    return o.select("o_orderkey", scalars.duration_text(k * 37 % 200000).alias("duration"), scalars.sign_class(text).alias("sign"), scalars.pair_symbol(F.concat(F.col("o_orderpriority"), F.lit("/USDC:USDC"))).alias("symbol"), F.array_join(scalars.name_list(F.concat(F.lit(" a, ,b"), F.lit(","), k.cast("string"))), "|").alias("names"))


_QUERY_NAMES = (
    "raw_lambda latest_mid newest_shards window_bounds trade_depths depth_histogram kappa_fit kappa_fit_ols kappa_fit_nonlinear impacts epsilon_estimates impact_histogram size_impact parameter_join spread_log_bps toxicity static_spread "
    "one_side_optimum hjb_symmetric hjb_asymmetric hjb_surface time_samples depth_lines quote_ladder bot_quotes entry_signals inventory_level trade_summary trade_extremes pnl_by_pair pnl_by_strategy open_trades "
    "daily_returns sharpe_loss drawdown book_flatten bbo_explode trade_normalise ingest_rates fill_ffill neighbour_shift cumulative_fills sim_metrics simulated_paths dashboard_series "
    "synthetic_calibration model_curves fill_probability scalar_functions"
).split()
QUERIES = {n: globals()[n] for n in _QUERY_NAMES}

# -- the same in SQL --------------------------------------------------------------------------------------------------

_TICKS = """ev AS (SELECT event_id, event_type, value, epoch_us(ts) AS us, 'S' || (user_id % 4) AS symbol FROM events),
t AS (SELECT symbol, us, CASE WHEN event_type = 'purchase' THEN 'buy' ELSE 'sell' END AS side, value AS price, event_id AS trade_id FROM ev WHERE event_type IN ('purchase', 'signup')),
q AS (SELECT symbol, us, value * 0.999::DOUBLE AS bid, value * 1.001::DOUBLE AS ask, event_id AS sequence FROM ev WHERE event_type IN ('view', 'click'))"""
_SPAN = MINUTES * 60_000_000
_CUT = f"""{_TICKS},
lim AS (SELECT b.symbol, coalesce(least(b.m, a.m), b.m) AS e FROM (SELECT symbol, max(us) m FROM q GROUP BY 1) b LEFT JOIN (SELECT symbol, max(us) m FROM t GROUP BY 1) a USING (symbol)),
t1 AS (SELECT t.* FROM t JOIN lim USING (symbol) WHERE us BETWEEN e - {_SPAN} AND e),
q1 AS (SELECT q.* FROM q JOIN lim USING (symbol) WHERE us BETWEEN e - {_SPAN} AND e),
ov AS (SELECT symbol, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM (SELECT symbol, min(us) lo, max(us) hi FROM t1 GROUP BY 1) a JOIN (SELECT symbol, min(us) lo, max(us) hi FROM q1 GROUP BY 1) b USING (symbol)),
t2 AS (SELECT t1.* FROM t1 JOIN ov USING (symbol) WHERE us BETWEEN lo AND hi),
q2 AS (SELECT q1.* FROM q1 JOIN ov USING (symbol) WHERE us BETWEEN lo AND hi)"""
_DEPTHS = f"""{_CUT},
dep AS (SELECT * FROM (SELECT t2.symbol, t2.side, t2.us, t2.trade_id, t2.price, q2.sequence, CASE WHEN t2.side = 'buy' THEN t2.price - q2.ask ELSE q2.bid - t2.price END AS depth
        FROM t2 ASOF JOIN q2 ON t2.symbol = q2.symbol AND t2.us - {LAG_US} >= q2.us) WHERE depth >= 0)"""
_HIST = f"""{_DEPTHS},
cut AS (SELECT symbol, side, quantile_cont(depth, 0.99) AS c FROM dep GROUP BY 1, 2),
kept AS (SELECT symbol, side, depth FROM dep JOIN cut USING (symbol, side) WHERE depth <= c),
top AS (SELECT symbol, side, max(depth) AS top, max(depth) / 20 AS width FROM kept GROUP BY 1, 2 HAVING count(*) >= 10),
b AS (SELECT symbol, side, top, width, depth, floor(depth / nullif(width, 0)) AS g FROM kept JOIN top USING (symbol, side)),
n AS (SELECT symbol, side, CASE WHEN top = 0 THEN 19 ELSE least(CASE WHEN depth < g * width THEN g - 1 WHEN depth >= (g + 1) * width THEN g + 1 ELSE g END, 19) END::INTEGER AS bin, count(*) AS n FROM b GROUP BY 1, 2, 3),
hist AS (SELECT symbol, side, bin, (bin * width + (bin + 1) * width) / 2 AS center, coalesce(n, 0) AS "count", coalesce(n, 0) / {MINUTES * 60}.0::DOUBLE AS intensity
         FROM (SELECT symbol, side, width, unnest(range(20))::INTEGER AS bin FROM top) LEFT JOIN n USING (symbol, side, bin))"""
_FIT = f"""{_HIST},
p AS (SELECT *, "count"::DOUBLE AS w, center AS x, ln(intensity) AS y FROM hist WHERE "count" > 0),
s AS (SELECT symbol, side, count(*) AS n, sum(w) sw, sum(w*x) sx, sum(w*y) sy, sum(w*x*x) sxx, sum(w*x*y) sxy FROM p GROUP BY 1, 2),
l AS (SELECT *, CASE WHEN n >= 3 THEN (sw*sxy - sx*sy) / nullif(sw*sxx - sx*sx, 0) END AS b, sy / sw AS ym FROM s),
l2 AS (SELECT *, (sy - b*sx) / sw AS a FROM l),
f AS (SELECT symbol, side, max(n) AS n_points, max(a) AS a, max(b) AS b, sum(w*(y-a-b*x)*(y-a-b*x)) AS res, sum(w*(y-ym)*(y-ym)) AS tot FROM p JOIN l2 USING (symbol, side) GROUP BY 1, 2)"""
_IMPACTS = f"""{_CUT},
m AS (SELECT symbol, us, (bid + ask) / 2 AS mid FROM q2),
pre AS (SELECT t2.*, m.us AS pus, m.mid AS pmid FROM t2 ASOF JOIN m ON t2.symbol = m.symbol AND t2.us > m.us),
post AS (SELECT pre.*, m.us AS fus, m.mid AS fmid FROM pre ASOF JOIN m ON pre.symbol = m.symbol AND pre.us < m.us),
imp AS (SELECT symbol, side, us, trade_id, CASE WHEN side = 'buy' THEN fmid - pmid ELSE -(fmid - pmid) END AS impact FROM post WHERE pus >= us - {HOUR_US} AND fus <= us + {HOUR_US})"""
_PARAMS = """p AS (SELECT 'S' || n_nationkey AS symbol, n_nationkey AS k, 4.0::DOUBLE + 0.5::DOUBLE * (n_nationkey % 7) AS kappa_p, 3.5::DOUBLE + 0.75::DOUBLE * (n_nationkey % 5) AS kappa_m,
0.1::DOUBLE + 0.05::DOUBLE * (n_nationkey % 6) AS lambda_p, 0.12::DOUBLE + 0.04::DOUBLE * (n_nationkey % 4) AS lambda_m, 0.01::DOUBLE + 0.02::DOUBLE * (n_nationkey % 5) AS epsilon_p,
0.02::DOUBLE + 0.01::DOUBLE * (n_nationkey % 6) AS epsilon_m, 50.0::DOUBLE + 25.0::DOUBLE * (n_nationkey % 9) AS mid FROM nation)"""
_HJB = f"""{_PARAMS},
c AS (SELECT *, greatest(1e-8, (kappa_p + kappa_m) / 2) AS kk FROM p),
g AS (SELECT *, lambda_p * exp(-1 - kk * epsilon_p) AS down, lambda_m * exp(-1 - kk * epsilon_m) AS up, kk * (lambda_p * epsilon_p - lambda_m * epsilon_m) AS drift FROM c),
a AS (SELECT *, list_transform(range(-3, 4), lambda x: x * drift + 3 * abs(drift)) AS diag FROM g),
it AS (SELECT symbol, 0 AS n, [1.0::DOUBLE, 1, 1, 1, 1, 1, 1] AS term, [1.0::DOUBLE, 1, 1, 1, 1, 1, 1] AS acc FROM a
  UNION ALL
  SELECT symbol, n + 1, nt, list_transform(range(1, 8), lambda i: acc[i] + nt[i]) FROM (
    SELECT it.symbol, n, acc, list_transform(range(1, 8), lambda i: (diag[i] * term[i] + down * CASE WHEN i > 1 THEN term[i - 1] ELSE 0 END + up * CASE WHEN i < 7 THEN term[i + 1] ELSE 0 END) * 60.0::DOUBLE / (n + 1)) AS nt
    FROM it JOIN a USING (symbol) WHERE n < 300)),
w AS (SELECT symbol, unnest(range(-3, 4))::INTEGER AS q, unnest(acc) AS omega FROM it WHERE n = 300),
h0 AS (SELECT symbol, q, ln(omega) / kk AS lg, kk, epsilon_p, epsilon_m FROM w JOIN a USING (symbol)),
h AS (SELECT symbol, q, lg - max(lg) OVER (PARTITION BY symbol) AS h, kk, epsilon_p, epsilon_m FROM h0),
hjb AS (SELECT symbol, q, h, 1 / kk + epsilon_p - (coalesce(lag(h) OVER o, h) - h) AS delta_plus, 1 / kk + epsilon_m - (coalesce(lead(h) OVER o, h) - h) AS delta_minus FROM h WINDOW o AS (PARTITION BY symbol ORDER BY q))"""
def _newton() -> str:
    """The asymmetric problem as a recursion over Newton's iterations: old and new values of seven grid points."""
    q = range(1, 8)
    down = {i: f"(n{i - 1} - n{i})" if i > 1 else "0.0::DOUBLE" for i in q}
    up = {i: f"(n{i + 1} - n{i})" if i < 7 else "0.0::DOUBLE" for i in q}
    each = lambda f: ", ".join(f(i) for i in q)
    top = lambda c: f"greatest({each(lambda i: f'{c}{i}')})"
    far = lambda e: f"greatest({each(lambda i: f'abs({e(i)})')}) < 1e-8"
    layers = [
        each(lambda i: f"lambda_p / kappa_p * exp(-kappa_p * (1 / kappa_p + epsilon_p - {down[i]})) AS vp{i}, lambda_m / kappa_m * exp(-kappa_m * (1 / kappa_m + epsilon_m - {up[i]})) AS vm{i}"),
        each(lambda i: f"n{i} - o{i} - 0.3::DOUBLE * (vp{i} + vm{i} + {i - 4} * (lambda_p * epsilon_p - lambda_m * epsilon_m)) AS f{i}, {f'-0.3::DOUBLE * kappa_p * vp{i}' if i > 1 else '0.0::DOUBLE'} AS l{i}, {f'-0.3::DOUBLE * kappa_m * vm{i}' if i < 7 else '0.0::DOUBLE'} AS u{i}"),
        "u1 / (1 - l1 - u1) AS c1, -f1 / (1 - l1 - u1) AS d1",  # Thomas' algorithm: forward
        *[x for i in q if i > 1 for x in (f"1 - l{i} - u{i} - l{i} * c{i - 1} AS m{i}", f"u{i} / m{i} AS c{i}, (-f{i} - l{i} * d{i - 1}) / m{i} AS d{i}")],
        "d7 AS s7",  # and back
        *[f"d{i} - c{i} * s{i + 1} AS s{i}" for i in range(6, 0, -1)],
        each(lambda i: f"n{i} + 0.7::DOUBLE * s{i} AS w{i}"),
        f"{top('w')} AS wx, {far(lambda i: f'f{i}')} AS still",
        each(lambda i: f"w{i} - wx AS t{i}"),
        f"{each(lambda i: f'CASE WHEN still THEN n{i} ELSE t{i} END AS r{i}')}, still OR itr = 49 OR {far(lambda i: f't{i} - n{i}')} AS fin",
        f"{top('r')} AS mx",
    ]
    inner = "SELECT * FROM nt JOIN p USING (symbol) WHERE stp < 200"
    for layer in layers:
        inner = f"SELECT *, {layer} FROM ({inner})"
    return f"""{_PARAMS},
nt AS (SELECT symbol, 0 AS stp, 0 AS itr, {each(lambda i: f"0.0::DOUBLE AS o{i}")}, {each(lambda i: f"0.0::DOUBLE AS n{i}")} FROM p
  UNION ALL
  SELECT symbol, stp + fin::INTEGER, CASE WHEN fin THEN 0 ELSE itr + 1 END, {each(lambda i: f"CASE WHEN fin THEN r{i} - mx ELSE o{i} END")}, {each(lambda i: f"CASE WHEN fin THEN r{i} - mx ELSE r{i} END")} FROM ({inner})),
asy AS (SELECT symbol, kappa_p, kappa_m, epsilon_p, epsilon_m, unnest(range(-3, 4))::INTEGER AS q, unnest([{each(lambda i: f"n{i}")}]) AS h FROM nt JOIN p USING (symbol) WHERE stp = 200),
asd AS (SELECT symbol, q, h, 1 / kappa_p + epsilon_p - (coalesce(lag(h) OVER o, h) - h) AS delta_plus, 1 / kappa_m + epsilon_m - (coalesce(lead(h) OVER o, h) - h) AS delta_minus FROM asy WINDOW o AS (PARTITION BY symbol ORDER BY q))"""


_SURFACE = f"""{_PARAMS},
c AS (SELECT *, greatest(1e-8, (kappa_p + kappa_m) / 2) AS kk FROM p),
g AS (SELECT *, lambda_p * exp(-1 - kk * epsilon_p) AS down, lambda_m * exp(-1 - kk * epsilon_m) AS up, kk * (lambda_p * epsilon_p - lambda_m * epsilon_m) AS drift FROM c),
a AS (SELECT *, 3 * abs(drift) AS cc, list_transform(range(-3, 4), lambda x: x * drift + 3 * abs(drift)) AS diag, unnest(range({STEPS + 1}))::INTEGER AS n, ({STEPS} - n) * {HORIZON / STEPS}::DOUBLE AS tau FROM g),
it AS (SELECT symbol, n, 0 AS r, [1.0::DOUBLE, 1, 1, 1, 1, 1, 1] AS term, [1.0::DOUBLE, 1, 1, 1, 1, 1, 1] AS acc FROM a
  UNION ALL
  SELECT symbol, n, r + 1, nx, list_transform(range(1, 8), lambda i: acc[i] + nx[i]) FROM (
    SELECT it.symbol, it.n, r, acc, list_transform(range(1, 8), lambda i: (diag[i] * term[i] + down * CASE WHEN i > 1 THEN term[i - 1] ELSE 0 END + up * CASE WHEN i < 7 THEN term[i + 1] ELSE 0 END) * tau / (r + 1)) AS nx
    FROM it JOIN a ON it.symbol = a.symbol AND it.n = a.n WHERE r < 150)),
w AS (SELECT symbol, n, unnest(range(-3, 4))::INTEGER AS q, unnest(acc) AS omega FROM it WHERE r = 150),
sf AS (SELECT w.symbol, w.n, w.n * {HORIZON / STEPS}::DOUBLE AS t, q, (ln(omega) - cc * tau) / kk AS h, kk, epsilon_p, epsilon_m FROM w JOIN a ON w.symbol = a.symbol AND w.n = a.n),
srf AS (SELECT symbol, n, t, q, h, 1 / kk + epsilon_p - (lag(h) OVER o - h) AS delta_plus, 1 / kk + epsilon_m - (lead(h) OVER o - h) AS delta_minus FROM sf WINDOW o AS (PARTITION BY symbol, n ORDER BY q))"""


def _u(*parts: str) -> str:
    """The uniform number of some parts."""
    return f"((('0x' || substr(md5(concat_ws('-', {', '.join(parts)})), 1, 12))::BIGINT + 0.5::DOUBLE) / {1 << 48}::DOUBLE)"


def _gauss(*parts: str) -> str:
    return f"""(sqrt(-2 * ln({_u(*parts, "'a'")})) * cos({2 * math.pi!r}::DOUBLE * {_u(*parts, "'b'")}))"""


_DT = HORIZON / STEPS
_MASSES = f"list_transform(range(0, 60), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(-m) * pow(m, j) / gamma(j + 1))))"
_COINS = lambda s: f"list_transform(range(1, c_{s} + 1), lambda j: {_u('7', 'symbol', 'path_id', 'n', repr(s), 'j')})"
_SIMULATED = f"""{_SURFACE},
cdf AS (SELECT symbol, side, {_MASSES} AS l FROM (SELECT symbol, 'p' AS side, lambda_p * {_DT}::DOUBLE AS m FROM p UNION ALL SELECT symbol, 'm', lambda_m * {_DT}::DOUBLE FROM p)),
dr AS (SELECT symbol, path_id, n, {", ".join(f"(SELECT len(list_filter(l, lambda x: x < u_{s})) FROM cdf WHERE cdf.symbol = z.symbol AND side = '{s}') AS c_{s}" for s in "pm")}, w FROM (
  SELECT symbol, path_id, n, {", ".join(f"{_u('7', 'symbol', 'path_id', 'n', repr(s))} AS u_{s}" for s in "pm")}, {_gauss("7", "symbol", "path_id", "n", "'w'")} AS w
  FROM (SELECT symbol, unnest(range({PATHS})) AS path_id FROM p), (SELECT unnest(range({STEPS})) AS n)) z),
cn AS (SELECT symbol, path_id, n, c_p, c_m, w, {_COINS("p")} AS up, {_COINS("m")} AS um FROM dr),
gr AS (SELECT symbol, n, list(coalesce(delta_plus, 'inf'::DOUBLE) ORDER BY q) AS ask, list(coalesce(delta_minus, 'inf'::DOUBLE) ORDER BY q) AS bid FROM srf GROUP BY 1, 2),
wk AS (SELECT symbol, path_id, 0 AS n, mid AS s, 0 AS q, 0.0::DOUBLE AS x, 0 AS fp, 0 AS fm FROM p, (SELECT unnest(range({PATHS})) AS path_id)
  UNION ALL
  SELECT symbol, path_id, n + 1, s + c_p * epsilon_p - c_m * epsilon_m + 0.01::DOUBLE * sqrt({_DT}::DOUBLE) * w, q + gm - gp, x + CASE WHEN gp > 0 THEN gp * (s + dp) ELSE 0 END - CASE WHEN gm > 0 THEN gm * (s - dm) ELSE 0 END, gp, gm FROM (
    SELECT *, len(list_filter(up, lambda v: v < CASE WHEN dp <= 0 THEN 1 ELSE exp(-kappa_p * dp) END))::INTEGER AS gp, len(list_filter(um, lambda v: v < CASE WHEN dm <= 0 THEN 1 ELSE exp(-kappa_m * dm) END))::INTEGER AS gm FROM (
      SELECT wk.symbol, wk.path_id, wk.n, s, wk.q, x, c_p, c_m, w, up, um, kappa_p, kappa_m, epsilon_p, epsilon_m, ask[greatest(-3, least(3, wk.q)) + 4] AS dp, bid[greatest(-3, least(3, wk.q)) + 4] AS dm
      FROM wk JOIN cn ON wk.symbol = cn.symbol AND wk.path_id = cn.path_id AND wk.n = cn.n JOIN gr ON gr.symbol = wk.symbol AND gr.n = wk.n JOIN p ON p.symbol = wk.symbol))),
pt AS (SELECT symbol, path_id, n, s, lead(q, 1, q) OVER o AS q, lead(x, 1, x) OVER o AS x, lead(fp, 1, 0) OVER o AS fills_p, lead(fm, 1, 0) OVER o AS fills_m FROM wk WINDOW o AS (PARTITION BY symbol, path_id ORDER BY n)),
pp AS (SELECT *, x + q * s AS pnl FROM pt)"""


def _zoom(points: str, keys: str, low: float, high: float, least: float, most: str, first: str) -> str:
    """Tables za and zb: the best k of ``a exp(-k x)`` for the lists xs, ys of ``points``, on grids that narrow around the best."""
    loss = f"""SELECT *, list_sum(list_transform(range(1, len(xs) + 1), lambda i: (ys[i] - a * exp(-k * xs[i])) * (ys[i] - a * exp(-k * xs[i])))) AS loss FROM (
        SELECT *, least({most}, greatest({least}::DOUBLE, list_dot_product(list_transform(xs, lambda x: exp(-k * x)), ys) / list_sum(list_transform(xs, lambda x: exp(-2 * k * x))))) AS a FROM %s)"""
    pick = f"SELECT {keys}, any_value(xs) AS xs, any_value(ys) AS ys, arg_min(k, loss) AS k, arg_min(a, loss) AS a, arg_min(b, loss) AS b, arg_min(e, loss) AS e FROM (%s) GROUP BY {keys}"
    start = f"(SELECT *, coalesce(lag(k) OVER o, k) AS b, coalesce(lead(k) OVER o, k) AS e FROM (SELECT *, unnest({first}) AS k FROM {points}) WINDOW o AS (PARTITION BY {keys} ORDER BY k))"
    out = [f"z0 AS ({pick % (loss % start)})"]
    for i in range(1, 6):
        grid = f"(SELECT {keys}, xs, ys, greatest({low}::DOUBLE, b + (e - b) * j / 100) AS k, greatest({low}::DOUBLE, b + (e - b) * (j - 1) / 100) AS b, least({high}::DOUBLE, b + (e - b) * (j + 1) / 100) AS e FROM (SELECT *, unnest(range(101)) AS j FROM z{i - 1}))"
        out.append(f"z{i} AS ({pick % (loss % grid)})")
    return ",\n".join(out)


_JOURNAL = """j AS (SELECT o_orderkey AS id, o_orderpriority AS pair, 'C' || (o_custkey % 3) AS strategy, (o_orderstatus = 'O')::INTEGER AS is_open, o_orderdate AS open_date,
CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_days((1 + o_orderkey % 90)::INTEGER) END AS close_date,
CASE WHEN o_orderstatus <> 'O' THEN (o_totalprice - 250000) / o_totalprice END AS close_profit, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice - 250000 END AS close_profit_abs,
o_totalprice AS stake_amount, o_totalprice / 100 AS open_rate FROM orders)"""
_DAILY = f"""{_JOURNAL},
r AS (SELECT id, close_profit_abs AS profit_abs, close_profit AS profit_ratio, close_date FROM j WHERE is_open = 0),
ds AS (SELECT close_date::DATE AS day, sum(profit_ratio - 0.0005::DOUBLE) AS ret FROM r GROUP BY 1),
cal AS (SELECT unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM ds),
daily AS (SELECT day, coalesce(ret, 0.0) AS ret FROM cal LEFT JOIN ds USING (day))"""
_DUR = "CASE WHEN {s} // 86400 > 0 THEN {s} // 86400 || 'd' END, CASE WHEN {s} % 86400 // 3600 > 0 THEN {s} % 86400 // 3600 || 'h' END, CASE WHEN {s} % 3600 // 60 > 0 THEN {s} % 3600 // 60 || 'm' END, {s} % 60 || 's'"


def _z(e: str, digits: int = 6, name: str | None = None) -> str:
    return f"round({e}, {digits}) + 0.0::DOUBLE AS {name or e}"


_RD = functools.partial(lambda digits, *names: ", ".join(_z(n, digits) for n in names))

ORACLES = {
    "raw_lambda": f"""WITH {_TICKS}, x AS (SELECT t.* FROM t JOIN (SELECT symbol, max(us) e FROM t GROUP BY 1) USING (symbol) WHERE us >= e - {_SPAN}),
        a AS (SELECT symbol, count(*) FILTER (side = 'buy') AS n_buy, count(*) FILTER (side = 'sell') AS n_sell, count(*) AS n_total, min(us) AS start_us, max(us) AS end_us, greatest((max(us) - min(us)) / 1e6, 1e-6) AS s FROM x GROUP BY 1)
        SELECT symbol, {_z("n_buy / s", 9, "lambda_p")}, {_z("n_sell / s", 9, "lambda_m")}, {_z("n_total / s", 9, "lambda_total")}, n_buy, n_sell, n_total, start_us, end_us FROM a""",
    "latest_mid": f"""WITH {_TICKS}, l AS (SELECT symbol, bid, ask FROM q QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sequence // 1000 DESC, us DESC, sequence) = 1)
        SELECT symbol, {_RD(6, "bid", "ask")}, {_z("(bid + ask) / 2", 6, "mid")} FROM l""",
    "newest_shards": f"""WITH {_TICKS}, x AS (SELECT symbol, lpad((sequence // 1000)::VARCHAR, 9, '0') AS file_name, us FROM q QUALIFY dense_rank() OVER (PARTITION BY symbol ORDER BY sequence // 1000 DESC) <= 3)
        SELECT symbol, file_name, unnest(['bid', 'ask']) AS side, n, last_us FROM (SELECT symbol, file_name, count(*) AS n, max(us) AS last_us FROM x GROUP BY 1, 2)""",
    "window_bounds": f"WITH {_CUT} SELECT symbol, e - {_SPAN} AS start_us, e AS end_us, lo AS overlap_start_us, hi AS overlap_end_us FROM lim JOIN ov USING (symbol)",
    "trade_depths": f"WITH {_DEPTHS} SELECT symbol, side, us, trade_id, sequence, {_RD(6, 'price', 'depth')} FROM dep",
    "depth_histogram": f'WITH {_HIST} SELECT symbol, side, bin, "count", {_RD(9, "center", "intensity")} FROM hist',
    "kappa_fit": f"WITH {_FIT} SELECT symbol, side, {_z('exp(a)', 6, 'lambda_0')}, {_z('CASE WHEN b IS NOT NULL THEN greatest(-b, 0.0::DOUBLE) END', 6, 'kappa')}, {_z('CASE WHEN b IS NOT NULL AND tot > 0 THEN 1 - res / tot END', 6, 'r2')}, CASE WHEN n_points >= 3 THEN n_points ELSE 0 END AS n_points FROM f",
    "kappa_fit_ols": f"""WITH {_HIST}, o AS (SELECT symbol, side, count(*) AS n, regr_slope(ln(intensity), center) AS b, regr_intercept(ln(intensity), center) AS a, regr_r2(ln(intensity), center) AS r2, regr_sxx(ln(intensity), center) AS sxx, regr_syy(ln(intensity), center) AS syy FROM hist WHERE "count" > 0 GROUP BY 1, 2),
        o2 AS (SELECT *, sqrt(greatest(0.0::DOUBLE, (1 - r2) * syy) / nullif(greatest(n - 2, 0), 0) / sxx) AS se, n - 2 AS df, atan(abs(b / nullif(se, 0)) / sqrt(df)) AS th FROM o WHERE n >= 3),
        o3 AS (SELECT *, CASE WHEN df % 2 = 1 THEN {2 / math.pi!r}::DOUBLE * (th + CASE WHEN df > 1 THEN sin(th) * list_sum(list_transform(range(0, (df - 1) // 2), lambda k: pow(cos(th), 2 * k + 1) * coalesce(list_aggregate(list_transform(range(1, k + 1), lambda j: 2.0::DOUBLE * j / (2 * j + 1)), 'product'), 1))) ELSE 0 END)
            ELSE sin(th) * list_sum(list_transform(range(0, df // 2), lambda k: pow(cos(th), 2 * k) * coalesce(list_aggregate(list_transform(range(1, k + 1), lambda j: (2.0::DOUBLE * j - 1) / (2 * j)), 'product'), 1))) END AS inside FROM o2)
        SELECT o.symbol, o.side, {_z("CASE WHEN o.n >= 3 THEN greatest(-o.b, 0.0::DOUBLE) END", 6, "kappa")}, {_z("CASE WHEN o.n >= 3 THEN exp(o.a) END", 6, "lambda_0")}, {_z("CASE WHEN o.n >= 3 THEN o.r2 END", 6, "r2")},
        {_z("CASE WHEN o.n >= 3 THEN CASE WHEN se > 0 THEN greatest(0.0::DOUBLE, 1 - inside) WHEN o.b = 0 THEN 1.0 ELSE 0.0 END END", 6, "p_value")}, {_z("se", 6, "std_error")}, CASE WHEN o.n >= 3 THEN o.n ELSE 0 END AS n_points FROM o LEFT JOIN o3 USING (symbol, side)""",
    "kappa_fit_nonlinear": f"""WITH {_HIST}, pts AS (SELECT symbol, side, list(center ORDER BY bin) AS xs, list(intensity ORDER BY bin) AS ys FROM hist WHERE "count" > 0 GROUP BY 1, 2 HAVING count(*) >= 4),
        {_zoom("pts", "symbol, side", 1.0, 500.0, 0.0, "'inf'::DOUBLE", f"list_transform(range(0, 1001), lambda i: exp({math.log(500)!r}::DOUBLE * i / 1000))")},
        v AS (SELECT symbol, side, k, a, len(xs) AS n, list_avg(ys) AS ym, list_transform(xs, lambda x: exp(-k * x)) AS ex, xs, ys FROM z5),
        v2 AS (SELECT *, list_sum(list_transform(range(1, n + 1), lambda i: (ys[i] - a * ex[i]) * (ys[i] - a * ex[i]))) AS rest, list_sum(list_transform(ys, lambda y: (y - ym) * (y - ym))) AS tot, list_dot_product(ex, ex) AS ee,
            list_sum(list_transform(range(1, n + 1), lambda i: a * a * xs[i] * xs[i] * ex[i] * ex[i])) AS dd, list_sum(list_transform(range(1, n + 1), lambda i: -a * xs[i] * ex[i] * ex[i])) AS ed FROM v)
        SELECT s.symbol, s.side, {_z("k", 4, "kappa")}, {_z("a", 4, "lambda_0")}, {_z("CASE WHEN tot > 0 THEN 1 - rest / tot END", 4, "r2")}, {_z("CASE WHEN ee * dd - ed * ed > 0 THEN sqrt(rest / (n - 2) * ee / (ee * dd - ed * ed)) END", 1, "std_error")}, coalesce(n, 0)::INTEGER AS n_points
        FROM (SELECT DISTINCT symbol, side FROM hist) s LEFT JOIN v2 USING (symbol, side)""",
    "impacts": f"WITH {_IMPACTS} SELECT symbol, side, us, trade_id, {_z('impact')} FROM imp",
    "epsilon_estimates": f"""WITH {_IMPACTS}, st AS (SELECT symbol, side, avg(impact) m, stddev_pop(impact) s FROM imp GROUP BY 1, 2),
        k AS (SELECT imp.* FROM imp JOIN st USING (symbol, side) WHERE s = 0 OR abs(impact - m) < 3.0::DOUBLE * s),
        rk AS (SELECT *, count(*) OVER (PARTITION BY symbol, side) AS n, row_number() OVER (PARTITION BY symbol, side ORDER BY impact, trade_id) AS rn FROM k),
        e AS (SELECT symbol, side, avg(impact) FILTER (n <= 2 OR (rn > floor(0.1::DOUBLE * n) AND rn <= floor(0.9::DOUBLE * n))) AS epsilon, avg(impact) AS mean, median(impact) AS median, stddev_pop(impact) AS std, count(*) AS n FROM rk GROUP BY 1, 2),
        sd AS (SELECT DISTINCT symbol, unnest(['buy', 'sell']) AS side FROM imp)
        SELECT symbol, side, {", ".join(_z(f"coalesce({c}, 0.0::DOUBLE)", 6, c) for c in ("epsilon", "mean", "median", "std"))}, coalesce(n, 0) AS n FROM sd LEFT JOIN e USING (symbol, side)""",
    "impact_histogram": f"""WITH {_IMPACTS}, e0 AS (SELECT symbol, side, min(impact) AS a, max(impact) AS b FROM imp GROUP BY 1, 2),
        e AS (SELECT symbol, side, CASE WHEN a = b THEN a - 0.5 ELSE a END AS a, CASE WHEN a = b THEN b + 0.5 ELSE b END AS b FROM e0), ee AS (SELECT *, (b - a) / 20 AS width FROM e),
        pl AS (SELECT imp.symbol, imp.side, impact, a, width, least(floor((impact - a) / width), 19) AS g FROM imp JOIN ee ON imp.symbol = ee.symbol AND imp.side = ee.side),
        n AS (SELECT symbol, side, CASE WHEN impact < a + g * width THEN g - 1 WHEN impact >= a + (g + 1) * width AND g < 19 THEN g + 1 ELSE g END::INTEGER AS bin, count(*) AS n FROM pl GROUP BY 1, 2, 3),
        f AS (SELECT symbol, side, a, width, unnest(range(20))::INTEGER AS bin FROM ee)
        SELECT f.symbol, f.side, f.bin, {_z("a + f.bin * width", 6, "low")}, {_z("a + (f.bin + 1) * width", 6, "high")}, coalesce(n, 0) AS "count" FROM f LEFT JOIN n ON f.symbol = n.symbol AND f.side = n.side AND f.bin = n.bin""",
    "size_impact": f"""WITH {_IMPACTS} SELECT symbol, side, {_z("regr_slope(impact, sqrt(trade_id % 9 + 1))", 6, "slope")}, {_z("regr_intercept(impact, sqrt(trade_id % 9 + 1))", 6, "intercept")}, count(*) AS n FROM imp GROUP BY 1, 2 HAVING count(*) > 3""",
    "parameter_join": f"""WITH {_PARAMS} SELECT symbol, {_RD(6, "kappa_p", "kappa_m", "epsilon_p", "epsilon_m")}, {_z("CASE WHEN k % 6 NOT IN (3, 4) THEN lambda_p ELSE 0.0::DOUBLE END", 6, "lambda_p")},
        {_z("CASE WHEN k % 6 <> 3 THEN lambda_m ELSE 0.0::DOUBLE END", 6, "lambda_m")}, {_z("CASE WHEN k % 6 <> 5 THEN mid END", 6, "mid")} FROM p WHERE k % 6 NOT IN (1, 2)""",
    "spread_log_bps": f"WITH {_PARAMS} SELECT symbol, mid <= 100 AS undefined, {_z('CASE WHEN mid > 100 THEN epsilon_p / (mid - 100) * 1e4 END', 6, 'bps')} FROM p",
    "toxicity": f"WITH {_PARAMS}, x AS (SELECT symbol, greatest(kappa_p * epsilon_p, kappa_m * epsilon_m) AS kappa_epsilon FROM p) SELECT symbol, {_z('kappa_epsilon')}, CASE WHEN kappa_epsilon >= 2 THEN 'toxic' WHEN kappa_epsilon >= 1 THEN 'competitive' ELSE 'manageable' END AS toxicity FROM x",
    "static_spread": f"WITH {_PARAMS}, x AS (SELECT symbol, mid, 1 / kappa_p + epsilon_p AS delta_p, 1 / kappa_m + epsilon_m AS delta_m FROM p) SELECT symbol, {_RD(6, 'delta_p', 'delta_m')}, {_z('delta_p * 100 / mid', 6, 'pct_p')}, {_z('delta_m * 100 / mid', 6, 'pct_m')} FROM x",
    "one_side_optimum": f"""WITH {_PARAMS}, x AS (SELECT symbol, lambda_p AS l, kappa_p AS k, epsilon_p AS e, (mid - 100) / 400 AS dh, 1 / kappa_p + epsilon_p - (mid - 100) / 400 AS z FROM p)
        SELECT symbol, {_z("z", 6, "depth")}, {_z("l / k * exp(-k * z)", 6, "value")}, {_z("greatest(z, 0.0::DOUBLE)", 6, "clipped_depth")}, {_z("CASE WHEN z <= 0 THEN greatest(l * (dh - e), 0.0::DOUBLE) ELSE l / k * exp(-k * z) END", 6, "clipped_value")} FROM x""",
    "hjb_symmetric": f"WITH RECURSIVE {_HJB} SELECT symbol, q, {_RD(6, 'h', 'delta_plus', 'delta_minus')}, 'symmetric' AS method FROM hjb",
    "hjb_asymmetric": f"WITH RECURSIVE {_newton()} SELECT symbol, q, {_RD(6, 'h', 'delta_plus', 'delta_minus')}, 'asymmetric' AS method FROM asd",
    "hjb_surface": f"WITH RECURSIVE {_SURFACE} SELECT symbol, n, {_z('t')}, q, {_RD(6, 'h', 'delta_plus', 'delta_minus')} FROM srf",
    "time_samples": f"""WITH RECURSIVE {_SURFACE}, ts AS (SELECT unnest(range(20)) * {HORIZON}::DOUBLE / 19 AS sample_t), tn AS (SELECT sample_t, floor(sample_t * {STEPS - 1} / {HORIZON}::DOUBLE)::INTEGER AS n FROM ts)
        SELECT symbol, {_z("sample_t")}, q, {_RD(6, "h", "delta_plus", "delta_minus")} FROM srf JOIN tn USING (n)""",
    "depth_lines": f"WITH RECURSIVE {_SURFACE} SELECT symbol, {_z('t')}, q, {_RD(6, 'delta_plus', 'delta_minus')} FROM srf WHERE q IN (-3, -2, 0, 1, 3)",
    "quote_ladder": f"""WITH RECURSIVE {_HJB}, x AS (SELECT hjb.symbol, q, mid, delta_minus + 0.00015::DOUBLE * mid * 2 AS b, delta_plus + 0.00015::DOUBLE * mid * 2 AS s FROM hjb JOIN p USING (symbol))
        SELECT symbol, q, {_z("mid - b", 6, "bid_px")}, {_z("mid + s", 6, "ask_px")}, {_z("b / mid * 1e4", 6, "bid_bps")}, {_z("s / mid * 1e4", 6, "ask_bps")} FROM x""",
    "bot_quotes": f"""WITH RECURSIVE {_HJB}, rq AS (SELECT symbol, unnest(range(-5, 6))::INTEGER AS q, mid, k % 5 = 0 AS is_short, mid * 1.01::DOUBLE AS proposed_rate, mid * 0.99::DOUBLE AS current_order_rate FROM p),
        x AS (SELECT rq.*, greatest(-3, least(3, rq.q)) AS q_used FROM rq),
        y AS (SELECT x.*, mid - (delta_minus + 0.00015::DOUBLE * mid * 2) AS bid, mid + (delta_plus + 0.00015::DOUBLE * mid * 2) AS ask, (delta_minus + 0.00015::DOUBLE * mid * 2) / mid * 1e4 AS bb, (delta_plus + 0.00015::DOUBLE * mid * 2) / mid * 1e4 AS ab
              FROM x LEFT JOIN (SELECT symbol, q AS qq, delta_plus, delta_minus FROM hjb) z ON x.symbol = z.symbol AND x.q_used = z.qq)
        SELECT symbol, q, {_RD(6, "mid", "proposed_rate", "current_order_rate")}, is_short, q_used, {_z("CASE WHEN NOT is_short THEN bid END", 6, "entry_price")}, {_z("CASE WHEN NOT is_short THEN coalesce(ask, proposed_rate) END", 6, "exit_price")},
        {_z("CASE WHEN NOT is_short THEN coalesce(bid, current_order_rate) END", 6, "adjust_price")}, {_z("bb", 6, "bid_bps")}, {_z("ab", 6, "ask_bps")} FROM y""",
    "entry_signals": f"WITH {_PARAMS} SELECT symbol, (k % 7 <> 6 AND k % 2 = 0 AND k % 3 <> 0 AND k < 20)::INTEGER AS enter_long, 0 AS exit_long FROM p",
    "inventory_level": f"WITH {_JOURNAL} SELECT pair, greatest(-3, least(3, count(*) FILTER (is_open = 1)))::INTEGER AS q FROM j GROUP BY 1",
    "trade_summary": f"""WITH {_JOURNAL}, a AS (SELECT count(*) AS total, count(*) FILTER (is_open = 0) AS closed, count(*) FILTER (is_open = 1) AS open, sum(close_profit_abs) AS profit_abs, sum(close_profit) * 100 AS profit_pct,
        count(*) FILTER (close_profit_abs > 0) AS wins, count(*) FILTER (close_profit_abs <= 0) AS losses, avg((epoch_us(close_date) - epoch_us(open_date)) / 1e6) AS mean_seconds FROM j)
        SELECT total, closed, open, {_RD(2, "profit_abs", "profit_pct")}, wins, losses, {_z("mean_seconds", 2)}, {_z("wins * 100.0::DOUBLE / closed", 2, "win_rate")}, concat_ws(' ', {_DUR.format(s="floor(mean_seconds)::BIGINT")}) AS mean_duration FROM a""",
    "trade_extremes": f"""WITH {_JOURNAL} (SELECT 'best' AS kind, id, pair, {_z("close_profit_abs", 2)}, close_date FROM j WHERE is_open = 0 ORDER BY j.close_profit_abs DESC, id LIMIT 1)
        UNION ALL (SELECT 'worst', id, pair, {_z("close_profit_abs", 2)}, close_date FROM j WHERE is_open = 0 ORDER BY j.close_profit_abs, id LIMIT 1)""",
    "pnl_by_pair": f"WITH {_JOURNAL} SELECT pair, {_z('sum(close_profit_abs)', 2, 'total_profit')}, count(id) AS n, {_z('avg(close_profit)', 6, 'mean_profit')} FROM j WHERE is_open = 0 GROUP BY 1",
    "pnl_by_strategy": f"WITH {_JOURNAL} SELECT strategy, {_z('sum(close_profit_abs)', 2, 'total_profit')}, count(id) AS n FROM j WHERE is_open = 0 GROUP BY 1",
    "open_trades": f"WITH {_JOURNAL} SELECT id, pair, open_date, printf('%.2f', stake_amount) AS stake_amount, printf('%.4f', open_rate) AS open_rate, 'No' AS is_short FROM j WHERE is_open = 1",
    "daily_returns": f"WITH {_DAILY} SELECT day::VARCHAR AS day, {_z('ret')} FROM daily",
    "sharpe_loss": f"WITH {_DAILY}, x AS (SELECT avg(ret) / stddev_samp(ret) * sqrt(365) AS sharpe FROM daily) SELECT (SELECT count(*) FROM r) AS n_trades, {_z('sharpe')}, {_z('-sharpe * (SELECT count(*) FROM r)', 3, 'loss')} FROM x",
    "drawdown": f"""WITH {_DAILY}, c AS (SELECT *, sum(profit_abs) OVER (ORDER BY close_date, id) AS cum FROM r), u AS (SELECT cum, greatest(0.0::DOUBLE, max(cum) OVER (ORDER BY close_date, id)) AS high FROM c),
        w AS (SELECT max(high - cum) AS max_drawdown, max((high - cum) / ({BALANCE}::DOUBLE + high)) AS max_relative FROM u),
        a AS (SELECT sum(profit_abs) AS total_profit, median(profit_ratio) AS median_ratio, count(*) FILTER (profit_abs > 0) / count(*) AS win_rate FROM r)
        SELECT {_z("total_profit", 1)}, {_RD(6, "median_ratio", "win_rate")}, {_z("max_drawdown", 1)}, {_z("max_relative")}, {_z(f"total_profit / {BALANCE}::DOUBLE", 5, "profit_pc")}, {_z("1 / (1 - max_relative) - 1", 5, "ddc")} FROM a, w""",
    "book_flatten": f"WITH {_TICKS} SELECT symbol, us AS sequence, us AS exchange_timestamp, "
    + ", ".join(f"{_z(f'value * {f}::DOUBLE + {s * i}', 6, f'{side}_price_{i}')}, {_z('(event_id % 10)::DOUBLE', 6, f'{side}_size_{i}')}" if side == "ask" or i < 2 else f"NULL::DOUBLE AS {side}_price_{i}, NULL::DOUBLE AS {side}_size_{i}" for i in range(3) for side, f, s in (("bid", 0.999, -1), ("ask", 1.001, 1)))
    + " FROM ev WHERE event_type = 'view'",
    "bbo_explode": f"""WITH {_TICKS}, x AS (SELECT ev.*, unnest(['bid', 'ask']) AS side FROM ev WHERE event_type IN ('view', 'click'))
        SELECT symbol, us AS exchange_timestamp, side, {_z("value * CASE WHEN side = 'bid' THEN 0.999::DOUBLE ELSE 1.001::DOUBLE END", 6, "price")}, {_z("(event_id % 10)::DOUBLE", 6, "size")} FROM x WHERE event_type = 'view' OR side = 'ask' OR event_id % 3 <> 0""",
    "trade_normalise": f"""WITH {_TICKS} SELECT symbol, us AS exchange_timestamp, CASE WHEN event_type = 'signup' THEN 'sell' ELSE 'buy' END AS side, CASE WHEN event_id % 4 <> 0 THEN event_id::VARCHAR ELSE 'None' END AS trade_id, {_z("value", 6, "price")}, {_z("1.5::DOUBLE", 6, "size")}
        FROM ev JOIN (SELECT unnest([0, 1]) AS copy) ON event_id % 2 = 0 OR copy = 0 WHERE event_type IN ('purchase', 'signup')""",
    "ingest_rates": f"WITH {_TICKS} SELECT symbol, CASE WHEN event_type IN ('view', 'click') THEN 'prices' ELSE 'trades' END AS kind, count(*) AS n, {_z('count(*) / nullif((max(us) - min(us)) / 60e6, 0)', 6, 'per_minute')} FROM ev GROUP BY 1, 2",
    "fill_ffill": f"""WITH s AS (SELECT user_id % 4 AS path_id, event_id AS n, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 THEN value END AS v FROM events)
        SELECT path_id, n, {_z("coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY path_id ORDER BY n), first_value(v IGNORE NULLS) OVER (PARTITION BY path_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))", 6, "x")} FROM s""",
    "neighbour_shift": f"SELECT path_id, n, {_z('value')}, {_z('coalesce(lag(value) OVER o, value)', 6, 'value_below')}, {_z('coalesce(lead(value) OVER o, value)', 6, 'value_above')} FROM (SELECT user_id % 4 AS path_id, event_id AS n, value FROM events) WINDOW o AS (PARTITION BY path_id ORDER BY n)",
    "cumulative_fills": "SELECT user_id % 4 AS path_id, event_id AS n, (sum(event_id % 2) OVER o)::BIGINT AS cum_fills_p, (sum(event_id % 3) OVER o)::BIGINT AS cum_fills_m FROM events WINDOW o AS (PARTITION BY user_id % 4 ORDER BY event_id)",
    "sim_metrics": f"""WITH s AS (SELECT user_id % 4 AS path_id, event_id AS n, value AS pnl FROM events), d AS (SELECT *, pnl - lag(pnl) OVER (PARTITION BY path_id ORDER BY n) AS dp FROM s),
        a AS (SELECT path_id, arg_max(pnl, n) AS final_pnl, sum(n % 2 + n % 3)::BIGINT AS fills, max(abs(n % 7 - 3)) AS max_inventory, avg(dp) AS m, stddev_pop(dp) AS sd, count(dp) AS k FROM d GROUP BY 1)
        SELECT path_id, {_z("final_pnl")}, fills, max_inventory, {_z("CASE WHEN sd > 0 THEN m / sd * sqrt(k / 30.0::DOUBLE) ELSE 0.0 END", 6, "sharpe")} FROM a""",
    "simulated_paths": f"""WITH RECURSIVE {_SIMULATED}, d AS (SELECT *, pnl - lag(pnl) OVER (PARTITION BY symbol, path_id ORDER BY n) AS dp FROM pp),
        m AS (SELECT symbol, path_id, arg_max(pnl, n) AS final_pnl, sum(fills_p + fills_m)::BIGINT AS fills, max(abs(q)) AS max_inventory, avg(dp) AS m, stddev_pop(dp) AS sd, count(dp) AS k FROM d GROUP BY 1, 2)
        SELECT symbol, path_id, {_z("final_pnl")}, fills, max_inventory, {_z(f"CASE WHEN sd > 0 THEN m / sd * sqrt(k / {HORIZON}::DOUBLE) ELSE 0.0 END", 6, "sharpe")} FROM m""",
    "dashboard_series": f"""WITH RECURSIVE {_SIMULATED} SELECT symbol, path_id, {_z(f"n * {_DT}::DOUBLE", 6, "t")}, {_z("pnl")}, q, {_z("s")}, (sum(fills_p) OVER o)::BIGINT AS sold, (sum(fills_m) OVER o)::BIGINT AS bought FROM pp WINDOW o AS (PARTITION BY symbol, path_id ORDER BY n)""",
    "synthetic_calibration": f"""WITH ob AS (SELECT i, i * 0.05::DOUBLE / 99 AS x, greatest(0.0::DOUBLE, 50 * exp(-60 * (i * 0.05::DOUBLE / 99)) + {_gauss("1", "i", "'l'")} * 0.1::DOUBLE * 50 * 0.2::DOUBLE) AS y FROM (SELECT unnest(range(100)) AS i)),
        pts AS (SELECT 1 AS one, list(x ORDER BY i) AS xs, list(y ORDER BY i) AS ys FROM ob),
        {_zoom("pts", "one", 0.0, 300.0, 0.0, "200.0::DOUBLE", f"list_concat([0.0::DOUBLE], list_transform(range(0, 1001), lambda i: 1e-6::DOUBLE * exp({math.log(3e8)!r}::DOUBLE * i / 1000)))")},
        jp AS (SELECT avg(greatest(1e-5, {0.005 / 3!r}::DOUBLE * pow(1 - {_u("3", "i", "'j'")}, {-1 / 1.5!r}::DOUBLE) + {_gauss("3", "i", "'n'")} * 0.1::DOUBLE * 0.005::DOUBLE * 0.5::DOUBLE)) AS epsilon FROM (SELECT unnest(range(10000)) AS i))
        SELECT {_z("k", 4, "kappa")}, {_z("a", 4, '"lambda"')}, {_z("epsilon", 9)} FROM z5, jp""",
    "model_curves": f"""WITH ob AS (SELECT i, i * 0.05::DOUBLE / 99 AS delta FROM (SELECT unnest(range(100)) AS i)),
        o2 AS (SELECT i, delta, exp(-60 * delta) AS prob_true, 50 * exp(-60 * delta) AS lambda_true, exp(-59.8::DOUBLE * delta) AS prob_fit, 49.5::DOUBLE * exp(-59.8::DOUBLE * delta) AS lambda_fit FROM ob)
        SELECT {_RD(9, "delta", "prob_true", "lambda_true", "prob_fit", "lambda_fit")}, {_z(f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, prob_true + {_gauss('1', 'i', chr(39) + 'p' + chr(39))} * 0.1::DOUBLE * 0.1::DOUBLE))", 9, "prob_observed")},
        {_z(f"greatest(0.0::DOUBLE, lambda_true + {_gauss('1', 'i', chr(39) + 'l' + chr(39))} * 0.1::DOUBLE * 50 * 0.2::DOUBLE)", 9, "lambda_observed")} FROM o2""",
    "fill_probability": f"WITH {_PARAMS} SELECT symbol, {_z('CASE WHEN mid <= 100 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, exp(-kappa_p * ((mid - 100) / 200))) END', 6, 'prob')} FROM p",
    "scalar_functions": f"""SELECT o_orderkey, concat_ws(' ', {_DUR.format(s="(o_orderkey * 37 % 200000)")}) AS duration, CASE WHEN round(o_totalprice - 250000) > 0 THEN 'gain' WHEN round(o_totalprice - 250000) < 0 THEN 'loss' ELSE 'flat' END AS sign,
        o_orderpriority AS symbol, 'a|b|' || o_orderkey AS names FROM orders""",
}
