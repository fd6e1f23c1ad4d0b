"""Whole jobs: calibration of all symbols at once, spreads from parameters, the journal report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import control, impact, kappa, quotes, rates, report, windows
from tidemark.sources import ticks


def fit_kappa(trades: DataFrame, books: DataFrame, minutes: float = 30, bins: int = 20, lag_us: int = kappa.LAG_US) -> DataFrame:
    """kappa and lambda_0 of both sides of every symbol; a side that can't be fitted is null."""
    return _kappa(*windows.calibration_inputs(trades, books, minutes), minutes, bins, lag_us)


def _kappa(t: DataFrame, q: DataFrame, minutes: float, bins: int, lag_us: int) -> DataFrame:
    return kappa.two_sided(kappa.fit(kappa.histogram(kappa.trade_depths(t, q, lag_us), bins, minutes * 60)))


def fit_epsilon(trades: DataFrame, books: DataFrame, minutes: float = 30, pre_us: int = impact.WINDOW_US, post_us: int = impact.WINDOW_US) -> DataFrame:
    return _epsilon(*windows.calibration_inputs(trades, books, minutes), pre_us, post_us)


def _epsilon(t: DataFrame, q: DataFrame, pre_us: int, post_us: int) -> DataFrame:
    return impact.two_sided(impact.estimates(impact.impacts(t, q, pre_us, post_us)))


def estimates(t: DataFrame, q: DataFrame, mids: DataFrame | None = None, minutes: float = 30, bins: int = 20, generation: int = 0, lag_us: int = kappa.LAG_US, pre_us: int = impact.WINDOW_US, post_us: int = impact.WINDOW_US) -> DataFrame:
    """A parameter row for each symbol with kappa on both sides, from trades and books cut to their window."""
    k = _kappa(t, q, minutes, bins, lag_us)
    full = quotes.parameters(k, _epsilon(t, q, pre_us, post_us), k, mids)
    end = t.groupBy("symbol").agg(F.max("us").alias("asof"))
    return full.join(end, "symbol").withColumn("generation", F.lit(generation).cast("long")).select("symbol", "kappa_p", "kappa_m", "lambda_p", "lambda_m", "epsilon_p", "epsilon_m", "mid", "generation", "asof")


def calibrate(trades: DataFrame, books: DataFrame, mids: DataFrame | None = None, minutes: float = 30, **options) -> DataFrame:
    """``estimates`` over the trailing window; one DAG, so no estimate reads another's stale file."""
    return estimates(*windows.calibration_inputs(trades, books, minutes), mids, minutes, **options)


def monitor(trades: DataFrame, minutes: float = 30) -> DataFrame:
    """Raw arrival rates over the trailing window, trades alone."""
    return rates.raw_lambda(windows.within(trades, windows.bounds(trades, None, minutes))).withColumn("unit", F.lit("trades_per_second"))


def spreads(params: DataFrame, asymmetric: bool = False, q_max: int = 3, horizon: float = 60.0, alpha: float = 0.0, phi: float = 0.0, steps: int = 200) -> DataFrame:
    """The quote ladder of every symbol."""
    if asymmetric:
        grid = control.asymmetric(params, q_max, horizon=horizon, alpha=alpha, phi=phi, steps=steps)
    else:
        grid = control.symmetric(params, horizon, q_max, alpha, phi)
    return quotes.ladder(grid, params)


def store_window(spark: SparkSession, root: str, minutes: float, symbols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Trades and books of the hours that the trailing window can touch, no others read."""
    since = ticks.trailing(spark, root, ("trades", "orderbooks"), minutes, symbols)
    trades = ticks.require(ticks.read_ticks(spark, root, "trades", since=since), "side", "price")
    return trades, ticks.read_ticks(spark, root, "orderbooks", since=since)


def store_mids(spark: SparkSession, root: str, symbols: list[str] | None = None) -> DataFrame | None:
    """The latest mid of every symbol that has prices; None without any."""
    return rates.latest_mid(ticks.newest_prices(spark, root, symbols), "hour") if ticks.exists(spark, f"{root}/prices/symbol=*") else None


def calibrate_store(spark: SparkSession, root: str, out: str, symbols: list[str] | None = None, minutes: float = 30, **options) -> list[str]:
    """Calibrate a tick store and upsert the results; returns the symbols written.

    A symbol whose estimates are missing keeps its last good row, and the others aren't held up.
    """
    if not (names := [s for s in ticks.catalog(spark, root) if symbols is None or s in symbols]):
        return []
    # Both fits read the window's rows: they are cut once.
    t, q = (df.persist() for df in windows.calibration_inputs(*store_window(spark, root, minutes, names), minutes))
    rows = estimates(t, q, store_mids(spark, root, names), minutes, **options).persist()
    done = sorted(r["symbol"] for r in rows.select("symbol").collect())  # a name a symbol
    if done:
        ticks.upsert_params(rows, out)
    for df in (rows, t, q):
        df.unpersist()
    return done


def journal_report(journal: DataFrame) -> dict[str, DataFrame]:
    return {"summary": report.summary(journal), "extremes": report.extremes(journal), "by_pair": report.by_pair(journal), "by_strategy": report.by_strategy(journal), "open": report.open_trades(journal)}
