"""Series by key and order: filling, shifting, sampling, and simulation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def fill(df: DataFrame, column: str, keys: list[str], order: str) -> DataFrame:
    """Missing and non-finite values take the last good one, those before the first good one the next.

    The backward fill is a second forward one in descending order; no frame looks ahead.
    """
    x = finite(F.col(column).cast("double"))
    back = Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_x", x).withColumn(column, F.coalesce(F.last("_x", ignorenulls=True).over(ahead), F.last("_x", ignorenulls=True).over(back))).drop("_x")


def neighbours(df: DataFrame, column: str, keys: list[str], order: str) -> DataFrame:
    """``<column>_below`` and ``<column>_above`` along the order; at the ends the value itself."""
    by = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({f"{column}_below": F.coalesce(F.lag(column).over(by), column), f"{column}_above": F.coalesce(F.lead(column).over(by), column)})


def cumulative(df: DataFrame, columns: list[str], keys: list[str], order: str) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({f"cum_{c}": F.sum(c).over(by) for c in columns})


def difference(df: DataFrame, column: str, keys: list[str], order: str) -> DataFrame:
    return df.withColumn(f"d_{column}", F.col(column) - F.lag(column).over(Window.partitionBy(*keys).orderBy(order)))


def sample_times(df: DataFrame, horizon: float, steps: int, points: int = 50) -> DataFrame:
    """Rows at ``points`` evenly spaced times: step int(t (N - 1) / T); ``df`` has n."""
    spark = df.sparkSession
    t = spark.range(points).select((F.col("id") * horizon / max(1, points - 1)).alias("sample_t"))
    at = t.withColumn("n", F.floor(F.col("sample_t") * (steps - 1) / horizon).cast("int"))
    return df.join(F.broadcast(at), "n")  # ``points`` rows


def simulation_metrics(paths: DataFrame, horizon: float, keys: tuple[str, ...] = ("path_id",)) -> DataFrame:
    """``keys``, final_pnl, fills, max_inventory, sharpe of paths with n, pnl, q, fills_p, fills_m."""
    diffs = difference(paths, "pnl", list(keys), "n")
    agg = diffs.groupBy(*keys).agg(F.max_by("pnl", "n").alias("final_pnl"), F.sum(F.col("fills_p") + F.col("fills_m")).alias("fills"), F.max(F.abs("q")).alias("max_inventory"), F.avg("d_pnl").alias("m"), F.stddev_pop("d_pnl").alias("s"), F.count("d_pnl").alias("k"))
    sharpe = F.when(F.col("s") > 0, F.try_divide(F.col("m"), F.col("s")) * F.sqrt(F.col("k") / horizon)).otherwise(0.0)
    return agg.select(*keys, "final_pnl", "fills", "max_inventory", sharpe.alias("sharpe"))


def dashboard(paths: DataFrame, horizon: float, steps: int) -> DataFrame:
    """A path's plotted series: symbol, path_id, t, pnl, q, s, and both sides' fills so far."""
    t = F.col("n") * (horizon / steps)
    run = cumulative(paths, ["fills_p", "fills_m"], ["symbol", "path_id"], "n")
    return run.select("symbol", "path_id", t.alias("t"), "pnl", "q", "s", F.col("cum_fills_p").alias("sold"), F.col("cum_fills_m").alias("bought"))


def surface_samples(surface: DataFrame, horizon: float, steps: int, points: int = 50) -> DataFrame:
    """The surface at evenly spaced times, infinite depths as null: what heat map and depth surfaces show."""
    at = sample_times(surface, horizon, steps, points)
    return at.select("symbol", "sample_t", "q", "h", finite(F.col("delta_plus")).alias("delta_plus"), finite(F.col("delta_minus")).alias("delta_minus"))


def depth_lines(surface: DataFrame, q_min: int, q_max: int) -> DataFrame:
    """Depths over time at the bounds, half-way to them and at no inventory; infinite ones as null."""
    shown = sorted({q_min, q_min // 2, 0, q_max // 2, q_max})
    return surface.where(F.col("q").isin(shown)).select("symbol", "t", "q", finite(F.col("delta_plus")).alias("delta_plus"), finite(F.col("delta_minus")).alias("delta_minus"))


def model_curves(observed: DataFrame, lam: Column, kappa: Column) -> DataFrame:
    """Observed, true and fitted fill probabilities and intensities over depth."""
    prob = F.exp(-kappa * F.col("delta"))
    return observed.select("delta", "prob_observed", "prob_true", prob.alias("prob_fit"), "lambda_observed", "lambda_true", (lam * prob).alias("lambda_fit"))
