"""Fill-intensity decay: trade depths against the book, histogram, and the fits of ln(intensity) over depth."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof

LAG_US = 500_000
KEY = ["symbol", "side"]


def trade_depths(trades: DataFrame, quotes: DataFrame, lag_us: int = LAG_US) -> DataFrame:
    """Trades with their book ``lag_us`` earlier and the depth they reached into it.

    A buy needs an ask and a price at or above it; any other side counts as a sale.  Trades without a book are left out.
    """
    joined = asof(trades, quotes, "book", ["bid_price_0", "ask_price_0", "sequence"], lag_us=lag_us).where("book is not null")
    buy = F.col("side") == "buy"
    depth = F.when(buy, F.col("price") - F.col("book.ask_price_0")).otherwise(F.col("book.bid_price_0") - F.col("price"))
    out = joined.withColumn("depth", depth).where("depth >= 0")
    return out.select("symbol", F.when(buy, "buy").otherwise("sell").alias("side"), "us", "trade_id", "price", F.col("book.sequence").alias("sequence"), "depth")


def trimmed_depths(depths: DataFrame, least: int = 10) -> DataFrame:
    """Depths up to the 99th percentile (linear interpolation); sides left with fewer than ``least`` have none."""
    side = Window.partitionBy(*KEY)  # one shuffle, which the counts by bin use again; the depths are computed once
    kept = depths.withColumn("cut", F.percentile("depth", F.lit(0.99)).over(side)).where("depth <= cut")
    sized = kept.withColumns({"n": F.count("*").over(side), "top": F.max("depth").over(side)})
    return sized.where(F.col("n") >= least).select(*KEY, "depth", "top")


def histogram(depths: DataFrame, bins: int = 20, seconds: float = 1800.0) -> DataFrame:
    """symbol, side, bin, center, count, intensity: equal widths from 0 to the largest depth, empty bins included.

    A bin is half-open, the last one closed; a bin number is corrected against the edges ``i * width`` themselves.
    """
    d = trimmed_depths(depths).withColumn("width", F.col("top") / bins)
    guess = F.floor(F.col("depth") / F.col("width"))
    down = F.when(F.col("depth") < guess * F.col("width"), guess - 1).when(F.col("depth") >= (guess + 1) * F.col("width"), guess + 1).otherwise(guess)
    d = d.withColumn("bin", F.when(F.col("top") == 0, bins - 1).otherwise(F.least(down, F.lit(bins - 1))).cast("int"))
    counts = d.groupBy(*KEY, "bin").agg(F.count("*").alias("n"), F.max("width").alias("width"))
    # At most ``bins`` entries a side.
    sides = counts.groupBy(*KEY).agg(F.max("width").alias("width"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("found"))
    full = sides.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("count", F.coalesce(F.col("found")[F.col("bin")], F.lit(0)))
    center = (F.col("bin") * F.col("width") + (F.col("bin") + 1) * F.col("width")) / 2
    return full.select(*KEY, "bin", center.alias("center"), "count", (F.col("count") / F.lit(seconds)).alias("intensity"))


def fit(hist: DataFrame) -> DataFrame:
    """Weighted least squares of ln(intensity) on depth, weights the counts: lambda_0, kappa, r2, n_points.

    At least three non-empty bins, else nulls and no points.  kappa is not below 0; lambda_0 keeps the unclamped fit's intercept.
    """
    point = F.struct(F.col("center").alias("x"), F.col("count").cast("double").alias("w"), F.ln(F.when(F.col("count") > 0, F.col("intensity"))).alias("y"))
    # A side's points are as many as bins: residuals need no second pass over the data.
    p = hist.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.when(F.col("count") > 0, point))).alias("p"))

    def total(e) -> Column:
        return F.aggregate("p", F.lit(0.0), lambda acc, r: acc + e(r["w"], r["x"], r["y"]))

    sums = p.select(*KEY, "p", F.size("p").alias("n"), total(lambda w, x, y: w).alias("sw"), total(lambda w, x, y: w * x).alias("sx"), total(lambda w, x, y: w * y).alias("sy"), total(lambda w, x, y: w * x * x).alias("sxx"), total(lambda w, x, y: w * x * y).alias("sxy"))
    det = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.try_divide(F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy"), det)
    line = sums.withColumn("b", F.when(F.col("n") >= 3, slope)).withColumn("ym", F.try_divide("sy", "sw")).withColumn("a", F.col("ym") - F.col("b") * F.try_divide("sx", "sw"))
    square = lambda z: z * z
    rest = line.withColumns({"res": total(lambda w, x, y: w * square(y - F.col("a") - F.col("b") * x)), "tot": total(lambda w, x, y: w * square(y - F.col("ym")))})
    r2 = F.when(F.col("tot") > 0, 1 - F.col("res") / F.when(F.col("tot") > 0, F.col("tot")))
    return rest.select(*KEY, F.exp("a").alias("lambda_0"), F.greatest(-F.col("b"), F.when(F.col("b").isNotNull(), 0.0)).alias("kappa"), F.when(F.col("b").isNotNull(), r2).alias("r2"), F.when(F.col("n") >= 3, F.col("n")).otherwise(0).alias("n_points"))


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) of Student's t with a whole number of degrees of freedom, by its finite series."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    cos2 = F.pow(F.cos(theta), 2)
    odd = df % 2 == 1
    first = F.when(odd, F.cos(theta)).otherwise(F.lit(1.0))
    # Even: sum of cos^2k (1 3 .. 2k-1)/(2 4 .. 2k); odd: sum of cos^(2k+1) (2 4 .. 2k)/(3 5 .. 2k+1).
    ratio = lambda k: F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
    last = F.floor((df - F.when(odd, 3).otherwise(2)) / 2)
    begin = F.struct(first.alias("term"), first.alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * cos2 * ratio(k)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    series = F.aggregate(F.when(last >= 1, F.sequence(F.lit(1), last.cast("int"))).otherwise(F.array().cast("array<int>")), begin, step)["sum"]
    inside = F.when(odd, 2 / math.pi * (theta + F.when(df > 1, F.sin(theta) * series).otherwise(0.0))).otherwise(F.sin(theta) * series)
    return F.greatest(F.lit(0.0), 1 - inside)


def fit_ols(hist: DataFrame) -> DataFrame:
    """Unweighted fit of ln(intensity): kappa, lambda_0, r2, p_value (slope 0), std_error, n_points; nulls below three points."""
    p = hist.where("count > 0").withColumn("y", F.ln("intensity"))
    agg = p.groupBy(*KEY).agg(F.count("*").alias("n"), F.regr_slope("y", "center").alias("b"), F.regr_intercept("y", "center").alias("a"), F.regr_r2("y", "center").alias("r2"), F.regr_sxx("y", "center").alias("sxx"), F.regr_syy("y", "center").alias("syy"))
    agg = agg.withColumn("se", F.sqrt(F.greatest(F.lit(0.0), (1 - F.col("r2")) * F.col("syy")) / F.when(F.col("n") > 2, F.col("n") - 2) / F.col("sxx")))
    ok = lambda c: F.when(F.col("n") >= 3, c)
    # An exact line has no spread: its slope is 0 for sure, or not.
    p_value = F.when(F.col("se") > 0, t_two_sided(F.col("b") / F.when(F.col("se") > 0, F.col("se")), F.col("n") - 2)).otherwise(F.when(F.col("b") == 0, 1.0).otherwise(0.0))
    return agg.select(*KEY, ok(F.greatest(-F.col("b"), F.lit(0.0))).alias("kappa"), ok(F.exp("a")).alias("lambda_0"), ok(F.col("r2")).alias("r2"), ok(p_value).alias("p_value"), ok(F.col("se")).alias("std_error"), F.when(F.col("n") >= 3, F.col("n")).otherwise(0).alias("n_points"))


def bounded_exponential(x: np.ndarray, y: np.ndarray, low: tuple[float, float], high: tuple[float, float], start: tuple[float, float], steps: int = 200) -> tuple[float, float]:
    """Least squares of ``a * exp(-k x)`` in a box: for each k the best a is closed-form, k by golden section around a grid."""
    def best_a(k: float) -> float:
        e = np.exp(-k * x)
        return float(np.clip(e @ y / (e @ e), low[0], high[0])) if e @ e > 0 else low[0]

    def loss(k: float) -> float:
        return float(((y - best_a(k) * np.exp(-k * x)) ** 2).sum())

    grid = np.unique(np.clip(np.concatenate([np.geomspace(max(low[1], 1e-6), high[1], 400), [start[1], low[1]]]), low[1], high[1]))
    at = int(np.argmin([loss(k) for k in grid]))
    a, b = grid[max(0, at - 1)], grid[min(len(grid) - 1, at + 1)]
    g = (5**0.5 - 1) / 2
    for _ in range(steps):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
        if b - a < 1e-12:
            break
    k = (a + b) / 2
    return best_a(k), k


def fit_nonlinear(hist: DataFrame) -> DataFrame:
    """Bounded fit of the intensities themselves, lambda_0 >= 0 and 1 <= kappa <= 500; nulls below four points.

    std_error is kappa's, from the curve's slopes at the solution and the residuals' variance.
    """
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["intensity"] > 0]
        row = {"symbol": None, "side": None, "kappa": None, "lambda_0": None, "r2": None, "std_error": None, "n_points": 0}
        if len(pdf) >= 4:
            x, y = pdf["center"].to_numpy(), pdf["intensity"].to_numpy()
            a, k = bounded_exponential(x, y, (0.0, 1.0), (np.inf, 500.0), (float(y.max()), 50.0))
            total, e = ((y - y.mean()) ** 2).sum(), np.exp(-k * x)
            rest = ((y - a * e) ** 2).sum()
            slopes = np.stack([e, -a * x * e])
            det = (slopes[0] @ slopes[0]) * (slopes[1] @ slopes[1]) - (slopes[0] @ slopes[1]) ** 2
            error = float(np.sqrt(rest / (len(x) - 2) * (slopes[0] @ slopes[0]) / det)) if det > 0 else None
            row |= {"kappa": k, "lambda_0": a, "r2": 1 - rest / total if total > 0 else None, "std_error": error, "n_points": len(x)}
        return pd.DataFrame([row])

    def keyed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return one(pdf).assign(symbol=key[0], side=key[1])

    return hist.groupBy(*KEY).applyInPandas(keyed, "symbol string, side string, kappa double, lambda_0 double, r2 double, std_error double, n_points int")


def two_sided(fits: DataFrame) -> DataFrame:
    """One row a symbol: kappa and lambda_0 of both sides; an unfitted side is null."""
    side = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    return fits.groupBy("symbol").agg(side("kappa", "buy").alias("kappa_p"), side("kappa", "sell").alias("kappa_m"), side("lambda_0", "buy").alias("lambda_p"), side("lambda_0", "sell").alias("lambda_m"))


