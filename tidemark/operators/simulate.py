"""Synthetic markets: fill probabilities, noisy observations, their calibration, and simulated trading paths."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import let
from tidemark.operators.kappa import bounded_exponential

PARETO = 1.5


def fill_probability(depth: Column, kappa: Column) -> Column:
    return F.when(depth <= 0, 1.0).otherwise(F.least(F.lit(1.0), F.exp(-kappa * depth)))


def uniform(*parts: Column | int | str) -> Column:
    """A number in (0, 1) that depends on the parts' values alone, so a lost task draws it again: 48 bits of their MD5."""
    named = F.concat_ws("-", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(named), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def normal(*parts: Column | int | str) -> Column:
    """A standard normal number from two uniform ones (Box and Muller)."""
    return F.sqrt(-2 * F.ln(uniform(*parts, "a"))) * F.cos(2 * math.pi * uniform(*parts, "b"))


def poisson(mean: Column, u: Column) -> Column:
    """The least k whose cumulative Poisson probability reaches ``u``."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    begin = F.struct(F.exp(-mean).alias("term"), F.exp(-mean).alias("sum"), F.lit(0).alias("k"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * mean / k
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"), (acc["k"] + (acc["sum"] < u).cast("int")).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), last), begin, step)["k"]


def observations(spark: SparkSession, lam: float, kappa: float, noise: float, seed: int, points: int = 100, deepest: float = 0.05) -> DataFrame:
    """delta, prob_true, prob_observed, lambda_true, lambda_observed on an even grid of depths."""
    i = F.col("id")
    df = spark.range(0, points, 1, 1).select("id", (i * deepest / (points - 1)).alias("delta"))
    df = df.withColumn("prob_true", F.exp(-kappa * F.col("delta"))).withColumn("lambda_true", lam * F.col("prob_true"))
    prob = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prob_true") + normal(seed, i, "p") * noise * 0.1))
    rate = F.greatest(F.lit(0.0), F.col("lambda_true") + normal(seed, i, "l") * noise * lam * 0.2)
    return df.withColumns({"prob_observed": prob, "lambda_observed": rate}).drop("id")


def jumps(spark: SparkSession, epsilon: float, noise: float, seed: int, n: int = 10_000) -> DataFrame:
    """Pareto jumps of mean ``epsilon``, observed with noise and at least 1e-5."""
    scale = epsilon * (PARETO - 1) / PARETO if epsilon > 0 else 0.0
    true = scale * F.pow(1 - uniform(seed, F.col("id"), "j"), F.lit(-1 / PARETO))
    return spark.range(n).select(F.greatest(F.lit(1e-5), true + normal(seed, F.col("id"), "n") * noise * epsilon * 0.5).alias("jump"))


def calibrate(observed: DataFrame, jumped: DataFrame) -> DataFrame:
    """kappa, lambda, epsilon: a line through ln(probability) above 0.01 starts a bounded fit of the intensities."""
    rough = observed.where("prob_observed > 0.01").agg(F.when(F.count("*") > 10, -F.regr_slope(F.ln("prob_observed"), "delta")).otherwise(100.0).alias("k"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("delta")
        x, y, k = pdf["delta"].to_numpy(), pdf["lambda_observed"].to_numpy(), float(pdf["k"].iloc[0])
        head = float(y[:5].mean())
        a, kappa = bounded_exponential(x, y, (0.0, 0.0), (200.0, 300.0), (head, k)) if len(x) > 1 else (head, k)
        return pd.DataFrame({"kappa": [kappa], "lambda": [a]})

    fitted = observed.crossJoin(F.broadcast(rough)).groupBy(F.lit("all")).applyInPandas(one, "kappa double, lambda double")
    return fitted.crossJoin(F.broadcast(jumped.agg(F.avg("jump").alias("epsilon"))))


MARKET = ("s0", "sigma", "lambda_p", "lambda_m", "kappa_p", "kappa_m", "epsilon_p", "epsilon_m")


def paths(surface_rows: DataFrame, markets: DataFrame, n_paths: int, horizon: float, steps: int, seed: int = 0) -> DataFrame:
    """symbol, path_id, n, s, q, x, pnl, fills_p, fills_m of ``n_paths`` paths a symbol that quote its (n, q) surface.

    ``markets`` has a row a symbol: s0, sigma, lambda_p, lambda_m, kappa_p, kappa_m, epsilon_p, epsilon_m.  A path is one
    row that folds over the steps: arrivals are Poisson, each is filled at the quote of the step's start with the
    depth's probability; inventories beyond the grid quote its bound.  A path's draws depend on the seed, its symbol
    and number only.
    """
    dt = horizon / steps
    cells = surface_rows.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("n", "q", "delta_plus", "delta_minus"))).alias("g"), F.min("q").alias("q0"), F.max("q").alias("q1"))
    # A symbol's surface is (steps + 1) times the inventory grid, as the arguments say.
    market = cells.select("symbol", F.transform("g", lambda r: r["delta_plus"]).alias("ask"), F.transform("g", lambda r: r["delta_minus"]).alias("bid"), "q0", "q1").join(markets.select("symbol", *MARKET), "symbol")
    spread = market.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_paths - 1))).alias("path_id"))
    n = F.col("n")
    draws = spread.select("symbol", "path_id", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("n"), "lambda_p", "lambda_m")
    key = (seed, F.col("symbol"), F.col("path_id"), n)
    draws = draws.select("symbol", "path_id", "n", *[poisson(F.col(f"lambda_{s}") * dt, uniform(*key, s)).alias(f"c_{s}") for s in "pm"], normal(*key, "w").alias("w"))

    def coins(count: Column, s: str) -> Column:
        some = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
        return F.transform(some, lambda j: uniform(*key, s, j))

    draws = draws.select("symbol", "path_id", F.struct("n", coins(F.col("c_p"), "p").alias("p"), coins(F.col("c_m"), "m").alias("m"), "w").alias("d"))
    each = draws.groupBy("symbol", "path_id").agg(F.sort_array(F.collect_list("d")).alias("draws")).join(market, "symbol")
    width = F.col("q1") - F.col("q0") + 1
    whole, zero = F.lit(0).cast("int"), F.lit(0.0)
    begin = F.struct(F.lit(-1).cast("int").alias("n"), F.col("s0").cast("double").alias("s"), whole.alias("q"), zero.alias("x"), whole.alias("fp"), whole.alias("fm"), zero.alias("next"))

    def step(acc: Column, d: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        price = F.when(last["n"] < 0, last["s"]).otherwise(last["next"])
        at = d["n"] * width + F.greatest(F.col("q0"), F.least(F.col("q1"), last["q"])) - F.col("q0")
        fills = lambda coins, depth, kappa: let(fill_probability(depth, F.col(kappa)), lambda p: F.size(F.filter(coins, lambda u: u < p)).cast("int"))

        def quoted(v: Column) -> Column:
            filled = F.struct(fills(d["p"], v["ask"], "kappa_p").alias("p"), fills(d["m"], v["bid"], "kappa_m").alias("m"))
            return let(filled, lambda f: moved(v, f))

        def moved(v: Column, f: Column) -> Column:
            # An infinite depth is never filled and doesn't count.
            cash = F.when(f["p"] > 0, f["p"] * (v["s"] + v["ask"])).otherwise(zero) - F.when(f["m"] > 0, f["m"] * (v["s"] - v["bid"])).otherwise(zero)
            after = v["s"] + F.size(d["p"]) * F.col("epsilon_p") - F.size(d["m"]) * F.col("epsilon_m") + F.col("sigma") * math.sqrt(dt) * d["w"]
            now = F.struct(d["n"].alias("n"), v["s"].alias("s"), (last["q"] + f["m"] - f["p"]).cast("int").alias("q"), (last["x"] + cash).alias("x"), f["p"].alias("fp"), f["m"].alias("fm"), after.alias("next"))
            return F.concat(acc, F.array(now))

        return let(F.struct(price.alias("s"), F.get("ask", at).alias("ask"), F.get("bid", at).alias("bid")), quoted)

    walked = each.select("symbol", "path_id", F.aggregate("draws", F.array(begin), step).alias("r"))
    last = F.get("r", F.size("r") - 1)
    end = F.struct(F.lit(steps).cast("int").alias("n"), last["next"].alias("s"), last["q"].alias("q"), last["x"].alias("x"), whole.alias("fp"), whole.alias("fm"), zero.alias("next"))
    rows = walked.select("symbol", "path_id", F.explode(F.concat(F.slice("r", 2, steps), F.array(end))).alias("r"))
    return rows.select("symbol", "path_id", "r.n", "r.s", "r.q", "r.x", (F.col("r.x") + F.col("r.q") * F.col("r.s")).alias("pnl"), F.col("r.fp").alias("fills_p"), F.col("r.fm").alias("fills_m"))
