"""Backtest scores: daily returns on the full calendar, the Sharpe loss and drawdown figures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLIPPAGE = 0.0005
DAYS = 365


def daily_returns(results: DataFrame, first_day: str | None = None, last_day: str | None = None, slippage: float = SLIPPAGE) -> DataFrame:
    """day, ret: sums of profit ratio less slippage by closing day, 0 on days without trades."""
    days = results.where("close_date is not null").select(F.to_date("close_date").alias("day"), (F.col("profit_ratio") - slippage).alias("r"))
    sums = days.groupBy("day").agg(F.sum("r").alias("ret"))
    lo = F.lit(first_day).cast("date") if first_day else F.min("day")
    hi = F.lit(last_day).cast("date") if last_day else F.max("day")
    calendar = days.agg(lo.alias("lo"), hi.alias("hi")).where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("day"))
    return calendar.join(sums, "day", "left").select("day", F.coalesce("ret", F.lit(0.0)).alias("ret"))


def sharpe_loss(results: DataFrame, **calendar) -> DataFrame:
    """n_trades, sharpe, loss: loss is minus Sharpe times trades; a zero deviation counts as Sharpe -100, a single day as NaN."""
    stats = daily_returns(results, **calendar).agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"), F.count("*").alias("days"))
    nan = F.lit(float("nan"))
    sharpe = F.when(F.col("days") < 2, nan).when(F.col("s") == 0, -100.0).otherwise(F.try_divide(F.col("m"), F.col("s")) * math.sqrt(DAYS))
    return stats.crossJoin(F.broadcast(results.agg(F.count("*").alias("n_trades")))).select("n_trades", sharpe.alias("sharpe")).withColumn("loss", -F.col("sharpe") * F.col("n_trades"))


def drawdown(results: DataFrame, starting_balance: float) -> DataFrame:
    """Profit figures and the largest drawdown of the balance, closing by closing (trades of one time by id).

    The running balance is summed by day first, then within each day, so no task sorts all trades.
    """
    r = results.where("close_date is not null").select(F.to_date("close_date").alias("day"), "close_date", "id", "profit_abs", "profit_ratio")
    by_day = r.groupBy("day").agg(F.sum("profit_abs").alias("p"))
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    before = by_day.select("day", F.coalesce(F.sum("p").over(upto), F.lit(0.0)).alias("before"))
    inside = Window.partitionBy("day").orderBy("close_date", "id").rowsBetween(Window.unboundedPreceding, 0)
    run = r.join(before, "day").withColumn("cum", F.col("before") + F.sum("profit_abs").over(inside))
    peak_day = run.groupBy("day").agg(F.max("cum").alias("top"))
    earlier = peak_day.select("day", F.coalesce(F.max("top").over(upto), F.lit(0.0)).alias("peak"))
    high = F.greatest(F.lit(0.0), "peak", F.max("cum").over(inside))
    under = run.join(earlier, "day").withColumn("high", high).withColumn("dd", F.col("high") - F.col("cum")).withColumn("rel", F.try_divide(F.col("dd"), F.lit(float(starting_balance)) + F.col("high")))
    worst = under.agg(F.max("dd").alias("max_drawdown"), F.max("rel").alias("max_relative"))
    wins = F.count_if(F.col("profit_abs") > 0) / F.count("*")
    plain = results.agg(F.sum("profit_abs").alias("total_profit"), F.median("profit_ratio").alias("median_ratio"), wins.alias("win_rate"))
    out = plain.crossJoin(F.broadcast(worst))
    return out.withColumn("profit_pc", F.col("total_profit") / starting_balance).withColumn("ddc", F.try_divide(F.lit(1.0), 1 - F.coalesce("max_relative", F.lit(0.0))) - 1)
