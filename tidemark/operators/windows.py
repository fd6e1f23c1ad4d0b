"""Trailing windows anchored at the data's own end, per symbol, and the overlap of two inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounds(trades: DataFrame, quotes: DataFrame | None = None, minutes: float = 30) -> DataFrame:
    """symbol, start_us, end_us: the last ``minutes`` up to the earlier of the two inputs' ends."""
    span = int(minutes * 60e6)
    end = trades.groupBy("symbol").agg(F.max("us").alias("t"))
    if quotes is None:
        return end.select("symbol", (F.col("t") - span).alias("start_us"), F.col("t").alias("end_us"))
    both = quotes.groupBy("symbol").agg(F.max("us").alias("q")).join(end, "symbol", "left")
    stop = F.coalesce(F.least("q", "t"), "q")
    return both.select("symbol", (stop - span).alias("start_us"), stop.alias("end_us"))


def within(df: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows with start_us <= us <= end_us of their symbol; ``limits`` has one row a symbol."""
    return df.join(limits, "symbol").where("us >= start_us and us <= end_us").drop("start_us", "end_us")


def last_minutes(trades: DataFrame, quotes: DataFrame, minutes: float = 30) -> tuple[DataFrame, DataFrame]:
    limits = bounds(trades, quotes, minutes)
    return within(trades, limits), within(quotes, limits)


def overlap(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """symbol, start_us, end_us that both inputs cover."""
    span = lambda df, a, b: df.groupBy("symbol").agg(F.min("us").alias(a), F.max("us").alias(b))
    both = span(trades, "t0", "t1").join(span(quotes, "q0", "q1"), "symbol")
    return both.select("symbol", F.greatest("t0", "q0").alias("start_us"), F.least("t1", "q1").alias("end_us"))


def calibration_inputs(trades: DataFrame, quotes: DataFrame, minutes: float = 30) -> tuple[DataFrame, DataFrame]:
    """Both inputs cut to the trailing window, then to their overlap."""
    t, q = last_minutes(trades, quotes, minutes)
    shared = overlap(t, q)
    return within(t, shared), within(q, shared)
