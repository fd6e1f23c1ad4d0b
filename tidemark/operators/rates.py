"""Arrival rates, latest mid price and ingest statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def raw_lambda(trades: DataFrame) -> DataFrame:
    """Trades a second by side over the observed span; the total counts any side."""
    side = F.lower("side")
    span = F.greatest((F.max("us") - F.min("us")) / 1e6, F.lit(1e-6))
    agg = trades.groupBy("symbol").agg(F.count_if(side == "buy").alias("n_buy"), F.count_if(side == "sell").alias("n_sell"), F.count("*").alias("n_total"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), span.alias("span"))
    rate = lambda c: F.col(c) / F.col("span")
    return agg.select("symbol", rate("n_buy").alias("lambda_p"), rate("n_sell").alias("lambda_m"), rate("n_total").alias("lambda_total"), "n_buy", "n_sell", "n_total", "start_us", "end_us")


def latest_mid(prices: DataFrame, shard: str = "file_name") -> DataFrame:
    """symbol, bid, ask, mid: each side from the newest shard that has it, at its latest time (first row on ties).

    ``prices`` has a row order, ``sequence``, and the column ``shard``, which sorts shards by age.  Without both sides a symbol has no row.
    """
    side = F.lower("side")
    newest = lambda s: F.max_by(F.when(side == s, F.col("price")), F.when((side == s) & F.col("price").isNotNull(), F.struct(shard, "us", (-F.col("sequence")).alias("k"))))
    both = prices.groupBy("symbol").agg(newest("bid").alias("bid"), newest("ask").alias("ask"))
    return both.where("bid is not null and ask is not null").withColumn("mid", (F.col("bid") + F.col("ask")) / 2)


def ingest_rates(rows: DataFrame) -> DataFrame:
    """Rows a minute of each (symbol, kind) over its run time."""
    agg = rows.groupBy("symbol", "kind").agg(F.count("*").alias("n"), ((F.max("us") - F.min("us")) / 60e6).alias("minutes"))
    return agg.select("symbol", "kind", "n", F.try_divide(F.col("n"), F.col("minutes")).alias("per_minute"))
