"""Tick-like tables derived from the star-schema test tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "value", us.alias("us"), F.concat(F.lit("S"), F.col("user_id") % 4).alias("symbol"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("event_type") == "purchase", "buy").otherwise("sell")
    picked = _events(spark, sf_dir).where(F.col("event_type").isin("purchase", "signup"))
    return picked.select("symbol", "us", side.alias("side"), F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("event_id").alias("trade_id"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = _events(spark, sf_dir).where(F.col("event_type").isin("view", "click"))
    return picked.select("symbol", "us", (F.col("value") * 0.999).alias("bid_price_0"), (F.col("value") * 1.001).alias("ask_price_0"), F.col("event_id").alias("sequence"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bid and an ask row for each quote; shards of 1,000 quotes by number stand in for files."""
    q = quotes(spark, sf_dir)
    sides = F.explode(F.array(F.struct(F.lit("bid").alias("side"), F.col("bid_price_0").alias("price")), F.struct(F.lit("ask").alias("side"), F.col("ask_price_0").alias("price")))).alias("e")
    shard = F.lpad(F.floor(F.col("sequence") / 1000).cast("string"), 9, "0")
    return q.select("symbol", "us", "sequence", shard.alias("file_name"), sides).select("symbol", "us", "sequence", "file_name", "e.side", "e.price")


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    still = F.col("o_orderstatus") == "O"
    profit = F.col("o_totalprice") - 250000
    closed = lambda c: F.when(~still, c)
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("pair"),
        F.concat(F.lit("C"), F.col("o_custkey") % 3).alias("strategy"),
        still.cast("int").alias("is_open"),
        F.lit(False).alias("is_short"),
        F.col("o_orderdate").alias("open_date"),
        closed(F.expr("o_orderdate + make_dt_interval(cast(1 + o_orderkey % 90 as int))")).alias("close_date"),
        closed(profit / F.col("o_totalprice")).alias("close_profit"),
        closed(profit).alias("close_profit_abs"),
        F.col("o_totalprice").alias("stake_amount"),
        F.lit("USDC").alias("stake_currency"),
        (F.col("o_totalprice") / 100).alias("open_rate"),
    )


def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 symbols with plausible, different parameters, from ``nation``'s keys."""
    k = F.col("n_nationkey")
    value = lambda base, step, mod: F.lit(base) + F.lit(step) * (k % mod)
    named: dict[str, Column] = {
        "kappa_p": value(4.0, 0.5, 7), "kappa_m": value(3.5, 0.75, 5), "lambda_p": value(0.1, 0.05, 6),
        "lambda_m": value(0.12, 0.04, 4), "epsilon_p": value(0.01, 0.02, 5), "epsilon_m": value(0.02, 0.01, 6), "mid": value(50.0, 25.0, 9),
    }
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("S"), k).alias("symbol"), *[c.alias(n) for n, c in named.items()])
