"""Quotes from depths: ladders over the inventory grid and entry, exit and adjusted prices at an inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAKER_FEE = 0.00015


def parameters(kappa: DataFrame, epsilon: DataFrame, rates: DataFrame | None = None, mids: DataFrame | None = None) -> DataFrame:
    """One row a symbol that has kappa and epsilon on both sides; missing rates are 0."""
    both = kappa.select("symbol", "kappa_p", "kappa_m").join(epsilon.select("symbol", "epsilon_p", "epsilon_m"), "symbol").na.drop()
    if rates is not None:
        both = both.join(rates.select("symbol", "lambda_p", "lambda_m"), "symbol", "left")
    else:
        both = both.withColumns({"lambda_p": F.lit(0.0), "lambda_m": F.lit(0.0)})
    both = both.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("lambda_p", "lambda_m")})
    return both.join(mids.select("symbol", "mid"), "symbol", "left") if mids is not None else both.withColumn("mid", F.lit(None).cast("double"))


def clamp_inventory(q: Column, q_max: int) -> Column:
    return F.greatest(F.lit(-q_max), F.least(F.lit(q_max), q))


def spread_bps(delta: Column, mid: Column) -> Column:
    """Basis points of mid; NaN where mid isn't positive."""
    return F.when(mid > 0, delta / F.when(mid > 0, mid) * 1e4).otherwise(F.lit(float("nan")))


def ladder(surface: DataFrame, params: DataFrame, fee: float = MAKER_FEE) -> DataFrame:
    """symbol, q, bid_px, ask_px, bid_bps, ask_bps for every grid point; a missing mid is 1, at mid 0 bps are null."""
    mids = params.select("symbol", F.coalesce("mid", F.lit(1.0)).alias("mid"))
    rows = surface.join(mids, "symbol")
    cushion = fee * F.col("mid") * 2
    bid, ask = F.col("delta_minus") + cushion, F.col("delta_plus") + cushion
    bps = lambda d: F.try_divide(d, F.col("mid")) * 1e4
    return rows.select("symbol", "q", (F.col("mid") - bid).alias("bid_px"), (F.col("mid") + ask).alias("ask_px"), bps(bid).alias("bid_bps"), bps(ask).alias("ask_bps"))


def inventory_level(journal: DataFrame, q_max: int = 3) -> DataFrame:
    """Open trades of each pair, clamped to the grid; pairs without open trades have 0."""
    return journal.groupBy("pair").agg(clamp_inventory(F.count_if(F.col("is_open") == 1), q_max).cast("int").alias("q"))


def bot_quotes(requests: DataFrame, surface: DataFrame, q_max: int = 3, fee: float = MAKER_FEE) -> DataFrame:
    """Prices for requests (symbol, q, mid, is_short, proposed_rate, current_order_rate).

    Entry and adjustment quote the bid, exit the ask.  Short: null.  Without depths: null, the proposed rate on exit,
    the current order's rate on adjustment.  bps are null where mid isn't positive.
    """
    at = requests.withColumn("q_used", clamp_inventory(F.col("q"), q_max))
    s = surface.select("symbol", F.col("q").alias("q_used"), "delta_plus", "delta_minus")
    j = at.join(s, ["symbol", "q_used"], "left")
    cushion = fee * F.col("mid") * 2
    bid, ask = F.col("mid") - (F.col("delta_minus") + cushion), F.col("mid") + (F.col("delta_plus") + cushion)
    long = lambda c: F.when(~F.col("is_short"), c)
    bps = lambda d: F.when(F.col("mid") > 0, (d + cushion) / F.when(F.col("mid") > 0, F.col("mid")) * 1e4)
    return j.select(
        *requests.columns, "q_used", long(bid).alias("entry_price"), long(F.coalesce(ask, "proposed_rate")).alias("exit_price"),
        long(F.coalesce(bid, "current_order_rate")).alias("adjust_price"), bps(F.col("delta_minus")).alias("bid_bps"), bps(F.col("delta_plus")).alias("ask_bps"),
    )


def entry_signals(candles: DataFrame, ready: DataFrame) -> DataFrame:
    """enter_long is 1 where the symbol's kappa, epsilon, depths and data are there; exit_long is 0."""
    r = ready.select("symbol", (F.col("kappa") & F.col("epsilon") & F.col("depths") & F.col("data")).alias("_all"))
    return candles.join(r, "symbol", "left").withColumns({"enter_long": F.coalesce(F.col("_all").cast("int"), F.lit(0)), "exit_long": F.lit(0)}).drop("_all")
