"""Wire messages to rows.  Input: a string column ``value`` and the receive time ``timestamp`` in seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources import schemas


def _number(c: Column) -> Column:
    return c.try_cast("double")


def bbo_rows(raw: DataFrame) -> DataFrame:
    """One row a side.  The channel form needs both sides; the direct form may lack one."""
    m = raw.select("timestamp", F.from_json("value", schemas.BBO_MESSAGE).alias("m"))
    channel = (F.col("m.channel") == "bbo") & F.col("m.data").isNotNull()
    both = F.size("m.data.bbo") >= 2
    pick = lambda i, name: F.when(F.coalesce(channel, F.lit(False)), F.when(both, F.get("m.data.bbo", F.lit(i)))).otherwise(F.col(f"m.{name}"))
    coin = F.coalesce(F.when(F.coalesce(channel, F.lit(False)), F.col("m.data.coin")).otherwise(F.col("m.coin")), F.lit("UNKNOWN"))
    time = F.when(F.coalesce(channel, F.lit(False)), F.col("m.data.time")).otherwise(F.col("m.time"))
    sides = F.array(F.struct(F.lit("bid").alias("side"), pick(0, "bid").alias("l")), F.struct(F.lit("ask").alias("side"), pick(1, "ask").alias("l")))
    rows = m.select(coin.alias("symbol"), "timestamp", time.alias("exchange_timestamp"), F.explode(sides).alias("e")).where("e.l is not null")
    return rows.select("symbol", "timestamp", _number(F.col("e.l.px")).alias("price"), _number(F.col("e.l.sz")).alias("size"), "e.side", "exchange_timestamp")


def trade_rows(raw: DataFrame) -> DataFrame:
    """One row a trade of a channel message, a bare list or a bare object.  Side ``A`` sells, anything else buys."""
    text = F.trim("value")
    inner = F.when(text.startswith("["), text).otherwise(F.coalesce(F.get_json_object("value", "$.data"), F.concat(F.lit("["), text, F.lit("]"))))
    inner = F.when(F.trim(inner).startswith("["), inner).otherwise(F.concat(F.lit("["), inner, F.lit("]")))
    t = raw.select("timestamp", F.explode(F.from_json(inner, f"array<{schemas.TRADE}>")).alias("t")).where("t is not null")
    return t.select(
        F.coalesce("t.coin", F.lit("UNKNOWN")).alias("symbol"), "timestamp", _number(F.col("t.px")).alias("price"), _number(F.col("t.sz")).alias("size"),
        F.when(F.col("t.side") == "A", "sell").otherwise("buy").alias("side"), F.coalesce("t.tid", F.lit("None")).alias("trade_id"), F.col("t.time").alias("exchange_timestamp"),
    )


def book_rows(raw: DataFrame, levels: int = 20) -> DataFrame:
    """One wide row a snapshot: bids are the first list, asks the second; missing levels are null, further ones cut.

    With fewer than two lists all levels are null.  Text that isn't a message leaves no row.
    """
    m = raw.select("timestamp", F.from_json("value", schemas.BOOK_MESSAGE).alias("m"))
    ch = F.coalesce((F.col("m.channel") == "l2Book") & F.col("m.data").isNotNull(), F.lit(False))
    pick = lambda f: F.when(ch, F.col(f"m.data.{f}")).otherwise(F.col(f"m.{f}"))
    m = m.select(F.coalesce(pick("coin"), F.lit("UNKNOWN")).alias("symbol"), "timestamp", pick("time").alias("sequence"), pick("time").alias("exchange_timestamp"), F.when(F.size(pick("levels")) >= 2, pick("levels")).alias("l"), F.coalesce("m.channel", "m.coin", F.col("m.time").cast("string"), F.to_json("m.levels")).alias("some")).where("some is not null")
    wide = []
    for i in range(levels):
        for k, side in enumerate(("bid", "ask")):
            level = F.get(F.get("l", F.lit(k)), F.lit(i))
            wide += [_number(level["px"]).alias(f"{side}_price_{i}"), _number(level["sz"]).alias(f"{side}_size_{i}")]
    return m.select("symbol", "timestamp", "sequence", "exchange_timestamp", *wide)


def book_levels(books: DataFrame, levels: int = 20) -> DataFrame:
    """The wide row's levels as one array of (level, bid, bid_size, ask, ask_size)."""
    each = [F.struct(F.lit(i).alias("level"), *[F.col(f"{s}_{w}_{i}").alias(f"{s}_{w}") for s in ("bid", "ask") for w in ("price", "size")]) for i in range(levels)]
    return books.select("symbol", "timestamp", "sequence", F.array(*each).alias("levels"))
