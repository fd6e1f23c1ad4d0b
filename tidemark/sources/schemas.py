"""Declared schemas.  Shards are always read with these: an all-null column in a shard defeats inference and merging."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"double": T.DoubleType(), "long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "doubles": T.ArrayType(T.DoubleType())}


def _struct(spec: str) -> T.StructType:
    """``name type, ...`` as a schema, without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (field.split() for field in spec.split(", "))])


PRICES = _struct("timestamp double, price double, size double, side string, exchange_timestamp long")
TRADES = _struct("timestamp double, price double, size double, side string, trade_id string, exchange_timestamp long")
JOURNAL = _struct(
    "id long, pair string, strategy string, is_open int, is_short boolean, open_date timestamp, close_date timestamp, "
    "close_profit double, close_profit_abs double, stake_amount double, stake_currency string, open_rate double"
)
BACKTEST = _struct("profit_abs double, profit_ratio double, close_date timestamp")
PARAMS = _struct("symbol string, kappa_p double, kappa_m double, lambda_p double, lambda_m double, epsilon_p double, epsilon_m double, mid double, generation long, asof long")
_LEVEL = "array<struct<px: string, sz: string>>"
#: Wire messages; px and sz arrive as strings or numbers, both parse as strings.
BBO_MESSAGE = f"struct<channel: string, data: struct<coin: string, time: bigint, bbo: {_LEVEL}>, coin: string, time: bigint, bid: struct<px: string, sz: string>, ask: struct<px: string, sz: string>>"
TRADE = "struct<coin: string, side: string, px: string, sz: string, tid: string, time: bigint>"
BOOK_MESSAGE = f"struct<channel: string, data: struct<coin: string, time: bigint, levels: array<{_LEVEL}>>, coin: string, time: bigint, levels: array<{_LEVEL}>>"
EVENT_LOG = _struct(
    "ts double, event string, pair string, symbol string, action string, side string, q int, mid double, proposed_rate double, price double, "
    "delta_model double, fee_cushion double, delta_total double, bps double, reason string, hjb_generation long"
)
EVENT_LOG.add("params", _struct("kappa_p double, kappa_m double, lambda_p double, lambda_m double, epsilon_p double, epsilon_m double"))
EVENT_LOG.add("hjb", _struct("q_grid doubles, h doubles, delta_plus doubles, delta_minus doubles"))


def orderbooks(levels: int = 20) -> T.StructType:
    """Wide snapshot: four columns a level, best first."""
    fields = ["timestamp double", "sequence long", "exchange_timestamp long"]
    for i in range(levels):
        fields += [f"{side}_{what}_{i} double" for side in ("bid", "ask") for what in ("price", "size")]
    return _struct(", ".join(fields))


def of(dtype: str, levels: int = 20) -> T.StructType:
    """A new schema object for a data type."""
    return T.StructType(list({"prices": PRICES, "trades": TRADES}[dtype])) if dtype in ("prices", "trades") else orderbooks(levels)
