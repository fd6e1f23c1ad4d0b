"""Small column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def duration_text(seconds: Column) -> Column:
    """``1d 2h 3m 4s``: leading zero units are left out, seconds always shown."""
    d, h, m, s = F.floor(seconds / 86400), F.floor(seconds % 86400 / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    part = lambda v, u: F.when(v > 0, F.concat(v.cast("string"), F.lit(u)))
    return F.when(seconds.isNotNull(), F.concat_ws(" ", part(d, "d"), part(h, "h"), part(m, "m"), F.concat(s.cast("long").cast("string"), F.lit("s"))))


def sign_class(value: Column) -> Column:
    """gain, loss or flat; text may carry a per-cent sign or the currency; other text is null."""
    v = F.trim(F.replace(F.replace(value.cast("string"), F.lit("%"), F.lit("")), F.lit("USDC"), F.lit(""))).try_cast("double")
    return F.when(v > 0, "gain").when(v < 0, "loss").when(v == 0, "flat")


def name_list(text: Column) -> Column:
    """Names of a comma-separated list, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def pair_symbol(pair: Column, suffix: str = "/USDC:USDC") -> Column:
    return F.replace(pair, F.lit(suffix), F.lit(""))


def linspace(low: Column, high: Column, n: int) -> Column:
    """``n`` evenly spaced points, both ends included."""
    if n < 2:
        return F.array(low.cast("double"))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + i * (high - low) / (n - 1))


def to_us(seconds: Column) -> Column:
    return F.round(seconds * 1e6).cast("long")


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))
