"""Price impact of trades, robust estimates of it, toxicity and static half-spreads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof

WINDOW_US = 200_000
KEY = ["symbol", "side"]


def mids(quotes: DataFrame) -> DataFrame:
    return quotes.withColumn("mid", (F.col("bid_price_0") + F.col("ask_price_0")) / 2)


def impacts(trades: DataFrame, quotes: DataFrame, pre_us: int = WINDOW_US, post_us: int = WINDOW_US, keep: tuple[str, ...] = ()) -> DataFrame:
    """Mid after minus mid before, signed by side (any side but buy sells), for trades that have both.

    Before: the last quote in [t - pre, t).  After: the first in (t, t + post].  ``keep`` names further columns.
    """
    q = mids(quotes)
    both = asof(trades, q, "pre", ["mid"], within_us=pre_us, inclusive=False)
    both = asof(both, q, "post", ["mid"], within_us=post_us, inclusive=False, forward=True)
    both = both.where("pre is not null and post is not null")
    buy = F.col("side") == "buy"
    move = F.col("post.mid") - F.col("pre.mid")
    return both.select("symbol", F.when(buy, "buy").otherwise("sell").alias("side"), "us", "trade_id", F.when(buy, move).otherwise(-move).alias("impact"), *keep).where("impact is not null")


def within_sigma(df: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Impacts nearer to the mean than ``sigmas`` population deviations; all of them where the deviation is 0."""
    side = Window.partitionBy(*KEY)  # the partitioning that the ranks below need too
    stats = df.withColumns({"m": F.avg("impact").over(side), "s": F.stddev_pop("impact").over(side)})
    return stats.where((F.col("s") == 0) | (F.abs(F.col("impact") - F.col("m")) < sigmas * F.col("s"))).drop("m", "s")


def estimates(df: DataFrame, trim: float = 0.1) -> DataFrame:
    """symbol, side, epsilon (trimmed mean), mean, median, std, n; a symbol's missing side has zeros."""
    kept = within_sigma(df)
    n = F.count("*").over(Window.partitionBy(*KEY))
    rank = F.row_number().over(Window.partitionBy(*KEY).orderBy("impact", "trade_id"))
    inner = (F.col("n") <= 2) | ((F.col("rank") > F.floor(trim * F.col("n"))) & (F.col("rank") <= F.floor((1 - trim) * F.col("n"))))
    ranked = kept.withColumn("n", n).withColumn("rank", rank)
    agg = ranked.groupBy(*KEY).agg(F.avg(F.when(inner, F.col("impact"))).alias("epsilon"), F.avg("impact").alias("mean"), F.median("impact").alias("median"), F.stddev_pop("impact").alias("std"), F.count("*").alias("n"))
    # Two entries a symbol at most.
    sides = agg.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("side", F.struct("epsilon", "mean", "median", "std", "n").alias("e")))).alias("found"))
    each = sides.withColumn("side", F.explode(F.array(F.lit("buy"), F.lit("sell")))).withColumn("e", F.col("found")[F.col("side")])
    zero = lambda c: F.coalesce(F.col(f"e.{c}"), F.lit(0.0)).alias(c)
    return each.select(*KEY, zero("epsilon"), zero("mean"), zero("median"), zero("std"), F.coalesce("e.n", F.lit(0)).alias("n"))


def two_sided(est: DataFrame) -> DataFrame:
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("epsilon")))
    return est.groupBy("symbol").agg(side("buy").alias("epsilon_p"), side("sell").alias("epsilon_m"))


def toxicity_class(worst: Column) -> Column:
    return F.when(worst >= 2, "toxic").when(worst >= 1, "competitive").otherwise("manageable")


def with_toxicity(params: DataFrame) -> DataFrame:
    """``params`` with kappa_epsilon, the worse side's, and its class."""
    worst = F.greatest(F.col("kappa_p") * F.col("epsilon_p"), F.col("kappa_m") * F.col("epsilon_m"))
    return params.withColumns({"kappa_epsilon": worst, "toxicity": toxicity_class(worst)})


def toxicity(params: DataFrame) -> DataFrame:
    return with_toxicity(params).select("symbol", "kappa_epsilon", "toxicity")


def static_spread(params: DataFrame) -> DataFrame:
    """1 / kappa + epsilon on each side, and in per cent of mid (null at mid 0); missing epsilons count as 0."""
    def half(side: str) -> Column:
        eps = F.coalesce(F.when(~F.isnan(f"epsilon_{side}"), F.col(f"epsilon_{side}")), F.lit(0.0))
        return F.try_divide(F.lit(1.0), F.col(f"kappa_{side}")) + eps

    out = params.select("symbol", "mid", half("p").alias("delta_p"), half("m").alias("delta_m"))
    pct = lambda c: F.try_divide(F.col(c) * 100, F.col("mid"))
    return out.select("symbol", "delta_p", "delta_m", pct("delta_p").alias("pct_p"), pct("delta_m").alias("pct_m"))


def impact_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    """symbol, side, bin, low, high, count of impacts, equal widths from least to largest, the last bin closed.

    A side whose impacts are all equal has bins of width 1 / ``bins`` around them.
    """
    ends = df.groupBy(*KEY).agg(F.min("impact").alias("a"), F.max("impact").alias("b"))
    ends = ends.select(*KEY, F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    ends = ends.withColumn("width", (F.col("b") - F.col("a")) / bins)
    placed = df.join(ends, KEY)
    edge = lambda i: F.col("a") + i * F.col("width")
    guess = F.least(F.floor((F.col("impact") - F.col("a")) / F.col("width")), F.lit(bins - 1))
    placed = placed.withColumn("g", guess)
    bin_ = F.when(F.col("impact") < edge(F.col("g")), F.col("g") - 1).when((F.col("impact") >= edge(F.col("g") + 1)) & (F.col("g") < bins - 1), F.col("g") + 1).otherwise(F.col("g"))
    counts = placed.groupBy(*KEY, bin_.cast("int").alias("bin")).agg(F.count("*").alias("count"))
    full = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(counts, [*KEY, "bin"], "left")
    return full.select(*KEY, "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def size_impact(df: DataFrame) -> DataFrame:
    """symbol, side, slope, intercept, n: the line of impact over the root of trade size (``size``), of more than three trades."""
    root = F.sqrt("size")
    agg = df.groupBy(*KEY).agg(F.regr_slope("impact", root).alias("slope"), F.regr_intercept("impact", root).alias("intercept"), F.count("*").alias("n"))
    return agg.where("n > 3")
