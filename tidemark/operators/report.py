"""Trade-journal report: summary, extremes, performance by pair and strategy, open trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import duration_text


def closed(journal: DataFrame) -> DataFrame:
    return journal.where("is_open = 0")


def summary(journal: DataFrame) -> DataFrame:
    """One row; a trade of zero profit is a loss, profit per cent is the sum of the trades' ratios."""
    done = F.col("is_open") == 0
    seconds = F.when(done, (F.unix_micros(F.col("close_date").cast("timestamp")) - F.unix_micros(F.col("open_date").cast("timestamp"))) / 1e6)
    when = lambda c: F.when(done, c)
    agg = journal.agg(
        F.count("*").alias("total"), F.count_if(done).alias("closed"), F.count_if(F.col("is_open") == 1).alias("open"),
        F.sum(when(F.col("close_profit_abs"))).alias("profit_abs"), (F.sum(when(F.col("close_profit"))) * 100).alias("profit_pct"),
        F.count_if(done & (F.col("close_profit_abs") > 0)).alias("wins"), F.count_if(done & (F.col("close_profit_abs") <= 0)).alias("losses"),
        F.avg(seconds).alias("mean_seconds"),
    )
    return agg.withColumn("win_rate", F.try_divide(F.col("wins") * 100.0, F.col("closed"))).withColumn("mean_duration", duration_text(F.floor("mean_seconds").cast("long")))


def extremes(journal: DataFrame) -> DataFrame:
    """The best and the worst closed trade; of equal profits the smaller id."""
    row = F.struct("id", "pair", "close_profit_abs", "close_date")
    best = F.max_by(row, F.struct("close_profit_abs", -F.col("id")))
    worst = F.min_by(row, F.struct("close_profit_abs", "id"))
    both = closed(journal).where("close_profit_abs is not null").agg(best.alias("b"), worst.alias("w"))
    kinds = F.array(F.struct(F.lit("best").alias("kind"), F.col("b").alias("t")), F.struct(F.lit("worst").alias("kind"), F.col("w").alias("t")))
    return both.select(F.explode(kinds).alias("e")).where("e.t is not null").select("e.kind", "e.t.*")


def by(journal: DataFrame, key: str) -> DataFrame:
    """Total and mean profit and count of closed trades, best first; a null key isn't a group."""
    agg = closed(journal).where(F.col(key).isNotNull()).groupBy(key).agg(F.sum("close_profit_abs").alias("total_profit"), F.count("id").alias("n"), F.avg("close_profit").alias("mean_profit"))
    return agg.orderBy(F.desc("total_profit"))


def by_pair(journal: DataFrame) -> DataFrame:
    return by(journal, "pair")


def by_strategy(journal: DataFrame) -> DataFrame:
    return by(journal, "strategy").drop("mean_profit")


def open_trades(journal: DataFrame) -> DataFrame:
    """The listed columns that exist, formatted for display."""
    shown: dict[str, Column] = {
        "id": F.col("id"), "pair": F.col("pair"), "open_date": F.col("open_date"), "stake_amount": F.format_string("%.2f", "stake_amount") if "stake_amount" in journal.columns else None,
        "open_rate": F.format_string("%.4f", "open_rate") if "open_rate" in journal.columns else None, "is_short": F.when(F.col("is_short"), "Yes").otherwise("No") if "is_short" in journal.columns else None,
    }
    return journal.where("is_open = 1").select(*[c.alias(n) for n, c in shown.items() if n in journal.columns])
