"""As-of joins: one shuffle and one sort, no pairs.

Both sides are united, ordered by time within (key, time bucket), and the right side's last row is carried forward.  A
bucket's first rows need the last right row of earlier buckets: buckets' last rows are aggregated, carried over the
buckets (one row a bucket) and put in front.  So a symbol with a third of all ticks is many tasks, not one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_US = 6 * 3_600_000_000
_LOWEST = -(1 << 63)


def asof(left: DataFrame, right: DataFrame, out: str, payload: list[str], lag_us: int = 0, within_us: int | None = None, inclusive: bool = True, forward: bool = False, by: str = "symbol", tie: str = "sequence", bucket_us: int = BUCKET_US) -> DataFrame:
    """``left`` with struct ``out`` (us and ``payload``) of the nearest ``right`` row, null where there is none.

    Backward: the last right row with ``us + lag_us <= left.us`` (``<`` unless ``inclusive``).  Forward: the first with
    ``us + lag_us >= left.us`` (``>``).  ``within_us`` bounds the distance, inclusively.  Right rows at one time: the
    largest ``tie`` counts backward, the smallest forward.  A null inside the payload is carried like any value.
    """
    sign = -1 if forward else 1
    carried = F.struct("us", *payload)
    when = sign * (F.col("us") + lag_us)
    r = right.select(F.col(by).alias("_by"), when.alias("_at"), F.lit(0 if inclusive else 1).alias("_tag"), (sign * F.col(tie)).alias("_tie"), carried.alias("_right"))
    lefts = F.struct(*left.columns)
    le = left.select(F.col(by).alias("_by"), (sign * F.col("us")).alias("_at"), F.lit(1 if inclusive else 0).alias("_tag"), lefts.alias("_left"))
    bucket = F.floor(F.col("_at") / bucket_us)
    r, le = r.withColumn("_bucket", bucket), le.withColumn("_bucket", bucket)
    both = r.select("_by", "_bucket", "_at", "_tie", "_right").unionByName(le.select("_by", "_bucket"), allowMissingColumns=True)
    buckets = both.groupBy("_by", "_bucket").agg(F.max_by("_right", F.when(F.col("_right").isNotNull(), F.struct("_at", "_tie"))).alias("_last"))
    earlier = Window.partitionBy("_by").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    front = buckets.select("_by", "_bucket", F.last("_last", ignorenulls=True).over(earlier).alias("_right")).where("_right is not null")
    front = front.withColumns({"_at": F.lit(_LOWEST), "_tag": F.lit(0), "_tie": F.lit(_LOWEST)})
    united = r.unionByName(front).unionByName(le, allowMissingColumns=True)
    order = Window.partitionBy("_by", "_bucket").orderBy("_at", "_tag", F.col("_tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    matched = united.withColumn(out, F.last("_right", ignorenulls=True).over(order)).where("_left is not null").select("_left.*", out)
    if within_us is not None:
        near = F.abs(F.col("us") - (F.col(f"{out}.us") + lag_us)) <= within_us
        matched = matched.withColumn(out, F.when(near, F.col(out)))
    return matched
