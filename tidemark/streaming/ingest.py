"""Streaming: raw messages to the tick store, and re-calibration after every micro-batch.

Raw drops are JSON lines ``{"timestamp": seconds, "value": "<message>"}``, a folder for each kind of message.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidemark.operators import normalise
from tidemark.plans.calibrate import calibrate_store
from tidemark.sources import ticks

RAW = "timestamp double, value string"
KINDS: dict[str, Callable[..., DataFrame]] = {"prices": normalise.bbo_rows, "trades": normalise.trade_rows, "orderbooks": normalise.book_rows}


def raw_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_trigger).json(path)


def ingest(spark: SparkSession, raw: str, root: str, kind: str, checkpoint: str, seconds: int | None = 60, **options) -> StreamingQuery:
    """Normalise and append to the tick store, exactly once (the file sink's log); ``seconds`` None drains and stops."""
    rows = KINDS[kind](raw_stream(spark, raw), **options).where("timestamp is not null").withColumn("hour", ticks.hour_of(F.col("timestamp")))
    writer = rows.writeStream.format("parquet").option("compression", "zstd").option("checkpointLocation", checkpoint).partitionBy("symbol", "hour")
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return writer.trigger(**trigger).start(f"{root}/{kind}")


def recalibrate(spark: SparkSession, raw_trigger: str, root: str, out: str, checkpoint: str, seconds: int | None = 15, on_error: Callable[[int, Exception], None] | None = None, **options) -> StreamingQuery:
    """After every micro-batch of ``raw_trigger`` the store's trailing window is calibrated anew and upserted.

    The window is anchored at the data's end, not at the clock's slots, so this is a batch job a trigger, over the
    window's hours only.  A failed or empty calibration leaves the last good rows; the generation is the batch's number.
    """

    def step(_: DataFrame, number: int) -> None:
        try:
            calibrate_store(spark, root, out, generation=number, **options)
        except Exception as e:  # the stream goes on with the last good parameters; the caller is told
            if on_error is None:
                raise
            on_error(number, e)

    writer = raw_stream(spark, raw_trigger).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"})).start()


class Watchdog(StreamingQueryListener):
    """Counts rows and remembers when each query last made progress; ``stale`` names those idle for too long."""

    def __init__(self, idle_seconds: float = 180.0) -> None:
        self.idle_seconds = idle_seconds
        self.rows: dict[str, int] = {}
        self.seen: dict[str, float] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.seen[str(event.id)] = time.monotonic()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        key = str(event.progress.id)
        if event.progress.numInputRows:
            self.seen[key] = time.monotonic()
            self.rows[key] = self.rows.get(key, 0) + event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.seen.pop(str(event.id), None)

    def stale(self) -> list[str]:
        now = time.monotonic()
        return [k for k, t in self.seen.items() if now - t > self.idle_seconds]


def supervise(start: Callable[[], StreamingQuery], dog: Watchdog, attempts: int = 3, backoff: float = 5.0, poll: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> None:
    """Keep a query alive: one that failed or is stale is stopped and started again.

    Returns when the query ends by itself.  After ``attempts`` starts in a row that failed the process exits with
    status 1, for whatever restarts the process; rows already committed stay.
    """
    query = start()
    while True:
        if not query.isActive and query.exception() is None:
            return
        if query.isActive and str(query.id) not in dog.stale():
            sleep(poll)
            continue
        if query.isActive:
            query.stop()
        for failed in range(1, attempts + 1):
            sleep(backoff)
            try:
                query = start()
                dog.seen[str(query.id)] = time.monotonic()
                break
            except Exception as e:
                if failed == attempts:
                    raise SystemExit(1) from e


__all__ = ["KINDS", "RAW", "Watchdog", "calibrate_store", "ingest", "raw_stream", "recalibrate", "supervise"]
