"""What the training-data operators share: work folders, word rules and small numeric helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Hashable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word rules here: blank and the five ASCII controls 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}
_collecting: ContextVar[tuple[list[str], ...]] = ContextVar("collecting", default=())
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session whose master is this very process has a folder of its own; any other raises,
    because its executors wouldn't see the driver's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
        base = _own_dirs[app]
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex[:12]}"
    for made in _collecting.get():
        made.append(path)
    return path


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The work paths that this thread makes inside the block, for ``remove`` once what was read from them is written."""
    made: list[str] = []
    token = _collecting.set((*_collecting.get(), made))
    try:
        yield made
    finally:
        _collecting.reset(token)


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = work_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    _paths[read] = path
    return read


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned and that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, [_paths.pop(df)])


_kept: dict[Hashable, Any] = {}


def keep(key: Hashable, build: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one operator's state, the last one's, and no other."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def drop_kept() -> None:
    if _kept:
        _kept.clear()
        gc.collect()


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _trim = None


def release() -> None:
    """Give what this process has freed back to the machine: allocators hold it, and idle workers would for as long as they live."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def _leanly(run: Callable[[Iterator], Iterator], keeps: bool, batches: Iterator) -> Iterator:
    if not keeps:
        drop_kept()
    try:
        yield from run(batches)
    finally:
        release()


def lean(run: Callable[[Iterator], Iterator], keeps: bool = False) -> Callable[[Iterator], Iterator]:
    """A task's function that leaves its worker small, as workers stay beside later stages that run in the JVM.

    Only tasks that ``keep`` something find what the one before has kept; any other drops it before it begins.
    """
    return lambda batches: _leanly(run, keeps, batches)  # travels by value, ``_leanly`` by name: it has the worker's own ``_kept``


#: Keys above such a part of the rows are joined by broadcast.
HOT = 1000


def on_key(rows: DataFrame, table: DataFrame, large: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each of ``keys``; ``large`` names the first key's hot values.

    A hot value has more than a ``HOT``th of all rows, so there are fewer than ``HOT``.  Their rows meet a broadcast part
    of the table: no value has a task of its own, and a task's other keys have a ``HOT``th of the rows at most.
    """
    hot_rows, hot_table = (x.join(F.broadcast(large), keys[0], "left_semi") for x in (rows, table))
    other_rows, other_table = (x.join(F.broadcast(large), keys[0], "left_anti") for x in (rows, table))
    return hot_rows.join(F.broadcast(hot_table), keys, how).unionByName(other_rows.join(other_table, keys, how))


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array; null and blank texts give an empty array."""
    t = trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN))


def partitions_of(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def partitions_for(spark: SparkSession, rows: int, each: int) -> int:
    """As many partitions as the session asks for, more where they would have above ``each`` rows."""
    return max(partitions_of(spark), -(-rows // each))


def unit(*cols: Column) -> Column:
    """A repeatable pseudo-random number in (0, 1) from the columns' values."""
    h = F.shiftrightunsigned(F.xxhash64(*cols), 11)
    return (h.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
