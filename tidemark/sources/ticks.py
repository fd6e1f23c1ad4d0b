"""The tick store, parameter files, journals and event logs.

One layout is written and read, by batch jobs and streams: ``<root>/<kind>/symbol=<S>/hour=<H>/*.parquet``, ``H`` being
the hours since 1970 of the receive time.  Symbols and trailing windows prune partitions; what is there and what is
newest is known from directory names alone.  ``read_shards`` reads flat folders of other collectors
(``<root>/<SYMBOL>/<kind>/*.parquet``), and ``import_shards`` brings them into a store.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources import schemas

NEWEST_HOURS = 10
HOUR_SECONDS = 3600
EVENT_LOG_BYTES = 2_000_000


def _hadoop(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def _names(spark: SparkSession, pattern: str) -> list[str]:
    """Last parts of the paths that match, without a job."""
    fs, path = _hadoop(spark, pattern)
    return [str(s.getPath().getName()) for s in (fs.globStatus(path) or [])]


def exists(spark: SparkSession, pattern: str) -> bool:
    return bool(_names(spark, pattern))


def symbols(spark: SparkSession, root: str, kind: str) -> list[str]:
    return sorted(unquote(n.removeprefix("symbol=")) for n in _names(spark, f"{root}/{kind}/symbol=*"))


def catalog(spark: SparkSession, root: str, needs: tuple[str, ...] = ("orderbooks", "trades")) -> list[str]:
    """Sorted symbols that have every kind in ``needs``."""
    return sorted(set.intersection(*(set(symbols(spark, root, kind)) for kind in needs)))


def hours(spark: SparkSession, root: str, kind: str, symbol: str) -> list[int]:
    """The hours that have data, ascending."""
    return sorted(int(n.removeprefix("hour=")) for n in _names(spark, f"{root}/{kind}/symbol={_escaped(symbol)}/hour=*"))


def _escaped(symbol: str) -> str:
    """A symbol as Spark names its folder, safe in a glob."""
    return "".join(f"%{ord(c):02X}" if c in '"#%\'*/:=?\\\x7f{[]^' or c < " " else c for c in symbol)


def hour_of(seconds: Column) -> Column:
    return F.floor(seconds / HOUR_SECONDS).cast("long")


def with_us(df: DataFrame) -> DataFrame:
    """Integer microseconds for all ordering and window arithmetic; NaN numbers become null."""
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    return df.select(*clean).withColumn("us", F.round(F.col("timestamp") * 1e6).cast("long"))


def read_ticks(spark: SparkSession, root: str, kind: str, only: Iterable[str] | None = None, since: dict[str, int] | None = None, levels: int = 20) -> DataFrame:
    """Ticks of a kind, with symbol and hour: of all symbols or ``only`` some, or of those in ``since`` from their hour on.

    A missing folder raises, an empty one gives no rows.
    """
    if not exists(spark, f"{root}/{kind}"):
        raise FileNotFoundError(f"{root}/{kind}")
    schema = schemas.of(kind, levels).add("symbol", "string").add("hour", "long")
    if not exists(spark, f"{root}/{kind}/symbol=*"):
        return spark.createDataFrame([], schema).transform(with_us)
    read = spark.read.schema(schema).parquet(f"{root}/{kind}")
    if only is not None:
        read = read.where(F.col("symbol").isin(list(only)))
    if since is not None:
        one = [(F.col("symbol") == s) & (F.col("hour") >= h) for s, h in since.items()]
        read = read.where(reduce(lambda x, y: x | y, one, F.lit(False)))
    return read.transform(with_us)


def trailing(spark: SparkSession, root: str, kinds: Iterable[str], minutes: float, only: Iterable[str] | None = None) -> dict[str, int]:
    """For each symbol that has all ``kinds`` the first hour of a window of ``minutes`` that ends with the kind that ends first."""
    names = catalog(spark, root, tuple(kinds))
    found = {s: min((hours(spark, root, k, s) or [0])[-1] for k in kinds) for s in names if only is None or s in set(only)}
    return {s: last - int(-(-minutes // 60)) for s, last in found.items()}


def newest(spark: SparkSession, root: str, kind: str, only: Iterable[str] | None = None, limit: int = NEWEST_HOURS, levels: int = 20) -> DataFrame:
    """Ticks of each symbol's ``limit`` newest hours that have data."""
    there = {s: hours(spark, root, kind, s) for s in (symbols(spark, root, kind) if only is None else only)}
    return read_ticks(spark, root, kind, since={s: h[-limit:][0] for s, h in there.items() if h}, levels=levels)


def newest_prices(spark: SparkSession, root: str, only: Iterable[str] | None = None) -> DataFrame:
    """The newest prices with a row order, ``sequence``, as ``latest_mid`` takes them."""
    return newest(spark, root, "prices", only).withColumn("sequence", F.coalesce("exchange_timestamp", F.lit(0)))


def write_ticks(df: DataFrame, root: str, kind: str, mode: str = "append") -> None:
    """Append ticks that have a symbol.  A kind that a stream writes takes no batches: readers go by the stream's log."""
    if exists(df.sparkSession, f"{root}/{kind}/_spark_metadata"):
        raise ValueError(f"{root}/{kind} is written by a stream")
    by_hour = df.withColumn("hour", hour_of(F.col("timestamp")))
    by_hour.write.mode(mode).option("compression", "zstd").partitionBy("symbol", "hour").parquet(f"{root}/{kind}")


def read_shards(spark: SparkSession, root: str, kind: str, symbol: str | None = None, levels: int = 20) -> DataFrame:
    """All files of flat folders ``<root>/<SYMBOL>/<kind>``, with symbol and file_name.

    A missing folder raises, an empty one gives no rows.
    """
    if not exists(spark, f"{root}/{symbol or '*'}/{kind}"):
        raise FileNotFoundError(f"{root}/{symbol or '*'}/{kind}")
    schema = schemas.of(kind, levels)
    if not exists(spark, f"{root}/{symbol or '*'}/{kind}/*.parquet"):
        return spark.createDataFrame([], schema).withColumns({"symbol": F.lit(symbol), "file_name": F.lit(None).cast("string")}).transform(with_us)
    read = spark.read.schema(schema).parquet(f"{root}/{symbol or '*'}/{kind}/*.parquet")
    found = read.withColumns({"symbol": F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+/[^/]+$", 1), "file_name": F.col("_metadata.file_name")})
    return found.transform(with_us)


def newest_shards(df: DataFrame, limit: int = NEWEST_HOURS, shard: str = "file_name") -> DataFrame:
    """Rows of each symbol's ``limit`` newest shards; ``shard`` sorts by age, as flat files' names do by their epoch."""
    files = df.select("symbol", shard).distinct()
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(shard)))
    kept = files.select("symbol", shard, rank.alias("rank")).where(F.col("rank") <= limit).drop("rank")
    return df.join(kept, ["symbol", shard], "left_semi")


def import_shards(spark: SparkSession, flat: str, root: str, kinds: Iterable[str] = ("prices", "trades", "orderbooks"), levels: int = 20) -> None:
    """Append the flat folders' ticks to a store."""
    for kind in kinds:
        if exists(spark, f"{flat}/*/{kind}"):
            write_ticks(read_shards(spark, flat, kind, levels=levels).drop("us", "file_name").where("timestamp is not null"), root, kind)


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def upsert_params(new: DataFrame, path: str) -> None:
    """Replace the rows of the symbols in ``new``, a partition each; other symbols stay as they are."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(path)


def read_params(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PARAMS).parquet(path)


#: Parameter files by kind: the names of a symbol's two sides, and further keys that its entry has.
_SIDES = {"kappa": ("kappa_p", "kappa_m"), "epsilon": ("epsilon_p", "epsilon_m"), "lambda": ("lambda_p", "lambda_m")}
_FURTHER = {"lambda": {"unit": "trades_per_second"}}


def read_json(spark: SparkSession, path: str, kind: str, needed: Iterable[str] | None = None) -> DataFrame:
    """A parameter file as rows: symbol and both sides (kappa, epsilon, lambda), or symbol and mid (kind ``mid``).

    Sides are named like ``kappa+`` or ``kappa_plus``.  Symbols without all values are left out; if one of ``needed``
    is among them, that raises.
    """
    raw = spark.read.text(path, wholetext=True)
    if kind == "mid":
        rows = raw.select(F.explode(F.from_json("value", "map<string, double>")).alias("symbol", "mid")).where("mid is not null")
    else:
        entries = raw.select(F.explode(F.from_json("value", "map<string, map<string, string>>")).alias("symbol", "m"))
        side = lambda sign, word: F.coalesce(F.col("m")[f"{kind}{sign}"], F.col("m")[f"{kind}_{word}"]).try_cast("double")
        rows = entries.select("symbol", side("+", "plus").alias(_SIDES[kind][0]), side("-", "minus").alias(_SIDES[kind][1])).na.drop()
    if needed is not None:
        missing = set(needed).difference(r["symbol"] for r in rows.collect())  # a row a symbol
        if missing:
            raise ValueError(f"{path} lacks {kind} of {', '.join(sorted(missing))}")
    return rows


def upsert_json(params: DataFrame, path: str, kind: str) -> None:
    """Replace the entries of the symbols in ``params`` in a parameter file, or begin one; a corrupt file counts as empty.

    ``params`` has symbol and the kind's columns, a row a symbol; missing values are written as null.
    """
    spark = params.sparkSession
    fs, at = _hadoop(spark, path)
    data: dict = {}
    if fs.exists(at):
        try:
            data = json.loads(spark.read.text(path, wholetext=True).first()["value"])
        except (ValueError, TypeError):
            data = {}
        data = data if isinstance(data, dict) else {}
    for r in params.collect():
        data[r["symbol"]] = r["mid"] if kind == "mid" else {f"{kind}+": r[_SIDES[kind][0]], f"{kind}-": r[_SIDES[kind][1]]} | _FURTHER.get(kind, {})
    new = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    fs.setWriteChecksum(False)  # the file may be edited by hand
    try:
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(data, indent=4).encode()))
        out.close()
    finally:
        fs.setWriteChecksum(True)
    fs.delete(at, False)
    fs.rename(new, at)


def read_journal(spark: SparkSession, url_or_path: str, table: str = "trades") -> DataFrame:
    """The trade journal: over JDBC for ``jdbc:`` addresses (the driver's jar must be there), else Parquet."""
    if url_or_path.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=url_or_path, dbtable=table).load()
    return spark.read.schema(schemas.JOURNAL).parquet(url_or_path)


def append_events(df: DataFrame, path: str, max_bytes: int = EVENT_LOG_BYTES) -> None:
    """Debug events as compact JSON lines.  A log above ``max_bytes`` first becomes the backup ``<path>.1``, the only one."""
    fs, log = _hadoop(df.sparkSession, path)
    if max_bytes > 0 and fs.exists(log) and fs.getContentSummary(log).getLength() > max_bytes:
        _, backup = _hadoop(df.sparkSession, f"{path}.1")
        fs.delete(backup, True)
        fs.rename(log, backup)
    df.write.mode("append").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.EVENT_LOG).json(path)


def latest_book_mid(books: DataFrame, fallback: DataFrame) -> DataFrame:
    """symbol, mid: of the latest snapshot's best levels, else ``fallback`` (symbol, rate)."""
    last = books.groupBy("symbol").agg(F.max_by(F.struct("bid_price_0", "ask_price_0"), F.struct("us", "sequence")).alias("b"))
    mid = last.select("symbol", ((F.col("b.bid_price_0") + F.col("b.ask_price_0")) / 2).alias("m"))
    return fallback.join(mid, "symbol", "left").select("symbol", F.coalesce("m", "rate").alias("mid"))


def has_data(spark: SparkSession, root: str, symbol: str) -> bool:
    """Whether any kind has an hour of the symbol, from directory names."""
    return exists(spark, f"{root}/*/symbol={_escaped(symbol)}/hour=*")
