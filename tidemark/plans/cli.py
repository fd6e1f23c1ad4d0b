"""Command line: ``python -m tidemark.plans.cli kappa|epsilon|lambda|mid|calibrate|run|spreads|ingest|import|report ...``.

``--root`` is a tick store (see ``tidemark.sources.ticks``).  Results are shown, or written to ``--output`` as Parquet;
``--json`` names a folder whose parameter files (kappa.json and so on) get the symbols' entries.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import impact
from tidemark.plans import calibrate as plan
from tidemark.plans import runner
from tidemark.sources import ticks

#: Parameter files by kind.
FILES = {"kappa": "kappa.json", "lambda": "lambda.json", "epsilon": "epsilon.json", "mid": "mid_price.json"}
RATES_FILE = "lambda_trades.json"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("kappa", "epsilon", "lambda", "mid", "calibrate", "run", "spreads"):
        p = sub.add_parser(name)
        p.add_argument("--root", required=True, help="tick store")
        p.add_argument("--crypto", default="ALL", help="a symbol or ALL")
        p.add_argument("--minutes", type=float, default=30)
        p.add_argument("--bins", type=int, default=20)
        p.add_argument("--output", help="Parquet folder for the result")
        p.add_argument("--json", help="folder of the parameter files")
        if name == "run":
            p.add_argument("--interval", type=float, default=runner.INTERVAL, help="seconds between cycles")
            mode = p.add_mutually_exclusive_group()
            mode.add_argument("--once", action="store_true", help="one cycle (the default)")
            mode.add_argument("--loop", action="store_true", help="cycle after cycle")
        if name == "spreads":
            p.add_argument("--mid", type=float)
            p.add_argument("--alpha", type=float, default=0.0)
            p.add_argument("--phi", type=float, default=0.0)
            p.add_argument("--qmax", type=int, default=3)
            p.add_argument("--horizon", type=float, default=60.0)
            p.add_argument("--steps", type=int, default=200)
            p.add_argument("--asym-kappa", action="store_true")
    i = sub.add_parser("ingest", help="raw messages to the tick store")
    i.add_argument("--raw", required=True, help="folder of JSON lines")
    i.add_argument("--root", required=True)
    i.add_argument("--kind", required=True, choices=("prices", "trades", "orderbooks"))
    i.add_argument("--checkpoint", required=True)
    i.add_argument("--seconds", type=int, default=60, help="between flushes; 0 drains what is there and stops")
    i.add_argument("--idle", type=float, default=180.0, help="seconds without rows after which the stream starts anew")
    m = sub.add_parser("import", help="flat folders of another collector to the tick store")
    m.add_argument("--flat", required=True)
    m.add_argument("--root", required=True)
    r = sub.add_parser("report")
    r.add_argument("journal", help="Parquet folder or jdbc: address")
    r.add_argument("--output")
    return top


def _symbols(spark: SparkSession, a: argparse.Namespace, needs: tuple[str, ...]) -> list[str]:
    names = ticks.catalog(spark, a.root, needs)
    if a.crypto != "ALL" and a.crypto not in names:
        raise FileNotFoundError(f"{a.root} has no {' and '.join(needs)} of {a.crypto}; it has {', '.join(names) or 'nothing'}")
    return names if a.crypto == "ALL" else [a.crypto]


def _save(a: argparse.Namespace, out: DataFrame, files: dict[str, str]) -> None:
    for kind, name in files.items() if a.json else ():
        kept = out.where("mid is not null") if kind == "mid" else out
        ticks.upsert_json(kept, os.path.join(a.json, name), kind)
    out.write.mode("overwrite").parquet(a.output) if a.output else out.show(1000, truncate=False)


def _calibrated(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Parameters of the store's symbols with their stored mids, read once."""
    names = _symbols(spark, a, ("orderbooks", "trades"))
    trades, books = plan.store_window(spark, a.root, a.minutes, names)
    return impact.with_toxicity(plan.calibrate(trades, books, plan.store_mids(spark, a.root, names), a.minutes, bins=a.bins))


def _ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    from tidemark.streaming import ingest as stream

    start = lambda: stream.ingest(spark, a.raw, a.root, a.kind, a.checkpoint, a.seconds or None)
    if not a.seconds:
        start().awaitTermination()
        return
    dog = stream.Watchdog(a.idle)
    spark.streams.addListener(dog)
    try:
        stream.supervise(start, dog)
    finally:
        spark.streams.removeListener(dog)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "report":
        for name, df in plan.journal_report(ticks.read_journal(spark, a.journal)).items():
            df.write.mode("overwrite").parquet(f"{a.output}/{name}") if a.output else df.show(truncate=False)
    elif a.command == "ingest":
        _ingest(spark, a)
    elif a.command == "import":
        ticks.import_shards(spark, a.flat, a.root)
    elif a.command == "lambda":
        since = ticks.trailing(spark, a.root, ("trades",), a.minutes, _symbols(spark, a, ("trades",)))
        _save(a, plan.monitor(ticks.read_ticks(spark, a.root, "trades", since=since), a.minutes), {"lambda": RATES_FILE})
    elif a.command == "mid":
        _symbols(spark, a, ("prices",))
        _save(a, plan.store_mids(spark, a.root, None if a.crypto == "ALL" else [a.crypto]), {"mid": FILES["mid"]})
    elif a.command in ("kappa", "epsilon"):
        trades, books = plan.store_window(spark, a.root, a.minutes, _symbols(spark, a, ("orderbooks", "trades")))
        if a.command == "kappa":
            _save(a, plan.fit_kappa(trades, books, a.minutes, a.bins), {k: FILES[k] for k in ("kappa", "lambda")})
        else:
            _save(a, plan.fit_epsilon(trades, books, a.minutes), {"epsilon": FILES["epsilon"]})
    elif a.command == "calibrate":
        _save(a, _calibrated(spark, a).persist(), FILES)
    elif a.command == "run":
        if not a.output:
            raise SystemExit("run needs --output, the parameters' folder")
        only = None if a.crypto == "ALL" else [a.crypto]

        def cycle(number: int) -> None:
            done = plan.calibrate_store(spark, a.root, a.output, only, a.minutes, bins=a.bins, generation=number)
            for kind, name in FILES.items() if a.json and done else ():
                rows = ticks.read_params(spark, a.output).where(F.col("symbol").isin(done))
                ticks.upsert_json(rows.where("mid is not null") if kind == "mid" else rows, os.path.join(a.json, name), kind)

        runner.repeat(cycle, a.interval, once=not a.loop, report=lambda n, e: print(f"cycle {n}: {e}", file=sys.stderr))
    else:
        params = _calibrated(spark, a)
        if a.mid is not None:  # else the stored mid, else 1
            params = params.withColumn("mid", F.lit(a.mid).cast("double"))
        _save(a, plan.spreads(params, a.asym_kappa, a.qmax, a.horizon, a.alpha, a.phi, a.steps).orderBy("symbol", "q"), {})


if __name__ == "__main__":
    main()
