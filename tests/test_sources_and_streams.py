"""Storage, messages, streams and the driver's contract."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import normalise
from tidemark.plans import calibrate as plan
from tidemark.plans import cli, runner
from tidemark.sources import schemas, ticks
from tidemark.streaming import ingest


def raw(spark, *messages):
    return spark.createDataFrame([(1.5, m if isinstance(m, str) else json.dumps(m)) for m in messages], "timestamp double, value string")


def test_messages(spark):
    level = lambda p: {"px": str(p), "sz": "2"}
    b = normalise.bbo_rows(raw(spark, {"channel": "bbo", "data": {"coin": "A", "time": 7, "bbo": [level(1), level(2)]}}, {"coin": "B", "time": 8, "ask": level(3)}, {"bid": {"px": 4, "sz": 5}}))
    assert sorted((r["symbol"], r["side"], r["price"], r["exchange_timestamp"]) for r in b.collect()) == [("A", "ask", 2.0, 7), ("A", "bid", 1.0, 7), ("B", "ask", 3.0, 8), ("UNKNOWN", "bid", 4.0, None)]
    t = normalise.trade_rows(raw(spark, {"channel": "trades", "data": [{"coin": "A", "side": "A", "px": "1", "sz": "2", "tid": 5, "time": 9}, {"coin": "A", "side": "Z", "px": "1", "sz": "2", "time": 9}]}, [{"coin": "B", "side": "B", "px": 3, "sz": 4, "tid": 1, "time": 1}], {"coin": "C", "side": "A", "px": 3, "sz": 4, "tid": 1, "time": 1}))
    assert sorted((r["symbol"], r["side"], r["trade_id"], r["price"]) for r in t.collect()) == [("A", "buy", "None", 1.0), ("A", "sell", "5", 1.0), ("B", "buy", "1", 3.0), ("C", "sell", "1", 3.0)]
    k = normalise.book_rows(raw(spark, {"channel": "l2Book", "data": {"coin": "A", "time": 7, "levels": [[level(1)], [level(2), level(3), level(4)]]}}), 2)
    books, k = k, k.first()
    one = normalise.book_rows(raw(spark, {"channel": "l2Book", "data": {"coin": "A", "time": 8, "levels": [[level(1)]]}}, {"coin": "B", "time": 9}, "not a message"), 1)
    assert sorted(map(tuple, one.collect())) == [("A", 1.5, 8, 8, None, None, None, None), ("B", 1.5, 9, 9, None, None, None, None)]
    assert (k["bid_price_0"], k["bid_price_1"], k["ask_price_1"], k["sequence"]) == (1.0, None, 3.0, 7)
    assert normalise.book_levels(books, 2).first()["levels"][1]["ask_price"] == 3.0


def shard(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_flat_folders(spark, tmp_path):
    """Folders of another collector are read and brought into a store."""
    root, store = str(tmp_path / "flat"), str(tmp_path / "store")
    books = schemas.orderbooks(2)
    with pytest.raises(FileNotFoundError):
        ticks.read_shards(spark, root, "trades")
    null = "timestamp double, sequence long, exchange_timestamp long, bid_price_0 double, bid_size_0 double, ask_price_0 double, ask_size_0 double"
    shard(spark, f"{root}/A/orderbooks", [(1.0, 1, 1, 9.0, 1.0, 10.0, 1.0)], null)
    shard(spark, f"{root}/A/orderbooks", [(2.0, 2, 2, 9.0, 1.0, 11.0, 1.0, 8.0, 1.0, 12.0, 1.0)], books)
    shard(spark, f"{root}/A/trades", [(1.0, 10.0, 1.0, "buy", "1", 1), (float("nan"), 10.0, 1.0, "buy", "1", 1)], schemas.TRADES)
    shard(spark, f"{root}/B/trades", [(1.0, 10.0, 1.0, "buy", "1", 1)], schemas.TRADES)
    b = ticks.read_shards(spark, root, "orderbooks", levels=2)
    assert sorted((r["symbol"], r["us"], r["ask_price_1"]) for r in b.collect()) == [("A", 1_000_000, None), ("A", 2_000_000, 12.0)]
    assert ticks.newest_shards(b, 1).count() == 1
    assert ticks.read_shards(spark, root, "trades", "A").where("us is null").count() == 1
    rate = spark.createDataFrame([("A", 1.0), ("Z", 5.0)], "symbol string, rate double")
    assert {r["symbol"]: r["mid"] for r in ticks.latest_book_mid(b, rate).collect()} == {"A": 10.0, "Z": 5.0}
    with pytest.raises(ValueError):
        ticks.require(b, "nothing")
    ticks.import_shards(spark, root, store, levels=2)
    assert ticks.catalog(spark, store) == ["A"] and ticks.catalog(spark, store, ("trades",)) == ["A", "B"]
    assert ticks.read_ticks(spark, store, "trades").count() == 2 and ticks.read_ticks(spark, store, "orderbooks", levels=2).count() == 2


def test_store(spark, tmp_path):
    root = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        ticks.read_ticks(spark, root, "trades")
    (tmp_path / "store" / "prices").mkdir(parents=True)
    assert ticks.read_ticks(spark, root, "prices").count() == 0
    names = ["A", "B/USDC:x", "C%[1]*"]
    rows = [(n, h * 3600.0 + 1, 10.0 + h, 1.0, "buy", "1", h) for n in names for h in range(100, 115)]
    ticks.write_ticks(spark.createDataFrame(rows, "symbol string, timestamp double, price double, size double, side string, trade_id string, exchange_timestamp long"), root, "trades")
    assert ticks.symbols(spark, root, "trades") == sorted(names) and ticks.catalog(spark, root) == []
    for n in names:
        assert ticks.hours(spark, root, "trades", n) == list(range(100, 115)) and ticks.has_data(spark, root, n)
        assert ticks.read_ticks(spark, root, "trades", [n]).count() == 15
    assert not ticks.has_data(spark, root, "Q")
    new = ticks.newest(spark, root, "trades")
    assert new.groupBy("symbol").agg(F.count("*"), F.min("hour")).collect()[0][1:] == (10, 105)
    assert ticks.trailing(spark, root, ("trades",), 90, ["A"]) == {"A": 112}
    scan = ticks.read_ticks(spark, root, "trades", since={"A": 112})
    assert scan.count() == 3
    text = scan._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in text and "(symbol" in text.split("PartitionFilters: [")[1].split("]")[0] and "hour" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert {r["hour"] for r in scan.select("hour").distinct().collect()} == {112, 113, 114}


def test_params(spark, tmp_path):
    row = lambda s, k, g: (s, k, 1.0, 0.1, 0.1, 0.0, 0.0, 10.0, g, 0)
    out = str(tmp_path / "params")
    ticks.upsert_params(spark.createDataFrame([row("A", 1.0, 1), row("B", 2.0, 1)], schemas.PARAMS), out)
    ticks.upsert_params(spark.createDataFrame([row("A", 3.0, 2)], schemas.PARAMS), out)
    back = ticks.read_params(spark, out)
    assert {r["symbol"]: (r["kappa_p"], r["generation"]) for r in back.collect()} == {"A": (3.0, 2), "B": (2.0, 1)}
    ev = spark.createDataFrame([(1.0, "quote", 3)], "ts double, event string, q int")
    log = str(tmp_path / "log")
    ticks.append_events(ev, log)
    assert ticks.read_events(spark, log).first()["q"] == 3
    ticks.append_events(ev, log)  # still below the limit
    assert ticks.read_events(spark, log).count() == 2
    for left, backed in ((1, 2), (1, 1)):  # a log above the limit becomes the only backup
        ticks.append_events(ev, log, max_bytes=10)
        assert (ticks.read_events(spark, log).count(), ticks.read_events(spark, f"{log}.1").count()) == (left, backed)


def test_parameter_files(spark, tmp_path):
    f = tmp_path / "kappa.json"
    f.write_text(json.dumps({"A": {"kappa+": 1, "kappa-": 2}, "B": {"kappa_plus": 3, "kappa_minus": None}, "C": {"kappa_plus": 3, "kappa_minus": 4}}, indent=1))
    assert sorted((r["symbol"], r["kappa_p"]) for r in ticks.read_json(spark, str(f), "kappa").collect()) == [("A", 1.0), ("C", 3.0)]
    assert ticks.read_json(spark, str(f), "kappa", ["A", "C"]).count() == 2
    with pytest.raises(ValueError, match="B"):
        ticks.read_json(spark, str(f), "kappa", ["A", "B"])
    row = ("A", 9.0, None, 0.5, 0.25, 0.1, 0.2, 10.0, 1, 0)
    params = spark.createDataFrame([row], schemas.PARAMS)
    ticks.upsert_json(params, str(f), "kappa")
    assert json.loads(f.read_text()) == {"A": {"kappa+": 9.0, "kappa-": None}, "B": {"kappa_plus": 3, "kappa_minus": None}, "C": {"kappa_plus": 3, "kappa_minus": 4}}
    new = tmp_path / "lambda.json"
    ticks.upsert_json(params, str(new), "lambda")
    assert json.loads(new.read_text()) == {"A": {"lambda+": 0.5, "lambda-": 0.25, "unit": "trades_per_second"}}
    assert tuple(ticks.read_json(spark, str(new), "lambda").first()) == ("A", 0.5, 0.25)
    new.write_text("{corrupt")
    ticks.upsert_json(params, str(new), "mid")
    assert json.loads(new.read_text()) == {"A": 10.0} and tuple(ticks.read_json(spark, str(new), "mid").first()) == ("A", 10.0)
    ticks.upsert_json(params, str(tmp_path / "epsilon.json"), "epsilon")
    assert tuple(ticks.read_json(spark, str(tmp_path / "epsilon.json"), "epsilon").first()) == ("A", 0.1, 0.2)


BASE = 1_700_000_000.0  # in the hour 472222, which begins 800 s before
DEPTHS = [0.0, 0.0, 0.0, 0.0, 0.1, 0.1, 0.1, 0.2, 0.2, 0.3]


def market(symbol):
    """Books and prices each 0.1 s and trades each 0.25 s for two minutes: raw messages of the three kinds, and trades of three hours before."""
    level = lambda p: {"px": f"{p:.4f}", "sz": "2"}
    bid = lambda t: 99.0 + 0.01 * int(t * 10 % 7)
    books = [(BASE + i / 10, bid(i / 10)) for i in range(1200)]
    trades = []
    for i in range(480):
        t = i / 4 + 0.001
        b = 99.0 + 0.01 * (int((t - 0.5) * 10) % 7) if t >= 0.5 else 99.0
        d = DEPTHS[i // 2 % 10]
        trades.append((BASE + t, "B" if i % 2 == 0 else "A", b + 2 + d if i % 2 == 0 else b - d, i))
    trades += [(BASE - 3 * 3600 + i, "B", 1e6, 1000 + i) for i in range(50)]
    out = {
        "orderbooks": [(t, {"channel": "l2Book", "data": {"coin": symbol, "time": int(t * 1000), "levels": [[level(b)], [level(b + 2)]]}}) for t, b in books],
        "prices": [(t, {"channel": "bbo", "data": {"coin": symbol, "time": int(t * 1000), "bbo": [level(b), level(b + 2)]}}) for t, b in books],
        "trades": [(t, {"channel": "trades", "data": [{"coin": symbol, "side": s, "px": f"{p:.4f}", "sz": "1", "tid": k, "time": int(t * 1000)}]}) for t, s, p, k in trades],
    }
    return {k: [json.dumps({"timestamp": t, "value": json.dumps(m)}) for t, m in v] for k, v in out.items()}


@pytest.fixture(scope="module")
def lake(spark, tmp_path_factory):
    """A store that three streams have filled, and the raw drop."""
    top = tmp_path_factory.mktemp("lake")
    for symbol in ("A", "B"):
        for kind, lines in market(symbol).items():
            folder = top / "raw" / kind
            folder.mkdir(parents=True, exist_ok=True)
            for k in range(2):
                (folder / f"{symbol}{k}.json").write_text("\n".join(lines[k::2]))
    for kind in ("prices", "trades", "orderbooks"):
        ingest.ingest(spark, str(top / "raw" / kind), str(top / "store"), kind, str(top / f"cp-{kind}"), None).awaitTermination()
    return top


def expected_kappa(side):
    """The weighted line through the depths' histogram, by numpy; the first trades see no book, the last comes after the overlap's last book."""
    seen = [DEPTHS[i // 2 % 10] for i in range(480) if (i % 2 == 0) == (side == "buy") and 0.6 <= i / 4 + 0.001 <= 119.7]
    d = np.array(seen)
    d = d[d <= np.percentile(d, 99)]
    n, edges = np.histogram(d, 4, (0, d.max()))
    x, ok = (edges[1:] + edges[:-1]) / 2, n > 0
    slope, cut = np.polyfit(x[ok], np.log(n[ok] / 1800), 1, w=np.sqrt(n[ok]))
    return -slope, math.exp(cut)


def test_stream_equals_batch(spark, lake):
    got = ticks.read_ticks(spark, str(lake / "store"), "trades")
    batch = normalise.trade_rows(spark.read.schema(ingest.RAW).json(str(lake / "raw" / "trades")))
    cols = ["symbol", "timestamp", "price", "side", "trade_id"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect())) and got.count() == 1060
    assert ticks.catalog(spark, str(lake / "store")) == ["A", "B"] and ticks.hours(spark, str(lake / "store"), "trades", "A") == [472219, 472222]
    with pytest.raises(ValueError, match="stream"):
        ticks.write_ticks(got.drop("hour", "us"), str(lake / "store"), "trades")


def test_store_is_calibrated(spark, lake, tmp_path):
    """From the streams' files to parameters, the old trades of three hours before neither read nor counted."""
    root, out = str(lake / "store"), str(tmp_path / "params")
    trades, books = plan.store_window(spark, root, 30)
    assert trades.agg(F.max("price")).first()[0] < 200 and all("hour=472222" in f or "hour=472221" in f for f in trades.select("price", F.input_file_name().alias("f")).toPandas().f)
    assert plan.calibrate_store(spark, root, out, bins=4, generation=3) == ["A", "B"]
    for r in ticks.read_params(spark, out).collect():
        for side, name in (("p", "buy"), ("m", "sell")):
            assert (r[f"kappa_{side}"], r[f"lambda_{side}"]) == pytest.approx(expected_kappa(name), rel=1e-6)
        assert r["epsilon_p"] is not None and r["generation"] == 3 and 100 <= r["mid"] <= 100.1 and r["asof"] == round((BASE + 119.501) * 1e6)
    assert plan.calibrate_store(spark, root, out, ["A"], bins=4, generation=4) == ["A"]
    assert {r["symbol"]: r["generation"] for r in ticks.read_params(spark, out).collect()} == {"A": 4, "B": 3}
    one = plan.calibrate(trades, books, plan.store_mids(spark, root), bins=4).where("symbol = 'A'").first()
    assert one["kappa_p"] == ticks.read_params(spark, out).where("symbol = 'A'").first()["kappa_p"]
    assert plan.calibrate_store(spark, str(tmp_path / "none"), out) == []


def test_recalibration_keeps_the_last_good_row(spark, lake, tmp_path, monkeypatch):
    root, out, seen = str(lake / "store"), str(tmp_path / "params"), []
    go = lambda cp: ingest.recalibrate(spark, str(lake / "raw" / "trades"), root, out, str(tmp_path / cp), None, lambda n, e: seen.append((n, str(e))), bins=4).awaitTermination()
    go("one")
    first = {r["symbol"]: r["generation"] for r in ticks.read_params(spark, out).collect()}
    assert first == {"A": 0, "B": 0} and not seen

    def broken(*_, **__):
        raise RuntimeError("no market")

    monkeypatch.setattr(ingest, "calibrate_store", broken)
    go("two")
    assert seen == [(0, "no market")] and {r["symbol"]: r["generation"] for r in ticks.read_params(spark, out).collect()} == first


class FakeQuery:
    def __init__(self, ident, states):
        self.id, self.states, self.stopped = ident, list(states), False

    @property
    def isActive(self):  # noqa: N802
        return self.states[0] != "failed" and self.states[0] != "done"

    def exception(self):
        return RuntimeError("x") if self.states[0] == "failed" else None

    def stop(self):
        self.stopped = True


def test_watchdog_starts_anew():
    dog = ingest.Watchdog(idle_seconds=60)
    queries = [FakeQuery("one", ["run", "run", "failed"]), FakeQuery("two", ["run"]), FakeQuery("three", ["done"])]
    started, current = [], []

    def start():
        if len(started) == 1 and not current[-1].stopped and len(current) == 1 and not getattr(start, "failed", 0):
            start.failed = 1
            raise OSError("not yet")
        q = queries[len(started)]
        started.append(q.id)
        current.append(q)
        return q

    def sleep(_):
        q = current[-1]
        if len(q.states) > 1:
            q.states.pop(0)
        elif q.id == "two":
            dog.seen["two"] -= 100  # nothing has come for longer than the limit

    ingest.supervise(start, dog, backoff=0, poll=0, sleep=sleep)
    assert started == ["one", "two", "three"] and queries[1].stopped

    def never():
        if not getattr(never, "first", 0):
            never.first = 1
            return FakeQuery("f", ["failed"])
        never.first += 1
        raise OSError("down")

    with pytest.raises(SystemExit) as stop:
        ingest.supervise(never, dog, attempts=3, backoff=0, poll=0, sleep=lambda _: None)
    assert stop.value.code == 1 and never.first == 4


def test_runner():
    calls, failed, naps = [], [], []

    def cycle(n):
        calls.append(n)
        if n == 1:
            raise ValueError("bad cycle")

    assert runner.repeat(cycle) == 1 and calls == [0]
    assert runner.repeat(cycle, 7.0, once=False, report=lambda n, e: failed.append((n, str(e))), sleep=naps.append, most=3) == 3
    assert calls[1:] == [0, 1, 2] and failed == [(1, "bad cycle")] and naps == [7.0, 7.0]
    with pytest.raises(ValueError):
        runner.repeat(lambda n: cycle(1))


def test_command_line(spark, lake, tmp_path, capsys):
    root, js = str(lake / "store"), tmp_path / "json"
    js.mkdir()
    go = lambda name, *more: cli.main([name, "--root", root, "--output", str(tmp_path / name), "--json", str(js), *more], spark)
    read = lambda name: {r["symbol"]: r for r in spark.read.parquet(str(tmp_path / name)).collect()}
    go("lambda")
    assert read("lambda")["A"]["lambda_p"] == pytest.approx(240 / 119.75, rel=1e-3)
    assert json.loads((js / "lambda_trades.json").read_text())["A"]["unit"] == "trades_per_second"
    go("mid", "--crypto", "B")
    mid = json.loads((js / "mid_price.json").read_text())
    assert list(mid) == ["B"] and 100 <= mid["B"] <= 100.1
    go("kappa", "--bins", "4")
    assert read("kappa")["A"]["kappa_p"] == pytest.approx(expected_kappa("buy")[0], rel=1e-6)
    assert set(json.loads((js / "kappa.json").read_text())) == {"A", "B"}
    go("epsilon", "--crypto", "A")
    assert list(read("epsilon")) == ["A"] and list(json.loads((js / "epsilon.json").read_text())) == ["A"]
    go("calibrate", "--bins", "4")
    assert read("calibrate")["B"]["toxicity"] == "manageable" and set(json.loads((js / "epsilon.json").read_text())) == {"A", "B"}
    go("run", "--bins", "4", "--once")
    assert read("run")["A"]["generation"] == 0
    # Spreads quote around the argument, else the stored mid.
    go("spreads", "--bins", "4")
    quoted = spark.read.parquet(str(tmp_path / "spreads")).where("symbol = 'A' and q = 0").first()
    assert 95 < quoted["bid_px"] < 100.1 < quoted["ask_px"] < 105
    go("spreads", "--bins", "4", "--mid", "50", "--asym-kappa", "--crypto", "A")
    rows = spark.read.parquet(str(tmp_path / "spreads")).collect()
    assert {r["symbol"] for r in rows} == {"A"} and len(rows) == 7 and all(40 < r["bid_px"] < 60 for r in rows)
    with pytest.raises(FileNotFoundError, match="A, B"):
        go("kappa", "--crypto", "Z")
    flat = str(tmp_path / "flat")
    shard(spark, f"{flat}/C/trades", [(float(i), 10.0, 1.0, "buy", str(i), i) for i in range(5)], schemas.TRADES)
    cli.main(["import", "--flat", flat, "--root", str(tmp_path / "other")], spark)
    cli.main(["lambda", "--root", str(tmp_path / "other")], spark)
    assert "1.25" in capsys.readouterr().out
    cli.main(["ingest", "--raw", str(lake / "raw" / "trades"), "--root", str(tmp_path / "third"), "--kind", "trades", "--checkpoint", str(tmp_path / "cp"), "--seconds", "0"], spark)
    assert ticks.catalog(spark, str(tmp_path / "third"), ("trades",)) == ["A", "B"]


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 48


def test_queries_match_their_sql(spark):
    """Every query of the library against its SQL at the smallest scale."""
    import os

    import duckdb

    from tidemark import queries

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in ("nation", "orders", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    text = lambda v: None if v is None or v != v else (repr(float(v)) if isinstance(v, float) else str(v))
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, d).toPandas(), con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns), name
        rows = [sorted(zip(*(map(text, f[c]) for c in sorted(f.columns)), strict=True), key=str) for f in (got, want)]
        assert rows[0] == rows[1], name


def test_plans(spark):
    """The as-of join neither multiplies rows nor runs Python."""
    from tidemark import queries

    plan_text = queries.trade_depths(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan_text and "NestedLoop" not in plan_text and "Python" not in plan_text
    # Neither the solver's surface nor the simulated paths run Python.
    for name in ("hjb_surface", "simulated_paths"):
        assert "Python" not in queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    scan = queries.raw_lambda(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "props" not in scan.split("Physical Plan")[1] and F is not None
