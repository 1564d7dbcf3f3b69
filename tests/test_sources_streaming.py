import json
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from tidemark.analytics import momentum
from tidemark.operators.indicators import compute, indicators, scaled
from tidemark.operators.simulate import fold
from tidemark.sources.candles import closed_only, parse_klines, read_csv, read_responses
from tidemark.streaming.live import closed_bars, positions


def candle(i):
    t = 1546300800000 + 60_000 * i
    return [t, "1.0", "2.0", "0.5", str(1 + i), "10", t + 59_999, "3.5", 7, "1", "2", "0"]


def test_payloads(spark, tmp_path):
    df = spark.createDataFrame([(json.dumps([candle(0), candle(1)]),), ("broken",), (None,), ("[[1,2]]",)], "p string")
    rows = parse_klines(df, "p").orderBy("Open_time").collect()
    assert [r["Close"] for r in rows] == [1.0, 2.0] and rows[0]["Close_time"] == 1546300859999 and rows[0]["Trades"] == 7
    (tmp_path / "a.json").write_text(json.dumps([candle(0)]))
    (tmp_path / "b.json").write_text(json.dumps([candle(1), candle(2)]))
    got = read_responses(spark, str(tmp_path))
    assert got.count() == 3
    assert closed_only(got, F.lit("2019-01-01 04:01:30").cast("timestamp")).count() == 2


def test_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Open_time,Close\n2019-01-01 00:00:00,1.5\n1546300800000,2\nnonsense,3\n")
    rows = read_csv(spark, str(tmp_path / "c.csv"), "Open_time string, Close double").orderBy("Close").collect()
    assert rows[0]["Open_time"] == rows[1]["Open_time"] and rows[2]["Open_time"] is None


def test_indicator_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    n = 2600
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    rows = [("s", i, float(c * 1.01), float(c * 0.99), float(c), float(rng.integers(1, 99))) for i, c in enumerate(close)]
    df = spark.createDataFrame(rows, "series string, tick bigint, High double, Low double, Close double, Volume double")
    import tidemark.operators.indicators as mod

    monkeypatch.setattr(mod, "ROWS", 1024)
    got = {r["tick"]: r for r in indicators(df).collect()}
    cols = [np.array([r[i] for r in rows]) for i in (2, 3, 4, 5)]
    want = scaled(compute(*cols))
    assert len(got) == n
    for name, x in want.items():
        worst = max(abs(got[t][name] - x[t]) for t in range(900, n))
        assert worst < 1e-2, (name, worst)


def run_stream(spark, out, name):
    q = out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_closed_bars(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("s", t0 + timedelta(minutes=30 * i), float(i), float(i + 1), float(i - 1), float(i), 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "series string, Open_time timestamp, Open double, High double, Low double, Close double, Volume double")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    got = run_stream(spark, closed_bars(stream), "bars").orderBy("bar").collect()
    assert [r["n"] for r in got] == [8, 8, 8, 8] and got[0]["open"] == 0.0 and got[0]["close"] == 7.0  # the last bar is still open


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(s, t, float(100 + rng.normal()), float(rng.normal()), [float(x) for x in rng.normal(size=50)]) for s in ("a", "b") for t in range(120)]
    df = spark.createDataFrame(rows, "series string, tick bigint, Close double, ATR_Scaled double, state array<double>")
    for k in range(3):
        df.filter(f"tick div 40 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    got = {(r["series"], r["tick"]): (r["action"], round(r["pnl"], 12)) for r in run_stream(spark, positions(stream, momentum), "pos").collect()}
    want = {(r["series"], r["tick"]): (r["action"], round(r["pnl"], 12)) for r in fold(df, "series", momentum).collect()}
    assert got == want and len(got) == 240


def test_master_merge_limit_and_guard(spark):
    from tidemark.sources.candles import enough_rows, latest, merge_master

    schema = "row_id bigint, series string, Open_time timestamp, ingest_time timestamp, Close double"
    at = lambda h: datetime(2024, 1, 1, h)
    old = spark.createDataFrame([(1, "a", at(0), at(1), 1.0), (2, "a", at(1), at(2), 2.0), (9, None, at(1), at(2), 9.0)], schema)
    new = spark.createDataFrame([(3, "a", at(1), at(3), 2.5), (4, "a", at(2), None, 3.0), (5, "b", None, at(2), 3.0)], schema)
    assert sorted((r["row_id"], r["Close"]) for r in merge_master(old, new).collect()) == [(1, 1.0), (3, 2.5), (4, 3.0)]
    assert merge_master(old, new.limit(0)).count() == 2 and merge_master(old.limit(0), old.limit(0)).count() == 0
    assert [r["row_id"] for r in latest(old.filter("series is not null"), 1).collect()] == [2]
    f = spark.range(130).selectExpr("'a' as series", "id as tick").union(spark.range(129).selectExpr("'b'", "id"))
    assert {r["series"] for r in enough_rows(f).collect()} == {"a"}
