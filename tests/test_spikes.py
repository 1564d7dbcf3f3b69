import math
from datetime import datetime, timedelta

import numpy as np

from tidemark.operators.spikes import implausible_readings

SCHEMA = "row_id bigint, series string, Open_time timestamp, Close double, Volume double, ingest_time timestamp, field string"


def series(n=600, seed=0, name="a", start=0):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.004, n)))
    volume = np.exp(rng.normal(6, 0.4, n))
    t0 = datetime(2024, 1, 1)
    return [[start + i, name, t0 + timedelta(hours=i), float(close[i]), float(volume[i]), t0 + timedelta(hours=i + 1), "x"] for i in range(n)]


def found(spark, data, **kw):
    df = spark.createDataFrame([tuple(r) for r in data], SCHEMA)
    return {(r["row_id"], r["field"]): r["reason"] for r in implausible_readings(df, "row_id", "series", "Open_time", "ingest_time", **kw).collect()}


def dirty():
    rows = series()
    rows[50][3] *= 1.4
    rows[51][3] *= 1.35  # a spike of two readings
    rows[90][3] = -5.0
    rows[91][3] = math.nan
    rows[92][3] = math.inf
    rows[93][3] = None
    rows[94][4] = -1.0
    rows[120][4] *= 300
    for i in range(200, 230):
        rows[i][3] = rows[200][3]  # stuck
    for i in range(300, 600):
        rows[i][3] *= 1.3  # a move that stays
    for i in range(400, 430):
        rows[i][4] *= 40 * math.sin((i - 399) / 32 * math.pi) + 1  # activity that swells and fades
    want = {(50, "Close"), (51, "Close"), (90, "Close"), (91, "Close"), (92, "Close"), (94, "Volume"), (120, "Volume")} | {(i, "Close") for i in range(201, 230)}
    return rows, want


def test_flags(spark):
    rows, want = dirty()
    assert set(found(spark, rows)) == want


def test_blocks_and_hot_source(spark):
    rows, want = dirty()
    assert set(found(spark, rows, rows=201, margin=64)) == want
    small = set(found(spark, rows, rows=32, margin=16))  # usual moves from few readings, runs over several blocks
    assert small >= want - {(120, "Volume")} and len(small - want) <= 3


def test_run_over_many_blocks(spark):
    rows = series(400)
    for i in range(100, 260):
        rows[i][3] = rows[100][3]
    got = found(spark, rows, rows=32, margin=8)
    assert {k for k in got if k[1] == "Close"} == {(i, "Close") for i in range(101, 260)}


def test_repeated_deliveries_do_not_lengthen_a_run(spark):
    rows = series(300)
    rows += [[1000 + k, "a", rows[80][2], rows[80][3], rows[80][4], rows[80][5], "x"] for k in range(40)]
    assert found(spark, rows) == {}
    rows += [[2000, "a", rows[150][2], rows[150][3] * 2, rows[150][4], rows[150][5] + timedelta(hours=5), "x"]]
    assert set(found(spark, rows)) == {(2000, "Close")}  # each delivery by itself


def test_edges(spark):
    assert found(spark, []) == {}
    lone = [[1, None, None, -1.0, 5.0, None, "x"], [2, "b", datetime(2024, 1, 1), 3.0, 0.0, None, "x"], [3, "c", None, math.nan, None, None, "x"]]
    assert found(spark, lone) == {(1, "Close"): "impossible", (3, "Close"): "impossible"}
    still = series(200, name="z")
    for r in still:
        r[4] = 0.0
    assert found(spark, still) == {}  # zero volume is no stuck reading
