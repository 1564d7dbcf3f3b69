import math

import numpy as np

from tidemark.operators.regular_grid import regular_grid, smooth


def dense(t, y, at, ql, qs, r):
    """The same posterior from one precision matrix over all times."""
    times = np.unique(np.concatenate([t, at]))
    n, where = len(times), {x: i for i, x in enumerate(np.unique(np.concatenate([t, at])))}
    p, h, i0 = np.zeros((2 * n, 2 * n)), np.zeros(2 * n), where[t[0]]
    p[2 * i0, 2 * i0] += 1 / r
    h[2 * i0] += y[0] / r
    p[2 * i0 + 1, 2 * i0 + 1] += 1 / (10 * (ql + qs))
    for i in range(n - 1):
        d = times[i + 1] - times[i]
        f, q = np.array([[1, d], [0, 1]]), np.linalg.inv(np.array([[ql * d + qs * d**3 / 3, qs * d * d / 2], [qs * d * d / 2, qs * d]]))
        a, b = slice(2 * i, 2 * i + 2), slice(2 * i + 2, 2 * i + 4)
        p[a, a] += f.T @ q @ f
        p[a, b] -= f.T @ q
        p[b, a] -= q @ f
        p[b, b] += q
    for k in range(1, len(t)):
        p[2 * where[t[k]], 2 * where[t[k]]] += 1 / r
        h[2 * where[t[k]]] += y[k] / r
    c = np.linalg.inv(p)
    idx = [2 * where[x] for x in at]
    return (c @ h)[idx], np.sqrt(np.diag(c)[idx])


def test_smoother_is_exact():
    rng = np.random.default_rng(1)
    t, y = np.cumsum(rng.exponential(1, 60)), np.cumsum(rng.normal(size=60))
    at = np.arange(0, int(t[-1])) + 0.0
    v, s = smooth(t, y, at, (1.0, 0.01, 0.3))
    v2, s2 = dense(t, y, at, 1.0, 0.01, 0.3)
    assert np.abs(v - v2).max() < 1e-9 and np.abs(s - s2).max() < 1e-9


def grid(spark, data, **kw):
    df = spark.createDataFrame(data, "series string, utc_ms bigint, v double, step bigint, value string")
    return {(r["series"], r["slot_ms"]): (r["value"], r["sd"], r["is_missing"]) for r in regular_grid(df, "series", "utc_ms", "v", "step", **kw).collect()}


def test_blocks_agree_with_the_whole_series(spark):
    rng = np.random.default_rng(2)
    t = np.unique(np.cumsum(rng.exponential(60_000, 900)).astype(int))
    y = np.cumsum(rng.normal(size=len(t)))
    rows = [("a", int(a), float(b), 60_000, "x") for a, b in zip(t, y)]
    noise = (1.0, 0.01, 0.3)
    whole, cut = grid(spark, rows, noise=noise, rows=100_000), grid(spark, rows, noise=noise, rows=128, margin=128)  # a slope forgets over 10 periods here
    assert whole.keys() == cut.keys()
    assert max(abs(whole[k][0] - cut[k][0]) for k in whole) < 1e-5
    have = {int(a) // 60_000 for a in t}
    assert all(m == (k[1] // 60_000 not in have) for k, (_, _, m) in cut.items())
    assert len(cut) == max(have) - min(have) + 1


def test_long_gap_and_edges(spark):
    rows = [("a", 0, 1.0, 1000, "x"), ("a", 50_000, 2.0, 1000, "x"), ("a", 50_000, 2.0, 1000, "x"), ("b", 5, math.nan, 1000, "x"), ("c", 7, math.inf, 1000, "x"), (None, 1, 1.0, 1000, "x"), ("d", None, 1.0, 1000, "x"), ("e", 1, 1.0, None, "x"), ("f", -1500, None, 1000, "x"), ("g", -1500, 3.0, 1000, "x")]
    got = grid(spark, rows, rows=1, margin=1)
    assert sum(m for (s, _), (_, _, m) in got.items() if s == "a") == 49 and len([k for k in got if k[0] == "a"]) == 51
    assert 1.0 < got["a", 25_000][0] < 2.0 and got["a", 25_000][1] > got["a", 0][1]
    assert {k[0] for k in got} == {"a", "c", "g"} and got["c", 0][2] is False
    assert ("g", -2000) in got
    assert grid(spark, []) == {}


def test_blocks_agree_where_the_noise_is_estimated(spark):
    rng = np.random.default_rng(5)
    t = np.unique(np.cumsum(rng.exponential(60_000, 6000)).astype(int))
    y = np.cumsum(rng.normal(size=len(t)) * np.where(np.arange(len(t)) < len(t) // 2, 1.0, 8.0))  # two halves that differ
    rows = [("a", int(a), float(b), 60_000, "x") for a, b in zip(t, y)]
    whole, cut = grid(spark, rows, rows=100_000), grid(spark, rows, rows=1024, margin=512)
    assert whole.keys() == cut.keys()
    assert max(abs(whole[k][1] / cut[k][1] - 1) for k in whole) < 1e-3
    assert max(abs(whole[k][0] - cut[k][0]) for k in whole) < 1e-3 * np.abs(y).max()


def test_a_long_gap_is_cut_into_ranges(spark):
    rows = [("a", 0, 1.0, 1000, "x"), ("a", 3_000, 2.0, 1000, "x"), ("a", 1_000_000, 4.0, 1000, "x"), ("a", 1_001_000, 4.0, 1000, "x")]
    one, many = grid(spark, rows), grid(spark, rows, slots=100)
    assert one == many and len(one) == 1002 and sum(m for _, _, m in one.values()) == 998
