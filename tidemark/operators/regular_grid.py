"""Problem 5: irregular readings onto a regular grid per source.

A Kalman smoother over a continuous-time local trend (a level that drifts by a slope,
both disturbed in proportion to elapsed time) is run over the readings of a source and
evaluated at the start of each period: a value, its standard deviation, and whether the
period has a reading of its own.

Readings are ranked and cut into blocks with margins of readings (see ``plans.blocks``):
a slope forgets over about ``SLOPE_SHARE ** -0.5`` = 32 periods, so what lies more than a margin of
512 readings away has no weight left in the smoother and blocks give the values of the whole series, and a hot source is many tasks. Margins
count readings, not time, so both ends of a long gap are always at hand. The variances are estimated once per source, from mergeable
sketches of its moves, so the standard deviations don't depend on the blocks either. A block whose readings span more than
``SLOTS`` periods (a gap of years at one-minute steps) is evaluated by several tasks, each for a range of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.blocks import ranked, with_margins
from tidemark.storage import materialize

#: Variances by which slope and reading are disturbed, as shares of the level's, a period.
SLOPE_SHARE, READING_SHARE = 1e-3, 0.05
SLOTS = 262_144  # periods that a task emits for a block
ACCURACY = 10_000  # quantiles of moves are off by at most a ten-thousandth in rank


def _noise(d: np.ndarray, dt: np.ndarray, scale: float) -> float:
    """Variance of the level a period: from the usual move, whatever spikes there are."""
    ok = np.isfinite(d) & (dt > 0)
    v = np.abs(d[ok]) / np.sqrt(dt[ok])
    spread = max(1.4826 * np.median(v), np.quantile(v, 0.9) / 1.645) if len(v) else 0.0
    return max(spread, 1e-9 * max(scale, 1e-12)) ** 2


def smooth(t: np.ndarray, y: np.ndarray, at: np.ndarray, noise: tuple[float, float, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed value and standard deviation at the sorted times ``at``, none of them after the last reading.

    ``t`` (rising) counts periods; readings that aren't finite disturb nothing. noise: the variances of
    level, slope and reading; else they are taken from the readings.
    """
    ok = np.isfinite(y)
    t, y = t[ok], y[ok]
    n = len(t)
    if n == 0:
        return np.full(len(at), np.nan), np.full(len(at), np.nan)
    if noise is None:
        ql = _noise(np.diff(y), np.diff(t), float(np.median(np.abs(y))))
        noise = (ql, SLOPE_SHARE * ql, READING_SHARE * ql)
    ql, qs, r = noise
    f = np.empty((n, 5))  # filtered level, slope, and their covariances
    p = np.empty((n, 5))  # predicted
    m0, m1, a, b, c = float(y[0]), 0.0, r, 0.0, 10.0 * (ql + qs)
    ts, ys = t.tolist(), y.tolist()
    p[0] = f[0] = (m0, m1, a, b, c)
    for i in range(1, n):
        d = ts[i] - ts[i - 1]
        m0 += d * m1
        a += 2 * d * b + d * d * c + ql * d + qs * d * d * d / 3
        b += d * c + qs * d * d / 2
        c += qs * d
        p[i] = (m0, m1, a, b, c)
        s = a + r
        g0, g1, e = a / s, b / s, ys[i] - m0
        m0 += g0 * e
        m1 += g1 * e
        c -= g1 * b
        b *= 1 - g0
        a *= 1 - g0
        f[i] = (m0, m1, a, b, c)
    sm = f.copy()
    s0, s1, sa, sb, sc = f[-1]
    fl, pl = f.tolist(), p.tolist()
    for i in range(n - 2, -1, -1):
        m0, m1, a, b, c = fl[i]
        q0, q1, pa, pb, pc = pl[i + 1]
        d = ts[i + 1] - ts[i]
        det = pa * pc - pb * pb
        if det <= 0:
            det = 1e-300
        u0, u1, v0, v1 = a + d * b, b, b + d * c, c  # P F^T
        g00, g01 = (u0 * pc - u1 * pb) / det, (u1 * pa - u0 * pb) / det
        g10, g11 = (v0 * pc - v1 * pb) / det, (v1 * pa - v0 * pb) / det
        e0, e1 = s0 - q0, s1 - q1
        s0, s1 = m0 + g00 * e0 + g01 * e1, m1 + g10 * e0 + g11 * e1
        da, db, dc = sa - pa, sb - pb, sc - pc
        sa = a + g00 * g00 * da + 2 * g00 * g01 * db + g01 * g01 * dc
        sb = b + g00 * g10 * da + (g00 * g11 + g01 * g10) * db + g01 * g11 * dc
        sc = c + g10 * g10 * da + 2 * g10 * g11 * db + g11 * g11 * dc
        sm[i] = (s0, s1, sa, sb, sc)
    # grid times: predicted from the reading before, then drawn to the smoothed reading after
    i = np.searchsorted(t, at, side="right") - 1
    head, i = i < 0, np.maximum(i, 0)
    d = np.maximum(at - t[i], 0.0)
    m0, m1, a, b, c = f[i].T
    g0, ga = m0 + d * m1, a + 2 * d * b + d * d * c + ql * d + qs * d**3 / 3
    gb, gc = b + d * c + qs * d * d / 2, c + qs * d
    j = np.minimum(i + 1, n - 1)
    h = t[j] - t[i] - d
    q0, q1, pa, pb, pc = p[j].T
    z0, z1, za, zb, zc = sm[j].T
    det = np.maximum(pa * pc - pb * pb, 1e-300)
    u0, u1 = ga + h * gb, gb
    k0, k1 = (u0 * pc - u1 * pb) / det, (u1 * pa - u0 * pb) / det
    value = g0 + k0 * (z0 - q0) + k1 * (z1 - q1)
    var = ga + k0 * k0 * (za - pa) + 2 * k0 * k1 * (zb - pb) + k1 * k1 * (zc - pc)
    last = i == n - 1
    value, var = np.where(last, sm[i, 0] + d * sm[i, 1], value), np.where(last, sm[i, 2] + 2 * d * sm[i, 3] + d * d * sm[i, 4] + ql * d + qs * d**3 / 3, var)
    back = t[0] - at
    value = np.where(head, sm[0, 0] - back * sm[0, 1], value)
    var = np.where(head, sm[0, 2] - 2 * back * sm[0, 3] + back**2 * sm[0, 4] + ql * back + qs * back**3 / 3, var)
    return value, np.sqrt(np.maximum(var, 0.0))


def _block(rows: int, slots_a_task: int):
    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        blk, step, part = int(pdf["_blk"].iloc[0]), int(pdf["step_ms"].iloc[0]), int(pdf["_part"].iloc[0])
        pdf = pdf.sort_values("_rank")
        ms, y = pdf["utc_ms"].to_numpy(), pdf["value"].to_numpy(dtype=float)
        noise = tuple(float(pdf[c].iloc[0]) for c in ("_ql", "_qs", "_r"))
        start, stop = int(pdf["_start"].iloc[0]), int(pdf["_stop"].iloc[0])
        grid = np.arange(start + part * slots_a_task, min(stop, start + (part + 1) * slots_a_task))
        value, sd = smooth((ms - ms[0]) / step, y, (grid * step - ms[0]) / step, noise)
        return pd.DataFrame({"series": pdf["series"].iloc[0], "slot_ms": grid * step, "value": value, "sd": sd, "is_missing": ~np.isin(grid, ms // step)})

    return block


def regular_grid(df: DataFrame, source: str, utc_ms: str, value: str, step_ms: str, rows: int = 4096, margin: int = 512, noise: tuple[float, float, float] | None = None, slots: int = SLOTS) -> DataFrame:
    """One row per source and period from its first reading's to its last: ``series, slot_ms, value, sd, is_missing``.

    Periods last ``step_ms`` and start at multiples of it. Rows with a null source, moment or step, or
    a null or NaN value, are no readings; readings of one moment are averaged; infinite ones mark their
    period as read but don't move the value (null where a block has no finite one); ``noise`` fixes the variances of level, slope and reading. A source with one
    reading gives one period. An empty table gives an empty result; other columns are ignored.
    """
    base = df.select(F.col(source).cast("string").alias("series"), F.col(utc_ms).cast("bigint").alias("utc_ms"), F.col(value).cast("double").alias("value"), F.col(step_ms).cast("bigint").alias("step_ms"))
    base = base.filter("series is not null and utc_ms is not null and value is not null and not isnan(value) and step_ms > 0")
    readings = base.groupBy("series", "step_ms", "utc_ms").agg(F.avg("value").alias("value")).withColumn("_b", F.expr("floor(utc_ms / step_ms) div 512"))
    blocks = with_margins(ranked(readings, "series", "utc_ms", "_b"), "_rank", rows, margin).drop("_b")
    by = Window.partitionBy("series", "_blk").orderBy("_rank")
    dt = (F.col("utc_ms") - F.lag("utc_ms").over(by)) / F.col("step_ms")
    move = F.abs(F.col("value") - F.lag("value").over(by)) / F.sqrt(dt)
    blocks = materialize(blocks.withColumn("_own", F.expr(f"_rank div {rows} = _blk")).withColumn("_move", F.when(F.abs(move) < float("inf"), move)), "readings")
    # where each block's periods begin and end: at its first reading, and at that of the next block
    slot = F.expr("floor(utc_ms / step_ms)")
    spans = blocks.groupBy("series", "_blk").agg(F.min(F.when(F.col("_own"), slot)).alias("_start"), F.coalesce(F.min(F.when(F.expr(f"_rank div {rows} > _blk"), slot)), F.max(F.when(F.col("_own"), slot)) + 1).alias("_stop")).filter("_start is not null")
    if noise is None:
        sketch = lambda c, q: F.percentile_approx(c, F.lit(q), F.lit(ACCURACY))
        own = F.when(F.col("_own"), F.col("_move"))
        size = F.when(F.col("_own") & (F.abs("value") < float("inf")), F.abs("value"))
        moves = blocks.groupBy("series").agg(sketch(own, 0.5).alias("_m"), sketch(own, 0.9).alias("_q"), sketch(size, 0.5).alias("_a"))
        spread = F.greatest(1.4826 * F.coalesce("_m", F.lit(0.0)), F.coalesce("_q", F.lit(0.0)) / 1.645, 1e-9 * F.greatest(F.coalesce("_a", F.lit(0.0)), F.lit(1e-12)))
        variances = moves.select("series", (spread * spread).alias("_ql")).withColumn("_qs", SLOPE_SHARE * F.col("_ql")).withColumn("_r", READING_SHARE * F.col("_ql"))
    else:
        variances = spans.select("series").distinct().select("series", *[F.lit(float(v)).alias(c) for c, v in zip(("_ql", "_qs", "_r"), noise)])
    tasks = spans.join(variances, "series").withColumn("_part", F.explode(F.expr(f"sequence(0, cast((_stop - _start - 1) div {slots} as int))")))
    return blocks.drop("_own", "_move").join(tasks, ["series", "_blk"]).groupBy("series", "_blk", "_part").applyInPandas(_block(rows, slots), "series string, slot_ms bigint, value double, sd double, is_missing boolean")
