"""Feature table, splits, windows over ticks and multi-pace state vectors.

All windows reach a bounded number of rows, so they run over blocks of ticks with
margins (``plans.blocks``): a series that holds a third of all rows is many tasks.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, EngineConfig
from tidemark.functions.scalars import null_if_nan
from tidemark.plans.blocks import neighbourhood, ranked


def feature_table(df: DataFrame, source: str = "series", order: str = "tick", key: str = "row_id", cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``series, tick, Close`` and the features of complete rows, ticks renumbered from 0.

    NaN counts as null; a row with a null is dropped; of rows with one tick the first by key stays.
    """
    cols = ["Close", *cfg.features]
    one = df.filter(F.col(source).isNotNull() & F.col(order).isNotNull()).groupBy(source, order).agg(F.min_by(F.struct(*cols), key).alias("x"))
    flat = one.select(source, order, *[null_if_nan(F.col(f"x.{c}")).alias(c) for c in cols]).dropna(subset=cols)
    flat = flat.withColumn("_b", F.expr(f"{order} div 4096"))
    return ranked(flat, source, order, "_b", "_tick").drop("_b", order).withColumnRenamed("_tick", order).select(source, order, *cols)


def split_labels(year: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """All splits a row belongs to (they overlap); a row without a year is a training row."""
    val = F.coalesce(year.isin(*cfg.val_years), F.lit(False))
    labels = [F.when(~val, "train"), *[F.when(year == y, f"val_{y}") for y in cfg.val_years], F.when(year == cfg.bear_year, f"bear_{cfg.bear_year}"), F.when(year.isin(*cfg.bull_years), "bull_trend")]
    return F.array_compact(F.array(*labels))


def with_splits(df: DataFrame, at: str, cfg: EngineConfig = DEFAULT) -> DataFrame:
    return df.withColumn("split", F.explode(split_labels(F.year(at), cfg)))


def _with_slopes(df: DataFrame, lags: dict[str, list[str]], cfg: EngineConfig) -> DataFrame:
    """Add a column per name: the distance of the first of its columns from the mean of those that aren't null, in their standard deviations.

    Two passes, so nearly equal values keep their digits; counts and means are columns of their own, so that no expression holds them many times.
    """
    here = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    df = df.withColumns({f"_n_{o}": reduce(add, [F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0) for c in cs]) for o, cs in lags.items()})
    df = df.withColumns({f"_m_{o}": reduce(add, [here(c) for c in cs]) / F.col(f"_n_{o}") for o, cs in lags.items()})
    off = lambda o, c: F.coalesce(F.col(c) - F.col(f"_m_{o}"), F.lit(0.0))
    df = df.withColumns({o: (F.col(cs[0]) - F.col(f"_m_{o}")) / (F.sqrt(reduce(add, [off(o, c) * off(o, c) for c in cs]) / F.col(f"_n_{o}")) + cfg.slope_eps) for o, cs in lags.items()})
    return df.drop(*[f"{p}_{o}" for o in lags for p in ("_n", "_m")])


def slopes(df: DataFrame, columns: list[str], source: str = "series", tick: str = "tick", cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``<column>_slope``: distance of a value from the mean of the last samples, in their standard deviations. Values aren't null."""
    near, w = neighbourhood(df, source, tick, cfg.history - 1)
    lags = {f"{c}_slope": [f"_l{i}_{j}" for j in range(cfg.history)] for i, c in enumerate(columns)}
    near = near.withColumns({n: F.lag(F.col(c).cast("double"), j).over(w) for c, names in zip(columns, lags.values()) for j, n in enumerate(names)})
    near = _with_slopes(near, lags, cfg)
    return near.filter("_own").drop("_blk", "_own", *[n for names in lags.values() for n in names])


def rolling_mean(df: DataFrame, value: str, width: int, out: str, source: str = "series", tick: str = "tick") -> DataFrame:
    """Mean of the last ``width`` rows; null until there are as many."""
    near, w = neighbourhood(df, source, tick, width - 1)
    w = w.rowsBetween(-(width - 1), 0)
    near = near.withColumn(out, F.when(F.count(F.lit(1)).over(w) == width, F.avg(value).over(w)))
    return near.filter("_own").drop("_blk", "_own")


def pct_change(df: DataFrame, value: str, out: str, source: str = "series", tick: str = "tick") -> DataFrame:
    near, w = neighbourhood(df, source, tick, 1)
    before = F.lag(value).over(w)
    return near.withColumn(out, F.when(before != 0, F.col(value) / before - 1)).filter("_own").drop("_blk", "_own")


def pace_samples(features: DataFrame, pace: int, source: str = "series", tick: str = "tick", cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Rows that a pace samples, with its value and slope vectors: ``series, sampled, current, slope``.

    After warm-up a pace takes row ``warmup + m pace``; before it, its history is rows ``warmup - (history - j) pace``,
    as zeros where they lie before the first row. Row ``warmup`` enters no history.
    """
    h, off = cfg.history, F.col(tick) - cfg.warmup
    m = F.when((off > 0) & (off % pace == 0), F.expr(f"({tick} - {cfg.warmup}) div {pace}")).when((off < 0) & (off % pace == 0) & (off >= -h * pace), F.expr(f"1 - ({cfg.warmup} - {tick}) div {pace}"))
    near, w = neighbourhood(features.withColumn("_m", m + h - 1).filter("_m is not null"), source, "_m", h - 1)
    lags = {f"_{c}{j}": F.coalesce(F.lag(F.col(c).cast("double"), j).over(w), F.lit(0.0)) for c in cfg.features for j in range(h)}  # rows before the first count as zeros
    near = near.withColumns(lags)
    current = [F.col(f"_{c}0") for c in cfg.features]
    near = _with_slopes(near, {f"_{c}_slope": [f"_{c}{j}" for j in range(h)] for c in cfg.features}, cfg)
    slope = [F.col(f"_{c}_slope") for c in cfg.features]
    near = near.withColumn("current", F.array(*current)).withColumn("slope", F.array(*slope))
    return near.filter("_own").select(source, F.col(tick).alias("sampled"), "current", "slope")


def open_loop_state(features: DataFrame, source: str = "series", tick: str = "tick", cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``series, tick, state``: market part of the state at each tick after warm-up, with a flat portfolio.

    A pace's last sample before a tick has a known tick, so carrying it forward is an equality join. A series with
    no more rows than the warm-up has no state.
    """
    out = features.filter(F.col(tick) > cfg.warmup).select(source, tick)
    for p in sorted(cfg.paces, reverse=True):  # the pace of every tick comes last: its join leaves the rows where those of ``source`` and ``tick`` meet
        off = F.col(tick) - cfg.warmup
        last = F.when(off >= p, F.col(tick) - off % p).otherwise(F.lit(cfg.warmup - p))
        key = "_s" if p > 1 else tick
        samples = pace_samples(features, p, source, tick, cfg).select(source, F.col("sampled").alias(key), F.concat("current", "slope").cast("array<float>").alias(f"_p{p}"))
        out = (out.withColumn("_s", last.cast("bigint")) if p > 1 else out).join(samples, [source, key], "left").drop("_s")
    zeros = F.array(*[F.lit(0.0)] * (2 * len(cfg.features))).cast("array<float>")
    return out.select(source, tick, F.concat(*[F.coalesce(f"_p{p}", zeros) for p in cfg.paces], F.array(F.lit(0.0), F.lit(0.0)).cast("array<float>")).alias("state"))


def states_of(values: np.ndarray, cfg: EngineConfig = DEFAULT) -> np.ndarray:
    """``open_loop_state`` of one series in memory: the float32 states of its ticks after warm-up, from its features at ticks 0, 1, ...

    Sums run in the order of those of ``pace_samples``, so both give the same digits.
    """
    h, off, out = cfg.history, np.arange(1, max(1, len(values) - cfg.warmup)), []
    for p in cfg.paces:
        before = [cfg.warmup - j * p for j in range(h, 0, -1) if 0 <= cfg.warmup - j * p < len(values)]
        sampled = values[[*before, *range(cfg.warmup + p, len(values), p)]].astype(np.float64)
        padded = np.concatenate([np.zeros((h - 1, values.shape[1])), sampled])
        lags = [padded[h - 1 - j : len(padded) - j] for j in range(h)]
        with np.errstate(all="ignore"):
            mean = reduce(add, lags) / float(h)
            slope = (sampled - mean) / (np.sqrt(reduce(add, [(x - mean) * (x - mean) for x in lags]) / float(h)) + cfg.slope_eps)
            both = np.concatenate([sampled, slope], axis=1).astype(np.float32)
        at = len(before) - 1 + off // p
        out.append(np.where((at >= 0)[:, None], both[at], np.float32(0)) if len(both) else np.zeros((len(off), 2 * values.shape[1]), dtype=np.float32))
    return np.concatenate([*out, np.zeros((len(off), 2), dtype=np.float32)], axis=1)


def resample_ohlc(df: DataFrame, at: str, width: str, source: str = "series", key: str = "row_id", empty: bool = False) -> DataFrame:
    """Bars of a fixed width: first open, highest, lowest, last close, rows. Unsound prices are left out.

    empty: bars without rows between a source's first and last are listed, with null prices and 0 rows.
    """
    ok = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('infinity')" for c in ("Open", "High", "Low", "Close"))
    first = F.struct(at, key)
    bars = (df.filter(ok).filter(F.col(at).isNotNull()).groupBy(source, F.window(F.col(at).cast("timestamp"), width)["start"].alias("bar"))
            .agg(F.min_by("Open", first).alias("open"), F.max("High").alias("high"), F.min("Low").alias("low"), F.max_by("Close", first).alias("close"), F.count("*").alias("n")))
    if not empty:
        return bars
    grid = bars.groupBy(source).agg(F.min("bar").alias("_a"), F.max("bar").alias("_b")).select(source, F.explode(F.expr(f"sequence(_a, _b, interval {width})")).alias("bar"))
    return grid.join(bars, [source, "bar"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
