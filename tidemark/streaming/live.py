"""Streaming: closed bars of a candle stream, and the position fold as a stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.config import DEFAULT, EngineConfig
from tidemark.operators.simulate import Policy, Position, advance


def closed_bars(stream: DataFrame, at: str = "Open_time", width: str = "4 hours", late: str = "1 hour", source: str = "series") -> DataFrame:
    """OHLC bars per source; a bar is emitted once, when the watermark has passed its end. Later rows are dropped."""
    t = stream.withColumn("_t", F.col(at).cast("timestamp")).withWatermark("_t", late)
    bars = t.groupBy(source, F.window("_t", width).alias("w")).agg(F.min_by("Open", "_t").alias("open"), F.max("High").alias("high"), F.min("Low").alias("low"), F.max_by("Close", "_t").alias("close"), F.sum("Volume").alias("volume"), F.count("*").alias("n"))
    return bars.select(source, F.col("w.start").alias("bar"), "open", "high", "low", "close", "volume", "n")


_OUT = "series string, tick bigint, price double, action int, pnl double, side string"


def positions(stream: DataFrame, policy: Policy, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The fold of ``operators.simulate`` over a stream of series, tick, Close, ATR_Scaled and state.

    State per series: side, entry, entry tick and last tick. A tick at or before the last one is a repeat and gives nothing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        side, entry, entry_tick, last = state.get if state.exists else (None, 0.0, 0, -1)
        p, out = Position(side, entry, entry_tick), []
        rows = pd.concat(list(batches)).sort_values("tick")
        for tick, price, atr, vec in zip(rows["tick"], rows["Close"], rows["ATR_Scaled"], rows["state"]):
            if tick <= last:
                continue
            p, o = advance(p, int(tick), float(price), float(atr), np.asarray(vec, dtype=np.float64), policy, cfg)
            last = int(tick)
            out.append((key[0], last, float(price), o["action"], o["pnl"], o["side"]))
        state.update((p.side, float(p.entry), int(p.entry_tick), last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")])

    return stream.groupBy("series").applyInPandasWithState(step, _OUT, "side string, entry double, entry_tick bigint, last bigint", "append", GroupStateTimeout.NoTimeout)
