"""Indicators by their public definitions, each scaled by a rolling z-score.

RSI(14) and ATR(14) after Wilder, MACD(12, 26, 9), Bollinger position (20, 2), on-balance
volume and deviation from SMA(20). Exponential averages are recurrences with fast decay; they are
taken over blocks of candles with a margin of earlier ones, after which their start has no weight.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

MARGIN, ROWS, SCALE = 600, 8192, 200


def _ema(x: np.ndarray, alpha: float) -> np.ndarray:
    return pd.Series(x).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def compute(high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray) -> dict[str, np.ndarray]:
    """Raw indicators of candles in order."""
    c = pd.Series(close)
    move = np.diff(close, prepend=close[:1])
    up, down = _ema(np.maximum(move, 0), 1 / 14), _ema(np.maximum(-move, 0), 1 / 14)
    rsi = 100 - 100 / (1 + np.divide(up, down, out=np.full(len(up), 1e9), where=down > 0))
    line = _ema(close, 2 / 13) - _ema(close, 2 / 27)
    before = np.concatenate([close[:1], close[:-1]])
    true_range = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
    mean, std = c.rolling(20, min_periods=1).mean().to_numpy(), c.rolling(20, min_periods=1).std(ddof=0).to_numpy()
    return {"RSI": rsi, "MACD": line - _ema(line, 2 / 10), "BB": (close - mean) / (2 * std + 1e-12), "OBV": np.cumsum(np.sign(move) * volume), "ATR": _ema(true_range, 1 / 14), "MeanDev": close / mean - 1}


def scaled(raw: dict[str, np.ndarray], window: int = SCALE) -> dict[str, np.ndarray]:
    """Rolling z-score; null until the window is full."""
    out = {}
    for name, x in raw.items():
        s = pd.Series(x)
        r = s.rolling(window)
        out[f"{name}_Scaled"] = ((s - r.mean()) / (r.std(ddof=0) + 1e-12)).to_numpy()
    return out


def indicators(candles: DataFrame, source: str = "series", rank: str = "tick") -> DataFrame:
    """``series, tick, Close`` and six scaled indicators; candles need High, Low, Close, Volume and ranks from 0.

    The z-score is invariant to where on-balance volume starts, so blocks agree with the whole series.
    """
    from pyspark.sql import functions as F

    own = F.expr(f"{rank} div {ROWS}")
    near = candles.withColumn("_blk", F.explode(F.array_compact(F.array(own, F.when(F.col(rank) % ROWS >= ROWS - MARGIN - SCALE, own + 1)))))
    names = ["RSI", "MACD", "BB", "OBV", "ATR", "MeanDev"]

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rank)
        got = scaled(compute(*[pdf[c].to_numpy(dtype=float) for c in ("High", "Low", "Close", "Volume")]))
        out = pd.DataFrame({source: pdf[source].to_numpy(), rank: pdf[rank].to_numpy(), "Close": pdf["Close"].to_numpy(), **got})
        return out[(pdf[rank] // ROWS == pdf["_blk"]).to_numpy()]

    return near.groupBy(source, "_blk").applyInPandas(block, f"{source} string, {rank} bigint, Close double, " + ", ".join(f"{n}_Scaled float" for n in names))
