"""Scalar functions as column expressions (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, EngineConfig


def null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c.cast("double")), c)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def entropy_bits(shares: Column) -> Column:
    """Entropy of an array of shares in bits; 1e-9 keeps empty shares finite."""
    return -F.aggregate(F.transform(shares, lambda p: p.cast("double") * F.log2(p.cast("double") + 1e-9)), F.lit(0.0), lambda a, x: a + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def shaped_reward(pnl: Column, holding: Column, in_position: Column, cfg: EngineConfig = DEFAULT) -> Column:
    bonus = F.when(pnl > cfg.bonus_above, pnl * cfg.bonus).otherwise(0.0)
    return pnl + bonus - F.when(holding & in_position, cfg.hold_cost).otherwise(0.0)


def entry_price(side: Column, price: Column, cfg: EngineConfig = DEFAULT) -> Column:
    return F.when(side == "LONG", price * (1 + cfg.commission)).when(side == "SHORT", price * (1 - cfg.commission))


def close_pnl(side: Column, entry: Column, price: Column, cfg: EngineConfig = DEFAULT) -> Column:
    """Relative gain of a closed position after the commission of both sides."""
    return F.when(side == "LONG", (price * (1 - cfg.commission) - entry) / entry).when(side == "SHORT", (entry - price * (1 + cfg.commission)) / entry)


def unrealised(side: Column, entry: Column, price: Column, cfg: EngineConfig = DEFAULT) -> Column:
    raw = F.when(side == "LONG", (price - entry) / entry).when(side == "SHORT", (entry - price) / entry).otherwise(0.0)
    return clip(raw, -cfg.pnl_clip, cfg.pnl_clip)


def side_code(side: Column) -> Column:
    return F.when(side == "LONG", 1.0).when(side == "SHORT", -1.0).otherwise(0.0)


def action_mask(side: Column) -> Column:
    """Allowed LONG, SHORT, CLOSE, HOLD: flat opens or holds, a position closes or holds."""
    flat = side.isNull()
    return F.array(flat, flat, ~flat, F.lit(True))


def argmax_first(v: Column) -> Column:
    """Index of the largest value; the first one wins ties."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def top2_margin(v: Column) -> Column:
    s = F.sort_array(v, asc=False)
    return F.when(F.size(v) > 1, s[0] - s[1]).otherwise(s[0])


def decay(start: float, rate: float, floor: float, epoch: Column) -> Column:
    return F.greatest(F.lit(floor), F.lit(start) * F.pow(F.lit(rate), epoch))


def seeded_uniform(seed: int, *keys: Column) -> Column:
    """Reproducible number in [0, 1) of a row, whatever the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) / float(1 << 52)
