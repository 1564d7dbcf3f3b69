"""Constants that are part of the semantics, as one frozen object.

Fixed values, equal to the ones the queries must reproduce.
"""

from dataclasses import dataclass

FEATURES = ("RSI_Scaled", "MACD_Scaled", "BB_Scaled", "OBV_Scaled", "ATR_Scaled", "MeanDev_Scaled")
PACES = (1, 6, 42, 90)
LONG, SHORT, CLOSE, HOLD = 0, 1, 2, 3


@dataclass(frozen=True)
class EngineConfig:
    features: tuple = FEATURES
    paces: tuple = PACES
    history: int = 8
    warmup: int = 128
    actions: int = 4
    k: int = 25
    gamma: float = 0.97
    bank_cap: int = 200_000
    signal_threshold: float = 0.0005
    min_tick_gap: int = 100
    weight_cap: float = 50.0
    eps_dist: float = 1e-3
    eps: float = 1e-8
    slope_eps: float = 1e-6
    commission: float = 0.00015
    max_hold: int = 32
    stop_loss: float = -0.015
    atr_gate: float = 2.0
    pnl_clip: float = 0.05
    reward_scale: float = 100.0
    bonus_above: float = 0.001
    bonus: float = 0.10
    hold_cost: float = 0.000005
    epsilon_start: float = 0.10
    epsilon_end: float = 0.01
    epsilon_decay: float = (0.01 / 0.10) ** (1 / 20)
    epochs: int = 100
    patience: int = 1
    warmup_epochs: int = 2
    min_improve: float = 0.005
    min_short_share: float = 0.03
    bear_floor: float = -0.10
    val_years: tuple = (2022, 2025)
    bear_year: int = 2022
    bull_years: tuple = (2020, 2021, 2024)
    days_per_year: int = 252
    candle_hours: int = 4

    @property
    def state_dim(self) -> int:
        return len(self.features) * 2 * len(self.paces) + 2


DEFAULT = EngineConfig()
