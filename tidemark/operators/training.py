"""The training driver: passes over the training rows, their commits to the bank, validation and model selection.

Each epoch is one job over all series at once; what the driver holds is one row of metrics a split. The bank of the next epoch
is a written table, so lineage doesn't grow with the epochs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, EngineConfig
from tidemark.operators.returns import append, discounted_returns, prune, save_bank
from tidemark.operators.simulate import Selection, epoch_metrics, fold, memory_policy, next_epsilon
from tidemark.plans.blocks import ranked
from tidemark.storage import materialize


def numbered(df: DataFrame, episode: str) -> DataFrame:
    """Add ``_number``: the number of an episode in the bank, the same in every epoch; a double holds it exactly."""
    return df.withColumn("_number", F.pmod(F.xxhash64(F.col(episode)), F.lit(1 << 52)))


def transitions(trace: DataFrame, episode: str, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Bank rows of a training trace: state, action and discounted return of each tick but an episode's last.

    A tick's row is pushed once its successor is known, so the last tick of an episode is not. The tick stored is the
    position in the episode's buffer. The episode's number in the bank stays the same over epochs, so temporal
    exclusion also meets rows of earlier passes.
    """
    r = ranked(trace.withColumn("_b", F.expr("tick div 4096")), episode, "tick", "_b", "i").drop("_b")
    last = r.groupBy(episode).agg(F.max("i").alias("_last"))
    pushed = r.join(last, episode).filter("i < _last").withColumn("_r", F.col("reward") * cfg.reward_scale)
    out = discounted_returns(pushed, episode, "i", "_r", "mc_return", cfg)
    return numbered(out, episode).select(F.col("_number").alias("episode_id"), F.col("i").alias("tick"), F.col("action").cast("bigint").alias("action"), F.col("mc_return").cast("float").alias("mc_return"), F.col("state").cast("array<float>").alias("state"))


def commit(bank: DataFrame, rows: DataFrame, seed: int = 0, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The bank with new rows, numbered behind the old ones, pruned to its cap and written."""
    top = bank.agg(F.coalesce(F.max("row_id"), F.lit(-1)).alias("_top"))
    part = Window.partitionBy("_p").orderBy("episode_id", "tick")
    split = materialize(rows.withColumn("_p", F.pmod(F.xxhash64("episode_id", "tick", "action", "mc_return"), F.lit(256))), "pushed")
    sizes = split.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))  # 256 rows
    counted = split.join(sizes.select("_p", F.coalesce("_before", F.lit(0)).alias("_before")), "_p").crossJoin(top)  # one row
    counted = counted.withColumn("row_id", F.col("_top") + F.col("_before") + F.row_number().over(part)).drop("_p", "_before", "_top")
    return materialize(prune(append(bank, counted), cfg.bank_cap, seed, cfg), "bank")


@dataclass
class Training:
    """State between epochs."""

    bank: DataFrame
    epoch: int = 0
    selection: Selection = field(default_factory=Selection)
    stopped: bool = False
    reports: list = field(default_factory=list)


def _share(counts: list[int], action: int) -> float:
    return counts[action] / max(1, sum(counts))


def epochs(train: DataFrame, validation: DataFrame, bank: DataFrame, episode: str = "series", split: str = "split", bear: str = "val_2022", n: int | None = None, seed: int = 0, best_path: str | None = None, cfg: EngineConfig = DEFAULT) -> Iterator[Training]:
    """Train until the selection stops or ``n`` epochs have passed; yields after each epoch.

    ``train`` and ``validation`` have episode, tick, Close, ATR_Scaled and state; ``validation`` also a split, each of which is an episode of
    its own. Training explores with a decaying epsilon; validation doesn't. Each series of the training rows is an episode of the bank.
    """
    at = Training(bank)
    passes = validation.withColumn("_e", F.concat_ws("/", split, F.col(episode).cast("string")))
    while not at.stopped and at.epoch < (n or cfg.epochs):
        at.epoch += 1
        policy = memory_policy(at.bank, cfg=cfg)
        trace = materialize(fold(numbered(train, episode), episode, policy, cfg, next_epsilon(at.epoch - 1, cfg), seed + at.epoch, "_number"), "epoch")
        rows = transitions(trace, episode, cfg)
        at.bank = commit(at.bank, rows, seed + at.epoch, cfg)
        tested = materialize(fold(passes, "_e", memory_policy(at.bank, cfg=cfg), cfg).withColumn(split, F.split("_e", "/", 2)[0]), "validation")
        t = epoch_metrics(trace, []).first()
        v = {r[split]: r for r in epoch_metrics(tested, [split]).collect()}  # one row a split
        counts = [sum(r["action_counts"][a] for r in v.values()) for a in range(cfg.actions)]
        gain = sum(r["realised_pnl"] for r in v.values())
        bear_gain = v[bear]["realised_pnl"] if bear in v else 0.0
        at.selection, save, at.stopped = at.selection.update(at.epoch, _share(t["action_counts"], 1), gain, _share(counts, 0), _share(counts, 1), bear_gain, cfg)
        if save and best_path:
            save_bank(at.bank, best_path, {"state_dim": cfg.state_dim, "action_dim": cfg.actions, "k": cfg.k, "max_size": cfg.bank_cap, "min_tick_gap": cfg.min_tick_gap, "n_commits": at.epoch, "next_episode_id": 0, "signal_threshold": cfg.signal_threshold, "eps_dist": cfg.eps_dist, "max_weight_ratio": cfg.weight_cap})
        at.reports.append({"epoch": at.epoch, "train_pnl": float(t["realised_pnl"]), "train_trades": int(t["n_trades"]), "val_pnl": float(gain), "bear_pnl": float(bear_gain), "epsilon": next_epsilon(at.epoch, cfg), "bank": at.bank.count(), "saved": bool(save)})
        yield at
