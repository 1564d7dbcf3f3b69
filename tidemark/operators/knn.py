"""Exact nearest neighbours of stated queries in the memory bank, and the vote over them.

The bank and the queries are cut into blocks; each task holds one block of either and
multiplies them, keeping the k best of each query; the bests of the bank's blocks are
merged by rank. Nothing is broadcast and no task grows with the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, EngineConfig
from tidemark.functions.scalars import argmax_first, top2_margin

BANK_BLOCK, QUERY_BLOCK = 16_384, 4_096
_PAIRS = 65_536  # whose differences are held at once

_FOUND = "qid bigint, bid bigint, dist double, excluded boolean"


def sound_states(df: DataFrame, state: str = "state") -> DataFrame:
    return df.filter(f"{state} is not null and size({state}) > 0 and not exists({state}, x -> x is null or isnan(x) or abs(x) = float('infinity'))")


def _search(k: int, gap: int, self_excluded: bool):
    def search(bank: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"qid": [], "bid": [], "dist": [], "excluded": []}, dtype=object)
        if not len(bank) or not len(queries):
            return none
        x, bid = np.stack(bank["b_state"].to_numpy()).astype(np.float64), bank["bid"].to_numpy()
        order = np.argsort(bid)
        x, bid, bep, btick = x[order], bid[order], bank["b_ep"].to_numpy(dtype=float)[order], bank["b_tick"].to_numpy(dtype=float)[order]
        norm = (x**2).sum(1)
        parts = []
        for lo in range(0, len(queries), 256):
            q = queries.iloc[lo : lo + 256]
            y, qid = np.stack(q["q_state"].to_numpy()).astype(np.float64), q["qid"].to_numpy()
            d2 = norm[None, :] - 2 * (y @ x.T)
            slack = 1e-9 * (norm.max() + (y**2).sum(1))
            if self_excluded:
                d2[qid[:, None] == bid[None, :]] = np.inf
            away = np.zeros(d2.shape, dtype=bool)
            if gap > 0:
                ep, tick = q["q_ep"].to_numpy(dtype=float), q["q_tick"].to_numpy(dtype=float)
                away = (ep[:, None] == bep[None, :]) & (np.abs(tick[:, None] - btick[None, :]) < gap)
            for flag in (False, True) if gap > 0 else (False,):
                d = np.where(away == flag, d2, np.inf)
                kth = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(q), np.inf)
                rows, at = np.nonzero(np.isfinite(d) & (d <= (kth + slack)[:, None]))  # all that rounding or ties leave in question
                exact = np.concatenate([np.sqrt(((y[rows[i : i + _PAIRS]] - x[at[i : i + _PAIRS]]) ** 2).sum(1)) for i in range(0, len(rows), _PAIRS)] or [np.empty(0)])
                o = np.lexsort((bid[at], exact, rows))
                rows, at, exact = rows[o], at[o], exact[o]
                top = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
                parts.append(pd.DataFrame({"qid": qid[rows[top]], "bid": bid[at[top]], "dist": exact[top], "excluded": flag}))
        return pd.concat(parts, ignore_index=True) if parts else none

    return search


def knn(queries: DataFrame, bank: DataFrame, k: int = DEFAULT.k, min_tick_gap: int = 0, self_excluded: bool = False) -> DataFrame:
    """``qid, rank, bid, dist``: the k nearest bank rows of each query row, by distance, then row_id.

    Both sides have row_id, episode_id, tick and state. With a gap, rows of the query's episode nearer in
    ticks than the gap are left out (never where a tick or episode is null), unless that leaves none: then
    the whole bank counts. Rows with a null state, or a null, NaN or infinite value in it, take no part; all states have one length.
    Queries and bank may come from one table.
    """
    side = lambda df, name, p: sound_states(df).select(F.col("row_id").cast("bigint").alias(name), *[F.col(c).alias(f"{p}_{a}") for c, a in (("episode_id", "ep"), ("tick", "tick"), ("state", "state"))])
    b, q = side(bank, "bid", "b"), side(queries, "qid", "q")
    nb, nq = (F.expr(f"greatest(1L, cast(ceil(n / {size}) as bigint))") for size in (BANK_BLOCK, QUERY_BLOCK))
    blocks = b.agg(F.count("*").alias("n")).select(nb.alias("nb")).crossJoin(q.agg(F.count("*").alias("n")).select(nq.alias("nq")))  # one row
    n = blocks.first()
    left = b.withColumn("_bb", F.pmod(F.xxhash64("bid"), F.lit(n["nb"]))).withColumn("_bq", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n["nq"] - 1))))
    right = q.withColumn("_qq", F.pmod(F.xxhash64("qid"), F.lit(n["nq"]))).withColumn("_qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n["nb"] - 1))))
    found = left.groupBy("_bb", "_bq").cogroup(right.groupBy("_qb", "_qq")).applyInPandas(_search(k, min_tick_gap, self_excluded), _FOUND)
    if min_tick_gap > 0:
        valid = F.max((~F.col("excluded")).cast("int")).over(Window.partitionBy("qid"))
        found = found.withColumn("_valid", valid).filter("not excluded or _valid = 0")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "bid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("qid", "rank", "bid", "dist")


def neighbour_weights(near: DataFrame, bank: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Neighbours with action, return and weight ``1 / (dist + eps)``, capped relative to the query's median weight."""
    w = F.lit(1.0) / (F.col("dist") + cfg.eps_dist)
    rows = near.join(bank.select(F.col("row_id").alias("bid"), "action", F.col("mc_return").cast("double").alias("ret")), "bid").withColumn("w", w)
    cap = rows.groupBy("qid").agg((cfg.weight_cap * (F.percentile("w", F.lit(0.5)) + cfg.eps)).alias("cap"))
    return rows.join(cap, "qid").withColumn("w", F.least("w", "cap")).drop("cap")


def votes(weighted: DataFrame, mask: Column | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``qid, action, vote, shares, margin, ret_mean, ret_std``: signed, weighted votes of the neighbours.

    An action without neighbours has vote 0; a masked one (``mask``: array<boolean>) can't win and has share 0. Null
    and NaN returns or actions don't vote.
    """
    ok = F.col("ret").isNotNull() & ~F.isnan("ret") & (F.abs("ret") < float("inf"))
    per = weighted.groupBy("qid").agg(
        F.array(*[F.coalesce(F.sum(F.when(ok & (F.col("action") == a), F.col("w") * F.col("ret"))), F.lit(0.0)) for a in range(cfg.actions)]).alias("vote"),
        F.coalesce(F.avg(F.when(ok, F.col("ret"))), F.lit(0.0)).alias("ret_mean"), F.coalesce(F.stddev_pop(F.when(ok, F.col("ret"))), F.lit(0.0)).alias("ret_std"))
    allowed = mask if mask is not None else F.array(*[F.lit(True)] * cfg.actions)
    per = per.withColumn("_m", allowed)
    masked = F.zip_with("vote", "_m", lambda v, m: F.when(m, v))
    filled = F.transform(masked, lambda v: F.coalesce(v, F.lit(0.0)))
    per = per.withColumn("_v", masked).withColumn("_f", filled).withColumn("_low", F.array_min("_f"))
    raw = F.zip_with("_f", "_m", lambda v, m: F.when(m, v - F.col("_low") + cfg.eps).otherwise(0.0))
    per = per.withColumn("_s", raw).withColumn("_t", F.aggregate("_s", F.lit(0.0), lambda a, x: a + x))
    shares = F.when(F.col("_t") > 0, F.transform("_s", lambda x: x / F.col("_t"))).otherwise(F.array(*[F.lit(1.0 / cfg.actions)] * cfg.actions))
    return per.select("qid", argmax_first(F.col("_v")).alias("action"), "vote", shares.alias("shares"), top2_margin(F.filter("_v", lambda v: v.isNotNull())).alias("margin"), "ret_mean", "ret_std")


def excluded_counts(queries: DataFrame, bank: DataFrame, min_tick_gap: int) -> DataFrame:
    """``qid, excluded``: how many bank rows the temporal exclusion leaves out for each query; 0 where it would leave none.

    The bank is counted per episode and tick first, so many rows of one tick (as legacy rows are) are one row of the join.
    """
    gap = F.lit(int(min_tick_gap)).cast("bigint")
    b = sound_states(bank).groupBy(F.col("episode_id").alias("b_ep"), F.col("tick").alias("b_tick")).agg(F.count("*").alias("n"))
    q = sound_states(queries).select(F.col("row_id").alias("qid"), F.col("episode_id").alias("q_ep"), F.col("tick").alias("q_tick"))
    if min_tick_gap <= 0:
        return q.select("qid", F.lit(0).cast("bigint").alias("excluded"))
    at = q.withColumn("_g", F.explode(F.array(*[F.floor(F.col("q_tick") / gap) + i for i in (-1, 0, 1)])))
    near = at.join(b.withColumn("_h", F.floor(F.col("b_tick") / gap)), (F.col("q_ep") == F.col("b_ep")) & (F.col("_g") == F.col("_h")) & (F.abs(F.col("q_tick") - F.col("b_tick")) < gap))
    n = near.groupBy("qid").agg(F.sum("n").alias("_n"))
    total = b.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_all"))
    return q.join(n, "qid", "left").crossJoin(total).select("qid", F.when(F.col("_n") < F.col("_all"), F.col("_n")).otherwise(F.lit(0)).cast("bigint").alias("excluded"))  # one row


def decide(queries: DataFrame, bank: DataFrame, mask: Column | None = None, k: int | None = None, min_tick_gap: int = 0, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``votes`` of every query with a sound state; where the bank holds no row, HOLD with shares [0, 0, 0, 1] and margin 0, whatever the mask."""
    found = votes(neighbour_weights(knn(queries, bank, k or cfg.k, min_tick_gap), bank, cfg), mask, cfg)
    zeros = F.array(*[F.lit(0.0)] * cfg.actions)
    none = {"action": F.lit(cfg.actions - 1), "vote": zeros, "shares": F.array(*[F.lit(float(a == cfg.actions - 1)) for a in range(cfg.actions)])}
    q = sound_states(queries).select(F.col("row_id").cast("bigint").alias("qid"))
    return q.join(found, "qid", "left").select("qid", *[F.coalesce(F.col(c), none.get(c, F.lit(0.0))).alias(c) for c in ("action", "vote", "shares", "margin", "ret_mean", "ret_std")])


def distance_report(near: DataFrame, duplicate: float = 0.05) -> DataFrame:
    """Integrity of a bank: median distance of the first and tenth neighbour, of all ten, and the share of near copies."""
    d = lambda r: F.percentile(F.when(F.col("rank") == r, F.col("dist")), F.lit(0.5))
    return near.agg(F.count_distinct("qid").alias("queries"), d(1).alias("median_first"), d(10).alias("median_tenth"), F.percentile("dist", F.lit(0.5)).alias("median_all"),
                    F.avg(F.when(F.col("rank") == 1, (F.col("dist") < duplicate).cast("double"))).alias("near_copies"))
