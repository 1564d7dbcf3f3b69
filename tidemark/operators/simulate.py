"""The closed loop: a fold over ticks whose state depends on its own decisions.

One pure function, ``advance``, takes a state and a row and gives the next state and
an output; batch (``fold``) and streaming (``streaming.positions``) both call it. Portfolio
values feed back into the next decision, so ticks of one episode are sequential by nature;
episodes (series, splits, parameter sets) run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import CLOSE, DEFAULT, HOLD, LONG, SHORT, EngineConfig
from tidemark.operators.candidates import TICKS, Candidates
from tidemark.operators.features import states_of

WINDOW = 8  # ticks looked at ahead, as if the position stayed
FLAT = 64  # ticks looked at ahead without a position
PAIRS = 1 << 18  # of tick and candidate compared at once


class Policy(Protocol):
    def __call__(self, state: np.ndarray, mask: np.ndarray) -> tuple[int, np.ndarray]:
        """Action and shares of the four actions; a masked action must not be returned."""


@dataclass(frozen=True)
class Position:
    side: str | None = None
    entry: float = 0.0
    entry_tick: int = 0


def unrealised(p: Position, price: float, cfg: EngineConfig = DEFAULT) -> float:
    if p.side is None:
        return 0.0
    gain = (price - p.entry) / p.entry if p.side == "LONG" else (p.entry - price) / p.entry
    return float(min(cfg.pnl_clip, max(-cfg.pnl_clip, gain)))


def mask_of(p: Position) -> np.ndarray:
    flat = p.side is None
    return np.array([flat, flat, not flat, True])


def settle(p: Position, price: float, cfg: EngineConfig = DEFAULT) -> float:
    if p.side == "LONG":
        return (price * (1 - cfg.commission) - p.entry) / p.entry
    return (p.entry - price * (1 + cfg.commission)) / p.entry


def forced(p: Position, tick: int, volatility: float, open_gain: float, cfg: EngineConfig = DEFAULT) -> int | None:
    """The action of a tick that the policy isn't asked for: volatility gate, stop loss, longest hold."""
    if p.side is None:
        return HOLD if abs(volatility) > cfg.atr_gate else None
    return CLOSE if open_gain <= cfg.stop_loss or tick - p.entry_tick >= cfg.max_hold else None


def carried(p: Position, tick: int, price: float, action: int, cfg: EngineConfig = DEFAULT) -> tuple[Position, float]:
    """The position after an action, and the gain it settles."""
    pnl, after = 0.0, p
    if action in (LONG, SHORT):
        wanted = "LONG" if action == LONG else "SHORT"
        if after.side is not None and after.side != wanted:
            pnl, after = settle(after, price, cfg), Position()
        if after.side is None:
            after = Position(wanted, price * (1 + cfg.commission if action == LONG else 1 - cfg.commission), tick)
    elif action == CLOSE and p.side is not None:
        pnl, after = settle(p, price, cfg), Position()
    return after, pnl


def advance(p: Position, tick: int, price: float, volatility: float, market: np.ndarray, policy: Policy, cfg: EngineConfig = DEFAULT) -> tuple[Position, dict]:
    """One tick: volatility gate, forced exit, else the policy; then the action is carried out."""
    open_gain = unrealised(p, price, cfg)
    state = np.concatenate([market[:-2], [{"LONG": 1.0, "SHORT": -1.0}.get(p.side, 0.0), open_gain]]).astype(np.float32)
    if (action := forced(p, tick, volatility, open_gain, cfg)) is not None:
        shares = np.eye(4)[action]
    else:
        action, shares = policy(state, mask_of(p))
    after, pnl = carried(p, tick, price, action, cfg)
    return after, {"action": int(action), "pnl": float(pnl), "side": after.side, "entry": after.entry if after.side else None, "entry_tick": after.entry_tick if after.side else None, "unrealised": open_gain, "shares": [float(x) for x in shares]}


@dataclass(frozen=True)
class Look:
    """What the bank says of a state, without a mask: signed votes, margin of the best two, mean and spread of the neighbours' returns."""

    vote: np.ndarray
    margin: float = 0.0
    ret_mean: float = 0.0
    ret_std: float = 0.0


class BankPolicy:
    """Vote of the k nearest rows, by distance, then position, of a bank of bounded size (``bank_cap``); an empty bank holds.

    Rows without a finite return or with an action below 0 are neighbours that don't vote. With a gap, rows of the
    episode nearer in ticks are left out, unless that leaves none. Without one, ``candidates`` are sought for the market parts of the next
    states and ``looks`` compares them alone. With one, ``ahead`` takes these parts, whose distances to all rows are then made in one
    product; only the portfolio's two dimensions remain for each tick.
    """

    def __init__(self, states: np.ndarray, actions: np.ndarray, returns: np.ndarray, k: int = DEFAULT.k, cfg: EngineConfig = DEFAULT, episodes: np.ndarray | None = None, ticks: np.ndarray | None = None):
        if len(states) > cfg.bank_cap:
            raise ValueError(f"a bank in a fold holds at most {cfg.bank_cap} rows; prune it first")
        valid = np.isfinite(returns) & (actions >= 0)
        self.states, self.k, self.cfg = states.astype(np.float64), k, cfg
        self.voted, self.weight = np.where(valid, actions, 0).astype(np.int64), np.where(valid, returns, 0.0)
        self.valid, self.norm = valid, (self.states**2).sum(1)
        self.episodes, self.ticks = episodes, ticks
        self.mine = np.ascontiguousarray(self.states[:, -2:])
        self.market, self.part, self.own = None, None, None
        self.sought: Candidates | None = None

    @property
    def chunk(self) -> int:
        return max(1, 8_000_000 // max(1, len(self.states)))

    def ahead(self, market: np.ndarray) -> None:
        """The market parts of the next ticks (all dimensions but the last two)."""
        if self.market is None:
            self.market, self.own = np.ascontiguousarray(self.states[:, :-2].T.astype(np.float32)), self.states[:, -2:]
        self.part = (self.norm - (self.own**2).sum(1))[None, :].astype(np.float32) - 2 * (market[:, :-2].astype(np.float32) @ self.market)

    def look(self, state: np.ndarray, i: int | None = None, episode: float | None = None, tick: int = 0) -> Look:
        if not len(self.states):
            return Look(np.zeros(4))
        state = state.astype(np.float64)
        if i is not None and self.part is not None:
            d2 = self.part[i] + ((self.own - state[-2:]) ** 2).sum(1) - state[-2:] @ state[-2:]
            slack = 2e-6 * (self.norm.max() + state @ state)
        else:
            d2, slack = self.norm - 2 * (self.states @ state), 1e-9 * (self.norm.max() + state @ state)
        if episode is not None and self.cfg.min_tick_gap > 0 and self.episodes is not None:
            away = (self.episodes == episode) & (np.abs(self.ticks - tick) < self.cfg.min_tick_gap)
            if away.any() and not away.all():
                d2 = np.where(away, np.inf, d2)
        n = min(self.k, int(np.isfinite(d2).sum()))
        near = np.nonzero(d2 <= np.partition(d2, n - 1)[n - 1] + slack)[0]  # rounding must not decide ties
        dist = np.sqrt(self.base(near, state[:-2]) + ((self.states[near, -2:] - state[-2:]) ** 2).sum(1))
        first = np.lexsort((near, dist))[:n]
        near, dist = near[first], dist[first]
        w = 1 / (dist + self.cfg.eps_dist)
        w = np.minimum(w, self.cfg.weight_cap * (np.median(w) + self.cfg.eps))
        vote = np.bincount(self.voted[near], weights=w * self.weight[near], minlength=4)[:4]
        ret, top = self.weight[near][self.valid[near]], np.sort(vote)
        return Look(vote, float(top[-1] - top[-2]), *((float(ret.mean()), float(ret.std())) if len(ret) else (0.0, 0.0)))

    def base(self, rows: np.ndarray, market: np.ndarray) -> np.ndarray:
        """Squared distances of rows from a market part, or from one each."""
        return ((self.states[rows, :-2] - market) ** 2).sum(1)

    def bases(self, market: np.ndarray, near: list[np.ndarray]) -> list[np.ndarray]:
        """``base`` of the candidates of each tick."""
        sizes, out, lo = np.array([len(c) for c in near]), [], 0
        while lo < len(near):
            hi = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:]), PAIRS, side="right")))
            y = np.repeat(market[lo:hi], sizes[lo:hi], axis=0)
            out += np.split(self.base(np.concatenate(near[lo:hi]), y), np.cumsum(sizes[lo:hi])[:-1])
            lo = hi
        return out

    def candidates(self, market: np.ndarray) -> list[np.ndarray]:
        """For the market parts of states, the rows of the bank that can be among the nearest, whatever the portfolio."""
        if self.sought is None:
            self.sought = Candidates(self.states, self.k, self.cfg.pnl_clip)
        return self.sought.of(market)

    def looks(self, states: np.ndarray, near: list[np.ndarray], base: list[np.ndarray] | None = None) -> list[Look]:
        """``look`` of several states, each among its candidates. base: those of the candidates, if known."""
        states = states.astype(np.float64)
        vote, margin, mean, std = self._looks(states[:, -2:], near, self.bases(states[:, :-2], near) if base is None else base)
        return [Look(*x) for x in zip(vote, margin.tolist(), mean.tolist(), std.tolist())]

    def _looks(self, own: np.ndarray, near: list[np.ndarray], base: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        h, n = len(own), min(self.k, len(self.states))
        size = np.array([len(c) for c in near])
        held = np.arange(size.max()) < size[:, None]
        rows, dist = np.zeros(held.shape, dtype=np.int64), np.full(held.shape, np.inf)
        rows[held], dist[held] = np.concatenate(near), np.concatenate(base)
        dist = np.sqrt(dist + ((self.mine[rows] - own[:, None]) ** 2).sum(2))
        first = np.argsort(dist, axis=1, kind="stable")[:, :n]  # candidates lie in order of position
        rows, dist = np.take_along_axis(rows, first, 1), np.take_along_axis(dist, first, 1)
        w = 1 / (dist + self.cfg.eps_dist)
        w = np.minimum(w, self.cfg.weight_cap * (np.median(w, axis=1)[:, None] + self.cfg.eps))
        ok, ret = self.valid[rows], self.weight[rows]
        vote = np.bincount((4 * np.arange(h)[:, None] + self.voted[rows]).ravel(), weights=(w * ret).ravel(), minlength=4 * h).reshape(h, 4)
        margin = np.diff(np.sort(vote, axis=1), axis=1)[:, -1]
        some = np.maximum(1, ok.sum(1))
        mean = ret.sum(1) / some  # a row that doesn't vote has weight 0
        std = np.sqrt((np.where(ok, ret - mean[:, None], 0.0) ** 2).sum(1) / some)
        return vote, margin, mean, std

    def chosen(self, vote: np.ndarray, mask: np.ndarray) -> tuple[list, np.ndarray]:
        """``choose`` for several votes under one mask."""
        f = np.where(mask, vote, 0.0)
        s = np.where(mask, f - f.min(1)[:, None] + self.cfg.eps, 0.0)
        total = s.sum(1)[:, None]
        return np.where(mask, vote, -np.inf).argmax(1).tolist(), np.where(total > 0, s / np.where(total > 0, total, 1.0), 0.25)

    def choose(self, look: Look, mask: np.ndarray) -> tuple[int, np.ndarray]:
        if not len(self.states):
            return HOLD, np.eye(4)[HOLD]
        f = np.where(mask, look.vote, 0.0)
        s = np.where(mask, f - f.min() + self.cfg.eps, 0.0)
        return int(np.where(mask, look.vote, -np.inf).argmax()), s / s.sum() if s.sum() > 0 else np.full(4, 0.25)

    def __call__(self, state: np.ndarray, mask: np.ndarray) -> tuple[int, np.ndarray]:
        return self.choose(self.look(state), mask)


def bank_policy(states: np.ndarray, actions: np.ndarray, returns: np.ndarray, k: int = DEFAULT.k, cfg: EngineConfig = DEFAULT, **where) -> BankPolicy:
    return BankPolicy(states, actions, returns, k, cfg, **where)


def memory_rows(bank: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """The sound rows of a bank, pruned to ``bank_cap`` as the reference's memory is."""
    from tidemark.operators.knn import sound_states
    from tidemark.operators.returns import prune

    return prune(sound_states(bank).filter(F.size("state") == cfg.state_dim), cfg.bank_cap)


class Memory:
    """The bank of a policy as it travels to the tasks, broadcast once; a task builds its policy on first use."""

    def __init__(self, shared, k: int, cfg: EngineConfig):
        self.shared, self.k, self.cfg, self.made = shared, k, cfg, None

    def __getstate__(self) -> dict:
        return {"shared": self.shared, "k": self.k, "cfg": self.cfg, "made": None}

    def policy(self) -> BankPolicy:
        if self.made is None:
            kept = vars(self.shared).setdefault("_policies", {})  # a worker's tasks share one broadcast
            if (self.k, self.cfg) not in kept:
                states, actions, gains, episodes, ticks = self.shared.value
                kept[self.k, self.cfg] = BankPolicy(states, actions, gains, self.k, self.cfg, episodes, ticks)
            self.made = kept[self.k, self.cfg]
        return self.made

    def __call__(self, state: np.ndarray, mask: np.ndarray) -> tuple[int, np.ndarray]:
        return self.policy()(state, mask)


def memory_policy(bank: DataFrame, k: int | None = None, cfg: EngineConfig = DEFAULT) -> Memory:
    """``BankPolicy`` over ``memory_rows`` in order of row_id; what travels to the tasks is bounded by the cap."""
    rows = memory_rows(bank, cfg)
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c)
    # as arrays throughout: rows of pandas take the driver several times their size
    t = rows.select("row_id", F.coalesce(F.col("action").cast("int"), F.lit(-1)).alias("action"), number("mc_return"), number("episode_id"), number("tick"), F.col("state").cast("array<float>").alias("state")).toArrow()
    order = np.argsort(t["row_id"].to_numpy(), kind="stable")
    of = lambda c, kind: t[c].to_numpy().astype(kind)[order]
    states = t["state"].combine_chunks().flatten().to_numpy().reshape(-1, cfg.state_dim)[order]
    rest = of("action", np.int64), *(of(c, float) for c in ("mc_return", "episode_id", "tick"))
    del t
    shared = bank.sparkSession.sparkContext.broadcast((states, *rest))
    return Memory(shared, k or cfg.k, cfg)


_OUT = "tick bigint, price double, action int, pnl double, side string, entry double, entry_tick bigint, unrealised double, shares array<double>"
#: Of a trace with a bank: what it says of each state without a mask, and the state decided on.
_SEEN = ", vote array<double>, margin double, ret_mean double, ret_std double, state array<float>, reward double"


def explore(policy: Callable, epsilon: float, rng: np.random.Generator) -> Callable:
    """A policy that takes a random allowed action with a chance of ``epsilon``, with the shares of the vote without a mask."""

    def act(state: np.ndarray, mask: np.ndarray) -> tuple[int, np.ndarray]:
        if epsilon > 0 and rng.random() < epsilon:
            return int(rng.choice(np.flatnonzero(mask))), policy(state, np.ones(4, dtype=bool))[1]
        return policy(state, mask)

    return act


def shaped(pnl: float, side: str | None, cfg: EngineConfig = DEFAULT) -> float:
    """Reward of a tick: the gain, a bonus on good ones, a cost while a position is held."""
    return pnl + (pnl * cfg.bonus if pnl > cfg.bonus_above else 0.0) - (cfg.hold_cost if side is not None and pnl == 0.0 else 0.0)


_FLAT, _HELD = mask_of(Position()), mask_of(Position("LONG"))


def traced(bank: BankPolicy, market: np.ndarray, ticks: np.ndarray, prices: np.ndarray, volatility: np.ndarray, wanted: list[str], cfg: EngineConfig = DEFAULT) -> dict:
    """The wanted columns of the trace of one episode, in order of ticks, by the candidates of a bank.

    What the bank says without a position is known for many ticks at once; with one, for the next ticks as if it stayed.
    """
    n, p = len(ticks), Position()
    says = any(c in wanted for c in ("vote", "margin", "ret_mean", "ret_std"))  # of ticks that it isn't asked for, too
    entered = {"LONG": 1.0, "SHORT": -1.0}
    action, side, gate = np.empty(n, dtype=np.int64), np.empty(n, dtype=object), volatility.tolist()
    entry, entry_tick, pnl, gain, own = np.full(n, np.nan), [None] * n, np.zeros(n), np.zeros(n), np.zeros((n, 2))
    shares, seen = np.zeros((n, 4)), [np.zeros((n, 4)), *np.zeros((3, n))]
    tick_at, price_at = ticks.tolist(), prices.tolist()
    near: list = []
    base: list = []
    held = flat = (0, 0, None, None, None)  # first and last tick, looks, actions, shares

    def looks(lo: int, hi: int, start: int, q: Position) -> tuple:
        mine = np.array([[entered.get(q.side, 0.0), unrealised(q, x, cfg)] for x in price_at[lo:hi]]).astype(np.float32).astype(np.float64)
        x = bank._looks(mine, near[lo - start : hi - start], base[lo - start : hi - start])
        return (lo, hi, x, *bank.chosen(x[0], _FLAT if q.side is None else _HELD))

    for i in range(n):
        if i % TICKS == 0:
            start, stop = i, min(n, i + TICKS)
            near = bank.candidates(market[start:stop, :-2])
            base = bank.bases(market[start:stop, :-2].astype(np.float32).astype(np.float64), near)
            held = flat = (0, 0, None, None, None)
        tick, price, before = tick_at[i], price_at[i], p
        open_gain = unrealised(p, price, cfg)
        a = forced(p, tick, gate[i], open_gain, cfg)
        if a is None or says:
            if p.side is None:
                if i >= flat[1]:
                    flat = looks(i, min(i + FLAT, stop), start, p)
                ahead = flat
            else:
                if i >= held[1]:
                    held = looks(i, min(i + WINDOW, stop), start, p)
                ahead = held
            at = i - ahead[0]
            if says:
                for to, x in zip(seen, ahead[2]):
                    to[i] = x[at]
        if a is None:
            a, shares[i] = ahead[3][at], ahead[4][at]
        else:
            shares[i, a] = 1.0
        p, pnl[i] = carried(p, tick, price, a, cfg)
        if p is not before:
            held = (0, 0, None, None, None)  # another entry
        action[i], side[i], gain[i], own[i] = a, p.side, open_gain, (entered.get(before.side, 0.0), open_gain)
        if p.side is not None:
            entry[i], entry_tick[i] = p.entry, p.entry_tick
    make = {
        "tick": lambda: ticks, "price": lambda: prices, "action": lambda: action, "pnl": lambda: pnl, "side": lambda: side, "entry": lambda: entry, "entry_tick": lambda: entry_tick, "unrealised": lambda: gain,
        "shares": lambda: shares.tolist(), "vote": lambda: seen[0].tolist(), "margin": lambda: seen[1], "ret_mean": lambda: seen[2], "ret_std": lambda: seen[3],
        "state": lambda: list(np.concatenate([market[:, :-2], own], axis=1).astype(np.float32)), "reward": lambda: [shaped(x, s, cfg) for x, s in zip(pnl.tolist(), side)],
    }
    return {c: make[c]() for c in wanted if c in make}


def fold(states: DataFrame, episode: str, policy: Policy | Callable, cfg: EngineConfig = DEFAULT, epsilon: float = 0.0, seed: int = 0, number: str | None = None, keep: tuple[str, ...] | None = None, features: tuple[str, ...] | None = None) -> DataFrame:
    """Trace of each episode: ``episode, tick, price, action, pnl, side, entry, ...`` from rows with tick, Close, ATR_Scaled and state.

    A policy over a bank (``memory_policy``) also gives what the bank says of every state: votes, margin, returns of the neighbours. Rows
    with a null state or price are skipped. A position open at the end stays open and is never settled. epsilon: chance of a
    random action, drawn from seed and episode, whatever the partitioning. number: a column with the bank's number of the episode, for its
    temporal exclusion. Reward is that of the tick's own action. keep: of the columns after the episode, those wanted, in their order. features: instead of state,
    rows have these columns and all ticks of the episode from 0; the task that folds it builds its states, and ticks after the warm-up are traced.
    """
    seen = isinstance(policy, Memory)
    kinds = [c for c in (_OUT + (_SEEN if seen else "")).split(", ") if keep is None or c.split()[0] in keep]
    names = [episode, *[c.split()[0] for c in kinds]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["tick", "Close", *([] if features else ["state"])]).sort_values("tick")
        if features:
            if not np.array_equal(pdf["tick"].to_numpy(), np.arange(len(pdf))):
                raise ValueError(f"{episode} {pdf[episode].iloc[0]}: ticks must run from 0 without gaps")
            market = states_of(pdf[list(features)].to_numpy(dtype=float), cfg).astype(np.float64)
            pdf = pdf.iloc[len(pdf) - len(market) :]
        if not len(pdf):
            return pd.DataFrame({c: [] for c in names}, dtype=object)
        name, p, out = pdf[episode].iloc[0], Position(), []
        bank = policy.policy() if seen else None
        rng = np.random.default_rng([seed, *str(name).encode()])
        if not features:
            market = np.stack(pdf["state"].to_numpy()).astype(np.float64)
        at: dict = {}
        mine = float(pdf[number].iloc[0]) if number else None
        price_at = pdf["Close"].to_numpy(dtype=float)
        quick = seen and len(bank.states) > 0 and mine is None and bool(np.isfinite(market).all())  # no rows are left out by time
        near: list = []
        ahead: dict = {}  # tick: the portfolio's part of its state and the look, if the position stays

        def look(state: np.ndarray) -> Look:
            if not quick:
                return bank.look(state, at["i"], mine, at["tick"])
            i, q = at["row"], at["before"]
            if i not in ahead or not np.array_equal(ahead[i][0], state[-2:]):
                stop = min(i + WINDOW, i - at["i"] + len(near))
                own = np.array([[{"LONG": 1.0, "SHORT": -1.0}.get(q.side, 0.0), unrealised(q, x, cfg)] for x in price_at[i:stop].tolist()])
                states = np.concatenate([market[i:stop, :-2], own], axis=1).astype(np.float32)
                ahead.clear()
                ahead.update((i + j, (o, x)) for j, (o, x) in enumerate(zip(states[:, -2:], bank.looks(states, near[at["i"] : at["i"] + stop - i]))))
            return ahead[i][1]

        def vote(state: np.ndarray, mask: np.ndarray) -> tuple[int, np.ndarray]:
            at["look"] = at["look"] or look(state)
            return bank.choose(at["look"], mask)

        if quick and epsilon == 0:
            return pd.DataFrame({episode: [name] * len(pdf), **traced(bank, market, pdf["tick"].to_numpy(), price_at, pdf["ATR_Scaled"].to_numpy(dtype=float), names, cfg)})[names]
        act = explore(vote if seen else policy, epsilon, rng)
        size = TICKS if quick else bank.chunk if seen and len(bank.states) else len(pdf)
        for i, (tick, price, atr) in enumerate(zip(pdf["tick"].tolist(), pdf["Close"].tolist(), pdf["ATR_Scaled"].tolist())):
            if quick and i % size == 0:
                near = bank.candidates(market[i : i + size, :-2])
            elif seen and len(bank.states) and i % size == 0:
                bank.ahead(market[i : i + size])
            at.update(look=None, i=i % size, row=i, tick=int(tick), before=p)
            before = p
            p, row = advance(p, int(tick), float(price), float(atr), market[i], act, cfg)
            row = {episode: name, "tick": tick, "price": price, **row}
            if seen:
                state = np.concatenate([market[i, :-2], [{"LONG": 1.0, "SHORT": -1.0}.get(before.side, 0.0), row["unrealised"]]]).astype(np.float32)
                says = at["look"] or look(state)
                row |= {"vote": says.vote.tolist(), "margin": says.margin, "ret_mean": says.ret_mean, "ret_std": says.ret_std, "state": state, "reward": shaped(row["pnl"], p.side, cfg)}
            out.append(row)
        return pd.DataFrame(out, columns=names).astype({"entry": float} if "entry" in names else {})

    kind = dict(states.dtypes)[episode]
    own = ["state"] if not features else [c for c in features if c != "ATR_Scaled"]
    rows = states.select(episode, "tick", F.col("Close").cast("double"), F.col("ATR_Scaled").cast("double"), *own, *([number] if number else []))
    if seen:  # their work counts, not their bytes, by which partitions would be joined
        rows = rows.repartition(8 * int(states.sparkSession.conf.get("spark.sql.shuffle.partitions")), episode)
    return rows.groupBy(episode).applyInPandas(run, ", ".join([f"{episode} {kind}", *kinds]))


def trades_of(trace: DataFrame, episode: str) -> DataFrame:
    """Closed trades of a trace: the tick that closes carries the gain, the row before it the position."""
    from pyspark.sql import Window

    w = Window.partitionBy(episode).orderBy("tick")
    before = trace.withColumn("_s", F.lag("side").over(w)).withColumn("_e", F.lag("entry").over(w)).withColumn("_t", F.lag("entry_tick").over(w))
    closed = before.filter((F.col("action") == CLOSE) & F.col("_s").isNotNull())
    return closed.select(episode, F.col("_t").alias("entry_tick"), F.col("tick").alias("exit_tick"), (F.col("tick") - F.col("_t")).alias("duration"), F.col("_s").alias("side"), "pnl", F.col("_e").alias("entry_price"), F.col("price").alias("exit_price"), (F.col("pnl") > 0).alias("win"))


def random_baseline(prices: DataFrame, trials: int = 1000, trades: int = 500, seed: int = 0, cfg: EngineConfig = DEFAULT, by: str | None = None) -> DataFrame:
    """Mean, spread and share of positive trials of a random policy, per group of ``by`` if given; ``prices`` has tick 0..n-1 and Close.

    Reproducible: the draws of a group follow from seed and group, whatever the partitioning. A trade may begin and end anywhere
    in its group, so a task holds the ticks and prices of one.
    """
    group = by or "_all"
    rows = prices.withColumn(group, F.lit(0)) if by is None else prices.filter(F.col(by).isNotNull())

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        close = pdf["Close"].to_numpy(dtype=float)[np.argsort(pdf["tick"].to_numpy())]
        rng = np.random.default_rng([seed, *str(key[0]).encode()])
        n, sums = len(close), []
        for lo in range(0, trials, 100):
            size = (min(100, trials - lo), trades)
            at, hold, sgn = rng.integers(0, max(1, n - 33), size), rng.integers(1, 33, size), rng.choice([-1.0, 1.0], size)
            entry, exit_ = close[at] * (1 + sgn * cfg.commission), close[np.minimum(at + hold, n - 1)] * (1 - sgn * cfg.commission)
            sums.append((sgn * (exit_ - entry) / entry).sum(1))
        pnl = np.concatenate(sums)
        return pd.DataFrame({group: [key[0]], "mean": pnl.mean(), "std": pnl.std(), "win_rate": (pnl > 0).mean()})

    out = rows.select(group, "tick", "Close").groupBy(group).applyInPandas(run, f"{group} {dict(rows.dtypes)[group]}, mean double, std double, win_rate double")
    return out if by else out.drop(group)


def next_epsilon(epoch: int, cfg: EngineConfig = DEFAULT) -> float:
    return max(cfg.epsilon_end, cfg.epsilon_start * cfg.epsilon_decay**epoch)


@dataclass(frozen=True)
class Selection:
    """Model selection over epochs: best validation gain so far and for how many epochs nothing was saved."""

    best: float = float("-inf")
    stale: int = 0

    def update(self, epoch: int, train_short: float, val_gain: float, val_long: float, val_short: float, bear_gain: float, cfg: EngineConfig = DEFAULT) -> tuple[Selection, bool, bool]:
        """The next selection, whether to save, and whether to stop; shares are those of an action among all.

        Training that hardly ever goes short stops at once, without a verdict on the epoch. An epoch is saved if both directions are used in
        validation, its gain beats the best by ``min_improve`` and the bear year stays above its floor.
        """
        if epoch > cfg.warmup_epochs and train_short < cfg.min_short_share:
            return self, False, True
        directional = val_short >= cfg.min_short_share and val_long >= cfg.min_short_share
        save = directional and val_gain > self.best + cfg.min_improve and bear_gain > cfg.bear_floor
        new = Selection(val_gain, 0) if save else replace(self, stale=self.stale + 1)
        return new, save, epoch >= cfg.warmup_epochs and new.stale >= cfg.patience


def epoch_metrics(trace: DataFrame, by: list[str], cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Per group of a trace: ``realised_pnl, n_trades`` (ticks with a gain or loss), ``action_counts`` and ``update_count`` (always 0)."""
    counts = F.array(*[F.count_if(F.col("action") == a) for a in range(cfg.actions)])
    return trace.groupBy(*by).agg(F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("realised_pnl"), F.count_if(F.col("pnl") != 0).alias("n_trades"), counts.alias("action_counts"), F.lit(0).cast("bigint").alias("update_count"))
