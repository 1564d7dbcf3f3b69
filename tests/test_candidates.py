"""The candidates of a bank against all of its rows, and the fold over them."""

import numpy as np
import pytest

from tidemark.config import DEFAULT
from tidemark.operators import candidates as C
from tidemark.operators import simulate as Z


def bank_of(rng, n, dims=12):
    centres = rng.normal(size=(9, dims))
    market = (centres[rng.integers(0, 9, n)] + rng.normal(0, 0.4, (n, dims))).round(2)
    own = np.stack([rng.integers(-1, 2, n), rng.integers(-24, 25, n) / 512], axis=1)
    states = np.concatenate([market, own], axis=1).astype(np.float32)
    states[n // 2 : n // 2 + 40] = states[7]  # ties
    return states


def ticks_of(rng, n, dims=12):
    """Slow dimensions change every sixth tick, the others at each."""
    market = rng.normal(size=(n, dims)).round(2)
    market[:, 4:] = market[np.arange(n) // 6 * 6][:, 4:]
    return market.astype(np.float32)


@pytest.mark.parametrize("few", [False, True])
def test_candidates_hold_the_nearest_for_every_portfolio(monkeypatch, few):
    if few:
        monkeypatch.setattr(C, "RUNS", 2)
        monkeypatch.setattr(C, "PILOT", 0.0)
    rng = np.random.default_rng(0)
    states, market = bank_of(rng, 5000), ticks_of(rng, 60)
    market[30] = states[7, :-2]  # a state of the bank
    market[40:50] = market[40]
    market[55:] *= 100
    found = C.Candidates(states, 25, 0.05).of(market)
    assert (few or np.mean([len(f) for f in found[:30]]) < 500) and all((np.diff(f) > 0).all() for f in found)
    for m, f in zip(market, found):
        for side, gain in ((0, 0.0), (1, 0.05), (1, -0.05), (1, 0.01), (-1, 0.05), (-1, -0.02)):
            y = np.concatenate([m, np.array([side, gain], dtype=np.float32)]).astype(float)
            d = ((states.astype(float) - y) ** 2).sum(1)
            assert np.isin(np.lexsort((np.arange(len(d)), d))[:25], f).all()


def test_a_small_bank_is_all_candidates():
    states = bank_of(np.random.default_rng(1), 90)
    assert [len(f) for f in C.Candidates(states, 25, 0.05).of(np.zeros((3, 12)))] == [90] * 3
    assert [len(f) for f in C.Candidates(states[:0], 25, 0.05).of(np.zeros((2, 12)))] == [0] * 2


def test_looks_are_those_of_the_whole_bank():
    rng = np.random.default_rng(2)
    states, market = bank_of(rng, 3000), ticks_of(rng, 40)
    returns = rng.normal(size=3000)
    returns[::7] = np.nan
    bank = Z.BankPolicy(states, rng.integers(-1, 4, 3000), returns)
    y = np.concatenate([market, np.tile([[1.0, -0.01]], (40, 1)).astype(np.float32)], axis=1)
    for state, got in zip(y, bank.looks(y, bank.candidates(market))):
        want = bank.look(state)
        assert got.vote.tolist() == want.vote.tolist()
        assert [got.margin, got.ret_mean, got.ret_std] == pytest.approx([want.margin, want.ret_mean, want.ret_std])


def test_the_fold_searches_no_whole_bank_at_each_tick(spark):
    rng = np.random.default_rng(3)
    states, market = bank_of(rng, 4000), ticks_of(rng, 700)
    actions, returns = rng.integers(0, 4, 4000), rng.normal(size=4000)
    price = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 700)))
    atr = np.where(np.arange(700) % 50 == 0, 3.0, 0.0)

    class Told(Z.Memory):
        def policy(self):
            class Narrow(Z.BankPolicy):
                def look(self, *a, **kw):
                    raise AssertionError("a search of the whole bank")

            self.made = self.made or Narrow(states, actions, returns, self.k, self.cfg)
            return self.made

    rows = [(s, t, float(price[t]), float(atr[t]), [*map(float, market[t]), 0.0, 0.0]) for s in ("a", "b") for t in range(700)]
    df = spark.createDataFrame(rows, "series string, tick bigint, Close double, ATR_Scaled double, state array<float>")
    trace = Z.fold(df, "series", Told(None, DEFAULT.k, DEFAULT)).toPandas()
    plain, seen = Z.BankPolicy(states, actions, returns), []

    def vote(state, mask):
        seen.append(plain.look(state).vote.tolist())
        return plain.choose(plain.look(state), mask)

    for _, got in trace.groupby("series"):
        p = Z.Position()
        for r in got.sort_values("tick").itertuples():
            seen.clear()
            p, want = Z.advance(p, r.tick, float(price[r.tick]), float(atr[r.tick]), np.concatenate([market[r.tick], [0, 0]]), vote)
            assert r.action == want["action"] and r.pnl == want["pnl"] and (not seen or list(r.vote) == seen[0])
    assert trace["side"].notna().any() and (trace["pnl"] != 0).any()
