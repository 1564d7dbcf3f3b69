"""The training driver against a plain loop over the same rules."""

from dataclasses import replace

import numpy as np
import pytest

from tidemark.config import DEFAULT
from tidemark.operators import simulate as Z
from tidemark.operators.training import commit, epochs, transitions

BANK = "row_id bigint, episode_id bigint, tick bigint, action bigint, mc_return float, state array<float>"
CFG = replace(DEFAULT, k=3, min_tick_gap=5, bank_cap=1000)


def rows(rng, name, n):
    price = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    return [(name, t, float(price[t]), float(rng.normal()), [*map(float, rng.normal(size=4).round(2)), 0.0, 0.0]) for t in range(n)]


def small_bank(rng, n=60):
    return [(i, -1, 0, int(rng.integers(0, 4)), float(np.float32(rng.normal())), [*map(float, rng.normal(size=4).round(2)), float(rng.integers(-1, 2)), 0.0]) for i in range(n)]


STATES = "series string, tick bigint, Close double, ATR_Scaled double, state array<float>"


def test_trace_looks_without_a_mask_and_commits_returns(spark):
    rng = np.random.default_rng(1)
    bank = spark.createDataFrame(small_bank(rng), BANK)
    cfg = replace(CFG, features=("a", "b"), paces=(1,))  # states of six values
    assert cfg.state_dim == 6
    df = spark.createDataFrame(rows(rng, "s", 80), STATES)
    trace = Z.fold(df, "series", Z.memory_policy(bank, cfg=cfg), cfg).toPandas().sort_values("tick")
    b = bank.toPandas().sort_values("row_id")
    plain = Z.bank_policy(np.stack(b["state"].to_numpy()), b["action"].to_numpy(), b["mc_return"].to_numpy(dtype=float), 3, cfg)
    p = Z.Position()
    for r, x in zip(trace.itertuples(), df.toPandas().sort_values("tick").itertuples()):
        before = p
        p, want = Z.advance(p, x.tick, x.Close, x.ATR_Scaled, np.asarray(x.state, dtype=float), plain, cfg)
        state = np.array([*x.state[:4], {"LONG": 1.0, "SHORT": -1.0}.get(before.side, 0.0), want["unrealised"]], dtype=np.float32)
        look = plain.look(state)
        assert r.action == want["action"] and np.allclose(r.vote, look.vote) and r.margin == pytest.approx(look.margin) and r.ret_std == pytest.approx(look.ret_std)
        assert r.reward == pytest.approx(Z.shaped(want["pnl"], p.side, cfg))
    assert trace["side"].notna().any() and (trace["pnl"] != 0).any()
    out = transitions(spark.createDataFrame(trace[["series", "tick", "action", "reward", "state"]]), "series", cfg).orderBy("tick").toPandas()
    g, want = 0.0, []
    for r in trace["reward"].tolist()[:-1][::-1]:
        g = 100 * r + 0.97 * g
        want.append(g)
    assert len(out) == 79 and out["tick"].tolist() == list(range(79)) and np.allclose(out["mc_return"], want[::-1], rtol=1e-5, atol=1e-6)
    new = commit(bank, transitions(spark.createDataFrame(trace[["series", "tick", "action", "reward", "state"]]), "series", cfg), cfg=cfg)
    ids = sorted(r["row_id"] for r in new.select("row_id").collect())
    assert ids == list(range(60 + 79))
    assert commit(new, new.drop("row_id").limit(0), cfg=replace(cfg, bank_cap=50)).count() == 50


def test_exploration_is_reproducible_and_allowed(spark):
    rng = np.random.default_rng(2)
    cfg = replace(CFG, features=("a", "b"), paces=(1,))
    df = spark.createDataFrame(rows(rng, "s", 60) + rows(rng, "t", 60), STATES)
    bank = Z.memory_policy(spark.createDataFrame(small_bank(rng), BANK), cfg=cfg)
    one = Z.fold(df, "series", bank, cfg, 0.5, 3).orderBy("series", "tick").select("action").collect()
    two = Z.fold(df.repartition(5), "series", bank, cfg, 0.5, 3).orderBy("series", "tick").select("action").collect()
    other = Z.fold(df, "series", bank, cfg, 0.5, 4).orderBy("series", "tick").select("action").collect()
    assert one == two != other


def test_epochs_stop_by_the_selection(spark, tmp_path):
    rng = np.random.default_rng(3)
    cfg = replace(CFG, features=("a", "b"), paces=(1,), min_short_share=0.0, bear_floor=-100.0)
    train = spark.createDataFrame(rows(rng, "s", 60), STATES)
    valid = spark.createDataFrame([(*r, "val_2022") for r in rows(rng, "s", 40)] + [(*r, "val_2025") for r in rows(rng, "s", 40)], STATES + ", split string")
    got = [list(t.reports)[-1] | {"stopped": t.stopped} for t in epochs(train, valid, spark.createDataFrame(small_bank(rng), BANK), n=4, best_path=str(tmp_path / "best"), cfg=cfg)]
    assert got[0]["saved"] and got[0]["bank"] == 60 + 59 and (tmp_path / "best" / "rows").exists()
    assert len(got) == 4 or got[-1]["stopped"]
    assert [r["bank"] for r in got] == [60 + 59 * (i + 1) for i in range(len(got))]
    best = float("-inf")
    for r in got:
        assert r["saved"] == (r["val_pnl"] > best + cfg.min_improve)
        best = r["val_pnl"] if r["saved"] else best
