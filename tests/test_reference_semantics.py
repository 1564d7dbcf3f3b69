"""Golden values derived by hand from the stated formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, FEATURES
from tidemark.functions import scalars as S
from tidemark.operators import diagnostics as D
from tidemark.operators import features as W
from tidemark.operators import knn as K
from tidemark.operators import returns as R
from tidemark.operators import simulate as Z
from tidemark.plans.blocks import next_rank, ranked, running


def test_discounted_returns(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.0), (1, 2, 2.0)], "e bigint, i bigint, r double")
    got = [r["mc_return"] for r in R.discounted_returns(df, "e", "i", "r").orderBy("i").collect()]
    assert got == pytest.approx([2.8818, 1.94, 2.0])


def test_discounted_returns_without_discount_and_with_gaps(spark):
    from dataclasses import replace

    df = spark.createDataFrame([(1, i, 1.0) for i in (0, 1, 5, 900, 901)], "e bigint, i bigint, r double")
    assert [x["g"] for x in R.discounted_returns(df, "e", "i", "r", "g", replace(DEFAULT, gamma=1.0), rows=4).orderBy("i").collect()] == [5, 4, 3, 2, 1]
    got = [x["g"] for x in R.discounted_returns(df, "e", "i", "r", "g", rows=4).orderBy("i").collect()]
    assert got == pytest.approx([sum(0.97 ** (j - i) for j in (0, 1, 5, 900, 901) if j >= i) for i in (0, 1, 5, 900, 901)])


def test_discounted_returns_of_long_episodes(spark):
    n = 40_000
    r = np.random.default_rng(0).normal(size=n)
    want = np.zeros(n)
    g = 0.0
    for i in range(n - 1, -1, -1):
        want[i] = g = r[i] + 0.97 * g
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(r)], "e bigint, i bigint, r double")
    got = np.array([x["mc_return"] for x in R.discounted_returns(df, "e", "i", "r").orderBy("i").collect()])
    assert np.abs(got - want).max() < 1e-9


BANK = "row_id bigint, episode_id bigint, tick bigint, action bigint, mc_return float, state array<float>"


def bank(spark, states, actions, returns):
    return spark.createDataFrame([(i, 0, i, a, float(r), [float(s)]) for i, (s, a, r) in enumerate(zip(states, actions, returns))], BANK)


@pytest.mark.parametrize("mask, action, shares, margin", [(None, 1, [0, 0.500166, 0.249917, 0.249917], 1.998668), ([True, True, False, True], 1, [0, 0.666815, 0, 0.333185], 1.998668), ([False, False, True, True], 2, [0, 0, 0.5, 0.5], 0)])
def test_vote(spark, mask, action, shares, margin):
    b = bank(spark, [0, 1, 2, 4], [0, 0, 1, 3], [1, -2, 3, 0.5])
    q = spark.createDataFrame([(99, None, None, 0, 0.0, [0.5])], BANK)
    v = K.votes(K.neighbour_weights(K.knn(q, b, k=3), b), F.array(*[F.lit(m) for m in mask]) if mask else None).first()
    assert v["action"] == action and v["margin"] == pytest.approx(margin, abs=1e-5)
    assert v["shares"] == pytest.approx(shares, abs=1e-5) and sum(v["shares"]) == pytest.approx(1)
    assert v["vote"] == pytest.approx([-1.996008, 1.998668, 0, 0], abs=1e-5)
    policy = Z.bank_policy(np.array([[0.0], [1], [2], [4]]), np.array([0, 0, 1, 3]), np.array([1, -2, 3, 0.5]), k=3)
    a, s = policy(np.array([0.5]), np.array(mask or [True] * 4))
    assert a == action and s == pytest.approx(shares, abs=1e-5)


def test_weight_cap(spark):
    b = bank(spark, [0, 3.3323, 3.4473, 3.5704, 3.7027], [0] * 5, [1.0] * 5)
    q = spark.createDataFrame([(99, None, None, 0, 0.0, [0.0])], BANK)
    w = [r["w"] for r in K.neighbour_weights(K.knn(q, b), b).orderBy("rank").collect()]
    assert w[0] == pytest.approx(50 * (w[2] + 1e-8))


def test_temporal_exclusion(spark):
    rows = [(t, 7, t, 0, 1.0, [float(t)]) for t in (200, 201, 300, 399, 400)] + [(1000, 8, 300, 0, 1.0, [300.0]), (1001, None, 300, 0, 1.0, [300.0])]
    b = spark.createDataFrame(rows, BANK)
    near = lambda ep, tick, gap=100, k=9: {r["bid"] for r in K.knn(spark.createDataFrame([(5000, ep, tick, 0, 0.0, [300.0])], BANK), b, k=k, min_tick_gap=gap).collect()}
    assert near(7, 300) == {200, 400, 1000, 1001}
    assert len(near(None, 300)) == len(near(7, None)) == len(near(7, 300, 0)) == 7
    only = b.filter("episode_id = 7 and row_id between 201 and 399")
    assert K.knn(spark.createDataFrame([(5000, 7, 300, 0, 0.0, [300.0])], BANK), only, min_tick_gap=100).count() == 3  # none left: all count
    assert K.knn(b, b.limit(0)).count() == 0
    n = lambda q, gap=100: {r["qid"]: r["excluded"] for r in K.excluded_counts(q, b, gap).collect()}
    q = spark.createDataFrame([(5000, 7, 300, 0, 0.0, [300.0]), (5001, None, 300, 0, 0.0, [1.0]), (5002, 9, 300, 0, 0.0, [1.0]), (5003, 7, -300, 0, 0.0, [1.0])], BANK)
    assert n(q) == {5000: 3, 5001: 0, 5002: 0, 5003: 0} and set(n(q, 0).values()) == {0}
    assert {r["excluded"] for r in K.excluded_counts(q.limit(1), only, 100).collect()} == {0}


def test_queries_from_the_bank_itself(spark):
    b = spark.createDataFrame([(i, 0, i, i % 4, float(i), [float(i), 0.0]) for i in range(12)] + [(50, 0, 1, 0, 1.0, [float("inf"), 0.0])], BANK)
    got = {(r["qid"], r["rank"]): (r["bid"], r["dist"]) for r in K.knn(b.filter("row_id % 3 = 0"), b, k=2).collect()}
    assert len(got) == 8 and all(got[i, 1] == (i, 0.0) for i in (0, 3, 6, 9)) and got[9, 2] == (8, 1.0)
    assert K.knn(b, b, k=1, self_excluded=True).count() == 12


def test_an_empty_bank_holds(spark):
    b = bank(spark, [0, 1], [0, 0], [1, -2])
    for mask in (None, F.array(F.lit(True), F.lit(True), F.lit(False), F.lit(False))):
        got = K.decide(b, b.limit(0), mask).collect()
        assert [(r["action"], r["shares"], r["margin"], r["vote"]) for r in got] == [(3, [0.0, 0.0, 0.0, 1.0], 0.0, [0.0] * 4)] * 2
    assert {r["action"] for r in K.decide(b, b, k=1).collect()} == {0, 1}


def test_positions():
    def always(action):
        return lambda state, mask: (action if mask[action] else 3, np.eye(4)[action])

    p, o = Z.advance(Z.Position(), 0, 100.0, 0.0, np.zeros(50), always(0))
    assert p.side == "LONG" and o["pnl"] == 0
    assert Z.settle(p, 110.0) == pytest.approx(0.0996700495)
    s, _ = Z.advance(Z.Position(), 0, 100.0, 0.0, np.zeros(50), always(1))
    assert Z.settle(s, 95.0) == pytest.approx(0.0497149572)
    assert Z.advance(p, 1, 98.5, 0.0, np.zeros(50), always(3))[1]["action"] == 2  # stop
    assert Z.advance(p, 1, 98.6, 0.0, np.zeros(50), always(3))[1]["action"] == 3
    assert Z.advance(p, 32, 100.0, 0.0, np.zeros(50), always(3))[1]["action"] == 2  # held too long
    assert Z.advance(p, 31, 100.0, 0.0, np.zeros(50), always(3))[1]["action"] == 3
    assert Z.advance(Z.Position(), 1, 100.0, 2.5, np.zeros(50), always(0))[1]["action"] == 3  # volatility gate
    assert Z.bank_policy(np.zeros((0, 50)), np.zeros(0), np.zeros(0))(np.zeros(50), np.array([True] * 4))[0] == 3


def test_scalars(spark):
    r = spark.range(1).select(S.shaped_reward(F.lit(0.01), F.lit(False), F.lit(False)).alias("a"), S.shaped_reward(F.lit(0.0), F.lit(True), F.lit(True)).alias("b"), S.shaped_reward(F.lit(0.001), F.lit(False), F.lit(False)).alias("c"),
                              S.entropy_bits(F.array(*[F.lit(0.25)] * 4)).alias("d"), S.euclidean(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("e"),
                              S.close_pnl(F.lit("LONG"), S.entry_price(F.lit("LONG"), F.lit(100.0)), F.lit(110.0)).alias("f"), S.argmax_first(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("g")).first()
    assert [r[x] for x in "abcdefg"] == pytest.approx([0.011, -0.000005, 0.001, 2.0, 5.0, 0.0996700495, 1], abs=1e-8)
    assert Z.next_epsilon(0) == 0.1 and Z.next_epsilon(100) == 0.01


def test_drawdown_runs_and_blocks(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([-0.02, 0.03, -0.01])], "e string, i bigint, p double")
    assert D.drawdown(df, "e", "i", "p").first()["max_drawdown"] == pytest.approx(-0.01)
    acts = spark.createDataFrame([(1, i, a) for i, a in enumerate([3, 3, 0, 3, 1, 3, 3])], "e bigint, t bigint, a bigint")
    assert [r["n"] for r in D.code_runs(acts, "e", "t", "a", 3).orderBy("start").collect()] == [2, 1]
    x = np.random.default_rng(0).normal(size=500)
    long = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "e string, i bigint, p double")
    got = [r["c"] for r in running(running(long, "e", "i", "p", "sum", "s", rows=32), "e", "i", "s", "max", "c", rows=32).orderBy("i").collect()]
    assert got == pytest.approx(list(np.maximum.accumulate(np.cumsum(x))))
    far = spark.createDataFrame([("a", i) for i in (0, 3, 40, 41, 300)], "e string, i bigint")
    assert [r["n"] for r in next_rank(far, "e", "i", "n", rows=32).orderBy("i").collect()] == [3, 40, 41, 300, None]
    back = ranked(long.withColumn("b", F.expr("i div 7")), "e", "i", "b", "r")
    assert back.filter("r <> i").count() == 0


def sequential_states(x):
    """Histories as rings, row by row."""
    paces, h = DEFAULT.paces, DEFAULT.history
    hist = {p: [x[128 - (h - j) * p] if 128 - (h - j) * p >= 0 else np.zeros(6) for j in range(h)] for p in paces}
    out = {}
    for t in range(129, len(x)):
        for p in paces:
            if (t - 128) % p == 0:
                hist[p] = hist[p][1:] + [x[t]]
        parts = []
        for p in paces:
            a = np.array(hist[p])
            parts += [a[-1], (a[-1] - a.mean(0)) / (a.std(0) + 1e-6)]
        out[t] = np.concatenate([*parts, [0, 0]])
    return out


def test_open_loop_states(spark):
    x = np.random.default_rng(5).normal(size=(700, 6)).astype(np.float32)
    rows = [("s", i, 1.0, *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "series string, tick bigint, Close double, " + ", ".join(f"{c} float" for c in FEATURES))
    got = {r["tick"]: np.array(r["state"]) for r in W.open_loop_state(df).collect()}
    want = sequential_states(x.astype(float))
    assert got.keys() == want.keys()
    assert max(np.abs(got[t] - want[t]).max() for t in got) < 1e-4
    early = {r["tick"]: np.array(r["state"]) for r in W.open_loop_state(df.filter("tick <= 300")).collect()}
    assert all(np.array_equal(early[t], got[t]) for t in early)  # nothing later is seen
    assert len(got[129]) == DEFAULT.state_dim


def test_slope_of_eight(spark):
    df = spark.createDataFrame([("s", i, float(i + 1)) for i in range(8)], "series string, tick bigint, x double")
    assert W.slopes(df, ["x"]).filter("tick = 7").first()["x_slope"] == pytest.approx(1.527525, abs=1e-5)


def test_prune(spark):
    b = spark.createDataFrame([(i, 0, i, 3, 1.0 if i < 8 else 0.0, [0.0]) for i in range(10)], BANK)
    kept = [r["mc_return"] for r in R.prune(b, 6).collect()]
    assert len(kept) == 6 and sum(x > 0 for x in kept) == 4
    assert R.prune(b, 20).count() == 10
    assert R.append(b, b.limit(3)).count() == 13


def test_bank_round_trip(spark, tmp_path):
    b = spark.createDataFrame([(1, 0, 5, 3, 1.0, [0.0])], BANK)
    R.save_bank(b, str(tmp_path / "b"), {"k": 25})
    rows, conf = R.load_bank(spark, str(tmp_path / "b"))
    assert rows.collect() == b.collect() and conf["k"] == 25 and conf["eps_dist"] == 1e-3 and conf["n_prunes"] is None
    none, conf = R.load_bank(spark, str(tmp_path / "nothing"))
    assert none.count() == 0 and conf["max_weight_ratio"] == 50.0
    b.drop("tick", "episode_id").write.parquet(str(tmp_path / "old/rows"))
    spark.createDataFrame([(25,)], "k bigint").write.parquet(str(tmp_path / "old/config"))
    old, conf = R.load_bank(spark, str(tmp_path / "old"))
    assert conf == {"k": 25, "eps_dist": 1e-3, "max_weight_ratio": 50.0, "min_tick_gap": 0, "next_episode_id": 0}
    assert (old.first()["tick"], old.first()["episode_id"]) == (0, -1)


def test_selection():
    up = lambda s, epoch, gain, short=0.5, long=0.3, vshort=0.3, bear=0.0: s.update(epoch, short, gain, long, vshort, bear)
    s, save, stop = up(Z.Selection(), 1, -0.5)
    assert save and not stop and s.best == -0.5  # anything beats nothing
    s2, save, stop = up(s, 1, -0.497)
    assert not save and not stop and s2.stale == 1  # less than the least improvement; warm-up goes on
    assert up(s, 2, -0.497)[2]  # the first epoch after warm-up with nothing better stops
    assert not up(s, 2, 0.1)[2] and up(s, 2, 0.1)[1]
    assert not up(s, 1, 0.5, vshort=0.02)[1] and not up(s, 1, 0.5, long=0.02)[1] and not up(s, 1, 0.5, bear=-0.10)[1] and up(s, 1, 0.5, bear=-0.09)[1]
    assert up(s, 3, 0.5, short=0.02) == (s, False, True) and not up(s, 2, 0.5, short=0.02)[2]


def test_empty_tables(spark):
    t = spark.createDataFrame([], "side string, pnl double, duration int, win boolean, c double, episode_id bigint, i bigint")
    assert D.trade_summary(t, ["side"]).count() == 0 and D.histogram(t, "pnl", 5).count() == 0 and D.quantile_groups(t, "c", "win").count() == 0
    assert D.drawdown(t, "episode_id", "i", "pnl").count() == 0
    b = spark.createDataFrame([], BANK)
    assert K.knn(b, b).count() == 0 and R.prune(b, 5).count() == 0
