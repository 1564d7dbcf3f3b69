"""What the queries on the trace ask of it, and how far the bank is searched."""

import numpy as np

from tidemark import analytics as A
from tidemark.operators import candidates as C
from tidemark.operators import simulate as Z


class Asked(Exception):
    pass


def asked(monkeypatch, name, spark=None):
    def trace(spark, d, *keep):
        raise Asked(keep)

    monkeypatch.setattr(A, "_trace", trace)
    try:
        A.QUERIES[name](spark, "")
    except Asked as e:
        return e.args[0]


def test_confusion_asks_for_two_columns(monkeypatch):
    assert asked(monkeypatch, "policy_confusion") == ("action", "vote")


def test_confusion_runs_the_trace_once(spark, monkeypatch):
    rows = [("a", i % 4, [0.0, 1.0, 0.5, 0.2]) for i in range(40)]
    trace = spark.createDataFrame(rows, "series string, action int, vote array<double>").groupBy("series").applyInPandas(lambda x: x, "series string, action int, vote array<double>")
    monkeypatch.setattr(A, "_trace", lambda spark, d, *keep: trace)
    q = A.QUERIES["policy_confusion"](spark, "")
    assert q._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInPandas") < 2
    assert {(r["action"], r["best_vote"], r["n"], r["match_rate"]) for r in q.collect()} == {(a, 1, 10, 0.25) for a in range(4)}


def test_regime_decisions_ask_for_three_columns(spark, monkeypatch):
    monkeypatch.setattr(A, "_features", lambda spark, d: spark.range(0).selectExpr("'a' as series", "id as tick"))
    monkeypatch.setattr(A.D, "with_regimes", lambda f: f.selectExpr("*", "0 as regime"))
    assert asked(monkeypatch, "regime_decisions", spark) == ("tick", "action", "shares")


def test_trades_ask_for_the_columns_of_a_trade(monkeypatch):
    assert asked(monkeypatch, "trace_trades") == ("tick", "price", "action", "pnl", "side", "entry", "entry_tick")


def test_metrics_ask_for_two_columns(monkeypatch):
    assert asked(monkeypatch, "trace_metrics") == ("action", "pnl")


def test_cells_of_the_changing_dimensions_narrow_the_search(monkeypatch):
    rng = np.random.default_rng(4)
    fast = rng.normal(size=(16, 4))[rng.integers(0, 16, 9001)] * 3 + rng.normal(0, 0.1, (9001, 4))
    states = np.concatenate([fast, rng.normal(size=(9001, 8)), np.zeros((9001, 2))], axis=1).astype(np.float32)
    market = np.repeat(states[:4, :-2], 6, axis=0)
    market[:, :4] += rng.normal(0, 0.1, (24, 4)).astype(np.float32)
    c, rows, over = C.Candidates(states, 25, 0.05), [], C.Candidates._over
    monkeypatch.setattr(C.Candidates, "_over", staticmethod(lambda part, r, *a: rows.append(len(r)) or over(part, r, *a)))
    found = c.of(market)
    assert len(rows) and sum(rows) < 0.2 * 9001 * len(c.runs(market))
    for m, f in zip(market, found):
        d = ((states[:, :-2].astype(float) - m) ** 2).sum(1)
        assert np.isin(np.lexsort((np.arange(9001), d))[:25], f).all()


def test_words_of_a_mask():
    for mask in (np.zeros(64, dtype=bool), np.ones(24, dtype=bool), np.random.default_rng(0).random(4096) < 0.02):
        assert C._where(mask).tolist() == np.flatnonzero(mask).tolist()


def test_kept_columns_are_those_of_the_whole_trace(spark):
    rng = np.random.default_rng(5)
    states, market = rng.normal(size=(900, 8)).astype(np.float32), rng.normal(size=(60, 6)).astype(np.float32)
    bank = Z.BankPolicy(states, rng.integers(0, 4, 900), rng.normal(size=900))

    class Told(Z.Memory):
        def policy(self):
            return bank

    rows = [("a", t, 100.0 + t % 7, 0.0, [*map(float, market[t]), 0.0, 0.0]) for t in range(60)]
    df = spark.createDataFrame(rows, "series string, tick bigint, Close double, ATR_Scaled double, state array<float>")
    policy = Told(None, 25, Z.DEFAULT)
    whole = Z.fold(df, "series", policy).toPandas().sort_values("tick")
    few = Z.fold(df, "series", policy, keep=("tick", "action", "pnl", "vote")).toPandas().sort_values("tick")
    assert list(few) == ["series", "tick", "action", "pnl", "vote"]
    for c in few:
        assert list(map(repr, few[c])) == list(map(repr, whole[c]))


def test_states_in_memory_are_those_of_the_tables(spark):
    from tidemark.config import DEFAULT, FEATURES
    from tidemark.operators import features as W

    rng = np.random.default_rng(6)
    sizes = {"none": 100, "one": 130, "some": 400}
    values = {s: np.round(rng.normal(size=(n, 6)), 3) for s, n in sizes.items()}
    values["some"][200:300, 2] = 0.5  # no spread
    rows = [(s, t, *map(float, v)) for s, x in values.items() for t, v in enumerate(x)]
    got = W.open_loop_state(spark.createDataFrame(rows, "series string, tick bigint, " + ", ".join(f"{c} double" for c in FEATURES))).toPandas()
    for s, x in values.items():
        want = got[got["series"] == s].sort_values("tick")
        mine = W.states_of(x)
        assert mine.dtype == np.float32 and len(mine) == len(want) == max(0, len(x) - DEFAULT.warmup - 1)
        if len(want):
            assert np.array_equal(mine, np.stack(want["state"].to_numpy()).astype(np.float32))
