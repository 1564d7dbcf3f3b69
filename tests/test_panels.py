"""Panels of the diagnostics that follow from trades joined to their series, and from the trace (sf0.01: the smallest data has no trace)."""

from collections import Counter

import pytest

from tidemark.queries import QUERIES

DIR = "/root/testdata/sf0.01"


def rows(spark, name):
    return [r.asDict() for r in QUERIES[name](spark, DIR).collect()]


def test_trades_by_regime_hour_and_outcome(spark):
    regimes = rows(spark, "win_rate_by_regime")
    assert {r["regime"] for r in regimes} <= {"trending_up", "trending_down", "ranging", "high_vol", "low_vol"} and len(regimes) > 1
    assert all(r["n"] >= 3 and 0 <= r["win_rate"] <= 1 for r in regimes)
    hours = rows(spark, "win_rate_by_entry_hour")
    trades = spark.read.parquet(f"{DIR}/trades.parquet")
    assert 0 < sum(r["n"] for r in hours) <= trades.filter("win is not null").count()
    assert len(hours) > 1 and all(0 <= r["hour"] < 24 and 0 <= r["win_rate"] <= 1 for r in hours)
    margins = rows(spark, "entry_margin_histogram")
    assert {r["won"] for r in margins} == {True, False} and len(margins) == 40
    assert all(r["price_min"] <= r["price_max"] for r in rows(spark, "price_range"))


def test_trace_by_regime_action_and_best_vote(spark):
    actions = Counter(r["action"] for r in rows(spark, "position_trace"))
    got = Counter()
    for r in rows(spark, "conviction_by_action"):
        got[r["action"]] += r["n"]
    assert got == actions
    for r in rows(spark, "regime_decisions"):
        assert r["n"] >= 10 and sum(r[f"share_{a}"] for a in range(4)) == pytest.approx(1)
        assert r["n"] == 10 or 0.25 <= r["conviction_least"] <= r["conviction_most"] <= 1 and r["entropy_most"] <= 2 + 1e-6
    confusion, seen = rows(spark, "policy_confusion"), Counter()
    for r in confusion:
        seen[r["action"]] += r["n"]
    assert seen == actions
    agree = sum(r["n"] for r in confusion if r["action"] == r["best_vote"])
    assert confusion[0]["match_rate"] == pytest.approx(agree / sum(actions.values()))
