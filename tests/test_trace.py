"""The registered trace against a plain sequential fold with the vote of the whole memory bank."""

import os

import numpy as np
import pytest

from tidemark import analytics as A
from tidemark.operators import features as W
from tidemark.operators import simulate as Z
from tidemark.storage import table

DIR = "/root/testdata/sf0.01"  # the series of the smallest data end within the warm-up


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_trace_votes_over_the_memory_bank(spark):
    b = table(spark, DIR, "memory_bank").toPandas().sort_values("row_id")
    b = b[b["state"].map(lambda s: s is not None and len(s) == 50 and not np.isnan(np.array(s, dtype=float)).any())]
    x, act, ret = np.stack(b["state"].to_numpy()).astype(float), b["action"].to_numpy(dtype=float), b["mc_return"].to_numpy(dtype=float)

    def vote(state, mask):
        d = np.sqrt(((x - state.astype(float)) ** 2).sum(1))
        near = np.argsort(d, kind="stable")[:25]
        w = 1 / (d[near] + 1e-3)
        w = np.minimum(w, 50 * (np.median(w) + 1e-8))
        v = np.array([sum(wi * ret[i] for wi, i in zip(w, near) if act[i] == a and np.isfinite(ret[i])) for a in range(4)])
        return int(np.where(mask, v, -np.inf).argmax()), np.zeros(4)

    trace = A.QUERIES["position_trace"](spark, DIR).toPandas()
    assert trace["action"].nunique() > 1
    f = A._features(spark, DIR)
    states = W.open_loop_state(f).join(f.select("series", "tick", "Close", "ATR_Scaled"), ["series", "tick"]).toPandas().dropna(subset=["state", "Close"])
    assert len(states) == len(trace)
    for series, rows in states.groupby("series"):
        p, want = Z.Position(), []
        for r in rows.sort_values("tick").itertuples():
            p, out = Z.advance(p, r.tick, r.Close, r.ATR_Scaled, np.asarray(r.state, dtype=float), vote)
            want.append(out["action"])
        assert trace[trace["series"] == series].sort_values("tick")["action"].tolist() == want
    neighbours = Z.bank_policy(np.array([[0.0]] * 40 + [[9.0]]), np.array([1] * 25 + [0] * 16), np.ones(41))
    assert neighbours(np.array([0.0]), np.array([True] * 4))[0] == 1  # of equal states the first
