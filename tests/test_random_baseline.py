import os

import numpy as np
import pytest

from tidemark import analytics as A

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
def test_every_series_has_a_baseline_of_1000_trials_of_500_trades(spark):
    got = A.QUERIES["random_baseline"](spark, DIR).toPandas().set_index("series")
    assert got.equals(A.QUERIES["random_baseline"](spark, DIR).toPandas().set_index("series").loc[got.index])
    prices = A._series(spark, DIR).toPandas()
    assert set(got.index) == set(prices["series"])
    for series, rows in prices.groupby("series"):
        c = rows.sort_values("tick")["Close"].to_numpy()
        at = np.arange(max(1, len(c) - 33))
        pnl = np.array([[s * (c[np.minimum(at + h, len(c) - 1)] * (1 - s * 0.00015) / (c[at] * (1 + s * 0.00015)) - 1) for h in range(1, 33)] for s in (-1, 1)])
        mean, std = 500 * pnl.mean(), np.sqrt(500) * pnl.std()  # of a trial, over all equally likely trades
        assert abs(got.loc[series, "mean"] - mean) < 6 * std / np.sqrt(1000) + 1e-12
        assert 0.85 * std - 1e-12 <= got.loc[series, "std"] <= 1.15 * std + 1e-12
