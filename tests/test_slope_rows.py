import numpy as np

from tidemark import analytics as A

DIR = "/root/testdata/sf0.01"


def test_every_tick_has_its_slope(spark):
    got = A.QUERIES["rolling_slope_all"](spark, DIR).toPandas().set_index(["series", "tick"])["slope"]
    f = A._features(spark, DIR).toPandas().sort_values(["series", "tick"])
    assert len(got) == len(f)
    for series, rows in f.groupby("series"):
        x = rows["RSI_Scaled"].to_numpy(dtype=float)
        for t in range(len(x)):
            w = x[max(0, t - 7) : t + 1]
            assert abs(got[series, t] - (w[-1] - w.mean()) / (w.std() + 1e-6)) < 1e-5, (series, t, np.ptp(w))
