import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.percentiles import percentiles, value_counts

SCHEMA = "g string, v double, piece int, value int, grp string, n int"


def table(spark, rows):
    return spark.createDataFrame([(g, v, p, 0, "x", 1) for g, v, p in rows], SCHEMA)


def test_exact_and_combined(spark):
    rng = np.random.default_rng(0)
    rows = [("hot", float(round(x, 1)), i % 7) for i, x in enumerate(rng.standard_t(2, 3000))] + [("b", float(i), i % 2) for i in range(10)] + [(None, 5.0, 0)]
    rows += [("b", math.nan, 0), ("b", None, 0), ("b", math.inf, 0), ("c", math.nan, 0)]
    df = table(spark, rows)
    for counts in (value_counts(df, "g", "v"), value_counts(df, "g", "v", F.col("piece"))):
        got = {(r["grp"], r["p"]): (r["value"], r["error_bound"], r["n"]) for r in percentiles(counts).collect()}
        assert len(got) == 9
        for g in ("hot", "b", None):
            x = [v for k, v, _ in rows if k == g and v is not None and math.isfinite(v)]
            for p in (0.5, 0.9, 0.99):
                assert got[g, p] == (np.quantile(x, p, method="inverted_cdf"), 0.0, len(x)), (g, p)
    days = [value_counts(df.filter(f"piece = {k}"), "g", "v") for k in range(7)]
    together = days[0]
    for d in days[1:]:
        together = together.unionByName(d)
    assert sorted(percentiles(together).collect(), key=str) == sorted(percentiles(value_counts(df, "g", "v")).collect(), key=str)


def test_bounded_error(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.lognormal(0, 3, 4000), -rng.lognormal(0, 2, 2000), np.zeros(500)])
    df = table(spark, [("a", float(v), 0) for v in x])
    counts = value_counts(df, "g", "v", rel_error=0.01)
    assert counts.count() < 2500
    for r in percentiles(counts, (0.05, 0.5, 0.9, 0.99), rel_error=0.01).collect():
        exact = np.quantile(x, r["p"], method="inverted_cdf")
        assert abs(r["value"] - exact) <= 0.01 * abs(exact) + 1e-12 and abs(r["value"] - exact) <= r["error_bound"] + 1e-12


def test_empty(spark):
    assert percentiles(value_counts(table(spark, []), "g", "v")).count() == 0


def test_the_bound_of_tiny_values_holds(spark):
    from tidemark.llm.percentiles import percentiles, value_counts

    values = [1e-35, -1e-33, 2e-31, 5e-30, 1.0, 3.0]
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    for p in (0.01, 0.2, 0.34, 0.5, 0.67, 0.84, 1.0):
        exact = percentiles(value_counts(df, "g", "v"), (p,)).first()["value"]
        r = percentiles(value_counts(df, "g", "v", rel_error=0.05), (p,), 0.05).first()
        assert abs(exact - r["value"]) <= r["error_bound"] and r["error_bound"] > 0, (p, exact, r)
