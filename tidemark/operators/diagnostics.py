"""Datasets of the diagnostic panels: plain aggregates with the reference semantics stated.

Histograms, quantile groups and grids need a range first: a one-row aggregate joined
back, never a collected value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, EngineConfig
from tidemark.plans.blocks import neighbourhood, next_rank, running


def dense_counts(df: DataFrame, code: str, codes: int, by: list[str] | None = None) -> DataFrame:
    """Counts and shares of codes 0..codes-1, zeros included."""
    by = by or []
    counts = df.groupBy(*by).agg(*[F.count_if(F.col(code) == c).alias(f"_{c}") for c in range(codes)])
    total = reduce(lambda a, b: a + b, [F.col(f"_{c}") for c in range(codes)])
    long = counts.withColumn("_n", total).select(*by, "_n", F.explode(F.array(*[F.struct(F.lit(c).alias(code), F.col(f"_{c}").alias("n")) for c in range(codes)])).alias("x"))
    return long.select(*by, F.col(f"x.{code}").alias(code), F.col("x.n").alias("n"), F.when(F.col("_n") > 0, F.col("x.n") / F.col("_n")).alias("share"))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def histogram(df: DataFrame, value: str, bins: int, by: list[str] | None = None, density: bool = False) -> DataFrame:
    """Equal-width bins between the group's least and largest value; the last bin is closed. Bins without rows are listed.

    Where all values are equal the range is half a unit to either side. Null, NaN and infinite values are left out.
    """
    by = by or []
    v = df.select(*by, finite(F.col(value).cast("double")).alias("v")).filter("v is not null")
    edge = v.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("total"))
    edge = edge.withColumn("lo", F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("lo") + 0.5 == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))).filter("total > 0")
    joined = v.join(edge, by) if by else v.crossJoin(edge)  # one row
    at = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    counts = joined.groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))
    grid = edge.select(*by, "lo", "hi", "total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = grid.join(counts, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    width = (F.col("hi") - F.col("lo")) / bins
    cols = [*by, "bin", (F.col("lo") + width * F.col("bin")).alias("left"), "n"]
    return out.select(*cols, *([(F.col("n") / (F.col("total") * width)).alias("density")] if density else []))


def transition_matrix(df: DataFrame, by: str, rank: str, code: str) -> DataFrame:
    """Counts of successive codes within a group and their shares of the first code (+1e-9 against empty rows).

    ``rank`` counts the rows of a group from 0; codes aren't null.
    """
    near, w = neighbourhood(df.select(by, rank, code), by, rank, 0, 1)
    pairs = near.withColumn("to", F.lead(code).over(w)).filter("_own and to is not null").groupBy(F.col(code).alias("from"), "to").agg(F.count("*").alias("n"))
    return pairs.withColumn("share", F.col("n") / (F.sum("n").over(Window.partitionBy("from")) + 1e-9))


def code_runs(df: DataFrame, by: str, rank: str, code: str, wanted: int) -> DataFrame:
    """Lengths of runs of ``wanted`` within a group; a run that ends the group is left out.

    ``rank`` counts the rows of a group from 0; codes aren't null.
    """
    near, w = neighbourhood(df.select(by, rank, code), by, rank, 1)
    starts = near.withColumn("_p", F.lag(code).over(w)).filter(f"_own and (_p is null or _p <> {code})").select(by, rank, code)
    ends = next_rank(starts, by, rank, "_end")
    return ends.filter((F.col(code) == wanted) & F.col("_end").isNotNull()).select(by, F.col(rank).alias("start"), (F.col("_end") - F.col(rank)).alias("n"))


def confusion(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def grid_mean(df: DataFrame, x: str, y: str, value: str, bins: int, least: int = 5) -> DataFrame:
    """Mean of a value per cell of a grid over two columns; cells are half open, so the largest x or y falls out, and need more than ``least`` rows."""
    d = df.select(*[finite(F.col(c).cast("double")).alias(n) for c, n in ((x, "x"), (y, "y"), (value, "v"))]).dropna()
    r = d.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cell = lambda c: F.floor((F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0")) * bins).cast("int")
    cells = d.crossJoin(r).filter("x1 > x0 and y1 > y0").withColumn("xi", cell("x")).withColumn("yi", cell("y")).filter(f"xi < {bins} and yi < {bins}")
    return cells.groupBy("xi", "yi").agg(F.count("*").alias("n"), F.avg("v").alias("mean_value")).filter(f"n > {least}")


def fixed_groups(df: DataFrame, value: str, flag: str, edges: list[float]) -> DataFrame:
    """Share of a flag per half-open range of a value; values outside all ranges (also the upper end) count nowhere."""
    when = reduce(lambda acc, i: acc.when((F.col(value) >= edges[i]) & (F.col(value) < edges[i + 1]), i), range(1, len(edges) - 1), F.when((F.col(value) >= edges[0]) & (F.col(value) < edges[1]), 0))
    return df.withColumn("grp", when).filter("grp is not null").groupBy("grp").agg(F.count("*").alias("n"), F.avg(F.col(flag).cast("double")).alias("rate"))


def quantile_groups(df: DataFrame, value: str, flag: str, groups: int = 5) -> DataFrame:
    """Share of a flag per quantile group, closed on both sides: a row on an edge is in both groups."""
    d = df.filter(finite(F.col(value)).isNotNull() & F.col(flag).isNotNull())
    edges = d.agg(F.percentile(value, F.array(*[F.lit(i / groups) for i in range(groups + 1)])).alias("e"))
    x = d.crossJoin(edges).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    x = x.filter((F.col(value) >= F.col("e")[F.col("grp")]) & (F.col(value) <= F.col("e")[F.col("grp") + 1]))
    return x.groupBy("grp").agg(F.count("*").alias("n"), F.avg(F.col(flag).cast("double")).alias("rate"))


#: Fixed values: |mean deviation| of a trend, and the quantiles of volatility that bound low and high.
TREND, CALM, WILD = 0.1, 0.25, 0.75


def regime_labels(mean_dev: Column, atr: Column, low: Column, high: Column) -> Column:
    """All regimes of a row; they overlap. Thresholds of volatility are the quartiles of the table."""
    return F.array_compact(F.array(F.when((mean_dev > TREND) & (atr > 0), "trending_up"), F.when((mean_dev < -TREND) & (atr > 0), "trending_down"), F.when((mean_dev >= -TREND) & (mean_dev <= TREND), "ranging"),
                                   F.when(atr > high, "high_vol"), F.when(atr < low, "low_vol")))


def with_regimes(df: DataFrame, mean_dev: str = "MeanDev_Scaled", atr: str = "ATR_Scaled") -> DataFrame:
    q = df.agg(F.percentile(F.col(atr).cast("double"), F.array(F.lit(CALM), F.lit(WILD))).alias("_q"))
    labels = regime_labels(F.col(mean_dev).cast("double"), F.col(atr).cast("double"), F.col("_q")[0], F.col("_q")[1])
    return df.crossJoin(q).withColumn("regime", F.explode(labels)).drop("_q")  # one row


def describe(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    v = finite(F.col(value).cast("double"))
    q = lambda p: F.percentile(v, F.lit(p))
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("least"), q(0.25).alias("q25"), q(0.5).alias("median"), q(0.75).alias("q75"), F.max(v).alias("most"))


def trade_summary(trades: DataFrame, by: list[str], ticks: Column | None = None, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Trade statistics per group: win rate, gains, holding time, Sharpe ratio plain and per year (if ``ticks`` is given)."""
    pnl = finite(F.col("pnl"))
    out = trades.groupBy(*by).agg(F.count(pnl).alias("n"), F.sum(pnl).alias("total"), F.avg(pnl).alias("mean"), F.stddev_pop(pnl).alias("std"), F.percentile(pnl, F.lit(0.5)).alias("median"), F.max(pnl).alias("best"), F.min(pnl).alias("worst"),
                                  F.avg((pnl > 0).cast("double")).alias("win_rate"), F.percentile("duration", F.lit(0.5)).alias("median_hold"), *([F.max(ticks).alias("ticks")] if ticks is not None else []))
    ratio = F.when(F.col("std") > 0, F.col("mean") / F.col("std"))
    out = out.withColumn("sharpe", ratio * F.sqrt("n")).withColumn("hold_hours", F.col("median_hold") * cfg.candle_hours)
    if ticks is not None:
        per_day = F.col("n") / F.greatest(F.lit(1.0), F.col("ticks") / (24 / cfg.candle_hours))
        out = out.withColumn("sharpe_year", ratio * F.sqrt(cfg.days_per_year * per_day)).drop("ticks")
    return out


def drawdown(df: DataFrame, by: str, rank: str, pnl: str) -> DataFrame:
    """Deepest fall of the cumulative gain below its running peak; the peak starts at the first value, not at 0."""
    c = running(running(df, by, rank, pnl, "sum", "_c"), by, rank, "_c", "max", "_top")
    return c.groupBy(by).agg(F.min(F.col("_c") - F.col("_top")).alias("max_drawdown"))


def conviction_edge(trades: DataFrame, value: str, flag: str, gap: float = 0.03) -> DataFrame:
    """Win rate at and above the upper third of a value against below the lower third."""
    d = trades.filter(finite(F.col(value)).isNotNull() & F.col(flag).isNotNull())
    q = d.agg(F.percentile(value, F.array(F.lit(0.33), F.lit(0.66))).alias("q"))
    f = F.col(flag).cast("double")
    out = d.crossJoin(q).agg(F.avg(F.when(F.col(value) >= F.col("q")[1], f)).alias("top"), F.avg(F.when(F.col(value) < F.col("q")[0], f)).alias("bottom"))  # one row
    return out.withColumn("edge", F.col("top") - F.col("bottom")).withColumn("predictive", F.col("edge") > gap)


def profile(df: DataFrame, at: str, value: str, unit: str) -> DataFrame:
    """Mean of a value per hour of day or weekday (Monday 0), empty ones as 0."""
    n, code = {"hour": (24, F.hour(at)), "weekday": (7, F.weekday(at))}[unit]
    got = df.filter(F.col(at).isNotNull()).groupBy(code.alias(unit)).agg(F.count("*").alias("n"), F.avg(finite(F.col(value).cast("double"))).alias("mean_value"))
    units = df.sparkSession.range(n).select(F.col("id").cast("int").alias(unit))
    return units.join(got, unit, "left").select(unit, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_value", F.lit(0.0)).alias("mean_value"))


def correlation(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """Pearson correlation of rows with both values; 0 with fewer than two."""
    x, y = finite(F.col(a)), finite(F.col(b))
    both = x.isNotNull() & y.isNotNull()
    d = df.filter(both).groupBy(*by).agg(F.count("*").alias("n"), F.corr(a, b).alias("r"))
    return d.withColumn("r", F.when((F.col("n") < 2) | F.col("r").isNull() | F.isnan("r"), 0.0).otherwise(F.col("r")))


def summary(trades: DataFrame, conviction: str = "entry_conviction", cfg: EngineConfig = DEFAULT) -> DataFrame:
    """``metric, value`` of a trade list: outcomes, sides and conviction edge. Trades without a finite gain are left out."""
    t = trades.withColumn("pnl", finite(F.col("pnl"))).filter("pnl is not null").withColumn("side", F.upper("side")).withColumn("_c", finite(F.col(conviction)))
    q = t.agg(F.percentile("_c", F.array(F.lit(0.33), F.lit(0.66))).alias("_q"))
    won = (F.col("pnl") > 0).cast("double")
    std, side = F.stddev_pop("pnl"), lambda s, c: F.when(F.col("side") == s, c)
    top, low = F.avg(F.when(F.col("_c") >= F.col("_q")[1], won)), F.avg(F.when(F.col("_c") < F.col("_q")[0], won))
    metrics = {
        "trades": F.count("*").cast("double"), "win_rate": F.avg(won), "mean": F.avg("pnl"), "median": F.percentile("pnl", F.lit(0.5)), "std": std, "total": F.sum("pnl"), "best": F.max("pnl"), "worst": F.min("pnl"),
        "sharpe": F.when(std > 0, F.avg("pnl") / std * F.sqrt(F.count("*"))), "median_hold": F.percentile("duration", F.lit(0.5)), "hold_hours": F.percentile("duration", F.lit(0.5)) * cfg.candle_hours,
        **{f"{s.lower()}_{n}": f(s) for s in ("LONG", "SHORT") for n, f in (("trades", lambda s: F.count_if(F.col("side") == s).cast("double")), ("win_rate", lambda s: F.avg(side(s, won))), ("mean", lambda s: F.avg(side(s, F.col("pnl")))))},
        "conviction_over_50": F.avg((F.col("_c") > 0.5).cast("double")), "conviction_over_70": F.avg((F.col("_c") > 0.7).cast("double")), "top_win_rate": top, "bottom_win_rate": low, "conviction_edge": top - low,
    }
    one = t.crossJoin(q).agg(*[m.alias(n) for n, m in metrics.items()])  # one row
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics])).alias("x")).select("x.*")


def policy_health(trace: DataFrame) -> DataFrame:
    """One row of a trace with votes: conviction, entropy, agreement with the best vote, margin and neighbours' returns."""
    from tidemark.functions.scalars import argmax_first, entropy_bits

    c = F.array_max("shares")
    return trace.agg(F.count("*").alias("n"), F.avg(c).alias("conviction"), F.avg((c > 0.5).cast("double")).alias("over_50"), F.avg((c > 0.7).cast("double")).alias("over_70"), F.avg(entropy_bits(F.col("shares"))).alias("entropy"),
                     F.avg((argmax_first(F.col("vote")) == F.col("action")).cast("double")).alias("match_rate"), F.avg("margin").alias("margin"), F.avg("ret_mean").alias("ret_mean"), F.avg("ret_std").alias("ret_std"))
