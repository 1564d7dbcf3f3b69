"""Queries of the time-series and bank operators over whole tables, each with its SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, FEATURES
from tidemark.functions import scalars as S
from tidemark.operators import diagnostics as D
from tidemark.operators import features as W
from tidemark.operators import knn as K
from tidemark.operators import returns as R
from tidemark.operators import simulate as Z
from tidemark.operators.timestamps import resolve_instants
from tidemark.plans.blocks import ranked, running
from tidemark.sources.candles import FIELDS, enough_rows, merge_master, parse_klines
from tidemark.storage import materialize, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


def _candles(spark, d) -> DataFrame:
    return table(spark, d, "klines").filter("series is not null and Open_time is not null and Close is not null and not isnan(Close) and abs(Close) < double('infinity') and Close > 0")


_CANDLES = """SELECT * FROM klines WHERE series IS NOT NULL AND Open_time IS NOT NULL AND "Close" IS NOT NULL AND isfinite("Close") AND "Close" > 0"""


def _series(spark, d) -> DataFrame:
    """One Close per series and moment (the first row), ranked in time: series, tick, Open_time, Close."""
    one = _candles(spark, d).groupBy("series", "Open_time").agg(F.min_by("Close", "row_id").alias("Close")).withColumn("_b", F.date_trunc("week", "Open_time"))
    return ranked(one, "series", "Open_time", "_b", "tick").drop("_b")


_SERIES = f"""SELECT series, Open_time, "Close", row_number() OVER (PARTITION BY series ORDER BY Open_time) - 1 AS tick
  FROM (SELECT series, Open_time, arg_min("Close", row_id) AS "Close" FROM ({_CANDLES}) GROUP BY ALL)"""


def _features(spark, d) -> DataFrame:
    return W.feature_table(table(spark, d, "master_processed"))


_F = ", ".join(f'"{c}"' for c in ("Close", *FEATURES))
_FEATURES = f"""SELECT series, row_number() OVER (PARTITION BY series ORDER BY tick) - 1 AS tick, {_F} FROM (
  SELECT * FROM master_processed WHERE series IS NOT NULL AND tick IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY series, tick ORDER BY row_id) = 1)
  WHERE {" AND ".join(f'"{c}" IS NOT NULL AND NOT isnan("{c}")' for c in ("Close", *FEATURES))}"""


@query("""SELECT row_id, Open_time, "Open", High, Low, "Close", Volume, Trades, Quote_volume, Taker_buy_base, Taker_buy_quote, Ignore,
  CASE WHEN regexp_full_match(trim(Close_time), '[0-9]{1,18}') THEN CAST(trim(Close_time) AS BIGINT) END AS Close_time FROM klines""")
def parse_payloads(spark, d):
    """S3: each candle as a JSON 12-tuple and back."""
    k = table(spark, d, "klines")
    text = {f: F.col(f).cast("string") for f in FIELDS} | {"Open_time": F.unix_millis(F.col("Open_time").cast("timestamp")).cast("string")}
    payload = k.select("row_id", F.to_json(F.array(F.array(*[text[f] for f in FIELDS]))).alias("payload"))
    out = parse_klines(payload, "payload", "row_id")
    return out.select("row_id", F.col("Open_time").cast("timestamp_ntz").alias("Open_time"), "Open", "High", "Low", "Close", "Volume", "Trades", "Quote_volume", "Taker_buy_base", "Taker_buy_quote", "Ignore", "Close_time")


@query(f"""WITH k AS (SELECT *, year(Open_time) AS y FROM klines), s AS (
  SELECT y, unnest(list_filter([CASE WHEN NOT coalesce(y IN (2022, 2025), false) THEN 'train' END, CASE WHEN y = 2022 THEN 'val_2022' END, CASE WHEN y = 2025 THEN 'val_2025' END,
    CASE WHEN y = 2022 THEN 'bear_2022' END, CASE WHEN y IN (2020, 2021, 2024) THEN 'bull_trend' END], lambda x: x IS NOT NULL)) AS split FROM k)
  SELECT split, y AS year, count(*) AS n FROM s GROUP BY ALL""")
def split_counts(spark, d):
    """Overlapping splits by year."""
    return W.with_splits(table(spark, d, "klines").select("Open_time"), "Open_time").groupBy("split", F.year("Open_time").cast("bigint").alias("year")).agg(F.count("*").alias("n"))


@query(f"""SELECT series, count(*) AS n, max(tick) AS last_tick, round(sum("Close"), 4) AS total FROM ({_FEATURES}) GROUP BY series""")
def complete_features(spark, d):
    """Projection, complete rows, renumbered ticks."""
    return rounded(_features(spark, d).groupBy("series").agg(F.count("*").alias("n"), F.max("tick").alias("last_tick"), F.sum("Close").alias("total")), 4, "total")


_OK = " AND ".join(f'"{c}" IS NOT NULL AND isfinite("{c}")' for c in ("Open", "High", "Low", "Close"))


@query(f"""SELECT series, time_bucket(INTERVAL 4 HOUR, Open_time) AS bar, arg_min("Open", (Open_time, row_id)) AS open, max(High) AS high, min(Low) AS low, arg_max("Close", (Open_time, row_id)) AS close, count(*) AS n
  FROM klines WHERE {_OK} AND Open_time IS NOT NULL GROUP BY ALL""")
def ohlc_4h(spark, d):
    """Bars of four hours."""
    return W.resample_ohlc(table(spark, d, "klines"), "Open_time", "4 hours").withColumn("bar", F.col("bar").cast("timestamp_ntz"))


@query(f"""WITH b AS (SELECT series, time_bucket(INTERVAL 4 HOUR, Open_time) AS bar, arg_min("Open", (Open_time, row_id)) AS open, max(High) AS high, min(Low) AS low, arg_max("Close", (Open_time, row_id)) AS close, count(*) AS n
  FROM klines WHERE {_OK} AND Open_time IS NOT NULL AND series IS NOT NULL GROUP BY ALL), g AS (SELECT series, unnest(generate_series(min(bar), max(bar), INTERVAL 4 HOUR)) AS bar FROM b GROUP BY series)
  SELECT g.series, g.bar, open, high, low, close, coalesce(n, 0) AS n FROM g LEFT JOIN b ON g.series = b.series AND g.bar = b.bar""")
def ohlc_4h_full(spark, d):
    """Bars of four hours, empty ones too."""
    return W.resample_ohlc(table(spark, d, "klines").filter("series is not null"), "Open_time", "4 hours", empty=True).withColumn("bar", F.col("bar").cast("timestamp_ntz"))


@query(f"""WITH r AS (SELECT series, abs("Close" / lag("Close") OVER (PARTITION BY series ORDER BY tick) - 1) AS r FROM ({_SERIES}))
  SELECT series, round(quantile_cont(r, 0.5), 9) AS median_move, count(r) AS n, round(0.0003 / nullif(quantile_cont(r, 0.5), 0), 4) AS commission_ratio FROM r GROUP BY series""")
def absolute_moves(spark, d):
    """Median absolute move per series against the commission of a round trip."""
    r = W.pct_change(_series(spark, d), "Close", "r")
    out = r.groupBy("series").agg(F.percentile(F.abs("r"), F.lit(0.5)).alias("m"), F.count("r").alias("n"))
    return out.select("series", F.round("m", 9).alias("median_move"), "n", F.round(0.0003 / F.when(F.col("m") != 0, F.col("m")), 4).alias("commission_ratio"))


def _lags(x: str, n: int, over: str) -> str:
    return ", ".join(f"lag({x}, {j}) OVER {over} AS l{j}" for j in range(n))


def _sum(terms) -> str:
    return " + ".join(terms)


_MEAN = f"(({_sum(f'coalesce(l{j}, 0)' for j in range(8))}) / ({_sum(f'(CASE WHEN l{j} IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)' for j in range(8))}))"
_SPREAD = f"sqrt(({_sum(f'(CASE WHEN l{j} IS NOT NULL THEN (l{j} - m) * (l{j} - m) ELSE 0 END)' for j in range(8))}) / ({_sum(f'(CASE WHEN l{j} IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)' for j in range(8))}))"


@query(f"""WITH w AS (SELECT series, tick, {_lags('CAST("RSI_Scaled" AS DOUBLE)', 8, "v")} FROM ({_FEATURES}) WINDOW v AS (PARTITION BY series ORDER BY tick)), m AS (SELECT *, {_MEAN} AS m FROM w)
  SELECT series, tick, round((l0 - m) / ({_SPREAD} + 1e-6), 4) + 0.0 AS slope FROM m""")
def rolling_slope(spark, d):
    """Slope of a feature over its last eight values, at every tick."""
    f = W.slopes(_features(spark, d).withColumn("x", F.col("RSI_Scaled").cast("double")), ["x"])
    return rounded(f.select("series", "tick", F.col("x_slope").alias("slope")), 4, "slope")


@query()
def rolling_slope_all(spark, d):
    """As rolling_slope, not rounded (no SQL: compared with a tolerance in the tests)."""
    f = W.slopes(_features(spark, d).withColumn("x", F.col("RSI_Scaled").cast("double")), ["x"])
    return f.select("series", "tick", F.col("x_slope").alias("slope"))


@query(f"""SELECT series, tick, CASE WHEN count(*) OVER w = 20 THEN round(avg("Close") OVER w / "Close", 8) END AS mean_20 FROM ({_SERIES})
  WINDOW w AS (PARTITION BY series ORDER BY tick ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")
def rolling_mean_full(spark, d):
    """Rolling mean of full windows, relative to the price."""
    m = W.rolling_mean(_series(spark, d), "Close", 20, "mean_20")
    return rounded(m.select("series", "tick", (F.col("mean_20") / F.col("Close")).alias("mean_20")), 8, "mean_20")


@query()
def open_loop_states(spark, d):
    """W1-W3, ST10: 50-dim states of all series (no SQL: checked against a sequential version in the tests)."""
    return W.open_loop_state(_features(spark, d))


_PACE = 6


@query(f"""WITH f AS ({_FEATURES}), s AS (SELECT series, tick, CAST("MACD_Scaled" AS DOUBLE) AS x FROM f WHERE tick > 128 AND (tick - 128) % {_PACE} = 0),
  w AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY tick) AS i FROM s)
  SELECT f.series, f.tick, round(w.x, 5) + 0.0 AS current FROM f JOIN w ON f.series = w.series AND w.i = (f.tick - 128) // {_PACE} WHERE f.tick >= 128 + {_PACE}""")
def pace_current(spark, d):
    """The last sample of pace 6 before each tick."""
    states = W.open_loop_state(_features(spark, d))
    at = 12  # behind current and slope of pace 1
    return rounded(states.filter(F.col("tick") >= 128 + _PACE).select("series", "tick", F.col("state")[at + 1].cast("double").alias("current")), 5, "current")


_STATES = " UNION ALL ".join(f"""SELECT series, {p} AS pace, CASE WHEN tick > 128 THEN (tick - 128) // {p} ELSE 1 - (128 - tick) // {p} END AS m, {", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in FEATURES)} FROM f
  WHERE (tick > 128 AND (tick - 128) % {p} = 0) OR (tick < 128 AND (128 - tick) % {p} = 0 AND 128 - tick <= 8 * {p})""" for p in DEFAULT.paces)
_LONG = " UNION ALL ".join(f'SELECT series, pace, m, {i} AS feature, "{c}" AS x FROM h' for i, c in enumerate(FEATURES))
_ZERO = ", ".join(f"coalesce(lag(x, {j}) OVER v, 0) AS l{j}" for j in range(8))


@query(f"""WITH f AS ({_FEATURES}), h AS ({_STATES}), x AS ({_LONG}), w AS (SELECT series, pace, m, feature, {_ZERO} FROM x WINDOW v AS (PARTITION BY series, pace, feature ORDER BY m)),
  a AS (SELECT *, ({_sum(f'l{j}' for j in range(8))}) / 8 AS mu FROM w), s AS (SELECT series, pace, m, feature, l0 AS x, (l0 - mu) / (sqrt(({_sum(f'(l{j} - mu) * (l{j} - mu)' for j in range(8))}) / 8) + 1e-6) AS slope FROM a),
  t AS (SELECT series, tick, p AS pace, i AS feature, (tick - 128) // p AS m FROM f, (VALUES (1), (6), (42), (90)) AS q(p), range(6) AS r(i) WHERE tick > 128)
  SELECT t.series, t.tick, CAST(t.pace AS INTEGER) AS pace, CAST(t.feature AS INTEGER) AS feature, round(CAST(CAST(coalesce(x, 0) AS FLOAT) AS DOUBLE), 5) + 0.0 AS current, round(CAST(CAST(coalesce(slope, 0) AS FLOAT) AS DOUBLE), 4) + 0.0 AS slope
  FROM t LEFT JOIN s ON t.series = s.series AND t.pace = s.pace AND t.feature = s.feature AND t.m = s.m""")
def pace_states(spark, d):
    """W1-W3, ST10: every pace and feature of every state: its last sample and slope."""
    n = len(FEATURES)
    parts = F.array(*[F.struct(F.lit(p).alias("pace"), F.lit(i).alias("feature"), F.col("state")[2 * n * j + i].alias("current"), F.col("state")[2 * n * j + n + i].alias("slope")) for j, p in enumerate(DEFAULT.paces) for i in range(n)])
    x = W.open_loop_state(_features(spark, d)).select("series", "tick", F.explode(parts).alias("x")).select("series", "tick", "x.pace", "x.feature", F.col("x.current").cast("double").alias("current"), F.col("x.slope").cast("double").alias("slope"))
    return rounded(rounded(x, 5, "current"), 4, "slope")


@query("""SELECT row_id FROM klines WHERE series IS NOT NULL AND Open_time IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY series, Open_time ORDER BY coalesce(ingest_time, TIMESTAMP '0001-01-01') DESC, row_id DESC) = 1""")
def master_rows(spark, d):
    """A master table (rows whose id is even) and new candles (the others) merged: the last delivery of each candle."""
    k = table(spark, d, "klines").select("row_id", "series", "Open_time", "ingest_time", "Close")
    return merge_master(k.filter("row_id % 2 = 0"), k.filter("row_id % 2 <> 0 or row_id is null")).select("row_id")


@query(f"""SELECT series, tick FROM ({_FEATURES}) QUALIFY count(*) OVER (PARTITION BY series) >= 130""")
def guarded_features(spark, d):
    """Complete rows of series that have rows enough."""
    return enough_rows(_features(spark, d)).select("series", "tick")


@query("""SELECT row_id, epoch_ms(Open_time) AS epoch_ms, strftime(Open_time, '%Y-%m-%d %H:%M') AS label, (epoch_ms(Open_time) // 60000) // 60 AS hours, (epoch_ms(Open_time) // 60000) % 60 AS minutes FROM klines WHERE Open_time IS NOT NULL""")
def time_parts(spark, d):
    """epoch, text and quotient with remainder of a moment."""
    t = table(spark, d, "klines").filter("Open_time is not null").select("row_id", F.unix_millis(F.col("Open_time").cast("timestamp")).alias("epoch_ms"), F.date_format("Open_time", "yyyy-MM-dd HH:mm").alias("label"))
    return t.select("*", F.expr("epoch_ms div 60000 div 60").alias("hours"), F.expr("epoch_ms div 60000 % 60").alias("minutes"))


@query("""SELECT CAST(e AS INTEGER) AS epoch, round(greatest(0.01, 0.1 * power(power(0.1, 1.0 / 20), e)), 12) AS epsilon FROM range(100) AS q(e)""")
def epsilon_schedule(spark, d):
    """chance of a random action by epoch."""
    from tidemark.operators.simulate import DEFAULT as C

    e = F.col("id").cast("int")
    return spark.range(C.epochs).select(e.alias("epoch"), F.round(S.decay(C.epsilon_start, C.epsilon_decay, C.epsilon_end, e), 12).alias("epsilon"))


# -- trades ---------------------------------------------------------------------------------------

_TRADES = "SELECT *, upper(side) AS s FROM trades"


def _trades(spark, d) -> DataFrame:
    return table(spark, d, "trades").withColumn("side", F.upper("side"))


_SUMMARY = """SELECT {by}, count(pnl) AS n, round(sum(pnl), 6) AS total, round(avg(pnl), 8) AS mean, round(stddev_pop(pnl), 8) AS std, round(quantile_cont(pnl, 0.5), 8) AS median, max(pnl) AS best, min(pnl) AS worst,
  round(avg(CAST(pnl > 0 AS INTEGER)), 8) AS win_rate, quantile_cont(duration, 0.5) AS median_hold, quantile_cont(duration, 0.5) * 4 AS hold_hours,
  round(CASE WHEN stddev_pop(pnl) > 0 THEN avg(pnl) / stddev_pop(pnl) END * sqrt(count(pnl)), 6) AS sharpe
  FROM (SELECT * REPLACE (CASE WHEN isfinite(pnl) THEN pnl END AS pnl, upper(side) AS side) FROM trades) GROUP BY {by}"""


def _summary(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, 8, "mean", "std", "median", "win_rate"), 6, "total", "sharpe")


@query(_SUMMARY.format(by="side"))
def per_side_stats(spark, d):
    """A7, A24, A25, A28, A30."""
    return _summary(D.trade_summary(_trades(spark, d), ["side"]))


@query(_SUMMARY.format(by="episode_id"))
def per_episode_stats(spark, d):
    """A7, A25, A38 per episode."""
    return _summary(D.trade_summary(_trades(spark, d), ["episode_id"]))


@query("""WITH t AS (SELECT episode_id, CASE WHEN isfinite(pnl) THEN pnl END AS pnl, exit_tick FROM trades), g AS (SELECT episode_id, count(pnl) AS n, avg(pnl) / nullif(stddev_pop(pnl), 0) AS r, max(exit_tick) AS ticks FROM t GROUP BY 1)
  SELECT episode_id, round(r * sqrt(252 * (n / greatest(1.0, ticks / 6.0))), 6) AS sharpe_year FROM g""")
def annual_sharpe(spark, d):
    """A26."""
    out = D.trade_summary(_trades(spark, d), ["episode_id"], F.col("exit_tick"))
    return rounded(out.select("episode_id", "sharpe_year"), 6, "sharpe_year")


_ORDERED = """SELECT episode_id, trade_id, pnl, exit_tick, row_number() OVER (PARTITION BY episode_id ORDER BY exit_tick, trade_id) - 1 AS i FROM trades WHERE pnl IS NOT NULL AND isfinite(pnl) AND exit_tick IS NOT NULL AND episode_id IS NOT NULL"""


def _ordered(spark, d) -> DataFrame:
    t = table(spark, d, "trades").filter("pnl is not null and not isnan(pnl) and abs(pnl) < double('infinity') and exit_tick is not null and episode_id is not null")
    t = t.withColumn("_o", F.struct("exit_tick", "trade_id")).withColumn("_b", F.expr("exit_tick div 2048"))
    return ranked(t, "episode_id", "_o", "_b", "i").drop("_o", "_b")


@query(f"""SELECT episode_id, trade_id, i, round(sum(pnl) OVER (PARTITION BY episode_id ORDER BY i), 8) + 0.0 AS curve FROM ({_ORDERED})""")
def pnl_curve(spark, d):
    """Cumulative gain by trade."""
    return rounded(running(_ordered(spark, d), "episode_id", "i", "pnl", "sum", "curve").select("episode_id", "trade_id", "i", "curve"), 8, "curve")


@query(f"""WITH c AS (SELECT episode_id, i, sum(pnl) OVER (PARTITION BY episode_id ORDER BY i) AS c FROM ({_ORDERED})), m AS (SELECT episode_id, c - max(c) OVER (PARTITION BY episode_id ORDER BY i) AS f FROM c)
  SELECT episode_id, round(min(f), 8) + 0.0 AS max_drawdown FROM m GROUP BY episode_id""")
def max_drawdown(spark, d):
    """A27, W7."""
    return rounded(D.drawdown(_ordered(spark, d), "episode_id", "i", "pnl"), 8, "max_drawdown")


_HIST = """WITH v AS (SELECT {cols} v FROM {src} WHERE v IS NOT NULL AND isfinite(v)), e AS (SELECT {by} min(v) AS lo, max(v) AS hi, count(*) AS total FROM v {grp}), g AS (SELECT e.*, b AS bin FROM e, range({n}) AS q(b)),
  c AS (SELECT {vby} least(floor((v - lo) / (hi - lo) * {n}), {n} - 1) AS bin, count(*) AS n FROM v {join} GROUP BY ALL)
  SELECT {gby} CAST(g.bin AS INTEGER) AS bin, round(lo + (hi - lo) / {n} * g.bin, 9) + 0.0 AS left, coalesce(c.n, 0) AS n{dens} FROM g LEFT JOIN c ON g.bin = c.bin {on}"""


@query(_HIST.format(cols="upper(side) AS side,", src="(SELECT *, pnl AS v FROM trades)", by="side,", grp="GROUP BY side", n=25, vby="v.side,", join="JOIN e ON v.side = e.side", gby="g.side,", on="AND g.side = c.side WHERE g.side IS NOT NULL", dens=""))
def pnl_histogram(spark, d):
    """A10, panels 4.1 and 4.6."""
    return rounded(D.histogram(_trades(spark, d).filter("side is not null"), "pnl", 25, ["side"]), 9, "left")


@query(_HIST.format(cols="", src="(SELECT *, entry_conviction AS v FROM trades)", by="", grp="", n=40, vby="", join="CROSS JOIN e", gby="", on="", dens=", round(coalesce(c.n, 0) / (total * ((hi - lo) / 40)), 7) + 0.0 AS density"))
def conviction_density(spark, d):
    """A11, panel 7.6."""
    return rounded(rounded(D.histogram(table(spark, d, "trades"), "entry_conviction", 40, density=True), 9, "left"), 7, "density")


@query("""WITH t AS (SELECT CAST(floor(entry_conviction * 5) AS INTEGER) AS grp, CAST(win AS INTEGER) AS w FROM trades WHERE entry_conviction >= 0 AND entry_conviction < 1 AND isfinite(entry_conviction))
  SELECT grp, count(*) AS n, round(avg(w), 8) AS rate FROM t GROUP BY grp""")
def win_rate_by_fifth(spark, d):
    """Fixed fifths; a conviction of exactly 1 is in none."""
    t = table(spark, d, "trades")
    fifth = F.floor(F.col("entry_conviction") * 5) / 5  # the same edges on both sides, whatever their rounding
    return rounded(D.fixed_groups(t.withColumn("c", F.when((F.col("entry_conviction") >= 0) & (F.col("entry_conviction") < 1), fifth + 0.1)), "c", "win", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]), 8, "rate")


@query("""WITH t AS (SELECT vote_margin_entry AS v, CAST(win AS INTEGER) AS w FROM trades WHERE vote_margin_entry IS NOT NULL AND isfinite(vote_margin_entry) AND win IS NOT NULL),
  e AS (SELECT quantile_cont(v, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM t) SELECT CAST(g AS INTEGER) AS grp, count(*) AS n, round(avg(w), 8) AS rate FROM t, e, range(5) AS q(g) WHERE v >= e[g + 1] AND v <= e[g + 2] GROUP BY g""")
def win_rate_by_quintile(spark, d):
    """Quintiles closed on both sides, so rows on an edge count twice."""
    return rounded(D.quantile_groups(table(spark, d, "trades"), "vote_margin_entry", "win"), 8, "rate")


@query("""WITH t AS (SELECT entry_conviction AS c, CAST(win AS INTEGER) AS w FROM trades WHERE entry_conviction IS NOT NULL AND isfinite(entry_conviction) AND win IS NOT NULL), q AS (SELECT quantile_cont(c, [0.33, 0.66]) AS q FROM t),
  r AS (SELECT avg(w) FILTER (c >= q[2]) AS top, avg(w) FILTER (c < q[1]) AS bottom FROM t, q) SELECT round(top, 8) AS top, round(bottom, 8) AS bottom, round(top - bottom, 8) + 0.0 AS edge, top - bottom > 0.03 AS predictive FROM r""")
def conviction_edge(spark, d):
    """A29."""
    return rounded(D.conviction_edge(table(spark, d, "trades"), "entry_conviction", "win"), 8, "top", "bottom", "edge")


@query("""SELECT upper(side) AS side, count(*) AS n, round(CASE WHEN count(*) < 2 THEN 0 ELSE coalesce(corr(vote_margin_entry, pnl), 0) END, 6) + 0.0 AS r FROM trades
  WHERE vote_margin_entry IS NOT NULL AND isfinite(vote_margin_entry) AND pnl IS NOT NULL AND isfinite(pnl) GROUP BY 1""")
def margin_correlation(spark, d):
    """A22."""
    return rounded(D.correlation(_trades(spark, d), "vote_margin_entry", "pnl", ["side"]), 6, "r")


@query("""WITH d AS (SELECT rsi_at_entry AS x, macd_at_entry AS y, pnl AS v FROM trades WHERE isfinite(rsi_at_entry) AND isfinite(macd_at_entry) AND isfinite(pnl)), r AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM d),
  c AS (SELECT floor((x - x0) / (x1 - x0) * 10) AS xi, floor((y - y0) / (y1 - y0) * 10) AS yi, v FROM d, r)
  SELECT CAST(xi AS INTEGER) AS xi, CAST(yi AS INTEGER) AS yi, count(*) AS n, round(avg(v), 8) + 0.0 AS mean_value FROM c WHERE xi < 10 AND yi < 10 GROUP BY ALL HAVING count(*) > 5""")
def decision_grid(spark, d):
    """Mean gain per RSI and MACD cell."""
    return rounded(D.grid_mean(table(spark, d, "trades"), "rsi_at_entry", "macd_at_entry", "pnl", 10), 8, "mean_value")


@query("""SELECT CAST(h AS INTEGER) AS hour, count(episode_id) FILTER (t.h2 IS NOT NULL) AS n, round(coalesce(avg(c), 0), 8) + 0.0 AS mean_value FROM range(24) AS q(h)
  LEFT JOIN (SELECT hour(ingest_time) AS h2, CASE WHEN isfinite(entry_conviction) THEN entry_conviction END AS c, coalesce(episode_id, 0) AS episode_id FROM trades) t ON t.h2 = h GROUP BY h""")
def hour_profile(spark, d):
    """A19."""
    return rounded(D.profile(table(spark, d, "trades"), "ingest_time", "entry_conviction", "hour"), 8, "mean_value")


@query("""SELECT CAST(w AS INTEGER) AS weekday, count(t.w2) AS n, round(coalesce(avg(c), 0), 8) + 0.0 AS mean_value FROM range(7) AS q(w)
  LEFT JOIN (SELECT isodow(ingest_time) - 1 AS w2, CASE WHEN isfinite(entry_conviction) THEN entry_conviction END AS c FROM trades) t ON t.w2 = w GROUP BY w""")
def weekday_profile(spark, d):
    return rounded(D.profile(table(spark, d, "trades"), "ingest_time", "entry_conviction", "weekday"), 8, "mean_value")


@query("""SELECT hour(ingest_time) AS hour, count(*) FILTER (upper(side) = 'LONG') AS n_long, count(*) FILTER (upper(side) = 'SHORT') AS n_short FROM trades WHERE ingest_time IS NOT NULL GROUP BY 1""")
def side_by_hour(spark, d):
    """A21."""
    return _trades(spark, d).filter("ingest_time is not null").groupBy(F.hour("ingest_time").cast("bigint").alias("hour")).agg(F.count_if(F.col("side") == "LONG").alias("n_long"), F.count_if(F.col("side") == "SHORT").alias("n_short"))


@query("""SELECT trade_id, round(pnl + CASE WHEN pnl > 0.001 THEN pnl * 0.1 ELSE 0 END, 10) + 0.0 AS reward,
  round(CASE upper(side) WHEN 'LONG' THEN (CAST(exit_price AS DOUBLE) * (1 - 0.00015) - CAST(entry_price AS DOUBLE) * 1.00015) / (CAST(entry_price AS DOUBLE) * 1.00015)
   WHEN 'SHORT' THEN (CAST(entry_price AS DOUBLE) * (1 - 0.00015) - CAST(exit_price AS DOUBLE) * 1.00015) / (CAST(entry_price AS DOUBLE) * (1 - 0.00015)) END, 9) + 0.0 AS closed FROM trades""")
def trade_rewards(spark, d):
    """Shaped reward, gain after commission."""
    t = _trades(spark, d)
    p0, p1 = F.col("entry_price").cast("double"), F.col("exit_price").cast("double")
    reward = S.shaped_reward(F.col("pnl"), F.lit(False), F.lit(False))  # a tick that closes holds nothing any more
    return t.select("trade_id", (F.round(reward, 10) + 0.0).alias("reward"), (F.round(S.close_pnl(F.col("side"), S.entry_price(F.col("side"), p0), p1), 9) + 0.0).alias("closed"))


@query("""SELECT t.trade_id, b.row_id, b.action FROM trades t JOIN memory_bank b ON t.episode_id = b.episode_id AND t.entry_tick = b.tick""")
def trade_entries(spark, d):
    """The bank row at the entry of a trade."""
    b = table(spark, d, "memory_bank").select("episode_id", F.col("tick").alias("entry_tick"), "row_id", "action")
    t = table(spark, d, "trades").select("trade_id", "episode_id", F.col("entry_tick").cast("bigint"))
    return t.join(b, ["episode_id", "entry_tick"]).select("trade_id", "row_id", "action")


_TRADE_METRICS = {
    "trades": "CAST(count(*) AS DOUBLE)", "win_rate": "avg(w)", "mean": "avg(pnl)", "median": "quantile_cont(pnl, 0.5)", "std": "stddev_pop(pnl)", "total": "sum(pnl)", "best": "max(pnl)", "worst": "min(pnl)",
    "sharpe": "CASE WHEN stddev_pop(pnl) > 0 THEN avg(pnl) / stddev_pop(pnl) * sqrt(count(*)) END", "median_hold": "quantile_cont(CAST(duration AS DOUBLE), 0.5)", "hold_hours": "quantile_cont(CAST(duration AS DOUBLE), 0.5) * 4",
    **{f"{s.lower()}_{n}": f.replace("?", s) for s in ("LONG", "SHORT") for n, f in (("trades", "CAST(count(*) FILTER (side = '?') AS DOUBLE)"), ("win_rate", "avg(w) FILTER (side = '?')"), ("mean", "avg(pnl) FILTER (side = '?')"))},
    "conviction_over_50": "avg(CASE WHEN c IS NOT NULL THEN CAST(c > 0.5 AS DOUBLE) END)", "conviction_over_70": "avg(CASE WHEN c IS NOT NULL THEN CAST(c > 0.7 AS DOUBLE) END)", "top_win_rate": "avg(w) FILTER (c >= q[2])", "bottom_win_rate": "avg(w) FILTER (c < q[1])",
    "conviction_edge": "avg(w) FILTER (c >= q[2]) - avg(w) FILTER (c < q[1])",
}


@query("""WITH t AS (SELECT pnl, duration, upper(side) AS side, CASE WHEN isfinite(entry_conviction) THEN entry_conviction END AS c, CAST(pnl > 0 AS DOUBLE) AS w FROM trades WHERE pnl IS NOT NULL AND isfinite(pnl)), k AS (SELECT quantile_cont(c, [0.33, 0.66]) AS q FROM t),
  o AS (SELECT """ + ", ".join(f"{v} AS {k}" for k, v in _TRADE_METRICS.items()) + " FROM t, k) " + " UNION ALL ".join(f"SELECT '{k}' AS metric, round({k}, 8) + 0.0 AS value FROM o" for k in _TRADE_METRICS))
def diagnostic_summary(spark, d):
    """The summary of all trades as metric and value."""
    return rounded(D.summary(table(spark, d, "trades")), 8, "value")


@query("""SELECT episode_id, round(coalesce(sum(pnl), 0), 8) + 0.0 AS realised_pnl, count(*) FILTER (pnl <> 0) AS n_trades FROM (SELECT episode_id, CASE WHEN isfinite(pnl) THEN pnl END AS pnl FROM trades) GROUP BY episode_id""")
def episode_outcomes(spark, d):
    """A38, ST13: gain of each episode, and its trades that gained or lost anything."""
    t = table(spark, d, "trades").select("episode_id", D.finite(F.col("pnl")).alias("pnl"), F.lit(None).cast("int").alias("action"))
    return rounded(Z.epoch_metrics(t, ["episode_id"]).select("episode_id", "realised_pnl", "n_trades"), 8, "realised_pnl")


# -- bank -----------------------------------------------------------------------------------------


def _in_order(b: DataFrame) -> DataFrame:
    """Bank rows with their rank ``i`` in the episode, by tick, then row_id; legacy rows all have tick 0."""
    b = b.withColumn("_o", F.struct("tick", "row_id")).withColumn("_b", F.when(F.col("tick") <= 0, F.expr("row_id div 4096")).otherwise(F.expr("tick div 2048 + 9223372036854")))
    return ranked(b, "episode_id", "_o", "_b", "i")


def _acts(spark, d) -> DataFrame:
    b = table(spark, d, "memory_bank").filter("action is not null and episode_id is not null and tick is not null")
    return _in_order(b.select("episode_id", "tick", "row_id", "action")).select("episode_id", "i", "action")


@query("""WITH b AS (SELECT episode_id, count(*) FILTER (action = 0) a0, count(*) FILTER (action = 1) a1, count(*) FILTER (action = 2) a2, count(*) FILTER (action = 3) a3 FROM memory_bank GROUP BY 1), l AS (
  SELECT episode_id, unnest([0, 1, 2, 3]) AS action, unnest([a0, a1, a2, a3]) AS n, a0 + a1 + a2 + a3 AS t FROM b) SELECT episode_id, CAST(action AS INTEGER) AS action, n, round(CASE WHEN t > 0 THEN n / t END, 8) AS share FROM l""")
def action_counts(spark, d):
    """Dense counts of actions per episode."""
    return rounded(D.dense_counts(table(spark, d, "memory_bank"), "action", 4, ["episode_id"]), 8, "share")


@query("""WITH p AS (SELECT action AS f, lead(action) OVER (PARTITION BY episode_id ORDER BY tick, row_id) AS t FROM memory_bank WHERE action IS NOT NULL AND episode_id IS NOT NULL AND tick IS NOT NULL), c AS (SELECT f, t, count(*) AS n FROM p WHERE t IS NOT NULL GROUP BY ALL)
  SELECT f AS "from", t AS "to", n, round(n / (sum(n) OVER (PARTITION BY f) + 1e-9), 8) AS share FROM c""")
def transition_matrix(spark, d):
    """A13, W10."""
    return rounded(D.transition_matrix(_acts(spark, d), "episode_id", "i", "action"), 8, "share")


@query("""WITH x AS (SELECT episode_id, action, row_number() OVER (PARTITION BY episode_id ORDER BY tick, row_id) AS i, lag(action) OVER (PARTITION BY episode_id ORDER BY tick, row_id) AS p FROM memory_bank WHERE action IS NOT NULL AND episode_id IS NOT NULL AND tick IS NOT NULL),
  s AS (SELECT episode_id, i, action, lead(i) OVER (PARTITION BY episode_id ORDER BY i) - i AS n FROM x WHERE p IS NULL OR p <> action) SELECT episode_id, CAST(i AS INTEGER) AS start, n FROM s WHERE action = 3 AND n IS NOT NULL""")
def hold_runs(spark, d):
    """Runs of HOLD, the last run of an episode left out."""
    return D.code_runs(_acts(spark, d), "episode_id", "i", "action", 3).withColumn("start", (F.col("start") + 1).cast("int"))


def _rewards(spark, d) -> DataFrame:
    b = table(spark, d, "memory_bank").filter("mc_return is not null and not isnan(mc_return) and abs(mc_return) < float('infinity') and episode_id is not null and tick is not null")
    return _in_order(b).select("episode_id", "row_id", "i", F.col("mc_return").cast("double").alias("r"))


@query("""WITH b AS (SELECT episode_id, row_id, CAST(mc_return AS DOUBLE) AS r, row_number() OVER (PARTITION BY episode_id ORDER BY tick, row_id) - 1 AS i FROM memory_bank WHERE mc_return IS NOT NULL AND isfinite(mc_return) AND episode_id IS NOT NULL AND tick IS NOT NULL)
  SELECT row_id, i, round(sum(power(0.97, i) * r) OVER (PARTITION BY episode_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / power(0.97, i), 5) + 0.0 AS g FROM b WHERE i < 100000""")
def discounted_returns(spark, d):
    """Discounted returns of the recorded values in each episode."""
    out = R.discounted_returns(_rewards(spark, d), "episode_id", "i", "r", "g")
    return rounded(out.select("row_id", "i", "g"), 5, "g")


@query("""SELECT count(*) AS n, round(avg(r), 8) AS mean_return, round(stddev_pop(r), 8) AS std_return, count(*) FILTER (action = 0) AS n_action_0, count(*) FILTER (action = 1) AS n_action_1, count(*) FILTER (action = 2) AS n_action_2, count(*) FILTER (action = 3) AS n_action_3
  FROM (SELECT action, CASE WHEN isfinite(mc_return) THEN CAST(mc_return AS DOUBLE) END AS r FROM memory_bank)""")
def bank_statistics(spark, d):
    """S18."""
    return rounded(R.bank_statistics(table(spark, d, "memory_bank")), 8, "mean_return", "std_return")


@query("""WITH s AS (SELECT coalesce(abs(mc_return) > 0.0005, false) AS signal, count(*) AS n FROM memory_bank GROUP BY 1), c AS (SELECT coalesce(max(n) FILTER (signal), 0) AS s, coalesce(max(n) FILTER (NOT signal), 0) AS z FROM s),
  k AS (SELECT s, z, least(s, 1000 // 2) AS ks FROM c), m AS (SELECT s, z, least(z, 1000 - ks) AS kz FROM k)
  SELECT unnest([true, false]) AS signal, unnest([CASE WHEN s + z <= 1000 THEN s ELSE least(s, 1000 - kz) END, CASE WHEN s + z <= 1000 THEN z ELSE kz END]) AS n FROM m""")
def prune_strata(spark, d):
    """Rows kept of either stratum when the bank is cut to 1000."""
    kept = R.prune(table(spark, d, "memory_bank"), 1000)
    return kept.groupBy(F.coalesce(F.abs("mc_return") > 0.0005, F.lit(False)).alias("signal")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT row_id, coalesce(abs(mc_return) > 0.0005, false) AS s, md5('0:' || CAST(row_id AS VARCHAR)) AS h FROM memory_bank), c AS (SELECT count(*) FILTER (s) AS s, count(*) FILTER (NOT s) AS z FROM b),
  k AS (SELECT s, z, least(s, 500) AS ks FROM c), m AS (SELECT s, z, least(z, 1000 - ks) AS kz FROM k), l AS (SELECT CASE WHEN s + z <= 1000 THEN s ELSE least(s, 1000 - kz) END AS ls, CASE WHEN s + z <= 1000 THEN z ELSE kz END AS lz FROM m)
  SELECT row_id FROM (SELECT row_id, s, row_number() OVER (PARTITION BY s ORDER BY h, row_id) AS r FROM b) x, l WHERE r <= CASE WHEN x.s THEN ls ELSE lz END""")
def pruned_rows(spark, d):
    """Which rows stay when the bank is cut to 1000."""
    return R.prune(table(spark, d, "memory_bank"), 1000).select("row_id")


@query("""SELECT row_id FROM memory_bank ORDER BY md5('0:' || CAST(row_id AS VARCHAR)), row_id LIMIT 500""")
def sampled_rows(spark, d):
    """T5: 500 rows of the bank without replacement (a sampling operator)."""
    return R.sample_rows(table(spark, d, "memory_bank"), 500).select("row_id")


@query("""SELECT row_id, episode_id, tick, action FROM memory_bank WHERE action IS NOT NULL AND action <> 3""")
def action_markers(spark, d):
    """Everything but HOLD."""
    return table(spark, d, "memory_bank").filter("action <> 3").select("row_id", "episode_id", "tick", "action")


@query("""SELECT row_id FROM memory_bank WHERE action IS NOT NULL AND episode_id IS NOT NULL AND tick IS NOT NULL QUALIFY lead(row_id) OVER (PARTITION BY episode_id ORDER BY tick, row_id) IS NOT NULL""")
def pushed_rows(spark, d):
    """Rows that are pushed once their successor is known: all but the last of each episode."""
    b = _in_order(table(spark, d, "memory_bank").filter("action is not null and episode_id is not null and tick is not null").select("episode_id", "tick", "row_id"))
    return b.join(b.groupBy("episode_id").agg(F.max("i").alias("_last")), "episode_id").filter("i < _last").select("row_id")


@query("""WITH x AS (SELECT m.*, quantile_cont(CAST("ATR_Scaled" AS DOUBLE), 0.25) OVER () AS q1, quantile_cont(CAST("ATR_Scaled" AS DOUBLE), 0.75) OVER () AS q3 FROM (""" + _FEATURES + """) m), r AS (SELECT *, unnest(list_filter([
  CASE WHEN "MeanDev_Scaled"::DOUBLE > 0.1 AND "ATR_Scaled" > 0 THEN 'trending_up' END, CASE WHEN "MeanDev_Scaled"::DOUBLE < -0.1 AND "ATR_Scaled" > 0 THEN 'trending_down' END, CASE WHEN "MeanDev_Scaled"::DOUBLE BETWEEN -0.1 AND 0.1 THEN 'ranging' END,
  CASE WHEN "ATR_Scaled"::DOUBLE > q3 THEN 'high_vol' END, CASE WHEN "ATR_Scaled"::DOUBLE < q1 THEN 'low_vol' END], lambda v: v IS NOT NULL)) AS regime FROM x)
  SELECT regime, count(*) AS n, round(avg("RSI_Scaled"::DOUBLE), 6) + 0.0 AS mean_rsi FROM r GROUP BY regime""")
def regime_mix(spark, d):
    """Overlapping regimes."""
    r = D.with_regimes(_features(spark, d))
    return rounded(r.groupBy("regime").agg(F.count("*").alias("n"), F.avg(F.col("RSI_Scaled").cast("double")).alias("mean_rsi")), 6, "mean_rsi")


@query("""SELECT action, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS least, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75, max(v) AS most
  FROM (SELECT action, CASE WHEN isfinite(mc_return) THEN CAST(mc_return AS DOUBLE) END AS v FROM memory_bank) GROUP BY action""")
def return_spread(spark, d):
    """Box-plot summary per action."""
    return rounded(D.describe(table(spark, d, "memory_bank"), "mc_return", ["action"]), 6, "mean", "std", "q25", "median", "q75")


@query("""SELECT series, row_id FROM klines WHERE series IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series ORDER BY ingest_time DESC NULLS LAST, row_id DESC) <= 1000""")
def last_rows(spark, d):
    """The last 1000 rows of each series (a top-k report)."""
    from pyspark.sql import Window

    k = table(spark, d, "klines").filter("series is not null")
    r = F.row_number().over(Window.partitionBy("series").orderBy(F.desc_nulls_last("ingest_time"), F.desc("row_id")))
    return k.select("series", "row_id", "ingest_time").withColumn("r", r).filter("r <= 1000").select("series", "row_id")


@query("""SELECT sum(realised_pnl) AS total_pnl, sum(n_trades) AS n_trades, sum(action_counts[1]) AS n_long, sum(action_counts[2]) AS n_short, sum(action_counts[3]) AS n_close, sum(action_counts[4]) AS n_hold, f.symbol FROM epoch_metrics e JOIN feeds f ON e.series = f.series GROUP BY f.symbol""".replace("sum(realised_pnl)", "round(sum(realised_pnl), 6)").replace("sum(n_trades)", "CAST(sum(n_trades) AS BIGINT)").replace("sum(action_counts[1])", "CAST(sum(action_counts[1]) AS BIGINT)").replace("sum(action_counts[2])", "CAST(sum(action_counts[2]) AS BIGINT)").replace("sum(action_counts[3])", "CAST(sum(action_counts[3]) AS BIGINT)").replace("sum(action_counts[4])", "CAST(sum(action_counts[4]) AS BIGINT)"))
def epoch_totals(spark, d):
    """Metrics of several passes combined."""
    e = table(spark, d, "epoch_metrics").join(table(spark, d, "feeds").select("series", "symbol"), "series")
    return rounded(e.groupBy("symbol").agg(F.sum("realised_pnl").alias("total_pnl"), F.sum("n_trades").alias("n_trades"), *[F.sum(F.col("action_counts")[i]).alias(n) for i, n in enumerate(("n_long", "n_short", "n_close", "n_hold"))]), 6, "total_pnl")


@query("""WITH e AS (SELECT episode_id, [x / nullif(list_sum(action_counts), 0) FOR x IN action_counts] AS p FROM epoch_metrics) SELECT episode_id, round(-list_sum([x * log2(x + 1e-9) FOR x IN p]), 8) + 0.0 AS entropy,
  CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS most, round(list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2], 8) + 0.0 AS margin FROM e""")
def action_entropy(spark, d):
    """Entropy in bits, first-index argmax and top-2 margin of the action shares."""
    e = table(spark, d, "epoch_metrics").withColumn("t", F.aggregate("action_counts", F.lit(0).cast("bigint"), lambda a, x: a + x))
    p = F.transform("action_counts", lambda x: x / F.when(F.col("t") > 0, F.col("t")))
    e = e.withColumn("p", p)
    return e.select("episode_id", (F.round(S.entropy_bits(F.col("p")), 8) + 0.0).alias("entropy"), S.argmax_first(F.col("p")).alias("most"), (F.round(S.top2_margin(F.col("p")), 8) + 0.0).alias("margin"))


_ENTRIES = """t AS (SELECT t.*, e.series FROM trades t JOIN epoch_metrics e ON t.episode_id = e.episode_id)"""


def _entries(spark, d) -> DataFrame:
    """Trades with the series of their episode; entry_tick counts its complete rows."""
    t = _trades(spark, d).join(table(spark, d, "epoch_metrics").select("episode_id", "series"), "episode_id")
    return t.withColumn("tick", F.col("entry_tick").cast("bigint"))


@query("""WITH x AS (SELECT m.*, quantile_cont(CAST("ATR_Scaled" AS DOUBLE), 0.25) OVER () AS q1, quantile_cont(CAST("ATR_Scaled" AS DOUBLE), 0.75) OVER () AS q3 FROM (""" + _FEATURES + """) m), r AS (SELECT *, unnest(list_filter([
  CASE WHEN "MeanDev_Scaled"::DOUBLE > 0.1 AND "ATR_Scaled" > 0 THEN 'trending_up' END, CASE WHEN "MeanDev_Scaled"::DOUBLE < -0.1 AND "ATR_Scaled" > 0 THEN 'trending_down' END, CASE WHEN "MeanDev_Scaled"::DOUBLE BETWEEN -0.1 AND 0.1 THEN 'ranging' END,
  CASE WHEN "ATR_Scaled"::DOUBLE > q3 THEN 'high_vol' END, CASE WHEN "ATR_Scaled"::DOUBLE < q1 THEN 'low_vol' END], lambda v: v IS NOT NULL)) AS regime FROM x), """ + _ENTRIES + """
  SELECT regime, count(win) AS n, round(avg(CAST(win AS INTEGER)), 8) AS win_rate FROM t JOIN r ON t.series = r.series AND t.entry_tick = r.tick GROUP BY regime HAVING count(win) >= 3""")
def win_rate_by_regime(spark, d):
    """Win rate by regime at entry; regimes with fewer than three trades are left out."""
    r = D.with_regimes(_features(spark, d)).select("series", "tick", "regime")
    out = _entries(spark, d).join(r, ["series", "tick"]).groupBy("regime").agg(F.count("win").alias("n"), F.avg(F.col("win").cast("double")).alias("win_rate"))
    return rounded(out.filter("n >= 3"), 8, "win_rate")


@query()
def win_rate_by_entry_hour(spark, d):
    """Win rate and count by hour (UTC) of the reading at entry (no SQL: its Open_time is text of many kinds)."""
    m = table(spark, d, "master_processed")
    at = resolve_instants(m.join(table(spark, d, "feeds").select("series", "tz_name", "date_order"), "series", "left"), "Open_time", ["row_id"], "series", "row_id", "tz_name", "date_order")
    hour = at.filter("status in ('stated', 'inferred')").select("row_id", F.expr("pmod(floor(utc_ms / 3600000), 24)").cast("int").alias("hour"))
    rows = W.feature_table(m, cfg=replace(DEFAULT, features=(*FEATURES, "row_id"))).select("series", "tick", "row_id")
    t = _entries(spark, d).join(rows, ["series", "tick"]).join(hour, "row_id").filter("win is not null")
    return t.groupBy("hour").agg(F.count("*").alias("n"), F.avg(F.col("win").cast("double")).alias("win_rate"))


@query(f"""SELECT series, min("Close") AS price_min, max("Close") AS price_max FROM ({_CANDLES}) GROUP BY series""")
def price_range(spark, d):
    """Least and largest sound Close of each series."""
    return _candles(spark, d).groupBy("series").agg(F.min("Close").alias("price_min"), F.max("Close").alias("price_max"))


@query(_HIST.format(cols="won,", src="(SELECT *, pnl > 0 AS won, vote_margin_entry AS v FROM trades WHERE pnl IS NOT NULL AND isfinite(pnl))", by="won,", grp="GROUP BY won", n=20, vby="v.won,", join="JOIN e ON v.won = e.won", gby="g.won,", on="AND g.won = c.won", dens=""))
def entry_margin_histogram(spark, d):
    """Vote margin at entry, wins against losses."""
    t = table(spark, d, "trades").filter(D.finite(F.col("pnl")).isNotNull()).withColumn("won", F.col("pnl") > 0)
    return rounded(D.histogram(t, "vote_margin_entry", 20, ["won"]), 9, "left")


# -- neighbours -----------------------------------------------------------------------------------


def _queries(spark, d) -> DataFrame:
    return table(spark, d, "memory_bank").filter("row_id % 20 = 0")


_SOUND = "(SELECT * FROM memory_bank WHERE state IS NOT NULL AND len(state) > 0 AND len(list_filter(state, lambda x: x IS NULL OR isnan(x))) = 0)"
_DIST = f"""b AS (SELECT row_id, episode_id, tick, action, CAST(mc_return AS DOUBLE) AS ret, CAST(state AS DOUBLE[]) AS s FROM {_SOUND}), q AS (SELECT * FROM b WHERE row_id % 20 = 0),
  d AS (SELECT q.row_id AS qid, b.row_id AS bid, list_distance(q.s, b.s) AS dist, b.action, b.ret, coalesce(q.episode_id = b.episode_id AND abs(q.tick - b.tick) < 100, false) AS away FROM q, b)"""


@query(f"""WITH {_DIST} SELECT qid, CAST(rank AS INTEGER) AS rank, round(dist, 6) + 0.0 AS dist FROM (SELECT qid, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, bid) AS rank FROM d) WHERE rank <= 25""")
def knn_topk(spark, d):
    """Exact nearest 25 rows of the stated queries (every row whose id is divisible by 20) among all rows."""
    return rounded(K.knn(_queries(spark, d), table(spark, d, "memory_bank")).select("qid", "rank", "dist"), 6, "dist")


_VOTE = """, c AS (SELECT *, NOT bool_or(NOT away) OVER (PARTITION BY qid) AS none FROM d), n AS (SELECT * FROM c WHERE {keep} QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, bid) <= 25),
  w AS (SELECT *, least(1 / (dist + 1e-3), 50 * (quantile_cont(1 / (dist + 1e-3), 0.5) OVER (PARTITION BY qid) + 1e-8)) AS w FROM n), v AS (SELECT qid,
  coalesce(sum(w * ret) FILTER (action = 0 AND isfinite(ret)), 0) v0, coalesce(sum(w * ret) FILTER (action = 1 AND isfinite(ret)), 0) v1, coalesce(sum(w * ret) FILTER (action = 2 AND isfinite(ret)), 0) v2, coalesce(sum(w * ret) FILTER (action = 3 AND isfinite(ret)), 0) v3 FROM w GROUP BY qid)
  SELECT qid, round(v0, 4) + 0.0 AS v0, round(v1, 4) + 0.0 AS v1, round(v2, 4) + 0.0 AS v2, round(v3, 4) + 0.0 AS v3 FROM v"""


def _vote_columns(v: DataFrame) -> DataFrame:
    return v.select("qid", *[(F.round(F.col("vote")[a], 4) + 0.0).alias(f"v{a}") for a in range(4)])


@query("WITH " + _DIST + _VOTE.format(keep="true"))
def knn_vote(spark, d):
    """A1, A2: weighted votes per action."""
    bank = table(spark, d, "memory_bank")
    return _vote_columns(K.votes(K.neighbour_weights(K.knn(_queries(spark, d), bank), bank)))


@query("WITH " + _DIST + _VOTE.format(keep="NOT away OR none"))
def knn_vote_temporal(spark, d):
    """Votes without rows of the query's episode within 100 ticks, all rows where none is left."""
    bank = table(spark, d, "memory_bank")
    return _vote_columns(K.votes(K.neighbour_weights(K.knn(_queries(spark, d), bank, min_tick_gap=100), bank)))


_VOTES = _VOTE[: _VOTE.index("FROM w GROUP BY qid)")].replace("SELECT qid,\n", "SELECT qid, avg(ret) FILTER (isfinite(ret)) AS rm, stddev_pop(ret) FILTER (isfinite(ret)) AS rs,\n") + "FROM w GROUP BY qid)"


def _shares(votes: str, allowed: list[int]) -> str:
    """Columns f0..f3, of which the masked ones are 0, to shares."""
    f = [f"v{a}" if a in allowed else "0.0::DOUBLE" for a in range(4)]
    low = f"least({', '.join(f)})"
    s = [f"({f[a]} - {low} + 1e-8)" if a in allowed else "0.0::DOUBLE" for a in range(4)]
    return ", ".join(f"round({s[a]} / ({_sum(s)}), 5) + 0.0 AS {votes}{a}" for a in range(4))


def _first_best(allowed: list[int]) -> str:
    top = f"greatest({', '.join(f'v{a}' for a in allowed)})"
    return "CAST(CASE " + " ".join(f"WHEN v{a} = {top} THEN {a}" for a in allowed) + " END AS INTEGER)"


def _top2(allowed: list[int]) -> str:
    v = f"list_sort([{', '.join(f'v{a}' for a in allowed)}], 'DESC')"
    return f"round({v}[1] - {v}[2], 4) + 0.0"


@query("WITH " + _DIST + _VOTES.format(keep="true") + f""", x AS (SELECT qid, count(*) FILTER (away) AS n, count(*) AS t FROM d GROUP BY qid)
  SELECT v.qid, {_first_best([0, 1, 2, 3])} AS action, {_top2([0, 1, 2, 3])} AS margin, {_shares("s", [0, 1, 2, 3])}, round(coalesce(rm, 0), 5) + 0.0 AS ret_mean, round(coalesce(rs, 0), 5) + 0.0 AS ret_std,
  {_first_best([0, 1, 3])} AS flat_action, {_top2([0, 1, 3])} AS flat_margin, {_shares("f", [0, 1, 3])}, CASE WHEN n < t THEN n ELSE 0 END AS excluded FROM v JOIN x ON v.qid = x.qid""")
def knn_decision(spark, d):
    """Action, shares and margin of each query with and without the mask of a flat portfolio, and what temporal exclusion would leave out."""
    bank, q = table(spark, d, "memory_bank"), _queries(spark, d)
    w = K.neighbour_weights(K.knn(q, bank), bank)
    flat = K.votes(w, S.action_mask(F.lit(None).cast("string")))
    pick = lambda v, p: [F.col("action").alias(f"{p}action"), (F.round("margin", 4) + 0.0).alias(f"{p}margin"), *[(F.round(F.col("shares")[a], 5) + 0.0).alias(f"{(p or 's')[0]}{a}") for a in range(4)]]
    free = K.votes(w)
    out = free.select("qid", *pick(free, ""), (F.round("ret_mean", 5) + 0.0).alias("ret_mean"), (F.round("ret_std", 5) + 0.0).alias("ret_std"))
    return out.join(flat.select("qid", *pick(flat, "flat_")), "qid").join(K.excluded_counts(q, bank, DEFAULT.min_tick_gap), "qid")


@query("WITH " + _DIST + """, k AS (SELECT qid, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, bid) AS rank FROM d WHERE qid <> bid), n AS (SELECT * FROM k WHERE rank <= 10)
  SELECT count(DISTINCT qid) AS queries, round(quantile_cont(dist, 0.5) FILTER (rank = 1), 6) AS median_first, round(quantile_cont(dist, 0.5) FILTER (rank = 10), 6) AS median_tenth, round(quantile_cont(dist, 0.5), 6) AS median_all,
  round(avg(CAST(dist < 0.05 AS INTEGER)) FILTER (rank = 1), 8) AS near_copies FROM n""")
def distance_report(spark, d):
    """Integrity of the bank, a row never its own neighbour."""
    near = K.knn(_queries(spark, d), table(spark, d, "memory_bank"), k=10, self_excluded=True)
    return rounded(rounded(K.distance_report(near), 6, "median_first", "median_tenth", "median_all"), 8, "near_copies")


@query("WITH " + _DIST[: _DIST.index("d AS (SELECT q.row_id")].rstrip().rstrip(",") + """, e AS (SELECT i, quantile_cont(s[i + 1], 0.1) AS lo, quantile_cont(s[i + 1], 0.9) AS hi FROM q, range(6) AS r(i) GROUP BY i),
  p AS (SELECT row_id * 12 + i * 2 + x AS qid, list_concat(s[1:i], [CAST(CAST(CASE WHEN x = 0 THEN lo ELSE hi END AS FLOAT) AS DOUBLE)], s[i + 2:50]) AS s FROM q, e, range(2) AS y(x)),
  d AS (SELECT p.qid, b.row_id AS bid, list_distance(p.s, b.s) AS dist, b.action, b.ret, false AS away FROM p, b)""" + _VOTES.format(keep="true") + """, l AS (SELECT *, least(v0, v1, v2, v3) AS low FROM v),
  s AS (SELECT qid, [(x - low + 1e-8) / (v0 + v1 + v2 + v3 - 4 * low + 4e-8) FOR x IN [v0, v1, v2, v3]] AS s FROM l), u AS (SELECT a.qid // 2 % 6 AS feature, unnest(range(4)) AS action, unnest([b.s[j + 1] - a.s[j + 1] FOR j IN range(4)]) AS delta
  FROM s a JOIN s b ON a.qid % 2 = 0 AND b.qid = a.qid + 1) SELECT CAST(feature AS INTEGER) AS feature, CAST(action AS INTEGER) AS action, round(avg(delta), 5) + 0.0 AS mean_delta, round(stddev_pop(delta), 5) + 0.0 AS std_delta FROM u GROUP BY ALL""")
def share_sensitivity(spark, d):
    """How the vote shares of the stated queries change when a feature goes from its 10th to its 90th percentile."""
    bank = table(spark, d, "memory_bank")
    q = K.sound_states(_queries(spark, d))
    ends = q.agg(*[F.percentile(F.col("state")[i].cast("double"), F.array(F.lit(0.1), F.lit(0.9))).alias(f"q{i}") for i in range(6)])
    probes = q.crossJoin(ends).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("e", F.explode(F.array(F.lit(0), F.lit(1))))  # one row
    at = F.array(*[F.col(f"q{i}") for i in range(6)])[F.col("i")][F.col("e")]
    probes = probes.withColumn("state", F.transform("state", lambda x, j: F.when(j == F.col("i"), at.cast("float")).otherwise(x))).withColumn("row_id", F.col("row_id") * 12 + F.col("i") * 2 + F.col("e"))
    v = K.votes(K.neighbour_weights(K.knn(probes, bank), bank)).select("qid", "shares")
    low, high = v.filter("qid % 2 = 0").select((F.expr("qid div 2")).alias("p"), F.col("shares").alias("a")), v.filter("qid % 2 = 1").select(F.expr("qid div 2").alias("p"), F.col("shares").alias("b"))
    x = low.join(high, "p").withColumn("feature", (F.col("p") % 6).cast("int")).select("feature", F.posexplode(F.zip_with("a", "b", lambda a, b: b - a)).alias("action", "delta"))
    return rounded(x.groupBy("feature", "action").agg(F.avg("delta").alias("mean_delta"), F.stddev_pop("delta").alias("std_delta")), 5, "mean_delta", "std_delta")


# -- loop -----------------------------------------------------------------------------------------


@query()
def random_baseline(spark, d):
    """A36, ST18: random policy over the prices of each series, 1000 trials of 500 trades (seeded; no SQL)."""
    return Z.random_baseline(_series(spark, d), by="series")


def momentum(state, mask):
    """A policy for tests and benchmarks: follow the slope of the first feature."""
    import numpy as np

    slope = float(state[6])
    want = 0 if slope > 1.0 else 1 if slope < -1.0 else 3
    action = want if mask[want] else (2 if mask[2] and abs(slope) < 0.5 else 3)
    return action, np.eye(4)[action]


def _trace(spark, d, *keep: str) -> DataFrame:
    """The trace of all series, with the columns named (all if none)."""
    return Z.fold(_features(spark, d), "series", Z.memory_policy(table(spark, d, "memory_bank")), keep=keep or None, features=FEATURES)


@query()
def position_trace(spark, d):
    """ST2-ST9, ST13, ST17: the fold over all series, each tick decided by the vote of the memory bank (no SQL: golden values and batch/stream parity in the tests)."""
    return _trace(spark, d)


@query()
def trace_trades(spark, d):
    """Closed trades of the trace."""
    return Z.trades_of(_trace(spark, d, "tick", "price", "action", "pnl", "side", "entry", "entry_tick"), "series")


def _conviction(trace: DataFrame) -> DataFrame:
    return trace.withColumn("conviction", F.array_max("shares")).withColumn("entropy", S.entropy_bits(F.col("shares")))


@query()
def conviction_by_action(spark, d):
    """Histogram of the largest share per action of the trace."""
    return D.histogram(_conviction(_trace(spark, d)), "conviction", 30, ["action"])


@query()
def regime_decisions(spark, d):
    """Per regime the share of each action (10 ticks at least), and the spread of conviction and entropy (more than 10), over the trace."""
    r = D.with_regimes(_features(spark, d)).select("series", "tick", "regime")
    x = materialize(_conviction(_trace(spark, d, "tick", "action", "shares")).join(r, ["series", "tick"]).select("regime", "action", "conviction", "entropy"), "decisions")
    mix = x.groupBy("regime").agg(F.count("*").alias("n"), *[F.avg((F.col("action") == a).cast("double")).alias(f"share_{a}") for a in range(4)])
    for c in ("conviction", "entropy"):
        s = D.describe(x, c, ["regime"])
        mix = mix.join(s.select("regime", *[F.when(F.col("n") > 10, F.col(q)).alias(f"{c}_{q}") for q in ("mean", "least", "q25", "median", "q75", "most")]), "regime")
    return mix.filter("n >= 10")


@query()
def policy_confusion(spark, d):
    """A12, ST14: action of the trace against the best vote without a mask, and the share of ticks where they agree."""
    c = materialize(D.confusion(_trace(spark, d, "action", "vote").withColumn("best_vote", S.argmax_first(F.col("vote"))), "action", "best_vote"), "confusion")  # read twice
    return c.crossJoin(c.agg((F.sum(F.when(F.col("action") == F.col("best_vote"), F.col("n")).otherwise(0)) / F.sum("n")).alias("match_rate")))  # one row


@query()
def policy_health(spark, d):
    """ST14, A24, A39: conviction, entropy, agreement, margin and neighbours' returns over the trace."""
    return D.policy_health(_trace(spark, d))


@query()
def trace_metrics(spark, d):
    """ST13: gain, trades and action counts of each series' pass."""
    return Z.epoch_metrics(_trace(spark, d, "action", "pnl"), ["series"])
