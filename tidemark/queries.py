"""Queries of the general operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import analytics
from tidemark.operators.regular_grid import regular_grid
from tidemark.operators.spikes import implausible_readings
from tidemark.operators.timestamps import resolve_instants
from tidemark.storage import table


def _with_feed(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    feeds = table(spark, sf_dir, "feeds").select("series", *cols)
    return table(spark, sf_dir, name).join(feeds, "series", "left")


def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both text columns as one table: src, row_id and what the text denotes."""
    k = _with_feed(spark, sf_dir, "klines", "tz_name", "date_order").select(F.lit("klines").alias("src"), "row_id", "series", F.col("Close_time").alias("text"), "tz_name", "date_order")
    m = _with_feed(spark, sf_dir, "master_processed", "tz_name", "date_order").select(F.lit("master_processed").alias("src"), "row_id", "series", F.col("Open_time").alias("text"), "tz_name", "date_order")
    both = k.unionByName(m).withColumn("origin", F.concat_ws("/", "src", "series"))
    return resolve_instants(both, "text", ["src", "row_id"], "origin", "row_id", "tz_name", "date_order")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instants(spark, sf_dir).filter("status in ('stated', 'inferred')").select("src", "row_id", "utc_ms")


def p1_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p1_found where no source declares its order of day and month: the search has to infer it."""
    k = _with_feed(spark, sf_dir, "klines", "tz_name")
    return resolve_instants(k, "Close_time", ["row_id"], "series", "row_id", "tz_name").select("row_id", "utc_ms", "status", "n_interpretations")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return implausible_readings(table(spark, sf_dir, "klines"), "row_id", "series", "Open_time", "ingest_time").select("row_id", "field")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _with_feed(spark, sf_dir, "master_processed", "tz_name", "date_order")
    at = resolve_instants(m, "Open_time", ["series", "Close"], "series", "row_id", "tz_name", "date_order").filter("status in ('stated', 'inferred')")
    step = table(spark, sf_dir, "feeds").select("series", (F.col("interval_min").cast("bigint") * 60_000).alias("step_ms"))
    return at.join(step, "series")


def p5_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regular_grid(readings(spark, sf_dir), "series", "utc_ms", "Close", "step_ms")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_grid(spark, sf_dir).filter("is_missing").select("series", "slot_ms")


def p5_klines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of the raw candles, whose moments are no texts: periods and whether they have a reading."""
    k = table(spark, sf_dir, "klines").select("series", F.unix_millis(F.col("Open_time").cast("timestamp")).alias("utc_ms"), "Close")
    step = table(spark, sf_dir, "feeds").select("series", (F.col("interval_min").cast("bigint") * 60_000).alias("step_ms"))
    return regular_grid(k.join(step, "series"), "series", "utc_ms", "Close", "step_ms").select("series", "slot_ms", "is_missing")


def p2_impossible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings beyond physical bounds."""
    found = implausible_readings(table(spark, sf_dir, "klines"), "row_id", "series", "Open_time", "ingest_time")
    return found.filter("reason = 'impossible'").select("row_id", "field")


QUERIES = {f.__name__: f for f in (p1_found, p1_undeclared, p2_found, p5_found, p5_grid, p5_klines, p2_impossible)} | analytics.QUERIES
ORACLE = analytics.ORACLE | {
    "p5_klines": """WITH r AS (SELECT k.series, epoch_ms(Open_time) // (interval_min * 60000) AS slot, interval_min * 60000 AS step FROM klines k JOIN feeds f ON k.series = f.series
   WHERE Open_time IS NOT NULL AND "Close" IS NOT NULL AND NOT isnan("Close")), e AS (SELECT series, step, unnest(range(min(slot), max(slot) + 1)) AS slot FROM r GROUP BY series, step)
  SELECT e.series, e.slot * e.step AS slot_ms, n.slot IS NULL AS is_missing FROM e LEFT JOIN (SELECT DISTINCT series, slot FROM r) n ON e.series = n.series AND e.slot = n.slot""",
    "p2_impossible": """SELECT row_id, 'Close' AS field FROM klines WHERE isnan("Close") OR "Close" > 1e12 OR "Close" <= 0
  UNION ALL SELECT row_id, 'Volume' FROM klines WHERE isnan(Volume) OR Volume > 1e13 OR Volume < 0""",
}
