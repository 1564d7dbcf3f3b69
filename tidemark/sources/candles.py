"""Candle sources: JSON payloads, CSV files of mixed timestamps and a pollable data source."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark import schemas
from tidemark.config import DEFAULT, EngineConfig

FIELDS = [f.name for f in schemas.CANDLE]
_DOUBLES = ("Open", "High", "Low", "Close", "Volume")


def parse_klines(df: DataFrame, payload: str, *keep: str) -> DataFrame:
    """One row per candle of JSON payloads (arrays of 12-tuples); numbers may be text. Broken payloads give no rows."""
    rows = df.select(*keep, F.explode(F.from_json(payload, "array<array<string>>")).alias("_t")).filter(F.size("_t") == len(FIELDS))
    col = lambda i, f: F.col("_t")[i]
    typed = {"Open_time": lambda c: F.timestamp_millis(F.expr(f"try_cast({c} as bigint)")), **{n: (lambda c: F.expr(f"try_cast({c} as double)")) for n in _DOUBLES}, "Close_time": lambda c: F.expr(f"try_cast({c} as bigint)"), "Trades": lambda c: F.expr(f"try_cast({c} as bigint)")}
    return rows.select(*keep, *[(typed[f](f"_t[{i}]") if f in typed else col(i, f)).alias(f) for i, f in enumerate(FIELDS)])


def closed_only(candles: DataFrame, now, hours: int = 4) -> DataFrame:
    """Without candles that are still forming at ``now`` (a timestamp column or literal)."""
    return candles.filter(F.col("Open_time") + F.expr(f"interval {hours} hours") <= now)


def read_csv(spark: SparkSession, path: str, schema: str, at: str = "Open_time") -> DataFrame:
    """CSV of candles with timestamps of mixed forms, normalised by the interpretations of ``operators.timestamps``."""
    from tidemark.operators.timestamps import with_interpretations

    raw = spark.read.schema(schema).csv(path, header=True).withColumn("_z", F.lit("UTC")).withColumn("_o", F.lit(None).cast("string"))
    seen = with_interpretations(raw, at, "_z", "_o", "_i")
    return seen.withColumn(at, F.when(F.size("_i") > 0, F.timestamp_micros(F.col("_i")[0]["us"]))).drop("_z", "_o", "_i")


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[_Part]:
        return [_Part(p) for p in sorted(glob.glob(os.path.join(self.path, "*.json")))]

    def read(self, partition: _Part) -> Iterator[tuple]:
        with open(partition.path) as f:
            yield os.path.basename(partition.path), json.dumps(json.load(f))


class CandleFiles(DataSource):
    """Stand-in of a REST endpoint: each JSON file of a folder is one response (``name, payload``)."""

    @classmethod
    def name(cls) -> str:
        return "candle_files"

    def schema(self) -> str:
        return "name string, payload string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(CandleFiles)
    return parse_klines(spark.read.format("candle_files").option("path", path).load(), "payload", "name")


def latest(candles: DataFrame, limit: int, source: str = "series", at: str = "Open_time") -> DataFrame:
    """The last ``limit`` candles of each source (the limit of a request)."""
    rank = F.row_number().over(Window.partitionBy(source).orderBy(F.desc(at)))
    return candles.withColumn("_r", rank).filter(F.col("_r") <= limit).drop("_r")


def merge_master(master: DataFrame, fresh: DataFrame, source: str = "series", at: str = "Open_time", arrived: str = "ingest_time", key: str = "row_id") -> DataFrame:
    """Master table and new candles, one row per source and moment: the one that arrived last, then the largest key.

    Rows without a source or moment are left out; columns that one side lacks are null there. An empty side adds nothing.
    """
    both = master.unionByName(fresh, allowMissingColumns=True).filter(F.col(source).isNotNull() & F.col(at).isNotNull())
    row = F.struct(*[F.col(c) for c in both.columns])
    order = F.struct(F.coalesce(F.col(arrived).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")), F.col(key))
    return both.groupBy(F.col(source).alias("_s"), F.col(at).alias("_t")).agg(F.max_by(row, order).alias("_row")).select("_row.*")


def enough_rows(features: DataFrame, source: str = "series", cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Only sources with rows enough for a state after warm-up (warm-up + 2)."""
    n = features.groupBy(source).agg(F.count("*").alias("_n")).filter(F.col("_n") >= cfg.warmup + 2).select(source)
    return features.join(n, source, "left_semi")
