"""Command line: run a named query over a folder of tables and write or show its result."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("query")
    p.add_argument("tables", help="folder with the Parquet tables")
    p.add_argument("--out", help="folder for the result (Parquet); else 20 rows are shown")
    p.add_argument("--queries", default="tidemark.queries", help="module whose queries are offered, e.g. __spark_entry__ for all of them")
    p.add_argument("--symbol", help="only rows of this symbol or series, where the result has such a column")
    p.add_argument("--checkpoint", help="folder that all executors share, for intermediate tables")
    p.add_argument("--split", help="only rows with this value in a column named split")
    p.add_argument("--explain", action="store_true")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    module = importlib.import_module(a.queries)
    known = module.queries() if hasattr(module, "queries") else module.QUERIES
    if a.query not in known:
        raise SystemExit(f"no query {a.query!r}; there are: {', '.join(sorted(known))}")
    spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.checkpoint:
        spark.sparkContext.setCheckpointDir(a.checkpoint)
    df = known[a.query](spark, a.tables)
    for column in ("symbol", "series"):
        if a.symbol and column in df.columns:
            df = df.filter(df[column] == a.symbol)
            break
    if a.split and "split" in df.columns:
        df = df.filter(df["split"] == a.split)
    if a.explain:
        df.explain("formatted")
    elif a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.show(truncate=False)


if __name__ == "__main__":
    main()
