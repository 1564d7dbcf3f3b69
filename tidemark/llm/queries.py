"""Queries of this subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.leaks import leaks
from tidemark.llm.neighbours import nearest
from tidemark.llm.packing import CAPACITY, count_tokens, pack
from tidemark.llm.percentiles import percentiles, value_counts
from tidemark.llm.truncation import source_report, truncated
from tidemark.operators.knn import knn
from tidemark.storage import table


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of values per piece: a day of klines, an episode of memory_bank."""
    bank = value_counts(table(spark, sf_dir, "memory_bank"), "action", "mc_return", F.concat(F.lit("episode "), F.coalesce(F.col("episode_id").cast("string"), F.lit("none"))))
    klines = value_counts(table(spark, sf_dir, "klines"), "series", "Close", F.concat(F.lit("day "), F.coalesce(F.date_format("Open_time", "yyyy-MM-dd"), F.lit("none"))))
    return bank.withColumn("src", F.lit("memory_bank")).unionByName(klines.withColumn("src", F.lit("klines")))


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, 90th and 99th percentile per action and per series, from the pieces."""
    both = p3_pieces(spark, sf_dir).withColumn("grp", F.concat_ws("/", "src", F.coalesce("grp", F.lit("(null)"))))
    out = percentiles(both).withColumn("_at", F.split("grp", "/", 2))
    return out.select(F.col("_at")[0].alias("src"), F.col("_at")[1].alias("grp"), "p", "value", "error_bound", "n")


def p3_bounded(spark: SparkSession, sf_dir: str, rel_error: float = 0.01) -> DataFrame:
    """Percentiles of memory_bank.mc_return per action from geometric buckets, held against the exact ones: whether each lies within its stated bound."""
    bank = table(spark, sf_dir, "memory_bank")
    exact = percentiles(value_counts(bank, "action", "mc_return")).select("grp", "p", "n", F.col("value").alias("exact"))
    near = percentiles(value_counts(bank, "action", "mc_return", rel_error=rel_error), rel_error=rel_error).select(F.col("grp").alias("g"), F.col("p").alias("q"), "value", "error_bound")
    both = exact.join(near, F.col("grp").eqNullSafe(F.col("g")) & (F.col("p") == F.col("q")))
    return both.select(F.coalesce("grp", F.lit("(null)")).alias("grp"), "p", "n", (F.abs(F.col("exact") - F.col("value")) <= F.col("error_bound")).alias("within"))


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other rows of each row of the bank, with their distances and returns."""
    bank = table(spark, sf_dir, "memory_bank")
    near = nearest(bank, "row_id", "state")
    return near.join(bank.select(F.col("row_id").alias("neighbour"), F.col("mc_return").alias("neighbour_return")), "neighbour").select("row_id", "rank", "neighbour", "distance", "neighbour_return")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest(table(spark, sf_dir, "memory_bank"), "row_id", "state").filter("distance <= 0.25")
    return near.select(F.least("row_id", "neighbour").alias("row_id_a"), F.greatest("row_id", "neighbour").alias("row_id_b")).distinct()


def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the rows whose id is divisible by 20, against all rows by brute force: how many there are, and whether at least 0.9 of their five nearest are found."""
    bank = table(spark, sf_dir, "memory_bank").select("row_id", "episode_id", "tick", "state")
    asked = bank.filter("row_id % 20 = 0")
    true = knn(asked, bank, k=5, self_excluded=True)
    last = true.groupBy("qid").agg(F.max("dist").alias("_far"), F.count("*").alias("_n"))
    found = nearest(bank, "row_id", "state").filter("row_id % 20 = 0").select(F.col("row_id").alias("qid"), "distance")
    hits = found.join(last, "qid").filter(F.col("distance") <= F.col("_far") * (1 + 1e-6) + 1e-9).groupBy("qid").agg(F.count("*").alias("_h"))
    return last.join(hits, "qid", "left").agg(F.count("*").alias("queries"), (F.sum(F.least(F.coalesce("_h", F.lit(0)), "_n")) / F.sum("_n") >= 0.9).alias("enough"))


def p6_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of the packing: each document with text lies in containers, piece by piece from 0, and none holds more than its capacity or two texts in one place."""
    packed = p6_containers(spark, sf_dir).withColumn("_size", F.col("token_to") - F.col("token_from"))
    by = Window.partitionBy("container").orderBy("start")
    free = packed.filter("container is not null").withColumn("_next", F.coalesce(F.lead("start").over(by), F.lit(CAPACITY))).withColumn("_fits", F.col("start") + F.col("_size") <= F.col("_next"))
    spans = free.groupBy("doc_id").agg(F.min("_fits").alias("fits"), (F.count("*") == F.max("piece") + 1).alias("whole"))
    ids = table(spark, sf_dir, "documents").select("doc_id")
    return ids.join(packed.select("doc_id").distinct(), "doc_id").join(spans, "doc_id", "left").select("doc_id", F.col("fits").isNotNull().alias("placed"), F.coalesce("fits", F.lit(True)).alias("fits"), F.coalesce("whole", F.lit(True)).alias("whole"))


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "n_tokens")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of test items, with the containment of the items in them."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "text")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(table(spark, sf_dir, "documents"), "doc_id", "source", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_judged(spark, sf_dir).filter("is_cut").select("doc_id")


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_report(p8_judged(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p3_percentiles, p3_pieces, p3_bounded, p4_found, p4_neighbours, p4_recall, p6_containers, p6_placed, p7_found, p7_leaks, p8_found, p8_judged, p8_sources)}
_VALUES = """
  SELECT 'memory_bank' AS src, coalesce(cast(action AS varchar), '(null)') AS grp, cast(mc_return AS double) AS v FROM memory_bank
   WHERE mc_return IS NOT NULL AND isfinite(mc_return)
  UNION ALL
  SELECT 'klines', coalesce(series, '(null)'), "Close" FROM klines WHERE "Close" IS NOT NULL AND isfinite("Close")"""
ORACLE = {
    "p3_bounded": f"""WITH v AS ({_VALUES}) SELECT grp, p, count(*) AS n, true AS within FROM v, (VALUES (cast(0.5 AS double)), (0.9), (0.99)) AS q(p) WHERE src = 'memory_bank' GROUP BY grp, p""",
    "p4_recall": """SELECT count(*) AS queries, true AS enough FROM memory_bank WHERE row_id % 20 = 0 AND state IS NOT NULL AND len(state) > 0 AND len(list_filter(state, lambda x: x IS NULL OR NOT isfinite(x))) = 0""",
    "p6_placed": """SELECT doc_id, text IS NOT NULL AND text <> '' AS placed, true AS fits, true AS whole FROM documents""",
    "p3_percentiles": f"""WITH v AS ({_VALUES}), r AS (SELECT *, row_number() OVER (PARTITION BY src, grp ORDER BY v) AS k, count(*) OVER (PARTITION BY src, grp) AS n FROM v)
  SELECT src, grp, p, min(v) + 0.0 AS value, cast(0 AS double) AS error_bound, n FROM r, (VALUES (cast(0.5 AS double)), (0.9), (0.99)) AS q(p)
   WHERE k >= greatest(1, ceil(round(p * n, 6))) GROUP BY src, grp, p, n""",
    "p3_pieces": """SELECT 'memory_bank' AS src, 'episode ' || coalesce(cast(episode_id AS varchar), 'none') AS piece, cast(action AS varchar) AS grp, cast(mc_return AS double) + 0.0 AS value, count(*) AS n
   FROM memory_bank WHERE mc_return IS NOT NULL AND isfinite(mc_return) GROUP BY ALL
  UNION ALL SELECT 'klines', 'day ' || coalesce(strftime(Open_time, '%Y-%m-%d'), 'none'), series, "Close" + 0.0, count(*) FROM klines WHERE "Close" IS NOT NULL AND isfinite("Close") GROUP BY ALL""",
}
