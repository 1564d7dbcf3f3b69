"""Problem 3: percentiles of very large numeric columns per group, from pieces that combine.

Cumulative frequencies in SQL. Rows shrink to counts per (group, value) before
anything is shuffled; counts of pieces (days, episodes, partitions) add up, so a piece
is itself a table of counts. The counts are sorted by range, each range sums up its own
counts per group, the sums of the ranges before it are added, and the first value whose
running count reaches a rank is the percentile.

Error: with ``rel_error = 0`` the percentile is an exact value of the column (the
smallest whose rank is at least p * n), its bound is 0. With ``rel_error > 0`` values
are first mapped to geometric buckets, so that a group has a bounded number of counts
however many rows it has; the result then lies within ``rel_error * abs(value)`` of the exact one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import materialize

PERCENTILES = (0.5, 0.9, 0.99)
#: Values nearer to zero than this share one bucket in the bounded mode.
SMALLEST = 1e-30


def _bucket(v: Column, rel_error: float) -> Column:
    """The middle, in relative terms, of the geometric bucket of a value."""
    if rel_error <= 0:
        return v + F.lit(0.0)  # -0.0 becomes 0.0
    gamma = (1 + rel_error) / (1 - rel_error)
    size = F.ceil(F.log(F.abs(v)) / math.log(gamma))
    return F.when(F.abs(v) < SMALLEST, F.lit(0.0)).otherwise(F.signum(v) * F.pow(F.lit(gamma), size) * (2 / (1 + gamma)))


def _bound(v: Column, rel_error: float) -> Column:
    """How far the true value can lie from that of its bucket."""
    if rel_error <= 0:
        return F.lit(0.0)
    return F.when(v == 0, F.lit(SMALLEST)).otherwise(F.abs(v) * rel_error / (1 - rel_error) * (1 + 1e-9))


def value_counts(df: DataFrame, group: str, value: str, piece: Column | None = None, rel_error: float = 0.0) -> DataFrame:
    """The piece of a percentile: ``piece, grp, value, n``. Null, NaN and infinite values are left out; a null group is a group."""
    v = F.col(value).cast("double")
    base = df.select((piece if piece is not None else F.lit("all")).cast("string").alias("piece"), F.col(group).cast("string").alias("grp"), v.alias("value"))
    base = base.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    return base.withColumn("value", _bucket(F.col("value"), rel_error)).groupBy("piece", "grp", "value").agg(F.count("*").alias("n"))


def percentiles(counts: DataFrame, ps: tuple[float, ...] = PERCENTILES, rel_error: float = 0.0) -> DataFrame:
    """``grp, p, value, error_bound, n`` from counts of any pieces.

    A group without a finite value has no row; ties are one value; an empty table gives an empty result.
    ``n`` is the number of values of the group.
    """
    spark = counts.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    added = counts.groupBy("grp", "value").agg(F.sum("n").alias("n"))
    ordered = added.repartitionByRange(parts, "grp", "value").withColumn("_part", F.spark_partition_id())
    ordered = materialize(ordered, "frequencies")  # the numbers of the ranges must stay the same below
    sums = ordered.groupBy("grp", "_part").agg(F.sum("n").alias("_n"))
    own = Window.partitionBy("grp").orderBy("_part")
    offsets = sums.select("grp", "_part", (F.sum("_n").over(own) - F.col("_n")).alias("_before"), F.col("_n"), F.sum("_n").over(Window.partitionBy("grp")).alias("_all"))
    # only the range in which a rank falls is summed up value by value
    ranks = offsets.select("*", F.explode(F.array(*[F.lit(float(p)) for p in ps])).alias("p")).withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.round(F.col("p") * F.col("_all"), 6))))
    wanted = ranks.filter((F.col("_rank") > F.col("_before")) & (F.col("_rank") <= F.col("_before") + F.col("_n"))).select("grp", "_part", "p", "_rank", "_before", "_all")
    some = ordered.join(wanted.select("grp", "_part").distinct().withColumnRenamed("grp", "_g").withColumnRenamed("_part", "_q"), F.col("grp").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_q")), "left_semi")
    running = some.withColumn("_sum", F.sum("n").over(Window.partitionBy("grp", "_part").orderBy("value")))
    w = wanted.select(F.col("grp").alias("_g"), F.col("_part").alias("_q"), "p", "_rank", "_before", "_all")
    hit = running.join(w, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_q"))).filter(F.col("_before") + F.col("_sum") >= F.col("_rank"))
    return hit.groupBy("grp", "p").agg(F.min("value").alias("value"), F.max("_all").alias("n")).select("grp", "p", "value", _bound(F.col("value"), rel_error).alias("error_bound"), "n")
