"""Rank the moments of each source and cut them into blocks of bounded size with margins.

No window ever runs over a whole source: moments are counted by time bucket, the
counts of the buckets (one row a bucket) are summed up per source, and rows are
ranked inside their bucket. So a source that holds a third of all rows is spread
over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, source: str, at: str, bucket: str, out: str = "_rank") -> DataFrame:
    """Add ``out``: the rank of the moment ``at`` among its source's distinct moments, from 0.

    ``bucket`` is a column that never falls as ``at`` rises; a bucket should hold a bounded number of rows.
    """
    inside = F.dense_rank().over(Window.partitionBy(source, bucket).orderBy(at))
    sized = df.groupBy(source, bucket).agg(F.count_distinct(at).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(source).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sized.select(source, bucket, F.coalesce(before, F.lit(0)).alias("_before"))
    return df.withColumn("_in", inside).join(offsets, [source, bucket]).withColumn(out, F.col("_before") + F.col("_in") - 1).drop("_in", "_before")


def with_margins(df: DataFrame, rank: str, rows: int, margin: int, out: str = "_blk") -> DataFrame:
    """Each row once for its own block of ``rows`` ranks and once for a neighbour whose margin it lies in."""
    own = F.expr(f"{rank} div {rows}")
    near = F.array(own, F.when((F.col(rank) % rows < margin) & (own > 0), own - 1), F.when(F.col(rank) % rows >= rows - margin, own + 1))
    return df.withColumn(out, F.explode(F.array_compact(near)))


def neighbourhood(df: DataFrame, source: str, rank: str, back: int, ahead: int = 0, rows: int = 4096) -> tuple[DataFrame, Window]:
    """For windows that reach a bounded number of ranks: rows copied into the blocks that need them, and the window.

    Evaluate frames of at most ``back`` and ``ahead`` rows over the window, then keep ``_own`` rows. The window is
    partitioned by block, so a hot source isn't one task.
    """
    own = F.expr(f"{rank} div {rows}")
    blocks = F.array(own, F.when(F.col(rank) % rows >= rows - back, own + 1) if back else F.lit(None), F.when((F.col(rank) % rows < ahead) & (own > 0), own - 1) if ahead else F.lit(None))
    out = df.withColumn("_blk", F.explode(F.array_compact(blocks))).withColumn("_own", F.col("_blk") == own)
    return out, Window.partitionBy(source, "_blk").orderBy(rank)


def running(df: DataFrame, source: str, rank: str, value: str, how: str, out: str, rows: int = 4096) -> DataFrame:
    """Running ``sum`` or ``max`` of a column over a source's ranks, by block totals and offsets."""
    agg = {"sum": F.sum, "max": F.max}[how]
    b = df.withColumn("_rb", F.expr(f"{rank} div {rows}"))
    totals = b.groupBy(source, "_rb").agg(agg(value).alias("_t"))
    before = agg("_t").over(Window.partitionBy(source).orderBy("_rb").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(source, "_rb", before.alias("_before"))
    inside = agg(value).over(Window.partitionBy(source, "_rb").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    joined = b.withColumn("_inside", inside).join(offsets, [source, "_rb"])
    both = F.coalesce(F.col("_before"), F.lit(0.0)) + F.col("_inside") if how == "sum" else F.greatest("_before", "_inside")
    return joined.withColumn(out, both).drop("_rb", "_inside", "_before")


def next_rank(df: DataFrame, source: str, rank: str, out: str, rows: int = 4096) -> DataFrame:
    """Add the rank of the source's next row (rows may lie any number of ranks apart); null for its last row."""
    b = df.withColumn("_nb", F.expr(f"{rank} div {rows}"))
    firsts = b.groupBy(source, "_nb").agg(F.min(rank).alias("_first"))
    later = firsts.select(source, "_nb", F.lead("_first").over(Window.partitionBy(source).orderBy("_nb")).alias("_later"))
    inside = F.lead(rank).over(Window.partitionBy(source, "_nb").orderBy(rank))
    return b.withColumn("_inside", inside).join(later, [source, "_nb"]).withColumn(out, F.coalesce("_inside", "_later")).drop("_nb", "_inside", "_later")
