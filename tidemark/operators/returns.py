"""Discounted returns and the memory bank: append, prune, statistics, save and load."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.config import DEFAULT, EngineConfig


def discounted_returns(df: DataFrame, episode: str, rank: str, reward: str, out: str = "mc_return", cfg: EngineConfig = DEFAULT, rows: int = 512) -> DataFrame:
    """``G_t = r_t + gamma G_{t+1}`` over the ranks of an episode.

    Exact for any length: inside blocks of ``rows`` ranks the closed form can't underflow; the sum of each
    later block that still counts is carried back, so work grows with the blocks.
    """
    g = cfg.gamma
    b = df.withColumn("_gb", F.expr(f"{rank} div {rows}")).withColumn("_gi", F.col(rank) % rows)
    after = Window.partitionBy(episode, "_gb").orderBy("_gi").rowsBetween(0, Window.unboundedFollowing)
    power = F.pow(F.lit(g), F.col("_gi"))
    b = b.withColumn("_own", F.sum(power * F.col(reward)).over(after) / power)
    starts = b.groupBy(episode, "_gb").agg(F.sum(power * F.col(reward)).alias("_s"))
    # G at the start of the next block, from the sums of later blocks; with a discount, those so far that it is below any double don't count
    whole = Window.partitionBy(episode).orderBy("_gb")
    if g >= 1:
        later = F.coalesce(F.sum("_s").over(whole.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
        carried = starts.select(episode, "_gb", later.alias("_next"))
    else:
        reach = max(1, math.ceil(745 / (rows * -math.log(g)))) if g > 0 else 1
        near = F.collect_list(F.struct("_gb", "_s")).over(whole.rangeBetween(1, reach))
        term = lambda a, x: a + x["_s"] * F.pow(F.lit(g), ((x["_gb"] - F.col("_gb") - 1) * rows).cast("double"))
        carried = starts.withColumn("_near", near).select(episode, "_gb", F.aggregate("_near", F.lit(0.0), term).alias("_next"))
    joined = b.join(carried, [episode, "_gb"])
    return joined.withColumn(out, F.col("_own") + F.pow(F.lit(g), F.lit(rows) - F.col("_gi")) * F.col("_next")).drop("_gb", "_gi", "_own", "_next")


def append(bank: DataFrame, rows: DataFrame) -> DataFrame:
    """Bag union by name; nothing is removed."""
    return bank.unionByName(rows, allowMissingColumns=True)


def prune(bank: DataFrame, target: int, seed: int = 0, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """At most ``target`` rows: half from returns above the threshold, the rest from the others, no row twice.

    Rows are chosen by a seeded hash; a shortage of one stratum is filled from the other. Null returns are noise.
    The cap is the operator's purpose (a bank of bounded size).
    """
    b = bank.withColumn("_s", F.coalesce(F.abs("mc_return") > cfg.signal_threshold, F.lit(False))).withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string"))))
    n = {r["_s"]: r["count"] for r in b.groupBy("_s").count().collect()}
    signal, noise = n.get(True, 0), n.get(False, 0)
    if signal + noise <= target:
        return bank
    keep_s = min(signal, target // 2)
    keep_n = min(noise, target - keep_s)
    keep_s = min(signal, target - keep_n)
    parts = [b.filter(F.col("_s") == flag).orderBy("_h", "row_id").limit(k) for flag, k in ((True, keep_s), (False, keep_n))]
    return parts[0].unionByName(parts[1]).drop("_s", "_h")


def sample_rows(df: DataFrame, n: int, seed: int = 0, key: str = "row_id") -> DataFrame:
    """``n`` rows without replacement (all, if there are fewer), by a seeded hash of the key: the same whatever the partitioning."""
    return df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).orderBy("_h", key).limit(n).drop("_h")


def bank_statistics(bank: DataFrame) -> DataFrame:
    r = F.when(~F.isnan("mc_return") & (F.abs("mc_return") < float("inf")), F.col("mc_return").cast("double"))
    return bank.agg(F.count("*").alias("n"), F.avg(r).alias("mean_return"), F.stddev_pop(r).alias("std_return"), *[F.count_if(F.col("action") == a).alias(f"n_action_{a}") for a in range(4)])


def save_bank(bank: DataFrame, path: str, config: dict) -> None:
    """Two tables below ``path``: the rows and one row of configuration."""
    bank.write.mode("overwrite").parquet(f"{path}/rows")
    spark = bank.sparkSession
    spark.createDataFrame([tuple(config.get(f.name) for f in schemas.BANK_CONFIG)], schemas.BANK_CONFIG).write.mode("overwrite").parquet(f"{path}/config")


def load_bank(spark, path: str) -> tuple[DataFrame, dict]:
    """Rows and configuration; legacy fields get their defaults, a missing path an empty bank."""
    defaults = {"eps_dist": 1e-3, "max_weight_ratio": 50.0, "min_tick_gap": 0, "next_episode_id": 0}
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    if not fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], schemas.BANK), defaults
    raw = spark.read.parquet(f"{path}/rows")
    cols = [F.col(f.name).cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType) for f in schemas.BANK]
    rows = raw.select(*[c.alias(f.name) for c, f in zip(cols, schemas.BANK)]).withColumn("tick", F.coalesce("tick", F.lit(0).cast("bigint"))).withColumn("episode_id", F.coalesce("episode_id", F.lit(-1).cast("bigint")))
    conf = spark.read.parquet(f"{path}/config").first().asDict()
    return rows, defaults | {k: v for k, v in conf.items() if v is not None or k not in defaults}
