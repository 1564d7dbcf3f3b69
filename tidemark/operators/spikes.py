"""Problem 2: implausible spikes, stuck values and impossible readings of each source.

Three judgements of each reading:

* physical bounds: a plain filter on the scan;
* a Hampel filter with two one-sided rolling medians in place of one around the reading, since one median can't tell
  a spike from a move that stays: the logarithm of a reading against the medians of the readings before
  and after it, in units of the source's usual moves (rolling median absolute deviation, from the median or, where levels wander,
  from the reading before; at least as large as a 90 % quantile says, for prices on a coarse grid). Far from both medians on the same side: it left the level and
  came back. A move that stays lies near the later median, a fast slide lies between;
* runs of equal readings whose length the source's own chance of a repeat can't explain.

Candles are ranked and cut into blocks with margins (see ``plans.blocks``), so a hot
source is many tasks. Runs that cross blocks are joined from one summary row a block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.blocks import ranked, with_margins
from tidemark.storage import materialize


@dataclass(frozen=True)
class Measure:
    """How a column is judged. ``positive``: zero is impossible (else it is a reading without a level)."""

    name: str
    positive: bool
    most: float
    deviations: float
    least_jump: float
    #: Usual moves: ``step`` from one reading to the next, or ``level`` around the rolling median.
    scale: str


CLOSE = Measure("Close", True, 1e12, 10.0, 0.0, "step")
VOLUME = Measure("Volume", False, 1e13, 6.0, 3.0, "level")

SIDE = 7  # readings in the median on each side
LONGEST = 3  # readings that an excursion may last
AROUND, EVERY = 513, 32  # window of the usual moves, and how often it is taken
SHORTEST_RUN = 6
CHANCE = 0.01  # expected natural runs of a source that are as long as a stuck one

_OUT = "series string, kind string, field string, _blk bigint, t bigint, a double, b double, rank bigint, size bigint, upto bigint"


def impossible(m: Measure):
    """Condition: a non-null reading that no source can give."""
    c = F.col(m.name)
    return F.isnan(c) | (c > m.most) | ((c <= 0) if m.positive else (c < 0))


def _medians(x: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the readings before, and after, each one (fewer at the ends, NaN for none)."""
    pad = np.full(side, np.nan)
    near = np.sort(np.lib.stride_tricks.sliding_window_view(np.concatenate([pad, x, pad]), side), axis=1)  # NaN last
    n = side - np.isnan(near).sum(axis=1)
    row = np.arange(len(near))
    med = np.where(n > 0, (near[row, np.maximum(n - 1, 0) // 2] + near[row, np.minimum(n // 2, side - 1)]) / 2, np.nan)
    return med[: len(x)], med[side + 1 : side + 1 + len(x)]


def _spread(v: np.ndarray) -> float:
    """A deviation that neither outliers nor a coarse price grid mislead."""
    return max(1.4826 * float(np.median(v)), float(np.quantile(v, 0.9)) / 1.645) if len(v) else np.nan


def _scales(moves: np.ndarray) -> np.ndarray:
    at = np.arange(0, len(moves), EVERY)
    local = np.array([_spread(moves[max(0, i - AROUND // 2) : i + AROUND // 2 + 1]) for i in at])
    return np.maximum(np.repeat(local, EVERY)[: len(moves)], _spread(moves))


def excursion(x: np.ndarray, m: Measure) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of log readings in order: the median before, the median after and the usual move, each at each reading."""
    before, after = _medians(x, SIDE)
    if m.scale == "step":
        moves = np.abs(np.diff(x, prepend=x[:1]))
        moves[0] = moves[1] if len(x) > 1 else 0.0
    else:
        middle = (np.where(np.isnan(before), after, before) + np.where(np.isnan(after), before, after)) / 2
        moves = np.abs(x - middle)
    return before, after, _scales(moves)


def far(x: np.ndarray, before: np.ndarray, after: np.ndarray, scale: np.ndarray, m: Measure) -> np.ndarray:
    """Whether readings lie beyond both medians on the same side, farther than the source's usual moves allow."""
    one, two = x - before, x - after
    out = np.where(np.sign(one) == np.sign(two), np.minimum(np.abs(one), np.abs(two)), 0.0)
    return np.nan_to_num(out) > np.maximum(m.deviations * np.maximum(scale, 1e-12), m.least_jump)


def _islands(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _judge(measures: tuple[Measure, ...], rows: int):
    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        series, blk = pdf["series"].iloc[0], int(pdf["_blk"].iloc[0])
        pdf = pdf.sort_values(["_rank", "first", *[m.name for m in measures]], kind="stable")
        rank, t = pdf["_rank"].to_numpy(), pdf["t"].to_numpy()
        own = rank // rows == blk
        out: dict[str, list] = {c.split()[0]: [] for c in _OUT.split(", ")}
        values = {m.name: pdf[m.name].to_numpy(dtype=float) for m in measures}
        pair = [values[m.name] for m in measures] + [np.full(len(t), np.nan)]

        def add(kind, field, mask_or_n, **cols):
            n = int(mask_or_n)
            if n:
                fixed = {"series": series, "kind": kind, "field": field, "_blk": blk}
                for c, values_ in out.items():
                    values_.extend(cols[c] if c in cols else [fixed.get(c)] * n)

        for m in measures:
            v = values[m.name]
            sound = np.isfinite(v) & (v <= m.most) & ((v > 0) if m.positive else (v >= 0))
            idx = np.flatnonzero(sound)
            idx = idx[np.diff(rank[idx], prepend=-1) != 0] if len(idx) else idx  # the first sound delivery stands for its candle
            level = idx[v[idx] > 0]
            if len(level) > 2:
                x = np.log(v[level])
                before, after, scale = excursion(x, m)
                gone = far(x, before, after, scale, m)
                for lo, hi in zip(*_islands(gone)):
                    if hi - lo > LONGEST:
                        gone[lo:hi] = False
                stays = np.zeros(len(x), dtype=bool)
                stays[far(x, before, after, scale, m) & ~gone] = True
                at = np.searchsorted(rank[level], rank)
                at_ok = (at < len(level)) & sound & (v > 0)
                at_ok[at_ok] = rank[level][at[at_ok]] == rank[at_ok]
                j = at[at_ok]
                flagged = np.zeros(len(v), dtype=bool)
                flagged[at_ok] = far(np.log(v[at_ok]), before[j], after[j], scale[j], m) & ~stays[j]
                flagged &= own
                add("spike", m.name, flagged.sum(), t=t[flagged], a=pair[0][flagged], b=pair[1][flagged])
            if not len(idx):
                continue
            seq, ranks = v[idx], rank[idx]
            new = np.concatenate([[True], seq[1:] != seq[:-1]])
            if ranks[0] // rows < blk:
                new[0] = False  # it belongs to an earlier block
            mine = ranks // rows == blk
            n = int(mine.sum())
            off = int(np.argmax(mine)) if n else 0
            starts = np.flatnonzero(new & mine)
            add("block", m.name, 1, size=[n], rank=[starts[0] - off if len(starts) else None], upto=[starts[-1] - off if len(starts) else None], t=[ranks[starts[0]] if len(starts) else None])
            if len(starts):
                ends = np.concatenate([starts[1:], [len(seq)]])
                size = (ends - starts).astype(float)
                size[-1] = np.nan  # its end may lie in a later block
                end_rank = np.concatenate([ranks[starts[1:]], [-1]])
                lens, counts = np.unique(size[:-1].astype(np.int64), return_counts=True)
                add("lengths", m.name, len(lens), size=lens, upto=counts)
                keep = np.isnan(size) | (size >= SHORTEST_RUN)
                keep &= seq[starts] != 0
                add("run", m.name, keep.sum(), a=seq[starts][keep], rank=ranks[starts][keep], size=[None if np.isnan(s) else int(s) for s in size[keep]], upto=end_rank[keep])
        return pd.DataFrame(out, dtype=object)

    return judge


def _limit(pdf: pd.DataFrame) -> pd.DataFrame:
    """From the counts of run lengths of a source: the length that its own repeats don't reach."""
    size, n = pdf["size"].to_numpy(dtype=float), pdf["n"].to_numpy(dtype=float)
    limit = np.inf
    for _ in range(4):
        ok = size < limit
        runs, equal = n[ok].sum(), (n[ok] * (size[ok] - 1)).sum()
        p = min(0.999, (equal + 0.5) / (runs + equal + 1))
        new = max(SHORTEST_RUN, 1 + np.log(max(runs, 1) / CHANCE) / -np.log(p))
        if new >= limit:
            break
        limit = new
    return pd.DataFrame({"series": [pdf["series"].iloc[0]], "field": [pdf["field"].iloc[0]], "limit": [float(limit)]})


def implausible_readings(df: DataFrame, key: str, source: str, at: str, arrived: str, measures: tuple[Measure, ...] = (CLOSE, VOLUME), rows: int = 4096, margin: int = AROUND // 2 + SIDE + 1, bucket_us: int = 3_600_000_000 * 6) -> DataFrame:
    """``key, field, reason`` of each implausible reading; reason is impossible, spike or stuck.

    Two measures at most. Each row is judged by itself; rows of one source and moment are deliveries
    of one candle, whose first sound delivery stands in the sequence, so repeats lengthen no run.
    Null readings are never flagged, nor zero where zero is possible. Rows without a source or moment
    are held against the physical bounds only. Exact repeats of a row are all flagged alike. An empty
    table gives an empty result; other columns are ignored.
    """
    names = [m.name for m in measures]
    base = df.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("series"), F.expr(f"unix_micros(cast({at} as timestamp))").alias("t"), F.expr(f"unix_micros(cast({arrived} as timestamp))").alias("first"), *[F.col(n).cast("double").alias(n) for n in names])
    bounds = None
    for m in measures:
        part = base.filter(impossible(m)).select("_key", F.lit(m.name).alias("field"), F.lit("impossible").alias("reason"))
        bounds = part if bounds is None else bounds.unionByName(part)

    distinct = (base.filter("series is not null and t is not null").groupBy("series", "t", *names).agg(F.min("first").alias("first"))
                .withColumn("_b", F.expr(f"t div {bucket_us}")))
    placed = materialize(ranked(distinct, "series", "t", "_b").drop("_b"), "candles")
    judged = materialize(with_margins(placed, "_rank", rows, margin).groupBy("series", "_blk").applyInPandas(_judge(measures, rows), _OUT), "judged")

    # runs: the end of a block's last run is the first start in a later block
    by = Window.partitionBy("series", "field").orderBy("_blk")
    blocks = judged.filter("kind = 'block'").withColumn("_off", F.coalesce(F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    after = by.rowsBetween(1, Window.unboundedFollowing)
    blocks = blocks.select("series", "field", "_blk", (F.col("_off") + F.col("upto")).alias("_last"), F.first(F.col("_off") + F.col("rank"), ignorenulls=True).over(after).alias("_next"),
                           F.first(F.when(F.col("rank").isNotNull(), F.struct("_blk", "t")), ignorenulls=True).over(after).alias("_stop"), F.sum("size").over(Window.partitionBy("series", "field")).alias("_all"))
    ends = blocks.filter("_last is not null").withColumn("_len", F.coalesce("_next", "_all") - F.col("_last"))
    counts = judged.filter("kind = 'lengths'").select("series", "field", "size", F.col("upto").alias("n")).unionByName(ends.select("series", "field", F.col("_len").alias("size"), F.lit(1).cast("bigint").alias("n")))
    limits = counts.groupBy("series", "field", "size").agg(F.sum("n").alias("n")).groupBy("series", "field").applyInPandas(_limit, "series string, field string, limit double")
    runs = (judged.filter("kind = 'run'").select("series", "field", "_blk", "a", "rank", "size", "upto").join(ends.select("series", "field", "_blk", "_len", "_stop"), ["series", "field", "_blk"], "left")
            .withColumn("size", F.coalesce("size", "_len")).join(limits, ["series", "field"]).filter("size >= limit")
            .withColumn("_to", F.when(F.col("upto") >= 0, F.col("_blk")).otherwise(F.col("_stop._blk")))
            .withColumn("_upto", F.when(F.col("upto") >= 0, F.col("upto")).otherwise(F.col("_stop.t"))))
    last_blk = placed.groupBy("series").agg(F.max(F.expr(f"_rank div {rows}")).alias("_end"))
    spans = runs.join(last_blk, "series").select("series", "field", F.col("a").alias("_value"), F.col("rank").alias("_from"), "_upto", F.explode(F.sequence("_blk", F.coalesce("_to", "_end"))).alias("_blk"))
    value = F.when(F.col("field") == names[0], F.col(names[0]))
    for n in names[1:]:
        value = value.when(F.col("field") == n, F.col(n))
    stuck = (placed.withColumn("_blk", F.expr(f"_rank div {rows}")).join(spans, ["series", "_blk"])
             .filter((F.col("_rank") > F.col("_from")) & (F.col("_upto").isNull() | (F.col("_rank") < F.col("_upto"))) & (value == F.col("_value"))))
    spikes = judged.filter("kind = 'spike'").select("series", "t", F.col("a").alias(names[0]), *([F.col("b").alias(names[1])] if len(names) > 1 else []), "field", F.lit("spike").alias("reason"))
    found = stuck.select("series", "t", *names, "field", F.lit("stuck").alias("reason")).unionByName(spikes)
    same = [base[c].eqNullSafe(found[c]) if c in names else base[c] == found[c] for c in ["series", "t", *names]]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    hits = base.join(found, cond).select(base["_key"], found["field"], found["reason"])
    return bounds.unionByName(hits).groupBy("_key", "field").agg(F.min("reason").alias("reason")).withColumnRenamed("_key", key)
