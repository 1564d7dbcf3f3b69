"""Problem 6: texts into containers of a fixed number of tokens.

The plan is made over the histogram of lengths, not over texts: best fit, longest
first, places all texts of a length at once, so the driver handles at most ``capacity``
lengths and a few patterns for each, whatever the number of texts. A pattern is a
list of lengths and the number of containers filled that way. Texts then take the
planned slots by their rank within their length. Ranks are made per (length, salt) with
offsets, and texts meet slots by (length, rank block), so a length that a third of the texts have is no single task.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.storage import materialize

CAPACITY = 2048
RANKS = 64  # ranks of a length that are joined to their slots at once


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key, n_tokens``: tokens of the whole text; null and empty texts have 0."""
    path = path or tokenizer_path()
    import public_tokenizers

    pattern = public_tokenizers.PATTERN

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(path, pattern)
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "n_tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["_text"]]})

    src = df.select(F.col(key), F.col(text).alias("_text"))
    return src.mapInPandas(count, T.StructType([src.schema[key], T.StructField("n_tokens", T.LongType())]))


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, number of containers) by best fit over counts, longest first.

    Same containers as best fit over single items: as long as an item fits the fullest
    open container, the next of its length goes into the same one.
    """
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}  # free space: [(run-length pattern, number)]
    frees: list[int] = []

    def put(free: int, pattern, n: int) -> None:
        if n:
            if free not in open_:
                open_[free] = []
                bisect.insort(frees, free)
            open_[free].append((pattern, n))

    for length in sorted((k for k in histogram if 0 < k <= capacity), reverse=True):
        left = histogram[length]
        at = bisect.bisect_left(frees, length)
        while left and at < len(frees):
            free = frees[at]
            each, bins = free // length, open_.pop(free)
            frees.pop(at)
            rest = []
            moved = []
            for pattern, n in bins:
                full = min(n, left // each)
                left -= full * each
                if full:
                    moved.append((free - each * length, (*pattern, (length, each)), full))
                n -= full
                if n and left and left < each:
                    moved.append((free - left * length, (*pattern, (length, left)), 1))
                    n -= 1
                    left = 0
                if n:
                    rest.append((pattern, n))
            for pattern, n in rest:
                put(free, pattern, n)
            for f, pattern, n in moved:
                put(f, pattern, n)
            at = bisect.bisect_left(frees, length)
        each = capacity // length
        if left:
            put(capacity - each * length, ((length, each),), left // each)
            if left % each:
                put(capacity - left % each * length, ((length, left % each),), 1)
    out = []
    for free in sorted(open_):
        out += [(tuple(x for ln, k in pattern for x in [ln] * k), n) for pattern, n in open_[free]]
    return out


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first container, texts of that length a container, offset of the first of them)."""
    taken: dict[int, int] = {}
    rows, container = [], 0
    for lengths, n in patterns:
        offset = 0
        for length in dict.fromkeys(lengths):
            each, start = lengths.count(length), taken.get(length, 0)
            rows.append((length, start, start + each * n, container, each, offset))
            taken[length] = start + each * n
            offset += each * length
        container += n
    return rows


def pack(df: DataFrame, key: str, n_tokens: str, capacity: int = CAPACITY, salts: int = 64) -> DataFrame:
    """``key, piece, container, start, token_from, token_to``: where each text lies.

    A text above the capacity, and only such a text, is split: into full containers of
    its own and a rest that is packed like a text. Texts without tokens (null or empty) need no
    space: their container is null. Each row is packed by itself, also where rows repeat. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    sized = df.select(F.col(key), F.coalesce(F.col(n_tokens).cast("bigint"), F.lit(0)).alias("_n"))
    whole = F.expr(f"CASE WHEN _n > {capacity} THEN _n div {capacity} ELSE 0 END")
    cut = F.explode(F.sequence(F.lit(0), whole - F.when((F.col("_n") > capacity) & (F.col("_n") % capacity == 0), 1).otherwise(0)).cast("array<int>"))
    pieces = sized.select(key, "_n", cut.alias("piece"))
    pieces = pieces.select(key, "piece", F.least(F.col("_n"), F.col("piece") * F.lit(capacity).cast("bigint")).alias("token_from"), F.least(F.col("_n"), (F.col("piece") + 1) * F.lit(capacity).cast("bigint")).alias("token_to"))
    salt = F.pmod(F.xxhash64(F.col(key), F.col("piece")), F.lit(salts))
    pieces = materialize(pieces.withColumn("_len", F.col("token_to") - F.col("token_from")).withColumn("_salt", salt), "pieces")
    counts = pieces.filter("_len > 0").groupBy("_len", "_salt").agg(F.count("*").alias("_c"))
    histogram = {r["_len"]: r["c"] for r in counts.groupBy("_len").agg(F.sum("_c").alias("c")).collect()}  # at most ``capacity`` rows
    slots = _slots(plan(histogram, capacity))
    schema = "_len bigint, _from bigint, _upto bigint, _first bigint, _each bigint, _offset bigint"
    offsets = counts.select("_len", "_salt", (F.sum("_c").over(Window.partitionBy("_len").orderBy("_salt")) - F.col("_c")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_len", "_salt").orderBy(key, "piece"))
    placed = pieces.filter("_len > 0").withColumn("_in", inside).join(offsets, ["_len", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_in") - 1)
    planned = spark.createDataFrame(slots or [(0, 0, 0, 0, 1, 0)], schema)
    planned = planned.withColumn("_rb", F.explode(F.expr(f"sequence(_from div {RANKS}, greatest(_from, _upto - 1) div {RANKS})")))
    found = placed.withColumn("_rb", F.expr(f"_rank div {RANKS}")).join(planned, ["_len", "_rb"]).filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_upto"))).withColumn("_k", F.col("_rank") - F.col("_from"))
    container = F.col("_first") + F.expr("_k div _each")
    start = F.col("_offset") + F.expr("_k % _each") * F.col("_len")
    out = found.select(key, "piece", container.alias("container"), start.alias("start"), "token_from", "token_to")
    nothing = pieces.filter("_len = 0").select(key, "piece", F.lit(None).cast("bigint").alias("container"), F.lit(None).cast("bigint").alias("start"), "token_from", "token_to")
    return out.unionByName(nothing)
