from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.packing import count_tokens, pack, plan


def naive(items, capacity):
    bins = []
    for x in sorted(items, reverse=True):
        fit = [b for b in bins if b >= x]
        if fit:
            bins.remove(min(fit))
            bins.append(min(fit) - x)
        else:
            bins.append(capacity - x)
    return Counter(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plan_is_best_fit_over_items(items):
    patterns = plan(Counter(items), 40)
    used = Counter()
    for lengths, n in patterns:
        assert sum(lengths) <= 40
        for x in lengths:
            used[x] += n
    assert used == Counter(items)
    got = Counter()
    for lengths, n in patterns:
        got[40 - sum(lengths)] += n
    assert got == naive(items, 40)


def packed(spark, lengths, capacity=100):
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "id bigint, n int, container string")
    return pack(df, "id", "n", capacity).collect()


def check(rows, lengths, capacity=100):
    cover, space = defaultdict(list), defaultdict(list)
    for r in rows:
        cover[r["id"]].append((r["token_from"], r["token_to"]))
        if r["container"] is not None:
            space[r["container"]].append((r["start"], r["start"] + r["token_to"] - r["token_from"]))
    assert set(cover) == set(range(len(lengths)))
    for i, n in enumerate(lengths):
        parts = sorted(cover[i])
        assert parts[0][0] == 0 and parts[-1][1] == (n or 0) and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert len(parts) == 1 or n > capacity
    for parts in space.values():
        parts.sort()
        assert parts[-1][1] <= capacity and all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))
    return len(space)


def test_texts_take_planned_slots(spark):
    lengths = [33] * 700 + [50] * 101 + [1, 2, 3, 99, 100, 101, 200, 250, 0, None] + list(range(1, 100))
    used = check(packed(spark, lengths), lengths)
    items = [x % 100 if x > 100 else x for x in lengths if x and (x <= 100 or x % 100)]
    assert used <= sum(naive(items, 100).values()) + sum(x // 100 for x in lengths if x and x > 100)


def test_edges(spark):
    assert packed(spark, []) == []
    assert [r["container"] for r in packed(spark, [0, None])] == [None, None]


def test_tokens_of_whole_texts(spark):
    pytest.importorskip("public_tokenizers")
    text = "Der Schlusskurs lag nahe 1.234 und fiel. " * 3000
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "a <|endoftext|> b")], "id bigint, t string")
    got = {r["id"]: r["n_tokens"] for r in count_tokens(df, "id", "t").collect()}
    assert got[2] == got[3] == 0 and got[4] > 3 and got[1] > 30_000


def test_one_length_for_half_the_texts_is_many_groups(spark):
    from pyspark.sql import functions as F

    n = 40_000
    df = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, 300).otherwise(1 + F.col("id") % 700).cast("bigint").alias("n"))
    out = pack(df, "k", "n")
    plan = out._jdf.queryExecution().toString()
    assert "_rb" in plan
    rows = out.collect()
    assert len(rows) == n and len({r["k"] for r in rows}) == n
    used = {}
    for r in rows:
        used.setdefault(r["container"], []).append((r["start"], r["start"] + r["token_to"] - r["token_from"]))
    for spans in used.values():
        spans.sort()
        assert spans[-1][1] <= 2048 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
