import itertools
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np

from tidemark.operators.timestamps import MOST, Rows, _ends, resolve_instants, viterbi


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "id bigint, src string, tz string, ord string, txt string")
    got = resolve_instants(df, "txt", ["id"], "src", "id", "tz", "ord", **kw).collect()
    return {r["id"]: (r["utc_ms"], r["status"]) for r in got}


def ms(*a, tz="UTC", **k):
    return int(datetime(*a, tzinfo=ZoneInfo(tz), **k).timestamp() * 1000)


CASES = [
    ("1546300859999", ms(2019, 1, 1, 0, 0, 59) + 999), ("1546300859", ms(2019, 1, 1, 0, 0, 59)), ("1546300859.5", ms(2019, 1, 1, 0, 0, 59) + 500),
    ("1546300859999999", ms(2019, 1, 1, 0, 0, 59) + 999), ("1546300859999999999", ms(2019, 1, 1, 0, 0, 59) + 999),
    ("2019-01-01T01:33:59Z", ms(2019, 1, 1, 1, 33, 59)), ("20190101T000259Z", ms(2019, 1, 1, 0, 2, 59)), ("2021-11-07T05:44:59.999-05:00", ms(2021, 11, 7, 10, 44, 59) + 999),
    ("2020-04-07 19:59:59+0000", ms(2020, 4, 7, 19, 59, 59)), ("2019-01-01 01:48:59.999 UTC", ms(2019, 1, 1, 1, 48, 59) + 999), ("2024-07-31 04:29:59 +05:30", ms(2024, 7, 30, 22, 59, 59)),
    ("Thu, 01 Sep 2022 03:59:59 GMT", ms(2022, 9, 1, 3, 59, 59)), ("1 Nov 2023 10:14:59 +0100", ms(2023, 11, 1, 9, 14, 59)), ("2022-04-09T11:29:59.999+05:30[Asia/Kolkata]", ms(2022, 4, 9, 5, 59, 59) + 999),
    ("2020-11-01 19:59:59 EST", ms(2020, 11, 2, 0, 59, 59)), ("2023-03-29 04:59:59 BST", ms(2023, 3, 29, 3, 59, 59)), ("  2019-01-01T01:33:59Z\t", ms(2019, 1, 1, 1, 33, 59)),
    # without a zone: Berlin
    ("2020-03-20T03:59:59.999000", ms(2020, 3, 20, 3, 59, 59, tz="Europe/Berlin") + 999), ("02/11/2024 12:14", ms(2024, 11, 2, 12, 14, tz="Europe/Berlin")), ("11/25/2024 12:14", ms(2024, 11, 25, 12, 14, tz="Europe/Berlin")),
    ("01.04.2022 11:14:59", ms(2022, 4, 1, 11, 14, 59, tz="Europe/Berlin")), ("20200317155959", ms(2020, 3, 17, 15, 59, 59, tz="Europe/Berlin")), ("Apr 10, 2022 12:29:59 AM", ms(2022, 4, 10, 0, 29, 59, tz="Europe/Berlin")),
    ("2022-01-02", ms(2022, 1, 2, tz="Europe/Berlin")), ("Do, 01. Dez. 2022 03:59:59 GMT", ms(2022, 12, 1, 3, 59, 59)), ("7 ene 2023 10:14:59 +0100", ms(2023, 1, 7, 9, 14, 59)),
]
NOTHING = [None, "", "n/a", "NaT", "####", "0000-00-00 00:00:00", "2024-02-30 10:15:00", "2023-13-05T00:00:00Z", "2022-06-07 25:61:00", "2022-01-01 10:00:00 XQZ", "Apr 10, 2022 13:29:59 AM", "12345", "9" * 400, "2020-03-29 02:30:00"]


def test_forms_and_precisions(spark):
    rows = [(i, "s", "Europe/Berlin", "DMY", t) for i, t in enumerate([c[0] for c in CASES] + NOTHING)]
    got = run(spark, rows)
    for i, (t, want) in enumerate(CASES):
        assert got[i] == (want, "inferred" if t == "02/11/2024 12:14" else "stated"), (t, got[i], want)
    for i in range(len(CASES), len(rows)):
        assert got[i] == (None, "none"), rows[i]


def test_clock_changes(spark):
    got = run(spark, [(0, "s", "America/New_York", "MDY", "2024-11-03 01:30:00"), (1, "s", "America/New_York", "MDY", "2024-11-03 02:30:00"), (2, "s", "America/New_York", "MDY", "2024-03-10 02:30:00"), (3, "s", "America/New_York", "MDY", "2024-11-03 01:30:00 EDT")])
    assert [got[i][1] for i in range(4)] == ["repeated", "stated", "none", "stated"]
    assert got[3][0] == ms(2024, 11, 3, 5, 30)


def test_search_infers_the_order_of_day_and_month(spark):
    at, rows = datetime(2024, 3, 1, tzinfo=timezone.utc), []
    for i in range(400):  # day and month are open on the first twelve days of a month only
        rows.append((i, "s", "UTC", None, (at + timedelta(hours=6 * i)).strftime("%m/%d/%Y %H:%M")))
    for rows_in_block in (65536, 7):
        got = run(spark, rows, block_rows=rows_in_block)
        right = sum(got[i][0] == int((at + timedelta(hours=6 * i)).timestamp() * 1000) for i in range(400))
        assert right >= 390, right


def test_blocks_give_the_cost_of_one_search(spark):
    rng = np.random.default_rng(3)
    texts = [f"{rng.integers(1, 13):02d}/{rng.integers(1, 13):02d}/2024 {rng.integers(0, 24):02d}:00" for _ in range(60)]
    rows = [(i, "s", "UTC", None, t) for i, t in enumerate(texts)]
    whole, blocks = run(spark, rows), run(spark, rows, block_rows=5)

    def cost(got):
        d = [datetime.fromtimestamp(got[i][0] / 1000, timezone.utc) for i in range(60)]
        fmt = [x.strftime("%d/%m") == t[:5] for x, t in zip(d, texts)]
        same = [t[:2] == t[3:5] for t in texts]
        return sum(2.0 * (b < a) for a, b in zip(d, d[1:])) + sum(a != b for (a, s), (b, r) in zip(zip(fmt, same), list(zip(fmt, same))[1:]) if not (s or r)), d

    assert abs(cost(whole)[0] - cost(blocks)[0]) <= 2  # equal cost up to days that read alike in both orders


def random_rows(rng, n, many=0.6):
    k = np.where(rng.random(n) < many, rng.integers(2, 4, n), 1)
    cost = np.where(np.arange(MOST) < k[:, None], rng.integers(0, 3, (n, MOST)).astype(float), np.inf)
    return Rows(rng.integers(0, 9, (n, MOST)), cost, rng.integers(0, 3, (n, MOST)))


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(60):
        rows = random_rows(rng, 6)
        price = lambda p: sum(rows.cost[i, j] for i, j in enumerate(p)) + sum(rows.step(i, i + 1)[p[i], p[i + 1]] for i in range(len(p) - 1))  # noqa: B023
        paths = list(itertools.product(*[range(int(np.isfinite(c).sum())) for c in rows.cost]))
        assert price(viterbi(rows)) == min(map(price, paths))
        ends, base = _ends(rows), None
        for a in range(int(np.isfinite(rows.cost[0]).sum())):
            for b in range(int(np.isfinite(rows.cost[-1]).sum())):
                least = min(price(p) for p in paths if p[0] == a and p[-1] == b)
                assert price(viterbi(rows, None, a, b)) == least
                base = least - ends[a, b] if base is None else base
                assert abs(least - ends[a, b] - base) < 1e-9


def test_a_declared_order_weighs_and_the_search_decides(spark):
    late = [(i, "s", "UTC", "DMY", t) for i, t in enumerate(["2024-04-02T00:00:00Z", "03/04/2024 00:00", "2024-04-04T00:00:00Z", "01/02/2024 00:00", "2024-04-05T00:00:00Z"])]
    got = run(spark, late)
    assert got[1] == (ms(2024, 4, 3), "inferred") and got[3] == (ms(2024, 2, 1), "inferred")  # a late row keeps the declared order
    none = run(spark, [(i, s, z, None, t) for i, s, z, _, t in late])
    assert none[1] == (ms(2024, 4, 3), "inferred")  # without a declaration, the order of time decides
    skipped = run(spark, [(0, "s", "America/New_York", "DMY", "10/03/2024 02:30"), (1, "s", "America/New_York", "MDY", "03/10/2024 02:30")])
    assert skipped[1] == (None, "none") and skipped[0] == (None, "none")


def test_empty_clashing_and_repeated(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(1, "s", None, None, "2019-01-01T00:00:00Z", 5, 6)] * 2, "id bigint, src string, tz string, ord string, txt string, _t int, utc_ms int")
    got = resolve_instants(df, "txt", ["id"], "src", "id", "tz", "ord").collect()
    assert len(got) == 2 and {r["utc_ms"] for r in got} == {1546300800000}
    nulls = spark.createDataFrame([(None, None, None, None, "2019-01-01T00:00:00Z")], df.select("id", "src", "tz", "ord", "txt").schema)
    assert resolve_instants(nulls, "txt", ["id"], "src", "id", "tz", "ord").first()["utc_ms"] == 1546300800000
