import numpy as np

from tidemark.operators import knn as K

SCHEMA = "row_id bigint, episode_id bigint, tick bigint, state array<float>"


def test_of_many_copies_the_smallest_row_ids_are_the_neighbours(spark):
    rng = np.random.default_rng(5)
    n = 3000
    x = rng.normal(size=(n, 10)).astype(np.float32)
    copies = np.sort(rng.permutation(n)[: n // 3])
    x[copies] = x[copies[0]]
    x[:4] = x[copies[0]] + np.float32(0.01) * rng.normal(size=(4, 10)).astype(np.float32)
    rows = [(i, i % 3, i, v.tolist()) for i, v in enumerate(x)]
    bank = spark.createDataFrame(rows, SCHEMA)
    queries = spark.createDataFrame([(10_000 + j, 0, 500, (x[i] + np.float32(s)).tolist()) for j, (i, s) in enumerate([(copies[0], 0), (copies[5], 0.001), (7, 0), (copies[9], 0.3)])], SCHEMA)
    y = {r["row_id"]: np.array(r["state"], dtype=np.float32).astype(float) for r in queries.collect()}
    for gap in (0, 100):
        got = {}
        for r in K.knn(queries, bank, min_tick_gap=gap).orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["bid"])
        away = np.array([gap > 0 and i % 3 == 0 and abs(i - 500) < gap for i in range(n)])
        for q, v in y.items():
            d = np.where(away, np.inf, np.sqrt(((x.astype(float) - v) ** 2).sum(1)))
            assert got[q] == np.lexsort((np.arange(n), d))[:25].tolist()
