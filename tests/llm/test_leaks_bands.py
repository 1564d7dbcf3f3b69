import numpy as np

from tidemark.llm import leaks as L


def test_bands_cover_two_edits_in_sixteen_words():
    for size, n in L.PARTITIONS:
        assert (1 - 2 / (8 + size - 1)) ** n <= L.MISS


def test_simulated_misses_of_the_worst_passages():
    rng, missed, trials = np.random.default_rng(11), 0, 4000
    for _ in range(trials):
        item = rng.integers(1, 2**62, 16).astype(np.uint64)
        doc = item.copy()
        doc[[5, 10]] = rng.integers(1, 2**62, 2).astype(np.uint64)
        ahead, after = rng.integers(2, 6), rng.integers(2, 6)
        text = np.concatenate([rng.integers(1, 2**62, ahead).astype(np.uint64), doc, rng.integers(1, 2**62, after).astype(np.uint64)])
        domain, windows = L.shingles(text)[:16], [L.shingles(item[i : i + 12]) for i in range(5)]
        if len(set(domain.tolist()) & {x for w in windows for x in w.tolist()}) < 2:
            continue
        n = dict(L.PARTITIONS)[16]
        missed += not any(L._permuted(domain, j).min() in {L._permuted(w, j).min() for w in windows} for j in range(n))
    assert missed / trials <= 2 * L.MISS
