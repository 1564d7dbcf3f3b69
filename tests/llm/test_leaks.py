import random

import numpy as np

from tidemark.llm.leaks import _hashed, leaks, shingles, verified, words_of


def word(rng):
    return "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))


def items(rng, n=20):
    shared = " Give the result as a plain number without units and round it to four places."
    return [(i, " ".join(word(rng) for _ in range(rng.randint(14, 60))) + "." + shared) for i in range(n)]


def edited(rng, words, edits):
    words = list(words)
    for at in sorted(rng.sample(range(1, len(words) - 1), edits), reverse=True):
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = word(rng)
        elif kind == 1:
            words.insert(at, word(rng))
        else:
            del words[at]
    return words


def found(spark, docs, its):
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, item_id int").drop("item_id")
    return {(r["doc_id"], r["item_id"]) for r in leaks(d, spark.createDataFrame(its, "item_id bigint, text string"), "doc_id", "text", "item_id", "text").collect()}


def test_passages(spark):
    rng = random.Random(4)
    its = items(rng)
    docs, want = [], set()
    for k in range(400):
        i, t = rng.choice(its)
        own = t.split(".")[0].split()
        noise = lambda n: [word(rng) for _ in range(n)]
        n = rng.randint(12, len(own))
        at = rng.randint(0, len(own) - n)
        passage = edited(rng, own[at : at + n], rng.randint(0, n // 8)) if k % 2 else own[at : at + n]
        text = noise(rng.choice([0, 3, 500])) + passage + noise(rng.choice([0, 4, 300]))
        docs.append((k, " ".join(text)))
        want.add((k, i))
    for k in range(400, 500):  # too short, or the shared instruction only
        i, t = rng.choice(its)
        docs.append((k, " ".join([word(rng) for _ in range(30)] + (t.split()[:9] if k % 2 else t.split(".")[1].split()) + [word(rng) for _ in range(30)])))
    got = found(spark, docs, its)
    assert not {g for g in got if g[0] >= 400}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) == 0


def test_noise_of_form(spark):
    rng = random.Random(5)
    its = items(rng, 3)
    own = its[0][1].split(".")[0].split()
    styled = "<b>" + "</b> ​\n **".join(w.upper() for w in own[:14]) + "**"
    wide = " ".join("".join(chr(ord(c) + 0xFEE0) for c in w) for w in own[:14])
    soft = " ".join(w[:2] + "­" + w[2:] for w in own[:14])
    assert found(spark, [(1, styled), (2, wide), (3, soft), (4, None), (5, ""), (6, "x " * 50_000 + " ".join(own[:13])), (7, " ".join(own[:14])), (7, " ".join(own[:14]))], its) == {(i, 0) for i in (1, 2, 3, 6, 7)}


def test_edges(spark):
    rng = random.Random(6)
    its = items(rng, 3)
    assert found(spark, [], its) == set()
    assert found(spark, [(1, its[0][1])], [(1, None), (2, ""), (3, "short text")]) == set()
    same = [(1, its[0][1]), (2, its[0][1]), (3, its[1][1])]
    assert found(spark, [(9, its[0][1])], same) == {(9, 1), (9, 2)}


def test_search_against_brute_force(spark):
    rng = random.Random(7)
    its = items(rng, 10)
    docs, want = [], set()
    for n in range(300):
        i, t = rng.choice(its)
        own = words_of(t.split(".")[0])
        at = rng.randint(0, len(own) - 13)
        words = [word(rng) for _ in range(rng.randint(0, 60))] + edited(rng, own[at : at + 13], 1) + [word(rng) for _ in range(rng.randint(0, 60))]
        docs.append((n, " ".join(words)))
        if verified(_hashed(own), _hashed(words)):
            want.add((n, i))
    got = found(spark, docs, its)
    assert len(want) > 200 and got <= want and len(want - got) <= 0.02 * len(want)


def test_containment_is_exact(spark):
    rng = random.Random(8)
    its = [(i, " ".join(word(rng) for _ in range(20)) + ".") for i in range(3)]
    own = words_of(its[1][1])
    d = spark.createDataFrame([(1, " ".join(own[:14])), (2, " ".join([*own, "x", *own]))], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in leaks(d, spark.createDataFrame(its, "item_id bigint, text string"), "doc_id", "text", "item_id", "text").collect()}
    n = len(set(shingles(_hashed(own)).tolist()))
    assert (got[1]["shared"], got[1]["containment"]) == (10, 10 / n) and got[2]["containment"] == 1.0


def test_short_shared_instructions_and_long_tags(spark):
    rng = random.Random(9)
    its = [(i, " ".join(word(rng) for _ in range(20)) + ". Answer with one letter and give no other words here.") for i in range(4)]
    own, shared = its[0][1].split(".")[0].split(), its[0][1].split(". ")[1]
    tag = "<span data-x='" + "y" * 900 + "'>"
    docs = [(1, " ".join(own[-3:]) + ". " + shared), (2, " ".join(own[:6]) + " " + tag + " " + " ".join(own[6:12])), (3, " ".join(own[-9:]) + ". " + shared)]
    assert found(spark, docs, its) == {(2, 0)}
