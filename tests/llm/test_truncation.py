import random

from tidemark.llm.truncation import contexts, ending, source_report, truncated

SUBJECT = ["The agent", "Our replay job", "The night desk", "The policy"]
VERB = ["moved", "rejected", "closed", "averaged"]
THING = ["the stop level", "a missing candle", "the pruning step", "its position limit", "the scaled features"]
WHEN = ["overnight", "before noon", "without warning", "after the restart"]


def sentence(rng):
    return f"{rng.choice(SUBJECT)} {rng.choice(VERB)} {rng.choice(THING)} {rng.choice(WHEN)}."


def corpus(seed=0, n=1500):
    rng = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        source = ("limited", "free", "plain")[i % 3]
        text = " ".join(sentence(rng) for _ in range(rng.randint(1, 9)))
        if source == "plain" and rng.random() < 0.5:
            text = text.rstrip(".")
        if source == "limited" and len(text) > 300:
            text = text[:300]
            if not text.rstrip().endswith("."):
                cut.add(i)
        if source == "free" and rng.random() < 0.1:
            at = rng.randint(len(text) // 2, len(text) - 12)
            while text[:at].rstrip().endswith(".") or text[: at + 1].rstrip().endswith("."):
                at -= 1
            text = text[:at]
            cut.add(i)
        rows.append((i, source, text, "x"))
    return rows, cut


def judged(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, source string, text string, is_cut string")
    return truncated(df, "id", "source", "text")


def test_limits_and_endings(spark):
    rows, cut = corpus()
    got = {r["id"]: r for r in judged(spark, rows).collect()}
    flagged = {i for i, r in got.items() if r["is_cut"]}
    assert len(flagged & cut) >= 0.9 * len(cut) and len(flagged - cut) <= 0.05 * len(cut), (len(flagged & cut), len(cut), len(flagged - cut))
    assert not any(r["is_cut"] for r in got.values() if r["source"] == "plain")
    assert {r["source"] for r in got.values() if r["at_limit"]} == {"limited"}


def test_endings():
    assert ending("It was cut [more]") == "marked" and ending("Not yet (cont.)") == "marked"
    assert ending("We will see...") == "dots" and ending("More tomorrow…") == "dots"
    assert ending("Done.") == ending('He said "done."') == "sentence"
    for t in ("see https://a.invalid/x", "x (TAG)", "```\ncode\n```", "nice :)", "Rose. Signed, desk 9", "#tag"):
        assert ending(t) == "structure", t
    assert ending("one, two,") == "comma" and ending("half a wor") == "open"
    words, after = contexts("It fell 5.2 %, then rose. Up")
    assert words == ["it", "fell", "0", "percent", "then", "rose", "up"] and after[5] == 1 and after[0] == 0


def test_edges(spark):
    assert judged(spark, []).count() == 0
    rows, _ = corpus(1, 300)
    odd = [(9001, None, "no source here", "x"), (9002, "free", None, "x"), (9003, "free", "", "x"), (9004, "free", "word " * 40_000, "x"), (9005, "free", "…", "x"), (9006, "free", rows[0][2], "x"), (9006, "free", rows[0][2], "x")]
    got = judged(spark, rows + odd).collect()
    ids = [r["id"] for r in got]
    assert 9002 not in ids and 9003 not in ids and ids.count(9006) == 2 and {9001, 9004, 9005} <= set(ids)
    report = {r["source"]: r for r in source_report(judged(spark, rows)).collect()}
    assert set(report) == {"limited", "free", "plain"} and report["free"]["n"] == 100


def test_verdicts_stay_when_the_corpus_is_delivered_ten_times(spark):
    rows, _ = corpus(2, 600)
    once = {r["id"]: (r["is_cut"], r["kind"], r["at_limit"]) for r in judged(spark, rows).collect()}
    many = [(10_000 * n + i, source, text, x) for n in range(10) for i, source, text, x in rows]
    got = {r["id"]: (r["is_cut"], r["kind"], r["at_limit"]) for r in judged(spark, many).collect()}
    assert {i % 10_000 for i in got} == set(once) and all(v == once[i % 10_000] for i, v in got.items())
    same = [(r["id"], (r["is_cut"], r["kind"], r["at_limit"])) for r in judged(spark, rows * 10).collect()]  # under the same keys
    assert len(same) == 6000 and all(v == once[i] for i, v in same)


def test_kinds(spark):
    rows, cut = corpus()
    got = {r["id"]: r for r in judged(spark, rows).collect()}
    assert {got[i]["kind"] for i in cut if rows[i][1] == "limited" and got[i]["is_cut"]} == {"limit"}
    assert {r["kind"] for r in got.values() if r["source"] == "free" and r["is_cut"]} == {"transfer"}
    assert all((r["kind"] is not None) == r["is_cut"] for r in got.values())
