from tidemark.llm.truncation import truncated


def test_a_fragment_that_ends_many_texts_is_no_habit(spark):
    texts = ["Very " * (i % 23) + "s" * (i % 5) + f" Word{chr(97 + i % 26)}{chr(97 + i // 26)} stays in the book{chr(97 + i % 26)} today." for i in range(300)]
    cut = ["More " * (3 * i) + f"Note{chr(97 + i)} says item{chr(97 + i)} in th" for i in range(8)]
    habit = ["Many " * (3 * i + 1) + f"Mail{chr(97 + i)} sent from desk{chr(97 + i)} regards zoltan" for i in range(8)]
    rows = [(i, "s" if i < 300 else "t", t) for i, t in enumerate([*texts, *cut, *habit])]
    got = {r["id"]: r["is_cut"] for r in truncated(spark.createDataFrame(rows, "id bigint, source string, text string"), "id", "source", "text").collect()}
    assert [got[300 + i] for i in range(8)] == [True] * 8
    assert [got[308 + i] for i in range(8)] == [False] * 8
    assert not any(got[i] for i in range(300))
