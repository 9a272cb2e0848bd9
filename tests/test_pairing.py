from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.functions.similarity import any_above
from blockloom.operators import pairing

FOX = "the quick brown fox jumps over the lazy dog and then sleeps " * 5


def labelled(spark, texts, title, ingredients, directions, **options):
    blocks = spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)], "file string, idx int, text string")
    labels = spark.createDataFrame(
        [("r", title, ingredients, directions)],
        "file string, title string, ingredients array<string>, directions array<string>",
    )
    rows = pairing.fuzzy_label(blocks, labels, **options).orderBy("idx").collect()
    return [r.label for r in rows]


# (block text, label) for title "Tide", ingredients and directions below; worked out by hand.
GOLDEN = [
    ("1 cup sugar ", "ingredient"),  # equal after strip and lower case
    ("1 cup of sugar", "ingredient"),  # 11 matched of 11 + 14
    ("abcd", "ingredient"),  # 4 matched of 4 + 5
    ("abcdx", "none"),  # 4 matched of 5 + 5 is 0.8, not above
    ("mix all of it", "direction"),  # 13 matched of 13 + 19
    ("mix all of", "none"),  # 10 matched of 10 + 19
    ("Mix all of it well", "direction"),
    ("tide", "title"),
    ("diet", "direction"),
    ("12", "none"),  # digits only
    (" ", "none"),
]


def test_golden_labels(spark):
    ings, dirs = ["1 Cup Sugar", "abcde"], ["Mix all of it well.", "diet", ""]
    assert labelled(spark, [t for t, _ in GOLDEN], "Tide", ings, dirs) == [label for _, label in GOLDEN]


def test_priority_of_kinds(spark):
    assert labelled(spark, ["stir it"], "Stir it", ["stir it"], ["stir it"]) == ["ingredient"]
    assert labelled(spark, ["stir it"], "Stir it", [], ["stir it"]) == ["direction"]
    assert labelled(spark, ["stir it"], "Stir it", [], []) == ["title"]
    assert labelled(spark, ["stir it"], None, None, None) == ["none"]


def test_comparison_is_not_symmetric(spark):
    """ratio(tide, diet) is 0.25 and ratio(diet, tide) 0.5; items come second, the title first."""
    assert labelled(spark, ["tide"], None, ["diet"], None, threshold=0.3) == ["none"]
    assert labelled(spark, ["diet"], None, ["tide"], None, threshold=0.3) == ["ingredient"]
    assert labelled(spark, ["tide"], "diet", None, None, threshold=0.3) == ["title"]
    assert labelled(spark, ["diet"], "tide", None, None, threshold=0.3) == ["none"]


def test_exactly_at_the_threshold_is_no_match(spark):
    assert labelled(spark, ["abcd"], None, ["abcdxx"], None) == ["none"]


def test_autojunk(spark):
    assert labelled(spark, [FOX], "", ["x" + FOX], []) == ["none"]
    assert labelled(spark, [FOX], "", ["x" + FOX], [], autojunk=False) == ["ingredient"]


words = st.text(alphabet="abcde ", max_size=30)
near = st.tuples(words, words, st.integers(0, 30)).map(lambda p: (p[0], p[0][: p[2]] + p[1][:3] + p[0][p[2]:]))
long_near = st.tuples(st.text(alphabet="abcdefgh ", min_size=190, max_size=260), st.integers(0, 200)).map(
    lambda p: (p[0], p[0][: p[1]] + "z" + p[0][p[1]:])
)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.tuples(words, words), near, long_near), st.sampled_from([0.5, 0.8, 0.95]))
def test_bounds_never_drop_a_match(pair, threshold):
    """The comparison inside the UDF, with its bounds, against the library's plain ratio."""
    import pandas as pd

    a, b = pair
    plain = SequenceMatcher(None, a, b).ratio() > threshold
    assert any_above(threshold).func(pd.Series([[a]]), pd.Series([["", b][1:]])).iloc[0] == plain
    if a and plain:
        assert 2.0 * min(len(a), len(b)) > threshold * (len(a) + len(b))


def test_pairs_and_pending(spark):
    labels = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "file string")
    pages = spark.createDataFrame([("a", 1), ("x", 2)], "file string, page_id int")
    assert [tuple(r) for r in pairing.pair(labels, pages).collect()] == [("a", 1)]
    left = {tuple(r) for r in pairing.pair_left(labels, pages).collect()}
    assert left == {("a", 1), ("b", None), ("c", None), ("d", None)}
    state = spark.createDataFrame([("a", "processed"), ("b", "failed")], "file string, status string")
    assert {r.file for r in pairing.pending(labels, state).collect()} == {"c", "d"}
    assert {r.file for r in pairing.pending(labels, state, retry_failed=True).collect()} == {"b", "c", "d"}


def test_candidates_are_not_exploded(spark):
    blocks = spark.createDataFrame([("r", 0, "abc")], "file string, idx int, text string")
    labels = spark.createDataFrame(
        [("r", None, ["ABCD"] * 3 + ["a"], None)],
        "file string, title string, ingredients array<string>, directions array<string>",
    )
    rows = pairing.fuzzy_candidates(blocks, labels).collect()
    assert len(rows) == 1 and rows[0].ing_candidates == ["abcd"] * 3 and rows[0].dir_candidates == []
    assert rows[0].title_candidate is None
