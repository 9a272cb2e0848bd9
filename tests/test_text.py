import pytest
from pyspark.sql import functions as F

from blockloom.functions.text import clean_items, contains_any, is_boilerplate_item, is_digits, nonblank_items, strip
from blockloom.operators.features import FeatureRules, block_features, dict_vectorize, quantity_number


def column(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_quantity_number(spark):
    texts = ["⅔ cup", "one cup", "two cups", "Two cups", "⅓ cup", "network", "٣"]
    assert column(spark, texts, quantity_number) == [False, False, True, False, True, False, True]
    assert column(spark, texts[:2], lambda c: quantity_number(c, fix=True)) == [True, True]


def features(spark, text):
    df = spark.createDataFrame(
        [(text, "p", 1, [], "", 0, 1, None)],
        "text string, tag string, depth int, class array<string>, id string, idx int, n_blocks int, section string",
    )
    return block_features(df).first()


@pytest.mark.parametrize("text,expected", [("½ cup", False), ("² x", True), ("٣", True), ("a1", False)])
def test_starts_with_digit(spark, text, expected):
    assert features(spark, text).starts_with_digit is expected


def test_units_are_whole_words(spark):
    texts = {"1 g salt": 1, "sugar": 0, "10-oz can": 1, "Cups": 1, "½l": 0, "l": 1, "cup_s": 0}
    assert {t: features(spark, t).contains_unit for t in texts} == texts


def test_counts(spark):
    row = features(spark, "1, ²3. a,b 🍋")
    assert (row.text_len, row.num_digits, row.comma_count, row.dot_count) == (12, 3, 2, 1)


def test_boilerplate_items(spark):
    texts = ["For the sauce", "Calories: 12", "Fat- 3", "Fat\\3", "Fat 3", "Total fat: 3", " for the x", None]
    assert column(spark, texts, is_boilerplate_item)[:7] == [True, True, True, True, False, False, True]


def test_item_cleaning(spark):
    df = spark.createDataFrame([(["0", "Mix ", " ", "", "\xa0Ⅳ　", "²"],), (None,)], "v array<string>")
    rows = df.select(clean_items(F.col("v")).alias("c"), nonblank_items(F.col("v")).alias("n")).collect()
    assert rows[0].c == ["mix", "ⅳ"]
    assert rows[0].n == ["0", "mix ", " ", "\xa0ⅳ　", "²"]
    assert rows[1].c == [] and rows[1].n == []


def test_strip_and_digits_agree_with_python(spark):
    texts = [" a b\x1c", "\x85", "٣²", "½", "", "1 2", "①"]
    assert column(spark, texts, strip) == [t.strip() for t in texts]
    assert column(spark, texts, is_digits) == [t.isdigit() for t in texts]


def test_contains_any(spark):
    df = spark.createDataFrame([("a bc", ["", "bc"]), ("abc", [""]), ("abc", None)], "t string, i array<string>")
    assert [r[0] for r in df.select(contains_any(F.col("t"), F.col("i"))).collect()] == [True, False, False]


def test_dict_vectorize(spark):
    df = spark.createDataFrame([(1, "p", 2, True)], "k int, tag string, depth int, flag boolean")
    rows = dict_vectorize(df, ["k"], ("tag", "depth", "flag")).collect()
    assert {(r.key, r.value) for r in rows} == {("tag=p", 1.0), ("depth", 2.0), ("flag", 1.0)}


def test_feature_rules_are_literal(spark):
    df = spark.createDataFrame(
        [("x", "p", 1, ["a.b"], "AXB", 0, 1, None)],
        "text string, tag string, depth int, class array<string>, id string, idx int, n_blocks int, section string",
    )
    row = block_features(df, FeatureRules(ingredient=("a.b",), direction=("a.x",), title=("axb",))).first()
    assert (row.class_has_ing_keyword, row.class_has_dir_keyword, row.class_has_title_keyword) == (1, 0, 1)
