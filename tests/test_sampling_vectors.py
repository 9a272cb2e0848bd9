import hashlib
import math

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from blockloom.operators import sampling, vectors


def population(spark, **sizes):
    rows = [(f"{c}{i}", c) for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "k string, label string")


def counts(df):
    return {r.label: r["count"] for r in df.groupBy("label").count().collect()}


def test_balance(spark):
    df = population(spark, none=100, ingredient=20, direction=10, title=1)
    balanced = sampling.balance_classes(df, ["k"])
    assert counts(balanced) == {"none": 93, "ingredient": 20, "direction": 10, "title": 3}
    rows = balanced.collect()
    assert {r.k for r in rows if r.label == "title"} == {"title0"}
    assert sorted(r.copy for r in rows if r.label == "title") == [0, 1, 2]
    none = [r.k for r in rows if r.label == "none"]
    assert len(set(none)) == 93
    again = sampling.balance_classes(df.repartition(9), ["k"]).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    other = sampling.balance_classes(df, ["k"], seed=1).collect()
    assert {r.k for r in other if r.label == "none"} != set(none)


def test_balance_draws_with_replacement(spark):
    df = population(spark, none=10, ingredient=1000, title=40)
    balanced = sampling.balance_classes(df, ["k"])
    target = int(1040 / 2 * 0.33)
    assert counts(balanced) == {"none": 10, "ingredient": 1000, "title": target}
    drawn = balanced.where("label = 'title'")
    assert 20 < drawn.select("k").distinct().count() < 41


@pytest.mark.parametrize("sizes,want", [
    ({"none": 5}, {}),
    ({"title": 5}, {"title": 5}),
    ({"none": 5, "title": 5}, {"none": 5, "title": 5}),
])
def test_balance_edges(spark, sizes, want):
    assert counts(sampling.balance_classes(population(spark, **sizes), ["k"])) == want


@pytest.mark.parametrize("residue,bits", [(10_000, 16), (1, 16), (3, 4), (40, 4), (0, 8)])
def test_down_sampling_by_radix(spark, monkeypatch, residue, bits):
    """Whatever is ranked in the end, the rows with the least hashes stay."""
    monkeypatch.setattr(sampling, "RESIDUE", residue)
    monkeypatch.setattr(sampling, "_RADIX_BITS", bits)
    df = population(spark, none=400, ingredient=30, title=25).unionByName(spark.createDataFrame([("x", None)], "k string, label string").select(*population(spark, none=1).columns))
    got = sampling.balance_classes(df, ["k"], ratio=2, floor=0.5).collect()
    names = sorted((f"none{i}" for i in range(400)), key=lambda k: hashlib.md5(f"42:{k}".encode()).hexdigest())
    plan = {r["label"]: r["target"] for r in sampling.class_plan(df, ratio=2, floor=0.5).collect()}
    assert sorted(r.k for r in got if r.label == "none") == sorted(names[: plan["none"]])
    assert [r.k for r in got if r.label is None] == ["x"]


def test_split(spark):
    df = spark.range(20_000).select(F.col("id"), (F.col("id") % 50).alias("page"))
    split = sampling.train_test_split(df, ["id"])
    share = split.where("part = 'test'").count() / 20_000
    assert abs(share - 0.2) < 0.02
    assert split.exceptAll(sampling.train_test_split(df.repartition(7), ["id"])).count() == 0
    by_page = sampling.train_test_split(df, ["page"])
    assert by_page.groupBy("page").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0


def test_shuffle_and_limits(spark):
    df = spark.range(100).toDF("page_id").withColumn("idx", F.lit(0))
    order = [r.page_id for r in sampling.shuffle(df, ["page_id"]).collect()]
    assert sorted(order) == list(range(100)) and order != list(range(100))
    assert order == [r.page_id for r in sampling.shuffle(df.repartition(3), ["page_id"]).collect()]
    assert [r.page_id for r in sampling.limit_blocks(df, 3).collect()] == [0, 1, 2]
    assert sorted(r.page_id for r in sampling.limit_files(df, 2).collect()) == [0, 1]


DOCS = ["Two cups of milk", "two CUPS", "a ½ x1_y ét ét", ""]


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "k int, text string")
    weights = {(r.k, r.term): r.weight for r in vectors.tfidf_weights(df, ["k"]).collect()}
    terms = {0: ["two", "cups", "of", "milk", "two cups", "cups of", "of milk"], 1: ["two", "cups", "two cups"],
             2: ["x1_y", "ét", "x1_y ét", "ét ét"], 3: []}
    assert {t for k, t in weights if k == 0} == set(terms[0])
    assert {t for k, t in weights if k == 2} == set(terms[2])
    df_of = {t: sum(t in ts for ts in terms.values()) for ts in terms.values() for t in ts}
    for k, ts in terms.items():
        tf = {t: (2 if (k, t) == (2, "ét") else 1) for t in ts}
        raw = {t: tf[t] * (math.log(5 / (1 + df_of[t])) + 1) for t in ts}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        for t in ts:
            assert weights[(k, t)] == pytest.approx(raw[t] / norm)


def test_vocabulary_is_cut_by_count_then_term(spark):
    df = spark.createDataFrame([("bb aa",), ("cc",), ("bb",)], "text string")
    assert [(r.term, r.tf) for r in vectors.tfidf_vocab(df, max_terms=3).collect()] == [("bb", 2), ("aa", 1), ("bb aa", 1)]


def test_rows_have_length_one(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = vectors.tfidf_weights(df, ["doc_id"]).groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("n"))
    assert rows.where(F.abs(F.col("n") - 1) > 1e-9).count() == 0 and rows.count() > 150


def feature_rows(spark, tags):
    from blockloom.operators.features import block_features

    rows = [(f"some text {i}", t, 1, [], "", i, len(tags), None) for i, t in enumerate(tags)]
    return block_features(spark.createDataFrame(
        rows, "text string, tag string, depth int, class array<string>, id string, idx int, n_blocks int, section string"))


def test_structured_vectors(spark):
    model = vectors.fit_structured(feature_rows(spark, ["p", "p", "h1"]))
    names = vectors.structured_names(model)
    assert names[:3] == ["tag=h1", "tag=p", "parent_tag=None"] and len(names) == 2 + 16  # tags, parent tag, 15 numbers
    rows = model.transform(feature_rows(spark, ["h1", "section", None])).orderBy("idx")
    known, unseen, none = (r.structured.toArray() for r in rows.collect())
    assert known[:2].tolist() == [1, 0] and unseen[:2].tolist() == none[:2].tolist() == [0, 0]
    assert len(known) == len(names) and known[2] == unseen[2] == 1
    found = {(r.idx, r.key): r.value for r in vectors.vector_entries(rows, ["idx"], "structured", names).collect()}
    assert found[0, "tag=h1"] == 1 and not any(k.startswith("tag=") for i, k in found if i)
    assert found == {(i, n): v[j] for i, v in enumerate([known, unseen, none]) for j, n in enumerate(names) if v[j]}


def test_only_the_most_frequent_tags_have_places(spark):
    model = vectors.fit_structured(feature_rows(spark, ["a", "b", "b", "c", "c", "c"]), max_tags=2)
    assert vectors.structured_names(model)[:3] == ["tag=b", "tag=c", "parent_tag=None"]


def test_entries_of_dense_and_sparse_vectors(spark):
    from pyspark.ml.linalg import Vectors

    rows = [(1, Vectors.dense([0.0, 2.0, 3.0])), (2, Vectors.sparse(3, [0, 2], [1.5, 0.0])), (3, Vectors.sparse(3, [], []))]
    found = vectors.vector_entries(spark.createDataFrame(rows, ["k", "v"]), ["k"], "v", ["x", "y", "z"]).collect()
    assert sorted(map(tuple, found)) == [(1, "y", 2.0), (1, "z", 3.0), (2, "x", 1.5)]


def test_feature_union(spark):
    rows = feature_rows(spark, ["p", "h1"])
    vec = PipelineModel(vectors.fit_vectors(rows)).transform(rows).select("structured", "tfidf", "features").first()
    assert vec.features.size == vec.structured.size + vec.tfidf.size


@pytest.mark.parametrize("max_terms", [1, 5, 40, 300])
def test_pruned_vocabulary_equals_full_counts(spark, max_terms):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    full = vectors.term_counts(df, "text").orderBy(F.desc("tf"), "term").limit(max_terms).collect()
    assert vectors.tfidf_vocab(df, "text", max_terms).collect() == full
    if max_terms == 300:
        assert any(" " in r.term for r in full)


def test_balanced_rows_can_be_shuffled(spark):
    from blockloom.operators import sampling

    rows = [(i, "none" if i % 4 else "a") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, label string")
    plain = sampling.balance_classes(df, ["id"])
    mixed = sampling.balance_classes(df, ["id"], shuffled=True).collect()
    assert sorted(map(tuple, mixed)) == sorted(map(tuple, plain.collect()))
    assert mixed != sorted(mixed) and mixed == sampling.balance_classes(df, ["id"], shuffled=True).collect()


def test_pairs_are_not_shuffled_before_they_are_counted(spark, monkeypatch):
    """Words that pairs are looked up in go to all tasks whatever Spark guesses of their size; too many do not. Same terms."""
    from blockloom.operators import vectors

    texts = [(f"red lamp {i % 5} red lamp by word{i % 40} then word{i % 7} red",) for i in range(200)]
    df = spark.createDataFrame(texts, "text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = vectors.tfidf_vocab(df, max_terms=12)
        assert "SortMergeJoin" not in found._jdf.queryExecution().sparkPlan().toString()
        monkeypatch.setattr(vectors, "BROADCAST_WORDS", 0, raising=False)
        plain = vectors.tfidf_vocab(df, max_terms=12)
        assert "SortMergeJoin" in plain._jdf.queryExecution().sparkPlan().toString()
        assert found.collect() == plain.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
