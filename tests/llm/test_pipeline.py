import importlib
import sys

import pytest
from conftest_llm import invented

ITEM = "one quick brown fox jumps over that lazy dog and then it sleeps under an old tree until night falls again"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("corpus"))
    passage = "\n".join(f"shared line number {w} of this very long passage." for w in "abcdefgh")
    docs = [(i, invented(i, 150), "en", "s", 1) for i in range(12)]
    docs += [(20, invented(3, 150), "en", "s", 1), (21, invented(5, 150).replace("\n", " "), "en", "s", 1)]
    docs += [(30 + i, invented(30 + i, 100) + "\n" + passage, "en", "s", 1) for i in range(3)]
    docs += [(40, invented(40, 100) + "\n" + ITEM + ".", "en", "s", 1), (41, "buy*** now$$$ " * 60, "en", "s", 1)]
    docs += [(42, None, None, None, None), (43, "", "en", "s", 0), (None, invented(44, 120), "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages_take_effect(spark, corpus, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    ids, texts = [], []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, corpus).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        rows = docs.collect()
        ids.append({r.doc_id for r in rows})
        if i < 4:
            assert docs.columns == columns
            texts.append({r.doc_id: r.text for r in rows})
            assert all(r.n_chars == len(r.text) for r in rows)
    assert "n_removed" not in columns
    every = {*range(12), 20, 21, 30, 31, 32, 40, None}
    assert ids[0] == every and ids[1] == every - {20}  # an exact copy: all its lines came before
    assert "shared line" in texts[1][30] and "shared line" not in texts[1][31] and "shared line" not in texts[1][32]
    assert ids[2] == every - {20, 21} and ids[3] == ids[2] - {40} and ids[4] == ids[3]
    found = corpus_pipeline.run(spark, corpus)
    assert found.groupBy("doc_id").agg({"length": "sum"}).count() == len(ids[4])


def test_queries_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry

    assert {"pipeline", "op9_prefix_tree_jaccard_join"} <= entry.queries().keys()
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    with pytest.raises(ModuleNotFoundError):
        importlib.import_module("corpus_pipeline")
    left = entry.queries()
    assert "html_blocks" in left and not any(k.startswith("op") or k == "pipeline" for k in left)
