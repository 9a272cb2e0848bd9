import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest_llm import invented
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.llm import ranked_search as search
from blockloom.llm.common import table
from blockloom.session import scratch_path

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """Every document scored for every item, by dictionaries and Python integers."""
    counted = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    counted = [(doc_id, c, sum(c.values())) for doc_id, c in counted if c]
    documents, words = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item_id, text in items:
        asked = set(terms(text)) & set(df)
        found = []
        for doc_id, c, n in counted:
            m = 100 - 90 + 90 * n * documents // words
            score = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        best = sorted(found)[:k]
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, _, doc_id) in enumerate(best, 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, k=10):
    path = scratch_path(spark, "index")
    corpus = search.corpus_of(docs)
    search.build(docs, path, corpus)
    return sorted((tuple(r) for r in search.search(spark, path, corpus, items, k).collect()), key=str)


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@given(st.lists(st.integers(0, 2**62), max_size=300))
@settings(max_examples=100, deadline=None)
def test_numbers_round_trip(values):
    data, ends = search.pack(np.array(values, np.int64))
    assert search.unpack(data).tolist() == values and len(data) == (ends[-1] if values else 0)


@given(st.text(alphabet="aZ é你\xa0\t\0.0_", max_size=60), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_terms_in_parts(text, most):
    assert [t.decode() for part in search.terms_of(text, most) for t in part] == terms(text)


def test_query_equals_brute_force(spark):
    from blockloom.llm.queries import QUERIES

    docs, items = (table(spark, SF, n) for n in ("documents", "benchmark"))
    found = sorted((tuple(r) for r in QUERIES["op13_block_max_search"](spark, SF).collect()), key=str)
    assert found == brute(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))


def test_many_shards_blocks_and_parts(spark, monkeypatch):
    """Ties, small blocks and shards, items in several blocks, and pruning that has to keep equal scores."""
    monkeypatch.setattr(search, "SHARD_DOCS", 37)
    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search, "STEP", 8)
    monkeypatch.setattr(search, "PORTION", 256)
    monkeypatch.setattr(search, "ITEM_TERMS", 20)
    rng = random.Random(5)
    docs = [(i, invented(rng.randrange(60), rng.randrange(1, 60), 30)) for i in range(400)]
    rng.shuffle(docs)
    items = [(i, invented(1000 + i, rng.randrange(1, 25), 40)) for i in range(12)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert searched(spark, d, spark.createDataFrame(items, "item_id bigint, text string"), 5) == brute(docs, items, 5)


def test_odd_rows(spark, odd_docs, no_docs, clashing):
    extra = clashing(odd_docs).selectExpr("*", "1 AS shard", "2 AS term", "3 AS df", "4 AS score", "5 AS item")
    rows = [(1, invented(1, 30)), (1, "one two"), (None, "same line"), (2, None), (3, ""), (4, "?!"), (5, "nowhere")]
    items = spark.createDataFrame([(*r, "x") for r in rows], "item_id bigint, text string, term string")
    assert searched(spark, extra, items) == brute(pairs(odd_docs, "doc_id", "text"), rows)
    assert searched(spark, no_docs, items) == []
    assert searched(spark, odd_docs, items.where("item_id > 9")) == []


def test_blocks_are_not_unpacked_in_vain(spark):
    """A weak list of many blocks is looked into only where candidates of the strong one stand."""
    corpus = search.Corpus(10_000, 50_000)
    writer = search.ShardWriter(corpus)
    for i in range(2000):
        writer.add(i, "weak other thing" + (" strong strong" if i % 400 == 0 else "") + " pad" * (i % 3))
    _, rows = writer.close(0)
    import pyarrow as pa

    sizes = np.array([3 + i % 3 + 2 * (i % 400 == 0) for i in range(2000)])
    lists = search._lists_of(pa.Table.from_batches([rows]), sizes, corpus)
    held = [(w * int(lists[t].tops.max()), w, lists[t]) for t, w in ((b"weak", 10), (b"strong", 9000))]
    scores, docs = search.best_of_shard(held, np.arange(2000), 2)
    assert (docs % 400 == 0).all() and len(lists[b"weak"].kept) < len(lists[b"weak"].last) / 2
    assert len(scores) == 2


def test_bounds_of_rare_terms_in_short_documents():
    """A weight times a block's greatest impact passes 32 bits; no candidate may be lost by it."""
    import pyarrow as pa

    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    docs = [(i, " ".join(words[int(500 * rng.random() ** 2)] for _ in range(rng.choice((1, 2, 3, 10, 50))))) for i in range(6000)]
    corpus = search.Corpus(len(docs), sum(len(t.split()) for _, t in docs))
    writer = search.ShardWriter(corpus)
    for doc_id, text in docs:
        writer.add(doc_id, text)
    own, rows = writer.close(0)
    doc_ids, sizes = (np.frombuffer(own.column(c)[0].as_py(), np.int64) for c in (1, 2))
    lists = search._lists_of(pa.Table.from_batches([rows]), sizes, corpus)
    weights = {t: corpus.weight(int((x.impacts(doc_ids) > 0).sum())) for t, x in lists.items()}
    assert any(w * int(lists[t].tops.max()) >= 2**31 for t, w in weights.items())
    items = [(i, " ".join(rng.choices(words, k=rng.choice((3, 8, 20))))) for i in range(20)]
    for item in items:
        asked = [t for t in {w.encode() for w in item[1].split()} if t in lists and weights[t]]
        held = [(weights[t] * int(lists[t].tops.max()), weights[t], lists[t]) for t in asked]
        scores, found = search.best_of_shard(held, doc_ids, 10)
        ranked = [(item[0], r, d, s) for r, (s, d) in enumerate(zip(scores.tolist(), found.tolist()), 1)]
        assert sorted(ranked, key=str) == brute(docs, [item])
