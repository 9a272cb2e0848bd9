from bisect import bisect_left
from collections import Counter
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.llm import alignment
from blockloom.llm.common import table

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(*alignment.paths())


def whole_text(aligner, text):
    """Groups and links of a text by its offsets, from one call of either library on the whole of it."""
    if not text:
        return [], []
    a = aligner.a.tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = aligner.b.model.encode(text)
    found = []
    for ids, own in ((a, aligner.a.bytes), (b, aligner.b.bytes)):
        if b"".join(own[i] for i in ids) != (" " + text).encode():
            return [], []
        at, ends = 0, []
        for i in ids:
            at += len(own[i])
            ends.append(at)
        found.append(ends)
    both = sorted(set(found[0]) & set(found[1]))
    groups = [([], []) for _ in both]
    for side, (ids, ends) in enumerate(zip((a, b), found)):
        for i, end in zip(ids, ends):
            groups[bisect_left(both, end)][side].append(i)
    ended = [{end: i for i, end in zip(ids, ends)} for ids, ends in zip((a, b), found)]  # no token is empty
    links = [(ended[0][end], ended[1][end]) for end in both]
    return groups, links


def brute(aligner, rows):
    """All rows' results, sorted."""
    aligned = [(doc_id, *whole_text(aligner, text)) for doc_id, text in rows]
    counts = Counter(x for _, _, links in aligned for x in links)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for doc_id, groups, links in aligned:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (
                doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
                sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
                sha256(text.encode()).hexdigest() if groups else "",
            )
        )
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


@given(st.lists(st.text(alphabet="aB's(;)é ñ\n\t\r.,!? 0\x1c\0你▁\xa0", max_size=40), max_size=5))
@settings(max_examples=200, deadline=None)
def test_pieces_give_the_groups_of_whole_texts(texts):
    aligner = alignment.aligner(*alignment.paths())
    got = aligner.align(texts)
    for i, text in enumerate(texts):
        groups, links = whole_text(aligner, text)
        digest = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert got["digests"][i] == (sha256(digest.encode()).hexdigest() if groups else "")
        assert [int(s[i]) for s in got["sums"]] == [sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups)]
        own = Counter()
        for kind in ("ones", "pairs"):
            ends, found, n = got[kind]
            for x, k in zip(found[ends[i] : ends[i + 1]].tolist(), n[ends[i] : ends[i + 1]].tolist()):
                own[(x, int(aligner.same[x])) if kind == "ones" else divmod(x, len(aligner.b.bytes))] += k
        assert own == Counter(links)


def test_query_equals_brute_force(spark, aligner):
    from blockloom.llm.queries import QUERIES

    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op12_identity_alignment"](spark, SF)) == brute(aligner, docs)


def test_pairs_that_are_shuffled(spark, aligner, odd_docs, clashing, monkeypatch):
    monkeypatch.setattr(alignment, "HEAVY", 4)  # nearly all pairs are rare
    monkeypatch.setattr(alignment, "PIECES", 3)
    docs = clashing(odd_docs).selectExpr("*", "1 AS row", "2 AS pair", "3 AS one", "4 AS n", "5 AS n_best")
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert rows_of(alignment.aligned(docs, *alignment.paths())) == brute(aligner, rows)


def test_texts_without_tokens(spark, no_docs):
    assert alignment.aligned(no_docs, *alignment.paths()).collect() == []
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a ▁ b"), (None, None)], "doc_id bigint, text string")
    assert {tuple(r[c] for c in COLUMNS[1:]) for r in alignment.aligned(docs, *alignment.paths()).collect()} == {(0,) * 6 + ("",)}


def test_identity_map(aligner):
    pairs = [(i, int(b)) for i, b in enumerate(aligner.same) if b >= 0]
    assert len(pairs) > 10_000
    assert all(aligner.a.bytes[a] == aligner.b.bytes[b] and aligner.a.bytes[a] for a, b in pairs)
    plain = [b for b in range(len(aligner.b.bytes)) if aligner.b.bytes[b] == b"a"]
    assert len(plain) == 2 and aligner.same[aligner.a.bytes.index(b"a")] == max(plain)  # the piece, not the byte
