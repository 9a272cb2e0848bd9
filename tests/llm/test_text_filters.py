"""Quality rules, line dedup, decontamination and the n-gram join against brute force."""

import collections
import re

import pytest
from conftest_llm import BLANK_ENDED, changed, invented

from blockloom.llm import decontaminate, line_dedup, ngram_join, quality_rules


def counts(text):
    words = BLANK_ENDED.findall(text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if BLANK_ENDED.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(repeated),
    )


def test_quality_counts(odd_docs):
    rows = quality_rules.judged(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        d = r["__doc"]
        found = (d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words)
        assert found == counts(r.text), r.doc_id
        assert d.base_failed == (found[0] < 50 or 100 * found[4] > 50 * found[0])
        assert not (d.base_failed and d.kept)


def test_lines_fail_and_documents_that_lose_too_much_go(spark, clashing):
    good = invented(3, 80)
    menu = "Home | News | Sport | About us | Contact"
    licence = "All rights reserved."
    symbols = "buy*** now### cheap$$$ pills&&& here***"
    shout = "BUY!! NOW!! IT!! IS!! CHEAP!!"
    unclosed = " ".join(["word"] * 12 + ["other", "and"] * 6)
    docs = spark.createDataFrame(
        [(1, f"{good}\n{menu}\n{licence}\n\n{symbols}\n{shout}\n{unclosed}"), (2, good[:200] + "\n" + f"{symbols}\n" * 40), (3, good)],
        "doc_id long, text string",
    )
    kept = {r.doc_id: r for r in quality_rules.clean(clashing(docs)).collect()}
    assert set(kept) == {1, 3}
    assert kept[1].text == good + "\n" and kept[3].text == good
    assert kept[1].key == "own key" and kept[1].w == "own w"


def test_empty_quality(no_docs):
    assert quality_rules.clean(no_docs).count() == 0


def deduped(docs):
    """docs: (doc_id, text) with unique ids, none null."""
    windows = lambda t: [tuple(x.strip(" \t\n\x0b\x0c\r") for x in t.split("\n")[i : i + 3]) for i in range(len(t.split("\n")) - 2)]
    first = {}
    for doc_id, text in sorted(docs):
        for i, w in enumerate(windows(text)):
            first.setdefault(w, (doc_id, i))
    out = {}
    for doc_id, text in docs:
        gone = {j for i, w in enumerate(windows(text)) if any(w) and first[w] != (doc_id, i) for j in (i, i + 1, i + 2)}
        out[doc_id] = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    return out


def test_line_dedup(spark, clashing):
    passage = invented(7, 60)
    docs = [(i, f"{invented(100 + i, 30)}\n{passage if i % 3 else ''}\n{invented(200 + i, 20)}") for i in range(12)]
    docs += [(20, "a\na\na\na\na"), (21, "\n\n\n\n\n"), (22, "x"), (23, ""), (24, docs[1][1]), (25, docs[1][1] + "\n  \n")]
    rows = line_dedup.dedup_lines(clashing(spark.createDataFrame(docs, "doc_id long, text string")), report=True).collect()
    assert {r.doc_id: r.text for r in rows} == deduped(docs)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[24].text == "" and by_id[22].n_removed == 0 and by_id[20].at == "own at"


def test_line_dedup_of_odd_rows(spark, odd_docs, no_docs):
    rows = line_dedup.dedup_lines(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert sorted(r.text for r in rows if r.doc_id == 5) == ["", ""]  # the null doc_id comes first and keeps the text
    assert [r.text for r in rows if r.doc_id == 2] == [None]
    assert [bool(r.text) for r in rows if r.doc_id is None and r.n_chars == 5] == [True]
    assert line_dedup.dedup_lines(no_docs).count() == 0


ITEM = "the quick brown fox jumps over one lazy dog and then it sleeps under an old tree until night falls again"


@pytest.fixture(scope="module")
def items(spark):
    rows = [(0, ITEM), (1, invented(1050, 40)), (2, "too short to tell"), (3, None), (None, invented(1051, 30)), (4, "")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_hits_leave_the_text_behind(spark, items):
    """A document's hits are rows that are in memory together: their size must not be the document's."""
    docs = spark.createDataFrame([(1, f"{ITEM} " * 200), (2, f"{invented(9, 300)} {ITEM}"), (3, ITEM)], "doc_id long, text string")
    found = decontaminate.contaminations(docs, items)

    def joins(node):
        below = [node.children().apply(i) for i in range(node.children().size())]
        own = [{a.name() for a in (b.output().apply(i) for i in range(b.output().size()))} for b in below]
        return ([own[0]] if any("item_w" in names for names in own[1:]) else []) + [x for b in below for x in joins(b)]

    rows = joins(found._jdf.queryExecution().optimizedPlan())
    assert rows and not any({"text", "w"} & names for names in rows)
    assert {(r.doc_id, r.item_id, r.overlap) for r in found.collect()} == {(1, 0, 1.0), (2, 0, 1.0), (3, 0, 1.0)}


def test_contaminations(spark, items, clashing):
    words = ITEM.split()
    tolerant = [w if i not in (4, 12) else "other" for i, w in enumerate(words)]
    apart = [w if i % 3 else "other" for i, w in enumerate(words)]
    texts = [
        invented(1, 100) + " " + ITEM + " " + invented(2, 50),
        invented(3, 20) + " " + " ".join(tolerant).upper() + ". " + invented(4, 30),
        invented(5, 30) + " " + " ".join(apart),
        " ".join(words[:8]),
        ITEM.replace(" ", ", "),
        invented(1050, 40) + " " + ITEM,
        invented(1051, 30),
        None,
        "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(clashing(docs), items).collect()}
    assert {d for d, _ in found} == {0, 1, 4, 5} and {(0, 0), (1, 0), (4, 0), (5, 0), (5, 1)} <= found
    kept = decontaminate.decontaminate(clashing(docs), items)
    assert {r.doc_id for r in kept.collect()} == {2, 3, 6, 7, 8} and kept.columns == clashing(docs).columns


def test_short_items_are_found_where_all_words_agree(spark):
    rows = [(0, "Who wrote the old song?"), (1, "one two three four five six seven eight nine ten"), (2, "word"), (3, ITEM), (4, " ")]
    short = spark.createDataFrame(rows, "item_id long, text string")
    texts = [
        "they ask who wrote the old song, often",
        "they ask who wrote the new song",
        "who wrote the old",
        "zero one two three four five six seven eight nine ten",
        "zero one two three four five six seven eight nine",
        "word",
        "x " + ITEM,
        "",
        None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.contaminations(docs, short).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(0, 0), (3, 1), (5, 2), (6, 3)} and all(r.overlap == 1 for r in found)


def test_items_in_blocks_give_the_same(spark, items, monkeypatch):
    docs = spark.createDataFrame([(i, invented(i, 60) + (" " + ITEM if i % 4 == 0 else "")) for i in range(40)], "doc_id long, text string")
    whole = sorted(decontaminate.contaminations(docs, items).collect())
    monkeypatch.setattr(decontaminate, "SEEDS", 80)
    assert sorted(decontaminate.contaminations(docs, items).collect()) == whole and len(whole) == 10


def test_decontaminate_odd_rows(odd_docs, no_docs, items):
    assert decontaminate.decontaminate(odd_docs, items).count() == odd_docs.count()
    assert decontaminate.decontaminate(odd_docs, items.limit(0)).count() == odd_docs.count()
    assert decontaminate.decontaminate(no_docs, items).count() == 0


def similar_components(docs, words, percent):
    sets = {}
    for doc_id, text in docs:
        w = BLANK_ENDED.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        grams = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
        sets.setdefault(doc_id, []).append(grams)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}, {d: sorted(map(len, s)) for d, s in sets.items()}


@pytest.fixture(scope="module")
def copies():
    docs = [(i, invented(i, 60)) for i in range(20)]
    docs += [(100 + i, changed(invented(1, 120), i, 0.02)) for i in range(25)]
    docs += [(200 + i, changed(changed(invented(2, 150), 5, 0.01 * i), i, 0.01)) for i in range(12)]
    docs += [(300 + i, invented(3, 60)) for i in range(5)]
    docs += [(400, ""), (401, None), (402, " "), (403, "a b"), (404, "A  b"), (405, "a"), (406, "a b c d"), (407, "one line " * 50)]
    docs += [(408, "one line " * 40), (409, invented(8, 60)), (409, invented(9, 60)), (410, invented(9, 60).upper())]
    return docs


@pytest.mark.parametrize("tree_sets,words,percent", [(1000, 4, 85), (2, 5, 80), (6, 4, 60)])
def test_similar_documents(spark, copies, clashing, monkeypatch, tree_sets, words, percent):
    monkeypatch.setattr(ngram_join, "TREE_SETS", tree_sets)
    monkeypatch.setattr(ngram_join, "PORTION", 2000)
    docs = clashing(spark.createDataFrame(copies, "doc_id long, text string"))
    rows = ngram_join.join_similar(docs, ngram_join.Similar(words, percent)).collect()
    want, sizes = similar_components(copies, words, percent)
    assert len(rows) == len(copies)
    assert {r.doc_id: r.component_id for r in rows} == want
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r.n_shingles)
    assert {d: sorted(n) for d, n in found.items()} == sizes


def test_frequent_grams_are_the_last(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT_LEAST", 3)
    monkeypatch.setattr(ngram_join, "FREQUENT_SHARE", 0.05)
    common = invented(77, 30)
    docs = [(i, common + "\n" + invented(500 + i // 2, 25)) for i in range(60)]
    rows = ngram_join.join_similar(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2), ngram_join.Similar(4, 85)).collect()
    assert {r.doc_id: r.component_id for r in rows} == similar_components(docs, 4, 85)[0]


def test_frequent_grams_of_scattered_copies_count_once(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT_LEAST", 3)
    monkeypatch.setattr(ngram_join, "FREQUENT_SHARE", 0.05)
    monkeypatch.setattr(ngram_join, "PORTION", 1000)
    common = invented(77, 30)
    texts = [common + "\n" + invented(600 + i, 25) for i in range(12)]
    texts += [common + "\n" + changed(invented(700 + i // 3, 60), i, 0.01) for i in range(9)]
    docs = [(i, texts[i % len(texts)]) for i in range(6 * len(texts))]
    dealt = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = ngram_join.join_similar(dealt, ngram_join.Similar(4, 85)).collect()
    assert {r.doc_id: r.component_id for r in rows} == similar_components(docs, 4, 85)[0]


def test_one_of_each_group_stays(spark, odd_docs, no_docs):
    kept = ngram_join.keep_one(odd_docs).collect()
    ids = [r.doc_id for r in kept]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 7, 8, 9] and ids.count(None) == 2
    assert ngram_join.keep_one(no_docs).count() == 0


def test_sets_of_words_that_collide_as_polynomials(spark):
    from blockloom.llm.shingles import Shingler

    words = ["".join("ab"[(bin(i).count("1") + k) % 2] for i in range(2048)) for k in (0, 1)]
    hashes, ends = Shingler(4, 3).sets([f"{w} x y z" for w in words])
    assert ends.tolist() == [1, 2] and hashes[0] != hashes[1]
    docs = spark.createDataFrame([(i, f"{w} x y z {w}") for i, w in enumerate(words)], "doc_id long, text string")
    found = ngram_join.join_similar(docs, ngram_join.Similar(4, 85)).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(0, 0), (1, 1)]
