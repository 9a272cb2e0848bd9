import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.llm import huffman, packing, token_files, tokens
from blockloom.session import scratch_path


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.default_path())


def library_ids(encoder, text):
    return np.array(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, encoder.dtype).tobytes()


@given(st.lists(st.text(alphabet="aB'sé ñ\n\t.,!? 0\x1c \0", max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_pieces_give_the_ids_of_whole_texts(texts):
    encoder = tokens.encoder(tokens.default_path())
    assert encoder.encode(texts) == [library_ids(encoder, t) for t in texts]


def test_table_of_pieces_starts_anew(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "PIECES", 5)
    texts = ["alpha beta gamma. delta", "beta epsilon zeta eta theta iota", "a b\nc <|endoftext|> d", None, ""]
    fresh = tokens.Encoder(tokens.default_path())
    for _ in range(3):
        assert fresh.encode(texts) == [library_ids(fresh, t) for t in texts]


@given(st.lists(st.integers(0, 300), max_size=1500), st.integers(9, 20))
@settings(max_examples=60, deadline=None)
def test_huffman_round_trip(ids, longest):
    ids = np.array(ids, np.int64)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=301), longest)
    assert lengths.max(initial=0) <= longest and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    data, points = huffman.pack(ids, huffman.codes(lengths), lengths)
    table, bits = huffman.unpack_table(lengths)
    assert (huffman.unpack(data, points, len(ids), table, bits) == ids).all()


def test_length_limit_is_optimal_when_it_does_not_bind():
    import heapq

    counts = np.random.default_rng(1).integers(1, 1000, 40)
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert (counts * huffman.code_lengths(counts)).sum() == cost
    skewed = 2 ** np.arange(20)
    assert huffman.code_lengths(skewed, 6).max() == 6


def test_token_files(spark, odd_docs, encoder, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 300)
    path = scratch_path(spark, "test-files")
    token_files.write_token_files(odd_docs, path, tokens.default_path())
    found = token_files.with_starts(spark, path, token_files.digest(token_files.read_token_files(spark, path), encoder.dtype))
    rows = sorted(found.collect(), key=lambda r: r.start)
    want = []
    for r in odd_docs.collect():
        ids = np.frombuffer(library_ids(encoder, r.text), encoder.dtype).astype("<u4").tolist() + [2]
        want.append((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4"))))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert spark.read.parquet(f"{path}/blocks").count() > 3


def test_token_files_without_rows(spark, no_docs, encoder):
    path = scratch_path(spark, "test-files")
    token_files.write_token_files(no_docs, path, tokens.default_path())
    rows = token_files.digest(token_files.read_token_files(spark, path), encoder.dtype)
    assert token_files.with_starts(spark, path, rows).count() == 0


def test_packing_covers_every_id_once(spark, odd_docs, encoder):
    limits = packing.Limits(tokens=64, segments=5, loss=48)
    sequences = packing.pack(odd_docs.coalesce(2), tokens.default_path(), limits)
    rows = packing.pieces(sequences).collect()
    per_sequence = {}
    for r in rows:
        per_sequence.setdefault(r.sequence_id, []).append(r)
    for own in per_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
        assert sum(r.length for r in own) <= 48 and len(own) <= 5
    want = sorted(len(library_ids(encoder, r.text)) // 2 + 1 for r in odd_docs.collect())
    assert sum(want) == sum(r.length for r in rows)
    whole = {}
    for r in odd_docs.where("doc_id in (1, 6, 8)").collect():
        whole[r.doc_id] = np.append(np.frombuffer(library_ids(encoder, r.text), encoder.dtype), 0).astype("<u4")
    for r in rows:
        if r.doc_id in whole:
            assert r.ids_crc32 == zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes())
    filled = sum(r.length for r in rows) / len(per_sequence) / 48
    assert filled > 0.9


def test_loss_bearing_ids_are_limited(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma delta " * 5, i % 15) for i in range(60)], "doc_id long, text string, loss_from int")
    limits = packing.Limits(tokens=64, segments=64, loss=24)
    sequences = packing.pack(docs.coalesce(1), tokens.default_path(), limits, loss_from=F.col("loss_from"))
    rows = packing.pieces(sequences).collect()
    loss = {}
    for r in rows:
        bearing = max(0, r.start + r.length - max(r.start, r.doc_id % 15))
        loss[r.sequence_id] = loss.get(r.sequence_id, 0) + bearing
    assert max(loss.values()) <= 24


def test_dot_product_prefers_the_best_aligned_piece():
    packer = packing.Packer(packing.Limits(tokens=10, segments=3, loss=10, shortest=1))
    piece = lambda n: packing.Piece(n, 0, np.zeros(n, np.uint16), np.ones(n, np.uint8), n)
    packer.waiting = [piece(n) for n in (2, 3, 7, 8)]
    assert [[len(p.ids) for p in s] for s in packer.pack(last=True)] == [[8, 2], [7, 3]]


def test_nothing_to_pack(no_docs):
    assert packing.pack(no_docs, tokens.default_path()).count() == 0


def thue_morse(letters, bits):
    """A word and its complement, which polynomials in their bytes modulo 2^64 can not tell apart."""
    word = "".join(letters[bin(i).count("1") % 2] for i in range(1 << bits))
    return word, word.translate(str.maketrans(letters, letters[::-1]))


@pytest.mark.parametrize("bits", [5, 8, 11, 12])
def test_words_that_collide_as_polynomials(encoder, bits):
    a, b = thue_morse("ab", bits)
    texts = [f"one {a} two", f"one {b} two", f"{b}.", f"{a}."]
    fresh = tokens.Encoder(tokens.default_path())
    assert fresh.encode(texts) == [library_ids(encoder, t) for t in texts]


def test_keys_of_short_and_long_strings():
    from blockloom.llm.hashing import keys_of

    rng = np.random.default_rng(2)
    strings = sorted({rng.integers(97, 99, n).astype(np.uint8).tobytes() for n in [*range(1, 60)] * 40} | {b"a\0", b"a", b"a\0\0"})
    raw = np.frombuffer(b"".join(strings), np.uint8)
    end = np.cumsum([len(s) for s in strings])
    start = end - [len(s) for s in strings]
    keys = keys_of(raw, start, end, 7)
    assert len(set(keys.tolist())) == len(strings)
    at = [0, 5, 100]
    moved = np.frombuffer(b"xy" + b"".join(strings) + b"z", np.uint8)
    assert (keys_of(moved, start[at] + 2, end[at] + 2, 7) == keys[at]).all()
    assert (keys_of(raw, start, end, 8) != keys).all()


def test_packing_reads_no_other_columns(odd_docs, clashing, encoder):
    docs = clashing(odd_docs).withColumns({c: F.lit(f"own {c}") for c in ("loss_from", "ids", "pieces", "sequence_id", "mask")})
    rows = packing.pieces(packing.pack(docs.coalesce(1), tokens.default_path())).collect()
    want = sum(len(library_ids(encoder, r.text)) // 2 + 1 for r in odd_docs.collect())
    assert sum(r.length for r in rows) == want


def test_token_files_read_no_other_columns(spark, odd_docs, clashing):
    path = scratch_path(spark, "test-files")
    docs = clashing(odd_docs).withColumns({c: F.lit("x") for c in ("ids", "ids_crc32", "n_tokens", "part", "data", "points")})
    token_files.write_token_files(docs, path, tokens.default_path())
    assert token_files.read_token_files(spark, path).count() == odd_docs.count()


@pytest.mark.parametrize("name", ["op1_huffman_token_files", "op2_vector_packing"])
def test_queries_hold_the_library_ids(spark, encoder, name):
    from blockloom.llm.common import table
    from blockloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    end = {"op1_huffman_token_files": 2, "op2_vector_packing": 0}[name]
    whole = {
        r.doc_id: np.append(np.frombuffer(library_ids(encoder, r.text), encoder.dtype), end).astype("<u4")
        for r in table(spark, sf, "documents").collect()
    }
    rows = QUERIES[name](spark, sf).collect()
    if end == 2:
        starts = dict(zip(sorted(whole), np.cumsum([0] + [len(whole[i]) for i in sorted(whole)])))
        want = {(i, int(starts[i]), len(x), zlib.crc32(x.tobytes())) for i, x in whole.items()}
        assert {tuple(r)[:4] for r in rows} == want and len(rows) == len(whole)
        return
    left = dict.fromkeys(whole, 0)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes())
        assert r.doc_tokens == len(whole[r.doc_id])
        left[r.doc_id] += r.length
    assert left == {i: len(x) for i, x in whole.items()}
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 1024
