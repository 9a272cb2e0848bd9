import random
import re
import string
from hashlib import sha256

import pytest
from conftest_llm import invented
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.llm import secret_scan
from blockloom.llm.common import table

SF = "/root/testdata/sf0.01"
# The patterns as they are asked for, without short cuts.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = [
    ("assign", re.compile("(?ia)" + ASSIGN), lambda m: len(m.group(2)) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m.group()) >= 16),
]


def brute(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m)]
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(found)]


def base_row(text):
    spans = brute(text)
    number = [sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")]
    return (*number, sha256(",".join(spans).encode()).hexdigest())


@pytest.fixture(scope="module")
def scanner():
    words = " ".join(sorted({w for i in range(30) for w in invented(i, 200).split()}))
    return secret_scan.Scanner((words + " authorization_header client_session_manager access_token_provider").encode())


PARTS = ["password", "Secret", "TOKEN", "api_key", "apikey", "ſecret", "toKen", '"', "'", " ", "  ", ":", "=", "AKIA", "AKIAAKIA"]
PARTS += ["ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "é", "\n", "x.y-z_", "abcdefghijkl", "-", "g"]


@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
@settings(max_examples=500, deadline=None)
def test_base_spans(scanner, text):
    base = [f"{k}:{a}:{b}" for a, b, k in scanner.spans(text) if k != "novel"]
    assert base == brute(text)


def test_query_keeps_base_spans(spark):
    from blockloom.llm.queries import QUERIES

    rows = QUERIES["op11_zstd_novelty_secrets"](spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    assert len(rows) == len(texts) and sum(r["n_assign"] for r in rows) > 0
    for r in rows:
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == base_row(texts[r["doc_id"]])
        assert [s for s in r["spans"].split(",") if s and not s.startswith("novel")] == brute(texts[r["doc_id"]])


def _random(rng, n, alphabet=string.ascii_letters + string.digits):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_random_strings_in_sensitive_context(scanner):
    rng = random.Random(1)
    for i in range(40):
        key = "A1b" + _random(rng, rng.randrange(21, 60))
        text = f"{invented(i, 60)} Authorization: Bearer {key} {invented(i + 1, 60)}"
        at = text.index(key)
        assert (at, at + len(key), "novel") in scanner.spans(text)
        plain = text.replace("Authorization: Bearer", "Delivered to")
        assert scanner.spans(plain) == []


def test_known_and_repeated_strings_stay(scanner):
    name = "client_session_manager access_token_provider2"
    assert scanner.spans(f"{invented(3, 50)} credentials come from {name} in {invented(4, 50)}") == []
    key = "Zk3" + _random(random.Random(2), 30)
    # What stands beside it already adds next to nothing.
    assert scanner.spans(f"see {key} and credentials {key}, {key}") == []


def test_address_with_password(scanner):
    text = f"{invented(5, 40)} connect to postgres://admin:q9XtL2mPz7Rw4Kd8@db.example/x {invented(6, 40)}"
    spans = scanner.spans(text)
    assert [text[a:b] for a, b, k in spans] == ["q9XtL2mPz7Rw4Kd8"] and spans[0][2] == "novel"


def test_dictionary_counts_all_texts(spark):
    docs = spark.createDataFrame([("alpha beta beta_x2 gamma",), ("beta gamma gamma",), (None,), ("",)], "text string")
    assert secret_scan.identifier_dictionary(docs, 100) == b"beta gamma"
    assert secret_scan.identifier_dictionary(docs, 8) == b"gamma"


def test_dictionary_of_a_step_with_too_many(spark):
    names = ["".join(chr(97 + (i // 26**k) % 26) for k in range(6)) for i in range(3000)]
    docs = spark.createDataFrame([(" ".join(names),), (" ".join(names) + " first first first first",)], "text string")
    found = secret_scan.identifier_dictionary(docs, 5000).split()
    assert found[-1] == b"first"
    assert len(found) <= 5000 // 7 + 1 and set(found) <= set(map(str.encode, names)) | {b"first"} and len(found) > 500


def test_odd_rows(spark, odd_docs, no_docs, clashing):
    extra = clashing(odd_docs).selectExpr("*", "1 AS found", "2 AS kind", "3 AS identifier", "4 AS spans")
    rows = secret_scan.digest(secret_scan.scan(extra, b"")).collect()
    assert sorted(map(str, (r["doc_id"] for r in rows))) == sorted(str(r["doc_id"]) for r in odd_docs.collect())
    none = sha256(b"").hexdigest()
    assert all(r["base_sha256"] == none and r["spans"] == "" for r in rows if r["doc_id"] in (2, 3, 4, 7))
    assert secret_scan.digest(secret_scan.scan(no_docs, b"")).collect() == []
    assert secret_scan.identifier_dictionary(no_docs, 100) == b""


def test_very_long_text(scanner):
    rng = random.Random(3)
    key = "Yy7" + _random(rng, 40)
    text = "token " * 20_000 + "a1" * 100_000 + " bearer " + key + " " + "secret" * 20_000
    assert (text.index(key), text.index(key) + len(key), "novel") in scanner.spans(text)
