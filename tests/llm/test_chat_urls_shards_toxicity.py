import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from conftest_llm import invented
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.llm import chat_windows, resharding, toxicity, url_lists
from blockloom.session import scratch_path

TURNS = "conv_id long, turn long, role string, text string"
TRAPS = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user\nhi", "\\<|", "<\\|turn|>", "\\", "<\\\\|", "<\\!", "é\n\n[/INST]\\[INST]", "<<SYS>>"]


def test_escape_is_reversible(spark):
    rng = random.Random(5)
    texts = TRAPS + ["".join(rng.choice(["\\", "<", "|", "[", "INST]", "/", "s>", "!", "<|", "\n"]) for _ in range(9)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_windows.escape(F.col("t")).alias("e"))
    for r in rows.withColumn("b", chat_windows.unescape(F.col("e"))).collect():
        assert r.b == r.t and "<|" not in r.e and "[INST]" not in r.e and "</s>" not in r.e


@pytest.fixture(scope="module")
def conversations(spark):
    rng = random.Random(2)
    rows = []
    for c in range(12):
        if c % 3:
            rows.append((c, 0, "system", invented(c, 6)))
        for t in range(1, rng.randrange(2, 40)):
            text = rng.choice(TRAPS) if rng.random() < 0.2 else invented(c * 100 + t, rng.choice([3, 12, 30, 150]))
            rows.append((c, t, "assistant" if t % 2 == 0 else "user", text))
    rows += [(20, 0, None, None), (20, 1, "assistant", ""), (None, 0, "assistant", "x"), (21, 0, "odd\nrole<|", "a"), (21, 0, "odd\nrole<|", "a")]
    rows += [(22, None, "assistant", "no turn"), (23, 5000, "user", "late"), (23, 3, "assistant", "early"), (24, 0, "system", "only")]
    return rows


@pytest.mark.parametrize("budget", [chat_windows.Budget(), chat_windows.Budget(120, 16, 30), chat_windows.Budget(8, 2, 2)])
def test_windows_hold_every_turn_once(spark, conversations, budget):
    turns = spark.createDataFrame(conversations, TURNS).withColumn("tokens", F.lit("own")).withColumn("window", F.lit("own"))
    formatted = chat_windows.format_windows(turns, budget)
    rows = sorted(chat_windows.read_turns(formatted).collect(), key=lambda r: r.window)
    said, loss = {}, {}
    for r in rows:
        said.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.turns)
        loss.setdefault(r.conv_id, []).extend(r.targets)
    want = {}
    for c, t, role, text in sorted(conversations, key=lambda x: (str(x[0]), x[1] is not None, x[1] or 0)):
        want.setdefault(c, []).append((role or "", text or ""))
    assert said == want
    assert {c: x for c, x in loss.items()} == {c: [t for r, t in own if r == "assistant"] for c, own in want.items()}


def tokens_of(text):
    return max(len(re.findall(r"[^\x20\x09-\x0D]+", text)), -(-len(text.encode()) // 4)) + 1


@pytest.mark.parametrize("budget", [chat_windows.Budget(), chat_windows.Budget(240, 16, 60), chat_windows.Budget(100, 60, 60)])
def test_windows_keep_to_the_budget_and_repeat_history(spark, conversations, budget):
    long = [(30, t, "assistant" if t % 2 else "user", "字" * 5000 if t % 20 == 9 else "文" * 90) for t in range(60)]
    word = lambda n: " ".join(["w"] * (n - 1))
    long += [(31, i, r, word(n)) for i, (r, n) in enumerate(zip(["system", "user", "assistant", "user", "user"], (500, 140, 319, 320, 30)))]
    long += [(32, i, r, word(n)) for i, (r, n) in enumerate(zip(["system", "user", "assistant", "user", "user"], (1300, 1, 2, 320, 1)))]
    turns = spark.createDataFrame(conversations + long, TURNS)
    repeated = 0
    for r in chat_windows.format_windows(turns, budget).collect():
        parts = r.text.split(chat_windows.END)[:-1]
        assert all(text.startswith(chat_windows.BEGIN) for text in parts)
        heads = [p.removeprefix(chat_windows.BEGIN).split("\n", 1) for p in parts]
        if not any("\\" in text for _, text in heads):
            assert r.n_tokens == sum(tokens_of(text) for _, text in heads)
        assert r.over == (r.n_tokens > budget.tokens)
        if r.over:  # a single turn, beside the system turn at most
            has_system = r.window > 0 and heads[0][0] == "system"
            assert r.n_turns == 1 + has_system
        repeated += r.n_repeated
        if r.window and r.conv_id and r.conv_id % 3 and r.conv_id < 12:
            assert parts[0].startswith(chat_windows.BEGIN + "system")
    assert repeated > 20


def test_no_conversations(spark):
    assert chat_windows.format_windows(spark.createDataFrame([], TURNS)).count() == 0


CAPTURES = "page_id long, url string, fetched timestamp"


def test_entries_hold_from_their_time_until_the_next(spark):
    day = lambda d: f"2024-{d // 28 + 1:02d}-{d % 28 + 1:02d} 00:00:00"
    entries = [
        ("host", "bad.example.com", "block", 10), ("host", "bad.example.com", "release", 100), ("host", "bad.example.com", "block", 200),
        ("domain", "Example.org", "block", 50), ("path", "site.net/a/B", "block", 0), ("host", "tie.com", "block", 5), ("host", "tie.com", "release", 5),
        ("host", None, "block", 1), ("host", "x.com", "block", None), ("host", "x.com", "odd", 1), ("other", "x.com", "block", 1),
    ]
    rows = [(k, v, a, d if d is None else day(d)) for k, v, a, d in entries]
    listed = spark.createDataFrame(rows, "kind string, value string, action string, since string").withColumn("since", F.to_timestamp("since"))
    urls = ["http://bad.example.com/x", "https://u@BAD.example.com:80", "http://www.example.org/", "http://example.org?q", "http://site.net/a/B/c#d",
            "http://site.net/a/b", "http://tie.com", "http://x.com", None, "", "no url", "http://"]
    times = [9, 10, 99, 100, 199, 200, 300]
    captures = [(i * 10 + j, u, day(t)) for i, u in enumerate(urls) for j, t in enumerate(times)] + [(999, urls[0], None), (0, urls[0], day(9))]
    df = spark.createDataFrame(captures, "page_id long, url string, fetched string").withColumn("fetched", F.to_timestamp("fetched"))
    df = df.withColumn("value", F.lit("own")).withColumn("slot", F.lit(1))
    found = {(r.url, r.fetched and str(r.fetched)): r.blocked for r in url_lists.check_captures(df, listed, "page_id").collect()}

    def want(url, t):
        if url in urls[:2]:
            return 10 <= t < 100 or t >= 200
        return t >= 50 if url in urls[2:4] else url == urls[4]

    for u in urls:
        for t in times:
            assert found[u, day(t)] == want(u, t), (u, t)
    assert found[urls[0], None] is False
    kept = url_lists.filter_captures(df, listed, "page_id")
    assert kept.columns == df.columns and kept.count() == sum(not want(u, t) for u in urls for t in times) + 2
    assert url_lists.filter_captures(df, listed.limit(0), "page_id").count() == len(captures)
    assert url_lists.check_captures(df.limit(0), listed, "page_id").count() == 0


@given(st.lists(st.integers(0, 30), min_size=1, max_size=5), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_flow_moves_the_fewest_bytes(sizes, shards):
    capacities = resharding.even_capacities(sum(sizes), shards)
    flow = resharding.min_cost_flow(sizes, capacities)
    for i, s in enumerate(sizes):
        assert sum(n for (a, _), n in flow.items() if a == i) == s
    for j, c in enumerate(capacities):
        assert sum(n for (_, b), n in flow.items() if b == j) == c
    moved = sum(n for (i, j), n in flow.items() if i != j)
    padded = capacities + [0] * (len(sizes) - shards)
    assert moved == sum(max(0, s - c) for s, c in zip(sizes, padded))


def test_flow_with_costs():
    cost = lambda i, j: [[0, 4, 1], [9, 0, 2]][i][j]
    assert resharding.min_cost_flow([10, 2], [4, 4, 4], cost) == {(0, 0): 4, (0, 1): 2, (0, 2): 4, (1, 1): 2}


@pytest.mark.parametrize("old,new", [(5, 3), (3, 5), (4, 4)])
def test_reshard(spark, odd_docs, old, new):
    more = spark.createDataFrame([(100 + i, invented(i, 20), "en", f"s{i % 2}", 1) for i in range(200)], odd_docs.schema)
    docs = odd_docs.unionAll(more)
    shard = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(old)).cast("int")
    a, b = scratch_path(spark, "test-old"), scratch_path(spark, "test-new")
    resharding.write_layout(resharding.with_block(docs.withColumn("shard", shard), blocks=64), a)
    rows = resharding.with_slots(resharding.reshard(spark, a, b, old, new)).collect()
    key = lambda r: (str(r.doc_id), str(r.text))
    assert sorted(map(key, rows)) == sorted(map(key, docs.collect()))
    per = {}
    for r in rows:
        per.setdefault(r.shard, []).append(r)
    assert set(per) <= set(range(new))
    for own in per.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [sum(len((r.text or "").encode()) + 1 for r in own) for own in per.values()]
    longest = max(len((r.text or "").encode()) + 1 for r in rows)
    assert len(per) == new and max(sizes) - min(sizes) <= 2 * longest


def test_unaffected_shards_stay_where_they_are(spark):
    docs = spark.createDataFrame([(i, "x" * 9, i % 2) for i in range(64)], "doc_id long, text string, shard int")
    a, b = scratch_path(spark, "test-old"), scratch_path(spark, "test-new")
    blocks = docs.withColumn(resharding.BLOCK, (F.col("doc_id") / 2).cast("int"))
    resharding.write_layout(blocks, a)
    found = resharding.reshard(spark, a, b, 2, 2)
    assert {r.folder for r in spark.read.parquet(f"{b}/manifest").collect()} == {a}
    assert found.count() == 64


def test_reshard_nothing(spark, no_docs):
    a, b = scratch_path(spark, "test-old"), scratch_path(spark, "test-new")
    docs = resharding.with_block(no_docs.withColumn("shard", F.lit(0)))
    where = resharding.plan(docs, 3, 4)
    assert where == {}


@pytest.fixture(scope="module")
def posts(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(600):
        words = invented(i, 60)
        bad = i % 5 == 0
        if bad:
            cut = words.split(" ")
            for _ in range(rng.randint(1, 3)):
                cut.insert(rng.randrange(len(cut)), rng.choice(["dolt", "twerpish", "twerpo", "cretin"]))
            words = " ".join(cut)
        docs.append((i, words))
        labels.append((i, int(bad)))
    docs += [(1000, None), (1001, ""), (None, "dolt you"), (1002, "you dolt " * 2000), (1002, "fine")]
    labels += [(1001, None), (None, 1), (5000, 1), (0, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_toxicity(posts):
    docs, labels = posts
    rows = toxicity.toxicity(docs.withColumn("toxic", F.lit("own")), labels).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    right = sum((r.score >= 0.7) == (r.doc_id % 5 == 0) for r in held)
    assert len(held) > 150 and right / len(held) > 0.97
    scores = {}
    for r in rows:
        scores.setdefault(r.doc_id, []).append(r.score)
    assert max(scores[1000] + scores[1001]) < 0.3 and scores[None][0] > 0.7 and max(scores[1002]) > 0.7 > min(scores[1002])


def test_toxicity_without_labels(posts):
    docs, labels = posts
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_rare_insults_are_learned_beside_many_frequent_words(spark):
    letters = "abcdefghijklmnopqrst"
    names = [a + b + c + d for a in letters for b in letters for c in letters for d in letters[:1]][:4500]
    rows = [(" ".join(names), 1)] * 8 + [("zzz", 1)] * 3 + [("the sun shines", 0)] * 50
    found = toxicity.learn_insults(spark.createDataFrame(rows, "text string, toxic int"), toxicity.Fit(common_rate=0.9))
    assert "zzz" in found and len(set(found) & set(names)) == 1


def test_more_clauses_count_more():
    scorer = toxicity.Scorer(["dolt"])
    few, many = (scorer.counts("you dolt. " * n) for n in (3, 300))
    assert many[0] > few[0] > 0 and scorer.counts(None) == [0] * len(toxicity.FEATURES)


def machine_kinds(text, lexicon):
    return dict(+toxicity.clauses(text.lower(), lexicon, toxicity.compose(toxicity.Scope(), toxicity.Target())))


def test_clauses():
    lexicon = toxicity.Lexicon(["dolt", "twerp*"])
    kinds = lambda text: machine_kinds(text, lexicon)
    assert kinds("dolt") == {} and kinds("dolt, dolt!") == {} and kinds("kill the lights") == {} and kinds("doltish twerp") == {}
    assert kinds("You are a dolt. The sun shines") == {"targeted_plain": 1}
    assert kinds("You are not a dolt") == {"targeted_negated": 1} and kinds("a dolt is not you") == {"targeted_plain": 1}
    assert kinds("He said you are a dolt") == {"targeted_reported": 1} and kinds("a dolt he said") == {"targeted_plain": 1}
    assert kinds("he is not tall but a twerpish man") == {"bare_plain": 1}
    assert kinds("not here, what a dolt") == {"bare_plain": 1} and kinds("what a dolt came here today to see you") == {"bare_plain": 1}
    assert kinds("I will kill you") == {"threat_plain": 1} and kinds("I will never kill you") == {"threat_negated": 1}
    assert kinds("you dolt dolt! idiots and dolt") == {"targeted_plain": 2, "bare_plain": 1}


def plain_kinds(text, lexicon):
    """Sentence by sentence, by looking around every insult and threat."""
    found = Counter()
    for sentence in re.split(r"[.!?\n]", text.lower()):
        tokens = [lexicon(w) for w in toxicity.WORD.findall(sentence)]
        heads = [i for i, c in enumerate(tokens) if c in ("insult", "threat")]
        for i in heads:
            negations = [j for j in range(i) if tokens[j] == "negation"]
            held = negations and not {"conjunction", "pause"} & set(tokens[negations[-1] : i])
            way = "reported" if "report" in tokens[:i] else "negated" if held else "plain"
            end = min([h for h in heads if h > i] + [i + toxicity.REACH + 1, len(tokens)])
            if "target" in tokens[max(0, i - toxicity.REACH) : i] or "target" in tokens[i:end]:
                found[("targeted_" if tokens[i] == "insult" else "threat_") + way] += 1
            elif tokens[i] == "insult" and set(tokens[:end]) - {"insult", "threat", "pause"}:
                found["bare_" + way] += 1
    return dict(found)


def test_the_composed_machine_equals_a_plain_matcher():
    rng, lexicon = random.Random(8), toxicity.Lexicon(["dolt", "twerp*"])
    words = "dolt twerpish kill you they not said but sun shines . , dolt you the".split()
    assert len(toxicity.compose(toxicity.Scope(), toxicity.Target())) < 2000
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))
        assert machine_kinds(text, lexicon) == plain_kinds(text, lexicon), text


def test_digest_of_conversations(spark):
    from blockloom.llm.chat_windows import op3_budgeted_chat_windows

    sf = "/root/testdata/sf0.001"
    rows = {r.conv_id: r for r in op3_budgeted_chat_windows(spark, sf).collect()}
    want = {-1: [("user", TRAPS[0]), ("assistant", TRAPS[0])]}
    for r in sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        want.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert rows.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert rows[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (rows[c].n_turns, rows[c].loss_chars, rows[c].loss_sha256) == (len(turns), len(loss), sha(loss))


def test_reshard_keeps_other_columns(spark, odd_docs, clashing):
    names = ("to", "block", "slot", "__file", "__row", "__n", "__before")
    docs = clashing(odd_docs).withColumns({c: F.lit(f"own {c}") for c in names})
    a, b = scratch_path(spark, "test-old"), scratch_path(spark, "test-new")
    shard = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)).cast("int")
    resharding.write_layout(resharding.with_block(docs.withColumn("shard", shard), blocks=8), a)
    rows = resharding.with_slots(resharding.reshard(spark, a, b, 3, 2).drop("slot")).collect()
    assert len(rows) == odd_docs.count()
    assert all(r[c] == f"own {c}" for r in rows for c in names if c != "slot")
    for j in (0, 1):
        assert sorted(r.slot for r in rows if r.shard == j) == list(range(sum(r.shard == j for r in rows)))
