import datetime as dt
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from blockloom.session import stored
from blockloom.sources.labels import read_packed_labels
from blockloom.sources import state as crawl_state
from blockloom.sources.bodies import bodies_of, read_bodies, write_bodies
from blockloom.sources.state import browser_domains, buckets_of, in_buckets, last_marker, load_state, next_index
from blockloom.streaming.extract import extract_stream
from blockloom.streaming.ingest import ingest_batch, ingest_stream
from blockloom.streaming import throttle as throttling
from blockloom.streaming.throttle import rocksdb_state, throttle, throttle_stream

T0 = dt.datetime(2024, 1, 1)
CONF: dict[str, str] = {}


@contextmanager
def settings_of(spark, conf):
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


EVENTS = "k string, ts timestamp, n bigint"


def brute(rows, delay):
    last, passed = {}, set()
    for k, ts, n in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or (ts - last[k]).total_seconds() >= delay:
            last[k] = ts
            passed.add(n)
    return passed


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def accepted(df):
    return {r.n for r in df.where("accepted").collect()}


def test_throttle_boundary(spark):
    rows = [("a", at(s), s) for s in (0, 30, 60, 90, 119, 120)]
    got = throttle(spark.createDataFrame(rows, EVENTS), "k", "ts", 60, "n")
    assert accepted(got) == {0, 60, 120}
    assert got.count() == 6


@pytest.mark.parametrize("steps,delay", [(64, 37), (0, 37), (2, 400), (64, 5000), (0, 5000)])
def test_throttle_against_brute_force(spark, monkeypatch, steps, delay):
    """A hot key with most of the events, ties in time, gaps, equal events and a null key, over many partitions."""
    monkeypatch.setattr(throttling, "STEPS", steps)
    monkeypatch.setitem(CONF, "spark.sql.shuffle.partitions", "23")
    rng = random.Random(steps + delay)
    rows = []
    for n in range(6000):
        k = "hot" if n % 3 else rng.choice(["b", "c", "d", None])
        rows.append((k, at(rng.choice([rng.randrange(3000), rng.uniform(5000, 9000)])), n))
    with settings_of(spark, CONF | {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        got = throttle(spark.createDataFrame(rows, EVENTS).repartition(7), "k", "ts", delay, "n")
        assert accepted(got) == brute(rows, delay)
        assert got.count() == len(rows)


def test_throttle_spreads_one_delay_of_one_key(spark):
    """A third of all events of one key inside one delay, many at the same time: no task above its share."""
    rows = [("hot", at((n % 50) / 10), n) for n in range(4000)] + [(f"k{n % 900}", at(n), n) for n in range(4000, 12000)]
    conf = {"spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    with settings_of(spark, conf):
        df = spark.createDataFrame(rows, EVENTS).repartition(5)
        assert accepted(throttle(df, "k", "ts", 60, "n")) == brute(rows, 60)
        same = spark.createDataFrame([("hot", at(0), 7)] * 3000, EVENTS).repartition(5)
        seen = []

        def kept(df):
            seen.append(stored(df))
            return seen[-1]

        throttling.stored, before = kept, throttling.stored
        try:
            throttle(df, "k", "ts", 60, "n").count()
            assert throttle(same, "k", "ts", 60, "n").where("accepted").count() == 1
        finally:
            throttling.stored = before
        for held, n in zip(seen, (12000, 3000)):
            shares = [r["count"] for r in held.where("whole is null").groupBy("part").count().collect()]
            assert sum(shares) == n and max(shares) <= 3 * n / 12


def test_throttle_without_delay_and_without_events(spark):
    rows = [("a", at(0), 0), ("a", at(0), 1), (None, None, 2)]
    df = spark.createDataFrame(rows, EVENTS)
    assert {r.n: r.accepted for r in throttle(df, "k", "ts", 0, "n").collect()} == {0: True, 1: True, 2: None}
    assert throttle(df.limit(0), "k", "ts", 5, "n").collect() == []


def test_throttle_does_not_depend_on_the_time_zone(spark):
    """Times without zone across a change to daylight saving time in the session's zone."""
    rows = [("a", dt.datetime(2024, 3, 10, 1, 59, 30), 0), ("a", dt.datetime(2024, 3, 10, 3, 0, 10), 1)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, n bigint")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert accepted(throttle(df, "k", "ts", 60, "n")) == {0, 1}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def write(spark, rows, path, schema, mode="append"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).parquet(str(path))


def passed_of(spark, tmp_path, batches, delay, **options):
    """Batches through the stream, each as micro-batch; the numbers that pass, and the last progress."""
    rocksdb_state(spark)
    for rows in batches:
        write(spark, rows, tmp_path / "in", EVENTS)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    passed = throttle_stream(stream, "k", "ts", delay, "n", **options)
    q = passed.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    assert len(q.recentProgress) >= len(batches)
    return {r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}, q.recentProgress[-1]


def test_throttle_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), at(10 * n + rng.random()), n) for n in range(300)]
    with settings_of(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "16"}):  # keys come in pieces
        batches = [rng.sample(rows[i : i + 75], 75) for i in range(0, 300, 75)]
        got, _ = passed_of(spark, tmp_path, batches, 45)
    batch = accepted(throttle(spark.createDataFrame(rows, EVENTS), "k", "ts", 45, "n"))
    assert got == batch == brute(rows, 45)


def test_late_events_of_a_stream(spark, tmp_path):
    """Before the watermark nothing passes; within it, what the passed events leave open does."""
    batches = [
        [("a", at(0), 0), ("b", at(0), 1)],
        [("a", at(200), 2)],
        [("c", at(20), 3), ("c", at(190), 4), ("a", at(180), 5), ("a", at(250), 6)],  # 3 is too late, 5 before 2
        [("a", at(260), 7), ("b", at(30), 8)],
    ]
    got, _ = passed_of(spark, tmp_path, batches, 60)
    assert got == {0, 1, 2, 4, 7}


LABELS = "file string, title string, href string, ingredients array<string>, directions array<string>"


@pytest.fixture
def crawl(spark):
    suffixes = spark.createDataFrame([("com",)], "suffix string")
    bodies = [(f"recipe_{i}", f"<body>title {i}</body>" if i % 4 else "  ") for i in range(12)]
    fetched = spark.createDataFrame(bodies, "file string, html string")

    def labels(lo, hi):
        return [(f"recipe_{i}", f"Title {i}", f"http://a{i}.com/x" if i % 5 else None, [], []) for i in range(lo, hi)]

    return fetched, suffixes, labels


def test_ingest_in_parts_and_again(spark, tmp_path, crawl):
    fetched, suffixes, labels = crawl
    source, state, corpus, cp = (str(tmp_path / n) for n in ("in", "state", "corpus", "cp"))

    def run():
        stream = spark.readStream.schema(LABELS).option("maxFilesPerTrigger", 1).parquet(source)
        ingest_stream(stream, fetched, suffixes, state, corpus, cp).awaitTermination()

    write(spark, labels(0, 5), source, LABELS)
    run()
    first = {r.file: tuple(r) for r in load_state(spark, state).collect()}
    assert len(first) == 5
    write(spark, labels(3, 12), source, LABELS)  # overlaps with what is known
    run()
    run()  # nothing new
    rows = {r.file: r for r in load_state(spark, state).collect()}
    assert len(rows) == 12
    for f, old in first.items():
        assert tuple(rows[f]) == old
    for i in range(12):
        r = rows[f"recipe_{i}"]
        if i % 5 == 0:
            assert (r.status, r.reason) == ("failed", "Missing href")
        elif i % 4 == 0:
            assert (r.status, r.reason, r.domain) == ("failed", "Empty or invalid HTML from both methods", f"a{i}.com")
        else:
            assert (r.status, r.reason) == ("processed", None)
    ids = sorted(r.out_index for r in rows.values() if r.out_index is not None)
    assert ids == list(range(len(ids))) and next_index(spark, state) == len(ids)
    written = spark.read.parquet(corpus)
    assert sorted(r.out_index for r in written.collect()) == ids
    assert {r.domain for r in browser_domains(spark, state).collect()} == {"allrecipes.com", "a4.com", "a8.com"}


def test_a_batch_run_again_changes_nothing(spark, tmp_path, crawl):
    fetched, suffixes, labels = crawl
    state, corpus = str(tmp_path / "state"), str(tmp_path / "corpus")
    batches = [spark.createDataFrame(labels(0, 6), LABELS), spark.createDataFrame(labels(6, 12), LABELS)]
    for n, rows in enumerate(batches):
        ingest_batch(rows, n, fetched, suffixes, state, corpus)
    before = sorted(map(repr, load_state(spark, state).collect()))
    ingest_batch(batches[1], 1, fetched, suffixes, state, corpus)
    assert sorted(map(repr, load_state(spark, state).collect())) == before
    assert spark.read.parquet(corpus).groupBy("out_index").count().where("count > 1").count() == 0
    # failed files are tried again only on request
    ingest_batch(spark.createDataFrame(labels(0, 12), LABELS), 2, fetched, suffixes, state, corpus)
    assert spark.read.parquet(f"{state}/batch=2").count() == 0
    ingest_batch(spark.createDataFrame(labels(0, 12), LABELS), 3, fetched, suffixes, state, corpus, retry_failed=True)
    # Two had blank bodies, so their domains are the browser's now; the other three fail as before.
    changed = spark.read.parquet(f"{state}/batch=3").collect()
    assert sorted((r.file, r.status) for r in changed) == [("recipe_4", "needs_browser"), ("recipe_8", "needs_browser")]
    assert load_state(spark, state).count() == 12


def test_state_with_snapshots(spark, tmp_path, crawl, monkeypatch):
    """Many batches over few snapshots give what one batch gives; batch n reads its buckets and the last deltas."""
    monkeypatch.setattr(crawl_state, "SNAPSHOT_EVERY", 2)
    monkeypatch.setattr(crawl_state, "BUCKETS", 7)
    fetched, suffixes, labels = crawl
    write_bodies(fetched, str(tmp_path / "bodies"))
    bodies = read_bodies(spark, str(tmp_path / "bodies"))
    state, corpus = str(tmp_path / "state"), str(tmp_path / "corpus")
    for n in range(6):
        ingest_batch(spark.createDataFrame(labels(2 * n, 2 * n + 2), LABELS), n, bodies, suffixes, state, corpus)
    once = str(tmp_path / "once")
    ingest_batch(spark.createDataFrame(labels(0, 12), LABELS), 0, fetched, suffixes, once, str(tmp_path / "other"))
    columns = ["file", "status", "url", "reason", "domain"]
    rows = lambda p: sorted(map(repr, load_state(spark, p).select(*columns).collect()))
    assert rows(state) == rows(once)
    assert last_marker(spark, state)["snapshot"] == 5 and last_marker(spark, state, 5)["snapshot"] == 3
    before = sorted(map(repr, load_state(spark, state).collect()))
    ingest_batch(spark.createDataFrame(labels(8, 10), LABELS), 4, bodies, suffixes, state, corpus)  # again
    ingest_batch(spark.createDataFrame(labels(10, 12), LABELS), 5, bodies, suffixes, state, corpus)
    assert sorted(map(repr, load_state(spark, state).collect())) == before
    assert next_index(spark, state) == spark.read.parquet(corpus).count()
    assert {r.domain for r in browser_domains(spark, state).collect()} == {"allrecipes.com", "a4.com", "a8.com"}
    one = spark.createDataFrame([("recipe_3",)], "file string")
    buckets = buckets_of(one)
    read = lambda df: {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
    snapshot = spark.read.parquet(f"{state}-snapshot/upto=5")
    assert read(in_buckets(snapshot, buckets)) and len(buckets) == 1
    plan = load_state(spark, state, 5, buckets)._jdf.queryExecution().executedPlan().toString()
    filters = [p.split("]")[0] for p in plan.split("PartitionFilters: [")[1:]]
    assert any("file_bucket" in f for f in filters) and any("(batch#" in f and "> 3)" in f for f in filters)
    found = bodies_of(bodies, one, buckets)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(file_bucket" in found


def test_the_browsers_body_counts(spark):
    rows = [("a", "plain", "plain"), ("a", "own", "browser"), ("b", "only", None), ("c", "one", "plain"), ("c", "one", "plain")]
    fetched = spark.createDataFrame(rows, "file string, html string, fetched_by string")
    files = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "file string")
    assert sorted((r.file, r.html) for r in bodies_of(fetched, files, []).collect()) == [("a", "own"), ("b", "only"), ("c", "one")]


def test_open_files_are_tried_again(spark, tmp_path):
    """A refused body, a body not fetched yet and corrupt lines: every label has a row in state."""
    suffixes = spark.createDataFrame([("com",)], "suffix string")
    state, corpus = str(tmp_path / "state"), str(tmp_path / "corpus")
    lines = [f'{{"file": "recipe_{i}", "title": "Title {i}", "href": "http://a{i}.com/x", "rating": 4.5}}' for i in range(4)]
    lines += ['{"file": "recipe_9"', "no json", "no json", "[1]"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    labels = read_packed_labels(spark, str(tmp_path / "in"))
    body = "file string, html string, fetched_by string"
    first = spark.createDataFrame([("recipe_0", "<p>title 0</p>", "plain"), ("recipe_1", "Error 405", "plain")], body)
    ingest_batch(labels, 0, first, suffixes, state, corpus)
    found = {r.file: r.status for r in load_state(spark, state).collect()}
    assert [found[f"recipe_{i}"] for i in range(4)] == ["processed", "needs_browser", "pending", "pending"]
    assert len(found) == 4 + 3 and sum(s == "failed" for s in found.values()) == 3  # equal lines are one
    more = first.union(spark.createDataFrame([("recipe_1", "<p>title 1</p>", "browser"), ("recipe_2", "<p>title 2</p>", "plain")], body))
    ingest_batch(labels.limit(0), 1, more, suffixes, state, corpus)
    rows = {r.file: (r.status, r.out_index) for r in load_state(spark, state).collect()}
    assert rows["recipe_1"] == ("processed", 1) and rows["recipe_2"] == ("processed", 2) and rows["recipe_3"] == ("pending", None)
    ingest_batch(labels.limit(0), 2, more, suffixes, state, corpus)
    assert spark.read.parquet(f"{state}/batch=2").count() == 0 and load_state(spark, state).count() == 7


def test_events_without_a_time(spark, tmp_path):
    rows = [("a", at(0), 0), ("a", None, 1), ("a", at(60), 2), (None, None, 3)]
    got = throttle(spark.createDataFrame(rows, EVENTS), "k", "ts", 60, "n")
    assert {r.n: r.accepted for r in got.collect()} == {0: True, 1: None, 2: True, 3: None}


def test_state_of_a_stream_expires(spark, tmp_path):
    rows = [("a", at(0), 0), ("a", at(30), 1), ("b", at(500), 2), ("a", at(1000), 3), ("a", at(1030), 4), ("b", None, 5)]
    got, last = passed_of(spark, tmp_path, [[r] for r in rows], 45)
    assert got == {0, 2, 3}
    assert last.stateOperators[0].numRowsTotal <= 3  # one key: its time, and its timer in both directions


def test_extract_stream_equals_batch(spark, tmp_path, model, recipes):
    from blockloom.plans.extraction import extract

    pages, _ = recipes
    pages = pages.select("file", "html").limit(20).union(spark.createDataFrame([("empty", "")], "file string, html string"))
    parts = pages.withColumn("n", F.abs(F.hash("file")) % 3)
    for i in range(3):
        parts.where(F.col("n") == i).drop("n").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("file string, html string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    extract_stream(stream, model, str(tmp_path / "out"), str(tmp_path / "cp"), "file").awaitTermination()
    columns = ["file", "title", "ingredients", "directions"]
    got = sorted(map(repr, spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()))
    assert got == sorted(map(repr, extract(pages, model, "file").select(*columns).collect()))
    assert len(got) == 21


@pytest.mark.parametrize("files", [None, 3])
def test_rule_extract_stream_of_a_file_or_a_folder(spark, tmp_path, files):
    """The table of pages is one Parquet file, or a folder of them beside those of other tables."""
    from blockloom.workload.queries import QUERIES

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    expected = sorted(map(tuple, QUERIES["extract_records"](spark, "/root/testdata/sf0.001").collect()))
    if files is None:
        found = QUERIES["rule_extract_stream"](spark, "/root/testdata/sf0.001")
    else:
        for name in ("pages", "documents"):
            spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(files).write.parquet(f"{tmp_path}/{name}.parquet")
        found = QUERIES["rule_extract_stream"](spark, str(tmp_path))
    rows = sorted(map(tuple, found.collect()))
    assert len(rows) == pages.count() and [r[0] for r in rows] == [r[0] for r in expected]


@pytest.mark.parametrize("most", [0, 100])
def test_one_record_per_file_without_a_shuffle_of_records(spark, monkeypatch, most):
    """Records are grouped only for files that have several; the greatest JSON text stays, nulls are a file, too."""
    from blockloom.streaming import ingest

    monkeypatch.setattr(ingest, "BROADCAST_FILES", most, raising=False)
    alone = [(f"f{i}", f"title {i}") for i in range(50)]
    rows = lambda data: spark.createDataFrame(data, "file string, title string")
    unique = ingest._one_per_file(rows(alone))
    assert "Exchange" not in unique._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, unique.collect())) == sorted(alone)
    several = [("f3", "a"), ("f3", "z"), ("g", "2"), ("g", "1"), (None, "x"), (None, "y")]
    found = {r.file: r.title for r in ingest._one_per_file(rows(alone + several)).collect()}
    assert found == {**dict(alone), "f3": "z", "g": "2", None: "y"}


def test_a_record_without_href_is_not_joined_with_bodies(spark, crawl):
    from blockloom.plans.curation import validate

    fetched, suffixes, labels = crawl
    found = {r.file: r for r in validate(spark.createDataFrame(labels(0, 12), LABELS), fetched, suffixes).collect()}
    assert len(found) == 12
    for i in (0, 5, 10):
        r = found[f"recipe_{i}"]
        assert (r.status, r.reason, r.url, r.domain, r.html) == ("failed", "Missing href", None, "", None)
    assert all(found[f"recipe_{i}"].html is not None for i in range(12) if i % 5)
