from pyspark.sql import functions as F

from blockloom.operators import crawl, quality
from blockloom.operators.numbering import number_within
from blockloom.operators.records import extract_records
from blockloom.operators.reports import classification_report

RECORD = "file string, title string, ingredients array<string>, directions array<string>"


def test_page_validity(spark):
    pairs = spark.createDataFrame(
        [
            ("a", "Soup", ["0", "Salt "], ["Boil it"], "some salt here 0"),
            ("b", "", ["0"], [" "], "0 anything"),
            ("c", "Soup", None, None, "my soup"),
        ],
        RECORD + ", page_text string",
    )
    rows = {r.file: (r.valid, r.reasons) for r in quality.validate_pages(pairs).collect()}
    assert rows == {
        "a": (True, "title missing, no directions matched"),
        "b": (False, "title missing, no ingredients matched, no directions matched"),
        "c": (True, "no ingredients matched, no directions matched"),
    }


def test_cleanup(spark):
    labels = spark.createDataFrame(
        [
            ("dup", "t", ["0", "0", "x", "x"], []),
            ("dup_without_page", "t", ["x", "x"], []),
            ("case", "t", ["X", "x", "", ""], ["y"]),
            ("missing", "t", ["zzz"], None),
            ("zero", "t", ["0"], None),
            ("no_page", "t", ["zzz"], None),
            ("titled", "page", ["zzz"], None),
        ],
        RECORD,
    )
    pages = spark.createDataFrame(
        [(f, f + ".html", "page with x and 0") for f in ("dup", "case", "missing", "zero", "titled")],
        "file string, page_id string, page_text string",
    )
    report = quality.cleanup_report(labels, pages)
    assert {tuple(r) for r in report.collect()} == {
        ("dup", "dup.html", "doubled ingredients"),
        ("dup_without_page", None, "doubled ingredients"),
        ("missing", "missing.html", "html missing recipe"),
        ("titled", "titled.html", "html missing recipe"),
    }
    with_title = quality.cleanup_report(labels, pages, title_col="title")
    assert "titled" not in {r.file for r in with_title.collect()}
    counts = {r.reason: r.n for r in quality.cleanup_counts(report).collect()}
    assert counts == {"doubled ingredients": 2, "html missing recipe": 2, "total": 4}
    left = {r.file for r in quality.clean_corpus(labels, report).collect()}
    assert left == {"case", "zero", "no_page"}
    assert {r.file for r in quality.dup_items(labels).collect()} == {"dup", "dup_without_page"}
    pairs = labels.join(pages, "file")
    assert {r.file for r in quality.missing_content(pairs).collect()} == {"missing", "titled"}


def test_registered_domain(spark):
    rules = spark.createDataFrame([(s,) for s in ("com", "uk", "co.uk", "ck", "*.ck", "!www.ck")], "suffix string")
    urls = {
        "http://www.food.com/recipe/1": "food.com",
        "https://user:pw@A.B.Co.UK:8080/x?y#z": "b.co.uk",
        "food.com/x": "food.com",
        "//cdn.food.com": "food.com",
        "http://a.b.c.ck/": "b.c.ck",
        "http://c.ck/": "",
        "http://x.www.ck/": "www.ck",
        "http://co.uk/": "",
        "http://127.0.0.1/": "",
        "http://localhost/": "",
        "": "",
    }
    df = spark.createDataFrame([(u,) for u in urls] + [(None,)], "url string")
    got = {r.url: r.domain for r in crawl.registered_domain(df, rules).collect()}
    assert got == {**urls, None: ""}


def test_crawl_outcome(spark):
    page = "<html><body>Soup: salt</body></html>"
    rows = [
        ("no_href", None, page, "plain"), ("blank_href", " ", page, "plain"), ("no_body", "u", None, "plain"),
        ("blank", "u", " \n", "browser"), ("refused", "u", "Error 405", "plain"),
        ("refused_twice", "u", "Not Acceptable", "browser"), ("http", "u", "HTTP 404", "plain"), ("ok", " u ", page, "plain"),
    ]
    labels = spark.createDataFrame([(f, h, "Soup", ["x"], ["y"]) for f, h, _, _ in rows],
                                   "file string, href string, title string, ingredients array<string>, directions array<string>")
    fetched = spark.createDataFrame([(f, b, by) for f, _, b, by in rows if f != "no_body"], "file string, html string, fetched_by string")
    got = {r.file: (r.status, r.reason) for r in crawl.crawl_outcome(fetched, labels).collect()}
    mismatch = "title missing, no ingredients matched, no directions matched"
    assert got == {
        "no_href": ("failed", "Missing href"), "blank_href": ("failed", "Missing href"),
        "no_body": ("pending", None),
        "blank": ("failed", "Empty or invalid HTML from both methods"),
        "refused": ("needs_browser", None), "refused_twice": ("failed", mismatch),
        "http": ("failed", mismatch), "ok": ("valid", None),
    }
    urls = {r.file: r.url for r in crawl.crawl_outcome(fetched, labels).collect()}
    assert urls["ok"] == "u" and urls["no_href"] is None


def test_numbering_with_a_hot_group(spark):
    """One group holds most rows and spans several partitions."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 5 == 0, F.col("id") % 7).otherwise(99).alias("g"),
        F.xxhash64("id").alias("o"),
    ).withColumn("g", F.when(F.col("g") != 3, F.col("g")))
    got = number_within(df, ["g"], ["o"], "n", 5)
    from pyspark.sql import Window

    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("o")) + 4)
    assert got.exceptAll(want.select("g", "o", F.col("n").cast("bigint"))).count() == 0
    assert got.count() == 20_000
    everything = number_within(df, [], ["o"], "n")
    assert everything.agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()[0:3] == (0, 19_999, 20_000)


def test_ids_and_rate_limit(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("c", "y")], "file string, domain string")
    got = {r.file: (r.out_index, r.out_name) for r in crawl.assign_ids(df, 7).collect()}
    assert got == {"a": (7, "recipe_00007"), "b": (8, "recipe_00008"), "c": (9, "recipe_00009")}
    plan = {(r.domain, r.file): r.wait for r in crawl.rate_limit_plan(df).collect()}
    assert plan == {("x", "a"): 0, ("x", "b"): 60, ("y", "c"): 0}


def test_browser_domains(spark):
    start = spark.createDataFrame([("allrecipes.com",)], "domain string")
    outcomes = spark.createDataFrame([("a.com", crawl.EMPTY_BODY), ("a.com", crawl.EMPTY_BODY), ("b.com", "Missing href")], "domain string, reason string")
    grown = crawl.grow_browser_domains(start, outcomes)
    assert sorted(r.domain for r in grown.collect()) == ["a.com", "allrecipes.com"]
    pages = spark.createDataFrame([(1, "a.com"), (2, "b.com")], "i int, domain string")
    assert [r.i for r in crawl.needs_browser(pages, grown).collect()] == [1]


def test_records(spark):
    rows = [
        (1, 3, "Second", "title"), (1, 0, "First", "title"), (1, 2, "2 eggs", "ingredient"), (1, 1, "For the sauce", "ingredient"),
        (1, 10, "Bake.", "direction"), (1, 9, "For the best result, mix.", "direction"), (1, 4, "x", "none"),
        (2, 0, "1 egg", "ingredient"), (3, None, None, None),
    ]
    df = spark.createDataFrame(rows, "page_id int, idx int, text string, prediction string").repartition(5)
    got = {r.page_id: (r.title, r.ingredients, r.directions) for r in extract_records(df).collect()}
    assert got == {
        1: ("First", ["2 eggs"], ["For the best result, mix.", "Bake."]),
        2: (None, ["1 egg"], []),
        3: (None, [], []),
    }


def test_classification_report(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "a")] * 2 + [("b", "d")]
    df = spark.createDataFrame(pairs, "label string, prediction string")
    got = {r["class"]: tuple(round(v, 4) for v in (r.precision, r.recall, r.f1)) + (r.support,) for r in classification_report(df).collect()}
    assert got == {
        "a": (0.6, 0.75, 0.6667, 4), "b": (0.6667, 0.6667, 0.6667, 3), "c": (0.0, 0.0, 0.0, 2), "d": (0.0, 0.0, 0.0, 0),
        "accuracy": (0.5556, 0.5556, 0.5556, 9), "macro avg": (0.3167, 0.3542, 0.3333, 9),
        "weighted avg": (0.4889, 0.5556, 0.5185, 9),
    }
