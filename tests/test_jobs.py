import json

import pytest
from pyspark.sql import functions as F

from blockloom.plans import curation
from blockloom.plans.extraction import extract
from blockloom.plans.training import labeled_blocks, load_model, predict, save_model
from blockloom.sources import corpus
from blockloom.sources.labels import bad_records, good_records, read_labels, read_packed_labels
from blockloom.session import stored
from blockloom.sources.pages import read_pages


@pytest.fixture
def folder(tmp_path):
    labels, pages = tmp_path / "labels", tmp_path / "pages"
    labels.mkdir()
    pages.mkdir()
    full = {
        "title": "Crème", "href": "http://a.com/1", "ingredients": ["0", "1 egg"], "directions": ["Beat it."], "__v": 1,
        "users": [None], "keywords": [], "hidden": True, "ratings": [{"user": "u", "rating": 5}], "firstAdded": "2016-01-02T03:04:05.000Z",
    }
    files = {
        "recipe_00003": json.dumps(full, indent=2, ensure_ascii=False), "recipe_00001": '{"title": ""}', "recipe_00002": '{"title": "x", ',
        "other": '{"title": "no"}',
    }
    for name, text in files.items():
        (labels / f"{name}.json").write_text(text, encoding="utf-8")
    (pages / "recipe_00003.html").write_text("<body><p>1 egg</p>\n<p>ü</p></body>", encoding="utf-8")
    return str(labels), str(pages)


def test_label_files(spark, folder):
    rows = {r.file: r for r in read_labels(spark, folder[0]).collect()}
    assert set(rows) == {"recipe_00001", "recipe_00002", "recipe_00003"}
    full = rows["recipe_00003"]
    assert (full.title, full.ingredients, full["__v"], full.users, full.hidden) == ("Crème", ["0", "1 egg"], 1, [None], True)
    assert full.ratings[0].rating == 5 and full.firstAdded.year == 2016
    labels = read_labels(spark, folder[0])
    assert {r.file for r in good_records(labels).collect()} == {"recipe_00001", "recipe_00003"}
    bad = bad_records(labels).collect()
    assert [r.file for r in bad] == ["recipe_00002"] and bad[0].reason.startswith("Invalid JSON")
    assert [r.file for r in read_labels(spark, folder[0], limit_files=2).collect()] == ["recipe_00001", "recipe_00002"]


def test_odd_values_in_other_fields_do_not_spoil_a_record(spark, tmp_path):
    odd = ['"rating": 4.5', '"hidden": "yes"', '"rating": "5"', '"__v": 3000000000', '"users": "me"', '"ratings": [1]', '"keywords": {}']
    lines = [f'{{"file": "recipe_{i}", "title": "t", "ingredients": ["x", 2], {o}}}' for i, o in enumerate(odd)]
    (tmp_path / "labels.jsonl").write_text("\n".join(lines))
    rows = good_records(read_packed_labels(spark, str(tmp_path / "labels.jsonl"))).collect()
    assert len(rows) == len(odd) and all(r.title == "t" and r.ingredients == ["x", "2"] for r in rows)


def test_whole_reasons(spark, tmp_path):
    (tmp_path / "labels.jsonl").write_text("x" * 999)
    bad = bad_records(read_packed_labels(spark, str(tmp_path / "labels.jsonl"))).first()
    assert bad.reason == "Invalid JSON: " + "x" * 999 and bad.file.startswith("labels.jsonl#")


def test_no_machine_local_scratch_off_one_machine(spark, monkeypatch):
    from types import SimpleNamespace

    from blockloom import session

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)), master="spark://x:7077")
    conf = SimpleNamespace(get=lambda key, default=None: default)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(SimpleNamespace(sparkContext=context, conf=conf))
    some = SimpleNamespace(isDefined=lambda: True, get=lambda: "hdfs://shared/cp")
    context._jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: some))
    assert session.shared_dir(SimpleNamespace(sparkContext=context, conf=conf)) == "hdfs://shared/cp"


def test_packed_labels(spark, tmp_path):
    lines = ['{"file": "recipe_1", "title": "a", "ingredients": ["x"]}', '{"file": "recipe_2", "tit', '{"file": "recipe_3"}']
    (tmp_path / "labels.jsonl").write_text("\n".join(lines))
    labels = read_packed_labels(spark, str(tmp_path / "labels.jsonl"))
    assert {r.file for r in good_records(labels).collect()} == {"recipe_1", "recipe_3"}
    assert bad_records(labels).count() == 1


def test_page_files(spark, folder):
    row = read_pages(spark, folder[1]).first()
    assert (row.file, row.html) == ("recipe_00003", "<body><p>1 egg</p>\n<p>ü</p></body>")


def test_validation_job(spark, folder):
    suffixes = spark.createDataFrame([("com",)], "suffix string")
    state = spark.createDataFrame([("recipe_00001", "failed")], "file string, status string")
    labels, pages = read_labels(spark, folder[0]), read_pages(spark, folder[1])
    rows = {r.file: r for r in curation.validate(labels, pages, suffixes, state).collect()}
    assert {f: r.status for f, r in rows.items()} == {"recipe_00002": "failed", "recipe_00003": "valid"}
    assert rows["recipe_00003"].domain == "a.com" and rows["recipe_00002"].reason.startswith("Invalid JSON")


def test_cleaning_job(spark, folder):
    labels = good_records(read_labels(spark, folder[0]))
    pages = read_pages(spark, folder[1]).withColumn("page_id", F.concat("file", F.lit(".html")))
    report, left = curation.clean(labels, pages)
    assert report.count() == 0 and left.count() == 2


def test_write_corpus(spark, tmp_path):
    df = spark.createDataFrame([("b", "<p>"), ("a", "<i>")], "file string, html string")
    rows = corpus.write_corpus(df, str(tmp_path / "c"), 3).orderBy("file").collect()
    assert [(r.file, r.html, r.out_index, r.out_name) for r in rows] == [("a", "<i>", 3, "recipe_00003"), ("b", "<p>", 4, "recipe_00004")]


def test_materialize(spark, tmp_path):
    root = str(tmp_path)
    one = corpus.materialize(spark.range(3), root, ["in"], limit=3)
    again = corpus.materialize(spark.range(99), root, ["in"], limit=3)  # the stored result counts
    other = corpus.materialize(spark.range(5), root, ["in"], limit=5)
    assert (one.count(), again.count(), other.count()) == (3, 3, 5)


def test_records_as_json(spark, tmp_path):
    df = spark.createDataFrame([(1, None, ["é"], [])], "page_id int, title string, ingredients array<string>, directions array<string>")
    want = {"title": None, "ingredients": ["é"], "directions": []}
    assert json.loads(corpus.records_json(df).first().json) == want
    corpus.write_records(df, str(tmp_path / "out"))
    line = spark.read.text(str(tmp_path / "out")).first().value
    assert json.loads(line) == {"page_id": 1, **want}


def test_labelled_blocks(spark, recipes):
    pages, labels = recipes
    extra = pages.union(spark.createDataFrame([("recipe_99999", "<body>x</body>")], pages.schema))
    rows = labeled_blocks(labels, extra)
    n = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    assert n["title"] >= 60 and n["ingredient"] == 240 and n["direction"] >= 180 and n["none"] > 400
    assert rows.where("file = 'recipe_99999'").count() == 0
    limited = labeled_blocks(labels, pages, limit=5).orderBy("file", "idx").collect()
    assert [(r.file, r.idx) for r in limited] == [("recipe_00000", i) for i in range(5)]


def test_model_gate(trained):
    report = {r["class"]: r for r in trained.report.collect()}
    assert report["macro avg"].f1 > 0.9
    assert report["macro avg"].support > 100


def test_extraction_and_saved_model(spark, tmp_path, recipes, model):
    pages, labels = recipes
    got = extract(pages, model, "file")
    records = {r.file: r for r in got.collect()}
    wanted = {r.file: r for r in labels.collect()}
    assert set(records) == set(wanted)
    exact = sum(records[f].ingredients == wanted[f].ingredients[1:] for f in wanted)
    assert exact > 54
    assert sum(records[f].title == wanted[f].title for f in wanted) > 54
    save_model(model, str(tmp_path / "model"))
    again = extract(pages, load_model(str(tmp_path / "model")), "file")
    assert sorted(map(repr, again.collect())) == sorted(map(repr, records.values()))
    empty = extract(spark.createDataFrame([("e", "<body></body>")], "file string, html string"), model, "file").first()
    assert tuple(empty) == ("e", None, [], [])


def test_unseen_tags_are_scored(spark, model):
    from blockloom.plans.extraction import featurised

    page = spark.createDataFrame([("n", "<body><blink>1 cup rice</blink></body>")], "file string, html string")
    assert predict(model, featurised(page, "file")).count() == 1


def test_whole_run(spark, tmp_path, recipes):
    """Files to validated corpus to clean corpus to labelled blocks."""
    source, html = tmp_path / "labels", tmp_path / "html"
    source.mkdir()
    html.mkdir()
    pages, labels = recipes
    for p in pages.limit(12).collect():
        (html / f"{p.file}.html").write_text(p.html if p.file != "recipe_00003" else "<body>gone</body>")
    for r in labels.limit(12).collect():
        record = {**r.asDict(), "href": f"http://www.site{r.file[-1]}.com/{r.file}"}
        if r.file == "recipe_00005":
            record["ingredients"] = record["ingredients"] + record["ingredients"]
        (source / f"{r.file}.json").write_text(json.dumps(record))
    suffixes = spark.createDataFrame([("com",)], "suffix string")
    fetched = read_pages(spark, str(html))
    outcome = curation.validate(read_labels(spark, str(source)), fetched, suffixes)
    assert {r.status: r["count"] for r in outcome.groupBy("status").count().collect()} == {"valid": 11, "failed": 1}
    written = corpus.write_corpus(outcome.where("status = 'valid'"), str(tmp_path / "corpus"))
    report, kept = curation.clean(written, written.select("file", "html", F.col("file").alias("page_id")))
    assert [tuple(r) for r in report.collect()] == [("recipe_00005", "recipe_00005", "doubled ingredients")]
    blocks = labeled_blocks(kept, written)
    assert blocks.select("file").distinct().count() == 10
    assert blocks.where("label = 'ingredient'").count() == 40


def test_train_counts_labels_as_training_does(monkeypatch):
    from blockloom.workload import queries

    asked = []
    monkeypatch.setattr(queries.inputs, "page_labels", lambda *_: None)
    monkeypatch.setattr(queries, "texts", lambda *_: None)
    monkeypatch.setattr(queries.training, "labeled_blocks", lambda *_, **options: asked.append(options.get("threshold", 0.8)))
    monkeypatch.setattr(queries.sampling, "train_test_split", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        queries.train_counts(None, "")
    assert asked == [0.8]


def test_a_file_per_row_in_few_folders(spark, tmp_path):
    """Files are named by their rows and read by the usual readers; running again replaces them."""
    from blockloom.sources.corpus import FOLDERS, write_files

    rows = [(f"{i}.html", f"<p>page {i}\u00e9\n</p>") for i in range(300)] + [("none.html", None)]
    frame = spark.createDataFrame(rows, "name string, value string").repartition(5)
    for path in (str(tmp_path / "out"), f"file://{tmp_path}/out"):
        assert write_files(frame, path) == 301
    folders = list((tmp_path / "out").iterdir())
    assert len(folders) <= FOLDERS and {f.name for d in folders for f in d.iterdir()} == {r[0] for r in rows}
    found = {f"{r.file}.html": r.html for r in read_pages(spark, f"{tmp_path}/out/*").collect()}
    assert {k: found.get(k) for k, _ in rows} == dict(rows)
    assert write_files(frame.limit(0), str(tmp_path / "other")) == 0


def test_label_files_are_read_once_in_tasks_of_hundreds(spark):
    from blockloom.workload.oracle import ORACLE
    from blockloom.workload.queries import QUERIES

    found = QUERIES["read_label_files"](spark, "/root/testdata/sf0.001")
    assert not any("label-files" in f for f in found.inputFiles())  # the stored records, not the files again
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert "read_label_files" in ORACLE


def test_tasks_of_boosting_do_not_grow_with_partitions(spark, recipes, monkeypatch):
    """The rows that trees are fitted to are bounded, and so are the partitions they lie in."""
    from blockloom.plans import training

    class Seen(Exception):
        pass

    class Fit:
        def __init__(self, **options):
            pass

        def fit(self, rows):
            raise Seen(rows.rdd.getNumPartitions(), rows.count())

    pages, labels = recipes
    blocks = stored(training.labeled_blocks(labels, pages))
    monkeypatch.setattr(training, "OneVsRest", Fit)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "4k")
        with pytest.raises(Seen) as seen:
            training.fit_classifier(blocks.repartition(40))
        assert seen.value.args == (1, blocks.count())
        monkeypatch.setattr(training, "TASK_ROWS", 1)
        with pytest.raises(Seen) as seen:
            training.fit_classifier(blocks.repartition(40))
        assert 1 < seen.value.args[0] <= spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_trees_are_fitted_to_all_rows(spark, recipes, monkeypatch):
    """More rows than were once fitted at most; each task has no more of them than it can keep."""
    from blockloom.plans import training

    class Seen(Exception):
        pass

    class Fit:
        def __init__(self, **options):
            pass

        def fit(self, rows):
            sizes = [r["n"] for r in rows.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
            raise Seen(sum(sizes), max(sizes))

    pages, labels = recipes
    blocks = stored(training.labeled_blocks(labels, pages))
    many = blocks.join(spark.range(-(-210_000 // blocks.count())).withColumnRenamed("id", "again"))
    monkeypatch.setattr(training, "OneVsRest", Fit)
    monkeypatch.setattr(training, "MOST_TASK_ROWS", 10_000, raising=False)
    with pytest.raises(Seen) as seen:
        training.fit_classifier(many)
    n, most = seen.value.args
    assert n == many.count() >= 210_000 and most <= 11_000


def test_folders_of_label_files_are_listed_in_portions(spark, tmp_path, monkeypatch):
    """The driver never lists all files of a glob of folders at once; the rows are those of one reading."""
    from blockloom.sources import labels

    names = [f"recipe_{i:03d}" for i in range(60)]
    for i, name in enumerate(names):
        folder = tmp_path / f"f{i % 6}"
        folder.mkdir(exist_ok=True)
        (folder / f"{name}.json").write_text('{"title": "' + name + ('"}' if i % 7 else ""))
    (tmp_path / "f0" / "other.json").write_text("{}")
    (tmp_path / "none").mkdir()
    asked, plain = [], labels.read_labels
    whole = plain(spark, f"{tmp_path}/*").collect()
    monkeypatch.setattr(labels, "read_labels", lambda s, p, **o: asked.append(plain(s, p, **o)) or asked[-1])
    monkeypatch.setattr(labels, "LISTED", 21, raising=False)
    found = labels.stored_labels(spark, f"{tmp_path}/*")
    assert sorted(found.collect(), key=str) == sorted(whole, key=str) and len(whole) == 60 and found.columns == asked[0].columns
    assert len(asked) == 3 and all(len(a.inputFiles()) <= 21 for a in asked)
    assert labels.stored_labels(spark, str(tmp_path / "f1")).count() == 10
    assert labels.stored_labels(spark, str(tmp_path / "none")).count() == 0
