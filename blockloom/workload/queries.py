"""One query per operator, each over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.functions.text import (
    clean_items as clean,
    contains_any as contains,
    is_boilerplate_item,
    nonblank_items as nonblank,
)
from blockloom.operators.numbering import number_within
from blockloom.operators import crawl, features, flatten, pairing, quality, records, reports, sampling, sections, vectors
from blockloom.plans import curation, extraction, training
from blockloom.session import scratch_path, stored
from blockloom.sources import bodies, corpus, labels as label_files, pages as page_sources, state as crawl_state
from blockloom.streaming import extract as stream_extract, ingest, throttle as throttling
from blockloom.workload import inputs
from blockloom.workload.inputs import table, texts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DAY = 86_400
WITHOUT_NAV = tuple(t for t in flatten.EXCLUDED_TAGS if t != "nav")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _joined(column: str, sep: str = "\n"):
    return F.array_join(column, sep).alias(column)


def _blocks(spark: SparkSession, sf: str, **options) -> DataFrame:
    return flatten.html_blocks(texts(spark, sf, "pages", "page_id", "html"), **options)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("lines"))


# -- flattening ---------------------------------------------------------------

@query
def html_blocks(spark, sf):
    return _blocks(spark, sf).select("page_id", "idx", "text", "tag", "depth")


@query
def li_blocks(spark, sf):
    blocks = _blocks(spark, sf, exclude=WITHOUT_NAV)
    return blocks.where("tag = 'li'").select("page_id", "idx", "text", "depth")


@query
def block_attrs(spark, sf):
    return _blocks(spark, sf).select("page_id", "idx", "itemprop", _joined("class", " "), "id")


@query
def unreadable_pages(spark, sf):
    """Blocks and skipped pages of one walk; every fifth page comes once more, with a declaration that breaks off."""
    pages = texts(spark, sf, "pages", "page_id", "html")
    broken = pages.where("page_id % 5 = 3").select((-1 - F.col("page_id")).alias("page_id"), F.concat("html", F.lit("<p>z<![x [y")).alias("html"))
    rows = stored(flatten.html_blocks(pages.unionByName(broken), report=True))
    blocks, skipped = flatten.split_unreadable(rows)
    return blocks.select("page_id", "idx", "text", F.lit(None).cast("string").alias("reason")).unionByName(skipped, True)


@query
def page_text_body(spark, sf):
    return flatten.page_text(texts(spark, sf, "pages", "page_id", "html"), "body").select("page_id", "page_text")


@query
def page_text_document(spark, sf):
    return flatten.page_text(texts(spark, sf, "pages", "page_id", "html"), "document").select("page_id", "page_text")


# -- items --------------------------------------------------------------------

@query
def clean_items(spark, sf):
    items = clean(F.col("lines"))
    return _lines(spark, sf).select("doc_id", F.array_join(items, "\n").alias("items"), F.size(items).alias("n"))


@query
def nonblank_items(spark, sf):
    items = nonblank(F.col("lines"))
    return _lines(spark, sf).select("doc_id", F.array_join(items, "\n").alias("items"), F.size(items).alias("n"))


@query
def boilerplate_items(spark, sf):
    """Lines, with the openings of the generated text standing in for recipe wording."""
    line = F.regexp_replace("line", r"^(The|Der|La|El|Of) ", "For the ")
    line = F.regexp_replace(line, r"^(In|En|Un) ", "Fat: 3 ")
    rows = _lines(spark, sf).select("doc_id", F.posexplode("lines").alias("pos", "line"))
    return rows.select("doc_id", "pos", is_boilerplate_item(line).alias("boilerplate"))


@query
def read_labels(spark, sf):
    """Label records written as JSON lines, with broken lines and odd values beside them, and read back."""
    root = scratch_path(spark, "labels")
    _label_lines(_labels(spark, sf).withColumn("n", F.col("doc_id"))).write.text(root)
    return _label_rows(label_files.read_packed_labels(spark, root))


def _label_lines(labels: DataFrame, whole: bool = False) -> DataFrame:
    """JSON lines of label records; a broken one more for every 50th n, odd unread values in others.

    whole: a text for each file instead, (stem, value), and a broken one in place of every 50th.
    """
    n = F.col("n")
    odd = F.struct(
        *[F.col(c) for c in labels.columns if c not in ("n", "doc_id", "batch")],
        F.when(n % 3 == 0, F.lit("5")).when(n % 3 == 1, F.lit("4.5")).alias("rating"),
        F.when(n % 4 == 0, F.lit("yes")).alias("hidden"),
        (n + 3_000_000_000).alias("__v"),
    )
    broken = F.concat(F.lit('{"file": "'), F.col("file"), F.lit('", "title": '))
    if whole:
        return labels.select(F.col("file").alias("stem"), F.when(n % 50 == 7, broken).otherwise(F.to_json(odd)).alias("value"))
    lines = F.when(n % 50 == 7, F.array(F.to_json(odd), broken)).otherwise(F.array(F.to_json(odd)))
    return labels.select(F.explode(lines).alias("value"))


def _label_rows(rows: DataFrame) -> DataFrame:
    """Good and bad records side by side; a bad one is named by the hash of its text."""
    good = label_files.good_records(rows).select("file", "title", _joined("ingredients"), _joined("directions"))
    bad = label_files.bad_records(rows).select(
        F.substring_index("file", "#", -1).alias("file"), F.col("reason").alias("title"),
        F.lit(None).cast("string").alias("ingredients"), F.lit(None).cast("string").alias("directions"),
    )
    return good.unionByName(bad)


@query
def page_files(spark, sf):
    """Pages written as a file each and read back by their names."""
    root = scratch_path(spark, "page-files")
    pages = texts(spark, sf, "pages", "page_id", "html")
    n = _write_files(pages.select(F.concat("page_id", F.lit(".html")).alias("name"), F.col("html").alias("value")), root)
    files = _in_tasks(page_sources.read_pages(spark, f"{root}/*"), n)
    html = F.replace(F.col("html"), F.lit("\x00"), F.lit(""))
    return files.select(F.col("file").cast("bigint").alias("page_id"), F.md5(html).alias("md5"), F.char_length(html).alias("n_chars"))


def _write_files(rows: DataFrame, root: str) -> int:
    """Files that end in a zero, as Spark skips empty ones when it reads; returns their number."""
    return corpus.write_files(rows.withColumn("value", F.concat(F.coalesce("value", F.lit("")), F.lit("\x00"))), root)


def _in_tasks(files: DataFrame, n: int) -> DataFrame:
    """Rows of n small files, some hundreds of them to a task."""
    return files.coalesce(max(files.sparkSession.sparkContext.defaultParallelism, n // label_files.TASK_FILES))


@query
def read_label_files(spark, sf):
    """Label records written as a JSON file each, some broken, and read back by their names, once for good and bad ones."""
    root = scratch_path(spark, "label-files")
    labels = inputs.candidate_labels(texts(spark, sf, "documents", "doc_id", "text"))
    lines = _label_lines(labels.withColumn("n", F.col("doc_id")), whole=True)
    _write_files(lines.select(F.concat("stem", F.lit(".json")).alias("name"), "value"), root)
    rows = label_files.stored_labels(spark, f"{root}/*")
    plain = lambda c: F.replace(F.col(c), F.lit("\x00"), F.lit("")).alias(c)
    return _label_rows(rows).select("file", plain("title"), "ingredients", "directions")


@query
def write_corpus(spark, sf):
    valid = _outcomes(spark, sf).where("status = 'valid'").select("page_id", "title")
    return corpus.write_corpus(stored(valid), scratch_path(spark, "corpus"), key="page_id")


@query
def materialize(spark, sf):
    blocks = _blocks(spark, sf).select("page_id", "idx", "text")
    root = scratch_path(spark, "materialized")
    corpus.materialize(blocks, root, [sf], limit=None)
    return corpus.materialize(blocks, root, [sf], limit=None)


# -- joins --------------------------------------------------------------------

def _labels(spark, sf):
    return inputs.candidate_labels(table(spark, sf, "documents"))


def _pages(spark, sf):
    return inputs.page_files(table(spark, sf, "pages"))


def _pairs(spark, sf):
    """(page_id, title, ingredients, directions, page_text) of body text."""
    pages = flatten.page_text(texts(spark, sf, "pages", "page_id", "html"), "body").drop("html")
    return pairing.pair(inputs.page_labels(spark, sf), pages, "page_id")


@query
def pair_pages(spark, sf):
    pages = _pages(spark, sf).select("file", "page_id", "url")
    return pairing.pair(_labels(spark, sf), pages).select("file", "page_id", "url", "title")


@query
def pair_left(spark, sf):
    pages = _pages(spark, sf).select("file", "page_id")
    return pairing.pair_left(_labels(spark, sf), pages).select("file", "page_id", "title")


@query
def pending_items(spark, sf):
    state = table(spark, sf, "labels").select(
        crawl_file("doc_id"), F.when(F.col("quality") == 1, "processed").otherwise("failed").alias("status")
    )
    files = table(spark, sf, "documents").select(crawl_file("doc_id"))
    first = pairing.pending(files, state).select("file", F.lit(False).alias("retry_failed"))
    again = pairing.pending(files, state, retry_failed=True).select("file", F.lit(True).alias("retry_failed"))
    return first.unionByName(again)


def crawl_file(column: str):
    return F.format_string(crawl.FILE_PATTERN, F.col(column).cast("int")).alias("file")


@query
def contains_any(spark, sf):
    items = nonblank(F.concat("ingredients", "directions"))
    return _pairs(spark, sf).select("page_id", contains(F.col("page_text"), items).alias("found"))


@query
def fuzzy_candidates(spark, sf):
    rows = pairing.fuzzy_candidates(_blocks(spark, sf), inputs.page_labels(spark, sf), "page_id")
    return rows.select(
        "page_id", "idx", "t",
        _joined("ing_candidates"), _joined("dir_candidates"),
        F.size("ing_candidates").alias("n_ing"), F.size("dir_candidates").alias("n_dir"),
        "title_candidate",
    )


@query
def fuzzy_label(spark, sf):
    rows = pairing.fuzzy_label(_blocks(spark, sf), inputs.page_labels(spark, sf), "page_id")
    return rows.select("page_id", "idx", "text", "label")


@query
def registered_domain(spark, sf):
    rows = crawl.registered_domain(table(spark, sf, "pages").select("page_id", "url"), inputs.suffix_rules(spark))
    return rows.select("page_id", "url", "domain")


# Attempts beside the real pages, by the last digit of the page they repeat: blank, mistaken and refused
# bodies, a record without href, and one that is not fetched yet. Their keys are negative.
BLANK, MISTAKEN, REFUSED, TURNED_AWAY, NO_HREF, NOT_YET = 3, 4, 5, 6, 7, 8


def _attempts(pages):
    """pages and the attempts beside them: kind is 0 for a page itself. Bodies stay on the pages."""
    n = (F.col("page_id") % 10).cast("int")
    kinds = F.when(n.between(BLANK, NOT_YET), F.array(F.lit(0), n)).otherwise(F.array(F.lit(0)))
    rows = pages.withColumn("kind", F.explode(kinds)).withColumnRenamed("page_id", "page")
    key = F.when(F.col("kind") == 0, F.col("page")).otherwise(-1 - F.col("page"))
    return rows.withColumn("page_id", key)


def _fetched(spark, sf):
    """Bodies as a crawler may have left them: every page's, and those of the attempts beside them."""
    kind = F.col("kind")
    body = (
        F.when(kind == BLANK, "  ").when(kind == MISTAKEN, "HTTP 404").when(kind == REFUSED, "<p>Error 405</p>")
        .when(kind == TURNED_AWAY, "<html><body>Not Acceptable</body></html>").otherwise(F.col("html"))
    )
    rows = _attempts(texts(spark, sf, "pages", "page_id", "html")).where(kind != NOT_YET)
    return rows.select("page_id", body.alias("html"))


def _outcomes(spark, sf):
    href = F.when(F.col("kind") == NO_HREF, F.lit(" ")).otherwise(F.col("url")).alias("href")
    tries = _attempts(table(spark, sf, "pages").select("page_id", "url")).select("page", "page_id", href)
    labels = inputs.page_labels(spark, sf).withColumnRenamed("page_id", "page").join(tries, "page").drop("page")
    return crawl.crawl_outcome(_fetched(spark, sf), labels, "page_id")


@query
def crawl_outcome(spark, sf):
    return _outcomes(spark, sf).select("page_id", "url", "status", "reason")


@query
def browser_domains(spark, sf):
    # Outcomes and domains are narrow: each is worked out once.
    outcomes = stored(_outcomes(spark, sf).select("page_id", "url", "reason"))
    rows = stored(crawl.registered_domain(outcomes, inputs.suffix_rules(spark)).select("page_id", "domain", "reason"))
    start = spark.createDataFrame([(d,) for d in crawl.BROWSER_DOMAINS], "domain string")
    return crawl.needs_browser(rows, crawl.grow_browser_domains(start, rows)).select("page_id", "domain")


# -- quality ------------------------------------------------------------------

@query
def dup_lines(spark, sf):
    return quality.dup_items(_lines(spark, sf), "doc_id", "lines")


@query
def validate_pages(spark, sf):
    bodies = flatten.page_text(texts(spark, sf, "pages", "page_id", "html"), "document").drop("html")
    pairs = pairing.pair(inputs.page_labels(spark, sf), bodies, "page_id")
    return quality.validate_pages(pairs).select(
        "page_id", "title_ok", "ingredients_ok", "directions_ok", "valid", "reasons"
    )


@query
def missing_content(spark, sf):
    return quality.missing_content(_pairs(spark, sf), "page_id")


def _report(spark, sf):
    return curation.clean(inputs.page_labels(spark, sf), texts(spark, sf, "pages", "page_id", "html").withColumn("page", F.col("page_id")), "page_id", "page")


@query
def cleanup_report(spark, sf):
    return _report(spark, sf)[0]


@query
def cleanup_counts(spark, sf):
    return quality.cleanup_counts(_report(spark, sf)[0])


@query
def clean_corpus(spark, sf):
    return _report(spark, sf)[1].select("page_id", "title")


# -- context, numbering, sampling ---------------------------------------------

@query
def section_context(spark, sf):
    rows = sections.section_context(stored(_blocks(spark, sf)), rules=inputs.SECTIONS)
    return rows.select("page_id", "idx", "section")


@query
def position_ratio(spark, sf):
    rows = sections.block_context(stored(_blocks(spark, sf)), rules=inputs.SECTIONS)
    return rows.select("page_id", "idx", F.round(sections.position_ratio(), 9).alias("position_ratio"))


@query
def assign_ids(spark, sf):
    # Range partitioning samples its input first, so the outcomes are kept.
    rows = stored(_outcomes(spark, sf).where("status = 'valid'").select("page_id"))
    return crawl.assign_ids(rows, 17, "page_id")


@query
def rate_limit_plan(spark, sf):
    rows = crawl.registered_domain(table(spark, sf, "pages").select("page_id", "url"), inputs.suffix_rules(spark))
    return crawl.rate_limit_plan(rows, "domain", "page_id")


@query
def limit_blocks(spark, sf):
    pages = sampling.limit_files(table(spark, sf, "pages"), 40)
    return sampling.limit_blocks(flatten.html_blocks(pages), 40).select("page_id", "idx", "text")


@query
def train_test_split(spark, sf):
    return sampling.train_test_split(inputs.classes(spark, sf), ["doc_id"])


@query
def class_plan(spark, sf):
    return sampling.class_plan(inputs.classes(spark, sf), ratio=1, floor=0.5)


@query
def balance_classes(spark, sf):
    return sampling.balance_classes(inputs.classes(spark, sf), ["doc_id"], ratio=1, floor=0.5)


@query
def class_plan_defaults(spark, sf):
    return sampling.class_plan(inputs.classes(spark, sf))


@query
def balance_classes_defaults(spark, sf):
    return sampling.balance_classes(inputs.classes(spark, sf), ["doc_id"])


@query
def shuffle_rows(spark, sf):
    """Every class row with its place in the seeded order."""
    rows = sampling.shuffle(inputs.classes(spark, sf), ["doc_id"])
    ordered = stored(rows.withColumn("__at", F.monotonically_increasing_id()))
    return number_within(ordered, [], ["__at"], "place").select("doc_id", "label", "place")


@query
def classification_report(spark, sf):
    n, lang = F.col("n_chars"), F.col("lang")
    guess = (
        F.when(n < 600, "none").when(lang == "en", "ingredient").when(lang == "fr", "direction").otherwise("extra")
    )
    guesses = table(spark, sf, "documents").select("doc_id", guess.alias("prediction"))
    report = reports.classification_report(inputs.classes(spark, sf).join(guesses, "doc_id"))
    return report.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


# -- features and vectors -----------------------------------------------------

def _features(spark, sf):
    return extraction.featurised(
        texts(spark, sf, "pages", "page_id", "html"), sections=inputs.SECTIONS, features=inputs.FEATURES
    )


@query
def block_features(spark, sf):
    columns = [c for c in features.STRUCTURED if c != "position_ratio"]
    return _features(spark, sf).select(
        "page_id", "idx", "raw", *columns, F.round("position_ratio", 9).alias("position_ratio")
    )


@query
def dict_vectorize(spark, sf):
    rows = features.dict_vectorize(_features(spark, sf), ["page_id", "idx"])
    return rows.select("page_id", "idx", "key", F.round("value", 9).alias("value"))


@query
def dict_vectors(spark, sf):
    """Vectors of all blocks by stages that were fitted to the first three blocks of every page."""
    rows = stored(_features(spark, sf))
    model = vectors.fit_structured(rows.where("idx < 3"))
    found = vectors.vector_entries(model.transform(rows), ["page_id", "idx"], "structured", vectors.structured_names(model))
    return found.select("page_id", "idx", "key", F.round("value", 9).alias("value"))


@query
def tfidf_vocab(spark, sf):
    return vectors.tfidf_vocab(texts(spark, sf, "documents", "text"))


@query
def tfidf_weights(spark, sf):
    rows = vectors.tfidf_weights(texts(spark, sf, "documents", "doc_id", "text"), ["doc_id"])
    return rows.select("doc_id", "term", F.round("weight", 6).alias("weight"))


# -- records and model --------------------------------------------------------

def _rule_records(spark, sf):
    return records.extract_records(
        inputs.rule_labels(_blocks(spark, sf, exclude=WITHOUT_NAV, keep_empty_pages=True))
    )


@query
def extract_records(spark, sf):
    return _rule_records(spark, sf).select("page_id", "title", _joined("ingredients"), _joined("directions"))


@query
def records_json(spark, sf):
    return corpus.records_json(_rule_records(spark, sf))


def _blocks_to_learn(spark, sf):
    return training.labeled_blocks(
        inputs.page_labels(spark, sf), texts(spark, sf, "pages", "page_id", "html"), "page_id",
        sections=inputs.SECTIONS, features=inputs.FEATURES,
    )


_FITTED: dict[tuple[str, str], str] = {}


def _fitted(spark, sf):
    """Folder with model and report of the training job, run with its defaults by the first query that needs it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITTED:
        root = scratch_path(spark, "fitted")
        trained = training.train(_blocks_to_learn(spark, sf), ["page_id", "idx"])
        training.save_model(trained.model, f"{root}/model")
        trained.report.write.parquet(f"{root}/report")
        _FITTED[key] = root
    return _FITTED[key]


def _model(spark, sf):
    return training.load_model(f"{_fitted(spark, sf)}/model")


@query
def train_eval(spark, sf):
    return spark.read.parquet(f"{_fitted(spark, sf)}/report")


@query
def train_counts(spark, sf):
    """Blocks of pages with label records by where training puts them: what is split, before fitting."""
    split = sampling.train_test_split(_blocks_to_learn(spark, sf), ["page_id", "idx"])
    return split.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query
def predict_blocks(spark, sf):
    return training.predict(_model(spark, sf), _features(spark, sf)).select("page_id", "idx", "text", "prediction")


# -- streaming ----------------------------------------------------------------

def _stream(spark, sf, name):
    """A table as it arrives, a file per core at a time. The braces make a glob of its name, which may be a file or a folder's."""
    schema = table(spark, sf, name).schema
    files = spark.sparkContext.defaultParallelism
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf}/{{{name}.parquet}}")


@query
def throttle_events(spark, sf):
    rows = throttling.throttle(table(spark, sf, "events"), "user_id", "ts", DAY, "event_id")
    return rows.select("user_id", "event_id", "accepted")


@query
def throttle_stream(spark, sf):
    """The events as they arrive, two weeks at a time; the last batch has the first ones once more, too late."""
    root = scratch_path(spark, "throttle")
    throttling.rocksdb_state(spark)
    events = table(spark, sf, "events")
    week = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / (14 * DAY))
    weeks = [r["w"] for r in events.select(week.alias("w")).distinct().where("w is not null").orderBy("w").collect()]
    late = events.where(week == weeks[0]).withColumn("event_id", -1 - F.col("event_id")) if weeks else events.limit(0)
    for rows in [*[events.where(week == w) for w in weeks], late]:
        rows.write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/in")
        passed = throttling.throttle_stream(stream, "user_id", "ts", DAY, "event_id")
        passed.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(
            availableNow=True
        ).start(f"{root}/out").awaitTermination()
    return spark.read.parquet(f"{root}/out").select("user_id", "event_id")


@query
def ingest_stream(spark, sf):
    root = scratch_path(spark, "ingest")
    named = F.when(F.col("page_id") < 0, F.concat(F.lit("recipe_x"), -1 - F.col("page_id"))).otherwise(
        F.format_string(crawl.FILE_PATTERN, F.col("page_id").cast("int"))
    )
    bodies.write_bodies(_fetched(spark, sf).select(named.alias("file"), "html"), f"{root}/bodies")
    fetched = bodies.read_bodies(spark, f"{root}/bodies")
    labels = stored(_ingest_labels(spark, sf, named), ingest.TEXTS)
    for batch in range(4):
        lines = _label_lines(labels.where(F.col("batch") == batch))
        lines.write.mode("append").option("compression", "gzip").text(f"{root}/in")
        stream = label_files.parse_packed_labels(spark.readStream.text(f"{root}/in"))
        ingest.ingest_stream(
            stream, fetched, inputs.suffix_rules(spark), f"{root}/state", f"{root}/corpus", f"{root}/checkpoint"
        ).awaitTermination()
    found = crawl_state.load_state(spark, f"{root}/state")
    return found.withColumn("file", F.substring_index("file", "#", -1))


def _ingest_labels(spark, sf, named):
    """Label records in four batches: pages in 0, 1 and 3, blank attempts in 2, others in 0 and 1;
    documents without a page, which have no href, by their ids."""
    n, kind = F.col("n"), F.col("kind")
    href = F.when(kind == NO_HREF, F.lit(" ")).otherwise(F.col("url")).alias("href")
    batch = (
        F.when(kind == 0, F.element_at(F.array(F.lit(0), F.lit(1), F.lit(3)), (n % 3 + 1).cast("int")))
        .when(kind == BLANK, F.lit(2)).otherwise(n % 2)
    )
    tries = _attempts(_pages(spark, sf).select("page_id", "url", F.col("file").alias("document"))).withColumn("paged", F.lit(True))
    records = _labels(spark, sf).withColumnRenamed("file", "document")
    rows = records.join(tries, "document", "left")  # one join for both, as the records are wide
    of = lambda paged, other: F.when(F.col("paged"), paged).otherwise(other)
    return rows.select(
        of(named, F.concat(F.lit("recipe_d"), F.col("doc_id"))).alias("file"), "title", "ingredients", "directions",
        of(href, F.lit(None)).alias("href"), of(F.col("page"), F.col("doc_id")).alias("n"),
        of(batch.cast("bigint"), F.col("doc_id") % 4).alias("batch"),
    )


class _TagRules(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A model of fixed rules: the label follows from the tag."""

    def _transform(self, dataset):
        return inputs.rule_labels(dataset)


@query
def rule_predictions(spark, sf):
    """The scoring job with a model whose answers are known."""
    rows = training.predict(PipelineModel([_TagRules()]), _features(spark, sf))
    return rows.select("page_id", "idx", "text", "prediction")


@query
def rule_extract_stream(spark, sf):
    """The streaming extraction job with that model."""
    root = scratch_path(spark, "extract-rules")
    stream_extract.extract_stream(
        _stream(spark, sf, "pages"), PipelineModel([_TagRules()]), f"{root}/out", f"{root}/checkpoint"
    ).awaitTermination()
    rows = spark.read.parquet(f"{root}/out")
    return rows.select("page_id", "title", _joined("ingredients"), _joined("directions"))


@query
def extract_stream(spark, sf):
    root = scratch_path(spark, "extract")
    stream_extract.extract_stream(
        _stream(spark, sf, "pages"), _model(spark, sf), f"{root}/out", f"{root}/checkpoint"
    ).awaitTermination()
    return spark.read.parquet(f"{root}/out").select("page_id", "title", "ingredients", "directions")
