"""The engine's inputs, derived from the given tables.

A page's url ends in the number of the document it was made from; so the
documents serve as candidate label records and the pages as their crawled pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators.crawl import FILE_PATTERN
from blockloom.operators.features import UNITS, FeatureRules
from blockloom.operators.flatten import SectionRules
from blockloom.session import spread

ITEM_CHARS = 120

# The generated text has no recipe words; these keywords do occur in it.
SECTIONS = SectionRules(ingredient=("the", "der"), direction=("la", "que", "in"))
FEATURES = FeatureRules(
    ingredient=("ad",), direction=("step",), title=("a",), units=(*UNITS, "the", "la", "un")
)
SUFFIXES = ("com", "net", "org", "example.org", "*.ck", "!www.ck")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """A table whose rows are costly to process, on all cores."""
    return spread(table(spark, sf, name).select(*columns))


def page_files(pages: DataFrame) -> DataFrame:
    """Pages with the stem (file) of the document they belong to."""
    number = F.regexp_extract("url", r"^https?://[^/]+/[a-z]+/(\d+)", 1).cast("int")
    return pages.withColumn("file", F.format_string(FILE_PATTERN, number))


def candidate_labels(documents: DataFrame) -> DataFrame:
    """(file, doc_id, title, ingredients, directions): first line, short lines, long lines."""
    lines = F.split("text", "\n")
    rest = F.slice("__lines", 2, 2**30)
    return (
        documents.select("doc_id", lines.alias("__lines"))
        .select(
            F.format_string(FILE_PATTERN, F.col("doc_id").cast("int")).alias("file"),
            "doc_id",
            F.col("__lines")[0].alias("title"),
            F.filter(rest, lambda i: F.char_length(i) <= ITEM_CHARS).alias("ingredients"),
            F.filter(rest, lambda i: F.char_length(i) > ITEM_CHARS).alias("directions"),
        )
    )


def suffix_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s,) for s in SUFFIXES], "suffix string")


def page_labels(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, title, ingredients, directions): the label record of every page."""
    pages = page_files(table(spark, sf, "pages").select("page_id", "url"))
    labels = candidate_labels(texts(spark, sf, "documents", "doc_id", "text"))
    return pages.select("page_id", "file").join(labels, "file").drop("file", "doc_id")


def classes(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, label): a class per document, 'none' for the unlabelled ones."""
    docs = table(spark, sf, "documents").select("doc_id")
    label = (
        F.when(F.col("quality").isNull(), "none")
        .when(F.col("toxic") == 1, "title")
        .when(F.col("quality") == 0, "direction")
        .otherwise("ingredient")
    )
    return docs.join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", label.alias("label")
    )


def rule_labels(blocks: DataFrame) -> DataFrame:
    """Blocks with a prediction taken from their tag."""
    tag = F.col("tag")
    return blocks.withColumn(
        "prediction",
        F.when(tag == "h1", "title").when(tag == "li", "ingredient").when(tag == "p", "direction").otherwise("none"),
    )
