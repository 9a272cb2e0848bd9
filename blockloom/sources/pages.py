"""Pages: a table with a url and html, or a folder of HTML files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.sources.labels import stem

PAGE_SCHEMA = "page_id bigint, url string, html string"


def read_pages(spark: SparkSession, path: str, pattern: str = "*.html", name: Column | None = None) -> DataFrame:
    """(file, html) for every HTML file, keyed by its stem, or by another name from the file's _metadata."""
    own = stem(F.col("_metadata.file_name")) if name is None else name
    return (
        spark.read.option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
        .select(own.alias("file"), F.col("value").alias("html"))
    )


def read_page_table(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) from parquet."""
    return spark.read.schema(PAGE_SCHEMA).parquet(path)
