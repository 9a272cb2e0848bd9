"""Fetched bodies as a table in buckets of the file, so that a batch of files reads its own buckets only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.sources.state import BUCKET, in_buckets, write_bucketed

BODY_SCHEMA = f"file string, html string, fetched_by string, {BUCKET} int"


def write_bodies(fetched: DataFrame, path: str) -> None:
    """fetched (file, html[, fetched_by]); the table as a whole is replaced."""
    by = "fetched_by" if "fetched_by" in fetched.columns else F.lit(None).cast("string").alias("fetched_by")
    write_bucketed(fetched.select("file", "html", by), path)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BODY_SCHEMA).parquet(path)


def bodies_of(fetched: DataFrame, files: DataFrame, buckets: list[int]) -> DataFrame:
    """The bodies of these files, the browser's where there are two. A table that is not in buckets is read whole.

    A file with several bodies is found by name first: only such files' bodies are grouped.
    """
    bucketed = BUCKET in fetched.columns
    own = (in_buckets(fetched, buckets).drop(BUCKET) if bucketed else fetched).join(files, "file", "left_semi")
    if "fetched_by" not in own.columns:
        return own
    several = own.groupBy("file").agg(F.count("*").alias("__n")).where("__n > 1").select("file")
    body = F.struct(*own.columns)
    best = own.join(several, "file", "left_semi").groupBy("file").agg(
        F.max_by(body, F.coalesce(F.col("fetched_by") == "browser", F.lit(False))).alias("b")
    )
    return own.join(several, "file", "left_anti").unionByName(best.select("b.*"))
