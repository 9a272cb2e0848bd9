"""Label records: one JSON object per file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.session import scratch_path

CORRUPT = "_corrupt"

# The fields of a label file. A value of another type is null, it does not spoil the record.
FIELDS = {
    "title": "string",
    "href": "string",
    "hash": "string",
    "image": "string",
    "ingredients": "array<string>",
    "directions": "array<string>",
    "keywords": "array<string>",
    "__v": "int",
    "users": "array<string>",
    "extension": "string",
    "ratings": "array<struct<user:string,rating:int>>",
    "hidden": "boolean",
    "rating": "int",
}

PATTERN = "recipe_*.json"
LISTED = 100_000  # files that the driver lists at once
LIST_CACHE = "spark.sql.hive.filesourcePartitionFileCacheSize"
TASK_FILES = 500  # files that a task reads: Spark would make a task of every 32


def stem(file_name):
    """File name without its folder and extension."""
    return F.regexp_replace(F.element_at(F.split(file_name, "/"), -1), r"\.[^.]*\z", "")


def _parsed(rows: DataFrame, key: str = "file") -> DataFrame:
    """(file, fields..., firstAdded, _corrupt) of the JSON texts in value.

    Only a text that is no JSON object is corrupt, and keeps itself in _corrupt. Fields are read one by
    one, so an odd value in one leaves the others alone. A corrupt line without a file of its own is named by
    its source and its hash, which keeps such lines apart.
    """
    rows = rows.withColumn("__v", F.try_parse_json("value"))
    is_record = F.coalesce(F.schema_of_variant("__v").startswith("OBJECT"), F.lit(False))
    field = lambda name, kind: F.try_variant_get("__v", f"$.{name}", kind)
    line = F.concat(F.col("__source"), F.lit("#"), F.md5("value"))
    file = F.col("__file") if "__file" in rows.columns else F.when(is_record, field(key, "string"))
    return rows.select(
        F.coalesce(file, line).alias(key),
        *[F.when(is_record, field(name, kind)).alias(name) for name, kind in FIELDS.items()],
        F.when(is_record, F.try_to_timestamp(field("firstAdded", "string"))).alias("firstAdded"),
        F.when(~is_record, F.col("value")).alias(CORRUPT),
    )


def read_labels(
    spark: SparkSession, path: str | list[str], limit_files: int | None = None, pattern: str = PATTERN, name: Column | None = None
) -> DataFrame:
    """Label records with their file stem (file), one JSON file each. name: another key, from the file's _metadata.

    Spark's driver lists all files, some 2 KB each; stored_labels() reads more than it can hold.
    """
    own = stem(F.col("_metadata.file_name")) if name is None else name
    files = (
        spark.read.option("pathGlobFilter", pattern)
        .text(path, wholetext=True)
        .select(own.alias("__file"), F.col("_metadata.file_name").alias("__source"), "value")
    )
    if limit_files is not None:
        files = files.orderBy("__file").limit(limit_files)
    return _parsed(files)


def stored_labels(spark: SparkSession, path: str, pattern: str = PATTERN, name: Column | None = None) -> DataFrame:
    """What read_labels() gives, as a table in the shared folder, read by jobs that run at once.

    path may be a glob of folders, as write_files() makes them: the driver then lists only so many of them at a time
    as hold some LISTED files together. A single folder is listed at once.
    """
    table = scratch_path(spark, "labels")
    for folders, n in _portions(spark, path):
        rows = _unlisted(spark, lambda folders=folders: read_labels(spark, folders, pattern=pattern, name=name))
        rows = rows.coalesce(max(spark.sparkContext.defaultParallelism, n // TASK_FILES))
        rows.write.mode("append").parquet(table)
    return spark.read.schema(rows.schema).parquet(table)


def _unlisted(spark: SparkSession, read: Callable[[], DataFrame]) -> DataFrame:
    """What read() gives, without Spark's driver keeping the files it lists for later readers."""
    kept = spark.conf.get(LIST_CACHE)
    spark.conf.set(LIST_CACHE, "0")
    try:
        return read()
    finally:
        spark.conf.set(LIST_CACHE, kept)


def _portions(spark: SparkSession, path: str) -> Iterator[tuple[list[str], int]]:
    """The folders of a glob, put together to some LISTED files, and how many these are."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held, total = [], 0
    for found in store.globStatus(at) or []:
        n = store.getContentSummary(found.getPath()).getFileCount()
        if held and total + n > LISTED:
            yield held, total
            held, total = [], 0
        held.append(found.getPath().toString())
        total += n
    yield held or [path], total


def parse_packed_labels(texts: DataFrame) -> DataFrame:
    """Label records of JSON lines, batch or stream, read by the text source."""
    return _parsed(texts.select(F.col("_metadata.file_name").alias("__source"), "value"))


def read_packed_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label records packed as JSON lines that carry their file stem (file).

    One small file per record does not scale; this is the form for a large corpus.
    """
    return parse_packed_labels(spark.read.text(path))


def good_records(labels: DataFrame) -> DataFrame:
    return labels.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad_records(labels: DataFrame) -> DataFrame:
    """(file, reason) of the files that could not be read."""
    return labels.where(F.col(CORRUPT).isNotNull()).select(
        "file", F.concat(F.lit("Invalid JSON: "), CORRUPT).alias("reason")
    )
