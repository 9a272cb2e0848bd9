"""Sinks: the validated corpus, labelled blocks, extracted records, a file per row."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators.crawl import assign_ids

FOLDERS = 64  # that files are dealt out to: more than Spark lists one after the other


def write_files(rows: DataFrame, path: str) -> int:
    """Write the text of every row (name, value) to a file of that name, in folders below path; returns their number.

    Tasks write through Arrow's file systems (path: local, or file, hdfs, s3, gs, abfs), as Spark's own writer has a
    folder per row and moves one after the other when it commits. A file gets its name when it is whole, so a task that
    runs again replaces what it has written. A null text is an empty file. Read them by path/*.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        own, made, written = TaskContext.get().taskAttemptId(), set(), 0
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                folder = f"{root}/{zlib.crc32(name.encode()) % FOLDERS:02x}"
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/_{name}.{own}"
                with store.open_output_stream(part, compression=None) as out:
                    out.write((value.as_py() or "").encode())
                store.move(part, f"{folder}/{name}")
                written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], ["files"])

    return rows.select("name", "value").mapInArrow(run, "files bigint").agg(F.sum("files")).first()[0] or 0


def write_corpus(pairs: DataFrame, path: str, start: int = 0, key: str = "file") -> DataFrame:
    """Write valid pairs under dense names (out_name); returns what was written."""
    assign_ids(pairs, start, key).write.mode("overwrite").parquet(path)
    return pairs.sparkSession.read.parquet(path)


def materialize(df: DataFrame, root: str, inputs: list[str], **options) -> DataFrame:
    """Write df below root once per (inputs, options) and read it back.

    The name covers the input paths and all options, so other inputs or limits
    never meet an old result. A marker table is written last; without it an
    earlier write is taken as unfinished and redone.
    """
    text = json.dumps([sorted(inputs), sorted(options.items())], default=str)
    path = f"{root.rstrip('/')}/{hashlib.sha256(text.encode()).hexdigest()[:24]}"
    spark = df.sparkSession
    if not _exists(spark, f"{path}.done"):
        df.write.mode("overwrite").parquet(path)
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{path}.done")
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.parquet(path).columns)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def records_json(records: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, json): one object per record; a missing title is written as null."""
    body = F.to_json(F.struct("title", "ingredients", "directions"), {"ignoreNullFields": "false"})
    return records.select(key, body.alias("json"))


def write_records(records: DataFrame, path: str, mode: str = "error") -> None:
    """Write records as JSON lines."""
    records.write.mode(mode).option("ignoreNullFields", "false").json(path)
