"""Token ids as files: canonical length-limited Huffman codes from global counts, in independent blocks.

Files of a folder (all Parquet, so that any store Spark reads can hold them):

codebook  one row: dtype of the ids and the length of every id's code, from which the codes follow.
blocks    rows (part, block, start, doc_ids, lengths, data, points): whole documents in ascending
          order; part and block order the rows; start is the number of ids before the block in its
          part; points are the bit offsets of every 256th id.

A block decodes on its own. Documents come in ascending doc_id; rows without doc_id come first,
rows with the same doc_id in order of their ids' checksum. A null or empty text has the end id only.
No rows make a folder without blocks, which reads as no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.llm import huffman, tokens
from blockloom.llm.common import rows_of, table
from blockloom.session import scratch_path

BLOCK_IDS = 1 << 20  # a block is closed when it has so many ids
PORTION = 1 << 21  # characters that are tokenized at a time
END_ID = 2


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, ids): the ids with the end id, as the encoder's integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        end, width = np.array([end_id], encoder.dtype).tobytes(), encoder.dtype.itemsize
        for doc_ids, texts in rows_of(batches, ["doc_id", "text"], PORTION, "text"):
            ids = [x + end for x in encoder.encode(texts)]
            crc = [zlib.crc32(np.frombuffer(x, encoder.dtype).astype("<u4")) for x in ids]
            columns = [
                pa.array(doc_ids, pa.int64()),
                pa.array([len(x) // width for x in ids], pa.int64()),
                pa.array(crc, pa.int64()),
                pa.array(ids, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_crc32", "ids"])

    schema = "doc_id bigint, n_tokens bigint, ids_crc32 bigint, ids binary"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def count_ids(tokenized: DataFrame, dtype: np.dtype) -> DataFrame:
    """(id, n): how often every id occurs. A task adds up its own first, so few rows are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                found = np.bincount(np.frombuffer(ids.as_buffer(), dtype))
                if len(found) > len(total):
                    total = np.pad(total, (0, len(found) - len(total)))
                total[: len(found)] += found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    return tokenized.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode all documents and write codebook and blocks below the path.

    The driver gets one count per id of the vocabulary. Ids are held once between
    counting and coding, as a table in the shared folder, and are shuffled in that form.
    """
    dtype = tokens.Encoder(tokenizer).dtype
    held = scratch_path(docs.sparkSession, "ids")
    made = tokenize(docs, tokenizer, end_id)
    made.write.option("compression", "zstd").parquet(held)
    ids = docs.sparkSession.read.schema(made.schema).parquet(held)

    counted = count_ids(ids, dtype).collect()
    counts = np.zeros(max([r["id"] for r in counted], default=0) + 1, np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    lengths = huffman.code_lengths(counts)
    docs.sparkSession.createDataFrame(
        [(dtype.str, lengths.tobytes())], "dtype string, lengths binary"
    ).coalesce(1).write.parquet(f"{path}/codebook")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = huffman.codes(lengths), TaskContext.get().partitionId()
        state = {"block": 0, "start": 0}

        def close(doc_ids: list, parts: list[bytes]) -> pa.RecordBatch:
            sizes = [len(p) // dtype.itemsize for p in parts]
            data, points = huffman.pack(np.frombuffer(b"".join(parts), dtype), code, lengths)
            row = [[part], [state["block"]], [state["start"]], [doc_ids], [sizes], [data], [points]]
            state["block"] += 1
            state["start"] += sum(sizes)
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, BLOCK)], schema=BLOCK)

        doc_ids, parts, size = [], [], 0
        for batch in batches:
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                parts.append(x.as_py())
                size += len(parts[-1]) // dtype.itemsize
                if size >= BLOCK_IDS:
                    yield close(doc_ids, parts)
                    doc_ids, parts, size = [], [], 0
        if parts:
            yield close(doc_ids, parts)

    order = ["doc_id", "ids_crc32", "n_tokens"]
    ranged = ids.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    ranged.mapInArrow(run, BLOCK_DDL).write.option("compression", "none").parquet(f"{path}/blocks")


BLOCK = pa.schema(
    [
        ("part", pa.int64()),
        ("block", pa.int64()),
        ("start", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("data", pa.binary()),
        ("points", pa.binary()),
    ]
)
BLOCK_DDL = (
    "part bigint, block bigint, start bigint, doc_ids array<bigint>, lengths array<bigint>, data binary, points binary"
)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, place, doc_id, start_in_part, ids), ids as the codebook's integers."""
    book = spark.read.parquet(f"{path}/codebook").first()
    lengths, dtype = np.frombuffer(book["lengths"], np.uint8), np.dtype(book["dtype"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, longest = huffman.unpack_table(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                part, block, start, doc_ids, sizes, data, points = (c[i].as_py() for c in batch.columns)
                ends = np.cumsum(np.array(sizes, np.int64))
                ids = huffman.unpack(data, points, int(ends[-1]), lookup, longest).astype(dtype)
                starts = ends - sizes
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * n, pa.int64()),
                        pa.array([block] * n, pa.int64()),
                        pa.array(range(n), pa.int64()),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(start + starts),
                        pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    ],
                    ["part", "block", "place", "doc_id", "start_in_part", "ids"],
                )

    schema = "part bigint, block bigint, place bigint, doc_id bigint, start_in_part bigint, ids binary"
    blocks = spark.read.schema(BLOCK_DDL).parquet(f"{path}/blocks")
    return blocks.mapInArrow(run, schema)


def digest(ids: DataFrame, dtype: np.dtype) -> DataFrame:
    """(part, doc_id, start_in_part, n_tokens, ids_crc32) of rows that read_token_files gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_buffer(), dtype) for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4")) for x in found], pa.int64()),
                ],
                ["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"],
            )

    schema = "part bigint, doc_id bigint, start_in_part bigint, n_tokens bigint, ids_crc32 bigint"
    return ids.select("part", "doc_id", "start_in_part", "ids").mapInArrow(run, schema)


def with_starts(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Rows with start: the ids in all parts before, plus start_in_part. One row per file is ordered."""
    blocks = spark.read.schema(BLOCK_DDL).parquet(f"{path}/blocks")
    size = F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)
    parts = blocks.groupBy("part").agg(F.sum(size).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(parts, "part").withColumn("start", F.col("before") + F.col("start_in_part"))


def op1_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the files and back: (doc_id, start, n_tokens, ids_crc32)."""
    path, tokenizer = scratch_path(spark, "token-files"), tokens.default_path()
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer)
    dtype = np.dtype(spark.read.parquet(f"{path}/codebook").first()["dtype"])
    rows = with_starts(spark, path, digest(read_token_files(spark, path), dtype))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")
