"""Durable crawl state: what became of every file, as a log with snapshots.

A batch writes its entries as a folder (a delta) and then a marker: the next free index, and the snapshot
that holds all entries up to some batch. Every SNAPSHOT_EVERY batches deltas and snapshot are merged into a
new snapshot, in buckets of the hash of the file, sorted by range within them. A batch so reads its marker,
the snapshot's buckets that its files fall into, and a bounded number of deltas, however long the history.

A batch that is run again after a failure overwrites its own folders, and readers of batch n see only what
batches before n wrote, so nothing is counted twice. A snapshot counts once a marker names it.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from blockloom.operators.crawl import BROWSER_DOMAINS, EMPTY_BODY

STATE_SCHEMA = "file string, status string, url string, reason string, domain string, out_index bigint, batch bigint"
MARKER_SCHEMA = "next_index bigint, snapshot bigint, batch bigint"
BUCKETS = 64
SNAPSHOT_EVERY = 8
BUCKET = "file_bucket"
_ENTRY = [c.split()[0] for c in STATE_SCHEMA.split(", ") if not c.startswith("batch")]


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or no rows if nothing has been written there yet; other errors are raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def file_bucket(file: Column) -> Column:
    return F.pmod(F.xxhash64(file), F.lit(BUCKETS)).cast("int")


def buckets_of(files: DataFrame) -> list[int]:
    """The buckets of these files: at most BUCKETS numbers."""
    return [r["b"] for r in files.select(file_bucket(F.col("file")).alias("b")).distinct().collect()]


def in_buckets(rows: DataFrame, buckets: list[int] | None) -> DataFrame:
    """Rows of a table in folders of BUCKET; only the folders of these buckets are read."""
    return rows if buckets is None else rows.where(F.col(BUCKET).isin(buckets))


def write_bucketed(rows: DataFrame, path: str) -> None:
    """Rows (file, ...) in folders of BUCKET, dealt evenly, sorted by file."""
    placed = rows.withColumn(BUCKET, file_bucket(F.col("file"))).repartitionByRange(BUCKET, "file")
    placed.sortWithinPartitions(BUCKET, "file").write.mode("overwrite").partitionBy(BUCKET).parquet(path, compression="zstd")


def last_marker(spark: SparkSession, path: str, before: int | None = None) -> Row | None:
    """The marker of the last batch before this one."""
    path = f"{path.rstrip('/')}-marker"
    if before is not None:
        found = read_if_there(spark, f"{path}/batch={before - 1}", MARKER_SCHEMA.rsplit(",", 1)[0]).first()
        if found is not None:
            return Row(*found.__fields__, "batch")(*found, before - 1)
    rows = read_if_there(spark, path, MARKER_SCHEMA)
    return (rows if before is None else rows.where(F.col("batch") < before)).orderBy(F.desc("batch")).first()


def _deltas(spark: SparkSession, path: str, after: int, before: int | None) -> DataFrame:
    rows = read_if_there(spark, path, STATE_SCHEMA).where(F.col("batch") > after)
    return rows if before is None else rows.where(F.col("batch") < before)


def load_state(
    spark: SparkSession, path: str, before: int | None = None, buckets: list[int] | None = None
) -> DataFrame:
    """(file, status, url, reason, domain, out_index): the latest entry of every file, or of those in some buckets."""
    return _latest(spark, path, last_marker(spark, path, before), before, buckets).select(_ENTRY)


def _latest(
    spark: SparkSession, path: str, marker: Row | None, before: int | None, buckets: list[int] | None = None
) -> DataFrame:
    upto = -1 if marker is None else marker["snapshot"]
    rows = _deltas(spark, path, upto, before)
    if buckets is not None:
        rows = rows.where(file_bucket(F.col("file")).isin(buckets))
    if upto >= 0:
        snapshot = read_if_there(spark, f"{path.rstrip('/')}-snapshot/upto={upto}", f"{STATE_SCHEMA}, {BUCKET} int")
        rows = rows.unionByName(in_buckets(snapshot, buckets).drop(BUCKET))
    entry = F.struct(*[c for c in _ENTRY if c != "file"], "batch")
    return rows.groupBy("file").agg(F.max_by(entry, "batch").alias("s")).select("file", "s.*")


def next_index(spark: SparkSession, path: str, before: int | None = None) -> int:
    marker = last_marker(spark, path, before)
    known, at = (0, -1) if marker is None else (marker["next_index"], marker["batch"])
    top = _deltas(spark, path, at, before).agg(F.max("out_index")).first()[0]
    return known if top is None else max(known, top + 1)


def browser_domains(
    spark: SparkSession, path: str, before: int | None = None, initial: tuple[str, ...] = BROWSER_DOMAINS
) -> DataFrame:
    """(domain): the initial ones and every domain whose body came back blank."""
    start = spark.createDataFrame([(d,) for d in initial], "domain string")
    return start.unionByName(_blank_domains(spark, path, last_marker(spark, path, before), before)).distinct()


def _blank_domains(spark: SparkSession, path: str, marker: Row | None, before: int | None) -> DataFrame:
    upto = -1 if marker is None else marker["snapshot"]
    blank = (F.col("reason") == EMPTY_BODY) & F.col("domain").isNotNull()
    rows = _deltas(spark, path, upto, before).where(blank).select("domain")
    if upto >= 0:
        rows = rows.unionByName(read_if_there(spark, f"{path.rstrip('/')}-domains/upto={upto}", "domain string"))
    return rows


def append_state(entries: DataFrame, path: str, batch: int) -> None:
    """Write a batch's entries; writing the same batch again replaces it."""
    entries.select(_ENTRY).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def close_batch(spark: SparkSession, path: str, batch: int, next_index: int) -> None:
    """Note that a batch's entries are written; merge them into a snapshot if it is time to."""
    path, marker = path.rstrip("/"), last_marker(spark, path, batch)
    snapshot = -1 if marker is None else marker["snapshot"]
    if batch - snapshot >= SNAPSHOT_EVERY:
        write_bucketed(_latest(spark, path, marker, batch + 1), f"{path}-snapshot/upto={batch}")
        domains = _blank_domains(spark, path, marker, batch + 1).distinct()
        domains.write.mode("overwrite").parquet(f"{path}-domains/upto={batch}")
        snapshot = batch
    row = spark.createDataFrame([(next_index, snapshot)], "next_index bigint, snapshot bigint")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}-marker/batch={batch}")
