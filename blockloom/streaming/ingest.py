"""Incremental validation: new label files against fetched bodies, with durable state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from blockloom.operators.crawl import assign_ids
from blockloom.plans.curation import validate
from blockloom.session import stored
from blockloom.sources.bodies import bodies_of
from blockloom.sources.state import (
    append_state, browser_domains, buckets_of, close_batch, last_marker, load_state, next_index, read_if_there,
)

OPEN = ("pending", "needs_browser")
NARROW = ("file", "status", "url", "reason", "domain")
BROADCAST_FILES = 100_000  # names that go to all tasks
TEXTS = "zstd"  # tables with texts are written small, as every batch writes its own


def _one_per_file(labels: DataFrame) -> DataFrame:
    """The greatest record of every file, in the order of its JSON text: the same one in every run. A stored table.

    Files with several records are found by name first: only their records are grouped.
    """
    rows = stored(labels, TEXTS)
    several = stored(rows.groupBy("file").agg(F.count("*").alias("__n")).where("__n > 1").select(F.col("file").alias("__file")))
    files = several.count()
    if not files:
        return rows
    if files <= BROADCAST_FILES:
        several = F.broadcast(several)
    same = F.col("file").eqNullSafe(F.col("__file"))
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in labels.columns]))
    record = F.struct(*[F.col(f"`{c}`") for c in labels.columns])
    best = rows.join(several, same, "left_semi").groupBy("file").agg(F.max_by(record, text).alias("m")).select("m.*")
    return stored(rows.join(several, same, "left_anti").unionByName(best), TEXTS)


def ingest_batch(
    labels: DataFrame,
    batch: int,
    fetched: DataFrame,
    suffixes: DataFrame,
    state_path: str,
    corpus_path: str,
    retry_failed: bool = False,
) -> None:
    """Validate one batch of labels, add the valid pairs to the corpus and note every outcome.

    fetched: the bodies, best as the table of sources.bodies, of which only the batch's buckets are read.
    Label records whose body is not there yet, or has to come by browser, are kept beside the state and
    tried again with every batch. Running a batch again writes the same folders with the same ids.
    """
    spark = labels.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in labels.schema)
    marker = last_marker(spark, state_path, batch)
    kept = read_if_there(spark, f"{state_path.rstrip('/')}-open", f"{schema}, batch bigint")
    waiting = kept.where(F.col("batch") == (-1 if marker is None else marker["batch"])).drop("batch")
    todo = _one_per_file(labels.unionByName(waiting))
    buckets = buckets_of(todo)
    files = todo.select("file")
    state = stored(load_state(spark, state_path, batch, buckets).join(files, "file", "left_semi"))
    domains = browser_domains(spark, state_path, before=batch)
    found = validate(todo, bodies_of(fetched, files, buckets), suffixes, state, retry_failed, domains)
    # Of what is not valid, nobody reads texts and bodies.
    valid = F.col("status") == "valid"
    outcome = stored(found.select(*[c if c in NARROW else F.when(valid, F.col(f"`{c}`")).alias(c) for c in found.columns]), TEXTS)
    still_open = todo.join(outcome.where(F.col("status").isin(*OPEN)).select("file"), "file", "left_semi")
    still_open.write.mode("overwrite").parquet(f"{state_path.rstrip('/')}-open/batch={batch}")

    valid = outcome.where("status = 'valid'")
    start = next_index(spark, state_path, before=batch)
    ids = stored(assign_ids(valid.select("file"), start))
    valid.drop("status", "reason").join(ids, "file").write.mode("overwrite").parquet(
        f"{corpus_path.rstrip('/')}/batch={batch}", compression=TEXTS
    )
    processed = valid.select(*NARROW).join(ids, "file").withColumn("status", F.lit("processed")).withColumn(
        "reason", F.lit(None).cast("string")
    )
    others = outcome.where("status <> 'valid'").withColumn("out_index", F.lit(None).cast("bigint"))
    columns = ["file", "status", "url", "reason", "domain", "out_index"]
    entries = processed.select(*columns).unionByName(others.select(*columns))
    # An open file gets an entry when its status changes, not with every batch.
    before = state.select(*[F.col(c).alias(f"__{c}") for c in columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns])
    append_state(entries.join(before, same, "left_anti"), state_path, batch)
    top = ids.agg(F.max("out_index")).first()[0]
    close_batch(spark, state_path, batch, start if top is None else top + 1)


def ingest_stream(
    labels: DataFrame,
    fetched: DataFrame,
    suffixes: DataFrame,
    state_path: str,
    corpus_path: str,
    checkpoint: str,
    retry_failed: bool = False,
) -> StreamingQuery:
    """Run ingest_batch on everything a stream of label records has new, then stop."""

    def each(rows: DataFrame, batch: int) -> None:
        ingest_batch(rows, batch, fetched, suffixes, state_path, corpus_path, retry_failed)

    return (
        labels.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
