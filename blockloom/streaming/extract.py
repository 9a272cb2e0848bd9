"""Extraction of arriving pages."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from blockloom.plans.extraction import extract
from blockloom.session import spread


def extract_stream(
    pages: DataFrame, model: PipelineModel, path: str, checkpoint: str, key: str = "page_id"
) -> StreamingQuery:
    """Write one record per arriving page below path, then stop when nothing is left.

    A page is whole within its micro-batch, so each batch is the batch job. A
    batch that is run again replaces its own folder.
    """

    def each(rows: DataFrame, batch: int) -> None:
        extract(spread(rows), model, key).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    return (
        pages.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
