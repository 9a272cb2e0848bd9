"""Predicted blocks to one record per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.text import is_boilerplate_item


def _in_order(condition: Column) -> Column:
    """Texts that meet the condition, in block order."""
    picked = F.collect_list(F.when(condition, F.struct("idx", "text")))
    return F.transform(F.array_sort(picked), lambda r: r["text"])


def extract_records(
    predictions: DataFrame, key: str = "page_id", label: str = "prediction"
) -> DataFrame:
    """(key, title, ingredients, directions) from (key, idx, text, label).

    The first title in document order counts; ingredients that are sub-headings
    or nutrition lines are dropped. A page given by a single row with a null idx
    gets an empty record. One aggregation; texts of other labels are blanked
    before it, so they are not shuffled.
    """
    kind = F.col(label)
    used = kind.isin("title", "ingredient", "direction")
    narrow = predictions.select(
        key, "idx", F.when(used, F.col("text")).alias("text"), F.when(used, kind).alias("__kind")
    )
    k = F.col("__kind")
    return narrow.groupBy(key).agg(
        F.min_by("text", F.when(k == "title", F.col("idx"))).alias("title"),
        _in_order((k == "ingredient") & ~is_boilerplate_item(F.col("text"))).alias("ingredients"),
        _in_order(k == "direction").alias("directions"),
    )
