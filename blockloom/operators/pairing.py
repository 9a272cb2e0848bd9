"""Joining candidate labels with pages, and labelling blocks from their label record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.similarity import any_above, within_length_bound
from blockloom.functions.text import is_digits, normalise


#: Labels in order of priority, the column of their candidates, and whether the block's text is compared as
#: the first sequence (with items) or as the second (with the title).
LABELS = (
    ("ingredient", "ing_candidates", True),
    ("direction", "dir_candidates", True),
    ("title", "title_candidate", False),
)


def pair(labels: DataFrame, pages: DataFrame, key: str = "file") -> DataFrame:
    """Labels with their page; a label without a page yields nothing."""
    return labels.join(pages, key, "inner")


def pair_left(labels: DataFrame, pages: DataFrame, key: str = "file") -> DataFrame:
    """Labels with their page, or with null page columns."""
    return labels.join(pages, key, "left")


def pending(
    candidates: DataFrame, state: DataFrame, key: str = "file", retry_failed: bool = False
) -> DataFrame:
    """Candidates not dealt with yet. state holds the latest status per key; pending ones stay open."""
    closed = ["processed"] if retry_failed else ["processed", "failed"]
    known = state.where(F.col("status").isin(closed))
    return candidates.join(known.select(key), key, "left_anti")


def _sized(items: Column) -> Column:
    return F.transform(
        F.coalesce(items, F.array().cast("array<string>")),
        lambda i: F.struct(F.lower(i).alias("s"), F.char_length(F.lower(i)).alias("n")),
    )


def fuzzy_candidates(
    blocks: DataFrame, labels: DataFrame, key: str = "file", threshold: float = 0.8
) -> DataFrame:
    """Blocks of labelled pages with the items whose length allows a match.

    One row per block, not per pair: the label record rides along and is
    narrowed in place, so nothing is exploded, and no second shuffle gathers a
    block's pairs. Adds t (the normalised text), ing_candidates, dir_candidates
    and title_candidate (null if ruled out).
    """
    records = labels.select(
        key,
        _sized(F.col("ingredients")).alias("__ing"),
        _sized(F.col("directions")).alias("__dir"),
        normalise(F.coalesce("title", F.lit(""))).alias("__title"),
    ).withColumn("__title_n", F.char_length("__title"))
    texts = blocks.withColumn("t", normalise(F.col("text"))).withColumn(
        "__n", F.when(~is_digits(F.col("t")), F.char_length("t")).otherwise(0)
    )
    joined = texts.join(records, key)
    n = F.col("__n")

    def near(items: str) -> Column:
        kept = F.filter(items, lambda i: within_length_bound(n, i["n"], threshold))
        return F.transform(kept, lambda i: i["s"])

    return joined.select(
        *blocks.columns,
        "t",
        near("__ing").alias("ing_candidates"),
        near("__dir").alias("dir_candidates"),
        F.when(within_length_bound(n, F.col("__title_n"), threshold), F.col("__title")).alias(
            "title_candidate"
        ),
    )


def fuzzy_label(
    blocks: DataFrame,
    labels: DataFrame,
    key: str = "file",
    threshold: float = 0.8,
    autojunk: bool = True,
) -> DataFrame:
    """Add label: the first of LABELS that has a candidate similar to the block, or 'none'.

    A block without candidates of a kind goes to Python as a null and is not compared.
    """
    rows = fuzzy_candidates(blocks, labels, key, threshold)
    similar = any_above(threshold, autojunk)
    label, text = F, F.array("t")
    for kind, candidates, text_is_first in LABELS:
        there = F.col(candidates)
        has = F.size(there) > 0 if text_is_first else there.isNotNull()
        there = there if text_is_first else F.array(there)
        own, others = F.when(has, text), F.when(has, there)
        flag = similar(own, others) if text_is_first else similar(others, own)
        label = label.when(flag, F.lit(kind))
    return rows.select(*blocks.columns, label.otherwise(F.lit("none")).alias("label"))
