"""Per-page context of blocks: section carry-forward and relative position.

html_blocks(rules=...) finds both while it walks the page. These functions are
for tables that already hold blocks. A page is cut into buckets of its block
index, so a page that makes up much of the table is spread over many tasks; the
carry between buckets is worked out on one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.operators.flatten import SectionRules

_BUCKET = 4096
# A heading's code is added to four times its index, so that the largest number
# so far tells what the latest heading opened. An unknown heading counts, too.
_NONE, _INGREDIENT, _DIRECTION = 0, 1, 2


def section_marker(rules: SectionRules) -> Column:
    """4 * idx + code for headings, null for other blocks."""
    opens = rules.of(F.col("text"))
    code = F.when(opens == "ingredient", _INGREDIENT).when(opens == "direction", _DIRECTION).otherwise(_NONE)
    return F.when(F.lower("tag").isin(*rules.headings), F.col("idx").cast("bigint") * 4 + code)


def block_context(
    blocks: DataFrame, key: str = "page_id", rules: SectionRules = SectionRules(), bucket: int = _BUCKET
) -> DataFrame:
    """Add n_blocks (blocks of the page) and section (null where none is open).

    blocks is read twice; pass a stored table, not a plan that flattens pages.
    """
    marked = blocks.withColumn("__marker", section_marker(rules)).withColumn(
        "__bucket", F.shiftright(F.col("idx"), bucket.bit_length() - 1)
    )
    summary = marked.groupBy(key, "__bucket").agg(
        F.count("*").alias("__n"), F.max("__marker").alias("__last")
    )
    page = Window.partitionBy(key)
    earlier = page.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(
        F.col(key).alias("__key"),
        F.col("__bucket").alias("__b"),
        F.sum("__n").over(page).cast("int").alias("n_blocks"),
        F.max("__last").over(earlier).alias("__carried"),
    )
    joined = marked.join(
        summary, (F.col(key) == F.col("__key")) & (F.col("__bucket") == F.col("__b"))
    )
    so_far = Window.partitionBy(key, "__bucket").orderBy("idx").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    latest = F.coalesce(F.max("__marker").over(so_far), F.col("__carried")) % 4
    section = F.when(latest == _INGREDIENT, "ingredient").when(latest == _DIRECTION, "direction")
    return joined.withColumn("section", section).drop(
        "__marker", "__bucket", "__key", "__b", "__carried"
    )


def section_context(blocks: DataFrame, key: str = "page_id", rules: SectionRules = SectionRules()) -> DataFrame:
    """Add section: the section opened by the latest heading, 'ingredient', 'direction' or null."""
    return block_context(blocks, key, rules).drop("n_blocks")


def position_ratio(idx: Column | str = "idx", n_blocks: Column | str = "n_blocks") -> Column:
    """Index scaled to 0..1 within the page."""
    idx = F.col(idx) if isinstance(idx, str) else idx
    n = F.col(n_blocks) if isinstance(n_blocks, str) else n_blocks
    return idx / F.greatest(F.lit(1), n - 1)
