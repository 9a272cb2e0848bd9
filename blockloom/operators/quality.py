"""Content checks on (label, page) pairs and the clean-up of a corpus.

A pair row has the label's title, ingredients, directions and the page's text as
a column, so every check is a higher-order function over one row: no explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.functions.text import clean_items, contains_any, nonblank_items

# Reason texts, in report order.
TITLE_MISSING = "title missing"
NO_INGREDIENTS = "no ingredients matched"
NO_DIRECTIONS = "no directions matched"
DOUBLED = "doubled ingredients"
HTML_MISSING = "html missing recipe"


def has_duplicate_items(items: Column, ignore: tuple[str, ...] = ("", "0")) -> Column:
    """Some item occurs twice, as it stands (case and spaces count); counters do not."""
    kept = F.filter(
        F.coalesce(items, F.array().cast("array<string>")),
        lambda i: i.isNotNull() & ~i.isin(*ignore),
    )
    return F.size(kept) > F.size(F.array_distinct(kept))


def dup_items(labels: DataFrame, key: str = "file", items: str = "ingredients") -> DataFrame:
    """Keys of the labels that list an item twice."""
    return labels.where(has_duplicate_items(F.col(items))).select(key).distinct()


def lacks_content(text: Column, ingredients: Column, directions: Column, title: Column | None = None) -> Column:
    """None of the record's items (nor the title, if given) is in the text."""
    items = F.concat(nonblank_items(ingredients), nonblank_items(directions))
    found = contains_any(text, items)
    if title is not None:
        low = F.lower(F.coalesce(title, F.lit("")))
        found = found | ((low != "") & F.contains(text, low))
    return ~found


def missing_content(
    pairs: DataFrame, key: str = "file", text: str = "page_text", title_col: str | None = None
) -> DataFrame:
    """Keys of the pairs whose page has none of the record's content.

    The title is looked at only if title_col names it.
    """
    title = F.col(title_col) if title_col else None
    lacking = lacks_content(F.col(text), F.col("ingredients"), F.col("directions"), title)
    return pairs.where(lacking).select(key).distinct()


def cleanup_report(
    labels: DataFrame, pages: DataFrame, key: str = "file", page: str = "page_id",
    text: str = "page_text", title_col: str | None = None,
) -> DataFrame:
    """(key, page, reason): labels with doubled items, then pages without content.

    A key reported as doubled is not reported again. A label without a page can
    only be doubled; its page is null. Both tests look at one row, so one left
    join serves them.
    """
    title = F.col(title_col) if title_col else None
    lacking = lacks_content(F.col(text), F.col("ingredients"), F.col("directions"), title)
    reason = F.when(has_duplicate_items(F.col("ingredients")), F.lit(DOUBLED)).when(
        F.col(page).isNotNull() & lacking, F.lit(HTML_MISSING)
    )
    rows = labels.select(key, "ingredients", "directions", *([title_col] if title_col else []))
    return (
        rows.join(pages.select(key, page, text), key, "left")
        .select(key, page, reason.alias("reason"))
        .where(F.col("reason").isNotNull())
    )


def cleanup_counts(report: DataFrame) -> DataFrame:
    """Rows per reason, and in all (reason 'total')."""
    return (
        report.rollup("reason")
        .agg(F.count("*").alias("n"))
        .select(F.coalesce("reason", F.lit("total")).alias("reason"), "n")
    )


def clean_corpus(labels: DataFrame, report: DataFrame, key: str = "file") -> DataFrame:
    """The labels that are not in the report."""
    return labels.join(report.select(key), key, "left_anti")


def validate_pages(pairs: DataFrame, text: str = "page_text") -> DataFrame:
    """Add title_ok, ingredients_ok, directions_ok, valid and reasons.

    One of the three is enough. The reasons are listed for valid pairs, too.
    """
    t = F.col(text)
    title = F.lower(F.coalesce("title", F.lit("")))
    return (
        pairs.withColumn("title_ok", (title != "") & F.contains(t, title))
        .withColumn("ingredients_ok", contains_any(t, clean_items(F.col("ingredients"))))
        .withColumn("directions_ok", contains_any(t, clean_items(F.col("directions"))))
        .withColumn("valid", F.col("title_ok") | F.col("ingredients_ok") | F.col("directions_ok"))
        .withColumn(
            "reasons",
            F.concat_ws(
                ", ",
                F.when(~F.col("title_ok"), TITLE_MISSING),
                F.when(~F.col("ingredients_ok"), NO_INGREDIENTS),
                F.when(~F.col("directions_ok"), NO_DIRECTIONS),
            ),
        )
    )
