"""Small helpers of the operators: words and lines as columns, keys of rows, blocks of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ASCII blanks, which end a word everywhere in this package.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, split at ASCII blanks; an empty array for a null or blank text."""
    plain = F.translate(F.coalesce(text, F.lit("")), BLANKS[1:], " " * (len(BLANKS) - 1))
    return F.array_remove(F.split(plain, " "), "")


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def content_key(text: Column, name: str = "__content") -> Column:
    """128 bits that stand for a text, as hexadecimal digits."""
    return F.md5(F.coalesce(text, F.lit(""))).alias(name)


def rows_of(batches: Iterator, columns: list[str], chars: int, size_of: str) -> Iterator[tuple[list, ...]]:
    """Lists of the columns' values, some `chars` characters of `size_of` at a time.

    A batch of Arrow rows may hold tens of megabytes of text; what is derived from
    it in Python is many times larger, so it is worked off in portions.
    """
    for batch in batches:
        data = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
        measure = data[columns.index(size_of)]
        start, total = 0, 0
        for i, value in enumerate(measure):
            total += len(value) if value else 0
            if total >= chars:
                yield tuple(d[start : i + 1] for d in data)
                start, total = i + 1, 0
        if start < len(measure):
            yield tuple(d[start:] for d in data)
