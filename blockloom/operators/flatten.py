"""Pages to text blocks: one row per text node, in document order.

Flattening is page-local: no shuffle. Pages stream through mapInArrow, which
gives out blocks in bounded batches, so neither a large page nor a long
partition has to sit in memory as a whole array of rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockloom.functions.dom import PageWalker
from blockloom.functions.text import any_of

# Elements removed with all their content.
EXCLUDED_TAGS = ("script", "style", "noscript", "footer", "nav", "link", "meta", "button")
# Elements whose whole text makes one block.
MERGED_TAGS = ("li",)
# Default keywords of sections and of class and id attributes.
INGREDIENT_KEYWORDS = ("ingredient", "component", "element", "material")
DIRECTION_KEYWORDS = ("instruct", "direction", "step", "method", "preparation", "procedure", "technique")
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")

_BLOCK_FIELDS = [
    T.StructField("idx", T.IntegerType()),
    T.StructField("text", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("itemprop", T.StringType()),
    T.StructField("class", T.ArrayType(T.StringType())),
    T.StructField("id", T.StringType()),
]
_CONTEXT_FIELDS = [
    T.StructField("n_blocks", T.IntegerType()),
    T.StructField("section", T.StringType()),
]
_REPORT_FIELDS = [T.StructField("reason", T.StringType())]
# Fixed value: reason of a page that is skipped.
UNREADABLE = "Unreadable HTML"
_ROWS_PER_BATCH = 4096


@dataclass(frozen=True)
class SectionRules:
    """Which headings open an ingredient or a direction section (first match wins)."""

    ingredient: tuple[str, ...] = INGREDIENT_KEYWORDS
    direction: tuple[str, ...] = DIRECTION_KEYWORDS
    headings: tuple[str, ...] = HEADING_TAGS

    @cached_property
    def sections(self) -> list[tuple[str, str]]:
        """(section, pattern of its keywords), the first match first; both forms below read this."""
        return [(name, any_of(getattr(self, name))) for name in ("ingredient", "direction")]

    def of(self, text: Column) -> Column:
        """Section a heading with this text opens; null for an unknown heading."""
        found = [F.when(F.lower(text).rlike(pattern), F.lit(name)) for name, pattern in self.sections]
        return F.coalesce(*found)

    def of_string(self, text: str) -> str | None:
        low = text.lower()
        return next((name for name, pattern in self.sections if re.search(pattern, low)), None)


def html_blocks(
    pages: DataFrame,
    key: str = "page_id",
    html: str = "html",
    exclude: Sequence[str] = EXCLUDED_TAGS,
    collapse: Sequence[str] = MERGED_TAGS,
    rules: SectionRules | None = None,
    keep_empty_pages: bool = False,
    report: bool = False,
) -> DataFrame:
    """Blocks of every page: (key, idx, text, tag, depth, itemprop, class, id).

    With rules, also n_blocks and section, found in the same pass over the page
    and so without a window. With keep_empty_pages, a page without blocks keeps
    one row whose other columns are null. With report, also reason, null for
    blocks; a page whose markup can not be parsed, which has no blocks, gives one
    row with a reason and nulls (see split_unreadable).
    """
    source = pages.select(key, F.col(html).alias("__html"))
    fields = [source.schema[key], *_BLOCK_FIELDS, *(_CONTEXT_FIELDS if rules else []), *(_REPORT_FIELDS if report else [])]
    schema = T.StructType(fields)
    names = [f.name for f in fields[1:]]
    exclude, collapse = tuple(exclude), tuple(collapse)

    def flatten(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def batch(keys: pa.Array, pick: list[int], columns: list[list]) -> pa.RecordBatch:
            arrays = [keys.take(pa.array(pick, pa.int64())).cast(arrow.field(0).type)]
            arrays += [pa.array(c, arrow.field(n).type) for n, c in zip(names, columns)]
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for records in batches:
            keys = records.column(0)
            pick: list[int] = []
            columns: list[list] = [[] for _ in names]
            for row, page in enumerate(records.column(1)):
                walker = PageWalker(exclude, collapse)
                nodes = walker.walk(page.as_py())
                section = None
                for idx, node in enumerate(nodes):
                    a = node.attrs
                    values = [
                        idx, node.text, node.tag, node.depth,
                        a.get("itemprop", ""), a.get("class", "").split(), a.get("id", ""),
                    ]
                    if rules:
                        if node.tag in rules.headings:
                            section = rules.of_string(node.text)
                        values += [len(nodes), section]
                    if report:
                        values.append(None)
                    pick.append(row)
                    for column, value in zip(columns, values):
                        column.append(value)
                    if len(pick) >= _ROWS_PER_BATCH:
                        yield batch(keys, pick, columns)
                        pick, columns = [], [[] for _ in names]
                if (keep_empty_pages and not nodes) or (report and walker.failed):
                    pick.append(row)
                    for column in columns:
                        column.append(None)
                    if report and walker.failed:
                        columns[-1][-1] = UNREADABLE
            if pick:
                yield batch(keys, pick, columns)

    return source.mapInArrow(flatten, schema)


def split_unreadable(rows: DataFrame, key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """Rows of html_blocks(report=True) as blocks without reason, and (key, reason) of the pages skipped.

    Both read rows: store them first, and one walk over the pages serves both.
    """
    skipped = F.col("reason").isNotNull()
    return rows.where(~skipped).drop("reason"), rows.where(skipped).select(key, "reason")


def unreadable_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, reason) of the pages whose markup can not be parsed; they have no blocks and no text."""
    return split_unreadable(html_blocks(pages, key, html, report=True), key)[1]


def page_text_column(html: Column, scope: str = "body", stripped: bool = True) -> Column:
    """Lowercased text of a page as a Column; see page_text."""
    if scope not in ("body", "document"):
        raise ValueError(f"unknown scope: {scope}")

    def texts(pages: pd.Series) -> pd.Series:
        def one(page: str | None) -> str:
            nodes = PageWalker(keep_blank=not stripped, cut_to_root=False).walk(page)
            return " ".join(
                n.text for n in nodes if not n.special and (n.rooted or scope == "document")
            ).lower()

        return pages.map(one)

    return F.pandas_udf(texts, "string")(html)


def page_text(
    pages: DataFrame,
    scope: str = "body",
    strip: bool | None = None,
    html: str = "html",
    out: str = "page_text",
) -> DataFrame:
    """Add the page's lowercased text, its pieces joined with one space.

    scope "body": pieces inside body, stripped, blank ones dropped; '' without a
    body. scope "document": every piece of the document, not stripped. Comments,
    doctypes, scripts and styles are left out; no other element is.
    """
    stripped = (scope == "body") if strip is None else strip
    return pages.withColumn(out, page_text_column(F.col(html), scope, stripped))
