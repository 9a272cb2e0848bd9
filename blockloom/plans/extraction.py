"""The extraction job: pages to blocks to features to predictions to records."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators.features import FeatureRules, block_features
from blockloom.operators.flatten import SectionRules, html_blocks
from blockloom.operators.records import extract_records
from blockloom.plans.training import predict


def featurised(
    pages: DataFrame,
    key: str = "page_id",
    html: str = "html",
    sections: SectionRules = SectionRules(),
    features: FeatureRules = FeatureRules(),
    keep_empty_pages: bool = False,
) -> DataFrame:
    """Blocks of pages with all features; page-local, without a shuffle."""
    blocks = html_blocks(pages, key, html, rules=sections, keep_empty_pages=keep_empty_pages)
    return block_features(blocks, features)


def extract(pages: DataFrame, model: PipelineModel, key: str = "page_id", html: str = "html") -> DataFrame:
    """One record per page. The only shuffle gathers a page's predicted texts.

    A page without blocks travels as one row of nulls, which the model scores
    after its nulls are filled in; it cannot become part of a record.
    """
    rows = featurised(pages, key, html, keep_empty_pages=True)
    scored = predict(model, _filled(rows))
    empty = F.col("idx") < 0
    return extract_records(
        scored.select(
            key,
            F.when(~empty, F.col("idx")).alias("idx"),
            "text",
            F.when(~empty, F.col("prediction")).alias("prediction"),
        ),
        key,
    )


def _filled(rows: DataFrame) -> DataFrame:
    """Stand-in values for the rows of pages without blocks, marked by idx -1."""
    kinds = dict(rows.dtypes)
    fill = {"string": F.lit(""), "int": F.lit(0), "double": F.lit(0.0), "boolean": F.lit(False), "bigint": F.lit(0)}
    blank = F.col("idx").isNull()
    return rows.select(
        *[
            F.when(blank, -1).otherwise(F.col("idx")).alias("idx")
            if c == "idx"
            else F.coalesce(c, fill[kinds[c]]).alias(c)
            if kinds[c] in fill and c not in ("section",)
            else F.col(c)
            for c in rows.columns
        ]
    )
