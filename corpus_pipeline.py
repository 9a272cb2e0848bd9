"""A corpus in stages, each over all that its predecessor kept: from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes it as Parquet in the shared
folder and reads it again for the next one, so a lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from blockloom.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules, tokens
from blockloom.llm.common import BLANKS, table
from blockloom.session import scratch_path


def _lengths(docs):
    """n_chars after the text has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def clean_lines(spark, docs, sf_dir):
    """Documents without failed lines; rejected ones go."""
    return _lengths(quality_rules.clean(docs))


def drop_repeated_lines(spark, docs, sf_dir):
    """Documents without windows of lines that came before, in them or elsewhere; one that has no text left goes."""
    found = line_dedup.dedup_lines(docs, report=True)
    emptied = (F.col("n_removed") > 0) & (F.btrim("text", F.lit(BLANKS)) == "")
    return _lengths(found.where(~F.coalesce(emptied, F.lit(False))).select(*[f"`{c}`" for c in docs.columns]))


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of similar ones: five words, 0.8."""
    return ngram_join.keep_one(docs, ngram_join.Similar(words=5, percent=80))


def drop_contaminated(spark, docs, sf_dir):
    """Documents without passages of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark, docs, sf_dir):
    """Pieces of all documents in sequences of at most 1024 ids."""
    return packing.pieces(packing.pack(docs, tokens.default_path()))


STAGES = [
    ("quality rules", clean_lines),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # tokenizing and packing have no SQL form


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
