"""Line deduplication by overlapping windows of three lines.

Three consecutive lines, without blanks at their ends, are hashed to 128 bits. A window found more
than once anywhere is kept where it comes first (by doc_id, then text, then place) and its other
occurrences are covered; covered windows of a document are merged and their lines removed. Windows
of blank lines do not count.

Windows are counted with partial sums before the shuffle, and only those found twice come into the
join, whose sides Spark may split where one window is very frequent. Only hashes and places are
shuffled until the runs of lines to keep, a few numbers per changed document, go back to the texts.

Texts that are null, or of fewer than three lines, stay as they are. Rows with equal doc_id and text
are one document here: they are changed alike. A null doc_id comes first in the order. Other columns
pass through. No rows give no rows. A text all of whose lines go becomes empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import BLANKS, content_key, lines, table

SPAN = 3


def windows(docs: DataFrame) -> DataFrame:
    """(id, key, at, a, b): every window with the two halves of its hash."""
    trimmed = F.transform(lines(F.col("text")), lambda x: F.btrim(x, F.lit(BLANKS)))
    rows = docs.select(F.col("doc_id").alias("id"), content_key(F.col("text"), "key"), trimmed.alias("l"))
    last = F.size("l") - SPAN
    rows = rows.select("id", "key", "l", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("at"))
    three = [F.get("l", F.col("at") + i) for i in range(SPAN)]
    filled = F.length(F.concat(*three)) > 0
    return rows.where(filled).select(
        "id", "key", "at", F.xxhash64(*three).alias("a"), F.xxhash64(F.lit(1), *reversed(three)).alias("b")
    )


def covered(docs: DataFrame) -> DataFrame:
    """(id, key, at): places, in order, of the windows of a document that repeat an earlier one."""
    every = windows(docs)
    place = F.struct("id", "key", "at")
    repeated = (
        every.groupBy("a", "b")
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("a").alias("ra"), F.col("b").alias("rb"), "first")
    )
    later = every.join(repeated, (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb"))).where(
        ~place.eqNullSafe(F.col("first"))
    )
    return later.groupBy("id", "key").agg(F.sort_array(F.collect_set("at")).alias("at"))


def _kept_lines(all_lines: Column, at: Column) -> Column:
    """The lines that no window at these places covers: the runs between merged windows."""
    n = F.size(at)
    ends = F.transform(at, lambda p: p + SPAN)
    runs = F.arrays_zip(
        F.concat(F.array(F.lit(0)), ends).alias("from"), F.concat(at, F.array(F.size(all_lines))).alias("to")
    )
    open_ = F.filter(runs, lambda r: r["to"] > r["from"])
    return F.when(n > 0, F.flatten(F.transform(open_, lambda r: F.slice(all_lines, r["from"] + 1, r["to"] - r["from"]))))


def dedup_lines(docs: DataFrame, report: bool = False) -> DataFrame:
    """docs with repeated windows of lines removed; with report, also n_removed."""
    gone = covered(docs).select(F.col("id").alias("__id"), F.col("key").alias("__same"), F.col("at").alias("__at"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    left = docs.select(*own, content_key(F.col("text"), "__key"))
    same = F.col("__key").eqNullSafe(F.col("__same")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    both = left.join(gone, same, "left")
    both = both.select(*own, "__at", lines(F.col("text")).alias("__l"))
    both = both.select(*own, "__at", "__l", _kept_lines(F.col("__l"), F.col("__at")).alias("__kept"))
    text = F.when(F.col("__kept").isNotNull(), F.array_join("__kept", "\n")).otherwise(F.col("text"))
    removed = F.coalesce(F.size("__l") - F.size("__kept"), F.lit(0)).cast("bigint")
    out = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return both.select(*out, *([removed.alias("n_removed")] if report else []))


def op5_window_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_removed) of all documents."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
