"""Line-first cleaning: rules judge every line, failed lines go, and documents that lose too much go.

All of a document is judged inside its row with SQL functions: nothing is shuffled, no key can be hot.

A line fails if it is
* navigation: so many separators that it is a menu or a table row,
* boilerplate: a licence, copyright, cookie or sign-in phrase,
* badly punctuated: many symbols or exclamation marks for its words, or long without any end of a sentence.
Blank lines never fail. A document is rejected if it fails the base rules (few words, many repeated
ones) or if failed lines hold more than `lost_share` of its words.

Null and empty texts have no words and fail the base rules. Equal rows are judged alike; a null
doc_id is kept as it is; other columns pass through. No rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import BLANKS, lines, table, words

# What the rules look for.
SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = r"[|»›•→]"
SENTENCE_END = r"[.!?…。！？][\"'”’»)\]]*(\s|$)"
BOILERPLATE = (
    r"(?i)\b(all rights reserved|licensed under|released under the|general public license|terms of (use|service)"
    r"|privacy policy|cookie policy|use of cookies|accept cookies|enable javascript|sign in|log in to|subscribe to"
    r"|share this|skip to content|read more)\b|©"
)


@dataclass(frozen=True)
class Rules:
    separators: int = 3  # in a line of navigation
    symbol_share: float = 0.1  # symbols by words of a line
    shout_share: float = 0.3  # "!!" by words of a line
    long_line: int = 20  # words of a line that needs the end of a sentence
    boilerplate_words: int = 25  # longer lines are text, even with such a phrase
    lost_share: float = 0.5
    least_words: int = 50
    repeat_percent: int = 50


def line_fails(line: Column, rules: Rules = Rules()) -> Column:
    n = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    navigation = F.regexp_count(line, F.lit(SEPARATORS)) >= rules.separators
    boilerplate = (n <= rules.boilerplate_words) & line.rlike(BOILERPLATE)
    symbols = F.regexp_count(line, F.lit(SYMBOLS)) > rules.symbol_share * n
    shouting = F.regexp_count(line, F.lit("!!")) > rules.shout_share * n
    unclosed = (n >= rules.long_line) & ~line.rlike(SENTENCE_END)
    return ~blank(line) & (navigation | boilerplate | symbols | shouting | unclosed)


def blank(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(BLANKS))) == 0


def judged(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs with __doc: the counts, base_failed, kept, and the text without failed lines."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*own, words(F.col("text")).alias("__w"), lines(F.col("text")).alias("__l"))
    n = F.size("__w")
    three = F.arrays_zip("__w", F.slice("__w", F.lit(2), n).alias("b"), F.slice("__w", F.lit(3), n).alias("c"))
    rows = rows.withColumn(
        "__h",  # the windows of three words; 64 bits tell them apart within one text
        F.transform(
            F.slice(three, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda z: F.xxhash64(z["__w"], z["b"], z["c"])
        ),
    )
    at = F.arrays_zip(F.col("__h").alias("h"), F.sequence(F.lit(0), F.size("__h") - 1).alias("at"))
    none = F.array().cast("array<struct<h:bigint,at:int>>")
    rows = rows.withColumn(
        "__s",  # windows in order of content, where any is found twice
        F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(at)).otherwise(none),
    )
    size = F.size("__s")
    beside = F.arrays_zip(
        F.col("__s").alias("own"),
        F.slice("__s", F.lit(2), size).alias("next"),
        F.concat(F.array(F.lit(None).cast("struct<h:bigint,at:int>")), F.slice("__s", F.lit(1), size - 1)).alias(
            "before"
        ),
    )
    twice = F.filter(
        F.when(size > 0, beside),
        lambda z: F.coalesce(z["own"]["h"] == z["next"]["h"], F.lit(False))
        | F.coalesce(z["own"]["h"] == z["before"]["h"], F.lit(False)),
    )
    rows = rows.withColumn("__p", F.sort_array(F.transform(twice, lambda z: z["own"]["at"])))
    steps = F.arrays_zip(F.col("__p").alias("at"), F.slice("__p", F.lit(2), F.size("__p")).alias("next"))
    repeated = F.when(
        F.size("__p") > 0,
        F.aggregate(
            steps, F.lit(0).cast("bigint"), lambda a, z: a + F.coalesce(F.least(z["next"] - z["at"], F.lit(3)), F.lit(3))
        ),
    ).otherwise(F.lit(0).cast("bigint"))
    filled = F.filter("__l", lambda x: ~blank(x))
    passed = F.filter("__l", lambda x: ~line_fails(x, rules))
    rows = rows.select(
        *own,
        "__w",
        filled.alias("__filled"),
        F.when(F.col("text").isNotNull(), F.array_join(passed, "\n")).alias("__clean"),
        repeated.alias("__repeated"),
    )
    n_words, clean_words = F.size("__w").cast("bigint"), F.size(words(F.col("__clean")))
    failed = (n_words < rules.least_words) | (100 * F.col("__repeated") > rules.repeat_percent * n_words)
    lost = (n_words - clean_words) > rules.lost_share * n_words
    verdict = F.struct(
        n_words.alias("n_words"),
        F.length(F.array_join("__w", "")).cast("bigint").alias("word_chars"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("__filled") - F.size(F.array_distinct("__filled"))).cast("bigint").alias("n_dup_lines"),
        F.col("__repeated").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & ~lost).alias("kept"),
        F.col("__clean").alias("text"),
    )
    return rows.select(*own, verdict.alias("__doc"))


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that are kept, without their failed lines; same columns."""
    # A filter on the verdict would be moved below the rules, which would then be worked out again and
    # again inside it; rows that a generator gives none for go without that.
    own = [f"`{c}`" for c in docs.columns if c != "text"]
    text = F.explode(F.when(F.col("__doc.kept"), F.array("__doc.text"))).alias("text")
    return judged(docs, rules).select(*own, text).select(*[f"`{c}`" for c in docs.columns])


def op7_line_first_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select("doc_id", "__doc.*").drop("text")
