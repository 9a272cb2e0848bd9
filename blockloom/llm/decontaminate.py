"""Benchmark decontamination by spaced seeds.

Words are compared without case and marks. A seed is a fixed mask over consecutive words: the words
at its 1s are hashed, those at its 0s are ignored, so a hit survives substitutions there. Every place
of every document is hashed with each mask and joined with the seeds of the test items; around a hit,
the words of document and item are compared one by one along their common diagonal, and a stretch of
up to `stretch` item words of which `share` agree is a contamination.

The test items are the query set. Their seeds and words are broadcast, never more than SEEDS rows
at a time: a larger set of items is worked off in blocks (by hash of the item) that each pass over all
documents. So documents are not shuffled at all; only verified hits are, after partial aggregation.

Items of fewer than `least_words` words have one mask, all their words, and count where every word agrees.
Items without words and null items are left out.
Null and empty documents are never contaminated. Equal rows are judged alike; a null doc_id is kept
as it is. An empty benchmark or no documents give no hits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.common import content_key, table, words
from blockloom.session import stored

# The masks, and marks that do not count.
MASKS = ("11010011011", "1110110101", "1011100111")
MARKS = ".,;:!?\"'()[]«»…"
SEEDS = 500_000


@dataclass(frozen=True)
class Rule:
    least_words: int = 11  # as long as the longest mask
    stretch: int = 20
    share: float = 0.8


def plain_words(text: Column) -> Column:
    return words(F.lower(F.translate(F.coalesce(text, F.lit("")), MARKS, "")))


def _hashes(word_list: str, at: Column, masks: list[str]) -> list[Column]:
    """The seeds that begin at a place, one per mask; null where the text ends before the mask does."""
    found = []
    for mask in masks:
        number = MASKS.index(mask) if mask in MASKS else -len(mask)
        picked = [F.get(word_list, at + i) for i, bit in enumerate(mask) if bit == "1"]
        found.append(F.when(picked[-1].isNotNull(), F.xxhash64(F.lit(number), *picked)))
    return found


def seeds(items: DataFrame, lengths: list[int], rule: Rule = Rule()) -> DataFrame:
    """(seed, item_id, item_at, n) of items (item_id, w, n); lengths: those of the short items."""
    places = items.select("item_id", "w", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("item_at"))
    own = [F.when(F.col("n") >= rule.least_words, x) for x in _hashes("w", F.col("item_at"), list(MASKS))]
    whole = _hashes("w", F.col("item_at"), ["1" * k for k in lengths])
    own += [F.when((F.col("n") == k) & (F.col("item_at") == 0), x) for k, x in zip(lengths, whole)]
    rows = places.select("item_id", "n", "item_at", F.explode(F.array(*own)).alias("seed"))
    return rows.where("seed is not null").select("seed", "item_id", "item_at", "n")


def _near(rule: Rule) -> tuple[Column, Column]:
    """The words of the document that the stretch around a hit may meet, and the place of the first."""
    first = F.greatest(F.lit(0), F.col("at") - rule.stretch)
    return F.slice("w", first + 1, 2 * rule.stretch + len(MASKS[0])), first


def _agreeing(rule: Rule) -> tuple[Column, Column]:
    """Agreeing words in the stretch of the item around a hit, and the words it has."""
    length = F.least(F.col("n"), F.lit(rule.stretch))
    begin = F.greatest(F.lit(0), F.least(F.col("item_at") - (rule.stretch - len(MASKS[0])) // 2, F.col("n") - length))
    there = F.col("at") - F.col("item_at") + begin  # in the document; before its start if negative
    skip = F.greatest(F.lit(0), -there)
    own = F.slice("near", there + skip - F.col("first") + 1, length - skip)
    item = F.slice("item_w", begin + skip + 1, length - skip)
    equal = F.zip_with(own, item, lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0)))
    return F.aggregate(equal, F.lit(0), lambda a, x: a + x), length


def contaminations(docs: DataFrame, items: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, key, item_id, hits, overlap): verified pairs; overlap is the best share of a stretch.

    key stands for the text, so that rows without or with the same doc_id stay apart.
    """
    tests = items.select("item_id", plain_words(F.col("text")).alias("w"))
    tests = tests.withColumn("n", F.size("w")).where("n > 0")
    is_short = F.col("n") < rule.least_words
    total, lengths = tests.agg(F.sum("n"), F.sort_array(F.collect_set(F.when(is_short, F.col("n"))))).first()
    total = total or 0
    masks = [*MASKS, *("1" * k for k in lengths)]
    blocks = -(-total * len(MASKS) * 5 // (4 * SEEDS)) or 1

    rows = docs.select("doc_id", content_key(F.col("text"), "key"), plain_words(F.col("text")).alias("w"))
    last = F.size("w") - min(map(len, masks))
    rows = rows.select("doc_id", "key", "w", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("at"))
    rows = rows.select("doc_id", "key", "w", "at", F.explode(F.array(*_hashes("w", F.col("at"), masks))).alias("seed"))

    near, first = _near(rule)
    found = []
    for block in range(blocks):
        own = tests.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else tests
        hits = rows.join(F.broadcast(seeds(own, lengths, rule)), "seed")
        # A document's hits are in memory together, so they leave its text and most of its words behind.
        hits = hits.select("doc_id", "key", "at", "item_id", "item_at", "n", near.alias("near"), first.alias("first"))
        hits = hits.join(F.broadcast(own.select("item_id", F.col("w").alias("item_w"))), "item_id")
        agree, length = _agreeing(rule)
        hits = hits.select("doc_id", "key", "item_id", agree.alias("agree"), length.alias("length"), is_short.alias("short"))
        hits = hits.where(F.col("agree") >= F.when(F.col("short"), F.col("length")).otherwise(F.ceil(rule.share * F.col("length"))))
        hits = hits.select("doc_id", "key", "item_id", (F.col("agree") / F.col("length")).alias("share"))
        counted = hits.groupBy("doc_id", "key", "item_id").agg(F.count("*").alias("hits"), F.max("share").alias("overlap"))
        found.append(stored(counted) if blocks > 1 else counted)  # a block after the other, so that one is held at a time
    return reduce(DataFrame.unionAll, found)


def decontaminate(docs: DataFrame, items: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The documents without a contamination; same columns."""
    bad = contaminations(docs, items, rule).select(F.col("doc_id").alias("__id"), F.col("key").alias("__bad")).distinct()
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*own, content_key(F.col("text"), "__key"))
    same = F.col("__key").eqNullSafe(F.col("__bad")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return rows.join(bad, same, "left_anti").select(*own)


def op4_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, hits, overlap) of all contaminated documents."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return contaminations(docs, items).select("doc_id", "item_id", "hits", "overlap")
