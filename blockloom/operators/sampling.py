"""Limits, splits and class balancing that give the same rows on any cluster.

Randomness is md5(seed, key): a row's fate depends on its key alone, not on
partitions, executors or retries. Balancing collects the class plan (one row per
class) and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.operators.numbering import number_within

_RANGE = 2**32
_RADIX_BITS = 16
_DIGEST_DIGITS = 32
RESIDUE = 10_000  # rows that are ranked in one task
NONE = "none"
# Balancing and split defaults.
RATIO_NONE_TO_MINOR = 3
FLOOR_OF_MEAN = 0.33
TEST_SHARE = 0.2
SEED = 42


def seeded_hash(seed: int, *keys: Column | str) -> Column:
    """Hex digest of seed and keys; sorting by it is a seeded shuffle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k for k in keys]))


def hash_number(digest: Column) -> Column:
    """First 32 bits of a digest as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def limit_blocks(blocks: DataFrame, n: int, order: Sequence[str] = ("page_id", "idx")) -> DataFrame:
    """First n blocks in file and document order."""
    return blocks.orderBy(*order).limit(n)


def limit_files(files: DataFrame, n: int, order: str = "page_id") -> DataFrame:
    """First n files in name order; apply before flattening."""
    return files.orderBy(order).limit(n)


def train_test_split(
    df: DataFrame, key: Sequence[str], test: float = TEST_SHARE, seed: int = SEED, out: str = "part"
) -> DataFrame:
    """Add part: 'train' or 'test'. Rows with the same key always fall together.

    Splitting by (page, idx) treats blocks alone; splitting by page keeps a
    page's blocks on one side. The share holds on average, not exactly.
    """
    cut = int(test * _RANGE)
    return df.withColumn(
        out, F.when(hash_number(seeded_hash(seed, *key)) < cut, "test").otherwise("train")
    )


def shuffle(df: DataFrame, key: Sequence[str], seed: int = SEED) -> DataFrame:
    return df.orderBy(seeded_hash(seed, *key), *key)


def class_plan(
    df: DataFrame, label: str = "label", ratio: int = RATIO_NONE_TO_MINOR, floor: float = FLOOR_OF_MEAN
) -> DataFrame:
    """(label, n, mean_minor, floor_target, target): the rows each class should end up with.

    'none' goes down to ratio times all other rows; any other class goes up to
    int(floor * mean size of the other classes). One row per class.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    everything = Window.partitionBy(F.lit(0))  # one row per class
    minor_n = F.when(F.col(label) != NONE, F.col("n"))
    mean = F.coalesce(F.avg(minor_n).over(everything), F.lit(0.0))
    minors = F.coalesce(F.sum(minor_n).over(everything), F.lit(0))
    floor_target = F.floor(mean * F.lit(floor))
    return counts.select(
        label,
        "n",
        mean.alias("mean_minor"),
        floor_target.alias("floor_target"),
        F.when(F.col(label) == NONE, F.least("n", minors * ratio))
        .otherwise(F.greatest("n", floor_target))
        .alias("target"),
    )


def balance_classes(
    df: DataFrame,
    key: Sequence[str],
    label: str = "label",
    ratio: int = RATIO_NONE_TO_MINOR,
    floor: float = FLOOR_OF_MEAN,
    seed: int = SEED,
    out: str = "copy",
    shuffled: bool = False,
) -> DataFrame:
    """Down-sample 'none' without, and lift small classes with, replacement.

    key must identify rows. Adds copy: the draw's number for rows of a lifted
    class (their originals are replaced by the draws), 0 for all others.
    """
    plan = {r[label]: (r["n"], r["target"]) for r in class_plan(df, label, ratio, floor).collect()}
    key = list(key)
    lifted = [c for c, (n, target) in plan.items() if c not in (NONE, None) and target > n]
    kept = df.where(~F.coalesce(F.col(label).isin(lifted), F.lit(False))) if lifted else df
    n_none, target_none = plan.get(NONE, (0, 0))
    if target_none < n_none:
        kept = _keep_first(kept, key, label, n_none, target_none, seed)
    parts = [kept.withColumn(out, F.lit(0).cast("bigint"))]
    parts += [_draw(df, key, label, c, *plan[c], seed, out) for c in lifted]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return shuffle(result, [*key, out], seed) if shuffled else result


def _keep_first(df: DataFrame, key: list[str], label: str, n: int, target: int, seed: int) -> DataFrame:
    """All rows but those of the n 'none' rows that come after the first target ones in hash order.

    Radix selection: a histogram of the hash's next 16 bits, over the rows that agree with the edge so far,
    finds the value in which the target falls, until no more than RESIDUE rows are left. Rows below the edge
    stay without being sorted; only the residue, whose size does not grow with the class, is ranked.
    """
    is_none = F.col(label).eqNullSafe(NONE)
    hashed = df.withColumn("__digest", F.when(is_none, seeded_hash(seed, *key)))
    if target <= 0:
        return hashed.where(~is_none).drop("__digest")
    edge, left, width = "", n, _RADIX_BITS // 4  # hexadecimal digits
    while left > RESIDUE and len(edge) < _DIGEST_DIGITS:
        digits = F.substring("__digest", len(edge) + 1, width)
        counted = hashed.where(is_none & F.col("__digest").startswith(edge)).groupBy(digits.alias("d")).count()
        for r in sorted(counted.collect()):  # at most 2 ** _RADIX_BITS rows
            left = r["count"]
            if left >= target:
                edge += r["d"]
                break
            target -= left
    sure = hashed.where(~is_none | (F.col("__digest") < edge))
    rank = F.row_number().over(Window.partitionBy(F.substring("__digest", 1, len(edge))).orderBy("__digest", *key))
    residue = hashed.where(is_none & F.col("__digest").startswith(edge)).withColumn("__rank", rank)
    return sure.unionByName(residue.where(F.col("__rank") <= target).drop("__rank")).drop("__digest")


def _draw(
    df: DataFrame, key: list[str], label: str, value: str, n: int, target: int, seed: int, out: str
) -> DataFrame:
    """target draws with replacement from the n rows of a class."""
    members = df.where(F.col(label) == value).withColumn("__digest", seeded_hash(seed, *key))
    ranked = number_within(
        members.select(*key, "__digest"), [], ["__digest", *key], "__rank"
    ).drop("__digest")
    draws = df.sparkSession.range(target).select(
        F.col("id").alias(out),
        (hash_number(seeded_hash(seed, F.lit(value), F.col("id").cast("string"))) % F.lit(n)).alias("__rank"),
    )
    picked = draws.join(ranked, "__rank").drop("__rank")
    return members.drop("__digest").join(picked, key)
