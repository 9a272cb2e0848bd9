"""Dense numbering that does not depend on any group fitting into one task.

row_number() puts a whole window partition into one task, which a domain or a
class holding a third of all rows does not survive. Here rows are range-sorted
into even partitions, numbered locally, and shifted by the counts of the
partitions before them. Only (partition, group) counts are added up, and these
are at most one per partition and group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.session import stored

_LOCAL_BITS = 33  # monotonically_increasing_id(): partition in the upper 31 bits


def number_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    out: str,
    start: int | Column = 0,
) -> DataFrame:
    """Number the rows of every group start, start+1, ... in the given order.

    order should be unique within a group; without keys the numbering is global.
    The sorted rows are stored, because both passes must see the same
    partitions: pass narrow rows and join wide ones back by key.
    """
    keys, order = list(keys), list(order)
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = stored(ranged.withColumn("__pos", F.monotonically_increasing_id()))
    rows = rows.withColumn("__part", F.shiftright("__pos", _LOCAL_BITS))

    runs = rows.groupBy("__part", *keys).agg(
        F.min("__pos").alias("__first"), F.count("*").alias("__n")
    )
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    runs = runs.select(
        F.col("__part").alias("__run"),
        *[F.col(k).alias(f"__run_{i}") for i, k in enumerate(keys)],
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
    )
    same = F.col("__part") == F.col("__run")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__run_{i}"))
    first = start if isinstance(start, Column) else F.lit(start)
    number = first.cast("bigint") + F.col("__pos") + F.col("__shift")
    return rows.join(runs, same).select(*df.columns, number.alias(out))
