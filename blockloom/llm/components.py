"""Connected components of an edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.session import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node (its larger ones, or its smaller ones and itself) on the least of all."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = both.join(least, "u")
    if large:
        return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(own).distinct()


def _settled(state: DataFrame) -> bool:
    """Whether every node hangs on one other, which hangs on none."""
    several = state.groupBy("u").count().where("count > 1").select("u")
    inner = state.join(state.select(F.col("u").alias("v")), "v", "left_semi").select("u")
    return several.unionAll(inner).agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame) -> DataFrame:
    """(v, root): every node of edges (a, b) with the least node of its component, but for roots.

    Ends when all components are stars; the number of rounds grows with the logarithm of the
    longest chain. Every round is a table in the shared folder; no node's neighbours are gathered.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = stored(pairs)
    while not _settled(state):
        state = stored(_stars(_stars(state, True), False))
    return state.select(F.col("u").alias("v"), F.col("v").alias("root"))
