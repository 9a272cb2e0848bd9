"""Model quality: per-class and average precision, recall, f1 and support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def classification_report(df: DataFrame, y: str = "label", yhat: str = "prediction") -> DataFrame:
    """Rows per class, then accuracy, macro avg and weighted avg.

    The rows are counted once into the confusion table, which has at most one
    row per pair of classes; everything else works on that. Classes that occur
    only as predictions are listed, and empty denominators give 0. The accuracy
    row has the accuracy in all three measures.
    """
    confusion = df.groupBy(F.col(y).alias("y"), F.col(yhat).alias("p")).agg(F.count("*").alias("n"))
    hit = F.col("y").eqNullSafe(F.col("p"))
    per_side = confusion.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("y").alias("class"), F.when(hit, F.col("n")).otherwise(0).alias("tp"),
                    F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted"),
                ),
                F.struct(
                    F.col("p").alias("class"), F.lit(0).cast("bigint").alias("tp"),
                    F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted"),
                ),
            )
        )
    )
    per_class = (
        per_side.groupBy("class")
        .agg(F.sum("tp").alias("tp"), F.sum("actual").alias("support"), F.sum("predicted").alias("predicted"))
        .withColumn("precision", _ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("tp"), F.col("support")))
        .withColumn("f1", _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")))
    )
    total = F.sum("support")
    accuracy = _ratio(F.sum("tp"), total)

    def weighted(c: str) -> Column:
        return _ratio(F.sum(F.col(c) * F.col("support")), total)

    averages = per_class.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("class"), accuracy.alias("precision"),
                accuracy.alias("recall"), accuracy.alias("f1"), total.alias("support"),
            ),
            F.struct(
                F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total.alias("support"),
            ),
            F.struct(
                F.lit("weighted avg").alias("class"), weighted("precision").alias("precision"),
                weighted("recall").alias("recall"), weighted("f1").alias("f1"), total.alias("support"),
            ),
        ).alias("rows")
    ).select(F.inline("rows"))
    columns = ["class", "precision", "recall", "f1", "support"]
    return per_class.select(*columns).unionByName(averages.select(*columns))
