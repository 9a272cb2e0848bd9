"""The training job: label, split, balance, vectorise, fit, evaluate, save."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators.features import FeatureRules, block_features
from blockloom.operators.flatten import SectionRules, html_blocks
from blockloom.operators.pairing import fuzzy_label
from blockloom.operators.reports import classification_report
from blockloom.operators.sampling import SEED, balance_classes, limit_blocks, limit_files, train_test_split
from blockloom.operators.vectors import MAX_TERMS, fit_vectors
from blockloom.session import scratch_path, stored

TASK_ROWS = 5_000  # balanced blocks that trees are fitted to, at least, in each task
MOST_TASK_ROWS = 100_000  # and at most, as each task keeps its own in memory or on disk while trees are fitted


def labeled_blocks(
    labels: DataFrame,
    pages: DataFrame,
    key: str = "file",
    html: str = "html",
    limit: int | None = None,
    sections: SectionRules = SectionRules(),
    features: FeatureRules = FeatureRules(),
    threshold: float = 0.8,
) -> DataFrame:
    """Featurised, weakly labelled blocks of every page that has a label record.

    With limit, the first that many label files and, of their blocks, the first
    that many.
    """
    if limit is not None:
        labels = limit_files(labels, limit, key)
    known = pages.select(key, html).join(labels.select(key), key, "left_semi")
    blocks = html_blocks(known, key, html, rules=sections)
    rows = block_features(fuzzy_label(blocks, labels, key, threshold), features)
    return limit_blocks(rows, limit, (key, "idx")) if limit is not None else rows


@dataclass
class Trained:
    model: PipelineModel
    report: DataFrame
    predictions: DataFrame


def fit_classifier(
    balanced: DataFrame,
    label: str = "label",
    max_terms: int = MAX_TERMS,
    rounds: int = 100,
    depth: int = 5,
    seed: int = SEED,
) -> PipelineModel:
    """Boosted trees, one per class, over structured and text features of all rows."""
    stages = fit_vectors(balanced, "raw", max_terms)
    target = StringIndexer(inputCol=label, outputCol="__y", handleInvalid="keep", stringOrderType="alphabetAsc").fit(balanced)
    rows = balanced
    for stage in [*stages, target]:
        rows = stage.transform(rows)
    rows = stored(rows.select("features", "__y"))
    context = balanced.sparkSession.sparkContext
    # Thousands of stages follow, each with a task and a histogram per partition, so these are as few as memory allows.
    n = rows.count()
    tasks = max(1, min(context.defaultParallelism, n // TASK_ROWS))
    wide = n > tasks * MOST_TASK_ROWS
    rows = rows.repartition(-(-n // MOST_TASK_ROWS)) if wide else rows.coalesce(tasks)
    if not context._jsc.sc().getCheckpointDir().isDefined():  # boosting then cuts its lineage now and then
        context.setCheckpointDir(scratch_path(balanced.sparkSession, "boosting"))
    booster = GBTClassifier(
        featuresCol="features", labelCol="__y", maxIter=rounds, maxDepth=depth, seed=seed, stepSize=0.1
    )
    classifier = OneVsRest(
        classifier=booster, featuresCol="features", labelCol="__y", predictionCol="__p", parallelism=1 if wide else 4
    ).fit(rows)
    back = IndexToString(inputCol="__p", outputCol="prediction", labels=target.labels)
    return PipelineModel([*stages, classifier, back])


def predict(model: PipelineModel, blocks: DataFrame) -> DataFrame:
    """Add prediction to featurised blocks."""
    scored = model.transform(blocks)
    return scored.select(*blocks.columns, "prediction")


def train(
    blocks: DataFrame,
    key: list[str],
    label: str = "label",
    by: list[str] | None = None,
    test: float = 0.2,
    rounds: int = 100,
    depth: int = 5,
    max_terms: int = MAX_TERMS,
    seed: int = SEED,
) -> Trained:
    """Split, balance the training part, fit, and report on the held-out part.

    by splits on other columns than key, e.g. the page. The labelled blocks are
    stored once: counting, sampling and fitting read them several times. Vocabulary, weights
    of terms and trees, each of whose levels is a pass over its rows, come from all balanced
    blocks. Jobs run as this is called.
    """
    rows = stored(train_test_split(blocks, by or key, test, seed))
    learned = rows.where("part = 'train'").drop("part")
    balanced = stored(balance_classes(learned, key, label, seed=seed))
    model = fit_classifier(balanced, label, max_terms, rounds, depth, seed)
    predictions = predict(model, rows.where("part = 'test'").drop("part"))
    return Trained(model, classification_report(predictions, label), predictions)


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
