"""Distributed fitting with ``pyspark.ml``: encoders, scaling, logistic regression, forest."""

from __future__ import annotations

from functools import cached_property

from pyspark.ml import Model, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.models import forest
from ledgerlens.models.features import Task, scaling
from ledgerlens.operators.sampling import (
    SEED,
    draw_key,
    pick_thresholds,
    picked_by,
    sample_quota,
    train_quota,
)
from ledgerlens.sources.scratch import new_folder, written

# Inverse regularisation strength and iteration limit of the logistic regression.
INVERSE_REGULARISATION = 1.0
MAX_ITERATIONS = 100
# Rows of a training partition. Trees do not depend on it.
ROWS_PER_PART = 25_000
# Training tasks per iteration stay below this, and so do partial counts per tree level and what
# tasks report to the driver; larger tables get larger parts.
MAX_PARTS = 128
# A row to be scored passes through every tree, so a task gets far fewer of them than of other rows.
ROWS_PER_SCORING = 10_000
MAX_SCORING_PARTS = 512


class Fitted:
    """Both models of one task on one split frame; each is trained when it is first used."""

    def __init__(self, task: Task, data: DataFrame):
        self.task = task
        self.data = data
        self.fitted = data.filter("is_fitted")
        self.counts = class_counts(self.fitted, task.label)

    @cached_property
    def stages(self) -> list[Transformer]:
        return encoders(self.data, self.task)

    @cached_property
    def train(self) -> DataFrame:
        return spread(self.fitted, self.task.key)

    @cached_property
    def logistic(self) -> PipelineModel:
        return fit_logistic(self.train, self.task, self.stages, self.counts)

    @cached_property
    def forest(self) -> PipelineModel:
        return fit_forest(self.fitted, self.task, self.stages, self.counts)

    def models(self) -> dict[str, PipelineModel]:
        return {"Logistic Regression": self.logistic, "Random Forest": self.forest}

    def test(self) -> DataFrame:
        """Every row outside the training part; a cap never reaches these."""
        return for_scoring(self.data.filter("NOT is_train"), self.task.key)

    def rows_used(self) -> DataFrame:
        """One row: training rows, those fitted on, and test rows."""
        return self.data.agg(
            F.count_if("is_train").alias("train_rows"),
            F.count_if("is_fitted").alias("fitted_rows"),
            F.count_if(~F.col("is_train")).alias("test_rows"),
        )

    def scored(self, model: PipelineModel) -> DataFrame:
        return predict(model, self.test(), self.task.key, self.task.label)


def encoders(df: DataFrame, task: Task) -> list[Transformer]:
    """Text to codes 0..k-1 in alphabetical order, as plain numbers.

    The indexer marks its output as a category, which would make trees split it as a set. The
    codes are meant as ordered numbers, so the arithmetic drops that mark.
    """
    if not task.text_features:
        return []
    indexer = StringIndexer(
        inputCols=list(task.text_features),
        outputCols=[f + "_index" for f in task.text_features],
        stringOrderType="alphabetAsc",
    ).fit(df)
    plain = ", ".join(f"`{f}_index` + 0D AS `{f}_code`" for f in task.text_features)
    return [indexer, SQLTransformer(statement=f"SELECT *, {plain} FROM __THIS__")]


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """``column, code``: the distinct texts of a column, numbered from 0 in byte order.

    Texts are dealt by ranges and numbered within their range; the only rows that meet in one task
    are the sizes of the ranges. Null has no code.
    """
    texts = df.select(column).filter(F.col(column).isNotNull()).distinct()
    # Written, so that ranges are drawn once and both uses below see the same.
    ranged = written(
        texts.repartitionByRange(column).withColumn("part", F.spark_partition_id()), "labels"
    )
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("part").count().select(
        "part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("offset")
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1
    # One row per range.
    return ranged.join(F.broadcast(offsets), "part").select(
        column, (F.col("offset") + place).cast("double").alias("code")
    )


def label_encode(df: DataFrame, task: Task) -> DataFrame:
    """A column ``<feature>_code`` per text feature, whatever the number of its texts."""
    for feature in task.text_features:
        codes = written(dictionary(df, feature), "codes").withColumnRenamed("code", f"{feature}_code")
        df = df.join(codes, feature, "left").select(*df.columns, f"{feature}_code")
    return df


def scaler(train: DataFrame, columns: list[str]) -> SQLTransformer:
    """z-scores with the mean and population deviation of the training rows."""
    found = {r.feature: (r.mean, r.std) for r in scaling(train, columns).collect()}
    terms = ", ".join(
        f"(`{c}` - ({found[c][0]!r}D)) / {found[c][1] or 1.0!r}D AS `{c}_z`" for c in columns
    )
    return SQLTransformer(statement=f"SELECT *, {terms} FROM __THIS__")


def prepare(features: DataFrame, task: Task) -> DataFrame:
    """Split, and cap the rows a model is fitted on where a caller's task has a cap.

    Every row is either training or test row (``is_train``). ``is_fitted`` marks the training rows
    the models learn from: all in every task of ``features.TASKS``, or a stratified sample of
    ``max_rows`` of them in a task that sets it.
    The features are written once with their draw key, since sampling, splitting and every fit
    read them again. Thresholds are one short text per class, so the split itself is an expression
    on that table.
    """
    draw = F.col("draw_key")
    label = task.label
    data = written(
        features.withColumn("draw_key", draw_key([task.key, *task.features])),
        f"{task.name}-features",
    )

    def thresholds(rows: DataFrame, quota: Column) -> dict[int, str]:
        return {r[label]: r["last"] for r in pick_thresholds(rows, label, draw, quota).collect()}

    data = data.withColumn("is_train", picked_by(thresholds(data, train_quota()), label, draw))
    if not task.max_rows:
        return data.withColumn("is_fitted", F.col("is_train"))
    train = data.filter("is_train")
    fitted = picked_by(thresholds(train, sample_quota(task.max_rows)), label, draw)
    return data.withColumn("is_fitted", F.col("is_train") & fitted)


def parts_for(rows: int) -> int:
    return min(MAX_PARTS, max(1, -(-rows // ROWS_PER_PART)))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Partitions of about ``ROWS_PER_PART`` rows, ``MAX_PARTS`` at most, in the order of the draw key.

    The regression adds up its rows in this order, which follows from the rows alone: not from
    cores, file layout or the order in which shuffled blocks arrive.
    """
    return df.repartition(parts_for(df.count()), key).sortWithinPartitions("draw_key", key)


def for_scoring(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """The rows dealt to tasks by their number; by file size, a few tasks would score them all."""
    rows = df.count() if rows is None else rows
    return df.repartition(min(MAX_SCORING_PARTS, max(1, -(-rows // ROWS_PER_SCORING))), key)


def class_counts(train: DataFrame, label: str) -> dict[int, int]:
    """Rows per class; raises when there is only one class to learn."""
    found = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    if len(found) < 2:
        raise ValueError(f"{label} needs at least two classes, found {sorted(found)}")
    return found


def fit_logistic(
    train: DataFrame, task: Task, stages: list[Transformer], counts: dict[int, int]
) -> PipelineModel:
    """L2 logistic regression on z-scores; the penalty is given per row of training data."""
    columns = task.encoded()
    stages = [*stages, scaler(_apply(stages, train), columns)]
    stages.append(VectorAssembler(inputCols=[c + "_z" for c in columns], outputCol="features"))
    rows = sum(counts.values())
    estimator = LogisticRegression(
        labelCol=task.label,
        regParam=1.0 / (INVERSE_REGULARISATION * rows),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=MAX_ITERATIONS,
    )
    return PipelineModel([*stages, _bare(estimator.fit(_apply(stages, train)))])


def fit_forest(
    train: DataFrame, task: Task, stages: list[Transformer], counts: dict[int, int]
) -> PipelineModel:
    """Random forest on unscaled features with balanced class weights."""
    rows = sum(counts.values())
    weights = [rows / (len(counts) * counts[c]) if c in counts else 0.0 for c in range(max(counts) + 1)]
    columns = task.encoded()
    grown = forest.fit(
        _apply(stages, train), columns, task.label, weights, task.trees, task.depth, SEED,
        parts_for(rows),
    )
    return PipelineModel([*stages, VectorAssembler(inputCols=columns, outputCol="features"), grown])


def fit(features: DataFrame, task: Task) -> Fitted:
    """Prepare the features for both models of the task; a label of one class raises."""
    return Fitted(task, prepare(features, task))


def predict(model: PipelineModel, df: DataFrame, *keep: str) -> DataFrame:
    """Predicted class and probability of the positive class, next to the kept columns."""
    return model.transform(df).select(
        *keep,
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("score"),
    )


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _bare(model: Model) -> Model:
    """The model without its training summary.

    The summary holds the session and the training frame, and both would travel with every
    scoring task. A saved model has neither.
    """
    path = new_folder(SparkSession.active(), "fitted")
    model.write().save(path)
    return type(model).load(path)


def _apply(stages: list[Transformer], df: DataFrame) -> DataFrame:
    for stage in stages:
        df = stage.transform(df)
    return df
