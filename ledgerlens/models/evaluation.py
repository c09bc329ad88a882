"""Evaluation as aggregates over (label, prediction, score) frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.functions.quantiles import once, with_scalar
from ledgerlens.functions.scalars import ratio, round_even
from ledgerlens.models.features import Task
from ledgerlens.sources.scratch import written

# The distinct scores are laid out in this many cells of about equal numbers for running sums.
SCORE_CELLS = 256
# Edges that one coarse step passes over.
EDGE_STEP = 16


def _confusion_columns(label: str) -> list[Column]:
    actual, predicted = F.col(label), F.col("prediction")
    return [
        F.count_if((actual == a) & (predicted == p)).alias(name)
        for name, a, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    ]


def confusion_counts(scored: DataFrame, label: str = "label") -> DataFrame:
    """True and false positives and negatives as one row."""
    return scored.agg(*_confusion_columns(label))


def confusion_matrix(scored: DataFrame, label: str = "label") -> DataFrame:
    """Actual class by predicted class."""
    return (
        scored.groupBy(F.col(label).alias("actual"))
        .pivot("prediction", [0, 1])
        .agg(F.count(F.lit(1)))
        .select(
            "actual",
            *(F.coalesce(F.col(f"`{p}`"), F.lit(0)).alias(f"predicted_{p}") for p in (0, 1)),
        )
        .orderBy("actual")
    )


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def class_report(scored: DataFrame, label: str = "label") -> DataFrame:
    """Precision, recall, f1 and support per class, with accuracy and both averages."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def row(precision: Column, recall: Column, support: Column):
        f1 = _or_zero(F.try_divide(2 * precision * recall, precision + recall))
        return precision, recall, f1, support

    zero = row(_or_zero(ratio(tn, tn + fn)), _or_zero(ratio(tn, tn + fp)), tn + fp)
    one = row(_or_zero(ratio(tp, tp + fp)), _or_zero(ratio(tp, tp + fn)), tp + fn)
    everything = zero[3] + one[3]
    macro = [(a + b) / 2 for a, b in zip(zero[:3], one[:3])]
    weighted = [
        F.try_divide(a * zero[3] + b * one[3], everything) for a, b in zip(zero[:3], one[:3])
    ]
    accuracy = ratio(tn + tp, everything)
    lines = [
        ("0", *zero),
        ("1", *one),
        ("accuracy", accuracy, accuracy, accuracy, everything),
        ("macro avg", *macro, everything),
        ("weighted avg", *weighted, everything),
    ]
    names = ("precision", "recall", "f1", "support")
    structs = [
        F.struct(
            F.lit(line[0]).alias("class"),
            *(round_even(v, 4).alias(n) for v, n in zip(line[1:4], names)),
            line[4].alias("support"),
        )
        for line in lines
    ]
    return confusion_counts(scored, label).select(F.explode(F.array(*structs)).alias("r")).select(
        "r.*"
    )


def precision_recall(scored: DataFrame, label: str = "label") -> DataFrame:
    """Precision and recall of the positive class; 0 when nothing was predicted or true."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return confusion_counts(scored, label).select(
        round_even(_or_zero(ratio(tp, tp + fp)), 4).alias("precision"),
        round_even(_or_zero(ratio(tp, tp + fn)), 4).alias("recall"),
    )


def ranked_scores(scored: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score with the positives and negatives at it and above it.

    Rows are counted per score first. The running sums then work within cells between sketch
    quantiles of the distinct scores, so scores that bunch up still spread over all cells; what
    lies in higher cells comes from the cell totals, of which there are at most ``SCORE_CELLS``
    per value of ``by`` (the models compared). No task ever sees all scores.
    """
    return _ranked(_score_counts(scored, label, by), by)


def _score_counts(scored: DataFrame, label: str, by: Sequence[str]) -> DataFrame:
    """Positives and negatives per score and predicted class: all a metric needs to know."""
    actual = F.col(label)
    return scored.groupBy(*by, "score", "prediction").agg(
        F.count_if(actual == 1).alias("pos"), F.count_if(actual == 0).alias("neg")
    )


def _cell(edges: Column) -> Column:
    """How many edges lie below the score, found in a coarse and a fine step."""

    def below(some: Column) -> Column:
        return F.size(F.filter(some, lambda e: e < F.col("score")))

    steps = F.sequence(F.lit(1), F.lit(SCORE_CELLS // EDGE_STEP - 1))
    coarse = F.transform(steps, lambda i: F.element_at(edges, (i * EDGE_STEP).cast("int")))
    return once(
        below(coarse) * EDGE_STEP,
        lambda start: start + below(F.slice(edges, start + 1, EDGE_STEP)),
    )


def _ranked(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    points = counts.groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    shares = [i / SCORE_CELLS for i in range(1, SCORE_CELLS)]
    edges = points.groupBy(*by).agg(
        F.percentile_approx("score", shares, 10 * SCORE_CELLS).alias("_edges")
    )
    points = (
        points.join(F.broadcast(edges), list(by))
        if by
        else with_scalar(points, "_edges", edges)
    )
    points = points.withColumn("_cell", once(F.col("_edges"), _cell)).drop("_edges")
    cells = points.groupBy(*by, "_cell").agg(
        F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg")
    )
    whole = W.partitionBy(*by)
    higher = whole.orderBy(F.col("_cell").desc()).rowsBetween(W.unboundedPreceding, -1)
    offsets = cells.select(
        *by,
        "_cell",
        F.coalesce(F.sum("_pos").over(higher), F.lit(0)).alias("_pos_above"),
        F.coalesce(F.sum("_neg").over(higher), F.lit(0)).alias("_neg_above"),
        F.sum("_pos").over(whole).alias("all_pos"),
        F.sum("_neg").over(whole).alias("all_neg"),
    )
    run = W.partitionBy(*by, "_cell").orderBy(F.col("score").desc())
    return points.join(F.broadcast(offsets), [*by, "_cell"]).select(
        *by,
        "score",
        "pos",
        "neg",
        (F.col("_pos_above") + F.sum("pos").over(run)).alias("cum_pos"),
        (F.col("_neg_above") + F.sum("neg").over(run)).alias("cum_neg"),
        "all_pos",
        "all_neg",
    )


def auc_value() -> Column:
    """Area under the curve from ranked scores: a positive beats every negative below it, and
    half of the negatives at its score."""
    below = F.col("all_neg") - F.col("cum_neg")
    wins = F.sum(F.col("pos").cast("double") * (2 * below + F.col("neg")))
    pairs = F.max(F.col("all_pos").cast("double") * F.col("all_neg"))
    return F.try_divide(wins, 2 * pairs)


def auc(scored: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    return ranked_scores(scored, label, by).groupBy(*by).agg(auc_value().alias("auc"))


def roc_curve(scored: DataFrame, label: str = "label") -> DataFrame:
    """False and true positive rate at every distinct score, from the strictest threshold on.

    The curve starts at the origin, where the threshold lies above every score (null here).
    """
    ranked = ranked_scores(scored, label)
    points = ranked.select(
        F.col("score").alias("threshold"),
        ratio("cum_neg", "all_neg").alias("fpr"),
        ratio("cum_pos", "all_pos").alias("tpr"),
    )
    origin = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return origin.unionByName(points).orderBy(F.col("threshold").desc_nulls_first())


def model_summary(scored: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    """AUC, recall and precision of every model in one frame of scores."""
    return summary_of_counts(_score_counts(scored, label, by), by)


def written_summary(scored: DataFrame, by: Sequence[str], label: str = "label") -> DataFrame:
    """The same with the counts per score written first, so that models score every row once."""
    return summary_of_counts(written(_score_counts(scored, label, by), "score-counts"), by)


def summary_of_counts(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    hits = F.col("prediction") == 1
    rates = counts.groupBy(*by).agg(
        _or_zero(ratio(F.sum(F.when(hits, F.col("pos"))), F.sum("pos"))).alias("recall"),
        _or_zero(
            ratio(F.sum(F.when(hits, F.col("pos"))), F.sum(F.when(hits, F.col("pos") + F.col("neg"))))
        ).alias("precision"),
    )
    areas = _ranked(counts, by).groupBy(*by).agg(auc_value().alias("auc"))
    # One row per model on both sides.
    return rates.join(F.broadcast(areas), list(by)).select(
        *by, *(round_even(F.col(c), 4).alias(n) for c, n in (
            ("auc", "roc_auc"), ("recall", "recall"), ("precision", "precision")
        ))
    )


def best_model(summary: DataFrame, *by: str) -> DataFrame:
    """The model with the largest AUC, per task when ``by`` names one."""
    return summary.groupBy(*by).agg(
        F.min_by("model", F.struct(-F.col("roc_auc"), "model")).alias("best_model"),
        F.max("roc_auc").alias("roc_auc"),
    )


def feature_importance(spark: SparkSession, model: PipelineModel, task: Task) -> DataFrame:
    """Importances of the forest, largest first, and each one's share in percent."""
    weights = model.stages[-1].featureImportances.toArray().tolist()
    rows = [(task.name, f, w) for f, w in zip(task.features, weights)]
    found = spark.createDataFrame(rows, "task string, feature string, importance double")
    return found.withColumn(
        "share_pct", round_even(F.col("importance") * 100, 1)
    ).orderBy(F.col("importance").desc(), "feature")


def coefficients(spark: SparkSession, model: PipelineModel, task: Task) -> DataFrame:
    """Coefficients of the logistic regression on z-scores, with the intercept."""
    fitted = model.stages[-1]
    rows = [
        *((task.name, f, w) for f, w in zip(task.features, fitted.coefficients.toArray().tolist())),
        (task.name, "(intercept)", float(fitted.intercept)),
    ]
    return spark.createDataFrame(rows, "task string, term string, weight double")
