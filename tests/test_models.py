"""Models checked by invariants and on a small separable bank."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ledgerlens import testbed
from ledgerlens.models import evaluation, features, forest, scoring, training
from ledgerlens.models.features import Task
from ledgerlens.registry import QUERIES
from ledgerlens.registry import models as queries
from tests.conftest import rows

TOY = Task("toy", "id", ("x", "kind"), "y", trees=10, depth=3, text_features=("kind",))


def toy_rows(n=400):
    rng = random.Random(1)
    return [
        (i, rng.gauss(2.0 if i % 4 == 0 else 0.0, 1.0), rng.choice("abc"), int(i % 4 == 0))
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def toy(spark):
    df = spark.createDataFrame(toy_rows(), "id bigint, x double, kind string, y int")
    return training.fit(df, TOY)


def test_codes_are_alphabetical_plain_numbers(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "c"), (4, "c"), (5, "c")], "id int, kind string")
    coded = training.label_encode(df, TOY)
    assert rows(coded, "kind", "kind_code") == [
        ("a", 0.0), ("b", 1.0), ("c", 2.0), ("c", 2.0), ("c", 2.0),
    ]
    assert not coded.schema["kind_code"].metadata


def test_many_labels_are_coded_by_ranges(spark):
    task = Task("wide", "id", ("text",), "y", trees=1, depth=1, text_features=("text",))
    df = spark.range(200_000).selectExpr("id", "concat('é', id * 7919 % 200000) as text", "0 as y")
    df = df.union(df.limit(10)).union(spark.sql("select -1L, cast(null as string), 0"))
    coded = {r.text: r.text_code for r in training.label_encode(df, task).collect()}
    assert coded.pop(None) is None
    order = sorted(coded, key=lambda t: t.encode())
    assert len(order) == 200_000 and [coded[t] for t in order] == list(range(200_000))


def test_training_parts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(training, "ROWS_PER_PART", 10)
    monkeypatch.setattr(training, "MAX_PARTS", 4)
    df = spark.range(100).withColumn("draw_key", F.md5(F.col("id").cast("string")))
    assert training.spread(df, "id").rdd.getNumPartitions() == 4


def test_scaling_uses_training_rows_and_the_population_deviation(toy):
    train = toy.data.filter("is_train")
    scaled = training.scaler(train, ["x"]).transform(train)
    got = scaled.agg(F.avg("x_z").alias("m"), F.stddev_pop("x_z").alias("s")).first()
    assert got.m == pytest.approx(0, abs=1e-12) and got.s == pytest.approx(1)


def test_constant_feature_scales_to_zero(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert {r.x_z for r in training.scaler(df, ["x"]).transform(df).collect()} == {0.0}


def test_weights_add_up_to_the_rows(toy):
    weights = features.balanced_weights(toy.data, "y").collect()
    assert sum(r.class_rows * r.weight for r in weights) == pytest.approx(400)
    assert len({r.class_rows * r.weight for r in weights}) == 1


def test_the_cap_leaves_test_rows_alone(spark):
    capped = Task("capped", "id", ("x", "kind"), "y", trees=2, depth=2, text_features=("kind",), max_rows=100)
    df = spark.createDataFrame(toy_rows(), "id bigint, x double, kind string, y int")
    fit = training.fit(df, capped)
    used = fit.rows_used().first()
    assert (used.train_rows, used.fitted_rows, used.test_rows) == (320, 100, 80)
    assert fit.scored(fit.forest).count() == 80


def transactions(spark, n=520_000):
    """Feature rows of the fraud task, more than the reference keeps in memory for training."""
    return spark.range(n).selectExpr(
        "id as CARD_TXN_ID", "cast(id * 7919 % 100003 as double) as AMOUNT", "concat('t', id % 3) as CARD_TYPE",
        "concat('m', id % 5) as MERCHANT_CATEGORY", "cast(id % 1009 as int) as days_since_txn",
        "cast(id % 11 = 0 as int) as IS_FRAUD",
    )


def test_fraud_models_fit_on_all_training_rows(spark):
    fit = training.fit(transactions(spark), features.FRAUD)
    used = fit.rows_used().first()
    assert used.fitted_rows == used.train_rows == sum(fit.counts.values()) == 416_000


def test_forest_does_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(training, "ROWS_PER_PART", 90)
    df = spark.createDataFrame(toy_rows(), "id bigint, x double, kind string, y int")
    scores = []
    for layout in (df.repartition(7), df.orderBy(F.col("id").desc()).coalesce(2)):
        fit = training.fit(layout, TOY)
        scores.append({r.id: r.score for r in fit.scored(fit.forest).collect()})
    assert scores[0] == scores[1]


def test_scores_that_bunch_up_spread_over_the_cells(spark):
    n = 200_000
    scored = spark.range(n).select(
        (F.lit(0.04) + F.col("id") * (0.0002 / n)).alias("score"),
        (F.col("id") % 7 == 0).cast("int").alias("label"),
        F.lit(0).alias("prediction"),
    )
    points = evaluation._score_counts(scored, "label", ())
    edges = points.agg(
        F.percentile_approx(
            "score",
            [i / evaluation.SCORE_CELLS for i in range(1, evaluation.SCORE_CELLS)],
            10 * evaluation.SCORE_CELLS,
        ).alias("e")
    ).first().e
    cells = points.select(evaluation._cell(F.lit(edges)).alias("c")).groupBy("c").count()
    assert cells.agg(F.max("count")).first()[0] < n / 100
    ranked = evaluation.ranked_scores(scored)
    last = ranked.agg(F.max("cum_pos").alias("p"), F.max("cum_neg").alias("n"), F.first("all_pos").alias("a")).first()
    assert last.p == last.a and last.p + last.n == n


def test_split_keeps_the_class_ratio(toy):
    counts = {(r.is_train, r.y): r["count"] for r in toy.data.groupBy("is_train", "y").count().collect()}
    assert counts == {(True, 0): 240, (True, 1): 80, (False, 0): 60, (False, 1): 20}


def test_both_models_learn(toy):
    for model in toy.models().values():
        assert evaluation.auc(toy.scored(model), "y").first().auc > 0.85


def test_auc_equals_the_evaluator(toy):
    for model in toy.models().values():
        scored = toy.scored(model)
        evaluator = BinaryClassificationEvaluator(
            rawPredictionCol="score", labelCol="y", numBins=0
        )
        assert evaluation.auc(scored, "y").first().auc == pytest.approx(
            evaluator.evaluate(scored), abs=1e-12
        )


def test_auc_and_curve_by_hand(spark):
    data = [(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.8), (0, 0.8001), (1, 1.0)]
    df = spark.createDataFrame(data, "label int, score double").withColumn(
        "prediction", (F.col("score") > 0.5).cast("int")
    )
    pos = [s for y, s in data if y]
    neg = [s for y, s in data if not y]
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    assert evaluation.auc(df).first().auc == pytest.approx(wins / 9)
    curve = [(r.threshold, r.fpr, r.tpr) for r in evaluation.roc_curve(df).collect()]
    assert curve[0] == (None, 0.0, 0.0) and curve[-1] == (0.1, 1.0, 1.0)
    assert curve[1] == (1.0, 0.0, pytest.approx(1 / 3))
    assert [c[0] for c in curve[1:]] == [1.0, 0.8001, 0.8, 0.4, 0.1]


def test_metrics_by_hand(spark):
    # tp 2, fp 1, fn 1, tn 4
    data = [(1, 1)] * 2 + [(0, 1)] + [(1, 0)] + [(0, 0)] * 4
    df = spark.createDataFrame(data, "label int, prediction int")
    assert rows(evaluation.confusion_matrix(df)) == [(0, 4, 1), (1, 1, 2)]
    report = {r["class"]: r for r in evaluation.class_report(df).collect()}
    assert (report["1"].precision, report["1"].recall, report["1"].f1) == (0.6667,) * 3
    assert (report["0"].precision, report["0"].support) == (0.8, 5)
    assert report["accuracy"].f1 == 0.75
    assert report["macro avg"].recall == pytest.approx(0.7333)
    assert report["weighted avg"].recall == 0.75
    assert rows(evaluation.precision_recall(df)) == [(0.6667, 0.6667)]


def test_no_positive_prediction_gives_zero(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    assert rows(evaluation.precision_recall(df)) == [(0.0, 0.0)]


def test_summary_and_best_model(toy):
    parts = [
        toy.scored(m).select(F.lit(n).alias("model"), F.col("y").alias("label"), "prediction", "score")
        for n, m in toy.models().items()
    ]
    summary = evaluation.model_summary(parts[0].unionByName(parts[1]), ["model"])
    by_model = {r.model: r for r in summary.collect()}
    for name, model in toy.models().items():
        scored = toy.scored(model)
        exact = evaluation.precision_recall(scored, "y").first()
        assert (by_model[name].precision, by_model[name].recall) == (exact.precision, exact.recall)
        assert by_model[name].roc_auc == round(evaluation.auc(scored, "y").first().auc, 4)
    best = evaluation.best_model(summary).first()
    assert best.roc_auc == max(r.roc_auc for r in by_model.values())
    assert by_model[best.best_model].roc_auc == best.roc_auc


def test_one_class_cannot_be_trained(spark):
    df = spark.createDataFrame([(i, float(i), "a", 0) for i in range(20)],
                               "id bigint, x double, kind string, y int")
    assert not features.class_check(df, "y").first().trainable
    with pytest.raises(ValueError, match="two classes"):
        training.fit(df, TOY)


def test_importances_add_up(spark, toy):
    found = evaluation.feature_importance(spark, toy.forest, TOY).collect()
    assert found[0].feature == "x"
    assert sum(r.importance for r in found) == pytest.approx(1)


def test_coefficients_name_their_terms(spark, toy):
    found = {r.term: r.weight for r in evaluation.coefficients(spark, toy.logistic, TOY).collect()}
    assert set(found) == {"x", "kind", "(intercept)"} and found["x"] > 0


def test_scoring_tasks_carry_no_session(spark, toy):
    """A session with metrics attached cannot be shipped; models must not hold on to it."""
    spark.range(3).observe(Observation("seen"), F.count(F.lit(1)).alias("n")).collect()
    for model in toy.models().values():
        assert toy.scored(model).count() == 80
        assert not model.stages[-1].hasSummary


def test_reloaded_models_score_the_same(toy, tmp_path):
    for name, model in toy.models().items():
        path = str(tmp_path / name.replace(" ", "_"))
        training.save(model, path)
        training.save(model, path)
        again = training.load(path)
        assert rows(toy.scored(again)) == rows(toy.scored(model))


def test_active_loans_are_scored_even_with_gaps(spark, sf_dir):
    bank = testbed.bank_on(spark, sf_dir)
    gaps = bank["customers"].withColumn(
        "CREDIT_SCORE", F.when(F.col("CUSTOMER_ID") % 2 == 0, F.col("CREDIT_SCORE"))
    )
    bank._open["customers"] = gaps
    task = Task("late", "LOAN_ID", features.LATE.features, features.LATE.label, trees=5, depth=3)
    fit = training.fit(features.late_features(bank, testbed.AS_OF), task)
    scored = scoring.score_active(bank, fit.forest, testbed.AS_OF)
    active = scoring.active_loans(features.late_frame(bank, testbed.AS_OF)).count()
    assert scored.count() == active
    share = scoring.high_risk_share(scored).first()
    assert share.active_loans == active
    assert share.high_risk_pct == round(share.high_risk_loans / active * 100, 1)
    top = scoring.riskiest_loans(scored).collect()
    assert len(top) == 10
    assert [r.late_risk_score for r in top] == sorted((r.late_risk_score for r in top), reverse=True)


def test_share_of_no_active_loans_is_null(spark):
    empty = spark.createDataFrame([], "LOAN_ID bigint, late_risk_score double")
    assert rows(scoring.high_risk_share(empty)) == [(0, 0, None)]


def test_late_label_follows_from_its_feature(spark, sf_dir):
    frame = features.late_features(testbed.bank_on(spark, sf_dir), testbed.AS_OF)
    assert frame.filter((F.col("late_ratio") > 0) != (F.col("ever_late") == 1)).count() == 0


def test_best_split_by_hand():
    # Bins 0..2 of one feature; class 1 weighs 3 times as much.
    counts = np.zeros((1, 2, forest.BINS), np.int64)
    counts[0, 0, :3], counts[0, 1, :3] = [4, 2, 0], [0, 1, 1]
    feature, cut, gain, below = forest.best_split(counts, [1.0, 3.0])

    def gini(a, b):
        return 1 - (a / (a + b)) ** 2 - (b / (a + b)) ** 2

    first = gini(6, 6) - 4 / 12 * gini(4, 0) - 8 / 12 * gini(2, 6)
    second = gini(6, 6) - 9 / 12 * gini(6, 3) - 3 / 12 * gini(0, 3)
    assert first > second
    assert (feature, cut, below.tolist()) == (0, 0, [4, 0]) and gain == pytest.approx(first)


def test_forest_does_not_depend_on_the_number_of_parts(spark, monkeypatch):
    """Training tasks can be as many as suit the table: trees follow from the rows alone."""
    df = spark.createDataFrame(toy_rows(), "id bigint, x double, kind string, y int")
    trees = []
    for rows_per_part, memory in ((1000, forest.PASS_BYTES), (50, 1)):
        monkeypatch.setattr(training, "ROWS_PER_PART", rows_per_part)
        monkeypatch.setattr(forest, "PASS_BYTES", memory)
        trees.append(training.fit(df, TOY).forest.stages[-1].toDebugString.split("\n", 1)[1])
    assert trees[0] == trees[1]


def test_forest_learns_as_the_library_does(spark, toy):
    """Same rules, other draws: scores of both forests lie close together."""
    ready = toy.forest.stages[0].transform(toy.fitted)
    for stage in toy.forest.stages[1:-1]:
        ready = stage.transform(ready)
    weight = F.when(F.col("y") == 1, 2.0).otherwise(2 / 3)
    library = RandomForestClassifier(
        labelCol="y", weightCol="w", numTrees=200, maxDepth=3, featureSubsetStrategy="sqrt", seed=1
    ).fit(ready.withColumn("w", weight))
    wide = Task("wide", "id", ("x", "kind"), "y", trees=200, depth=3, text_features=("kind",))
    ours = training.fit_forest(toy.fitted, wide, toy.stages, toy.counts)
    assert ours.stages[-1].getNumTrees == 200
    theirs = training.PipelineModel([*ours.stages[:-1], training._bare(library)])
    expected = {r.id: r.score for r in toy.scored(theirs).collect()}
    gaps = [abs(r.score - expected[r.id]) for r in toy.scored(ours).collect()]
    assert max(gaps) < 0.15 and sum(gaps) / len(gaps) < 0.03


def test_bootstrap_counts_are_poisson():
    seeds = np.arange(50_000, dtype=np.uint64)
    draws = forest.poisson_table()
    bits = forest.mixed(seeds, 7).view("<u2").reshape(-1, 4)
    for column in range(4):
        times = draws.take(bits[:, column])
        assert times.mean() == pytest.approx(1, abs=0.02) and times.var() == pytest.approx(1, abs=0.04)


def test_thresholds_lie_between_few_values_and_at_quantiles_of_many(spark):
    df = spark.range(10_000).selectExpr("cast(id % 3 as double) as few", "cast(id as double) as many", "md5(string(id)) as draw_key")
    few, many = forest.thresholds(df, ["few", "many"])
    assert few == [0.5, 1.5]
    assert many == pytest.approx([9_999 * i / 32 for i in range(1, 32)])


def test_thresholds_are_quantiles_of_all_rows(spark):
    """Of a table far too large for a sample of some ten thousand rows to hold."""
    df = spark.range(120_000).selectExpr(
        "exp(id * 7919 % 120000 / 9000) as x", "if(id % 3 = 0, 17D, id % 1000) as y", "md5(string(id)) as draw_key"
    )
    held = df.toPandas()
    for column, found in zip("xy", forest.thresholds(df.repartition(5), ["x", "y"])):
        expected = np.unique(np.quantile(held[column], np.arange(1, 32) / 32))
        assert found == pytest.approx(expected.tolist(), rel=1e-14)


def test_scoring_tasks_follow_from_the_rows(spark, toy, monkeypatch):
    monkeypatch.setattr(training, "ROWS_PER_SCORING", 10)
    assert toy.scored(toy.forest).rdd.getNumPartitions() == 8
    monkeypatch.setattr(training, "MAX_SCORING_PARTS", 4)
    assert toy.scored(toy.forest).rdd.getNumPartitions() == 4


def test_summaries_of_trained_models_score_once(spark, toy):
    """What is aggregated several times is the written counts, not the models' scores."""
    scored = toy.scored(toy.forest).select(F.lit("a").alias("model"), F.col("y").alias("label"), "prediction", "score")
    found = evaluation.written_summary(scored, ["model"])
    assert rows(found) == rows(evaluation.model_summary(scored, ["model"]))
    assert "UDF" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_regression_tasks_are_bounded_for_the_driver():
    """Every task reports a few KB per iteration."""
    assert training.parts_for(20_000_000) <= 128


@pytest.fixture(scope="module")
def many_transactions(spark):
    """Model queries with more transactions than the reference trains on; models are their own."""
    with pytest.MonkeyPatch.context() as patch:
        frame = transactions(spark)
        patch.setitem(features.FEATURES, "fraud", lambda bank, day: frame)
        patch.setattr(queries, "_fitted", {})
        yield


def rows_at_root(forest_model):
    """Bootstrapped training rows per tree; close to all training rows."""
    trees = forest_model.stages[-1].trees
    return sum(t._java_obj.rootNode().impurityStats().rawCount() for t in trees) / len(trees)


@pytest.mark.parametrize(
    "name",
    [
        "ml_lr_fit",
        "ml_feature_importance",
        "ml_save_load",
        "ml_fitted_summary",
        "ml_fitted_best",
        "insight_models",
    ],
)
def test_model_queries_learn_from_every_training_row(spark, sf_dir, many_transactions, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
    assert {task for *_, task in queries._fitted} == {"fraud", "default", "late"}
    for fit in queries._fitted.values():
        used = fit.rows_used().first()
        assert used.fitted_rows == used.train_rows == sum(fit.counts.values())
        if name != "ml_lr_fit":
            assert rows_at_root(fit.forest) == pytest.approx(used.train_rows, rel=0.02)
