"""Queries on feature frames, sampling, fitting, evaluation and scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import testbed
from ledgerlens.functions.scalars import round_even
from ledgerlens.models import evaluation, features, scoring, training
from ledgerlens.models.features import DEFAULT, FRAUD, LATE, TASKS
from ledgerlens.operators import sampling
from ledgerlens.plans import insights
from ledgerlens.registry.core import Context, query
from ledgerlens.schema import ACTIVE_STATUS
from ledgerlens.sources.scratch import new_folder
from ledgerlens.testbed import AS_OF

# Sample size of the sampling queries: below the row counts, so that something is left out.
SAMPLE_CAP = 10_000

_fitted: dict[tuple[str, str, str], training.Fitted] = {}


def fitted(context: Context, task: features.Task) -> training.Fitted:
    """Both models of a task, each trained at most once per application and data folder."""
    key = (context.spark.sparkContext.applicationId, context.sf_dir, task.name)
    if key not in _fitted:
        frame = features.FEATURES[task.name](context.bank, AS_OF)
        _fitted[key] = training.fit(frame, task)
    return _fitted[key]


def scores(context: Context) -> DataFrame:
    return testbed.model_scores(context.spark, context.sf_dir)


@query(
    "feat_fraud",
    """select CARD_TXN_ID, cast(AMOUNT as double) as AMOUNT, CARD_TYPE, MERCHANT_CATEGORY,
      days_since_txn, IS_FRAUD
    from card_txn where AMOUNT is not null and CARD_TYPE is not null
      and MERCHANT_CATEGORY is not null and days_since_txn is not null and IS_FRAUD is not null""",
)
def feat_fraud(context: Context) -> DataFrame:
    return features.fraud_features(context.bank, AS_OF)


@query(
    "feat_default",
    """select LOAN_ID, ANNUAL_INCOME, CREDIT_SCORE, coalesce(tenure_days, 0) as tenure_days,
      cast(LOAN_AMOUNT as double) as LOAN_AMOUNT, cast(INTEREST_RATE as double) as INTEREST_RATE,
      ever_late, is_default
    from default_frame where ANNUAL_INCOME is not null and CREDIT_SCORE is not null
      and LOAN_AMOUNT is not null and INTEREST_RATE is not null""",
)
def feat_default(context: Context) -> DataFrame:
    return features.default_features(context.bank, AS_OF)


@query(
    "feat_late",
    """select LOAN_ID, CREDIT_SCORE, cast(LOAN_AMOUNT as double) as LOAN_AMOUNT,
      cast(INTEREST_RATE as double) as INTEREST_RATE, payments_made, late_ratio, ever_late
    from late_frame where CREDIT_SCORE is not null and LOAN_AMOUNT is not null
      and INTEREST_RATE is not null""",
)
def feat_late(context: Context) -> DataFrame:
    return features.late_features(context.bank, AS_OF)


@query("agg_class_check", """
  select count(distinct is_default) as n_classes, count(distinct is_default) >= 2 as trainable
  from default_frame""")
def agg_class_check(context: Context) -> DataFrame:
    return features.class_check(features.default_features(context.bank, AS_OF), DEFAULT.label)


@query(
    "ml_label_encode",
    """select CARD_TXN_ID,
      cast(dense_rank() over (order by CARD_TYPE) - 1 as int) as CARD_TYPE_code,
      cast(dense_rank() over (order by MERCHANT_CATEGORY) - 1 as int) as MERCHANT_CATEGORY_code
    from card_txn where CARD_TYPE is not null and MERCHANT_CATEGORY is not null""",
)
def ml_label_encode(context: Context) -> DataFrame:
    coded = training.label_encode(features.fraud_features(context.bank, AS_OF), FRAUD)
    codes = [c + "_code" for c in FRAUD.text_features]
    return coded.select("CARD_TXN_ID", *(F.col(c).cast("int").alias(c) for c in codes))


SAMPLE_SQL = f"""
  select CARD_TXN_ID, IS_FRAUD from (
    select CARD_TXN_ID, IS_FRAUD,
      row_number() over (partition by IS_FRAUD
        order by md5(concat_ws(':', cast(CARD_TXN_ID as varchar), '42'))) as place,
      count(*) over (partition by IS_FRAUD) as class_rows, count(*) over () as all_rows
    from card_txn where CARD_TYPE is not null) t
  where place <= case when all_rows <= {SAMPLE_CAP} then class_rows
    else cast(floor(cast({SAMPLE_CAP} as double) * class_rows / all_rows) as bigint) end"""


@query("ml_stratified_sample", SAMPLE_SQL)
def ml_stratified_sample(context: Context) -> DataFrame:
    frame = features.fraud_features(context.bank, AS_OF).select("CARD_TXN_ID", "IS_FRAUD")
    return sampling.stratified_sample(frame, "IS_FRAUD", sampling.draw_key(["CARD_TXN_ID"]), SAMPLE_CAP)


@query("union_strata", SAMPLE_SQL)
def union_strata(context: Context) -> DataFrame:
    """The same sample, drawn class by class and put together."""
    frame = features.fraud_features(context.bank, AS_OF).select("CARD_TXN_ID", "IS_FRAUD")
    drawn = sampling.stratified_sample(frame, "IS_FRAUD", sampling.draw_key(["CARD_TXN_ID"]), SAMPLE_CAP)
    return sampling.union_strata([drawn.filter(f"IS_FRAUD = {c}") for c in (0, 1)])


@query("ml_stratified_split", "select LOAN_ID, is_default, is_train from split_loans")
def ml_stratified_split(context: Context) -> DataFrame:
    frame = features.default_features(context.bank, AS_OF).select("LOAN_ID", "is_default")
    return sampling.stratified_split(frame, "is_default", sampling.draw_key(["LOAN_ID"]))


SCALED = ("CREDIT_SCORE", "LOAN_AMOUNT")


@query(
    "ml_standard_scale",
    "select LOAN_ID, is_train, "
    + ", ".join(
        f"round_even((cast({c} as double) - (select avg(cast({c} as double)) from split_loans"
        f" where is_train)) / (select stddev_pop(cast({c} as double)) from split_loans"
        f" where is_train), 6) + 0 as {c}_z"
        for c in SCALED
    )
    + " from split_loans",
)
def ml_standard_scale(context: Context) -> DataFrame:
    frame = features.default_features(context.bank, AS_OF)
    frame = frame.select("LOAN_ID", "is_default", *SCALED)
    split = sampling.stratified_split(frame, "is_default", sampling.draw_key(["LOAN_ID"]))
    scale = training.scaler(split.filter("is_train"), list(SCALED))
    return scale.transform(split).select(
        "LOAN_ID",
        "is_train",
        *((round_even(F.col(f"{c}_z"), 6) + F.lit(0)).alias(f"{c}_z") for c in SCALED),
    )


@query(
    "ml_balanced_weight",
    """select is_default, count(*) as class_rows, cast(sum(count(*)) over () as double)
      / (count(*) over () * count(*)) as weight from default_frame group by is_default""",
)
def ml_balanced_weight(context: Context) -> DataFrame:
    frame = features.default_features(context.bank, AS_OF)
    return features.balanced_weights(frame, DEFAULT.label)


# ---- fitting ----------------------------------------------------------------------------------


@query("ml_lr_fit")
def ml_lr_fit(context: Context) -> DataFrame:
    parts = [
        evaluation.coefficients(context.spark, fitted(context, t).logistic, t) for t in TASKS
    ]
    return reduce(DataFrame.unionByName, parts)


def _forest_scores(context: Context, task: features.Task) -> DataFrame:
    fit = fitted(context, task)
    return fit.scored(fit.forest)


@query("ml_rf_fraud")
def ml_rf_fraud(context: Context) -> DataFrame:
    return _forest_scores(context, FRAUD)


@query("ml_rf_default")
def ml_rf_default(context: Context) -> DataFrame:
    return _forest_scores(context, DEFAULT)


@query("ml_rf_late")
def ml_rf_late(context: Context) -> DataFrame:
    return _forest_scores(context, LATE)


@query("ml_predict")
def ml_predict(context: Context) -> DataFrame:
    """Class and probability of every test loan from both default models."""
    fit = fitted(context, DEFAULT)
    parts = [
        fit.scored(model).withColumn("model", F.lit(name)) for name, model in fit.models().items()
    ]
    return reduce(DataFrame.unionByName, parts)


# ---- evaluation -------------------------------------------------------------------------------


@query(
    "ml_confusion",
    """select label as actual, count(*) filter (where prediction = 0) as predicted_0,
      count(*) filter (where prediction = 1) as predicted_1 from model_scores group by label""",
)
def ml_confusion(context: Context) -> DataFrame:
    return evaluation.confusion_matrix(scores(context))


@query(
    "ml_class_report",
    """
    select class, round_even(precision, 4) as precision, round_even(recall, 4) as recall,
      round_even(f1, 4) as f1, support
    from (
      select '0' as class, p0 as precision, r0 as recall, f0 as f1, s0 as support from class_rates
      union all select '1', p1, r1, f1, s1 from class_rates
      union all select 'accuracy', acc, acc, acc, s0 + s1 from class_rates
      union all select 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 from class_rates
      union all select 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1),
        (r0 * s0 + r1 * s1) / (s0 + s1), (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 from class_rates) r""",
)
def ml_class_report(context: Context) -> DataFrame:
    return evaluation.class_report(scores(context))


@query(
    "ml_precision_recall",
    """select round_even(coalesce(cast(tp as double) / nullif(tp + fp, 0), 0), 4) as precision,
      round_even(coalesce(cast(tp as double) / nullif(tp + fn, 0), 0), 4) as recall
    from confusion_counts""",
)
def ml_precision_recall(context: Context) -> DataFrame:
    return evaluation.precision_recall(scores(context))


@query(
    "ml_auc",
    """select sum(cast(pos as double) * (2 * (all_neg - cum_neg) + neg))
      / (2 * (max(cast(all_pos as double) * all_neg))) as auc from score_points""",
)
def ml_auc(context: Context) -> DataFrame:
    return evaluation.auc(scores(context))


@query(
    "ml_roc_curve",
    """select score as threshold, cast(cum_neg as double) / all_neg as fpr,
      cast(cum_pos as double) / all_pos as tpr from score_points
    union all
    select cast(null as double), cast(0 as double), cast(0 as double)""",
)
def ml_roc_curve(context: Context) -> DataFrame:
    return evaluation.roc_curve(scores(context))


@query("ml_feature_importance")
def ml_feature_importance(context: Context) -> DataFrame:
    parts = [
        evaluation.feature_importance(context.spark, fitted(context, t).forest, t) for t in TASKS
    ]
    return reduce(DataFrame.unionByName, parts)


def all_scores(context: Context) -> DataFrame:
    """Test scores of all six models as (task, model, label, prediction, score)."""
    parts = [
        fit.scored(model).select(
            F.lit(task.name).alias("task"),
            F.lit(name).alias("model"),
            F.col(task.label).alias("label"),
            "prediction",
            "score",
        )
        for task in TASKS
        for fit in [fitted(context, task)]
        for name, model in fit.models().items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _summary(context: Context) -> DataFrame:
    return evaluation.written_summary(all_scores(context), ["task", "model"])


def given_summary(context: Context) -> DataFrame:
    """Summary of two models with given scores: the fixed score, and one that turns it round."""
    known = scores(context).withColumns({"task": F.lit("given"), "model": F.lit("as scored")})
    turned = known.withColumns(
        {"model": F.lit("turned"), "score": 1 - F.col("score"), "prediction": 1 - F.col("prediction")}
    )
    return evaluation.model_summary(known.unionByName(turned), ["task", "model"])


@query(
    "ml_model_summary",
    """
    select 'given' as task, model, round_even(auc, 4) as roc_auc,
      round_even(coalesce(cast(hit as double) / nullif(all_pos, 0), 0), 4) as recall,
      round_even(coalesce(cast(hit as double) / nullif(called, 0), 0), 4) as precision
    from (
      select 'as scored' as model, tp as hit, tp + fp as called, tp + fn as all_pos,
        (select auc from ml_auc) as auc from confusion_counts
      union all
      select 'turned', fn, tn + fn, tp + fn,
        (select sum(cast(pos as double) * (2 * (cum_neg - neg) + neg))
          / (2 * (max(cast(all_pos as double) * all_neg))) from score_points)
      from confusion_counts) m""",
)
def ml_model_summary(context: Context) -> DataFrame:
    """Given scores, so that SQL can check the figures; ``ml_fitted_summary`` has trained models."""
    return given_summary(context)


@query(
    "ml_best_model",
    """select task, model as best_model, roc_auc from ml_model_summary
      order by roc_auc desc, model limit 1""",
)
def ml_best_model(context: Context) -> DataFrame:
    """The better of the models with given scores; ``ml_fitted_best`` compares trained ones."""
    return evaluation.best_model(given_summary(context), "task")


@query("ml_fitted_summary")
def ml_fitted_summary(context: Context) -> DataFrame:
    return _summary(context)


@query("ml_fitted_best")
def ml_fitted_best(context: Context) -> DataFrame:
    return evaluation.best_model(_summary(context), "task")


@query("insight_models")
def insight_models(context: Context) -> DataFrame:
    """The sentence of every task: its best model and the strongest driver of its forest."""
    return insights.model_sentences(
        evaluation.best_model(_summary(context), "task"), ml_feature_importance(context)
    )


# ---- scoring ----------------------------------------------------------------------------------


def _active(context: Context) -> DataFrame:
    return scoring.score_active(context.bank, fitted(context, LATE).forest, AS_OF)


@query("ml_score_active")
def ml_score_active(context: Context) -> DataFrame:
    return _active(context)


def _given_active(context: Context) -> DataFrame:
    """Active loans with the fixed score in place of a trained one."""
    given = scores(context).select("LOAN_ID", F.col("score").alias("late_risk_score"))
    active = scoring.active_loans(context["loan"]).select("LOAN_ID", "CUSTOMER_ID")
    return active.join(given, "LOAN_ID")


GIVEN_ACTIVE_SQL = f"""
  select l.LOAN_ID, l.CUSTOMER_ID, s.score as late_risk_score
  from loan l join model_scores s on s.LOAN_ID = l.LOAN_ID where l.STATUS = '{ACTIVE_STATUS}'"""


@query("topk_risk_loans", f"{GIVEN_ACTIVE_SQL} order by s.score desc, l.LOAN_ID limit 10")
def topk_risk_loans(context: Context) -> DataFrame:
    """Given scores, so that SQL can check the rows; ``topk_fitted_loans`` has a trained model."""
    return scoring.riskiest_loans(_given_active(context))


@query(
    "ml_high_risk_share",
    f"""select count(*) filter (where late_risk_score > 0.5) as high_risk_loans,
      count(*) as active_loans, round_even(cast(count(*) filter (where late_risk_score > 0.5)
        as double) / count(*) * 100, 1) as high_risk_pct
    from ({GIVEN_ACTIVE_SQL}) a""",
)
def ml_high_risk_share(context: Context) -> DataFrame:
    """Given scores; ``ml_fitted_high_risk`` has a trained model."""
    return scoring.high_risk_share(_given_active(context))


@query("topk_fitted_loans")
def topk_fitted_loans(context: Context) -> DataFrame:
    return scoring.riskiest_loans(_active(context))


@query("ml_fitted_high_risk")
def ml_fitted_high_risk(context: Context) -> DataFrame:
    return scoring.high_risk_share(_active(context))


@query(
    "ml_score_active_rows",
    f"""select LOAN_ID, CUSTOMER_ID, true as is_probability from loan
      where STATUS = '{ACTIVE_STATUS}'""",
)
def ml_score_active_rows(context: Context) -> DataFrame:
    """What is determined of ``ml_score_active``: which loans are scored, each with a probability."""
    return _active(context).select(
        "LOAN_ID", "CUSTOMER_ID", F.col("late_risk_score").between(0, 1).alias("is_probability")
    )


@query(
    "ml_predict_rows",
    """select m.model, is_default, count(*) as n_rows, count(*) as n_probabilities,
      count(*) as n_larger_class
    from split_loans cross join (values ('Logistic Regression'), ('Random Forest')) m(model)
    where not is_train group by m.model, is_default""",
)
def ml_predict_rows(context: Context) -> DataFrame:
    """What is determined of ``ml_predict``: test loans per class, each with its larger class."""
    score = F.col("score")
    agrees = (score == 0.5) | ((score > 0.5) == (F.col("prediction") == 1))
    return ml_predict(context).groupBy("model", "is_default").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(score.between(0, 1)).alias("n_probabilities"),
        F.count_if(agrees).alias("n_larger_class"),
    )


@query("ml_save_load")
def ml_save_load(context: Context) -> DataFrame:
    """Test scores of every task from models that were saved, one folder per task, and reloaded."""
    folder = new_folder(context.spark, "models")
    parts = []
    for task in TASKS:
        fit = fitted(context, task)
        training.save(fit.forest, f"{folder}/{task.name}")
        reloaded = training.load(f"{folder}/{task.name}")
        scored = training.predict(reloaded, fit.test(), task.key)
        parts.append(
            scored.select(
                F.lit(task.name).alias("task"), F.col(task.key).alias("id"), "prediction", "score"
            )
        )
    return reduce(DataFrame.unionByName, parts)
