"""Queries over the trained model: split, training, calibration, evaluation."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from farelens.operators import cleaning, evaluation, modelling
from farelens.operators.features import BASE_FEATURES
from farelens.operators.pricing import recommend_batch
from farelens.operators.tree_sweep import score_trees
from farelens.plans.data import KEY, Data
from farelens.plans.pricing_queries import flat_recommendation
from farelens.plans.registry import query, rounded
from farelens.session import cut_lineage, scratch_path, stored
from farelens.sources import predictions

TEST_SIZE, SEED = 0.2, 42

_ROW_TEXT = (
    "concat_ws('-', order_id, copy_no, line_no, driver_id, part_id, CAST(round(ext * 100) AS BIGINT))"
)
_DIGEST = f"md5(concat_ws('|', {_ROW_TEXT}, '{SEED}'))"


def _row_key(prefix: str = ""):
    parts = [F.col(prefix + c) for c in KEY[:-1]]
    cents = F.round(F.col(f"{prefix}ext") * 100).cast("bigint")
    return F.concat_ws("-", *[p.cast("string") for p in parts], cents.cast("string"))


_SPLIT_SQL = f"""SELECT *, row_number() OVER (PARTITION BY is_done ORDER BY {_DIGEST})
 <= ceil({TEST_SIZE} * count(*) OVER (PARTITION BY is_done)) AS is_test FROM bids"""


@query(
    "stratified_split",
    f"SELECT order_id, copy_no, line_no, driver_id, part_id, ext, is_test FROM ({_SPLIT_SQL} ) halves",
)
def _stratified_split(d: Data) -> DataFrame:
    halves = evaluation.stratified_split(d.kept_bids, "is_done", _row_key(), TEST_SIZE, SEED)
    return halves.select(*KEY, "is_test")


@query(
    "pos_weight",
    f"""SELECT round(count(*) FILTER (WHERE is_done <> 'done') / CAST(count(*) FILTER (WHERE is_done = 'done') AS DOUBLE), 6) AS pos_weight
FROM ({_SPLIT_SQL} ) halves WHERE NOT is_test""",
)
def _pos_weight(d: Data) -> DataFrame:
    halves = evaluation.stratified_split(d.kept_bids, "is_done", _row_key(), TEST_SIZE, SEED)
    train = halves.filter(~F.col("is_test")).withColumn("label", cleaning.label_binary())
    return rounded(cleaning.pos_weight(train))


@query(
    "roc_auc",
    """SELECT round((sum(avg_rank) FILTER (WHERE label = 1) - p * (p + 1) / 2) / (p * (count(*) - p)), 6) AS roc_auc
FROM (SELECT label, rank() OVER (ORDER BY probability) + (count(*) OVER (PARTITION BY probability) - 1) / 2e0 AS avg_rank,
 CAST(sum(label) OVER () AS DOUBLE) AS p FROM score_rows ) ranked GROUP BY p""",
)
def _roc_auc(d: Data) -> DataFrame:
    return rounded(evaluation.ranking_areas(d.scored_bids).select("roc_auc"))


@query(
    "pr_auc",
    """SELECT round(sum((tp - tp_before) / total * (precision + coalesce(precision_before, 1e0)) / 2), 6) AS pr_auc
FROM (SELECT *, coalesce(lag(tp) OVER w, 0) AS tp_before, lag(precision) OVER w AS precision_before FROM (
  SELECT probability, tp, tp / CAST(seen AS DOUBLE) AS precision, total FROM (
   SELECT probability, sum(pos) OVER (ORDER BY probability DESC) AS tp, sum(n) OVER (ORDER BY probability DESC) AS seen,
    CAST(sum(pos) OVER () AS DOUBLE) AS total
   FROM (SELECT probability, sum(label) AS pos, count(*) AS n FROM score_rows GROUP BY probability) per_score) summed) points
 WINDOW w AS (ORDER BY probability DESC)) segments""",
)
def _pr_auc(d: Data) -> DataFrame:
    return rounded(evaluation.ranking_areas(d.scored_bids).select("pr_auc"))


# -- the trained model ------------------------------------------------------

_FITTED: dict[tuple[str, str], tuple[PipelineModel, DataFrame]] = {}


def fitted(d: Data) -> tuple[PipelineModel, DataFrame]:
    """The calibrated model of a data folder and its split feature table.

    Kept for the session, because eight queries look at the same model.
    """
    at = (d.spark.sparkContext.applicationId, d.folder)
    if at not in _FITTED:
        table = modelling.feature_table(d.features, BASE_FEATURES)
        split = evaluation.stratified_split(table, "label", _row_key("k_"), TEST_SIZE, SEED)
        halves = cut_lineage(
            split.select("k_order_id", "k_copy_no", "label", "is_test", *BASE_FEATURES)
        )
        train = halves.filter(~F.col("is_test"))
        trees = modelling.train_classifier(train)
        _FITTED[at] = modelling.calibrate_sigmoid(trees, train), halves
    return _FITTED[at]


@query("train_classifier")
def _train_classifier(d: Data) -> DataFrame:
    """Areas of the uncalibrated trees on the train and the test part."""
    model, halves = fitted(d)
    return _areas(modelling.tree_probability(model, halves))


@query("calibrate_sigmoid")
def _calibrate_sigmoid(d: Data) -> DataFrame:
    """Areas, mean probability and share of accepted bids after calibration."""
    model, halves = fitted(d)
    return _areas(modelling.predict_proba(model, halves))


def _areas(scored: DataFrame) -> DataFrame:
    """Both parts' areas and means; each row goes through the trees once."""
    scored = stored(scored.select("is_test", "label", "probability"), "scored")
    parts = []
    for name, part in (("train", ~F.col("is_test")), ("test", F.col("is_test"))):
        rows = scored.filter(part)
        means = rows.agg(
            F.avg("label").alias("share_done"), F.avg("probability").alias("mean_probability")
        )
        packed = means.select(F.struct("*").alias("_m")).scalar()
        areas = evaluation.ranking_areas(rows)
        parts.append(
            areas.select(
                F.lit(name).alias("part"), "*", *[packed[c].alias(c) for c in means.columns]
            )
        )
    return parts[0].unionByName(parts[1])


@query("predict_proba")
def _predict_proba(d: Data) -> DataFrame:
    model, halves = fitted(d)
    return modelling.predict_proba(model, halves).select(
        "k_order_id", "k_copy_no", "is_test", "label", "probability"
    )


@query("feature_importance")
def _feature_importance(d: Data) -> DataFrame:
    model, halves = fitted(d)
    return modelling.feature_importance(model, halves)


@query("importance_top10")
def _importance_top10(d: Data) -> DataFrame:
    model, halves = fitted(d)
    return modelling.importance_top(modelling.feature_importance(model, halves))


@query("sink_model")
def _sink_model(d: Data) -> DataFrame:
    """Predictions of the stored and reloaded model against the one in memory."""
    model, halves = fitted(d)
    path = scratch_path(d.spark, "model")
    predictions.sink_model(model, path)
    again = predictions.source_model(path, BASE_FEATURES)
    own = modelling.predict_proba(model, halves).withColumnRenamed("probability", "in_memory")
    both = modelling.predict_proba(again, own)
    return both.groupBy("is_test").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.abs(F.col("in_memory") - F.col("probability")) > 1e-12).alias("n_different"),
    )


@query("source_model")
def _source_model(d: Data) -> DataFrame:
    model, halves = fitted(d)
    path = scratch_path(d.spark, "model")
    predictions.sink_model(model, path)
    again = predictions.source_model(path)
    return modelling.predict_proba(again, halves).select("k_order_id", "label", "probability")


@query("sink_feature_names")
def _sink_feature_names(d: Data) -> DataFrame:
    """Stored feature names in order, with each one's mean over the table."""
    model, halves = fitted(d)
    path = scratch_path(d.spark, "model")
    predictions.sink_model(model, path)
    names = modelling.feature_names(predictions.source_model(path, BASE_FEATURES))
    means = halves.agg(*[F.avg(c).alias(c) for c in names])
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(c).alias("mean"))
        for i, c in enumerate(names)
    ]
    return means.select(F.inline(F.array(*rows)))


@query("score_fn")
def _score_fn(d: Data) -> DataFrame:
    """Recommendations with the trained model as the scorer."""
    model, _ = fitted(d)
    return flat_recommendation(recommend_batch(d.prepared, score_trees(d.spark, model)))
