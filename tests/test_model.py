"""The trained model ranks better than chance, is calibrated, and survives storage."""

import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from __spark_entry__ import queries
from farelens.operators import modelling, orders
from farelens.operators.features import BASE_FEATURES
from farelens.operators.pricing import recommendation, sweep
from farelens.operators.scoring import score_model
from farelens.plans import model_queries
from farelens.plans.data import Data
from farelens.plans.pricing_queries import flat_recommendation

QUERIES = queries()


def test_calibrated_model(spark):
    parts = {r["part"]: r for r in QUERIES["calibrate_sigmoid"](spark, FOLDER).collect()}
    assert parts["test"]["roc_auc"] > 0.6 and parts["test"]["pr_auc"] > parts["test"]["share_done"]
    train = parts["train"]
    assert train["mean_probability"] == pytest.approx(train["share_done"], abs=0.01)


def test_stored_model_predicts_the_same(spark):
    rows = QUERIES["sink_model"](spark, FOLDER).collect()
    assert sum(r["n_rows"] for r in rows) > 6000 and all(r["n_different"] == 0 for r in rows)


def test_feature_names_and_importance(spark):
    names = QUERIES["sink_feature_names"](spark, FOLDER).orderBy("position").collect()
    assert tuple(r["feature"] for r in names) == BASE_FEATURES
    weights = QUERIES["feature_importance"](spark, FOLDER).collect()
    assert sum(r["importance"] for r in weights) == pytest.approx(1.0)
    assert QUERIES["importance_top10"](spark, FOLDER).count() == 10


def test_too_few_rows(spark):
    with pytest.raises(ValueError):
        orders.require_rows(spark.range(99))
    assert orders.require_rows(spark.range(100)).count() == 100


def test_registered_model_has_all_trees(spark):
    model, _ = model_queries.fitted(Data(spark, FOLDER))
    trees, settings = model.stages[1], modelling.TreeSettings()
    assert trees.getNumTrees == settings.iterations == 200
    assert trees.getStepSize() == settings.rate == 0.05 and trees.getMaxDepth() == settings.depth


def test_model_sweep_uses_the_whole_grid(spark, monkeypatch):
    d = Data(spark, FOLDER)
    table = modelling.feature_table(d.features.select("label", *BASE_FEATURES), BASE_FEATURES)
    settings = modelling.TreeSettings(iterations=1, depth=2)
    model = modelling.calibrate_sigmoid(modelling.train_classifier(table, settings=settings), table)
    monkeypatch.setattr(model_queries, "fitted", lambda _: (model, table))
    swept = sweep(d.prepared, score_model(model), coarse=150, fine=500)
    expected = flat_recommendation(recommendation(swept))
    got = QUERIES["score_fn"](spark, FOLDER)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)


def test_trees_score_the_calibration_rows_once(spark):
    """One pass counts the classes, one scores the rows; the regression's own passes read the scores."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(label):
        seen.add(1)
        return label

    n = F.col("id")
    rows = spark.range(400).select((n % 7 % 2).cast("double").alias("label"), (n % 13).cast("double").alias("x"))
    settings = modelling.TreeSettings(iterations=2, depth=2)
    trees = modelling.train_classifier(rows, features=("x",), settings=settings)
    model = modelling.calibrate_sigmoid(trees, rows.withColumn("label", counted.asNondeterministic()("label")))
    assert seen.value == 2 * 400
    plain = modelling.calibrate_sigmoid(trees, rows)
    assert model.stages[-1].intercept == plain.stages[-1].intercept
