"""Distributed forms against brute force on skewed fixtures, and plan checks."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from farelens.operators import (
    cleaning,
    evaluation,
    features,
    history,
    joins,
    modelling,
    pricing,
    statistics,
)
from farelens.operators.scoring import score_logistic, score_model
from farelens.plans.data import Data
from farelens.plans.registry import quick_round
from farelens.session import scratch_path
from farelens.sources import bids
from farelens.sources.bids import bids_view

NAMES = ("price_increase_pct", "distance_km", "driver_acceptance_rate", "is_peak_hour")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows under one key, some without a key, the rest spread."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, None).otherwise(F.col("id") % 5000)
    return spark.range(60_000).withColumn("k", key.cast("bigint")).cache()


def test_hot_key_join_equals_plain_join(spark, skewed):
    table = (
        spark.range(4000).filter("id <> 11").select(F.col("id").alias("k"), (F.col("id") * 2.0).alias("v"))
    )
    plain = skewed.join(table, "k", "left").select("id", "k", "v")
    split = joins.left_lookup(skewed, table, "k", small=False).select("id", "k", "v")
    assert split.count() == 60_000
    assert split.exceptAll(plain).count() == 0 and plain.exceptAll(split).count() == 0


def test_hot_key_join_with_known_weights(spark, skewed):
    table = skewed.filter("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
    split = joins.left_lookup(skewed, table, "k", weight=F.col("n"), small=False)
    plain = skewed.join(table, "k", "left")
    assert split.select("id", "n").exceptAll(plain.select("id", "n")).count() == 0


def test_hot_rows_do_not_meet_in_one_partition(spark, skewed):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.range(5000).select(F.col("id").alias("k"), F.col("id").alias("v"))
        big = table.hint("merge")
        split = joins.left_lookup(skewed, big, "k", small=False)
        sizes = [r["count"] for r in split.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(sizes) < 60_000 / 4


@pytest.mark.parametrize("p", [0.25, 0.5, 0.77])
def test_quantiles_by_narrowing(spark, p):
    rng = np.random.default_rng(3)
    values = rng.normal(size=30_000)
    tied = np.where(rng.random(30_000) < 0.6, 1.5, np.round(values, 2))
    df = spark.createDataFrame(
        [(float(a), float(b), None) for a, b in zip(values, tied)], "a double, b double, c double"
    ).repartition(8)
    found = statistics.exact_quantiles(df, {c: (c, p) for c in "abc"}, exact_rows=200)
    assert found["a"] == pytest.approx(np.quantile(values, p), abs=1e-12)
    assert found["b"] == pytest.approx(np.quantile(tied, p), abs=1e-12)
    assert found["c"] is None


def test_quantile_by_counts(spark):
    values = [float(v) for v in range(100)] + [5.0] * 51
    df = spark.createDataFrame([(v,) for v in values], "v double")
    place = (len(values) - 1) * 0.3
    assert statistics._quantile_by_counts(df, place) == pytest.approx(np.quantile(values, 0.3))


def test_running_totals_by_range(spark):
    df = spark.range(5000).select((F.col("id") * 0.5).alias("s"), (F.col("id") % 7).alias("n"))
    got = statistics.running_totals(df, "s", ["n"], rows_per_range=300).orderBy("s")
    before = [r["n_before"] for r in got.select("n_before").collect()]
    n = np.arange(5000) % 7
    assert before == list(np.cumsum(n) - n)


def test_ranking_areas_do_not_depend_on_ranges(spark):
    rows = [(float(round(x, 3)), int(x + e > 0.9)) for x, e in np.random.default_rng(5).random((3000, 2))]
    df = spark.createDataFrame(rows, "probability double, label int")
    one = evaluation.ranking_areas(df).first()
    many = evaluation.ranking_areas(df, rows_per_range=50).first()
    score, label = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    diff = score[label == 1][:, None] - score[label == 0][None, :]
    brute = ((diff > 0) + 0.5 * (diff == 0)).mean()
    assert one["roc_auc"] == pytest.approx(brute) and many["roc_auc"] == pytest.approx(brute)
    assert one["pr_auc"] == pytest.approx(many["pr_auc"])


def test_split_narrows_by_prefix(spark, monkeypatch):
    df = spark.range(20_000).withColumn("label", (F.col("id") % 3 == 0).cast("int"))
    key = F.col("id").cast("string")
    whole = evaluation.stratified_split(df, "label", key).filter("is_test")
    monkeypatch.setattr(evaluation, "_ORDERED_ROWS", 1)
    narrowed = evaluation.stratified_split(df, "label", key).filter("is_test")
    assert whole.exceptAll(narrowed).count() == 0 and narrowed.count() == whole.count()
    counts = {r["label"]: r["count"] for r in whole.groupBy("label").count().collect()}
    assert counts == {0: 2667, 1: 1334}


def test_statistics_after_filling(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=2000)
    holes = rng.random(2000) < 0.2
    df = spark.createDataFrame([(None if h else float(v),) for v, h in zip(x, holes)], "x double")
    s = statistics.fit_statistics(df, ["x"])["x"]
    median = np.median(x[~holes])
    filled = np.where(holes, median, x)
    assert s.fill == pytest.approx(median)
    assert s.high == pytest.approx(filled.mean() + 10 * filled.std(ddof=1))


def test_moments_make_no_row_per_value(spark, monkeypatch):
    """Values are folded where they are; gaps, infinite values, a large offset and a column without spread."""
    rng = np.random.default_rng(5)
    x = 1e9 + rng.normal(size=3000)
    odd = {0: None, 1: float("nan"), 2: float("inf"), 3: float("-inf")}
    rows = [(odd.get(i % 10, float(v)), 0.1, None, i) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "x double, same double, empty double, whole long").repartition(7)
    monkeypatch.setattr(statistics.F, "posexplode", None)
    n, found = statistics.column_moments(df, df.columns)
    kept = x[np.arange(3000) % 10 > 3]
    assert n == 3000 and found["x"].n == kept.size
    assert found["x"].mean == pytest.approx(kept.mean(), rel=1e-14)
    assert found["x"].squares == pytest.approx(((kept - kept.mean()) ** 2).sum(), rel=1e-6)
    assert (found["same"].n, found["same"].mean, found["same"].squares) == (3000, 0.1, 0.0)
    assert found["empty"].n == 0 and found["whole"].mean == pytest.approx(1499.5)
    assert statistics.column_moments(df.limit(0), ["x"])[0] == 0


def test_quick_round_is_round(spark):
    """The same bits, near the middle of two steps, beyond what arithmetic is exact for, and for odd values."""
    rng = np.random.default_rng(6)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, -1e-5, 5e-5, -5e-5, 1.00005, 99999.99995, 1e5, 1e15, -1e308]
    middles = [float(k + 0.5) / 1e4 for k in range(-3000, 3000)]
    free = rng.uniform(-2e5, 2e5, 3000).tolist() + [round(v, 5) for v in rng.uniform(-9, 9, 3000).tolist()]
    df = spark.createDataFrame([(v,) for v in odd + middles + free], "x double")
    for digits in (4, 6):
        both = df.select(F.round("x", digits).alias("a"), quick_round(F.col("x"), digits).alias("b"))
        bits = [np.array([np.nan if v is None else v for v in c]).tobytes() for c in zip(*both.collect())]
        assert bits[0] == bits[1]
        assert both.filter("a IS NULL").count() == both.filter("b IS NULL").count() == 1


def test_dedupe_limits_groups_before_the_exchange(spark):
    df = cleaning.dedupe_first(bids_view(spark, FOLDER), ["copy_no", "line_no", "part_id", "ext"])
    plan = plan_of(df)
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


def test_sweep_places_orders_once(spark):
    path = scratch_path(spark, "prepared")
    Data(spark, FOLDER).prepared.write.parquet(path)
    plan = plan_of(pricing.sweep(spark.read.parquet(path), score_logistic()))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SortAggregate" not in plan


def test_model_sweep_places_orders_once(spark):
    path = scratch_path(spark, "prepared")
    d = Data(spark, FOLDER)
    d.prepared.write.parquet(path)
    label = F.when(F.col("is_done") == "done", 1.0).otherwise(0.0)
    wide = features.row_features(d.joined.withColumn("label", label))
    table = modelling.feature_table(wide.select("label", *NAMES), NAMES)
    one_tree = modelling.TreeSettings(iterations=1, depth=2)
    model = modelling.calibrate_sigmoid(
        modelling.train_classifier(table, NAMES, settings=one_tree), table
    )
    plan = plan_of(pricing.sweep(spark.read.parquet(path), score_model(model)))
    assert plan.count("Exchange hashpartitioning") == 1


def test_scan_reads_only_needed_columns(spark):
    plan = plan_of(bids_view(spark, FOLDER).select("order_id", "is_done"))
    schema = [line for line in plan.splitlines() if "lineitem" in line][0]
    assert "l_extendedprice" not in schema and "l_shipdate" not in schema


def test_history_is_a_partial_aggregate(spark):
    plan = plan_of(history.build_history(bids_view(spark, FOLDER), history.DRIVER))
    assert "partial_count" in plan and "partial_avg" in plan


def same_rows(a, b):
    b = b.select(a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_bids_that_are_read_again_join_nothing(spark):
    d = Data(spark, FOLDER)
    assert same_rows(d.kept_bids, d.bids)
    plan = plan_of(d.kept_bids)
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Exchange" not in plan


def test_lines_are_looked_up_before_they_widen(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(joins, "HOT_SHARE", 20)
    d = Data(spark, FOLDER)
    plain = history.join_history(history.join_history(d.bids, d.users, history.USER, True), d.drivers, history.DRIVER, True)
    assert same_rows(d.joined, plain)
    plan = d.joined._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join") :]
    assert "taxi" not in below and "carname" not in below and "platform" not in below


def test_quantiles_read_stored_scores(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        calls.add(1)
        return float(x)

    df = spark.range(2000).select(counted("id").alias("probability"))
    assert statistics.prob_quantiles(df).first()["median"] == 999.5
    assert calls.value == 2000


def test_splits_without_rows_leave_no_core_idle(spark, tmp_path):
    """A file of two row groups in more splits than cores: most splits begin inside a group and are empty."""
    table = pa.table({"order_id": range(20_000), "line_no": [1] * 20_000, "noise": [f"{i * i:x}" for i in range(20_000)]})
    pq.write_table(table, tmp_path / "lines.parquet", row_group_size=10_000)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        lines = spark.read.parquet(str(tmp_path / "lines.parquet"))
        cores, splits = spark.sparkContext.defaultParallelism, lines.rdd.getNumPartitions()
        assert splits >= cores
        dealt = bids.spread_if_few(lines, "order_id", "line_no")
        held = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert len(held) == splits and sum(held) == 20_000
        assert dealt.agg(F.countDistinct("order_id")).first()[0] == 20_000
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    even = spark.range(0, 20_000, 1, 8).withColumnRenamed("id", "order_id")
    assert bids.spread_if_few(even, "order_id") is even
    none = even.filter("order_id < 0")
    assert bids.spread_if_few(none, "order_id") is none
