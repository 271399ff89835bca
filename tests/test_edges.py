"""Small golden frames for the missing-value, tie and boundary rules."""

import math

from pyspark.sql import functions as F

from farelens.functions import clock, display, fare
from farelens.functions.missing import clip, finite_or_null, flag, larger_of
from farelens.operators import cleaning, history, orders, pricing, quality, quotes, statistics
from farelens.operators.features import row_features
from farelens.operators.scoring import Scorer
from farelens.schema import BID_FIELDS
from farelens.sources import orders as order_source

BID_DDL = "row_id long, " + ", ".join(f"{k} {v}" for k, v in BID_FIELDS.items())


def bids(spark, *changes):
    """One ordinary bid per given change."""
    plain = {
        "order_id": 1, "user_id": 10, "driver_id": 20,
        "order_timestamp": "2020-05-01 14:30:00", "tender_timestamp": "2020-05-01 14:30:20",
        "driver_reg_date": "2020-01-15 00:00:00", "distance_in_meters": 3404,
        "duration_in_seconds": 486, "pickup_in_meters": 790, "pickup_in_seconds": 169,
        "driver_rating": 5.0, "carname": "LADA", "carmodel": "GRANTA", "platform": "android",
        "price_start_local": 180.0, "price_bid_local": 200.0, "is_done": "done",
    }
    rows = [{"row_id": i, **plain, **c} for i, c in enumerate(changes)]
    names = ["row_id", *BID_FIELDS]
    texts = ", ".join(
        f"{c} {'string' if t == 'timestamp' else t}" for c, t in BID_FIELDS.items()
    )
    df = spark.createDataFrame([[r[n] for n in names] for r in rows], f"row_id long, {texts}")
    return cleaning.parse_times(df)


def test_zero_start_price(spark):
    df = bids(spark, {"price_start_local": 0.0}, {"price_start_local": 0.0, "price_bid_local": 0.0})
    measured = [r[0] for r in cleaning.with_measures(df).orderBy("row_id").select("price_increase_pct").collect()]
    assert measured[0] == math.inf and measured[1] is None
    made = row_features(df).orderBy("row_id").select("price_increase_pct", "is_price_increased", "price_inc_x_night").collect()
    assert [tuple(r) for r in made] == [(None, 1.0, None), (None, 0.0, None)]


def test_unreadable_times_and_missing_rating(spark):
    df = bids(spark, {"order_timestamp": "never", "driver_rating": None})
    row = row_features(df).first()
    assert row["order_timestamp"] is None
    assert (row["is_night"], row["day_of_month"], row["driver_experience_days"]) == (1.0, 15, 365.0)
    assert row["response_time_seconds"] == 30.0
    assert row["rating_deviation"] is None and row["has_perfect_rating"] == 0.0
    marks = cleaning.anomaly_flags(df).first()
    assert marks["future_bid"] is False and marks["slow_response"] is False


def test_zero_durations(spark):
    df = bids(spark, {"duration_in_seconds": 0, "pickup_in_seconds": 0})
    measured = cleaning.with_measures(df).first()
    assert measured["avg_speed_kmh"] is None and measured["pickup_speed_kmh"] is None
    q = quality.with_quality(df).first()
    assert q["flag_zero_duration"] == 1.0 and q["flag_too_fast_city"] == 1.0
    assert q["data_quality_index"] == 1 / (1 + q["total_flags"])


def test_duplicates_keep_first_and_nulls_match(spark):
    df = bids(
        spark,
        {"is_done": "cancel", "tender_timestamp": None},
        {"is_done": "done", "tender_timestamp": None},
        {"driver_id": 21},
    )
    kept = cleaning.dedupe_first(df, ["row_id"]).select("row_id", "is_done")
    assert sorted(map(tuple, kept.collect())) == [(0, "cancel"), (2, "done")]
    summary = cleaning.clean_summary(df, ["row_id"]).first()
    assert (summary["initial"], summary["removed"], summary["kept"]) == (3, 1, 2)


def test_history_guard_and_missing_keys(spark):
    same = bids(spark, {}, {"user_id": 11})
    assert history.build_history(same, history.USER).count() == 0
    assert history.build_history(same.drop("is_done"), history.USER).count() == 0
    mixed = bids(spark, {}, {"is_done": "cancel"}, {"user_id": None})
    rows = history.build_history(mixed, history.USER).collect()
    assert len(rows) == 1 and rows[0]["user_order_count"] == 2
    assert rows[0]["user_acceptance_rate"] == 0.5
    joined = history.join_history(mixed, history.build_history(mixed, history.USER), history.USER)
    nameless = joined.filter("user_id IS NULL").first()
    assert nameless["user_order_count"] == 1.0 and nameless["user_avg_bid"] == 200.0


def test_lookup_without_tables_uses_constants(spark):
    users = history.empty_history(spark.range(0), history.USER)
    found = history.lookup_history(bids(spark, {}), users, history.USER).first()
    assert found["user_order_count"] == 10.0 and found["user_acceptance_rate"] == 0.41


def test_car_classes(spark):
    cars = [
        ("LADA", "GRANTA", "comfort"), ("LADA", "Granta", "economy"), (" Toyota ", "x", "business"),
        ("VW", "Passat CC", "business"), ("Daewoo", "Camry", "economy"), (None, None, "comfort"),
        ("LADA", "Vesta", "comfort"),
    ]
    df = spark.createDataFrame(cars, "brand string, model string, expected string")
    kind = fare.taxi_type(F.col("brand"), F.col("model"))
    assert df.filter(kind != F.col("expected")).count() == 0


def test_missing_value_rules(spark):
    df = spark.createDataFrame([(None, 1.0), (3.0, 2.0), (float("nan"), 0.0), (float("inf"), 9.0)], "a double, b double")
    out = df.select(clip(F.col("a"), 0, 2), larger_of(F.col("a"), F.col("b")), flag(F.col("a") > 1), finite_or_null(F.col("a"))).collect()
    assert tuple(out[0]) == (None, None, 0.0, None)
    assert tuple(out[1]) == (2.0, 3.0, 1.0, 3.0)
    assert out[2][3] is None and out[3][3] is None


def test_tenure_rounds_down(spark):
    df = spark.sql("SELECT TIMESTAMP '2020-01-02 00:00:00' a, TIMESTAMP '2020-01-01 23:00:00' b")
    assert df.select(clock.whole_days(F.col("a"), F.col("b"))).first()[0] == -1.0


def test_one_row_table_is_not_clipped(spark):
    df = spark.createDataFrame([(5.0, None)], "x double, y double")
    stats = statistics.fit_statistics(df, ["x", "y"])
    assert stats["x"].low is None
    assert tuple(statistics.clip_sigma(statistics.impute(df, stats), stats).first()) == (5.0, 0.0)


def request(spark, start=180.0, metres=3404, seconds=486):
    return spark.createDataFrame(
        [(1, start, metres, seconds)],
        "order_id long, price_start_local double, distance_in_meters long, duration_in_seconds long",
    )


def constant(p):
    return Scorer((), lambda points: points.withColumn("probability", F.lit(float(p))))


def test_zone_boundaries(spark):
    df = spark.createDataFrame([(0.7,), (0.5,), (0.3,), (1.0,), (0.0,)], "p double")
    assert [r[0] for r in df.select(pricing.zone_of(F.col("p"))).collect()] == [3, 2, 4, None, 1]


def test_certain_acceptance_has_no_zone_but_is_green(spark):
    r = pricing.recommend_batch(request(spark), constant(1.0)).first()
    assert r["zones"] == [] and r["optimal_price"]["zone_id"] == 3
    axis = quotes.with_axis(pricing.recommend_batch(request(spark), constant(1.0))).first()
    assert axis["axis_min"] == 180.0 and axis["axis_max"] > axis["axis_min"]


def test_hopeless_scan_ends_at_twice_the_reference(spark):
    r = pricing.with_scan_limit(request(spark), constant(0.01)).first()
    assert r["scan_max"] == 2 * r["reference_price"]
    best = pricing.recommend_batch(request(spark), constant(0.0)).first()["optimal_price"]
    assert best["zone_id"] == 1 and best["price"] >= 180.0 and best["expected_value"] == 0.0


def test_start_above_scan_keeps_all_prices(spark):
    fading = Scorer((), lambda p: p.withColumn("probability", F.when(F.col("price") < 300, 0.5).otherwise(0.0)))
    s = pricing.sweep(request(spark, start=900.0), fading).first()
    assert s["scan_max"] < 900 and s["optimal_price"] <= s["scan_max"]


def test_equal_scores_take_the_lowest_price(spark):
    flat_score = Scorer((), lambda p: p.withColumn("probability", F.lit(10.0) / F.col("price")))
    s = pricing.sweep(request(spark, start=100.0), flat_score).first()
    assert abs(s["max_probability_price"] - s["search_min"]) < 2 or s["max_probability_price"] >= 100
    same = pricing.sweep(request(spark, start=0.0), constant(0.4)).first()
    assert same["max_probability_price"] == 0.0


def test_order_checks(spark):
    ddl = "order_id long, order_timestamp long, distance_in_meters long, duration_in_seconds long, pickup_in_meters long, pickup_in_seconds long, driver_rating double, platform string, price_start_local double"
    df = spark.createDataFrame(
        [(1, 5, 1, 1, 1, 1, 5.0, "web", 1.0), (2, 0, -1, 1, 1, 1, 5.5, "fax", None)], ddl
    )
    good, bad = orders.validate_orders(df)
    assert [r["order_id"] for r in good.collect()] == [1]
    assert set(bad.first()["errors"]) == {
        "order_timestamp", "distance_in_meters", "driver_rating", "platform", "price_start_local"
    }
    filled = orders.order_defaults(df).first()
    assert (filled["carname"], filled["carmodel"]) == ("Renault", "Logan")
    assert filled["driver_reg_date"] == "2020-01-01"


def test_display_rules(spark):
    df = spark.createDataFrame([(0.0, 3000.0), (None, None), (90.0, 1.0)], "s double, m double")
    assert [r[0] for r in df.select(display.eta_minutes(F.col("s"), F.col("m"), 25)).collect()] == [6, 25, 2]
    one = spark.range(1)
    snap = display.snap_to_step(F.lit(132.5), F.lit(5.0), F.lit(0.0), F.lit(134.0))
    assert one.select(snap).first()[0] == 134.0


def test_recommendations_are_written_packed(spark, monkeypatch, tmp_path):
    """Packed files of few records, one reader each; what is read again is what was written."""
    monkeypatch.setattr(order_source, "RECORDS_OF_FILE", 2, raising=False)
    rows = spark.range(5).coalesce(1).selectExpr("id AS order_id", "'Приора' AS name", "array(id, NULL) AS zones")
    order_source.sink_recommendation_json(rows, str(tmp_path / "out"))
    assert len(list(tmp_path.glob("out/*.json.gz"))) == 3
    again = spark.read.schema(rows.schema).json(str(tmp_path / "out"))
    assert again.exceptAll(rows).count() == 0 and again.count() == 5
