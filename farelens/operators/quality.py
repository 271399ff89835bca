"""Data-quality columns: 17 flags, 8 scores, index and categories."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from farelens.functions.clock import seconds_between
from farelens.functions.missing import clip, flag, larger_of, num, ratio
from farelens.operators import cleaning as c

FLAGS = (
    "flag_future_driver", "flag_future_bid", "flag_slow_response",
    "flag_zero_distance", "flag_zero_duration", "flag_zero_price",
    "flag_too_short_trip", "flag_too_quick_trip",
    "flag_extreme_distance", "flag_extreme_duration",
    "flag_too_fast_city", "flag_physically_impossible", "flag_too_slow",
    "flag_extreme_pickup_ratio", "flag_extreme_pickup_speed",
    "flag_extreme_markup", "flag_extreme_price",
)
SCORES = (
    "response_time_score", "zero_values_count", "short_trip_score", "distance_extremity",
    "duration_extremity", "speed_anomaly_score", "pickup_anomaly_score", "price_anomaly_score",
)
INDEX = (
    "total_flags", "data_quality_index", "is_high_quality", "is_suspicious", "is_low_quality",
)
QUALITY_COLUMNS = (*FLAGS, *SCORES, *INDEX)


def _filled(value: Column, default: float) -> Column:
    return F.coalesce(value, F.lit(default))


def _measures() -> dict[str, Column]:
    """Softened measures: 0.1 in each divisor, and a neutral value where unknown."""
    metres, seconds = num("distance_in_meters"), num("duration_in_seconds")
    pickup_m, pickup_s = num("pickup_in_meters"), num("pickup_in_seconds")
    bid, start = num("price_bid_local"), num("price_start_local")
    response = seconds_between(F.col("order_timestamp"), F.col("tender_timestamp"))
    return {
        "_response": _filled(response, 30.0),
        "_speed": _filled(ratio(metres, seconds + 0.1) * 3.6, 30.0),
        "_pickup_speed": _filled(ratio(pickup_m, pickup_s + 0.1) * 3.6, 30.0),
        "_pickup_ratio": _filled(ratio(pickup_m, metres + 0.1), 0.5),
        "_increase": _filled(ratio(bid - start, start + 0.1) * 100, 0.0),
    }


def _flags() -> dict[str, Column]:
    metres, seconds = F.col("distance_in_meters"), F.col("duration_in_seconds")
    bid, speed = F.col("price_bid_local"), F.col("_speed")
    found = {
        "future_driver": F.col("driver_reg_date") > F.col("order_timestamp"),
        "future_bid": F.col("tender_timestamp") < F.col("order_timestamp"),
        "slow_response": F.col("_response") > c.MAX_RESPONSE_S,
        "zero_distance": metres <= 0,
        "zero_duration": seconds <= 0,
        "zero_price": bid <= 0,
        "too_short_trip": metres < c.MIN_TRIP_M,
        "too_quick_trip": seconds < c.MIN_TRIP_S,
        "extreme_distance": metres > c.MAX_TRIP_M,
        "extreme_duration": seconds > c.MAX_TRIP_S,
        "too_fast_city": speed > c.MAX_CITY_KMH,
        "physically_impossible": seconds < metres / F.lit(c.MAX_POSSIBLE_KMH / 3.6),
        "too_slow": speed < c.MIN_KMH,
        "extreme_pickup_ratio": F.col("_pickup_ratio") > c.MAX_PICKUP_RATIO,
        "extreme_pickup_speed": F.col("_pickup_speed") > c.MAX_PICKUP_KMH,
        "extreme_markup": F.col("_increase") > c.MAX_MARKUP_PCT,
        "extreme_price": bid > c.MAX_PRICE,
    }
    return {f"flag_{name}": flag(p) for name, p in found.items()}


def _scores() -> dict[str, Column]:
    metres, seconds = num("distance_in_meters"), num("duration_in_seconds")
    speed, dear = F.col("_speed"), num("price_bid_local") / F.lit(float(c.MAX_PRICE))
    too_slow = ratio(F.lit(float(c.MIN_KMH)), speed + 0.1)
    zeros = ("flag_zero_distance", "flag_zero_duration", "flag_zero_price")
    scores = {
        "response_time_score": clip(F.col("_response") / F.lit(float(c.MAX_RESPONSE_S)), 0, 2),
        "zero_values_count": reduce(add, [F.col(z) for z in zeros]),
        "short_trip_score": clip(metres / F.lit(float(c.MIN_TRIP_M)), 0, 2),
        "distance_extremity": metres / F.lit(float(c.MAX_TRIP_M)),
        "duration_extremity": seconds / F.lit(float(c.MAX_TRIP_S)),
        "speed_anomaly_score": clip(
            larger_of(speed / F.lit(float(c.MAX_CITY_KMH)), too_slow), 0, 5
        ),
        "pickup_anomaly_score": clip(
            F.col("_pickup_ratio") / F.lit(float(c.MAX_PICKUP_RATIO)), 0, 3
        ),
        "price_anomaly_score": clip(
            larger_of(F.col("_increase") / F.lit(float(c.MAX_MARKUP_PCT)), dear), 0, 3
        ),
    }
    return {name: F.coalesce(value, F.lit(0.0)) for name, value in scores.items()}


def with_flags(bids: DataFrame) -> DataFrame:
    measured = bids.withColumns(_measures()).withColumns(_flags())
    return measured.drop(*_measures())


def _index() -> dict[str, Column]:
    total = F.col("total_flags")
    return {
        "data_quality_index": F.lit(1.0) / (F.lit(1.0) + total),
        "is_high_quality": flag(total == 0),
        "is_suspicious": flag(total >= 2),
        "is_low_quality": flag(total >= 4),
    }


def with_quality(bids: DataFrame) -> DataFrame:
    """Bids plus the 30 quality columns; a plain projection, nothing is removed."""
    measured = bids.withColumns(_measures()).withColumns(_flags()).withColumns(_scores())
    total = reduce(add, [F.col(f) for f in FLAGS])
    return (
        measured.withColumn("total_flags", total).withColumns(_index()).drop(*_measures())
    )


def quality_label() -> Column:
    """``done`` for a row with at most one flag."""
    return F.when(F.col("data_quality_index") >= 0.5, "done").otherwise("cancel")


def threshold_label(probability: Column, threshold: float = 0.5) -> Column:
    return F.when(probability >= F.lit(threshold), "done").otherwise("cancel")


def quality_summary(quality: DataFrame) -> DataFrame:
    marks = {"high": "is_high_quality", "suspicious": "is_suspicious", "low": "is_low_quality"}
    aggs = [F.count("*").alias("n"), F.avg("data_quality_index").alias("avg_index")]
    aggs += [F.count_if(F.col(col) == 1.0).alias(f"{name}_count") for name, col in marks.items()]
    out = quality.agg(*aggs)
    percents = [
        (ratio(F.col(f"{m}_count"), F.col("n")) * 100).alias(f"{m}_pct") for m in marks
    ]
    return out.select("avg_index", *[f"{m}_count" for m in marks], *percents)


def quality_range(quality: DataFrame) -> DataFrame:
    index = "data_quality_index"
    return quality.agg(
        F.min(index).alias("min_index"),
        F.avg(index).alias("avg_index"),
        F.max(index).alias("max_index"),
    )


def label_counts(labelled: DataFrame, label: str = "is_done") -> DataFrame:
    """Rows and percent per output label."""
    counts = labelled.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n_rows"))
    total = counts.agg(F.sum("n_rows").alias("_t")).scalar()
    return counts.select("label", "n_rows", (ratio(F.col("n_rows"), total) * 100).alias("pct"))
