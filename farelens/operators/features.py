"""The feature table: 100 base columns in 15 groups, plus the quality columns.

Batch features describe bids that were made; serving features describe a price a
driver might ask. They share names but not every formula, so each group that
differs takes the differing columns as arguments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from farelens.functions import clock, fare
from farelens.functions.missing import clip, flag, num, ratio
from farelens.operators.history import DRIVER, USER, join_history
from farelens.operators.quality import QUALITY_COLUMNS, with_quality

GROUPS: dict[str, tuple[str, ...]] = {
    "price": (
        "price_bid_local", "price_start_local", "price_increase_abs", "price_increase_pct",
        "is_price_increased", "price_per_km", "price_per_minute",
    ),
    "time": (
        "hour_sin", "hour_cos", "day_of_week", "day_sin", "day_cos", "is_weekend",
        "is_morning_peak", "is_evening_peak", "is_peak_hour", "is_night", "is_lunch_time",
    ),
    "trip": (
        "distance_in_meters", "duration_in_seconds", "distance_km", "duration_min",
        "avg_speed_kmh", "is_traffic_jam", "is_highway", "is_short_trip", "is_medium_trip",
        "is_long_trip",
    ),
    "pickup": (
        "pickup_in_meters", "pickup_in_seconds", "pickup_km", "pickup_speed_kmh",
        "pickup_to_trip_ratio", "pickup_time_ratio", "total_distance", "total_time",
    ),
    "driver": (
        "driver_rating", "driver_experience_days", "driver_experience_years", "is_new_driver",
        "is_experienced_driver", "has_perfect_rating", "rating_deviation",
    ),
    "response": (
        "response_time_seconds", "response_time_log", "is_fast_response", "is_slow_response",
    ),
    "taxi": ("taxi_type_economy", "taxi_type_comfort", "taxi_type_business"),
    "platform": ("platform_android", "platform_ios"),
    "cross": (
        "price_inc_x_distance", "price_inc_x_night", "price_inc_x_peak", "price_inc_x_weekend",
        "distance_x_night", "distance_x_weekend", "distance_x_peak", "speed_x_peak",
        "rating_x_price_inc", "experience_x_price_inc",
    ),
    "fuel": (
        "fuel_cost_rub", "fuel_liters", "price_to_fuel_ratio", "min_profitable_price",
        "price_above_min_profitable", "price_above_min_profitable_pct", "is_highly_profitable",
        "is_profitable", "is_unprofitable", "net_profit", "net_profit_per_km",
        "net_profit_per_minute", "fuel_ratio_x_distance", "fuel_ratio_x_peak",
        "net_profit_x_rating",
    ),
    "user": (
        "user_order_count", "user_acceptance_rate", "user_avg_price_ratio", "user_is_new",
        "user_is_vip", "user_is_price_sensitive",
    ),
    "driver_hist": (
        "driver_bid_count", "driver_acceptance_rate", "driver_avg_bid_ratio",
        "driver_is_active", "driver_is_aggressive", "driver_is_flexible",
    ),
    "match": ("user_driver_match_score", "price_vs_user_avg", "price_vs_driver_avg"),
    "route": ("route_efficiency", "is_very_short", "is_very_long", "pickup_burden"),
    "month": ("day_of_month", "is_month_start", "is_month_end", "hour_quartile"),
}
BASE_FEATURES = tuple(name for group in GROUPS.values() for name in group)
ALL_FEATURES = BASE_FEATURES + QUALITY_COLUMNS




def _price() -> dict[str, Column]:
    bid, start = num("price_bid_local"), num("price_start_local")
    percent = ratio(bid - start, start) * 100
    km, mins = fare.kilometres(num("distance_in_meters")), fare.minutes(num("duration_in_seconds"))
    return {
        "price_increase_abs": bid - start,
        # Infinite at a zero start price, hence missing; it is still an increase.
        "price_increase_pct": percent,
        "is_price_increased": flag(F.when(start == 0, bid > 0).otherwise(percent > 0)),
        "price_per_km": ratio(bid, km + 0.1),
        "price_per_minute": ratio(bid, mins + 0.1),
    }


def _time() -> dict[str, Column]:
    ts = F.col("order_timestamp")
    hour, weekday = clock.hour_of(ts), clock.weekday_of(ts)
    hour_sin, hour_cos = clock.cycle(hour, 24)
    day_sin, day_cos = clock.cycle(weekday, 7)
    return {
        "hour_sin": hour_sin,
        "hour_cos": hour_cos,
        "day_of_week": weekday,
        "day_sin": day_sin,
        "day_cos": day_cos,
        "is_weekend": flag(weekday >= 5),
        "is_morning_peak": clock.is_morning_peak(hour),
        "is_evening_peak": clock.is_evening_peak(hour),
        "is_peak_hour": clock.is_peak(hour),
        "is_night": clock.is_night(hour),
        "is_lunch_time": flag(hour.between(12, 14)),
    }


def _trip(speed: Column) -> dict[str, Column]:
    km = fare.kilometres(num("distance_in_meters"))
    return {
        "distance_km": km,
        "duration_min": fare.minutes(num("duration_in_seconds")),
        "avg_speed_kmh": speed,
        "is_traffic_jam": flag(speed < 15),
        "is_highway": flag(speed > 50),
        "is_short_trip": flag(km < 2),
        "is_medium_trip": flag((km >= 2) & (km < 10)),
        "is_long_trip": flag(km >= 10),
    }


def _pickup(speed: Column, length_ratio: Column, time_ratio: Column) -> dict[str, Column]:
    return {
        "pickup_km": fare.kilometres(num("pickup_in_meters")),
        "pickup_speed_kmh": speed,
        "pickup_to_trip_ratio": length_ratio,
        "pickup_time_ratio": time_ratio,
        "total_distance": num("pickup_in_meters") + num("distance_in_meters"),
        "total_time": num("pickup_in_seconds") + num("duration_in_seconds"),
    }


def _driver(days: Column) -> dict[str, Column]:
    rating = num("driver_rating")
    return {
        "driver_experience_days": days,
        "driver_experience_years": days / F.lit(365.25),
        "is_new_driver": flag(days < 30),
        "is_experienced_driver": flag(days > 365),
        "has_perfect_rating": flag(rating == 5.0),
        "rating_deviation": F.lit(5.0) - rating,
    }


def _response(seconds: Column) -> dict[str, Column]:
    return {
        "response_time_seconds": seconds,
        "response_time_log": F.log1p(seconds),
        "is_fast_response": flag(seconds < 10),
        "is_slow_response": flag(seconds > 60),
    }


def _taxi_and_platform() -> dict[str, Column]:
    kind = fare.taxi_type(F.col("carname"), F.col("carmodel"))
    one_hot = {f"taxi_type_{k}": flag(kind == k) for k in ("economy", "comfort", "business")}
    return one_hot | {f"platform_{p}": flag(F.col("platform") == p) for p in ("android", "ios")}


def _cross() -> dict[str, Column]:
    """Products of columns made by the earlier groups."""
    factors = {
        "price_inc_x_distance": ("price_increase_pct", "distance_km"),
        "price_inc_x_night": ("price_increase_pct", "is_night"),
        "price_inc_x_peak": ("price_increase_pct", "is_peak_hour"),
        "price_inc_x_weekend": ("price_increase_pct", "is_weekend"),
        "distance_x_night": ("distance_km", "is_night"),
        "distance_x_weekend": ("distance_km", "is_weekend"),
        "distance_x_peak": ("distance_km", "is_peak_hour"),
        "speed_x_peak": ("avg_speed_kmh", "is_peak_hour"),
        "rating_x_price_inc": ("driver_rating", "price_increase_pct"),
        "experience_x_price_inc": ("driver_experience_years", "price_increase_pct"),
    }
    return {name: F.col(a) * F.col(b) for name, (a, b) in factors.items()}


def _fuel(above_pct: Column) -> dict[str, Column]:
    """Needs ``fuel_cost_rub``, ``fuel_liters`` and ``min_profitable_price``."""
    bid, cost, least = num("price_bid_local"), F.col("fuel_cost_rub"), F.col("min_profitable_price")
    profit, fuel_ratio = bid - cost, ratio(bid, cost + 0.1)
    return {
        "price_to_fuel_ratio": fuel_ratio,
        "price_above_min_profitable": bid - least,
        "price_above_min_profitable_pct": above_pct,
        "is_highly_profitable": flag(bid >= least * 2),
        "is_profitable": flag(bid >= least),
        "is_unprofitable": flag(bid < least),
        "net_profit": profit,
        "net_profit_per_km": ratio(profit, F.col("distance_km") + 0.1),
        "net_profit_per_minute": ratio(profit, F.col("duration_min") + 0.1),
        "fuel_ratio_x_distance": fuel_ratio * F.col("distance_km"),
        "fuel_ratio_x_peak": fuel_ratio * F.col("is_peak_hour"),
        "net_profit_x_rating": profit * num("driver_rating"),
    }


def _route_and_month() -> dict[str, Column]:
    km, ts = F.col("distance_km"), F.col("order_timestamp")
    day, hour = clock.month_day_of(ts), clock.hour_of(ts)
    return {
        "route_efficiency": ratio(km, F.col("duration_min") + 0.1),
        "is_very_short": flag(km < 1),
        "is_very_long": flag(km > 20),
        "pickup_burden": ratio(F.col("pickup_km"), km + 0.1),
        "day_of_month": day,
        "is_month_start": flag(day <= 5),
        "is_month_end": flag(day >= 25),
        "hour_quartile": F.floor(hour / F.lit(6.0)),
    }


def _match(user_price: Column, driver_price: Column) -> dict[str, Column]:
    bid = num("price_bid_local")
    return {
        "user_driver_match_score": F.col("user_acceptance_rate") * F.col("driver_acceptance_rate"),
        "price_vs_user_avg": ratio(bid, user_price + 0.1),
        "price_vs_driver_avg": ratio(bid, driver_price + 0.1),
    }


def row_features(bids: DataFrame) -> DataFrame:
    """All batch groups that need only the bid itself (one narrow stage)."""
    metres, seconds = num("distance_in_meters"), num("duration_in_seconds")
    pickup_m, pickup_s = num("pickup_in_meters"), num("pickup_in_seconds")
    ordered, tendered = F.col("order_timestamp"), F.col("tender_timestamp")
    days = F.coalesce(clock.whole_days(F.col("driver_reg_date"), ordered), F.lit(365.0))
    response = F.coalesce(clock.seconds_between(ordered, tendered), F.lit(30.0))
    cost, bid = F.col("fuel_cost_rub"), num("price_bid_local")
    least = F.col("min_profitable_price")
    direct = (
        _price()
        | _time()
        | _trip(clip(ratio(metres, seconds + 0.1) * 3.6, 0, 150))
        | _pickup(
            clip(ratio(pickup_m, pickup_s + 0.1) * 3.6, 0, 150),
            clip(ratio(pickup_m, metres + 1.0), 0, 10),
            clip(ratio(pickup_s, seconds + 1.0), 0, 10),
        )
        | _driver(clip(days, 0, 3650))
        | _response(clip(response, 0, 600))
        | _taxi_and_platform()
        | {"fuel_cost_rub": fare.fuel_cost(metres), "fuel_liters": fare.fuel_litres(metres)}
    )
    return (
        bids.withColumns(direct)
        .withColumn("min_profitable_price", fare.min_profitable(cost))
        .withColumns(
            _cross() | _fuel(ratio(bid - least, least + 0.1) * 100) | _route_and_month()
        )
    )


def history_features(
    bids: DataFrame, users: DataFrame, drivers: DataFrame, small: bool | None = None
) -> DataFrame:
    """Both history joins and the three groups built on them."""
    joined = join_history(bids, users, USER, small)
    return with_match(join_history(joined, drivers, DRIVER, small))


def with_match(joined: DataFrame) -> DataFrame:
    """The columns built on both histories, for bids that have them."""
    return joined.withColumns(_match(F.col("user_avg_bid"), F.col("driver_avg_bid")))


def as_features(df: DataFrame, names: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """Identification columns as they are, features as doubles."""
    return df.select(*keep, *[F.col(n).cast("double").alias(n) for n in names])


def batch_features(
    bids: DataFrame,
    users: DataFrame,
    drivers: DataFrame,
    keep: tuple[str, ...] = (),
    small: bool | None = None,
) -> DataFrame:
    """The 130 columns before imputation and clipping."""
    return matched_features(history_features(bids, users, drivers, small), keep)


def matched_features(matched: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 130 columns of bids that went through ``with_match``."""
    return as_features(row_features(with_quality(matched)), ALL_FEATURES, keep)


def serving_features(priced: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 100 base columns for a candidate price.

    ``priced`` has the (defaulted) order fields, the looked-up history columns,
    ``price`` (the candidate) and ``reference_price``.
    """
    metres, seconds = num("distance_in_meters"), num("duration_in_seconds")
    pickup_m, pickup_s = num("pickup_in_meters"), num("pickup_in_seconds")
    requested = priced.withColumns(
        {
            "order_timestamp": F.timestamp_seconds(F.col("order_timestamp")),
            "price_bid_local": F.col("price"),
            "price_start_local": F.col("reference_price"),
        }
    )
    days = clock.whole_days(clock.parsed(F.col("driver_reg_date")), F.col("order_timestamp"))
    bid, least = num("price_bid_local"), F.col("min_profitable_price")
    direct = (
        _price()
        | _time()
        | _trip(F.when(seconds > 0, metres / seconds * 3.6).otherwise(25.0))
        | _pickup(
            F.when(pickup_s > 0, pickup_m / pickup_s * 3.6).otherwise(20.0),
            ratio(pickup_m, metres + 1.0),
            ratio(pickup_s, seconds + 1.0),
        )
        | _driver(F.when(days >= 0, days).otherwise(365.0))
        | _response(F.lit(30.0))
        | _taxi_and_platform()
        | {
            "fuel_cost_rub": F.round(fare.fuel_cost(metres), 2),
            "fuel_liters": F.round(fare.fuel_litres(metres), 2),
        }
    )
    above_pct = F.when(least > 0, ratio(bid - least, least) * 100).otherwise(0.0)
    users_price = F.col("user_order_count") * F.lit(20.0)
    drivers_price = F.col("driver_bid_count") * F.lit(10.0)
    wide = (
        requested.withColumns(direct)
        .withColumn("min_profitable_price", fare.min_profitable(F.col("fuel_cost_rub")))
        .withColumns(
            _cross() | _fuel(above_pct) | _route_and_month() | _match(users_price, drivers_price)
        )
    )
    return as_features(wide, BASE_FEATURES, keep)
