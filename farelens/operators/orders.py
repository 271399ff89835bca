"""Validation, defaults and coercion of price requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from farelens.functions.missing import num
from farelens.operators.history import DRIVER, USER, lookup_history
from farelens.schema import (
    ORDER_FIELDS,
    PLATFORMS,
    REQUIRED_BID_COLUMNS,
    REQUIRED_ORDER_COLUMNS,
    UNREADABLE,
)

# Fixed values for absent optional fields.
ORDER_DEFAULTS = {
    "driver_reg_date": "2020-01-01",
    "driver_rating": 5.0,
    "carname": "Renault",
    "carmodel": "Logan",
    "platform": "android",
}


def missing_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED_BID_COLUMNS) -> list[str]:
    return [c for c in required if c not in df.columns]


def check_columns(
    df: DataFrame, required: tuple[str, ...] = REQUIRED_BID_COLUMNS
) -> DataFrame:
    """One row per required column: whether the frame has it, and its filled rows."""
    absent = missing_columns(df, required)
    filled = df.agg(
        *[(F.lit(0) if c in absent else F.count(c)).cast("bigint").alias(c) for c in required]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(c not in absent).alias("is_present"),
            F.col(c).alias("n_filled"),
        )
        for c in required
    ]
    return filled.select(F.inline(F.array(*rows)))


def add_missing_label(bids: DataFrame) -> DataFrame:
    if "is_done" in bids.columns:
        return bids
    return bids.withColumn("is_done", F.lit("cancel"))


def require_rows(df: DataFrame, least: int = 100) -> DataFrame:
    """The frame itself, or an error if it has fewer than ``least`` rows."""
    if df.limit(least).count() < least:
        raise ValueError(f"fewer than {least} rows left after cleaning")
    return df


def require_fields(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders with all required fields, and the others with the absent names."""
    absent = missing_columns(orders, REQUIRED_ORDER_COLUMNS)
    if absent:
        raise ValueError(f"required order fields are absent: {', '.join(absent)}")
    marks = [
        F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED_ORDER_COLUMNS
    ]
    marked = orders.withColumn("missing_fields", F.array_compact(F.array(*marks)))
    complete = F.size("missing_fields") == 0
    return marked.filter(complete).drop("missing_fields"), marked.filter(~complete)


def _order_rules() -> dict[str, Column]:
    at_least_zero = (
        "distance_in_meters", "duration_in_seconds", "pickup_in_meters",
        "pickup_in_seconds", "price_start_local",
    )
    return {
        "order_timestamp": F.col("order_timestamp") > 0,
        **{c: F.col(c) >= 0 for c in at_least_zero},
        "driver_rating": F.col("driver_rating").between(1.0, 5.0),
        "platform": F.col("platform").isin(list(PLATFORMS)),
    }


def mark_order_errors(orders: DataFrame) -> DataFrame:
    """Add ``errors``: the names of required fields that are absent or out of range.

    A request that was read with its text kept (``UNREADABLE``) has that name first where the text
    could not be read.
    """
    marks = [
        F.when(~F.coalesce(rule, F.lit(False)), F.lit(name))
        for name, rule in _order_rules().items()
    ]
    if UNREADABLE in orders.columns:
        marks.insert(0, F.when(F.col(UNREADABLE).isNotNull(), F.lit(UNREADABLE)))
    return orders.withColumn("errors", F.array_compact(F.array(*marks)))


def validate_orders(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted orders, and rejected ones with the reasons."""
    marked = mark_order_errors(orders)
    good = F.size("errors") == 0
    return marked.filter(good).drop("errors"), marked.filter(~good)


def order_defaults(orders: DataFrame) -> DataFrame:
    """Fill absent optional fields; the bid time defaults to the order time."""
    filled = {
        c: F.coalesce(F.col(c), F.lit(v)) if c in orders.columns else F.lit(v)
        for c, v in ORDER_DEFAULTS.items()
    }
    ordered = F.col("order_timestamp")
    tender = (
        F.coalesce(F.col("tender_timestamp"), ordered)
        if "tender_timestamp" in orders.columns
        else ordered
    )
    ids = {
        c: F.lit(None).cast("bigint") for c in ("user_id", "driver_id") if c not in orders.columns
    }
    return orders.withColumns(filled | {"tender_timestamp": tender} | ids)


def coerce_order(orders: DataFrame) -> DataFrame:
    """Declared types for every request field; absent optional fields become null."""
    columns = [
        (F.col(c) if c in orders.columns else F.lit(None)).cast(t).alias(c)
        for c, t in ORDER_FIELDS.items()
    ]
    extra = [c for c in orders.columns if c not in ORDER_FIELDS]
    return orders.select(*extra, *columns)


def prepare_orders(
    orders: DataFrame, users: DataFrame, drivers: DataFrame, small: bool | None = None
) -> DataFrame:
    """Requests ready to be priced: defaults and looked-up history."""
    filled = order_defaults(coerce_order(orders))
    with_user = lookup_history(filled, users, USER, small)
    return lookup_history(with_user, drivers, DRIVER, small)


def recommendation_errors(recommendations: DataFrame) -> DataFrame:
    """Per output rule, the number of recommendations that break it."""

    def percent(c: Column) -> Column:
        return c.between(0, 100)

    zones, best = F.col("zones"), F.col("optimal_price")
    fuel, analysis = F.col("fuel_economics"), F.col("analysis")
    rules = {
        "zone_prices": F.forall(
            zones, lambda z: (z["price_range"]["min"] >= 0) & (z["price_range"]["max"] >= 0)
        ),
        "zone_percents": F.forall(
            zones,
            lambda z: percent(z["metrics"]["avg_probability_percent"])
            & percent(z["metrics"]["avg_normalized_probability_percent"]),
        ),
        "zone_values": F.forall(zones, lambda z: z["metrics"]["avg_expected_value"] >= 0),
        "zone_ids": F.forall(zones, lambda z: z["zone_id"] >= 0) & (best["zone_id"] >= 0),
        "optimal_price": (best["price"] >= 0) & (best["expected_value"] >= 0),
        "optimal_percents": percent(best["probability_percent"])
        & percent(best["normalized_probability_percent"]),
        "fuel": (fuel["fuel_cost"] >= 0)
        & (fuel["fuel_liters"] >= 0)
        & (fuel["distance_km"] >= 0)
        & (fuel["fuel_price_per_liter"] >= 0)
        & (fuel["consumption_per_100km"] >= 0)
        & (fuel["min_profitable_price"] >= 0),
        "start_price": num(analysis["start_price"]) >= 0,
        "max_probability": percent(analysis["max_probability_percent"])
        & (analysis["max_probability_price"] >= 0),
        "scan_range": (analysis["scan_range"]["min"] >= 0)
        & (analysis["scan_range"]["max"] >= 0),
    }
    broken = [
        F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()
    ]
    counted = recommendations.agg(*broken)
    rows = F.inline(
        F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_broken")) for n in rules])
    )
    return counted.select(rows)
