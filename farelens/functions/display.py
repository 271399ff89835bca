"""Columns that turn a recommendation into what a driver is shown."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from farelens.functions.missing import ratio

DEFAULT_STEP = 5.0


def round_half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5))


def zone_color(name: Column) -> Column:
    return (
        F.when(name.contains("green"), "green")
        .when(name.contains("yellow"), "yellow")
        .when(name.contains("red"), "red")
        .otherwise("green")
    )


# Readable zone labels.
ZONE_LABELS = {
    "green": "Зелёная зона",
    "yellow_low": "Жёлтая зона (низкая)",
    "yellow_high": "Жёлтая зона (высокая)",
    "red": "Красная зона",
}


def zone_label(name: Column) -> Column:
    label = F.when(F.lit(False), F.lit(""))
    for part, text in ZONE_LABELS.items():
        label = label.when(name.contains(part), text)
    return label.otherwise(name)


def snap_to_step(price: Column, step: Column, low: Column, high: Column) -> Column:
    snapped = round_half_up(price / step) * step
    return F.greatest(low, F.least(high, snapped))


def eta_minutes(seconds: Column, metres: Column, fallback: int) -> Column:
    """Minutes from the stated time, else from distance at 30 km/h, else a constant."""
    by_distance = metres / F.lit(1000.0) * F.lit(120.0)
    return (
        F.when(seconds > 0, round_half_up(seconds / F.lit(60.0)))
        .when(metres > 0, round_half_up(by_distance / F.lit(60.0)))
        .otherwise(F.lit(fallback))
        .cast("bigint")
    )


def margin_color(profit: Column, fuel: Column) -> Column:
    return F.when(profit > fuel * 2, "green").when(profit > fuel, "yellow").otherwise("red")


def margin_percent(profit: Column, expected_value: Column) -> Column:
    return ratio(profit, expected_value) * F.lit(100.0)
