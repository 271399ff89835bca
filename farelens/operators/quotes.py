"""Quotes at any price and the reports shown with a recommendation.

A recommendation holds at most four zones, sorted by lowest price, so these are
array expressions on the row: no join and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from farelens.functions import display
from farelens.functions.missing import ratio
from farelens.operators.pricing import ZONES
from farelens.schema import ZONE_DDL

# Fixed values.
TAIL_START, TAIL_FALL = 10.0, 8.0
WITH_RED = (0.15, 50.0)
WITHOUT_RED = (0.3, 100.0)
EMPTY_SPAN = 200.0


def _low(zone: Column) -> Column:
    return zone["price_range"]["min"]


def _high(zone: Column) -> Column:
    return zone["price_range"]["max"]


def _chance(zone: Column) -> Column:
    return zone["metrics"]["avg_normalized_probability_percent"]


def enrich(recommendations: DataFrame) -> DataFrame:
    """A missing zone list becomes an empty one, and so do missing recommendations."""
    zones = F.coalesce(F.col("zones"), F.array().cast(f"array<{ZONE_DDL}>"))
    out = recommendations.withColumn("zones", zones)
    if "recommendations" not in out.columns:
        return out.withColumn("recommendations", F.array().cast("array<string>"))
    return out.withColumn("recommendations", F.coalesce(F.col("recommendations"), F.array()))


def with_axis(recommendations: DataFrame, step: float = display.DEFAULT_STEP) -> DataFrame:
    """Add the price axis: ``axis_min``, ``axis_max``, ``axis_step``, ``axis_mid``."""
    zones, analysis = F.col("zones"), F.col("analysis")
    low = _low(F.col("_first"))
    span = _high(F.col("_last")) - low
    red = F.exists(zones, lambda z: z["zone_id"].isin(0, 1))

    def extended(rule: tuple[float, float]) -> Column:
        return _high(F.col("_last")) + F.greatest(span * rule[0], F.lit(rule[1]))

    scan, start = analysis["scan_range"], analysis["start_price"]
    bare_low = F.coalesce(scan["min"], start, F.lit(0.0))
    bare_high = F.coalesce(scan["max"], F.coalesce(start, bare_low) + EMPTY_SPAN)
    has_zones = F.size(zones) > 0
    staged = recommendations.withColumns(
        {
            "_first": F.get(zones, F.lit(0)),
            "_last": F.try_element_at(zones, F.lit(-1)),
        }
    )
    high = F.when(red, extended(WITH_RED)).otherwise(extended(WITHOUT_RED))
    axis = staged.withColumns(
        {
            "axis_min": F.when(has_zones, low).otherwise(bare_low),
            "axis_max": F.when(has_zones, high).otherwise(F.greatest(bare_low + 1, bare_high)),
            "axis_step": F.lit(step if step > 0 else display.DEFAULT_STEP),
        }
    )
    mid = (F.col("axis_min") + F.col("axis_max")) / 2
    return axis.withColumn("axis_mid", mid).drop("_first", "_last")


def with_zone_at(quotes: DataFrame, price: str = "price") -> DataFrame:
    """Add ``zone_index``: 0-based place of the first zone that holds the price."""
    p = F.col(price)
    hits = F.transform(
        F.col("zones"), lambda z, i: F.when((p >= _low(z)) & (p <= _high(z)), i)
    )
    return quotes.withColumn("zone_index", F.array_min(hits))


def with_neighbours(quotes: DataFrame) -> DataFrame:
    """Add ``zone_at`` and the neighbours' chances (null at either end)."""
    zones, at = F.col("zones"), F.col("zone_index")
    return quotes.withColumns(
        {
            "zone_at": F.get(zones, at),
            "previous_chance": _chance(F.get(zones, at - 1)),
            "next_chance": _chance(F.get(zones, at + 1)),
        }
    )


def inside_chance(price: Column) -> Column:
    """Linear between the zone's ends, where an end is the mean with the neighbour."""
    zone = F.col("zone_at")
    own = _chance(zone)
    at_low = F.coalesce((F.col("previous_chance") + own) / 2, own)
    at_high = F.coalesce((F.col("next_chance") + own) / 2, own)
    width = _high(zone) - _low(zone)
    place = (price - _low(zone)) / F.when(width == 0, F.lit(1.0)).otherwise(width)
    return at_low + (at_high - at_low) * place


def tail_chance(price: Column) -> Column:
    """Beyond the zones: falls from 10 % with the distance, 0 without room to fall."""
    zones = F.col("zones")
    first, last = F.get(zones, F.lit(0)), F.get(zones, F.size(zones) - 1)
    beyond, room = price - _high(last), F.col("axis_max") - _high(last)
    before, room_before = _low(first) - price, _low(first) - F.col("axis_min")

    def fall(distance: Column, whole: Column) -> Column:
        left = F.lit(TAIL_START) - ratio(distance, whole) * TAIL_FALL
        return F.coalesce(F.greatest(F.lit(0.0), left), F.lit(0.0))

    return F.when(beyond > 0, fall(beyond, room)).when(before > 0, fall(before, room_before))


def quote(quotes: DataFrame, price: str = "price") -> DataFrame:
    """Chance, expected value and colour at ``price`` for rows of ``with_axis``.

    Inside a zone the chance is interpolated; beyond the zones it falls off; in a
    gap between zones (or without zones) the optimum's own values are shown.
    """
    p, best = F.col(price), F.col("optimal_price")
    located = with_neighbours(with_zone_at(quotes, price))
    staged = located.withColumns({"_in": inside_chance(p), "_out": tail_chance(p)})
    inside, outside = F.col("zone_index").isNotNull(), F.col("_out").isNotNull()

    def shown(value: Column) -> Column:
        return F.when(value != 0, value)

    own = F.coalesce(
        shown(best["normalized_probability_percent"]), shown(best["probability_percent"]), F.lit(0.0)
    )
    chance = F.when(inside, F.col("_in")).when(outside, F.col("_out")).otherwise(own)
    value = (
        F.when(inside, F.greatest(F.lit(0.0), p * (F.col("_in") / 100)))
        .when(outside, p * (F.col("_out") / 100))
        .otherwise(F.coalesce(best["expected_value"], F.lit(0.0)))
    )
    color = (
        F.when(inside, display.zone_color(F.col("zone_at")["zone_name"]))
        .when(outside, "red")
        .otherwise("green")
    )
    return staged.withColumns(
        {"quote_probability": chance, "quote_ev": value, "quote_color": color}
    ).drop("_in", "_out")


def zone_segments(recommendations: DataFrame) -> DataFrame:
    """Coloured segments of the axis: each visible zone, then the uncovered end."""
    low, high = F.col("axis_min"), F.col("axis_max")
    zones = F.col("zones")
    visible = F.filter(
        zones, lambda z: (_low(z) >= low) & (_high(z) <= high) & (_low(z) < _high(z))
    )
    drawn = F.transform(
        visible,
        lambda z: F.struct(
            _low(z).alias("segment_min"),
            _high(z).alias("segment_max"),
            display.zone_color(z["zone_name"]).alias("color"),
            F.lit(False).alias("is_gap"),
        ),
    )
    last = _high(F.get(zones, F.size(zones) - 1))
    gap = F.struct(
        last.alias("segment_min"),
        high.alias("segment_max"),
        F.lit("red").alias("color"),
        F.lit(True).alias("is_gap"),
    )
    end = F.when(last < high, F.array(gap)).otherwise(F.slice(F.array(gap), 1, 0))
    return recommendations.select("order_id", F.inline(F.concat(drawn, end)))


# Zones every report lists, by falling chance.
REPORT_HINTS = {
    3: "≥70% вероятность",
    2: "50-70% вероятность",
    4: "30-50% вероятность",
    1: "<30% вероятность",
}


def zone_report(recommendations: DataFrame) -> DataFrame:
    """All four zones per order; an absent one shows where it would begin."""
    zones = F.col("zones")
    listed = F.array(
        *[
            F.struct(
                F.lit(zone).alias("zone_id"),
                F.lit(name).alias("zone_name"),
                F.lit(REPORT_HINTS[zone]).alias("description"),
            )
            for zone, name, *_ in ZONES
        ]
    )
    highest = F.array_max(
        F.transform(zones, lambda z: F.struct(z["zone_id"].alias("id"), _high(z).alias("high")))
    )["high"]
    bounded = recommendations.select("order_id", "zones", highest.alias("_last_high"))
    rows = bounded.select("*", F.inline(listed))
    own = F.get(F.filter(zones, lambda z: z["zone_id"] == F.col("zone_id")), F.lit(0))
    staged = rows.withColumn("_zone", own)
    zone, there = F.col("_zone"), F.col("_zone").isNotNull()
    beyond = F.when(
        F.col("_last_high").isNotNull() & (F.col("zone_id") < 3),
        F.concat(F.lit(">"), F.round("_last_high", 0).cast("bigint").cast("string"), F.lit("₽")),
    ).otherwise("—")
    return staged.select(
        "order_id",
        "zone_id",
        display.zone_label(F.col("zone_name")).alias("label"),
        display.zone_color(F.col("zone_name")).alias("color"),
        there.alias("is_present"),
        _low(zone).alias("price_min"),
        _high(zone).alias("price_max"),
        zone["metrics"]["avg_probability_percent"].alias("probability_percent"),
        zone["metrics"]["avg_expected_value"].alias("expected_value"),
        _chance(zone).alias("normalized_percent"),
        F.when(~there, beyond).alias("price_hint"),
        F.when(~there, F.col("description")).alias("note"),
    )


def optimal_zone_lookup(recommendations: DataFrame) -> DataFrame:
    """Label and colour of the optimum's zone; ``N/A`` and green where it is absent."""
    zone = F.get(
        F.filter(
            F.col("zones"), lambda z: z["zone_id"] == F.col("optimal_price")["zone_id"]
        ),
        F.lit(0),
    )
    staged = recommendations.withColumn("_zone", zone)
    name = F.col("_zone")["zone_name"]
    return staged.select(
        "order_id",
        F.col("optimal_price")["zone_id"].alias("zone_id"),
        F.when(name.isNull(), "N/A").otherwise(display.zone_label(name)).alias("label"),
        F.when(name.isNull(), "green").otherwise(display.zone_color(name)).alias("color"),
    )


def margin_band(recommendations: DataFrame) -> DataFrame:
    """Profit colour and margin percent of the optimum."""
    best, fuel = F.col("optimal_price"), F.col("fuel_economics")["fuel_cost"]
    # A profit of exactly zero counts as not given and is derived again.
    given = F.when(best["net_profit"] != 0, best["net_profit"])
    profit = F.coalesce(given, best["expected_value"] - fuel)
    return recommendations.select(
        "order_id",
        profit.alias("net_profit"),
        display.margin_color(profit, fuel).alias("color"),
        display.margin_percent(profit, best["expected_value"]).alias("margin_percent"),
    )


def max_prob_ev(recommendations: DataFrame) -> DataFrame:
    """Expected value at the likeliest price next to the optimum's, in whole units."""
    best, analysis = F.col("optimal_price"), F.col("analysis")
    price = F.round(analysis["max_probability_price"], 0)
    percent = F.round(analysis["max_probability_percent"], 0)
    return recommendations.select(
        "order_id",
        F.round(best["price"], 0).alias("optimal_price"),
        F.round(best["probability_percent"], 0).alias("optimal_percent"),
        F.round(best["expected_value"], 0).alias("optimal_ev"),
        price.alias("max_prob_price"),
        percent.alias("max_prob_percent"),
        F.round(price * percent / 100, 0).alias("max_prob_ev"),
    )
