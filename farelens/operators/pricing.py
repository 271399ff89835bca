"""Price sweep: candidate prices, their scores, the best price and its zones.

Orders are placed by id once, before they multiply. A sweep by a scorer of grids
keeps an order's candidate prices in one array that is folded where it was scored.
Curves, and sweeps by any other scorer, explode candidate prices into rows and fold
them back per order inside the same stage; all buffers are numbers, so each step is
a generated hash aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from farelens.functions import fare
from farelens.functions.missing import num, ratio
from farelens.operators.grid_scoring import GridRules, GridScorer, with_curves, with_sweep
from farelens.operators.scoring import Scorer

COARSE_POINTS = 150
FINE_POINTS = 500

# Fixed values ---------------------------------------------------------------
SCAN_PROBABILITY = 0.05
EV_WEIGHT, PROBABILITY_WEIGHT = 0.7, 0.3
# id, name, lowest probability, probability just above the band
ZONES = (
    (3, "zone_3_green", 0.70, 1.0),
    (2, "zone_2_yellow_low", 0.50, 0.70),
    (4, "zone_4_yellow_high", 0.30, 0.50),
    (1, "zone_1_red_low", 0.0, 0.30),
)
ZONE_THRESHOLDS = {
    "green_zone": "≥70% вероятность принятия",
    "yellow_low_zone": "50-70% вероятность принятия",
    "yellow_high_zone": "30-50% вероятность принятия",
    "red_zone": "<30% вероятность принятия",
}
# ----------------------------------------------------------------------------

# Columns that differ between the candidate prices of an order.
POINT_COLUMNS = (
    "point", "price", "probability", "expected_value", "is_valid",
    "normalized_probability", "normalized_ev", "weighted_score", "band",
)


def with_search_range(orders: DataFrame) -> DataFrame:
    reference = fare.reference_price(num("distance_in_meters"), num("duration_in_seconds"))
    staged = orders.withColumn("reference_price", reference)
    low, high = fare.search_bounds(num("price_start_local"), F.col("reference_price"))
    return staged.withColumns({"search_min": low, "search_max": high})


def grid_price(point: Column, low: Column, high: Column, n: int) -> Column:
    """Evenly spaced price number ``point`` of ``n``; both ends are exact."""
    step = (high - low) / F.lit(float(n - 1))
    return F.when(point == n - 1, high).otherwise(low + point * step)


def price_points(orders: DataFrame, low: str, high: str, n: int) -> DataFrame:
    """One row per order and candidate price."""
    points = orders.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("point"))
    return points.withColumn("price", grid_price(F.col("point"), F.col(low), F.col(high), n))


def spread_orders(orders: DataFrame, partitions: int | None = None) -> DataFrame:
    """Place orders by id before they multiply.

    A sweep makes over a thousand rows of each order, so partitions that look small
    are not; an explicit number keeps adaptive execution from merging them.
    """
    spark = orders.sparkSession
    if partitions is None:
        planned = int(spark.conf.get("spark.sql.shuffle.partitions"))
        partitions = max(planned, spark.sparkContext.defaultParallelism * 2)
    return orders.repartition(partitions, "order_id")


def with_scan_limit(orders: DataFrame, scorer: Scorer, coarse: int = COARSE_POINTS) -> DataFrame:
    """Orders with ``scan_max``: the largest coarse price that still has a chance.

    Keeps the columns the sweep needs; ``order_id`` must be unique.
    """
    needed = ["order_id", "price_start_local", "distance_in_meters", "duration_in_seconds"]
    prepared = scorer.prepare(orders)
    needed += [c for c in scorer.inputs if c not in needed]
    ranged = with_search_range(spread_orders(prepared.select(*needed)))
    points = scorer.score(price_points(ranged, "search_min", "search_max", coarse))
    promising = F.when(F.col("probability") >= SCAN_PROBABILITY, F.col("price"))
    limited = points.groupBy(*ranged.columns).agg(F.max(promising).alias("_top"))
    limit = F.coalesce(F.col("_top"), F.col("reference_price") * 2.0)
    return limited.withColumn("scan_max", limit).drop("_top")


def is_valid_price() -> Column:
    """At or above the user's start price; every price if the scan ends below it."""
    start = F.col("price_start_local")
    return F.when(F.col("scan_max") >= start, F.col("price") >= start).otherwise(F.lit(True))


def scored_points(limited: DataFrame, scorer: Scorer, fine: int = FINE_POINTS) -> DataFrame:
    """Fine candidate prices with probability, expected value and validity."""
    points = scorer.score(price_points(limited, "search_min", "scan_max", fine))
    return points.withColumns(
        {"expected_value": F.col("price") * F.col("probability"), "is_valid": is_valid_price()}
    )


def with_maxima(limited: DataFrame, scorer: Scorer, fine: int = FINE_POINTS) -> DataFrame:
    """Orders with the highest probability (any price) and expected value (valid prices)."""
    points = scored_points(limited, scorer, fine)
    return points.groupBy(*limited.columns).agg(
        F.max("probability").alias("max_probability"),
        F.max(F.when(F.col("is_valid"), F.col("expected_value"))).alias("max_expected_value"),
    )


def grid_rules(coarse: int, fine: int) -> GridRules:
    zones = tuple((zone, low, high) for zone, _, low, high in ZONES)
    return GridRules(coarse, fine, SCAN_PROBABILITY, (EV_WEIGHT, PROBABILITY_WEIGHT), zones)


def _ranged(orders: DataFrame, scorer: Scorer | GridScorer) -> tuple[DataFrame, list[str]]:
    """Placed orders with their search range, and the columns that only the scorer needs."""
    needed = ["order_id", "price_start_local", "distance_in_meters", "duration_in_seconds"]
    prepared = scorer.prepare(orders)
    passing = [c for c in scorer.inputs if c not in needed and c in prepared.columns]
    return with_search_range(spread_orders(prepared.select(*needed, *passing))), passing


def curve_points(orders: DataFrame, scorer: GridScorer, coarse: int, fine: int) -> DataFrame:
    """The points of ``scored_points`` with both maxima; each candidate is scored once."""
    ranged, passing = _ranged(orders, scorer)
    curved = with_curves(ranged, scorer, coarse, fine, SCAN_PROBABILITY).drop(*passing)
    rest = [c for c in curved.columns if c != "probabilities"]
    points = curved.select(*rest, F.posexplode("probabilities").alias("point", "probability"))
    price = grid_price(F.col("point"), F.col("search_min"), F.col("scan_max"), fine)
    priced = points.withColumn("price", price)
    return priced.withColumns(
        {"expected_value": F.col("price") * F.col("probability"), "is_valid": is_valid_price()}
    )


def normalized(probability: Column) -> Column:
    highest = F.col("max_probability")
    return F.when(highest > 0, probability / highest).otherwise(probability)


def price_curve(
    orders: DataFrame, scorer: Scorer | GridScorer, coarse: int = COARSE_POINTS, fine: int = FINE_POINTS
) -> DataFrame:
    """Every fine candidate price of every order with all its scores."""
    if isinstance(scorer, GridScorer):
        points = curve_points(orders, scorer, coarse, fine)
    else:
        maxima = with_maxima(with_scan_limit(orders, scorer, coarse), scorer, fine)
        points = scored_points(maxima, scorer, fine)
    share = ratio(F.col("expected_value"), F.col("max_expected_value"))
    curve = points.withColumns(
        {"normalized_probability": normalized(F.col("probability")), "normalized_ev": share}
    )
    balance = F.col("normalized_ev") * EV_WEIGHT + F.col("normalized_probability") * (
        PROBABILITY_WEIGHT
    )
    return curve.withColumns({"weighted_score": balance, "band": zone_of(F.col("probability"))})


def zone_of(probability: Column) -> Column:
    """Zone id of a probability; exactly 1.0 belongs to none."""
    band = F.when(F.lit(False), F.lit(0))
    for zone, _, low, high in ZONES:
        band = band.when((probability >= low) & (probability < high), F.lit(zone))
    return band


def rank_key(value: Column, n: int) -> Column:
    """A number that is largest for the highest value and, among equals (to nine
    decimals), for the lowest price. Missing values rank last."""
    units = F.coalesce(F.floor(value * 1e9 + 0.5), F.lit(-1).cast("bigint"))
    return units * n + (F.lit(n - 1) - F.col("point"))


def _point_of(key: Column, n: int) -> Column:
    return F.lit(n - 1) - F.pmod(key, F.lit(n))


def _zone_columns() -> list[Column]:
    """Spread the (order, zone) rows of ``sweep`` into columns per zone."""
    spread = []
    for zone, *_ in ZONES:
        for name in ("n", "min", "max", "p", "ev"):
            own = F.max(F.when(F.col("band") == zone, F.col(f"_{name}")))
            spread.append((F.coalesce(own, F.lit(0)) if name == "n" else own).alias(f"z{zone}_{name}"))
    return spread


def sweep(
    orders: DataFrame, scorer: Scorer | GridScorer, coarse: int = COARSE_POINTS, fine: int = FINE_POINTS
) -> DataFrame:
    """One row per order: the optimum, the most probable price and sums per zone."""
    if isinstance(scorer, GridScorer) or scorer.grid is not None:
        ranged, passing = _ranged(orders, scorer)
        swept = with_sweep(ranged, scorer, grid_rules(coarse, fine))
        return swept.drop(*passing) if isinstance(scorer, GridScorer) else swept
    return _sweep_rows(orders, scorer, coarse, fine)


def _sweep_rows(orders: DataFrame, scorer: Scorer | GridScorer, coarse: int, fine: int) -> DataFrame:
    """The sweep by a row for each candidate price."""
    curve = price_curve(orders, scorer, coarse, fine)
    # All order-level columns, so that the existing partitioning satisfies the grouping.
    keys = [c for c in curve.columns if c not in POINT_COLUMNS]
    ranked = curve.filter("is_valid").withColumns(
        {
            "_by_score": rank_key(F.col("weighted_score"), fine),
            "_by_chance": rank_key(F.col("probability"), fine),
        }
    )
    per_zone = ranked.groupBy(*keys, "band").agg(
        F.count("*").alias("_n"),
        F.min("price").alias("_min"),
        F.max("price").alias("_max"),
        F.sum("probability").alias("_p"),
        F.sum("expected_value").alias("_ev"),
        F.max("_by_score").alias("_best"),
        F.max_by("probability", "_by_score").alias("_best_p"),
        F.max("_by_chance").alias("_likeliest"),
    )
    folded = per_zone.groupBy(*keys).agg(
        F.max("_best").alias("_best"),
        F.max_by("_best_p", "_best").alias("optimal_probability"),
        F.max("_likeliest").alias("_likeliest"),
        *_zone_columns(),
    )
    low, high = F.col("search_min"), F.col("scan_max")
    return folded.withColumns(
        {
            "optimal_price": grid_price(_point_of(F.col("_best"), fine), low, high, fine),
            "max_probability_price": grid_price(
                _point_of(F.col("_likeliest"), fine), low, high, fine
            ),
        }
    ).drop("_best", "_likeliest")


def _percent(value: Column) -> Column:
    return F.round(value * 100, 2)


def zones_column() -> Column:
    """Non-empty zones by lowest price."""
    entries = []
    for position, (zone, name, *_) in enumerate(ZONES):
        n, mean_p = F.col(f"z{zone}_n"), ratio(F.col(f"z{zone}_p"), F.col(f"z{zone}_n"))
        low = F.round(F.col(f"z{zone}_min"), 2)
        record = F.struct(
            F.lit(zone).alias("zone_id"),
            F.lit(name).alias("zone_name"),
            F.struct(low.alias("min"), F.round(F.col(f"z{zone}_max"), 2).alias("max")).alias(
                "price_range"
            ),
            F.struct(
                _percent(mean_p).alias("avg_probability_percent"),
                _percent(normalized(mean_p)).alias("avg_normalized_probability_percent"),
                F.round(ratio(F.col(f"z{zone}_ev"), n), 2).alias("avg_expected_value"),
            ).alias("metrics"),
        )
        keyed = F.struct(low.alias("low"), F.lit(position).alias("at"), record.alias("zone"))
        entries.append(F.when(n > 0, keyed))
    ordered = F.array_sort(F.array_compact(F.array(*entries)))
    return F.transform(ordered, lambda e: e["zone"])


def optimal_zone(probability: Column, zones: Column) -> Column:
    """Zone of the optimum; if that zone is empty, the one with the highest mean
    probability; without zones, the green one."""
    by_cut = (
        F.when(probability >= 0.70, 3)
        .when(probability >= 0.50, 2)
        .when(probability >= 0.30, 4)
        .otherwise(1)
    )
    ids = F.transform(zones, lambda z: z["zone_id"])
    ranked = F.transform(
        zones,
        lambda z, i: F.struct(
            z["metrics"]["avg_probability_percent"].alias("p"),
            (-i).alias("at"),
            z["zone_id"].alias("zone_id"),
        ),
    )
    fallback = F.coalesce(F.array_max(ranked)["zone_id"], F.lit(3))
    return F.when(F.array_contains(ids, by_cut), by_cut).otherwise(fallback)


def recommendation(swept: DataFrame, timestamp: Column | None = None) -> DataFrame:
    """The nested recommendation of each swept order."""
    if timestamp is None:
        timestamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    metres = num("distance_in_meters")
    cost = F.round(fare.fuel_cost(metres), 2)
    price, probability = F.col("optimal_price"), F.col("optimal_probability")
    profit = F.round(price * probability - F.col("fuel_cost"), 2)
    staged = swept.withColumns({"fuel_cost": cost, "zones": zones_column()}).withColumn(
        "net_profit", profit
    )
    optimal = F.struct(
        F.round(price, 2).alias("price"),
        _percent(probability).alias("probability_percent"),
        _percent(normalized(probability)).alias("normalized_probability_percent"),
        F.round(price * probability, 2).alias("expected_value"),
        optimal_zone(probability, F.col("zones")).alias("zone_id"),
        F.col("net_profit"),
    )
    fuel = F.struct(
        F.col("fuel_cost"),
        F.round(fare.fuel_litres(metres), 2).alias("fuel_liters"),
        F.round(fare.kilometres(metres), 2).alias("distance_km"),
        F.lit(fare.FUEL_PRICE_PER_LITRE).alias("fuel_price_per_liter"),
        F.lit(fare.FUEL_LITRES_PER_100KM).alias("consumption_per_100km"),
        F.round(fare.min_profitable(F.col("fuel_cost")), 2).alias("min_profitable_price"),
        F.col("net_profit").alias("net_profit_from_optimal"),
    )
    start = num("price_start_local")
    analysis = F.struct(
        start.alias("start_price"),
        _percent(F.col("max_probability")).alias("max_probability_percent"),
        F.round(F.col("max_probability_price"), 2).alias("max_probability_price"),
        F.struct(
            F.round(start, 2).alias("min"), F.round(F.col("scan_max"), 2).alias("max")
        ).alias("scan_range"),
        timestamp.alias("timestamp"),
    )
    return staged.select(
        "order_id",
        "zones",
        optimal.alias("optimal_price"),
        zone_thresholds().alias("zone_thresholds"),
        fuel.alias("fuel_economics"),
        analysis.alias("analysis"),
    )


def zone_thresholds() -> Column:
    return F.struct(*[F.lit(text).alias(name) for name, text in ZONE_THRESHOLDS.items()])


def recommend_batch(
    orders: DataFrame,
    scorer: Scorer | GridScorer,
    coarse: int = COARSE_POINTS,
    fine: int = FINE_POINTS,
    timestamp: Column | None = None,
) -> DataFrame:
    """The nested recommendation for a whole table of orders.

    Orders carry the defaulted request fields and the looked-up history columns.
    """
    return recommendation(sweep(orders, scorer, coarse, fine), timestamp)
