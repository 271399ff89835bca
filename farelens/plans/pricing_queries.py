"""Queries over orders: candidate prices, zones, recommendations and quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farelens.functions import display
from farelens.functions.missing import num
from farelens.operators import grid_scoring, pricing, quotes
from farelens.plans import oracle_views as o
from farelens.plans.data import KEY, Data
from farelens.plans.registry import query, rounded
from farelens.sources.orders import as_recommendation_schema

# -- candidate prices -------------------------------------------------------


@query(
    "search_bounds",
    f"SELECT order_id, {o.r('reference_price', 'search_min', 'search_max')} FROM ranged",
)
def _search_bounds(d: Data) -> DataFrame:
    ranged = pricing.with_search_range(d.orders)
    return rounded(ranged.select("order_id", "reference_price", "search_min", "search_max"))


def _points(d: Data, n: int) -> DataFrame:
    ranged = pricing.with_search_range(d.orders)
    placed = pricing.spread_orders(ranged.select("order_id", "search_min", "search_max"))
    return pricing.price_points(placed, "search_min", "search_max", n)


@query(
    "price_grid",
    """SELECT order_id, count(*) AS n_points, round(min(price), 6) AS lowest, round(max(price), 6) AS highest,
 round(sum(price), 4) AS total FROM coarse GROUP BY order_id""",
)
def _price_grid(d: Data) -> DataFrame:
    out = _points(d, pricing.COARSE_POINTS).groupBy("order_id").agg(
        F.count("*").alias("n_points"),
        F.round(F.min("price"), 6).alias("lowest"),
        F.round(F.max("price"), 6).alias("highest"),
        F.round(F.sum("price"), 4).alias("total"),
    )
    return out


@query(
    "union_grid",
    """SELECT order_id, count(*) AS n_points, round(sum(price), 4) AS total
FROM (SELECT order_id, price FROM coarse UNION ALL SELECT order_id, price FROM fine ) together GROUP BY order_id""",
)
def _union_grid(d: Data) -> DataFrame:
    limited = pricing.with_scan_limit(d.prepared, d.scorer)
    low, high = limited.select("order_id", "search_min", "search_max"), limited
    coarse = pricing.price_points(low, "search_min", "search_max", pricing.COARSE_POINTS)
    fine = pricing.price_points(high, "search_min", "scan_max", pricing.FINE_POINTS)
    together = coarse.select("order_id", "price").unionByName(fine.select("order_id", "price"))
    return together.groupBy("order_id").agg(
        F.count("*").alias("n_points"), F.round(F.sum("price"), 4).alias("total")
    )


@query(
    "score_logistic",
    """SELECT order_id, round(min(probability), 6) AS lowest, round(max(probability), 6) AS highest,
 round(sum(probability), 5) AS total FROM coarse GROUP BY order_id""",
)
def _score_logistic(d: Data) -> DataFrame:
    ranged = pricing.with_search_range(d.scorer.prepare(d.prepared))
    columns = ["order_id", "reference_price", "search_min", "search_max", *d.scorer.inputs]
    placed = pricing.spread_orders(ranged.select(*columns))
    points = pricing.price_points(placed, "search_min", "search_max", pricing.COARSE_POINTS)
    return d.scorer.score(points).groupBy("order_id").agg(
        F.round(F.min("probability"), 6).alias("lowest"),
        F.round(F.max("probability"), 6).alias("highest"),
        F.round(F.sum("probability"), 5).alias("total"),
    )


@query("max_scan_price", f"SELECT order_id, {o.r('scan_max')} FROM limited")
def _max_scan_price(d: Data) -> DataFrame:
    limited = pricing.with_scan_limit(d.prepared, d.scorer)
    return rounded(limited.select("order_id", "scan_max"))


@query(
    "valid_price_mask",
    """SELECT order_id, CAST(count(*) FILTER (WHERE is_valid) AS BIGINT) AS n_valid,
 round(min(price) FILTER (WHERE is_valid), 6) AS lowest_valid, bool_or(price >= price_start_local) AS reaches_start
FROM fine GROUP BY order_id""",
)
def _valid_price_mask(d: Data) -> DataFrame:
    points = pricing.scored_points(pricing.with_scan_limit(d.prepared, d.scorer), d.scorer)
    out = points.groupBy("order_id").agg(
        F.count_if("is_valid").alias("n_valid"),
        F.min(F.when(F.col("is_valid"), F.col("price"))).alias("lowest_valid"),
        F.bool_or(F.col("price") >= F.col("price_start_local")).alias("reaches_start"),
    )
    return rounded(out)


@query(
    "price_curve",
    """SELECT order_id, count(*) AS n_points, round(sum(price), 4) AS price_total, round(sum(probability), 4) AS probability_total,
 round(sum(expected_value), 4) AS ev_total, round(sum(normalized_probability), 4) AS normalized_total,
 round(max(weighted_score) FILTER (WHERE is_valid), 6) AS best_score FROM curve GROUP BY order_id""",
)
def _price_curve(d: Data) -> DataFrame:
    totals = {
        "price_total": "price",
        "probability_total": "probability",
        "ev_total": "expected_value",
        "normalized_total": "normalized_probability",
    }
    best = F.max(F.when(F.col("is_valid"), F.col("weighted_score")))
    return d.curve.groupBy("order_id").agg(
        F.count("*").alias("n_points"),
        *[F.round(F.sum(c), 4).alias(n) for n, c in totals.items()],
        F.round(best, 6).alias("best_score"),
    )


@query(
    "prob_normalize",
    """SELECT order_id, round(min(normalized_probability), 6) AS lowest, round(max(normalized_probability), 6) AS highest,
 round(sum(normalized_probability), 4) AS total FROM curve GROUP BY order_id""",
)
def _prob_normalize(d: Data) -> DataFrame:
    value = "normalized_probability"
    return d.curve.groupBy("order_id").agg(
        F.round(F.min(value), 6).alias("lowest"),
        F.round(F.max(value), 6).alias("highest"),
        F.round(F.sum(value), 4).alias("total"),
    )


@query(
    "ev_normalize",
    """SELECT order_id, round(min(normalized_ev), 6) AS lowest, round(max(normalized_ev), 6) AS highest,
 round(sum(normalized_ev), 4) AS total FROM curve WHERE is_valid GROUP BY order_id""",
)
def _ev_normalize(d: Data) -> DataFrame:
    return d.curve.filter("is_valid").groupBy("order_id").agg(
        F.round(F.min("normalized_ev"), 6).alias("lowest"),
        F.round(F.max("normalized_ev"), 6).alias("highest"),
        F.round(F.sum("normalized_ev"), 4).alias("total"),
    )


@query(
    "optimal_price",
    f"SELECT order_id, {o.r('price', 'probability', 'normalized_probability', 'expected_value')} FROM best",
)
def _optimal_price(d: Data) -> DataFrame:
    price, p = F.col("optimal_price"), F.col("optimal_probability")
    out = d.swept.select(
        "order_id",
        price.alias("price"),
        p.alias("probability"),
        pricing.normalized(p).alias("normalized_probability"),
        (price * p).alias("expected_value"),
    )
    return rounded(out)


@query("max_prob_price", f"SELECT order_id, {o.r('max_probability_price')} FROM likeliest")
def _max_prob_price(d: Data) -> DataFrame:
    return rounded(d.swept.select("order_id", "max_probability_price"))


@query("max_probability", f"SELECT order_id, {o.r('max_probability')} FROM maxima")
def _max_probability(d: Data) -> DataFrame:
    limited = pricing.with_scan_limit(d.prepared, d.scorer)
    maxima = pricing.with_maxima(limited, d.scorer)
    return rounded(maxima.select("order_id", "max_probability"))


# -- zones ------------------------------------------------------------------


@query(
    "zone_band_join",
    """SELECT order_id, band, count(*) AS n_points, round(min(price), 6) AS lowest, round(max(price), 6) AS highest
FROM curve WHERE is_valid AND band IS NOT NULL GROUP BY order_id, band""",
)
def _zone_band_join(d: Data) -> DataFrame:
    inside = d.curve.filter(F.col("is_valid") & F.col("band").isNotNull())
    return inside.groupBy("order_id", "band").agg(
        F.count("*").alias("n_points"),
        F.round(F.min("price"), 6).alias("lowest"),
        F.round(F.max("price"), 6).alias("highest"),
    )


def _zone_rows(d: Data) -> DataFrame:
    rows = d.recommended.select("order_id", F.posexplode("zones").alias("at", "z"))
    return rows.select(
        "order_id",
        (F.col("at") + 1).alias("position"),
        "z.zone_id",
        "z.zone_name",
        F.col("z.price_range.min").alias("price_min"),
        F.col("z.price_range.max").alias("price_max"),
        "z.metrics.*",
    )


_ZONE_VALUES = (
    "price_min", "price_max", "avg_probability_percent",
    "avg_normalized_probability_percent", "avg_expected_value",
)


@query("zone_metrics", f"SELECT order_id, zone_id, zone_name, {', '.join(_ZONE_VALUES)} FROM zones")
def _zone_metrics(d: Data) -> DataFrame:
    return _zone_rows(d).select("order_id", "zone_id", "zone_name", *_ZONE_VALUES)


@query("zones_by_price", "SELECT order_id, CAST(position AS INT) AS position, zone_id FROM zones")
def _zones_by_price(d: Data) -> DataFrame:
    return _zone_rows(d).select("order_id", "position", "zone_id")


@query(
    "zones_by_id",
    "SELECT order_id, CAST(row_number() OVER (PARTITION BY order_id ORDER BY zone_id) AS INT) AS position, zone_id, price_min FROM zones",
)
def _zones_by_id(d: Data) -> DataFrame:
    by_id = F.array_sort(
        F.transform(
            "zones",
            lambda z: F.struct(
                z["zone_id"].alias("zone_id"), z["price_range"]["min"].alias("price_min")
            ),
        )
    )
    rows = d.recommended.select("order_id", F.posexplode(by_id).alias("at", "z"))
    return rows.select(
        "order_id", (F.col("at") + 1).alias("position"), "z.zone_id", "z.price_min"
    )


@query("optimal_zone_fallback", "SELECT order_id, zone_id FROM chosen")
def _optimal_zone_fallback(d: Data) -> DataFrame:
    return d.recommended.select("order_id", F.col("optimal_price.zone_id").alias("zone_id"))


_LABEL_SQL = """CASE WHEN zone_name LIKE '%green%' THEN 'Зелёная зона' WHEN zone_name LIKE '%yellow_low%' THEN 'Жёлтая зона (низкая)'
 WHEN zone_name LIKE '%yellow_high%' THEN 'Жёлтая зона (высокая)' WHEN zone_name LIKE '%red%' THEN 'Красная зона' ELSE zone_name END"""
_COLOR_SQL = """CASE WHEN zone_name LIKE '%green%' THEN 'green' WHEN zone_name LIKE '%yellow%' THEN 'yellow'
 WHEN zone_name LIKE '%red%' THEN 'red' ELSE 'green' END"""


@query("zone_color", f"SELECT order_id, zone_id, {_COLOR_SQL} AS color FROM zones")
def _zone_color(d: Data) -> DataFrame:
    color = display.zone_color(F.col("zone_name"))
    return _zone_rows(d).select("order_id", "zone_id", color.alias("color"))


@query("zone_label", f"SELECT order_id, zone_id, {_LABEL_SQL} AS label FROM zones")
def _zone_label(d: Data) -> DataFrame:
    label = display.zone_label(F.col("zone_name"))
    return _zone_rows(d).select("order_id", "zone_id", label.alias("label"))


@query(
    "optimal_zone_lookup",
    f"""SELECT c.order_id, c.zone_id, coalesce(z.label, 'N/A') AS label, coalesce(z.color, 'green') AS color
FROM chosen c LEFT JOIN (SELECT order_id, zone_id, {_LABEL_SQL} AS label, {_COLOR_SQL} AS color FROM zones ) z
 ON c.order_id = z.order_id AND c.zone_id = z.zone_id""",
)
def _optimal_zone_lookup(d: Data) -> DataFrame:
    return quotes.optimal_zone_lookup(d.recommended)


@query(
    "zone_report",
    """SELECT c.order_id, p.zone_id, p.label, p.color, z.zone_id IS NOT NULL AS is_present, z.price_min, z.price_max,
 z.avg_probability_percent AS probability_percent, z.avg_expected_value AS expected_value,
 z.avg_normalized_probability_percent AS normalized_percent,
 CASE WHEN z.zone_id IS NULL THEN CASE WHEN l.high IS NOT NULL AND p.zone_id < 3
  THEN '>' || CAST(CAST(round(l.high, 0) AS BIGINT) AS VARCHAR) || '₽' ELSE '—' END END AS price_hint,
 CASE WHEN z.zone_id IS NULL THEN p.note END AS note
FROM chosen c CROSS JOIN (VALUES (3, 'Зелёная зона', 'green', '≥70% вероятность'), (2, 'Жёлтая зона (низкая)', 'yellow', '50-70% вероятность'),
  (4, 'Жёлтая зона (высокая)', 'yellow', '30-50% вероятность'), (1, 'Красная зона', 'red', '<30% вероятность')) p(zone_id, label, color, note)
LEFT JOIN zones z ON c.order_id = z.order_id AND p.zone_id = z.zone_id
LEFT JOIN (SELECT order_id, arg_max(price_max, zone_id) AS high FROM zones GROUP BY order_id) l ON c.order_id = l.order_id""",
)
def _zone_report(d: Data) -> DataFrame:
    return quotes.zone_report(d.recommended)


# -- recommendations --------------------------------------------------------

_FLAT = (
    "price", "probability_percent", "normalized_probability_percent", "expected_value",
    "net_profit", "fuel_cost", "fuel_liters", "distance_km", "min_profitable_price",
    "max_probability_percent", "max_probability_price",
)
FLAT_SQL = f"""SELECT c.order_id, {', '.join('c.' + n for n in _FLAT)}, c.zone_id,
 money(c.price_start_local) AS scan_low, money(c.scan_max) AS scan_high,
 coalesce(z.described, '') AS zones
FROM chosen c LEFT JOIN (SELECT order_id, string_agg(zone_id || ':' || CAST(CAST(round(price_min * 100, 0) AS BIGINT) AS VARCHAR)
  || '-' || CAST(CAST(round(price_max * 100, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY position) AS described FROM zones GROUP BY order_id) z
 ON c.order_id = z.order_id"""


def flat_recommendation(df: DataFrame) -> DataFrame:
    """The nested record as plain columns; zones as text in hundredths."""

    def cents(c):
        return F.round(c * 100, 0).cast("bigint").cast("string")

    described = F.transform(
        "zones",
        lambda z: F.concat(
            z["zone_id"].cast("string"),
            F.lit(":"),
            cents(z["price_range"]["min"]),
            F.lit("-"),
            cents(z["price_range"]["max"]),
        ),
    )
    return df.select(
        "order_id",
        "optimal_price.*",
        *[
            f"fuel_economics.{c}"
            for c in ("fuel_cost", "fuel_liters", "distance_km", "min_profitable_price")
        ],
        "analysis.max_probability_percent",
        "analysis.max_probability_price",
        F.col("analysis.scan_range.min").alias("scan_low"),
        F.col("analysis.scan_range.max").alias("scan_high"),
        F.array_join(described, ",").alias("zones"),
    )


@query("recommend_batch", FLAT_SQL)
def _recommend_batch(d: Data) -> DataFrame:
    return flat_recommendation(d.recommended)


@query("score_external", FLAT_SQL)
def _score_external(d: Data) -> DataFrame:
    """Recommendations by a scorer that the session's setting names."""
    d.spark.conf.set(grid_scoring.SCORER_SETTING, "farelens.operators.grid_scoring:logistic")
    try:
        scorer = grid_scoring.configured_scorer(d.spark)
    finally:
        d.spark.conf.unset(grid_scoring.SCORER_SETTING)
    return flat_recommendation(pricing.recommend_batch(d.prepared, scorer))


@query("result_coercion", FLAT_SQL)
def _result_coercion(d: Data) -> DataFrame:
    return flat_recommendation(as_recommendation_schema(d.recommended))


@query(
    "fuel_economics",
    """SELECT order_id, fuel_cost, fuel_liters, distance_km, 55e0 AS fuel_price_per_liter, 9e0 AS consumption_per_100km,
 min_profitable_price, net_profit AS net_profit_from_optimal FROM chosen""",
)
def _fuel_economics(d: Data) -> DataFrame:
    return d.recommended.select("order_id", "fuel_economics.*")


@query(
    "scan_analysis",
    """SELECT order_id, price_start_local AS start_price, max_probability_percent, max_probability_price,
 money(price_start_local) AS scan_low, money(scan_max) AS scan_high FROM chosen""",
)
def _scan_analysis(d: Data) -> DataFrame:
    return d.recommended.select(
        "order_id",
        "analysis.start_price",
        "analysis.max_probability_percent",
        "analysis.max_probability_price",
        F.col("analysis.scan_range.min").alias("scan_low"),
        F.col("analysis.scan_range.max").alias("scan_high"),
    )


@query(
    "zone_thresholds",
    "SELECT order_id, "
    + ", ".join(f"'{t}' AS {n}" for n, t in pricing.ZONE_THRESHOLDS.items())
    + " FROM ord",
)
def _zone_thresholds(d: Data) -> DataFrame:
    record = d.orders.select("order_id", pricing.zone_thresholds().alias("t"))
    return record.select("order_id", "t.*")


@query("run_timestamp")
def _run_timestamp(d: Data) -> DataFrame:
    return d.recommended.select("order_id", "analysis.timestamp")


@query(
    "enrich_recommendation",
    """SELECT c.order_id, CAST(CASE WHEN c.order_id % 3 = 0 THEN 0 ELSE count(z.zone_id) END AS INT) AS n_zones, 0 AS n_recommendations
FROM chosen c LEFT JOIN zones z ON c.order_id = z.order_id GROUP BY c.order_id""",
)
def _enrich_recommendation(d: Data) -> DataFrame:
    """Every third record arrives without its zone list."""
    holed = d.recommended.withColumn("zones", F.when(F.col("order_id") % 3 != 0, F.col("zones")))
    return quotes.enrich(holed).select(
        "order_id",
        F.size("zones").alias("n_zones"),
        F.size("recommendations").alias("n_recommendations"),
    )


# -- axis and quotes --------------------------------------------------------


@query("axis_bounds", f"SELECT order_id, {o.r('axis_min', 'axis_max', 'axis_step')} FROM axis")
def _axis_bounds(d: Data) -> DataFrame:
    return rounded(d.axis.select("order_id", "axis_min", "axis_max", "axis_step"))


@query("axis_mid", "SELECT order_id, round((axis_min + axis_max) / 2, 6) AS axis_mid FROM axis")
def _axis_mid(d: Data) -> DataFrame:
    return rounded(d.axis.select("order_id", "axis_mid"))


def asked_prices(axis: DataFrame) -> DataFrame:
    """Several prices per order: around, inside and between the zones."""
    low, high = F.col("axis_min"), F.col("axis_max")
    zones = F.col("zones")
    first, second = F.get(zones, F.lit(0)), F.get(zones, F.lit(1))
    last = F.get(zones, F.size(zones) - 1)
    gap = (first["price_range"]["max"] + second["price_range"]["min"]) / 2
    probes = {
        "below": low - 20,
        "low": low,
        "mid": F.col("axis_mid"),
        "best": F.col("optimal_price.price"),
        "gap": gap,
        "beyond": last["price_range"]["max"] + 30,
        "high": high,
    }
    listed = F.array(*[F.struct(F.lit(n).alias("probe"), p.alias("ask")) for n, p in probes.items()])
    return axis.select("*", F.inline(listed)).filter(F.col("ask").isNotNull())


def _quoted(d: Data) -> DataFrame:
    return quotes.quote(asked_prices(d.axis), "ask")


_ASK = "round(ask, 6) + 0e0 AS ask"


@query("quote_zone_lookup", f"SELECT order_id, probe, {_ASK}, zone_id FROM quoted")
def _quote_zone_lookup(d: Data) -> DataFrame:
    located = quotes.with_neighbours(quotes.with_zone_at(asked_prices(d.axis), "ask"))
    return rounded(located.select("order_id", "probe", "ask", "zone_at.zone_id"))


@query(
    "zone_neighbours",
    f"SELECT order_id, probe, {o.r('previous_chance', 'next_chance')} FROM quoted",
)
def _zone_neighbours(d: Data) -> DataFrame:
    located = quotes.with_neighbours(quotes.with_zone_at(asked_prices(d.axis), "ask"))
    return rounded(located.select("order_id", "probe", "previous_chance", "next_chance"))


@query(
    "quote_probability",
    f"SELECT order_id, probe, {_ASK}, {o.r('quote_probability')} FROM quoted WHERE place = 'inside'",
)
def _quote_probability(d: Data) -> DataFrame:
    inside = _quoted(d).filter(F.col("zone_index").isNotNull())
    return rounded(inside.select("order_id", "probe", "ask", "quote_probability"))


@query(
    "quote_tail",
    f"""SELECT order_id, probe, {_ASK}, {o.r('quote_probability')}, CASE WHEN place = 'tail' THEN 'red' ELSE 'green' END AS quote_color
FROM quoted WHERE place <> 'inside'""",
)
def _quote_tail(d: Data) -> DataFrame:
    outside = _quoted(d).filter(F.col("zone_index").isNull())
    return rounded(
        outside.select("order_id", "probe", "ask", "quote_probability", "quote_color")
    )


@query(
    "quote_ev",
    "SELECT order_id, probe, "
    + o.exact(
        "CASE place WHEN 'inside' THEN greatest(0e0, ask * (quote_probability / 100))"
        " WHEN 'tail' THEN ask * (quote_probability / 100) ELSE optimal_ev END",
        6,
    )
    + " AS quote_ev FROM quoted",
)
def _quote_ev(d: Data) -> DataFrame:
    return rounded(_quoted(d).select("order_id", "probe", "quote_ev"))


@query(
    "zone_filter",
    f"""SELECT z.order_id, z.zone_id, z.price_min, z.price_max FROM zones z JOIN axis a ON z.order_id = a.order_id
WHERE z.price_min >= a.axis_min AND z.price_max <= a.axis_max AND z.price_min < z.price_max""",
)
def _zone_filter(d: Data) -> DataFrame:
    low, high = F.col("axis_min"), F.col("axis_max")
    kept = F.filter(
        "zones",
        lambda z: (z["price_range"]["min"] >= low)
        & (z["price_range"]["max"] <= high)
        & (z["price_range"]["min"] < z["price_range"]["max"]),
    )
    rows = d.axis.select("order_id", F.explode(kept).alias("z"))
    return rows.select(
        "order_id",
        "z.zone_id",
        F.col("z.price_range.min").alias("price_min"),
        F.col("z.price_range.max").alias("price_max"),
    )


@query(
    "zone_gaps",
    f"""SELECT z.order_id, z.price_min AS segment_min, round(z.price_max, 6) AS segment_max, {_COLOR_SQL} AS color, FALSE AS is_gap
FROM zones z JOIN axis a ON z.order_id = a.order_id
WHERE z.price_min >= a.axis_min AND z.price_max <= a.axis_max AND z.price_min < z.price_max
UNION ALL SELECT order_id, zones_max, round(axis_max, 6), 'red', TRUE FROM axis WHERE zones_max < axis_max""",
)
def _zone_gaps(d: Data) -> DataFrame:
    return rounded(quotes.zone_segments(d.axis))


@query(
    "snap_to_step",
    "SELECT order_id, round(greatest(axis_min, least(axis_max, floor(price / axis_step + 0.5e0) * axis_step)), 6) AS snapped FROM axis",
)
def _snap_to_step(d: Data) -> DataFrame:
    snapped = display.snap_to_step(
        F.col("optimal_price.price"), F.col("axis_step"), F.col("axis_min"), F.col("axis_max")
    )
    return rounded(d.axis.select("order_id", snapped.alias("snapped")))


@query(
    "eta_minutes",
    f"""SELECT {o.KEY}, CAST(CASE WHEN pickup_in_seconds > 0 THEN floor(pickup_in_seconds / 60e0 + 0.5e0)
  WHEN pickup_in_meters > 0 THEN floor(pickup_in_meters / 1000e0 * 120 / 60 + 0.5e0) ELSE 2 END AS BIGINT) AS pickup_minutes,
 CAST(CASE WHEN duration_in_seconds > 0 THEN floor(duration_in_seconds / 60e0 + 0.5e0)
  WHEN distance_in_meters > 0 THEN floor(distance_in_meters / 1000e0 * 120 / 60 + 0.5e0) ELSE 25 END AS BIGINT) AS trip_minutes FROM bids""",
)
def _eta_minutes(d: Data) -> DataFrame:
    pickup = display.eta_minutes(num("pickup_in_seconds"), num("pickup_in_meters"), 2)
    trip = display.eta_minutes(num("duration_in_seconds"), num("distance_in_meters"), 25)
    return d.bids.select(*KEY, pickup.alias("pickup_minutes"), trip.alias("trip_minutes"))


@query(
    "margin_band",
    """SELECT order_id, net_profit, CASE WHEN net_profit > fuel_cost * 2 THEN 'green' WHEN net_profit > fuel_cost THEN 'yellow' ELSE 'red' END AS color,
 CASE WHEN expected_value <> 0 THEN round(net_profit / expected_value * 100, 6) + 0e0 END AS margin_percent
FROM (SELECT * REPLACE (coalesce(nullif(net_profit, 0), expected_value - fuel_cost) AS net_profit) FROM chosen ) c""",
)
def _margin_band(d: Data) -> DataFrame:
    return rounded(quotes.margin_band(d.recommended))


@query(
    "max_prob_ev",
    """SELECT order_id, round(price, 0) AS optimal_price, round(probability_percent, 0) AS optimal_percent, round(expected_value, 0) AS optimal_ev,
 round(max_probability_price, 0) AS max_prob_price, round(max_probability_percent, 0) AS max_prob_percent,
 round(round(max_probability_price, 0) * round(max_probability_percent, 0) / 100, 0) AS max_prob_ev FROM chosen""",
)
def _max_prob_ev(d: Data) -> DataFrame:
    return quotes.max_prob_ev(d.recommended)
