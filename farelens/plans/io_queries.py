"""Queries that go through sources, sinks, validation and the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farelens.functions import clock
from farelens.operators import orders as ops
from farelens.operators import quality
from farelens.plans import oracle_views as o
from farelens.plans.data import Data
from farelens.plans.pricing_queries import FLAT_SQL, flat_recommendation
from farelens.plans.registry import query, rounded
from farelens.schema import BID_FIELDS, ORDER_FIELDS, RECOMMENDATION_DDL, UNREADABLE
from farelens.session import scratch_path
from farelens.sources import bids as bid_source
from farelens.sources import history as history_source
from farelens.sources import orders as order_source
from farelens.sources import predictions
from farelens.streaming.recommend import rejected_requests, stream_orders, stream_recommend

NOW = 1718558240


def _bids_csv(d: Data) -> str:
    path = scratch_path(d.spark, "bids")
    out = d.bids.select(*BID_FIELDS)
    out.write.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return path


_TIMES = ("order_timestamp", "tender_timestamp", "driver_reg_date")


@query(
    "scan_bids",
    "SELECT "
    + ", ".join(f"CAST(epoch({c}) AS BIGINT) AS {c}" if c in _TIMES else c for c in BID_FIELDS)
    + " FROM bids",
)
def _scan_bids(d: Data) -> DataFrame:
    read = bid_source.scan_bids(d.spark, _bids_csv(d))
    return read.select(
        *[F.unix_timestamp(c).alias(c) if c in _TIMES else F.col(c) for c in BID_FIELDS]
    )


@query(
    "scan_first_existing",
    f"SELECT platform, carname, count(*) AS n_rows, count(user_id) AS n_users, money(sum(price_bid_local)) AS total FROM bids GROUP BY platform, carname",
)
def _scan_first_existing(d: Data) -> DataFrame:
    absent = scratch_path(d.spark, "absent")
    read = bid_source.scan_first_existing(d.spark, [absent, _bids_csv(d)])
    return read.groupBy("platform", "carname").agg(
        F.count("*").alias("n_rows"),
        F.count("user_id").alias("n_users"),
        F.round(F.sum("price_bid_local"), 2).alias("total"),
    )


_UH = ("user_avg_bid", "user_avg_start_price", "user_acceptance_rate", "user_avg_price_ratio")


@query(
    "sink_history",
    f"SELECT user_id, user_order_count, user_done_count, {o.r(*_UH)} FROM uh",
)
def _sink_history(d: Data) -> DataFrame:
    folder = scratch_path(d.spark, "history")
    history_source.sink_history(d.bids, folder)
    users = d.spark.read.parquet(f"{folder}/user_history.parquet")
    return rounded(users.select("user_id", "user_order_count", "user_done_count", *_UH))


@query(
    "source_history",
    f"SELECT driver_id, driver_bid_count, {o.r('driver_avg_bid', 'driver_is_active')}, 0 AS n_absent FROM dh",
)
def _source_history(d: Data) -> DataFrame:
    """Both tables from a folder that has them; none from one that has not."""
    folder = scratch_path(d.spark, "history")
    history_source.sink_history(d.bids, folder)
    _, drivers = history_source.source_history(d.spark, folder)
    _, nothing = history_source.source_history(d.spark, scratch_path(d.spark, "absent"))
    absent = nothing.agg(F.count("*").alias("n")).scalar()
    out = drivers.select("driver_id", "driver_bid_count", "driver_avg_bid", "driver_is_active")
    return rounded(out.withColumn("n_absent", absent.cast("int")))


@query(
    "refresh_history",
    "SELECT CAST(user_is_vip AS INT) AS vip, count(*) AS n_users, round(sum(user_avg_bid), 4) AS total FROM uh GROUP BY user_is_vip",
)
def _refresh_history(d: Data) -> DataFrame:
    folder, paths = scratch_path(d.spark, "history"), [_bids_csv(d)]
    history_source.refresh_history(d.spark, folder, paths)
    history_source.refresh_history(d.spark, folder, paths, force=True)
    users, _ = history_source.source_history(d.spark, folder)
    return users.groupBy(F.col("user_is_vip").cast("int").alias("vip")).agg(
        F.count("*").alias("n_users"), F.round(F.sum("user_avg_bid"), 4).alias("total")
    )


# -- label files ------------------------------------------------------------

_LABEL_SQL = "CASE WHEN data_quality_index >= 0.5 THEN 'done' ELSE 'cancel' END"


def _labelled(d: Data) -> DataFrame:
    scored = quality.with_quality(d.scored_bids)
    return scored.withColumn("is_done", quality.quality_label())


@query("sink_predictions", f"SELECT {_LABEL_SQL} AS is_done FROM quality")
def _sink_predictions(d: Data) -> DataFrame:
    path = scratch_path(d.spark, "labels")
    predictions.sink_predictions(d.quality.withColumn("is_done", quality.quality_label()), path)
    return predictions.source_predictions(d.spark, path)


@query(
    "sink_predictions_detailed",
    f"SELECT {_LABEL_SQL} AS is_done, {o.r('probability', 'data_quality_index')} FROM score_rows",
)
def _sink_predictions_detailed(d: Data) -> DataFrame:
    path = scratch_path(d.spark, "labels")
    predictions.sink_predictions_detailed(_labelled(d), path)
    return rounded(predictions.source_predictions(d.spark, path, detailed=True))


@query("verify_sink", f"SELECT {_LABEL_SQL} AS is_done, count(*) AS n_rows FROM quality GROUP BY 1")
def _verify_sink(d: Data) -> DataFrame:
    path = scratch_path(d.spark, "labels")
    predictions.sink_predictions(d.quality.withColumn("is_done", quality.quality_label()), path)
    return predictions.verify_sink(d.spark, path)


# -- orders -----------------------------------------------------------------

_ORDER = ("order_id", *ORDER_FIELDS)


@query("source_orders", f"SELECT {', '.join(_ORDER)} FROM ord")
def _source_orders(d: Data) -> DataFrame:
    path = scratch_path(d.spark, "orders")
    d.orders.write.json(path)
    return order_source.source_orders(d.spark, path).select(*_ORDER)


@query("coerce_order", f"SELECT {', '.join(c for c in _ORDER if c != 'carmodel')}, NULL::VARCHAR AS carmodel FROM ord")
def _coerce_order(d: Data) -> DataFrame:
    """Text for all fields and no car model at all."""
    raw = d.orders.drop("carmodel")
    texts = raw.select("order_id", *[F.col(c).cast("string") for c in raw.columns if c != "order_id"])
    return ops.coerce_order(texts).select(*_ORDER)


@query("order_defaults", f"SELECT {', '.join(_ORDER)}, tender_timestamp FROM filled")
def _order_defaults(d: Data) -> DataFrame:
    return ops.order_defaults(d.orders).select(*_ORDER, "tender_timestamp")


_HOLED = "CASE WHEN order_id % 7 = 0 THEN NULL ELSE duration_in_seconds END"


@query(
    "require_fields",
    f"""SELECT order_id, CASE WHEN {_HOLED} IS NULL THEN 'duration_in_seconds' ELSE '' END AS missing FROM ord""",
)
def _require_fields(d: Data) -> DataFrame:
    holed = d.orders.withColumn("duration_in_seconds", F.expr(_HOLED))
    good, bad = ops.require_fields(holed)
    accepted = good.select("order_id", F.lit("").alias("missing"))
    return accepted.unionByName(
        bad.select("order_id", F.array_join("missing_fields", ",").alias("missing"))
    )


@query(
    "validate_orders",
    """SELECT order_id, concat_ws(',', CASE WHEN pickup_in_seconds - 5 < 0 THEN 'pickup_in_seconds' END,
 CASE WHEN driver_rating IS NULL OR driver_rating NOT BETWEEN 1 AND 5 THEN 'driver_rating' END,
 CASE WHEN platform NOT IN ('android', 'ios', 'web') THEN 'platform' END) AS errors FROM (
  SELECT * REPLACE (CASE WHEN order_id % 13 = 0 THEN 'desktop' ELSE platform END AS platform) FROM ord ) altered""",
)
def _validate_orders(d: Data) -> DataFrame:
    """Orders with some negative times, absent ratings and unknown platforms."""
    altered = d.orders.withColumns(
        {
            "pickup_in_seconds": F.col("pickup_in_seconds") - 5,
            "platform": F.when(F.col("order_id") % 13 == 0, "desktop").otherwise(F.col("platform")),
        }
    )
    good, bad = ops.validate_orders(altered)
    accepted = good.select("order_id", F.lit("").alias("errors"))
    return accepted.unionByName(bad.select("order_id", F.array_join("errors", ",").alias("errors")))


@query(
    "order_time_normalize",
    f"""SELECT order_id, CASE order_id % 4 WHEN 0 THEN order_timestamp WHEN 1 THEN order_timestamp ELSE {NOW} END AS order_timestamp FROM ord""",
)
def _order_time_normalize(d: Data) -> DataFrame:
    """Times as fractional seconds, as a date text, unreadable, or absent."""
    raw = (
        F.when(F.col("order_id") % 4 == 0, F.concat(F.col("order_timestamp").cast("string"), F.lit(".75")))
        .when(
            F.col("order_id") % 4 == 1,
            F.date_format(F.timestamp_seconds("order_timestamp"), "yyyy-MM-dd HH:mm:ss"),
        )
        .when(F.col("order_id") % 4 == 2, "soon")
    )
    return d.orders.select(
        "order_id", clock.order_epoch(raw, F.lit(NOW).cast("bigint")).alias("order_timestamp")
    )


# -- recommendations out and in ---------------------------------------------


@query("sink_recommendation_json", FLAT_SQL)
def _sink_recommendation_json(d: Data) -> DataFrame:
    path = scratch_path(d.spark, "recommendations")
    order_source.sink_recommendation_json(d.recommended, path)
    return flat_recommendation(d.spark.read.schema(RECOMMENDATION_DDL).json(path))


@query(
    "validate_recommendation",
    """SELECT rule, CASE WHEN rule = 'optimal_price' THEN (SELECT count(*) FROM chosen WHERE price < 0 OR expected_value < 0)
 WHEN rule = 'fuel' THEN (SELECT count(*) FROM chosen WHERE fuel_cost < 0 OR fuel_liters < 0 OR distance_km < 0 OR min_profitable_price < 0)
 WHEN rule = 'optimal_percents' THEN (SELECT count(*) FROM chosen WHERE probability_percent NOT BETWEEN 0 AND 100 OR normalized_probability_percent NOT BETWEEN 0 AND 100)
 WHEN rule = 'max_probability' THEN (SELECT count(*) FROM chosen WHERE max_probability_percent NOT BETWEEN 0 AND 100 OR max_probability_price < 0)
 WHEN rule = 'start_price' THEN (SELECT count(*) FROM chosen WHERE price_start_local < 0)
 WHEN rule = 'scan_range' THEN (SELECT count(*) FROM chosen WHERE price_start_local < 0 OR scan_max < 0)
 WHEN rule = 'zone_ids' THEN (SELECT count(*) FROM chosen WHERE zone_id < 0)
 WHEN rule = 'zone_prices' THEN (SELECT count(DISTINCT order_id) FROM zones WHERE price_min < 0 OR price_max < 0)
 WHEN rule = 'zone_values' THEN (SELECT count(DISTINCT order_id) FROM zones WHERE avg_expected_value < 0)
 ELSE (SELECT count(DISTINCT order_id) FROM zones WHERE avg_probability_percent NOT BETWEEN 0 AND 100 OR avg_normalized_probability_percent NOT BETWEEN 0 AND 100) END AS n_broken
FROM (VALUES ('zone_prices'), ('zone_percents'), ('zone_values'), ('zone_ids'), ('optimal_price'), ('optimal_percents'), ('fuel'),
 ('start_price'), ('max_probability'), ('scan_range')) t(rule)""",
)
def _validate_recommendation(d: Data) -> DataFrame:
    return ops.recommendation_errors(d.recommended)


@query("stream_recommend", FLAT_SQL)
def _stream_recommend(d: Data) -> DataFrame:
    """All orders as JSON files through the stream; default rating where absent."""
    incoming = scratch_path(d.spark, "incoming")
    rated = d.kept_orders.withColumn("driver_rating", F.coalesce("driver_rating", F.lit(5.0)))
    rated.write.json(incoming)
    out, progress = scratch_path(d.spark, "priced"), scratch_path(d.spark, "progress")
    stream = stream_recommend(
        stream_orders(d.spark, incoming),
        d.users,
        d.drivers,
        d.scorer,
        out,
        progress,
        transform=flat_recommendation,
    )
    stream.awaitTermination()
    return d.spark.read.parquet(f"{out}/batch=*")


_STREAM_RULES = """CASE WHEN order_id % 17 = 3 THEN 'unreadable' END, CASE WHEN order_id % 17 = 3 THEN 'order_timestamp' END,
 CASE WHEN order_id % 17 = 3 THEN 'distance_in_meters' END, CASE WHEN order_id % 17 = 3 THEN 'duration_in_seconds' END,
 CASE WHEN order_id % 17 = 3 THEN 'pickup_in_meters' END, CASE WHEN order_id % 17 = 3 OR pickup_in_seconds - 5 < 0 THEN 'pickup_in_seconds' END,
 CASE WHEN order_id % 17 = 3 THEN 'price_start_local' END,
 CASE WHEN order_id % 17 = 3 OR driver_rating IS NULL OR driver_rating NOT BETWEEN 1 AND 5 THEN 'driver_rating' END,
 CASE WHEN order_id % 17 = 3 OR order_id % 13 = 0 THEN 'platform' END"""


@query(
    "stream_rejects",
    f"""SELECT order_id, errors = '' AS priced, errors FROM (SELECT order_id, concat_ws(',', {_STREAM_RULES}) AS errors FROM ord ) judged""",
)
def _stream_rejects(d: Data) -> DataFrame:
    """A stream with negative times, absent ratings, unknown platforms and torn lines: what was priced and what was not."""
    incoming = scratch_path(d.spark, "incoming")
    altered = d.kept_orders.withColumns(
        {
            "pickup_in_seconds": F.col("pickup_in_seconds") - 5,
            "platform": F.when(F.col("order_id") % 13 == 0, "desktop").otherwise(F.col("platform")),
        }
    )
    line = F.to_json(F.struct(*altered.columns))
    torn = F.concat(F.lit('{"order_id": '), F.col("order_id").cast("string"), F.lit(', "platform'))
    altered.select(F.when(F.col("order_id") % 17 == 3, torn).otherwise(line).alias("value")).write.text(incoming)
    out, progress = scratch_path(d.spark, "priced"), scratch_path(d.spark, "progress")
    stream = stream_recommend(stream_orders(d.spark, incoming), d.users, d.drivers, d.scorer, out, progress)
    stream.awaitTermination()
    priced = d.spark.read.parquet(f"{out}/batch=*").select("order_id", F.lit(True).alias("priced"), F.lit("").alias("errors"))
    refused = rejected_requests(d.spark, f"{out}_rejected")
    named = F.regexp_extract(UNREADABLE, r'"order_id": (\d+)', 1).try_cast("bigint")
    return priced.unionByName(
        refused.select(
            F.coalesce("order_id", named).alias("order_id"), F.lit(False).alias("priced"), F.array_join("errors", ",").alias("errors")
        )
    )
