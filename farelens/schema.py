"""Fixed schemas of the records the engine reads and writes."""

from __future__ import annotations


BID_TIMES = ("order_timestamp", "tender_timestamp", "driver_reg_date")

# One row is one driver's bid on a passenger's order.
BID_FIELDS = {
    "order_id": "bigint",
    "user_id": "bigint",
    "driver_id": "bigint",
    "order_timestamp": "timestamp",
    "tender_timestamp": "timestamp",
    "driver_reg_date": "timestamp",
    "distance_in_meters": "bigint",
    "duration_in_seconds": "bigint",
    "pickup_in_meters": "bigint",
    "pickup_in_seconds": "bigint",
    "driver_rating": "double",
    "carname": "string",
    "carmodel": "string",
    "platform": "string",
    "price_start_local": "double",
    "price_bid_local": "double",
    "is_done": "string",
}

# Columns a bid file must carry for labelling; the label and order id may be absent.
REQUIRED_BID_COLUMNS = tuple(c for c in BID_FIELDS if c not in ("order_id", "is_done"))

PLATFORMS = ("android", "ios", "web")

ORDER_FIELDS = {
    "order_timestamp": "bigint",
    "distance_in_meters": "bigint",
    "duration_in_seconds": "bigint",
    "pickup_in_meters": "bigint",
    "pickup_in_seconds": "bigint",
    "driver_rating": "double",
    "platform": "string",
    "price_start_local": "double",
    "carname": "string",
    "carmodel": "string",
    "driver_reg_date": "string",
    "user_id": "bigint",
    "driver_id": "bigint",
}

REQUIRED_ORDER_COLUMNS = (
    "order_timestamp",
    "distance_in_meters",
    "duration_in_seconds",
    "pickup_in_meters",
    "pickup_in_seconds",
    "price_start_local",
)

ORDER_DDL = "order_id bigint, " + ", ".join(f"{k} {v}" for k, v in ORDER_FIELDS.items())

# Holds a record's own text where it does not have the declared form, else null.
UNREADABLE = "unreadable"

USER_HISTORY_FIELDS = {
    "user_id": "bigint",
    "user_order_count": "bigint",
    "user_done_count": "bigint",
    "user_avg_bid": "double",
    "user_avg_start_price": "double",
    "user_acceptance_rate": "double",
    "user_avg_price_ratio": "double",
    "user_is_new": "double",
    "user_is_vip": "double",
    "user_is_price_sensitive": "double",
}

DRIVER_HISTORY_FIELDS = {
    "driver_id": "bigint",
    "driver_bid_count": "bigint",
    "driver_done_count": "bigint",
    "driver_avg_bid": "double",
    "driver_avg_start_price": "double",
    "driver_acceptance_rate": "double",
    "driver_avg_bid_ratio": "double",
    "driver_is_active": "double",
    "driver_is_aggressive": "double",
    "driver_is_flexible": "double",
}


def history_ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in fields.items())


ZONE_DDL = (
    "struct<zone_id:int,zone_name:string,price_range:struct<min:double,max:double>,"
    "metrics:struct<avg_probability_percent:double,"
    "avg_normalized_probability_percent:double,avg_expected_value:double>>"
)

RECOMMENDATION_DDL = (
    f"order_id bigint, zones array<{ZONE_DDL}>, "
    "optimal_price struct<price:double,probability_percent:double,"
    "normalized_probability_percent:double,expected_value:double,zone_id:int,net_profit:double>, "
    "zone_thresholds struct<green_zone:string,yellow_low_zone:string,"
    "yellow_high_zone:string,red_zone:string>, "
    "fuel_economics struct<fuel_cost:double,fuel_liters:double,distance_km:double,"
    "fuel_price_per_liter:double,consumption_per_100km:double,min_profitable_price:double,"
    "net_profit_from_optimal:double>, "
    "analysis struct<start_price:double,max_probability_percent:double,"
    "max_probability_price:double,scan_range:struct<min:double,max:double>,timestamp:string>"
)
