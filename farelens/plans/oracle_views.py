"""Named SQL views that the oracle queries are put together from.

Plain DuckDB SQL, written independently of the Spark operators: joins, windows
and grids in brute force over the whole tables.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {}


def view(name: str, body: str) -> None:
    VIEWS[name] = money(body.strip())


def with_views(*names: str) -> str:
    """A WITH clause holding the named views and all they depend on, in order."""
    needed: set[str] = set()
    pending = list(names)
    while pending:
        name = pending.pop()
        if name in needed:
            continue
        needed.add(name)
        pending += [other for other in VIEWS if _mentions(VIEWS[name], other)]
    # Feature views are read once for the fitted values and once for the rows: computed once.
    kind = {name: "AS MATERIALIZED" if name == "feat" or name.startswith("imputed_") else "AS" for name in needed}
    listed = [f"{name} {kind[name]} (\n{VIEWS[name]}\n)" for name in VIEWS if name in needed]
    return "WITH " + ",\n".join(listed) + "\n"


def _mentions(body: str, name: str) -> bool:
    return f" {name} " in f" {body} ".replace("\n", " ").replace(",", " ").replace(")", " ")


def r(*names: str, digits: int = 6, prefix: str = "") -> str:
    """Rounded columns under their own names."""
    return ", ".join(f"{exact(prefix + n, digits)} AS {n}" for n in names)


def _closing(text: str, at: int) -> int:
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return i
    raise ValueError(text)


def exact(value: str, digits: int) -> str:
    """Rounding of the digits as they are written, half up.

    DuckDB's own rounding of a DOUBLE multiplies first, which turns 1.00499... into
    a tie; going through text does not.
    """
    return f"CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


def money(sql: str) -> str:
    """Spell out each ``money(x)``: rounding to two decimals."""
    while (start := sql.rfind("money(")) >= 0:
        end = _closing(sql, start + len("money"))
        inner = sql[start + len("money(") : end]
        sql = sql[:start] + exact(inner, 2) + sql[end + 1 :]
    return sql


KEY = "order_id, copy_no, line_no, driver_id, part_id, ext"

view(
    "v_base",
    """
SELECT l.l_orderkey AS order_id, l.l_suppkey AS driver_id,
 CASE WHEN o.o_custkey % 97 = 0 THEN NULL ELSE o.o_custkey END AS user_id,
 l.l_linenumber AS line_no, l.l_partkey AS part_id, l.l_discount AS disc, l.l_extendedprice AS ext,
 CAST(o.o_orderdate AS TIMESTAMP) + INTERVAL '1' SECOND * ((l.l_orderkey*7919) % 86400) AS order_timestamp,
 CASE WHEN l.l_orderkey % 101 = 0 THEN 0 WHEN l.l_orderkey % 67 = 5 THEN 10*(300+(l.l_orderkey*7919) % 24000) ELSE 300+(l.l_orderkey*7919) % 24000 END AS distance_in_meters,
 CASE WHEN l.l_orderkey % 103 = 1 THEN 0 WHEN l.l_orderkey % 71 = 3 THEN 4*(30+(l.l_orderkey*104729) % 3600) ELSE 30+(l.l_orderkey*104729) % 3600 END AS duration_in_seconds,
 (l.l_suppkey*613+l.l_orderkey*17) % 3500 AS pickup_in_meters,
 (l.l_suppkey*37+l.l_linenumber*59+l.l_orderkey) % 600 AS pickup_in_seconds,
 CASE WHEN l.l_suppkey % 29 = 0 THEN NULL ELSE 5e0-(l.l_suppkey % 8)/10e0 END AS driver_rating,
 CAST(DATE '1993-01-01' + INTERVAL '1' DAY * ((l.l_suppkey*53) % 2600) AS TIMESTAMP) AS driver_reg_date,
 CASE l.l_suppkey % 8 WHEN 0 THEN 'LADA' WHEN 1 THEN 'LADA' WHEN 2 THEN 'Toyota' WHEN 3 THEN 'Renault' WHEN 4 THEN 'Hyundai' WHEN 5 THEN 'Daewoo' WHEN 6 THEN 'Nissan' ELSE 'ВАЗ (LADA)' END AS carname,
 CASE l.l_suppkey % 8 WHEN 0 THEN 'GRANTA' WHEN 1 THEN 'Vesta' WHEN 2 THEN 'Camry' WHEN 3 THEN 'Logan' WHEN 4 THEN 'Solaris' WHEN 5 THEN 'Nexia' WHEN 6 THEN 'Qashqai' ELSE 'Приора' END AS carmodel,
 CASE l.l_orderkey % 5 WHEN 0 THEN 'ios' WHEN 1 THEN 'web' ELSE 'android' END AS platform,
 CASE WHEN l.l_returnflag = 'R' OR (l.l_returnflag = 'N' AND l.l_discount < 0.03) THEN 'done' ELSE 'cancel' END AS is_done
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
""",
)
view(
    "v_priced",
    """
SELECT *, order_timestamp + INTERVAL '1' SECOND * ((part_id*31+line_no*17) % 420 - 10) AS tender_timestamp,
 CASE WHEN order_id % 211 = 7 THEN 0e0 ELSE floor(90e0 + distance_in_meters*14e0/1000e0 + duration_in_seconds*5e0/60e0) END AS price_start_local
FROM v_base
""",
)
view(
    "v_bid",
    """
SELECT *, CASE WHEN part_id % 307 = 5 THEN 0e0 WHEN part_id % 41 = 0 THEN floor(price_start_local*25e0/10e0) ELSE floor(price_start_local*(1e0 + CAST(disc AS DOUBLE)*6e0)) END AS price_bid_local
FROM v_priced
""",
)
view(
    "bids",
    """
SELECT 0 AS copy_no, * FROM v_bid
UNION ALL SELECT 1 AS copy_no, * FROM v_bid WHERE order_id % 50 = 0
""",
)
view(
    "meas",
    """
SELECT *,
 (epoch_us(tender_timestamp) - epoch_us(order_timestamp)) / 1e6 AS response_time_seconds,
 CASE WHEN duration_in_seconds <> 0 THEN CAST(distance_in_meters AS DOUBLE) / duration_in_seconds * 3.6e0 END AS avg_speed_kmh,
 CASE WHEN pickup_in_seconds <> 0 THEN CAST(pickup_in_meters AS DOUBLE) / pickup_in_seconds * 3.6e0 END AS pickup_speed_kmh,
 CASE WHEN distance_in_meters <> 0 THEN CAST(pickup_in_meters AS DOUBLE) / distance_in_meters END AS pickup_ratio,
 CASE WHEN price_start_local <> 0 THEN (price_bid_local - price_start_local) / price_start_local * 100
      WHEN price_bid_local > 0 THEN CAST('inf' AS DOUBLE) WHEN price_bid_local < 0 THEN CAST('-inf' AS DOUBLE) END AS price_increase_pct
FROM bids
""",
)
CLEAN_FLAGS = {
    "zero_distance": "distance_in_meters <= 0",
    "zero_duration": "duration_in_seconds <= 0",
    "zero_price": "price_bid_local <= 0",
    "future_driver": "driver_reg_date > order_timestamp",
    "future_bid": "tender_timestamp < order_timestamp",
    "slow_response": "response_time_seconds > 300",
    "too_short_trip": "distance_in_meters < 500",
    "too_quick_trip": "duration_in_seconds < 60",
    "extreme_distance": "distance_in_meters > 100000",
    "extreme_duration": "duration_in_seconds > 7200",
    "too_fast_city": "avg_speed_kmh > 80",
    "physically_impossible": "duration_in_seconds < distance_in_meters / (120e0 / 3.6e0)",
    "too_slow": "avg_speed_kmh < 8",
    "extreme_pickup_ratio": "pickup_ratio > 5",
    "extreme_pickup_speed": "pickup_speed_kmh > 100",
    "extreme_markup": "price_increase_pct > 100",
    "extreme_price": "price_bid_local > 5000",
}
view(
    "marked",
    "SELECT *,\n"
    + ",\n".join(f" coalesce({p}, FALSE) AS {n}" for n, p in CLEAN_FLAGS.items())
    + """,
 row_number() OVER (PARTITION BY order_id, driver_id, price_bid_local, pickup_in_meters, tender_timestamp
   ORDER BY copy_no, line_no, driver_id, part_id, ext) > 1 AS exact_duplicate
FROM meas""",
)
ANY_FLAG = "(" + " OR ".join(CLEAN_FLAGS) + ")"

view(
    "soft",
    """
SELECT *,
 coalesce((epoch_us(tender_timestamp) - epoch_us(order_timestamp)) / 1e6, 30) AS s_response,
 coalesce(distance_in_meters / (duration_in_seconds + 0.1e0) * 3.6e0, 30) AS s_speed,
 coalesce(pickup_in_meters / (pickup_in_seconds + 0.1e0) * 3.6e0, 30) AS s_pickup_speed,
 coalesce(pickup_in_meters / (distance_in_meters + 0.1e0), 0.5e0) AS s_pickup_ratio,
 coalesce((price_bid_local - price_start_local) / (price_start_local + 0.1e0) * 100, 0) AS s_increase
FROM bids
""",
)
QUALITY_FLAGS = {
    "flag_future_driver": "driver_reg_date > order_timestamp",
    "flag_future_bid": "tender_timestamp < order_timestamp",
    "flag_slow_response": "s_response > 300",
    "flag_zero_distance": "distance_in_meters <= 0",
    "flag_zero_duration": "duration_in_seconds <= 0",
    "flag_zero_price": "price_bid_local <= 0",
    "flag_too_short_trip": "distance_in_meters < 500",
    "flag_too_quick_trip": "duration_in_seconds < 60",
    "flag_extreme_distance": "distance_in_meters > 100000",
    "flag_extreme_duration": "duration_in_seconds > 7200",
    "flag_too_fast_city": "s_speed > 80",
    "flag_physically_impossible": "duration_in_seconds < distance_in_meters / (120e0 / 3.6e0)",
    "flag_too_slow": "s_speed < 8",
    "flag_extreme_pickup_ratio": "s_pickup_ratio > 5",
    "flag_extreme_pickup_speed": "s_pickup_speed > 100",
    "flag_extreme_markup": "s_increase > 100",
    "flag_extreme_price": "price_bid_local > 5000",
}
view(
    "flagged",
    "SELECT *,\n"
    + ",\n".join(
        f" CASE WHEN {p} THEN 1e0 ELSE 0e0 END AS {n}" for n, p in QUALITY_FLAGS.items()
    )
    + "\nFROM soft",
)
view(
    "scored_quality",
    f"""
SELECT *,
 least(greatest(s_response / 300, 0e0), 2e0) AS response_time_score,
 flag_zero_distance + flag_zero_duration + flag_zero_price AS zero_values_count,
 least(greatest(distance_in_meters / 500e0, 0e0), 2e0) AS short_trip_score,
 distance_in_meters / 100000e0 AS distance_extremity,
 duration_in_seconds / 7200e0 AS duration_extremity,
 least(greatest(greatest(s_speed / 80, 8 / (s_speed + 0.1e0)), 0e0), 5e0) AS speed_anomaly_score,
 least(greatest(s_pickup_ratio / 5, 0e0), 3e0) AS pickup_anomaly_score,
 least(greatest(greatest(s_increase / 100, price_bid_local / 5000), 0e0), 3e0) AS price_anomaly_score,
 {" + ".join(QUALITY_FLAGS)} AS total_flags
FROM flagged
""",
)
view(
    "quality",
    """
SELECT *, 1e0 / (1e0 + total_flags) AS data_quality_index,
 CASE WHEN total_flags = 0 THEN 1e0 ELSE 0e0 END AS is_high_quality,
 CASE WHEN total_flags >= 2 THEN 1e0 ELSE 0e0 END AS is_suspicious,
 CASE WHEN total_flags >= 4 THEN 1e0 ELSE 0e0 END AS is_low_quality
FROM scored_quality
""",
)
view(
    "uh",
    """
SELECT *, user_done_count / CAST(user_order_count AS DOUBLE) AS user_acceptance_rate,
 user_avg_bid / (user_avg_start_price + 0.1e0) AS user_avg_price_ratio,
 CASE WHEN user_order_count <= 5 THEN 1e0 ELSE 0e0 END AS user_is_new,
 CASE WHEN user_order_count >= 20 THEN 1e0 ELSE 0e0 END AS user_is_vip,
 CASE WHEN user_avg_bid / (user_avg_start_price + 0.1e0) < 1.1e0 THEN 1e0 ELSE 0e0 END AS user_is_price_sensitive
FROM (SELECT user_id, count(is_done) AS user_order_count,
  CAST(count(*) FILTER (WHERE is_done = 'done') AS BIGINT) AS user_done_count,
  avg(price_bid_local) AS user_avg_bid, avg(price_start_local) AS user_avg_start_price
  FROM bids WHERE user_id IS NOT NULL GROUP BY user_id) grouped
""",
)
view(
    "dh",
    """
SELECT *, driver_done_count / CAST(driver_bid_count AS DOUBLE) AS driver_acceptance_rate,
 driver_avg_bid / (driver_avg_start_price + 0.1e0) AS driver_avg_bid_ratio,
 CASE WHEN driver_bid_count >= 20 THEN 1e0 ELSE 0e0 END AS driver_is_active,
 CASE WHEN driver_avg_bid / (driver_avg_start_price + 0.1e0) > 1.2e0 THEN 1e0 ELSE 0e0 END AS driver_is_aggressive,
 CASE WHEN driver_avg_bid / (driver_avg_start_price + 0.1e0) < 1.1e0 THEN 1e0 ELSE 0e0 END AS driver_is_flexible
FROM (SELECT driver_id, count(is_done) AS driver_bid_count,
  CAST(count(*) FILTER (WHERE is_done = 'done') AS BIGINT) AS driver_done_count,
  avg(price_bid_local) AS driver_avg_bid, avg(price_start_local) AS driver_avg_start_price
  FROM bids WHERE driver_id IS NOT NULL GROUP BY driver_id) grouped
""",
)
view(
    "joined",
    """
SELECT b.*,
 CAST(coalesce(u.user_order_count, 1) AS DOUBLE) AS user_order_count,
 CAST(coalesce(u.user_done_count, 0) AS DOUBLE) AS user_done_count,
 coalesce(u.user_avg_bid, b.price_bid_local) AS user_avg_bid,
 coalesce(u.user_avg_start_price, b.price_start_local) AS user_avg_start_price,
 coalesce(u.user_acceptance_rate, 0.5e0) AS user_acceptance_rate,
 coalesce(u.user_avg_price_ratio, 1e0) AS user_avg_price_ratio,
 coalesce(u.user_is_new, 1e0) AS user_is_new,
 coalesce(u.user_is_vip, 0e0) AS user_is_vip,
 coalesce(u.user_is_price_sensitive, 0.5e0) AS user_is_price_sensitive,
 CAST(coalesce(d.driver_bid_count, 1) AS DOUBLE) AS driver_bid_count,
 CAST(coalesce(d.driver_done_count, 0) AS DOUBLE) AS driver_done_count,
 coalesce(d.driver_avg_bid, b.price_bid_local) AS driver_avg_bid,
 coalesce(d.driver_avg_start_price, b.price_start_local) AS driver_avg_start_price,
 coalesce(d.driver_acceptance_rate, 0.5e0) AS driver_acceptance_rate,
 coalesce(d.driver_avg_bid_ratio, 1e0) AS driver_avg_bid_ratio,
 coalesce(d.driver_is_active, 0.5e0) AS driver_is_active,
 coalesce(d.driver_is_aggressive, 0e0) AS driver_is_aggressive,
 coalesce(d.driver_is_flexible, 0.5e0) AS driver_is_flexible
FROM quality b LEFT JOIN uh u ON b.user_id = u.user_id LEFT JOIN dh d ON b.driver_id = d.driver_id
""",
)
TAXI = """CASE
 WHEN trim(carname) IN ('Daewoo','Lifan','FAW','Great Wall','Geely','ЗАЗ','Chery')
  OR trim(carmodel) IN ('Logan','Symbol','Sandero','Lacetti','Aveo','Nexia','Rio','Spectra','Granta','Гранта','Kalina','Калина','Priora','Приора','2110','2112','2115','2107','2114','Самара','S18') THEN 'economy'
 WHEN trim(carname) IN ('Toyota','Honda','Mitsubishi','Subaru')
  OR trim(carmodel) IN ('Camry','Corolla','RAV4','Avensis','Civic','Accord','Qashqai','X-Trail','Tiguan','Passat CC','Passat','CX-5','Outlander','Kyron','Legacy') THEN 'business'
 ELSE 'comfort' END"""


def flag_sql(predicate: str) -> str:
    return f"CASE WHEN {predicate} THEN 1e0 ELSE 0e0 END"


def _features(source: str, serving: bool) -> tuple[str, str]:
    """The two stages of the feature columns, over bids or over candidate prices."""
    bid, start = ("price", "reference_price") if serving else ("price_bid_local", "price_start_local")
    metres, secs = "distance_in_meters", "duration_in_seconds"
    if serving:
        speed = f"CASE WHEN {secs} > 0 THEN {metres} / CAST({secs} AS DOUBLE) * 3.6e0 ELSE 25e0 END"
        pick = "CASE WHEN pickup_in_seconds > 0 THEN pickup_in_meters / CAST(pickup_in_seconds AS DOUBLE) * 3.6e0 ELSE 20e0 END"
        by_len, by_time = f"pickup_in_meters / ({metres} + 1e0)", f"pickup_in_seconds / ({secs} + 1e0)"
        days = "floor((epoch_us(ts) - epoch_us(CAST(driver_reg_date AS TIMESTAMP))) / 86400e6)"
        days = f"CASE WHEN {days} >= 0 THEN {days} ELSE 365e0 END"
        response = "30e0"
        cost, litres = f"money({metres} / 1000e0 * 9e0 / 100e0 * 55e0)", f"money({metres} / 1000e0 * 9e0 / 100e0)"
        above = "CASE WHEN min_profitable_price > 0 THEN (bid - min_profitable_price) / min_profitable_price * 100 ELSE 0e0 END"
        vs_user, vs_driver = "user_order_count * 20e0", "driver_bid_count * 10e0"
    else:
        speed = f"least(greatest({metres} / ({secs} + 0.1e0) * 3.6e0, 0e0), 150e0)"
        pick = "least(greatest(pickup_in_meters / (pickup_in_seconds + 0.1e0) * 3.6e0, 0e0), 150e0)"
        by_len = f"least(greatest(pickup_in_meters / ({metres} + 1e0), 0e0), 10e0)"
        by_time = f"least(greatest(pickup_in_seconds / ({secs} + 1e0), 0e0), 10e0)"
        days = "least(greatest(coalesce(floor((epoch_us(ts) - epoch_us(driver_reg_date)) / 86400e6), 365e0), 0e0), 3650e0)"
        response = "least(greatest(coalesce((epoch_us(tender_timestamp) - epoch_us(ts)) / 1e6, 30e0), 0e0), 600e0)"
        cost, litres = f"{metres} / 1000e0 * 9e0 / 100e0 * 55e0", f"{metres} / 1000e0 * 9e0 / 100e0"
        above = "(bid - min_profitable_price) / (min_profitable_price + 0.1e0) * 100"
        vs_user, vs_driver = "user_avg_bid", "driver_avg_bid"
    one = f"""
SELECT * REPLACE (CAST({metres} AS DOUBLE) AS {metres}, CAST({secs} AS DOUBLE) AS {secs},
  CAST(pickup_in_meters AS DOUBLE) AS pickup_in_meters, CAST(pickup_in_seconds AS DOUBLE) AS pickup_in_seconds),
 {bid} AS bid, {start} AS start_price,
 CASE WHEN {start} <> 0 THEN ({bid} - {start}) / {start} * 100 END AS price_increase_pct,
 {flag_sql(f"CASE WHEN {start} = 0 THEN {bid} > 0 ELSE ({bid} - {start}) / {start} > 0 END")} AS is_price_increased,
 coalesce(hour(ts), 0) AS h, coalesce(isodow(ts) - 1, 0) AS w, coalesce(day(ts), 15) AS dom,
 {metres} / 1000e0 AS distance_km, {secs} / 60e0 AS duration_min, {speed} AS avg_speed_kmh,
 pickup_in_meters / 1000e0 AS pickup_km, {pick} AS pickup_speed_kmh,
 {by_len} AS pickup_to_trip_ratio, {by_time} AS pickup_time_ratio,
 CAST(pickup_in_meters + {metres} AS DOUBLE) AS total_distance,
 CAST(pickup_in_seconds + {secs} AS DOUBLE) AS total_time,
 {days} AS driver_experience_days, {response} AS response_time_seconds,
 {TAXI} AS kind, {cost} AS fuel_cost_rub, {litres} AS fuel_liters, ({cost}) * 1.3e0 AS min_profitable_price
FROM {source}"""
    two = f"""
SELECT * REPLACE ({"bid AS price_bid_local, " if not serving else ""}start_price AS price_start_local){", bid AS price_bid_local" if serving else ""},
 bid - start_price AS price_increase_abs,
 bid / (distance_km + 0.1e0) AS price_per_km, bid / (duration_min + 0.1e0) AS price_per_minute,
 sin(2 * pi() * h / 24) AS hour_sin, cos(2 * pi() * h / 24) AS hour_cos, CAST(w AS DOUBLE) AS day_of_week,
 sin(2 * pi() * w / 7) AS day_sin, cos(2 * pi() * w / 7) AS day_cos,
 {flag_sql("w >= 5")} AS is_weekend, {flag_sql("h BETWEEN 7 AND 9")} AS is_morning_peak,
 {flag_sql("h BETWEEN 17 AND 20")} AS is_evening_peak,
 {flag_sql("h BETWEEN 7 AND 9 OR h BETWEEN 17 AND 20")} AS is_peak_hour,
 {flag_sql("h < 6 OR h >= 22")} AS is_night, {flag_sql("h BETWEEN 12 AND 14")} AS is_lunch_time,
 {flag_sql("avg_speed_kmh < 15")} AS is_traffic_jam, {flag_sql("avg_speed_kmh > 50")} AS is_highway,
 {flag_sql("distance_km < 2")} AS is_short_trip, {flag_sql("distance_km >= 2 AND distance_km < 10")} AS is_medium_trip,
 {flag_sql("distance_km >= 10")} AS is_long_trip,
 driver_experience_days / 365.25e0 AS driver_experience_years,
 {flag_sql("driver_experience_days < 30")} AS is_new_driver,
 {flag_sql("driver_experience_days > 365")} AS is_experienced_driver,
 {flag_sql("driver_rating = 5")} AS has_perfect_rating, 5 - driver_rating AS rating_deviation,
 ln(1 + response_time_seconds) AS response_time_log,
 {flag_sql("response_time_seconds < 10")} AS is_fast_response, {flag_sql("response_time_seconds > 60")} AS is_slow_response,
 {flag_sql("kind = 'economy'")} AS taxi_type_economy, {flag_sql("kind = 'comfort'")} AS taxi_type_comfort,
 {flag_sql("kind = 'business'")} AS taxi_type_business,
 {flag_sql("platform = 'android'")} AS platform_android, {flag_sql("platform = 'ios'")} AS platform_ios,
 price_increase_pct * distance_km AS price_inc_x_distance,
 price_increase_pct * is_night AS price_inc_x_night, price_increase_pct * is_peak_hour AS price_inc_x_peak,
 price_increase_pct * is_weekend AS price_inc_x_weekend,
 distance_km * is_night AS distance_x_night, distance_km * is_weekend AS distance_x_weekend,
 distance_km * is_peak_hour AS distance_x_peak, avg_speed_kmh * is_peak_hour AS speed_x_peak,
 driver_rating * price_increase_pct AS rating_x_price_inc,
 driver_experience_years * price_increase_pct AS experience_x_price_inc,
 bid / (fuel_cost_rub + 0.1e0) AS price_to_fuel_ratio, bid - min_profitable_price AS price_above_min_profitable,
 {above} AS price_above_min_profitable_pct,
 {flag_sql("bid >= min_profitable_price * 2")} AS is_highly_profitable,
 {flag_sql("bid >= min_profitable_price")} AS is_profitable, {flag_sql("bid < min_profitable_price")} AS is_unprofitable,
 bid - fuel_cost_rub AS net_profit, (bid - fuel_cost_rub) / (distance_km + 0.1e0) AS net_profit_per_km,
 (bid - fuel_cost_rub) / (duration_min + 0.1e0) AS net_profit_per_minute,
 price_to_fuel_ratio * distance_km AS fuel_ratio_x_distance, price_to_fuel_ratio * is_peak_hour AS fuel_ratio_x_peak,
 (bid - fuel_cost_rub) * driver_rating AS net_profit_x_rating,
 user_acceptance_rate * driver_acceptance_rate AS user_driver_match_score,
 bid / ({vs_user} + 0.1e0) AS price_vs_user_avg, bid / ({vs_driver} + 0.1e0) AS price_vs_driver_avg,
 distance_km / (duration_min + 0.1e0) AS route_efficiency,
 {flag_sql("distance_km < 1")} AS is_very_short, {flag_sql("distance_km > 20")} AS is_very_long,
 pickup_km / (distance_km + 0.1e0) AS pickup_burden,
 CAST(dom AS DOUBLE) AS day_of_month, {flag_sql("dom <= 5")} AS is_month_start, {flag_sql("dom >= 25")} AS is_month_end,
 CAST(h // 6 AS DOUBLE) AS hour_quartile
FROM """
    return one, two


view("timed", "SELECT *, order_timestamp AS ts FROM joined")
_one, _two = _features("timed", serving=False)
view("feat_one", _one)
view("feat", _two + "feat_one")

view(
    "ord",
    """
SELECT order_id, CAST(epoch(order_timestamp) AS BIGINT) AS order_timestamp, distance_in_meters,
 duration_in_seconds, pickup_in_meters, pickup_in_seconds, driver_rating, platform,
 price_start_local, carname, carmodel, strftime(driver_reg_date, '%Y-%m-%d') AS driver_reg_date,
 user_id, driver_id
FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY line_no, driver_id, part_id, ext) AS rn
      FROM bids WHERE copy_no = 0) ranked WHERE rn = 1
""",
)
view(
    "filled",
    """
SELECT * REPLACE (coalesce(driver_reg_date, '2020-01-01') AS driver_reg_date,
 coalesce(driver_rating, 5e0) AS driver_rating, coalesce(carname, 'Renault') AS carname,
 coalesce(carmodel, 'Logan') AS carmodel, coalesce(platform, 'android') AS platform),
 order_timestamp AS tender_timestamp
FROM ord
""",
)
USER_SERVED = (
    "user_order_count", "user_acceptance_rate", "user_avg_price_ratio",
    "user_is_new", "user_is_vip", "user_is_price_sensitive",
)
DRIVER_SERVED = (
    "driver_bid_count", "driver_acceptance_rate", "driver_avg_bid_ratio",
    "driver_is_active", "driver_is_aggressive", "driver_is_flexible",
)
view(
    "looked_up",
    "SELECT f.*,\n"
    + ",\n".join(
        f" coalesce(CAST({a}.{c} AS DOUBLE), (SELECT avg({c}) FROM {t} )) AS {c}"
        for a, t, names in (("u", "uh", USER_SERVED), ("d", "dh", DRIVER_SERVED))
        for c in names
    )
    + "\nFROM filled f LEFT JOIN uh u ON f.user_id = u.user_id LEFT JOIN dh d ON f.driver_id = d.driver_id",
)
view(
    "ranged",
    """
SELECT *, least(price_start_local, reference_price * 0.5e0) AS search_min,
 greatest(reference_price * 3, price_start_local * 2.5e0) AS search_max,
 1.2e0 + CASE WHEN hour(to_timestamp(order_timestamp) AT TIME ZONE 'UTC') BETWEEN 7 AND 9
   OR hour(to_timestamp(order_timestamp) AT TIME ZONE 'UTC') BETWEEN 17 AND 20 THEN 0.15e0 ELSE 0e0 END
  - 0.02e0 * (distance_in_meters / 1000e0) + 0.5e0 * driver_acceptance_rate AS score_base
FROM (SELECT *, 100e0 + 15e0 * (distance_in_meters / 1000e0) + 5e0 * (duration_in_seconds / 60e0) AS reference_price
      FROM looked_up ) referenced
""",
)
_PROB = "1e0 / (1e0 + exp(-(score_base - 0.02e0 * ((price - reference_price) / reference_price * 100))))"
view(
    "coarse",
    f"""
SELECT *, {_PROB} AS probability FROM (
 SELECT r.*, CASE WHEN g.i = 149 THEN search_max ELSE search_min + g.i * ((search_max - search_min) / 149e0) END AS price
 FROM ranged r CROSS JOIN range(150) g(i)) placed
""",
)
view(
    "limited",
    """
SELECT r.*, coalesce(t.top, r.reference_price * 2) AS scan_max
FROM ranged r LEFT JOIN (SELECT order_id, max(price) AS top FROM coarse WHERE probability >= 0.05e0 GROUP BY order_id) t
 ON r.order_id = t.order_id
""",
)
view(
    "fine",
    f"""
SELECT *, price * probability AS expected_value, NOT (scan_max >= price_start_local) OR price >= price_start_local AS is_valid
FROM (SELECT *, {_PROB} AS probability FROM (
 SELECT l.*, CAST(g.i AS BIGINT) AS point,
  CASE WHEN g.i = 499 THEN scan_max ELSE search_min + g.i * ((scan_max - search_min) / 499e0) END AS price
 FROM limited l CROSS JOIN range(500) g(i)) placed) scored
""",
)
view(
    "maxima",
    """
SELECT order_id, max(probability) AS max_probability, max(expected_value) FILTER (WHERE is_valid) AS max_expected_value
FROM fine GROUP BY order_id
""",
)
view(
    "curve",
    """
SELECT *, 0.7e0 * normalized_ev + 0.3e0 * normalized_probability AS weighted_score,
 CASE WHEN probability >= 0.7e0 AND probability < 1 THEN 3 WHEN probability >= 0.5e0 AND probability < 0.7e0 THEN 2
  WHEN probability >= 0.3e0 AND probability < 0.5e0 THEN 4 WHEN probability >= 0 AND probability < 0.3e0 THEN 1 END AS band
FROM (SELECT f.*, m.max_probability, m.max_expected_value,
  CASE WHEN m.max_probability > 0 THEN f.probability / m.max_probability ELSE f.probability END AS normalized_probability,
  CASE WHEN m.max_expected_value <> 0 THEN f.expected_value / m.max_expected_value END AS normalized_ev
  FROM fine f JOIN maxima m ON f.order_id = m.order_id) shared
""",
)
view(
    "best",
    """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id
  ORDER BY coalesce(floor(weighted_score * 1e9 + 0.5e0), -1) DESC, point) AS rn FROM curve WHERE is_valid) ranked WHERE rn = 1
""",
)
view(
    "likeliest",
    """
SELECT order_id, price AS max_probability_price FROM (SELECT *, row_number() OVER (PARTITION BY order_id
  ORDER BY floor(probability * 1e9 + 0.5e0) DESC, point) AS rn FROM curve WHERE is_valid) ranked WHERE rn = 1
""",
)
view(
    "zones",
    """
SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY price_min, config) AS position FROM (
 SELECT order_id, band AS zone_id,
  CASE band WHEN 3 THEN 'zone_3_green' WHEN 2 THEN 'zone_2_yellow_low' WHEN 4 THEN 'zone_4_yellow_high' ELSE 'zone_1_red_low' END AS zone_name,
  CASE band WHEN 3 THEN 0 WHEN 2 THEN 1 WHEN 4 THEN 2 ELSE 3 END AS config,
  money(min(price)) AS price_min, money(max(price)) AS price_max,
  money(avg(probability) * 100) AS avg_probability_percent,
  money(avg(normalized_probability) * 100) AS avg_normalized_probability_percent,
  money(avg(expected_value)) AS avg_expected_value
 FROM curve WHERE is_valid AND band IS NOT NULL GROUP BY order_id, band) grouped
""",
)
view(
    "chosen",
    """
SELECT b.order_id, b.distance_in_meters, b.price_start_local, b.scan_max,
 money(b.price) AS price, money(b.probability * 100) AS probability_percent,
 money(b.normalized_probability * 100) AS normalized_probability_percent,
 money(b.expected_value) AS expected_value,
 coalesce((SELECT z.zone_id FROM zones z WHERE z.order_id = b.order_id AND z.zone_id =
   CASE WHEN b.probability >= 0.7e0 THEN 3 WHEN b.probability >= 0.5e0 THEN 2 WHEN b.probability >= 0.3e0 THEN 4 ELSE 1 END),
  f.zone_id, 3) AS zone_id,
 money(b.expected_value - money(b.distance_in_meters / 1000e0 * 9e0 / 100e0 * 55e0)) AS net_profit,
 money(b.distance_in_meters / 1000e0 * 9e0 / 100e0 * 55e0) AS fuel_cost,
 money(b.distance_in_meters / 1000e0 * 9e0 / 100e0) AS fuel_liters,
 money(b.distance_in_meters / 1000e0) AS distance_km,
 money(money(b.distance_in_meters / 1000e0 * 9e0 / 100e0 * 55e0) * 1.3e0) AS min_profitable_price,
 money(b.max_probability * 100) AS max_probability_percent,
 money(l.max_probability_price) AS max_probability_price
FROM best b JOIN likeliest l ON b.order_id = l.order_id
LEFT JOIN (SELECT order_id, arg_max(zone_id, avg_probability_percent * 100 - position) AS zone_id FROM zones GROUP BY order_id) f
 ON b.order_id = f.order_id
""",
)
view(
    "axis",
    """
SELECT c.*, coalesce(a.lowest, money(c.price_start_local)) AS axis_min,
 CASE WHEN a.lowest IS NULL THEN greatest(money(c.price_start_local) + 1, money(c.scan_max))
  WHEN a.red THEN a.highest + greatest((a.highest - a.lowest) * 0.15e0, 50e0)
  ELSE a.highest + greatest((a.highest - a.lowest) * 0.3e0, 100e0) END AS axis_max,
 5e0 AS axis_step, a.lowest AS zones_min, a.highest AS zones_max
FROM chosen c LEFT JOIN (SELECT order_id, arg_min(price_min, position) AS lowest, arg_max(price_max, position) AS highest,
  bool_or(zone_id IN (0, 1)) AS red FROM zones GROUP BY order_id) a ON c.order_id = a.order_id
""",
)
# Prices to quote: below, at and above the zones, in the first gap, and the optimum.
view(
    "asked",
    """
SELECT order_id, axis_min, axis_max, 'below' AS probe, axis_min - 20 AS ask FROM axis
UNION ALL SELECT order_id, axis_min, axis_max, 'low', axis_min FROM axis
UNION ALL SELECT order_id, axis_min, axis_max, 'mid', (axis_min + axis_max) / 2 FROM axis
UNION ALL SELECT order_id, axis_min, axis_max, 'best', price FROM axis
UNION ALL SELECT a.order_id, a.axis_min, a.axis_max, 'gap', (z.price_max + y.price_min) / 2
 FROM axis a JOIN zones z ON a.order_id = z.order_id AND z.position = 1
 JOIN zones y ON a.order_id = y.order_id AND y.position = 2
UNION ALL SELECT order_id, axis_min, axis_max, 'beyond', zones_max + 30 FROM axis WHERE zones_max IS NOT NULL
UNION ALL SELECT order_id, axis_min, axis_max, 'high', axis_max FROM axis
""",
)
view(
    "hits",
    """
SELECT a.order_id, a.probe, a.ask, a.axis_min, a.axis_max, min(z.position) AS position
FROM asked a LEFT JOIN zones z ON a.order_id = z.order_id AND a.ask >= z.price_min AND a.ask <= z.price_max
GROUP BY ALL
""",
)
view(
    "neighbours",
    """
SELECT *, lag(avg_normalized_probability_percent) OVER (PARTITION BY order_id ORDER BY position) AS previous_chance,
 lead(avg_normalized_probability_percent) OVER (PARTITION BY order_id ORDER BY position) AS next_chance
FROM zones
""",
)
view(
    "quoted",
    """
SELECT h.*, z.zone_id, z.zone_name, z.previous_chance, z.next_chance,
 CASE WHEN z.zone_id IS NOT NULL THEN
   coalesce((z.previous_chance + z.avg_normalized_probability_percent) / 2, z.avg_normalized_probability_percent)
   + (coalesce((z.next_chance + z.avg_normalized_probability_percent) / 2, z.avg_normalized_probability_percent)
      - coalesce((z.previous_chance + z.avg_normalized_probability_percent) / 2, z.avg_normalized_probability_percent))
     * ((h.ask - z.price_min) / CASE WHEN z.price_max = z.price_min THEN 1e0 ELSE z.price_max - z.price_min END)
  WHEN h.ask > x.zones_max THEN coalesce(greatest(0e0, 10 - CASE WHEN h.axis_max <> x.zones_max THEN (h.ask - x.zones_max) / (h.axis_max - x.zones_max) END * 8), 0e0)
  WHEN h.ask < x.zones_min THEN CASE WHEN x.zones_min <> h.axis_min THEN greatest(0e0, 10 - (x.zones_min - h.ask) / (x.zones_min - h.axis_min) * 8) ELSE 0e0 END
  ELSE coalesce(nullif(x.normalized_probability_percent, 0), nullif(x.probability_percent, 0), 0e0) END AS quote_probability,
 CASE WHEN z.zone_id IS NOT NULL THEN 'inside' WHEN h.ask > x.zones_max OR h.ask < x.zones_min THEN 'tail' ELSE 'gap' END AS place,
 x.expected_value AS optimal_ev
FROM hits h JOIN axis x ON h.order_id = x.order_id
LEFT JOIN neighbours z ON h.order_id = z.order_id AND h.position = z.position
""",
)
view(
    "score_rows",
    """
SELECT *, 1e0 / (1e0 + exp(-(1.2e0 - 0.02e0 * coalesce(price_increase_pct, 0e0) + 0.15e0 * is_peak_hour
 - 0.02e0 * distance_km + 0.5e0 * driver_acceptance_rate))) AS probability,
 CASE WHEN is_done = 'done' THEN 1 ELSE 0 END AS label
FROM feat
""",
)
view("serve_timed", "SELECT *, to_timestamp(order_timestamp) AT TIME ZONE 'UTC' AS ts, price_start_local * 1.2e0 AS price FROM ranged")
_one, _two = _features("serve_timed", serving=True)
view("serve_one", _one)
view("serve", _two + "serve_one")
