"""Queries over bids: measures, marks, cleaning, quality and history."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farelens.functions import clock, fare
from farelens.functions.missing import clip, finite_or_null, larger_of, num
from farelens.operators import cleaning, history, orders, quality, statistics
from farelens.operators.history import DRIVER, USER
from farelens.plans import oracle_views as o
from farelens.plans.data import KEY, Data
from farelens.plans.registry import query, rounded

K = o.KEY


def flags_as_int(df: DataFrame, names) -> DataFrame:
    return df.select(*KEY, *[F.col(n).cast("int").alias(n) for n in names])


# -- measures ---------------------------------------------------------------


_TIMES_AS_TEXT = {
    "order_timestamp": 50,
    "tender_timestamp": 37,
    "driver_reg_date": 23,
}


@query(
    "parse_times",
    f"SELECT {K}, "
    + ", ".join(
        f"CASE WHEN part_id % {m} <> 0 THEN CAST(epoch({c}) AS BIGINT) END AS {c}"
        for c, m in _TIMES_AS_TEXT.items()
    )
    + " FROM bids",
)
def _parse_times(d: Data) -> DataFrame:
    texts = {
        c: F.when(F.col("part_id") % m == 0, F.lit("no time")).otherwise(
            F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        )
        for c, m in _TIMES_AS_TEXT.items()
    }
    parsed = cleaning.parse_times(d.bids.withColumns(texts))
    return parsed.select(*KEY, *[F.unix_timestamp(c).alias(c) for c in texts])


def _measure(key: str, column: str) -> None:
    @query(key, f"SELECT {K}, {o.r(column)} FROM meas")
    def _run(d: Data) -> DataFrame:
        return rounded(cleaning.with_measures(d.bids).select(*KEY, column))


_measure("response_time", "response_time_seconds")
_measure("trip_speed", "avg_speed_kmh")
_measure("pickup_speed", "pickup_speed_kmh")
_measure("pickup_ratio", "pickup_ratio")


@query(
    "price_increase_pct",
    f"""SELECT {K}, coalesce(isinf(price_increase_pct), FALSE) AS is_infinite,
 CASE WHEN NOT isinf(price_increase_pct) THEN round(price_increase_pct, 6) + 0e0 END AS price_increase_pct FROM meas""",
)
def _price_increase_pct(d: Data) -> DataFrame:
    value = F.col("price_increase_pct")
    out = cleaning.with_measures(d.bids).select(
        *KEY,
        F.coalesce(value.isin(float("inf"), float("-inf")), F.lit(False)).alias("is_infinite"),
        finite_or_null(value).alias("price_increase_pct"),
    )
    return rounded(out)


@query(
    "label_binary",
    f"SELECT {K}, CASE WHEN is_done = 'done' THEN 1 ELSE 0 END AS label FROM bids",
)
def _label_binary(d: Data) -> DataFrame:
    return d.bids.select(*KEY, cleaning.label_binary().alias("label"))


@query(
    "select_columns",
    f"SELECT driver_id, {o.r(*[c for c in o.DRIVER_SERVED])} FROM dh",
)
def _select_columns(d: Data) -> DataFrame:
    served = d.drivers.select("driver_id", *[num(c).alias(c) for c in DRIVER.served])
    return rounded(served)


# -- marks and cleaning -----------------------------------------------------


@query(
    "anomaly_flags",
    f"SELECT {K}, " + ", ".join(f"CAST({n} AS INT) AS {n}" for n in o.CLEAN_FLAGS) + " FROM marked",
)
def _anomaly_flags(d: Data) -> DataFrame:
    return flags_as_int(cleaning.anomaly_flags(d.bids), o.CLEAN_FLAGS)


@query("dedupe_first", f"SELECT {K}, is_done FROM marked WHERE NOT exact_duplicate")
def _dedupe_first(d: Data) -> DataFrame:
    return cleaning.dedupe_first(d.bids, d.row_order).select(*KEY, "is_done")


@query("clean_soft", f"SELECT {K}, {o.r('pickup_ratio')} FROM marked WHERE NOT exact_duplicate")
def _clean_soft(d: Data) -> DataFrame:
    return rounded(cleaning.clean(d.bids, d.row_order).select(*KEY, "pickup_ratio"))


CLEAN_STRICT_SQL = f"SELECT {K}, {o.r('pickup_ratio')} FROM marked WHERE NOT exact_duplicate AND NOT {o.ANY_FLAG}"


@query("clean_strict", CLEAN_STRICT_SQL)
def _clean_strict(d: Data) -> DataFrame:
    return rounded(cleaning.clean(d.bids, d.row_order, soft=False).select(*KEY, "pickup_ratio"))


@query("only_accepted", f"SELECT {K} FROM marked WHERE NOT exact_duplicate AND is_done = 'done'")
def _only_accepted(d: Data) -> DataFrame:
    return cleaning.clean(d.bids, d.row_order, only_accepted=True).select(*KEY)


@query(
    "mask_union",
    f"""SELECT platform, count(*) AS n_rows, CAST(count(*) FILTER (WHERE {o.ANY_FLAG} OR exact_duplicate OR is_done <> 'done') AS BIGINT) AS n_removed
FROM marked GROUP BY platform""",
)
def _mask_union(d: Data) -> DataFrame:
    masks = [*cleaning.anomaly_predicates().values(), cleaning.not_accepted()]
    measured = cleaning.with_measures(d.bids)
    kept = cleaning.dedupe_first(measured, d.row_order).filter(~cleaning.any_of(masks))
    seen = measured.groupBy("platform").agg(F.count("*").alias("n_rows"))
    left = kept.groupBy("platform").agg(F.count("*").alias("n_kept"))
    removed = F.col("n_rows") - F.coalesce(F.col("n_kept"), F.lit(0))
    return seen.join(left, "platform", "left").select(
        "platform", "n_rows", removed.alias("n_removed")
    )


_COUNTED = (*o.CLEAN_FLAGS, "exact_duplicate", "not_accepted")


ANOMALY_COUNTS_SQL = (
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS problem, '{cleaning.PROBLEM_TEXT[n]}' AS description,"
        f" CAST(count(*) FILTER (WHERE {'is_done <> ' + chr(39) + 'done' + chr(39) if n == 'not_accepted' else n}) AS BIGINT) AS n_rows FROM marked "
        for n in _COUNTED
    )
    + ") counted WHERE n_rows > 0"
)


@query("anomaly_counts", ANOMALY_COUNTS_SQL)
def _anomaly_counts(d: Data) -> DataFrame:
    return cleaning.anomaly_counts(d.bids, d.row_order, only_accepted=True)


@query(
    "clean_summary",
    f"""SELECT initial, initial - kept AS removed, round((initial - kept) * 100e0 / initial, 6) AS removed_pct,
 kept, round(kept * 100e0 / initial, 6) AS kept_pct
FROM (SELECT count(*) AS initial, CAST(count(*) FILTER (WHERE NOT exact_duplicate AND NOT {o.ANY_FLAG}) AS BIGINT) AS kept FROM marked ) counted""",
)
def _clean_summary(d: Data) -> DataFrame:
    return rounded(cleaning.clean_summary(d.bids, d.row_order, soft=False))


@query(
    "bids_per_order",
    """SELECT count(DISTINCT order_id) AS unique_orders,
 round(count(*) / CAST(count(DISTINCT order_id) AS DOUBLE), 6) AS avg_bids_per_order FROM marked WHERE NOT exact_duplicate""",
)
def _bids_per_order(d: Data) -> DataFrame:
    return rounded(cleaning.bids_per_order(cleaning.dedupe_first(d.bids, d.row_order)))


@query(
    "class_balance",
    """SELECT done_count, n - done_count AS cancel_count, round(done_count * 100e0 / n, 6) AS done_pct,
 round(100 - done_count * 100e0 / n, 6) AS cancel_pct, round((n - done_count) / CAST(done_count AS DOUBLE), 6) AS cancel_per_done
FROM (SELECT count(*) AS n, CAST(count(*) FILTER (WHERE is_done = 'done') AS BIGINT) AS done_count FROM bids ) counted""",
)
def _class_balance(d: Data) -> DataFrame:
    return rounded(cleaning.class_balance(d.bids))


# -- quality ----------------------------------------------------------------


@query("quality_flags", f"SELECT {K}, {', '.join(quality.FLAGS)} FROM quality")
def _quality_flags(d: Data) -> DataFrame:
    return quality.with_flags(d.bids).select(*KEY, *quality.FLAGS)


@query("quality_scores", f"SELECT {K}, {o.r(*quality.SCORES)} FROM quality")
def _quality_scores(d: Data) -> DataFrame:
    return rounded(d.quality.select(*KEY, *quality.SCORES))


@query("quality_index", f"SELECT {K}, {o.r(*quality.INDEX)} FROM quality")
def _quality_index(d: Data) -> DataFrame:
    return rounded(d.quality.select(*KEY, *quality.INDEX))


_LABEL_SQL = "CASE WHEN data_quality_index >= 0.5 THEN 'done' ELSE 'cancel' END"


@query("quality_label", f"SELECT {K}, {_LABEL_SQL} AS is_done FROM quality")
def _quality_label(d: Data) -> DataFrame:
    return d.quality.select(*KEY, quality.quality_label().alias("is_done"))


@query(
    "threshold_label",
    f"""SELECT {K}, CASE WHEN probability >= 0.6 THEN 'done' ELSE 'cancel' END AS label FROM score_rows""",
)
def _threshold_label(d: Data) -> DataFrame:
    label = quality.threshold_label(F.col("probability"), 0.6)
    return d.scored_bids.select(*KEY, label.alias("label"))


@query(
    "quality_summary",
    """SELECT round(avg(data_quality_index), 6) AS avg_index,
 CAST(sum(is_high_quality) AS BIGINT) AS high_count, CAST(sum(is_suspicious) AS BIGINT) AS suspicious_count, CAST(sum(is_low_quality) AS BIGINT) AS low_count,
 round(sum(is_high_quality) * 100 / count(*), 6) AS high_pct, round(sum(is_suspicious) * 100 / count(*), 6) AS suspicious_pct, round(sum(is_low_quality) * 100 / count(*), 6) AS low_pct
FROM quality""",
)
def _quality_summary(d: Data) -> DataFrame:
    return rounded(quality.quality_summary(d.quality))


@query(
    "quality_range",
    """SELECT round(min(data_quality_index), 6) AS min_index, round(avg(data_quality_index), 6) AS avg_index,
 round(max(data_quality_index), 6) AS max_index FROM quality""",
)
def _quality_range(d: Data) -> DataFrame:
    return rounded(quality.quality_range(d.quality))


@query(
    "label_counts",
    f"""SELECT label, count(*) AS n_rows, round(count(*) * 100e0 / (SELECT count(*) FROM quality ), 6) AS pct
FROM (SELECT {_LABEL_SQL} AS label FROM quality ) labelled GROUP BY label""",
)
def _label_counts(d: Data) -> DataFrame:
    labelled = d.quality.select(quality.quality_label().alias("is_done"))
    return rounded(quality.label_counts(labelled))


@query("distinct_labels", f"SELECT DISTINCT {_LABEL_SQL} AS is_done FROM quality")
def _distinct_labels(d: Data) -> DataFrame:
    return d.quality.select(quality.quality_label().alias("is_done")).distinct()


# -- history ----------------------------------------------------------------

_UH = [c for c in USER.fields if c not in ("user_id", "user_order_count", "user_done_count")]
_DH = [c for c in DRIVER.fields if c not in ("driver_id", "driver_bid_count", "driver_done_count")]


@query("user_history", f"SELECT user_id, user_order_count, user_done_count, {o.r(*_UH)} FROM uh")
def _user_history(d: Data) -> DataFrame:
    return rounded(history.build_history(d.bids, USER))


@query(
    "driver_history",
    f"SELECT driver_id, driver_bid_count, driver_done_count, {o.r(*_DH)} FROM dh",
)
def _driver_history(d: Data) -> DataFrame:
    return rounded(history.build_history(d.bids, DRIVER))


@query(
    "history_guard",
    f"""SELECT 'varied' AS labels, user_id, user_order_count, {o.r('user_avg_bid')} FROM uh
WHERE (SELECT count(DISTINCT is_done) FROM bids ) > 1""",
)
def _history_guard(d: Data) -> DataFrame:
    """With one distinct label the table is empty; with two it is whole."""
    constant = history.build_history(d.bids.withColumn("is_done", F.lit("cancel")), USER)
    varied = history.build_history(d.bids, USER)
    tagged = [
        t.select(F.lit(n).alias("labels"), "user_id", "user_order_count", "user_avg_bid")
        for n, t in (("constant", constant), ("varied", varied))
    ]
    return rounded(tagged[0].unionByName(tagged[1]))


@query(
    "history_defaults",
    "SELECT "
    + ", ".join(
        f"(SELECT round(avg({c}), 6) FROM {t} ) AS {c}"
        for t, names in (("uh", o.USER_SERVED), ("dh", o.DRIVER_SERVED))
        for c in names
    ),
)
def _history_defaults(d: Data) -> DataFrame:
    means = history.history_defaults(d.users, USER)
    others = history.history_defaults(d.drivers, DRIVER)
    packed = others.select(F.struct("*").alias("_d")).scalar()
    return rounded(means.select("*", *[packed[c].alias(c) for c in others.columns]))


@query(
    "history_summary",
    """SELECT users, round(user_mean_rate, 6) AS user_mean_rate, round(user_mean_ratio, 6) AS user_mean_ratio, user_vip,
 drivers, round(driver_mean_rate, 6) AS driver_mean_rate, round(driver_mean_ratio, 6) AS driver_mean_ratio, driver_active
FROM (SELECT count(*) AS users, avg(user_acceptance_rate) AS user_mean_rate, avg(user_avg_price_ratio) AS user_mean_ratio, sum(user_is_vip) AS user_vip FROM uh ) u,
 (SELECT count(*) AS drivers, avg(driver_acceptance_rate) AS driver_mean_rate, avg(driver_avg_bid_ratio) AS driver_mean_ratio, sum(driver_is_active) AS driver_active FROM dh ) d""",
)
def _history_summary(d: Data) -> DataFrame:
    return rounded(history.history_summary(d.users, d.drivers))


@query("join_user_history", f"SELECT {K}, {o.r(*USER.fills)} FROM joined")
def _join_user_history(d: Data) -> DataFrame:
    return rounded(history.join_history(d.kept_bids, d.users, USER).select(*KEY, *USER.fills))


@query("join_driver_history", f"SELECT {K}, {o.r(*DRIVER.fills)} FROM joined")
def _join_driver_history(d: Data) -> DataFrame:
    return rounded(history.join_history(d.kept_bids, d.drivers, DRIVER).select(*KEY, *DRIVER.fills))


@query("lookup_user_history", f"SELECT order_id, {o.r(*o.USER_SERVED)} FROM looked_up")
def _lookup_user_history(d: Data) -> DataFrame:
    found = history.lookup_history(d.kept_orders, d.users, USER)
    return rounded(found.select("order_id", *USER.served))


@query("lookup_driver_history", f"SELECT order_id, {o.r(*o.DRIVER_SERVED)} FROM looked_up")
def _lookup_driver_history(d: Data) -> DataFrame:
    found = history.lookup_history(d.kept_orders, d.drivers, DRIVER)
    return rounded(found.select("order_id", *DRIVER.served))


# -- scalar functions -------------------------------------------------------

_FUEL = "distance_in_meters / 1000e0 * 9e0 / 100e0"


@query(
    "fuel_cost",
    f"""SELECT {K}, round({_FUEL}, 6) AS fuel_liters, round({_FUEL} * 55e0, 6) AS fuel_cost_rub,
 round(distance_in_meters / 1000e0 * 12e0 / 100e0 * 60e0, 6) AS thirsty_cost, money({_FUEL} * 55e0) AS shown_cost FROM bids""",
)
def _fuel_cost(d: Data) -> DataFrame:
    metres = num("distance_in_meters")
    out = d.bids.select(
        *KEY,
        fare.fuel_litres(metres).alias("fuel_liters"),
        fare.fuel_cost(metres).alias("fuel_cost_rub"),
        fare.fuel_cost(metres, 12.0, 60.0).alias("thirsty_cost"),
        F.round(fare.fuel_cost(metres), 2).alias("shown_cost"),
    )
    return rounded(out)


@query("min_profitable", f"SELECT {K}, round({_FUEL} * 55e0 * 1.3e0, 6) AS min_profitable_price FROM bids")
def _min_profitable(d: Data) -> DataFrame:
    least = fare.min_profitable(fare.fuel_cost(num("distance_in_meters")))
    return rounded(d.bids.select(*KEY, least.alias("min_profitable_price")))


@query("net_profit", f"SELECT {K}, round(price_bid_local - {_FUEL} * 55e0, 6) + 0e0 AS net_profit FROM bids")
def _net_profit(d: Data) -> DataFrame:
    profit = num("price_bid_local") - fare.fuel_cost(num("distance_in_meters"))
    return rounded(d.bids.select(*KEY, profit.alias("net_profit")))


@query(
    "reference_price",
    f"""SELECT {K}, round(100e0 + distance_in_meters / 1000e0 * 15e0 + duration_in_seconds / 60e0 * 5e0, 6) AS reference_price FROM bids""",
)
def _reference_price(d: Data) -> DataFrame:
    price = fare.reference_price(num("distance_in_meters"), num("duration_in_seconds"))
    return rounded(d.bids.select(*KEY, price.alias("reference_price")))


@query("taxi_type", f"SELECT {K}, carname, carmodel, {o.TAXI} AS taxi_type FROM bids")
def _taxi_type(d: Data) -> DataFrame:
    kind = fare.taxi_type(F.col("carname"), F.col("carmodel"))
    return d.bids.select(*KEY, "carname", "carmodel", kind.alias("taxi_type"))


@query(
    "clip",
    f"SELECT {K}, CASE WHEN driver_rating IS NOT NULL THEN round(least(greatest(driver_rating, 4.5e0), 4.8e0), 6) END AS rating FROM bids",
)
def _clip(d: Data) -> DataFrame:
    return rounded(d.bids.select(*KEY, clip(F.col("driver_rating"), 4.5, 4.8).alias("rating")))


@query(
    "elementwise_max",
    f"""SELECT {K}, CASE WHEN driver_rating IS NOT NULL THEN round(greatest(driver_rating, pickup_in_seconds / 100e0), 6) END AS larger FROM bids""",
)
def _elementwise_max(d: Data) -> DataFrame:
    larger = larger_of(F.col("driver_rating"), num("pickup_in_seconds") / 100)
    return rounded(d.bids.select(*KEY, larger.alias("larger")))


@query("cyclic_encoding", f"SELECT {K}, {o.r('hour_sin', 'hour_cos', 'day_sin', 'day_cos')} FROM feat")
def _cyclic_encoding(d: Data) -> DataFrame:
    ts = F.col("order_timestamp")
    hour_sin, hour_cos = clock.cycle(clock.hour_of(ts), 24)
    day_sin, day_cos = clock.cycle(clock.weekday_of(ts), 7)
    columns = {"hour_sin": hour_sin, "hour_cos": hour_cos, "day_sin": day_sin, "day_cos": day_cos}
    return rounded(d.bids.select(*KEY, *[c.alias(n) for n, c in columns.items()]))


@query("calendar_parts", f"SELECT {K}, CAST(h AS INT) AS hour, CAST(w AS INT) AS weekday, CAST(dom AS INT) AS month_day FROM feat")
def _calendar_parts(d: Data) -> DataFrame:
    ts = F.col("order_timestamp")
    return d.bids.select(
        *KEY,
        clock.hour_of(ts).alias("hour"),
        clock.weekday_of(ts).alias("weekday"),
        clock.month_day_of(ts).alias("month_day"),
    )


_TIME_FLAGS = (
    "is_weekend", "is_morning_peak", "is_evening_peak", "is_peak_hour", "is_night",
    "is_lunch_time", "is_month_start", "is_month_end", "hour_quartile",
)


@query("time_flags", f"SELECT {K}, {', '.join(_TIME_FLAGS)} FROM feat")
def _time_flags(d: Data) -> DataFrame:
    return d.row_features.select(*KEY, *[num(c).alias(c) for c in _TIME_FLAGS])


_TENURE = ("driver_experience_days", "driver_experience_years")


@query("tenure", f"SELECT {K}, {o.r(*_TENURE)} FROM feat")
def _tenure(d: Data) -> DataFrame:
    return rounded(d.row_features.select(*KEY, *_TENURE))


@query("log1p", f"SELECT {K}, {o.r('response_time_log')} FROM feat")
def _log1p(d: Data) -> DataFrame:
    return rounded(d.row_features.select(*KEY, "response_time_log"))


@query(
    "non_finite_to_null",
    f"SELECT {K}, CASE WHEN NOT isinf(price_increase_pct) THEN round(price_increase_pct, 6) + 0e0 END AS value FROM meas",
)
def _non_finite_to_null(d: Data) -> DataFrame:
    value = finite_or_null(F.col("price_increase_pct"))
    return rounded(cleaning.with_measures(d.bids).select(*KEY, value.alias("value")))


# -- input checks and statistics --------------------------------------------


@query(
    "check_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c != 'platform'} AS is_present,"
        f" count({'NULL' if c == 'platform' else c}) AS n_filled FROM bids "
        for c in orders.REQUIRED_BID_COLUMNS
    ),
)
def _check_columns(d: Data) -> DataFrame:
    return orders.check_columns(d.bids.drop("platform"))


@query("add_missing_label", "SELECT 'cancel' AS is_done, platform, count(*) AS n_rows FROM bids GROUP BY platform")
def _add_missing_label(d: Data) -> DataFrame:
    labelled = orders.add_missing_label(d.bids.drop("is_done"))
    return labelled.groupBy("is_done", "platform").agg(F.count("*").alias("n_rows"))


@query("min_rows_guard", "SELECT platform, count(*) AS n_rows FROM marked WHERE NOT exact_duplicate GROUP BY platform")
def _min_rows_guard(d: Data) -> DataFrame:
    kept = orders.require_rows(cleaning.clean(d.bids, d.row_order))
    return kept.groupBy("platform").agg(F.count("*").alias("n_rows"))


@query(
    "prob_quantiles",
    """SELECT round(min(probability), 6) AS min, round(max(probability), 6) AS max, round(avg(probability), 6) AS mean,
 round(quantile_cont(probability, 0.25), 6) AS q1, round(quantile_cont(probability, 0.5), 6) AS median, round(quantile_cont(probability, 0.75), 6) AS q3
FROM score_rows""",
)
def _prob_quantiles(d: Data) -> DataFrame:
    return rounded(statistics.prob_quantiles(d.scored_bids))
