"""Derived measures, anomaly marks, de-duplication and cleaning of bids."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from farelens.functions.clock import parsed, seconds_between
from farelens.functions.missing import num, ratio
from farelens.schema import BID_TIMES
from farelens.session import stored

DUPLICATE_KEY = ("order_id", "driver_id", "price_bid_local", "pickup_in_meters", "tender_timestamp")

# Limits of the anomaly predicates.
MAX_RESPONSE_S = 300
MIN_TRIP_M = 500
MIN_TRIP_S = 60
MAX_TRIP_M = 100_000
MAX_TRIP_S = 7200
MAX_CITY_KMH = 80
MAX_POSSIBLE_KMH = 120
MIN_KMH = 8
MAX_PICKUP_RATIO = 5
MAX_PICKUP_KMH = 100
MAX_MARKUP_PCT = 100
MAX_PRICE = 5000

# Report text per problem.
PROBLEM_TEXT = {
    "future_driver": "Водитель зарегистрирован после заказа",
    "future_bid": "Бид отправлен до создания заказа",
    "slow_response": "Медленный ответ водителя (>5 мин)",
    "zero_distance": "Нулевое/отрицательное расстояние",
    "zero_duration": "Нулевая/отрицательная длительность",
    "zero_price": "Нулевая/отрицательная цена",
    "too_short_trip": "Слишком короткая поездка (<500м)",
    "too_quick_trip": "Слишком быстрая поездка (<60сек)",
    "extreme_distance": "Слишком длинная поездка (>100 км)",
    "extreme_duration": "Слишком долгая поездка (>2 ч)",
    "too_fast_city": "Слишком высокая скорость (>80 км/ч)",
    "physically_impossible": "Физически невозможная скорость (>120 км/ч)",
    "too_slow": "Слишком низкая скорость (<8 км/ч)",
    "extreme_pickup_ratio": "Подача >5x длиннее поездки",
    "extreme_pickup_speed": "Скорость подачи >100 км/ч",
    "extreme_markup": "Наценка >100%",
    "extreme_price": "Цена >5000₽",
    "exact_duplicate": "Точный дубликат (все поля совпадают)",
    "not_accepted": "Отклонённый бид (is_done=cancel)",
}


def parse_times(bids: DataFrame) -> DataFrame:
    """Time columns given as text become timestamps; unreadable text becomes null."""
    texts = {f.name for f in bids.schema.fields if f.dataType.typeName() == "string"}
    return bids.withColumns({c: parsed(F.col(c)) for c in BID_TIMES if c in texts})


def price_increase(bid: Column, start: Column) -> Column:
    """Percent over the start price; infinite (with sign) where the start price is
    zero, and missing where both are zero."""
    unbounded = F.when(bid > 0, F.lit(float("inf"))).when(bid < 0, F.lit(float("-inf")))
    return F.when(start == 0, unbounded).otherwise(ratio(bid - start, start) * 100)


def with_measures(bids: DataFrame) -> DataFrame:
    """Add response time, speeds, pickup ratio and price increase."""
    kmh = F.lit(3.6)
    return bids.withColumns(
        {
            "response_time_seconds": seconds_between(
                F.col("order_timestamp"), F.col("tender_timestamp")
            ),
            "avg_speed_kmh": ratio(F.col("distance_in_meters"), F.col("duration_in_seconds")) * kmh,
            "pickup_speed_kmh": ratio(F.col("pickup_in_meters"), F.col("pickup_in_seconds")) * kmh,
            "pickup_ratio": ratio(F.col("pickup_in_meters"), F.col("distance_in_meters")),
            "price_increase_pct": price_increase(
                num("price_bid_local"), num("price_start_local")
            ),
        }
    )


def anomaly_predicates() -> dict[str, Column]:
    """The 17 predicates over ``with_measures`` columns, false where unknown."""
    metres, seconds = F.col("distance_in_meters"), F.col("duration_in_seconds")
    bid, speed = F.col("price_bid_local"), F.col("avg_speed_kmh")
    found = {
        "zero_distance": metres <= 0,
        "zero_duration": seconds <= 0,
        "zero_price": bid <= 0,
        "future_driver": F.col("driver_reg_date") > F.col("order_timestamp"),
        "future_bid": F.col("tender_timestamp") < F.col("order_timestamp"),
        "slow_response": F.col("response_time_seconds") > MAX_RESPONSE_S,
        "too_short_trip": metres < MIN_TRIP_M,
        "too_quick_trip": seconds < MIN_TRIP_S,
        "extreme_distance": metres > MAX_TRIP_M,
        "extreme_duration": seconds > MAX_TRIP_S,
        "too_fast_city": speed > MAX_CITY_KMH,
        "physically_impossible": seconds < metres / F.lit(MAX_POSSIBLE_KMH / 3.6),
        "too_slow": speed < MIN_KMH,
        "extreme_pickup_ratio": F.col("pickup_ratio") > MAX_PICKUP_RATIO,
        "extreme_pickup_speed": F.col("pickup_speed_kmh") > MAX_PICKUP_KMH,
        "extreme_markup": F.col("price_increase_pct") > MAX_MARKUP_PCT,
        "extreme_price": bid > MAX_PRICE,
    }
    return {name: F.coalesce(p, F.lit(False)) for name, p in found.items()}


def any_of(predicates: list[Column]) -> Column:
    return reduce(or_, predicates)


def anomaly_flags(bids: DataFrame) -> DataFrame:
    """Bids with the measures and one boolean column per predicate."""
    return with_measures(bids).select("*", *[p.alias(n) for n, p in anomaly_predicates().items()])


def not_accepted() -> Column:
    return F.coalesce(F.col("is_done") != "done", F.lit(True))


def dedupe_first(bids: DataFrame, row_order: list[str]) -> DataFrame:
    """First row of each group of copies.

    ``row_number() = 1`` is planned with a group limit below the exchange, so a
    group holding a large share of the rows sends one row per task.
    """
    window = Window.partitionBy(*DUPLICATE_KEY).orderBy(*row_order)
    return (
        bids.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") == 1).drop("_rn")
    )


def clean(
    bids: DataFrame, row_order: list[str], soft: bool = True, only_accepted: bool = False
) -> DataFrame:
    """Remove copies; in strict mode also every anomalous row."""
    kept = with_measures(dedupe_first(bids, row_order))
    if not soft:
        kept = kept.filter(~any_of(list(anomaly_predicates().values())))
    if only_accepted:
        kept = kept.filter(~not_accepted())
    return kept


def _first_of_copies(bids: DataFrame, row_order: list[str], extra: dict[str, Column]) -> DataFrame:
    """Per group of copies: number of rows and ``extra`` of the first row (one
    grouped aggregate with map-side combine, nothing is marked row by row)."""
    first = F.min(F.struct(*row_order, *[c.alias(n) for n, c in extra.items()]))
    grouped = bids.groupBy(*DUPLICATE_KEY).agg(F.count("*").alias("copies"), first.alias("_f"))
    return grouped.select(*DUPLICATE_KEY, "copies", *[F.col("_f")[n].alias(n) for n in extra])


def anomaly_counts(bids: DataFrame, row_order: list[str], only_accepted: bool = False) -> DataFrame:
    """Rows per problem (non-zero only) with its report text."""
    marked = with_measures(bids)
    marks = anomaly_predicates()
    if only_accepted:
        marks["not_accepted"] = not_accepted()
    per_key = marked.groupBy(*DUPLICATE_KEY).agg(
        F.count("*").alias("_n"), *[F.count_if(p).alias(n) for n, p in marks.items()]
    )
    totals = per_key.agg(
        F.sum(F.col("_n") - 1).alias("exact_duplicate"), *[F.sum(n).alias(n) for n in marks]
    )
    names = ["exact_duplicate", *marks]
    rows = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("problem"),
                    F.lit(PROBLEM_TEXT[n]).alias("description"),
                    F.col(n).alias("n_rows"),
                )
                for n in names
            ]
        )
    )
    return totals.select(rows).filter(F.col("n_rows") > 0)


def clean_summary(
    bids: DataFrame, row_order: list[str], soft: bool = True, only_accepted: bool = False
) -> DataFrame:
    """Initial, removed and kept rows with percents, in one pass."""
    drop = F.lit(False)
    if not soft:
        drop = any_of(list(anomaly_predicates().values()))
    if only_accepted:
        drop = drop | not_accepted()
    groups = _first_of_copies(with_measures(bids), row_order, {"drop": drop})
    initial, kept = F.sum("copies"), F.count_if(~F.col("drop"))
    out = groups.agg(initial.alias("initial"), kept.alias("kept"))
    removed = F.col("initial") - F.col("kept")
    return out.select(
        "initial",
        removed.alias("removed"),
        (ratio(removed, F.col("initial")) * 100).alias("removed_pct"),
        "kept",
        (ratio(F.col("kept"), F.col("initial")) * 100).alias("kept_pct"),
    )


def cleaned_groups(
    bids: DataFrame, row_order: list[str], soft: bool = True, only_accepted: bool = False
) -> tuple[DataFrame, list[str]]:
    """A row per group of copies: its first row, whether that stays, and its rows per problem.

    One grouped aggregate with map-side combine, so a large group of copies is a row per task before
    anything moves.
    """
    marks = anomaly_predicates()
    measured = with_measures(bids)
    drop = any_of(list(marks.values())) if not soft else F.lit(False)
    if only_accepted:
        marks["not_accepted"] = not_accepted()
        drop = drop | not_accepted()
    rest = [c for c in measured.columns if c not in row_order]
    first = F.min(F.struct(*row_order, drop.alias("_drop"), F.struct(*rest).alias("_rest")))
    counts = [F.count_if(p).alias(f"_{n}") for n, p in marks.items()]
    groups = measured.groupBy(*[F.col(c).alias(f"_key_{c}") for c in DUPLICATE_KEY]).agg(
        first.alias("_first"), F.count("*").alias("_copies"), *counts
    )
    return groups, list(marks)


def clean_and_report(
    bids: DataFrame, row_order: list[str], path: str, soft: bool = True, only_accepted: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Write the cleaned bids to ``path`` and report on the cleaning, in one pass over the bids.

    The groups of copies are stored; the cleaned bids and all counts come from that one table, so they
    agree however often executors are lost. Returns problems with their rows (non-zero only), and
    initial, removed and kept rows with percents.
    """
    spark = bids.sparkSession
    groups, marks = cleaned_groups(bids, row_order, soft, only_accepted)
    groups = stored(groups, "copies")
    totals = [
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("initial"),
        F.count_if(~F.col("_first._drop")).alias("kept"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("exact_duplicate"),
        *[F.coalesce(F.sum(f"_{n}"), F.lit(0)).alias(n) for n in marks],
    ]
    kept = groups.filter(~F.col("_first._drop"))
    columns = [F.col(f"_first.{c}") if c in row_order else F.col(f"_first._rest.{c}") for c in with_measures(bids).columns]
    kept.select(*columns).write.mode("overwrite").parquet(path)
    found = groups.agg(*totals).first().asDict()
    problems = [(n, PROBLEM_TEXT[n], found[n]) for n in ("exact_duplicate", *marks) if found[n]]
    counts = spark.createDataFrame(problems, "problem string, description string, n_rows bigint")
    removed, initial = F.col("initial") - F.col("kept"), F.col("initial")
    summary = spark.createDataFrame([(found["initial"], found["kept"])], "initial bigint, kept bigint").select(
        "initial",
        removed.alias("removed"),
        (ratio(removed, initial) * 100).alias("removed_pct"),
        "kept",
        (ratio(F.col("kept"), initial) * 100).alias("kept_pct"),
    )
    return counts, summary


def bids_per_order(bids: DataFrame) -> DataFrame:
    """Distinct orders and mean bids per order (0 without orders)."""
    per_order = bids.groupBy("order_id").agg(F.count("*").alias("n"))
    orders = F.count("order_id")
    mean = F.coalesce(ratio(F.sum("n"), orders), F.lit(0.0))
    return per_order.agg(orders.alias("unique_orders"), mean.alias("avg_bids_per_order"))


def label_binary() -> Column:
    return F.when(F.col("is_done") == "done", 1).otherwise(0)


def class_balance(bids: DataFrame) -> DataFrame:
    counts = bids.agg(F.count("*").alias("n"), F.sum(label_binary()).alias("done_count"))
    done, cancel = F.col("done_count"), F.col("n") - F.col("done_count")
    done_pct = F.coalesce(ratio(done, F.col("n")) * 100, F.lit(0.0))
    return counts.select(
        done.alias("done_count"),
        cancel.alias("cancel_count"),
        done_pct.alias("done_pct"),
        (F.lit(100.0) - done_pct).alias("cancel_pct"),
        ratio(cancel, done).alias("cancel_per_done"),
    )


def pos_weight(train: DataFrame, label: str = "label") -> DataFrame:
    positive = F.count_if(F.col(label) == 1)
    return train.agg(ratio(F.count_if(F.col(label) == 0), positive).alias("pos_weight"))
