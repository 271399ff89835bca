"""Per-user and per-driver history: aggregates, guard, joins and lookups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from farelens.functions.missing import flag, ratio
from farelens.operators.joins import left_lookup
from farelens.schema import DRIVER_HISTORY_FIELDS, USER_HISTORY_FIELDS, history_ddl


@dataclass(frozen=True, eq=False)
class Side:
    """Names and rules of one history table."""

    key: str
    count: str
    ratio: str
    fields: dict[str, str]
    # Values where a bid has no history; "bid" and "start" mean the bid's own price.
    fills: dict[str, float | str]
    # Means used when no history table exists at all.
    constants: dict[str, float]

    @property
    def prefix(self) -> str:
        return self.key.removesuffix("_id")

    @property
    def served(self) -> list[str]:
        """The columns a price request uses."""
        return list(self.constants)


USER = Side(
    key="user_id",
    count="user_order_count",
    ratio="user_avg_price_ratio",
    fields=USER_HISTORY_FIELDS,
    fills={
        "user_order_count": 1.0,
        "user_done_count": 0.0,
        "user_acceptance_rate": 0.5,
        "user_avg_bid": "price_bid_local",
        "user_avg_start_price": "price_start_local",
        "user_avg_price_ratio": 1.0,
        "user_is_new": 1.0,
        "user_is_vip": 0.0,
        "user_is_price_sensitive": 0.5,
    },
    constants={
        "user_order_count": 10.0,
        "user_acceptance_rate": 0.41,
        "user_avg_price_ratio": 1.18,
        "user_is_new": 0.3,
        "user_is_vip": 0.1,
        "user_is_price_sensitive": 0.5,
    },
)
DRIVER = Side(
    key="driver_id",
    count="driver_bid_count",
    ratio="driver_avg_bid_ratio",
    fields=DRIVER_HISTORY_FIELDS,
    fills={
        "driver_bid_count": 1.0,
        "driver_done_count": 0.0,
        "driver_acceptance_rate": 0.5,
        "driver_avg_bid": "price_bid_local",
        "driver_avg_start_price": "price_start_local",
        "driver_avg_bid_ratio": 1.0,
        "driver_is_active": 0.5,
        "driver_is_aggressive": 0.0,
        "driver_is_flexible": 0.5,
    },
    constants={
        "driver_bid_count": 20.0,
        "driver_acceptance_rate": 0.43,
        "driver_avg_bid_ratio": 1.15,
        "driver_is_active": 0.5,
        "driver_is_aggressive": 0.2,
        "driver_is_flexible": 0.4,
    },
)


def empty_history(df: DataFrame, side: Side) -> DataFrame:
    return df.sparkSession.createDataFrame([], history_ddl(side.fields))


def labels_vary(bids: DataFrame) -> DataFrame:
    """One row: whether the label column has more than one distinct value."""
    return bids.agg(
        F.coalesce(F.min("is_done") < F.max("is_done"), F.lit(False)).alias("labels_vary")
    )


def _categories(side: Side) -> dict[str, Column]:
    count, markup = F.col(side.count), F.col(side.ratio)
    if side is USER:
        return {
            "user_is_new": flag(count <= 5),
            "user_is_vip": flag(count >= 20),
            "user_is_price_sensitive": flag(markup < 1.1),
        }
    return {
        "driver_is_active": flag(count >= 20),
        "driver_is_aggressive": flag(markup > 1.2),
        "driver_is_flexible": flag(markup < 1.1),
    }


def aggregate_history(bids: DataFrame, side: Side) -> DataFrame:
    """One row per key, without the guard. Rows without a key form no group."""
    p = side.prefix
    grouped = (
        bids.filter(F.col(side.key).isNotNull())
        .groupBy(side.key)
        .agg(
            F.count("is_done").alias(side.count),
            F.count_if(F.col("is_done") == "done").alias(f"{p}_done_count"),
            F.avg("price_bid_local").alias(f"{p}_avg_bid"),
            F.avg("price_start_local").alias(f"{p}_avg_start_price"),
        )
    )
    return (
        grouped.withColumns(
            {
                f"{p}_acceptance_rate": ratio(F.col(f"{p}_done_count"), F.col(side.count)),
                side.ratio: ratio(
                    F.col(f"{p}_avg_bid"), F.col(f"{p}_avg_start_price") + F.lit(0.1)
                ),
            }
        )
        .withColumns(_categories(side))
        .select(*side.fields)
    )


def build_history(bids: DataFrame, side: Side) -> DataFrame:
    """History of one side; empty if the label is absent or does not vary."""
    if "is_done" not in bids.columns:
        return empty_history(bids, side)
    return aggregate_history(bids, side).filter(labels_vary(bids).scalar())


def join_history(
    bids: DataFrame, history: DataFrame, side: Side, small: bool | None = None
) -> DataFrame:
    """Bids with the side's nine columns, filled where there is no history."""
    return fill_history(match_history(bids, history, side, small), side)


def match_history(
    rows: DataFrame, history: DataFrame, side: Side, small: bool | None = None
) -> DataFrame:
    """Rows with the side's columns as they are in the history, null where it has none."""
    return left_lookup(rows, history, side.key, weight=F.col(side.count), small=small)


def fill_history(joined: DataFrame, side: Side) -> DataFrame:
    """Doubles in place of matched columns, filled where there is no history."""
    filled = {
        name: F.coalesce(
            F.col(name).cast("double"), F.col(v) if isinstance(v, str) else F.lit(v)
        )
        for name, v in side.fills.items()
    }
    return joined.withColumns(filled)


def history_defaults(history: DataFrame, side: Side) -> DataFrame:
    """One row: mean of each served column, or the constants for an empty table."""
    return history.agg(
        *[F.coalesce(F.avg(c), F.lit(v)).alias(c) for c, v in side.constants.items()]
    )


def lookup_history(
    orders: DataFrame, history: DataFrame, side: Side, small: bool | None = None
) -> DataFrame:
    """Orders with the side's six served columns; unknown ids get the global means."""
    means = history_defaults(history, side).select(F.struct("*").alias("_d")).scalar()
    served = history.select(side.key, *[F.col(c).cast("double").alias(c) for c in side.served])
    joined = left_lookup(orders, served, side.key, small=small)
    return joined.withColumns({c: F.coalesce(F.col(c), means[c]) for c in side.served})


def history_summary(users: DataFrame, drivers: DataFrame) -> DataFrame:
    """One row with sizes and means of both tables."""
    u = users.agg(
        F.count("*").alias("users"),
        F.avg("user_acceptance_rate").alias("user_mean_rate"),
        F.avg("user_avg_price_ratio").alias("user_mean_ratio"),
        F.sum("user_is_vip").alias("user_vip"),
    )
    d = drivers.agg(
        F.count("*").alias("drivers"),
        F.avg("driver_acceptance_rate").alias("driver_mean_rate"),
        F.avg("driver_avg_bid_ratio").alias("driver_mean_ratio"),
        F.sum("driver_is_active").alias("driver_active"),
    )
    packed = d.select(F.struct("*").alias("_d")).scalar()
    return u.select("*", *[packed[c].alias(c) for c in d.columns])
