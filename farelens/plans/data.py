"""The inputs that the registered queries share, each built on first use."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from farelens.operators.features import matched_features, row_features, with_match
from farelens.operators.history import DRIVER, USER, Side, build_history, fill_history, match_history
from farelens.operators.orders import prepare_orders
from farelens.operators.pricing import price_curve, recommendation, sweep
from farelens.operators.quality import with_quality
from farelens.operators.quotes import with_axis
from farelens.operators.scoring import score_logistic
from farelens.session import apply_settings, cut_lineage, stored
from farelens.sources.bids import VIEW_ROW_ORDER, bid_lines, bids_of, bids_view, orders_view

KEY = ("order_id", "copy_no", "line_no", "driver_id", "part_id", "ext")


def bids_with(matched: DataFrame, *sides: Side) -> DataFrame:
    """Bids of matched lines, with the filled columns of each side."""
    bids = bids_of(matched, tuple(name for side in sides for name in side.fills))
    for side in sides:
        bids = fill_history(bids, side)
    return bids


class Data:
    """Bids, histories and priced orders of one data folder."""

    row_order = VIEW_ROW_ORDER

    def __init__(self, spark: SparkSession, folder: str):
        apply_settings(spark)
        self.spark, self.folder = spark, folder

    @cached_property
    def bids(self) -> DataFrame:
        return bids_view(self.spark, self.folder)

    @cached_property
    def lines(self) -> DataFrame:
        """Lines with their orders, joined once and stored: what reads bids again shuffles nothing."""
        return stored(bid_lines(self.spark, self.folder), "bid-lines")

    @cached_property
    def kept_bids(self) -> DataFrame:
        """The bids again, for work that reads them more than once."""
        return bids_of(self.lines)

    @cached_property
    def quality(self) -> DataFrame:
        return with_quality(self.bids)

    @cached_property
    def users(self) -> DataFrame:
        """Small next to the bids and read several times, so computed once."""
        return cut_lineage(build_history(self.kept_bids, USER))

    @cached_property
    def drivers(self) -> DataFrame:
        return cut_lineage(build_history(self.kept_bids, DRIVER))

    def matched(self, *sides: Side) -> DataFrame:
        """Lines looked up in the histories, before they widen into bids."""
        lines = self.lines
        for side in sides:
            lines = match_history(lines, self.users if side is USER else self.drivers, side)
        return lines

    @cached_property
    def joined(self) -> DataFrame:
        return bids_with(self.matched(USER, DRIVER), USER, DRIVER)

    @cached_property
    def row_features(self) -> DataFrame:
        return row_features(self.bids)

    @cached_property
    def features(self) -> DataFrame:
        """130 raw features with the row key and the label; they are read several times."""
        keep = ("k_order_id", "k_copy_no", "k_line_no", "k_driver_id", "k_part_id", "k_ext")
        bids = bids_with(stored(self.matched(USER, DRIVER), "matched-lines"), USER, DRIVER)
        named = bids.withColumns({k: F.col(k.removeprefix("k_")) for k in keep})
        label = F.when(F.col("is_done") == "done", 1.0).otherwise(0.0)
        return matched_features(with_match(named.withColumn("label", label)), (*keep, "label"))

    @cached_property
    def scored_bids(self) -> DataFrame:
        """Bids with a fixed logistic probability and a 0/1 label."""
        wide = row_features(bids_with(self.matched(DRIVER), DRIVER))
        z = (
            F.lit(1.2)
            - F.coalesce(F.col("price_increase_pct"), F.lit(0.0)) * 0.02
            + F.col("is_peak_hour") * 0.15
            - F.col("distance_km") * 0.02
            + F.col("driver_acceptance_rate") * 0.5
        )
        return wide.withColumns(
            {
                "probability": F.lit(1.0) / (F.lit(1.0) + F.exp(-z)),
                "label": F.when(F.col("is_done") == "done", 1).otherwise(0),
            }
        )

    @cached_property
    def orders(self) -> DataFrame:
        return orders_view(self.bids)

    @cached_property
    def kept_orders(self) -> DataFrame:
        return orders_view(self.kept_bids)

    @cached_property
    def prepared(self) -> DataFrame:
        return prepare_orders(self.kept_orders, self.users, self.drivers)

    @cached_property
    def scorer(self):
        return score_logistic()

    @cached_property
    def curve(self) -> DataFrame:
        return price_curve(self.prepared, self.scorer)

    @cached_property
    def swept(self) -> DataFrame:
        return sweep(self.prepared, self.scorer)

    @cached_property
    def recommended(self) -> DataFrame:
        return recommendation(self.swept)

    @cached_property
    def axis(self) -> DataFrame:
        return with_axis(self.recommended)

