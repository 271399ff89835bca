"""Acceptance-probability scorers that a price sweep can plug in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from farelens.functions import clock, fare
from farelens.functions.missing import num
from farelens.operators.features import serving_features
from farelens.operators.history import DRIVER, USER
from farelens.schema import ORDER_FIELDS


@dataclass(frozen=True)
class Scorer:
    """``prepare`` works once per order, ``score`` on every (order, price) row.

    ``score`` receives the ``inputs``, ``price`` and ``reference_price``, and adds
    ``probability`` while keeping all other columns. ``grid``, where given, runs in the
    worker and returns the same score as a function of a block of orders and an array
    of prices, a row for each order; a sweep then needs no row for each price.
    """

    inputs: tuple[str, ...]
    score: Callable[[DataFrame], DataFrame]
    prepare: Callable[[DataFrame], DataFrame] = field(default=lambda orders: orders)
    grid: Callable[[], Callable[[pd.DataFrame, np.ndarray], np.ndarray]] | None = None


def _logistic_grid() -> Callable[[pd.DataFrame, np.ndarray], np.ndarray]:
    def score(orders: pd.DataFrame, prices: np.ndarray) -> np.ndarray:
        base, reference = (orders[c].to_numpy(np.float64)[:, None] for c in ("score_base", "reference_price"))
        percent = (prices - reference) / reference * 100
        return 1.0 / (1.0 + np.exp(-(base - percent * 0.02)))

    return score


def score_logistic() -> Scorer:
    """A fixed-coefficient logistic score, decreasing in price."""

    def prepare(orders: DataFrame) -> DataFrame:
        hour = clock.hour_of(F.timestamp_seconds(F.col("order_timestamp")))
        km = fare.kilometres(num("distance_in_meters"))
        rest = (
            F.lit(1.2)
            + clock.is_peak(hour) * 0.15
            - km * 0.02
            + F.col("driver_acceptance_rate") * 0.5
        )
        return orders.withColumn("score_base", rest)

    def score(points: DataFrame) -> DataFrame:
        price, reference = F.col("price"), F.col("reference_price")
        percent = (price - reference) / reference * 100
        z = F.col("score_base") - percent * 0.02
        return points.withColumn("probability", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))

    return Scorer(("score_base",), score, prepare, _logistic_grid)


def score_model(model: PipelineModel) -> Scorer:
    """A fitted model over the serving features of each candidate price."""
    inputs = (*ORDER_FIELDS, *USER.served, *DRIVER.served)

    def score(points: DataFrame) -> DataFrame:
        # Plain renames, so that Spark still knows how the orders are placed.
        kept = {c: f"kept_{c}" for c in points.columns}
        renamed = points.withColumns({k: F.col(c) for c, k in kept.items()})
        scored = model.transform(serving_features(renamed, keep=tuple(kept.values())))
        back = [F.col(k).alias(c) for c, k in kept.items()]
        return scored.select(*back, class_probability().alias("probability"))

    return Scorer(inputs, score)


def class_probability(column: str = "calibrated") -> Column:
    """Probability of acceptance out of the model's probability vector."""
    return vector_to_array(F.col(column))[1]
