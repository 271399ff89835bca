"""Registered queries and, where SQL can express them, their oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farelens.plans.data import Data
from farelens.plans.oracle_views import VIEWS, _mentions, money, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def oracle_text(select: str) -> str:
    return with_views(*[v for v in VIEWS if _mentions(select, v)]) + money(select.strip())


def query(key: str, sql: str | None = None):
    """Register ``fn(data) -> DataFrame`` under ``key``; ``sql`` selects from the views."""

    def wrap(fn: Callable[[Data], DataFrame]) -> Callable[[Data], DataFrame]:
        QUERIES[key] = lambda spark, folder: fn(Data(spark, folder))
        if sql is not None:
            ORACLES[key] = oracle_text(sql)
        return fn

    return wrap


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns to a fixed number of decimals."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) for c in doubles})


def quick_round(value: Column, digits: int) -> Column:
    """``F.round`` of a double, which goes through decimal text, by arithmetic wherever that is exact.

    Below a billion steps the error of the product is under a millionth of a step, so only values that
    close to the middle of two steps, larger and infinite ones and NaN are left to ``F.round``.
    """
    steps = value * F.lit(10.0**digits)
    whole = F.rint(steps)
    sure = (F.abs(steps) < 1e9) & (F.abs(steps - whole) < 0.499999)
    # Adding zero takes the sign off a negative zero.
    return F.when(sure, (whole + F.lit(0.0)) / F.lit(10.0**digits)).otherwise(F.round(value, digits))
