"""Missing-value rules shared by all operators.

A comparison with a missing value is false, a bound or maximum with a missing
value is missing, and an infinite value counts as missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def num(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def flag(predicate: Column) -> Column:
    """1.0 where the predicate holds, 0.0 where it fails or is unknown."""
    return F.when(predicate, F.lit(1.0)).otherwise(F.lit(0.0))


def clip(value: Column, low: float | Column, high: float | Column) -> Column:
    """Clamp that keeps missing values missing (``least``/``greatest`` skip them)."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(value > high, high).when(value < low, low).otherwise(value)


def larger_of(a: Column, b: Column) -> Column:
    """Maximum of two values; missing if either is."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(a, b))


def finite_or_null(value: Column) -> Column:
    # NaN orders above infinity, so one comparison drops both.
    return F.when(F.abs(value) < float("inf"), value)


def ratio(a: Column, b: Column) -> Column:
    """Quotient that is missing where the divisor is zero."""
    return F.try_divide(num(a), num(b))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Ingest rule: Spark orders NaN above every number, so NaN becomes NULL."""
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in doubles})
