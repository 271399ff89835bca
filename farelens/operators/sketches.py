"""Quantile sketches that are kept per part of the data and merged.

A sketch is a few kilobytes whatever it has seen. Each part of a table (a day, a file, a load) keeps
its own; quantiles of any set of parts come from merging theirs, without reading the rows again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Size parameter of the sketch: the rank of an answer is off by 1.33 % at most, 99 times of 100.
K = 200
RANK_ERROR = 0.0133
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def sketch_parts(df: DataFrame, part: list[str], column: str, k: int = K) -> DataFrame:
    """One row per part: its sketch, count, sum and extremes of ``column``; missing values are left out."""
    value = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    held = df.select(*part, value.alias("_value")).filter(F.col("_value").isNotNull())
    return held.groupBy(*part).agg(
        F.kll_sketch_agg_double("_value", k).alias("sketch"),
        F.count("_value").alias("n"),
        F.sum("_value").alias("total"),
        F.min("_value").alias("min"),
        F.max("_value").alias("max"),
    )


def merge_parts(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sketches of parts put together, per group of ``by`` or all; merging merged ones is the same."""
    return parts.groupBy(*(by or [])).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"),
        F.sum("n").alias("n"),
        F.sum("total").alias("total"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )


def sketched(name: str, probability: float) -> Column:
    return F.kll_sketch_get_quantile_double("sketch", F.lit(float(probability))).alias(name)


def sketch_report(merged: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The columns of ``prob_quantiles``: extremes and mean exact, quartiles from the sketch."""
    return merged.select(
        *(by or []), "min", "max", (F.col("total") / F.col("n")).alias("mean"),
        *[sketched(name, p) for name, p in QUARTILES.items()],
    )
