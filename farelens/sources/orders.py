"""Price requests in, recommendations out, as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farelens.functions.missing import nan_to_null
from farelens.schema import ORDER_DDL, RECOMMENDATION_DDL

# Recommendations of one file at most.
RECORDS_OF_FILE = 100_000


def source_orders(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.schema(ORDER_DDL).json(path))


def orders_from_json(df: DataFrame, text: str = "value") -> DataFrame:
    """Requests held as JSON text in a column."""
    return df.select(F.from_json(F.col(text), ORDER_DDL).alias("_o")).select("_o.*")


def as_recommendation_schema(df: DataFrame) -> DataFrame:
    """Cast a scorer's result to the declared record; fails on missing fields."""
    empty = df.sparkSession.createDataFrame([], RECOMMENDATION_DDL)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in empty.schema.fields])


def recommendation_json() -> Column:
    """The nested record as JSON text; letters outside ASCII stay readable."""
    names = ("zones", "optimal_price", "zone_thresholds", "fuel_economics", "analysis")
    return F.to_json(F.struct(*names))


def sink_recommendation_json(recommendations: DataFrame, path: str) -> None:
    """JSON lines, packed: their field names are most of them. A packed file has one reader, so files end early."""
    writer = recommendations.write.mode("overwrite").option("maxRecordsPerFile", RECORDS_OF_FILE)
    writer.option("compression", "gzip").json(path)
