"""Recommendations for requests that arrive as files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from farelens.operators.grid_scoring import GridScorer
from farelens.operators.orders import mark_order_errors, prepare_orders
from farelens.operators.pricing import COARSE_POINTS, FINE_POINTS, recommend_batch
from farelens.operators.scoring import Scorer
from farelens.schema import ORDER_DDL, UNREADABLE


def stream_orders(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Requests of a folder of JSON files; a line that is no request keeps its text as ``UNREADABLE``."""
    reader = spark.readStream.schema(f"{ORDER_DDL}, {UNREADABLE} string").option("maxFilesPerTrigger", files_per_batch)
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", UNREADABLE).json(folder)


def stream_recommend(
    orders: DataFrame,
    users: DataFrame,
    drivers: DataFrame,
    scorer: Scorer | GridScorer,
    out: str,
    checkpoint: str,
    coarse: int = COARSE_POINTS,
    fine: int = FINE_POINTS,
    transform: Callable[[DataFrame], DataFrame] = lambda df: df,
    rejected: str | None = None,
) -> StreamingQuery:
    """Price every request that has arrived, with the same plan as a batch.

    Requests that break a rule go to ``rejected`` (beside ``out`` if not given), whole, with the names
    of the fields at fault; each request is in exactly one of the two. No state is kept between
    batches. Each micro-batch overwrites its own folder in both, rejected requests first, so a batch
    that is run again after a failure leaves one copy of its rows.
    """
    refused = rejected or f"{out.rstrip('/')}_rejected"

    def price(batch: DataFrame, batch_id: int) -> None:
        # Read once, though written to two places.
        marked = mark_order_errors(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good = F.size("errors") == 0
            marked.filter(~good).write.mode("overwrite").parquet(f"{refused}/batch={batch_id}")
            valid = marked.filter(good).drop("errors", UNREADABLE)
            priced = transform(recommend_batch(prepare_orders(valid, users, drivers), scorer, coarse, fine))
            priced.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        finally:
            marked.unpersist()

    writer = orders.writeStream.foreachBatch(price).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def rejected_requests(spark: SparkSession, rejected: str) -> DataFrame:
    """All requests that were refused so far, with ``errors`` and the batch they came in."""
    schema = f"{ORDER_DDL}, {UNREADABLE} string, errors array<string>, batch bigint"
    return spark.read.schema(schema).option("basePath", rejected).parquet(f"{rejected}/batch=*")
