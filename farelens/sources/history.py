"""Storing, loading and refreshing the two history tables.

Both are written to a folder of their own and published together by one small file that names it, so
a reader sees both as they were or both as they are. A writer that fails between the two leaves what
was published before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from farelens.operators.history import DRIVER, USER, build_history, empty_history
from farelens.schema import history_ddl
from farelens.sources.bids import path_exists, scan_first_existing


def _paths(folder: str) -> dict:
    return {USER: f"{folder}/user_history.parquet", DRIVER: f"{folder}/driver_history.parquet"}


POINTER_DDL = "version bigint, folder string"


def published_history(spark: SparkSession, folder: str) -> dict:
    """Version and folder of what was published last; version 0 and the folder itself if nothing was."""
    pointers = f"{folder}/published"
    if not path_exists(spark, pointers):
        return {"version": 0, "folder": folder}
    seen = spark.read.schema(POINTER_DDL).json(pointers)
    last = seen.agg(F.max(F.struct("version", "folder")).alias("last")).first()["last"]
    return last.asDict() if last else {"version": 0, "folder": folder}


def publish_history(bids: DataFrame, folder: str) -> int:
    """Write both tables, then publish them; readers of earlier versions keep their files."""
    spark = bids.sparkSession
    version = published_history(spark, folder)["version"] + 1
    # Two writers of one version have folders of their own; the one that sorts last is what all read.
    own = f"{folder}/version={version:08d}-{uuid.uuid4().hex}"
    for side, path in _paths(own).items():
        build_history(bids, side).write.parquet(path)
    pointer = spark.createDataFrame([(version, own)], POINTER_DDL).coalesce(1)
    pointer.write.mode("append").json(f"{folder}/published")  # one file, committed whole or not at all
    return version


def sink_history(bids: DataFrame, folder: str) -> None:
    """Write both tables at fixed places; ``publish_history`` also covers readers meanwhile."""
    for side, path in _paths(folder).items():
        build_history(bids, side).write.mode("overwrite").parquet(path)


def source_history(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Both tables, as published last or else as written to fixed places; two empty ones if either is
    absent, so that lookups use constants."""
    paths = _paths(published_history(spark, folder)["folder"])
    if all(path_exists(spark, p) for p in paths.values()):
        users, drivers = (
            spark.read.schema(history_ddl(side.fields)).parquet(p) for side, p in paths.items()
        )
        return users, drivers
    nothing = spark.range(0)
    return empty_history(nothing, USER), empty_history(nothing, DRIVER)


def refresh_history(
    spark: SparkSession, folder: str, bid_paths: list[str], force: bool = False
) -> bool:
    """Build and publish the tables if absent or forced; false if there is nothing to build from."""
    held = _paths(published_history(spark, folder)["folder"])
    if not force and all(path_exists(spark, p) for p in held.values()):
        return True
    bids = scan_first_existing(spark, bid_paths)
    if bids is None:
        return False
    publish_history(bids, folder)
    return True
