"""Reading bids, and the bid view over the supplied order tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from farelens.functions.missing import nan_to_null
from farelens.operators.cleaning import parse_times
from farelens.schema import BID_FIELDS


def typed_column(name: str, kind: str) -> Column:
    """A text column as its fixed type; times and texts stay as they are."""
    text = F.col(name)
    if kind == "bigint":
        # "5.0" is how a whole number looks in a column that once held a gap.
        whole = text.try_cast("bigint")
        return F.coalesce(whole, text.try_cast("double").try_cast("bigint")).alias(name)
    if kind in ("timestamp", "string"):
        return text
    return text.try_cast(kind).alias(name)


def scan_bids(spark: SparkSession, path: str) -> DataFrame:
    """Bids from CSV with a header, or from Parquet.

    CSV columns are found by name and cast to the fixed types, without an
    inference pass; unreadable values become null. ``row_id`` keeps file order.
    """
    if path.rstrip("/").endswith(".parquet"):
        bids = spark.read.parquet(path)
    else:
        raw = spark.read.option("header", True).csv(path)
        columns = [
            typed_column(c, BID_FIELDS[c]) if c in BID_FIELDS else F.col(c) for c in raw.columns
        ]
        bids = parse_times(raw.select(*columns))
    return nan_to_null(bids).withColumn("row_id", F.monotonically_increasing_id())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark can list the path, on any file system."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def scan_first_existing(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The first path that exists, or nothing."""
    for path in paths:
        if path_exists(spark, path):
            return scan_bids(spark, path)
    return None


# Times its even share that a split may hold before rows are dealt anew.
UNEVEN = 1.25


def spread_if_few(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores where fewer splits hold the rows; evenly split inputs pass unchanged.

    A split that begins inside a row group of a Parquet file is empty, so rows are counted, not splits;
    Parquet counts them from its footers.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= cores:
        held = df.groupBy(F.spark_partition_id().alias("split")).agg(F.count("*").alias("n"))
        most, rows = held.agg(F.max("n"), F.sum("n")).first()
        if not rows or most * cores <= UNEVEN * rows:
            return df
    return df.repartition(max(cores, splits), *keys)


# Order of the rows of one order in the bid view; unique within the order.
VIEW_ROW_ORDER = ["copy_no", "line_no", "driver_id", "part_id", "ext"]


def bid_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with their orders: the few columns of which bids are made."""
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr(
        "l_orderkey AS order_id", "l_suppkey AS driver_id", "l_linenumber AS line_no",
        "l_partkey AS part_id", "l_discount AS disc", "l_extendedprice AS ext",
        "l_returnflag AS returned",
    )
    orders = spark.read.parquet(f"{folder}/orders.parquet").selectExpr(
        "o_orderkey AS order_id",
        "o_custkey AS customer",
        "CAST(o_orderdate AS TIMESTAMP) AS order_date",
    )
    lines = spread_if_few(lines, "order_id", "line_no", "part_id")
    return lines.join(orders, "order_id").selectExpr(
        "order_id", "driver_id",
        "CASE WHEN customer % 97 = 0 THEN NULL ELSE customer END AS user_id",
        "line_no", "part_id", "disc", "ext", "returned", "order_date",
    )


def bids_view(spark: SparkSession, folder: str) -> DataFrame:
    """Bids derived from ``lineitem`` and ``orders``: one bid per line item, and a
    second copy of each bid for every fiftieth order."""
    return bids_of(bid_lines(spark, folder))


def bids_of(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The bids of ``bid_lines``; each bid carries the ``keep`` columns of its line."""
    base = lines.selectExpr(
        *keep,
        "order_id", "driver_id", "user_id", "line_no", "part_id", "disc", "ext",
        "timestampadd(SECOND, CAST((order_id * 7919) % 86400 AS INT), order_date)"
        " AS order_timestamp",
        "CASE WHEN order_id % 101 = 0 THEN 0 ELSE (300 + (order_id * 7919) % 24000)"
        " * CASE WHEN order_id % 67 = 5 THEN 10 ELSE 1 END END AS distance_in_meters",
        "CASE WHEN order_id % 103 = 1 THEN 0 ELSE (30 + (order_id * 104729) % 3600)"
        " * CASE WHEN order_id % 71 = 3 THEN 4 ELSE 1 END END AS duration_in_seconds",
        "(driver_id * 613 + order_id * 17) % 3500 AS pickup_in_meters",
        "(driver_id * 37 + line_no * 59 + order_id) % 600 AS pickup_in_seconds",
        "CASE WHEN driver_id % 29 = 0 THEN NULL ELSE 5e0 - (driver_id % 8) / 10e0 END"
        " AS driver_rating",
        "CAST(date_add(DATE '1993-01-01', CAST((driver_id * 53) % 2600 AS INT)) AS TIMESTAMP)"
        " AS driver_reg_date",
        "element_at(array('LADA', 'LADA', 'Toyota', 'Renault', 'Hyundai', 'Daewoo', 'Nissan',"
        " 'ВАЗ (LADA)'), CAST(driver_id % 8 AS INT) + 1) AS carname",
        "element_at(array('GRANTA', 'Vesta', 'Camry', 'Logan', 'Solaris', 'Nexia', 'Qashqai',"
        " 'Приора'), CAST(driver_id % 8 AS INT) + 1) AS carmodel",
        "CASE order_id % 5 WHEN 0 THEN 'ios' WHEN 1 THEN 'web' ELSE 'android' END AS platform",
        "CASE WHEN returned = 'R' OR (returned = 'N' AND disc < 0.03) THEN 'done'"
        " ELSE 'cancel' END AS is_done",
    )
    priced = base.selectExpr(
        "*",
        "timestampadd(SECOND, CAST((part_id * 31 + line_no * 17) % 420 - 10 AS INT),"
        " order_timestamp) AS tender_timestamp",
        "CASE WHEN order_id % 211 = 7 THEN 0e0 ELSE CAST(floor(90e0 + distance_in_meters * 14e0"
        " / 1000e0 + duration_in_seconds * 5e0 / 60e0) AS DOUBLE) END AS price_start_local",
    )
    bid = priced.selectExpr(
        "*",
        "CASE WHEN part_id % 307 = 5 THEN 0e0"
        " WHEN part_id % 41 = 0 THEN CAST(floor(price_start_local * 25e0 / 10e0) AS DOUBLE)"
        " ELSE CAST(floor(price_start_local * (1e0 + CAST(disc AS DOUBLE) * 6e0)) AS DOUBLE) END"
        " AS price_bid_local",
    )
    copies = F.when(F.col("order_id") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    return bid.select(F.explode(copies).alias("copy_no"), "*")


def orders_view(bids: DataFrame) -> DataFrame:
    """Price requests: the first bid of each order, times as Unix seconds."""
    window = Window.partitionBy("order_id").orderBy("line_no", "driver_id", "part_id", "ext")
    first = (
        bids.filter(F.col("copy_no") == 0)
        .withColumn("_rn", F.row_number().over(window))
        .filter(F.col("_rn") == 1)
    )
    return first.select(
        "order_id",
        F.unix_timestamp("order_timestamp").alias("order_timestamp"),
        "distance_in_meters", "duration_in_seconds", "pickup_in_meters", "pickup_in_seconds",
        "driver_rating", "platform", "price_start_local", "carname", "carmodel",
        F.date_format("driver_reg_date", "yyyy-MM-dd").alias("driver_reg_date"),
        "user_id", "driver_id",
    )
