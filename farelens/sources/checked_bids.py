"""Bids from CSV of which nothing is lost: where each row stands, and what could not be read.

A checked scan has the typed columns of ``scan_bids`` and, with them, each row's place in its file, the
values that could not be cast, and the whole text of lines that have too few or too many fields.
``readable_bids`` and ``bid_rejects`` divide it; every line of the files is in one of them, and a line
whose values were lost is in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from farelens.functions.missing import nan_to_null
from farelens.operators.cleaning import parse_times
from farelens.schema import BID_FIELDS, UNREADABLE
from farelens.sources.bids import typed_column

# A row's place: the order of these columns is the order of rows in the files, for any split of them.
FILE_ORDER = ["file_path", "file_block", "scan_seq"]
LOST = "lost_values"
# Up to this many blocks of files are broadcast to number rows.
BROADCAST_BLOCKS = 200_000


def with_file_order(read: DataFrame) -> DataFrame:
    """Add ``FILE_ORDER`` to a frame that comes straight from files.

    Rows of a block get ascending numbers in the scan, and blocks ascend within a file; so sorting by
    the three columns gives the same order, however the files are split and on however many cores.
    """
    return read.select(
        "*",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("file_block"),
        F.monotonically_increasing_id().alias("scan_seq"),
    )


def with_file_rows(ordered: DataFrame) -> DataFrame:
    """Add ``file_row``, the number of each row within its file from 0, the same for any split.

    A first pass counts the rows of each block; a block's rows then begin behind those of the blocks
    before it.
    """
    blocks = ordered.groupBy("file_path", "file_block").agg(
        F.min("scan_seq").alias("_first"), F.count("*").alias("_n")
    )
    before = Window.partitionBy("file_path").orderBy("file_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if blocks.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS:
        starts = F.broadcast(starts)
    numbered = ordered.join(starts, ["file_path", "file_block"])
    return numbered.withColumn("file_row", F.col("_before") + F.col("scan_seq") - F.col("_first")).drop(
        "_first", "_before"
    )


def _lost(column: str, kind: str) -> Column:
    """The name and text of a value that its type cannot hold."""
    text = F.col(column)
    value = F.try_to_timestamp(text) if kind == "timestamp" else typed_column(column, kind)
    failed = text.isNotNull() & (F.trim(text) != "") & value.isNull()
    return F.when(failed, F.struct(F.lit(column).alias("field"), text.alias("text")))


def scan_bids_checked(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Bids with ``FILE_ORDER``, ``LOST`` and ``UNREADABLE``; files without a header need their ``columns``."""
    header = columns is None
    names = spark.read.option("header", True).csv(path).columns if header else columns
    schema = ", ".join([*[f"`{c}` string" for c in names], f"{UNREADABLE} string"])
    reader = spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE")
    # All fields are parsed whatever is selected, or the number of fields of a line goes unnoticed.
    reader = reader.option("columnNameOfCorruptRecord", UNREADABLE).option("columnPruning", False)
    raw = with_file_order(reader.csv(path))
    held = [c for c in names if BID_FIELDS.get(c, "string") != "string"]
    lost = F.array_compact(F.array(*[_lost(c, BID_FIELDS[c]) for c in held])) if held else F.array()
    typed = [typed_column(c, BID_FIELDS[c]) if c in BID_FIELDS else F.col(c) for c in names]
    marked = raw.select(*typed, *FILE_ORDER, lost.alias(LOST), UNREADABLE)
    return nan_to_null(parse_times(marked))


def readable_bids(checked: DataFrame) -> DataFrame:
    """Lines with as many fields as there are columns; values that could not be cast are null."""
    return checked.filter(F.col(UNREADABLE).isNull()).drop(UNREADABLE, LOST)


def n_fields(line: Column) -> Column:
    """Fields of a CSV line; separators within quotes do not count."""
    bare = F.regexp_replace(line, r'"(?:[^"\\]|\\.)*+"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def bid_rejects(checked: DataFrame) -> DataFrame:
    """A row for each line and each value that was not read: place, reason, field and text."""
    own = {*FILE_ORDER, LOST, UNREADABLE, "file_row"}
    columns = len([c for c in checked.columns if c not in own])
    place = [c for c in checked.columns if c in {*FILE_ORDER, "file_row"}]
    fields = n_fields(F.col(UNREADABLE))
    reason = F.when(fields < columns, "short line").when(fields > columns, "long line").otherwise("unreadable line")
    lines = F.struct(reason.alias("reason"), F.lit(None).cast("string").alias("field"), F.col(UNREADABLE).alias("text"))
    values = F.transform(
        LOST, lambda v: F.struct(F.lit("unreadable value").alias("reason"), v["field"].alias("field"), v["text"].alias("text"))
    )
    found = F.when(F.col(UNREADABLE).isNotNull(), F.array(lines)).otherwise(values)
    return checked.select(*place, F.inline(found))
