"""Left lookup join that stays balanced when a few keys hold most of the rows.

Keys holding more than 1/``HOT_SHARE`` of all rows are "hot". There can never be
more than ``HOT_SHARE`` of them, so their history rows are a broadcast of proven
size. All other keys go through an ordinary equi-join, where no key is large;
rows without a key, and the hot rows that need no second lookup, are spread over
all partitions instead of meeting in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from farelens.functions.missing import num

HOT_SHARE = 1000
# A history row is about 100 bytes, so this is at most some 20 MB per executor.
BROADCAST_ROWS = 200_000
_SPREAD = 4096


def left_lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    weight: Column | None = None,
    small: bool | None = None,
) -> DataFrame:
    """``rows LEFT JOIN table USING (key)`` for a table with one row per key.

    ``weight`` is a column of ``table`` with the number of ``rows`` under its key,
    if known; otherwise the keys are counted. ``small`` tells whether the table is
    known to fit a broadcast; otherwise its rows are counted. ``rows`` should carry
    a row id, so that copies of a row spread as well.
    """
    if small is None:
        small = table.count() <= BROADCAST_ROWS
    if small:
        return rows.join(F.broadcast(table), key, "left")

    if weight is None:
        counted = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    else:
        counted = table.select(key, num(weight).alias("_n"))
    total = counted.agg(F.sum("_n").alias("_total")).scalar()
    hot_keys = counted.filter(F.col("_n") * HOT_SHARE > total).select(key)

    values = [c for c in table.columns if c != key]
    packed = table.select(F.col(key), F.struct(*values).alias("_v"))
    known = packed.join(F.broadcast(hot_keys), key, "left_semi")
    hot = hot_keys.join(known, key, "left").select(
        F.col(key), F.lit(True).alias("_is_hot"), F.col("_v").alias("_hot")
    )
    cold = packed.join(F.broadcast(hot_keys), key, "left_anti").select(
        F.col(key).alias("_cold_key"), F.lit(0).alias("_lane"), F.col("_v").alias("_cold")
    )
    done = F.col("_is_hot").isNotNull() | F.col(key).isNull()
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(_SPREAD)) + 1
    staged = (
        rows.join(F.broadcast(hot), key, "left")
        .withColumn("_cold_key", F.when(~done, F.col(key)))
        .withColumn("_lane", F.when(done, spread).otherwise(0).cast("int"))
    )
    joined = staged.join(cold, ["_cold_key", "_lane"], "left")
    found = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *[found[c].alias(c) for c in values])
