"""Prices in bands that users supply: half-open intervals that may overlap, leave gaps or have no end.

The line of prices is cut into bins at edges of the bands. A band is posted under the bins it reaches,
a price under the one bin it lies in, and an equality of bins is all that the join needs; the exact
bounds then decide.

Where only sums per band are wanted (``sums``), no price is paired with a band that holds its whole
cell: prices are added up by cells between neighbouring edges, cells by twos, fours and so on, and a
band takes the few of these runs that lie within it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

# Bins at most, and how many (band, bin) rows are broadcast at most.
BINS = 1024
BROADCAST_ROWS = 200_000
_BIN = "_bin"
# Cells at most into which ends of bands cut the prices that are added up.
CELLS = 65_536
_LEVEL_BITS = 40


def bin_edges(bands: DataFrame, low: str, high: str, bins: int = BINS) -> list[float]:
    """At most ``bins`` - 1 ascending edges, at quantiles of the bands' finite ends."""
    ends = _finite_ends(bands, low, high)
    if ends.limit(bins).count() < bins:
        return sorted(r["end"] for r in ends.collect())
    cuts = ends.approxQuantile("end", [i / bins for i in range(1, bins)], 0.1 / bins)
    return sorted(set(cuts))


def bin_of(value: str, edges: list[float], df: DataFrame, out: str) -> DataFrame:
    """Add the bin of a value that is not null: how many edges are at most the value."""
    if not edges:
        return df.withColumn(out, F.lit(0.0))
    splits = [float("-inf"), *edges, float("inf")]
    return Bucketizer(splits=splits, inputCol=value, outputCol=out, handleInvalid="keep").transform(df)


def join_bands(
    points: DataFrame, bands: DataFrame, price: str = "price", low: str = "band_low", high: str = "band_high",
    bins: int = BINS, broadcast_rows: int = BROADCAST_ROWS, sums: tuple[str, ...] | None = None, cells: int = CELLS,
) -> DataFrame:
    """Each point with each band that holds its price: low <= price < high, null ends being open.

    With ``sums``, each band with each of the runs of prices that make it up instead: ``n_points`` of the
    run and ``sum_<c>`` of each named column of the points; bands and runs grow no faster than their tables.

    Points in no band are left out, bands without points too; points and bands have no column name in
    common. Bands that are posted few enough times are broadcast, so that points stay where they are;
    beyond that both sides are dealt by bin.
    """
    if sums is not None:
        return _runs_of_bands(points, bands, price, low, high, sums, cells)
    edges = bin_edges(bands, low, high, bins)
    clean = bands.withColumns({"_low": _end(low, "-inf"), "_high": _end(high, "inf")}).filter("_low < _high")
    posted = bin_of("_high", edges, bin_of("_low", edges, clean, "_from"), "_to").withColumn(
        _BIN, F.explode(F.sequence(F.col("_from").cast("int"), F.col("_to").cast("int")))
    )
    posted = posted.drop("_from", "_to")
    if posted.limit(broadcast_rows + 1).count() <= broadcast_rows:
        posted = F.broadcast(posted)
    value = F.col(price).cast("double")
    priced = points.withColumn("_value", value).filter(F.col("_value").isNotNull() & ~F.isnan("_value"))
    binned = bin_of("_value", edges, priced, _BIN).withColumn(_BIN, F.col(_BIN).cast("int"))
    inside = (F.col("_value") >= F.col("_low")) & (F.col("_value") < F.col("_high"))
    return binned.join(posted, _BIN).filter(inside).drop(_BIN, "_value", "_low", "_high")


def _runs_of_bands(
    points: DataFrame, bands: DataFrame, price: str, low: str, high: str, sums: tuple[str, ...], cells: int
) -> DataFrame:
    """``join_bands`` by runs. A band's end that is no edge (there are too many) splits a cell; the prices
    of such a cell are compared one by one, equal ones together."""
    edges = np.array(bin_edges(bands, low, high, cells), np.float64)
    levels = int(len(edges)).bit_length()

    @F.pandas_udf("int")
    def cell_of(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, values.to_numpy(np.float64), "right").astype(np.int32))

    @F.udf("array<bigint>")
    def runs(first, end):
        """The fewest runs of 2**level cells from ``first`` to before ``end``."""
        found, level = [], 0
        while first < end:
            if first & 1:
                found.append(level << _LEVEL_BITS | first)
                first += 1
            if end & 1:
                end -= 1
                found.append(level << _LEVEL_BITS | end)
            first, end, level = first >> 1, end >> 1, level + 1
        return found

    @F.pandas_udf("boolean")
    def is_edge(values: pd.Series) -> pd.Series:
        return pd.Series(np.isin(values.to_numpy(np.float64), edges) | np.isinf(values.to_numpy(np.float64)))

    totals = [f"sum_{c}" for c in sums]
    value = F.col(price).cast("double")
    priced = points.withColumn("_value", value).filter(F.col("_value") < float("inf")).withColumn("_cell", cell_of("_value"))
    added = [F.count("*").alias("n_points"), *[F.sum(c).alias(f"sum_{c}") for c in sums]]
    again = [F.sum(c).alias(c) for c in ("n_points", *totals)]
    level = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    per_cell = priced.groupBy("_cell").agg(*added).select("*", level.alias("_level"))
    run = F.col("_level").cast("bigint") * 2**_LEVEL_BITS + F.floor(F.col("_cell") / F.pow(F.lit(2.0), "_level"))
    per_run = per_cell.groupBy(run.alias("_run")).agg(*again)

    clean = bands.withColumns({"_low": _end(low, "-inf"), "_high": _end(high, "inf")}).filter("_low < _high")
    placed = clean.withColumns(
        {"_from": cell_of("_low"), "_to": cell_of("_high"), "_low_cut": ~is_edge("_low"), "_high_cut": ~is_edge("_high")}
    ).withColumn("_to", F.when(F.col("_high") == float("inf"), len(edges) + 1).otherwise(F.col("_to")))
    first = F.col("_from") + F.col("_low_cut").cast("int")
    own = [*bands.columns, "n_points", *totals]
    posted = placed.select(*bands.columns, F.explode(runs(first, "_to")).alias("_run"))
    whole = posted.join(per_run, "_run").select(*own)
    if len(edges) == _finite_ends(bands, low, high).count():
        return whole
    ends = F.array_distinct(F.array_compact(F.array(F.when(F.col("_low_cut"), F.col("_from")), F.when(F.col("_high_cut"), F.col("_to")))))
    split = placed.select(*bands.columns, "_low", "_high", F.explode(ends).alias("_cell"))
    per_value = priced.groupBy("_cell", "_value").agg(*added)
    inside = (F.col("_value") >= F.col("_low")) & (F.col("_value") < F.col("_high"))
    return whole.unionByName(split.join(per_value, "_cell").filter(inside).select(*own))


def _finite_ends(bands: DataFrame, low: str, high: str) -> DataFrame:
    ends = bands.select(F.explode(F.array(F.col(low).cast("double"), F.col(high).cast("double"))).alias("end"))
    return ends.filter(F.col("end").isNotNull() & (F.abs("end") < float("inf"))).distinct()


def _end(column: str, open_: str) -> Column:
    return F.coalesce(F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double")), F.lit(float(open_)))
