"""Exact quantiles, imputation, clipping and running totals over whole tables.

Nothing here gathers an unbounded set in one task: quantiles narrow a bracket
until it is small, running totals work per score range, and only fixed-size
statistics reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from farelens.functions.missing import clip, finite_or_null
from farelens.session import stored

# Up to this many values of one column may meet in one exact-percentile buffer.
EXACT_ROWS = 1_000_000
_ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame,
    targets: dict[str, tuple[str, float]],
    counts: dict[str, int] | None = None,
    exact_rows: int = EXACT_ROWS,
) -> dict[str, float | None]:
    """Linear-interpolation quantiles: name -> (column, probability), nulls ignored.

    Columns of up to ``exact_rows`` values are solved in one pass. For a longer
    one, an approximate percentile gives a bracket around the wanted rank, and
    only values inside the bracket go on; each pass shrinks it several
    thousandfold, so two or three passes over the column are enough. All targets
    share the passes.
    """
    if counts is None:
        columns = sorted({c for c, _ in targets.values()})
        counts = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    # 0-based fractional place of each target among the column's values
    place = {name: (counts[c] - 1) * p for name, (c, p) in targets.items()}
    found: dict[str, float | None] = {n: None for n, (c, _) in targets.items() if not counts[c]}
    # name -> (low, high, values below low, values inside)
    open_ = {n: (None, None, 0, counts[c]) for n, (c, _) in targets.items() if counts[c]}

    def inside(name: str) -> Column:
        low, high = open_[name][:2]
        value = F.col(targets[name][0])
        return value if low is None else F.when((value >= low) & (value <= high), value)

    while open_:
        ready = [n for n, (*_, within) in open_.items() if within <= exact_rows]
        if ready:
            aggs = []
            for n in ready:
                _, _, below, within = open_[n]
                share = (place[n] - below) / (within - 1) if within > 1 else 0.0
                aggs.append(F.percentile(inside(n), min(max(share, 0.0), 1.0)).alias(n))
            found |= df.agg(*aggs).first().asDict()
            for n in ready:
                del open_[n]
            continue

        margin, aggs = 3.0 / _ACCURACY, []
        for n, (_, _, below, within) in open_.items():
            at = place[n] - below
            ends = [max(at / within - margin, 0.0), min((at + 1) / within + margin, 1.0)]
            aggs.append(F.percentile_approx(inside(n), ends, _ACCURACY).alias(n))
        brackets = df.agg(*aggs).first().asDict()
        checks = []
        for n in open_:
            (low, high), value = brackets[n], F.col(targets[n][0])
            checks.append(F.count_if(value < low).alias(f"{n}__below"))
            checks.append(F.count_if((value >= low) & (value <= high)).alias(f"{n}__in"))
        sizes = df.agg(*checks).first().asDict()
        for n in list(open_):
            (low, high), total = brackets[n], counts[targets[n][0]]
            below, within = sizes[f"{n}__below"], sizes[f"{n}__in"]
            covered = below <= int(place[n]) and below + within >= min(int(place[n]) + 2, total)
            if covered and low == high:
                found[n] = float(low)
                del open_[n]
            elif covered and within < open_[n][3]:
                open_[n] = (low, high, below, within)
            else:
                # The sketch missed or cannot narrow further: settle by value counts.
                values = df.select(inside(n).alias("v"))
                found[n] = _quantile_by_counts(values, place[n] - open_[n][2])
                del open_[n]
    return found


def _quantile_by_counts(values: DataFrame, place: float) -> float:
    """Quantile at a fractional 0-based place, by running totals of value counts."""
    per_value = values.filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    upto = running_totals(per_value, "v", ["n"])
    lower, share = int(place), place - int(place)

    def at(rank: int) -> Row:
        holds = (F.col("n_before") <= rank) & (F.col("n_before") + F.col("n") > rank)
        return upto.filter(holds).first()

    low = at(lower)["v"]
    if share == 0:
        return float(low)
    return float(low) + (float(at(lower + 1)["v"]) - float(low)) * share


def running_totals(
    df: DataFrame, order: str, sums: list[str], rows_per_range: int = 1_000_000
) -> DataFrame:
    """Add ``<c>_before``: the sum of ``c`` over all rows with a smaller ``order``.

    Rows have distinct ``order`` values. They are cut into ranges of about equal
    size; a window runs inside each range, and the totals of the earlier ranges
    (one row per range, at most a few thousand) are added.
    """
    n = df.count()
    ranges = max(1, min(4000, n // rows_per_range + 1))
    if ranges == 1:
        within = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumns(
            {f"{c}_before": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums}
        )
    cuts = df.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    edges = sorted(set(cuts))
    splits = [float("-inf"), *edges, float("inf")]
    ranged = Bucketizer(splits=splits, inputCol=order, outputCol="_range").transform(df)
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums]
    )
    within = (
        Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.join(F.broadcast(offsets), "_range")
        .withColumns(
            {
                f"{c}_before": F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_{c}")
                for c in sums
            }
        )
        .drop("_range", *[f"_{c}" for c in sums])
    )


@dataclass(frozen=True)
class ColumnStats:
    """What imputation and clipping of one column need."""

    fill: float | None
    low: float | None
    high: float | None


@dataclass(frozen=True)
class Moments:
    """Count, mean and sum of squared deviations of some finite values."""

    n: int = 0
    mean: float = 0.0
    squares: float = 0.0

    def merged(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return self if self.n else other
        n, apart = self.n + other.n, other.mean - self.mean
        mean = self.mean + apart * other.n / n
        return Moments(n, mean, self.squares + other.squares + apart * apart * self.n * other.n / n)


def _moments(values: np.ndarray) -> Moments:
    """Of the finite values; equal ones have no deviation at all."""
    known = values[np.isfinite(values)]
    if not known.size:
        return Moments()
    apart = known - known[0]
    middle = apart.mean()
    return Moments(known.size, float(known[0] + middle), float(((apart - middle) ** 2).sum()))


def _task_moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the rows of a task: their number, and the moments of each column."""
    rows, folded = 0, []
    for batch in batches:
        rows += batch.num_rows
        found = [_moments(values.to_numpy(zero_copy_only=False)) for values in batch.columns]
        folded = [a.merged(b) for a, b in zip(folded, found, strict=True)] if folded else found
    if rows:
        columns = [[m.n for m in folded], [m.mean for m in folded], [m.squares for m in folded]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows]), *[pa.array([c]) for c in columns]], names=["rows", "n", "mean", "squares"]
        )


def column_moments(df: DataFrame, columns: list[str]) -> tuple[int, dict[str, Moments]]:
    """Rows of the frame, and the moments of each column.

    Tasks fold their rows in Arrow batches and send one row each. One aggregate with several buffers
    per column would outgrow what the JVM compiles, and a row for each value takes far longer.
    """
    if not columns:
        return 0, {}
    numbers = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    ddl = "rows long, n array<long>, mean array<double>, squares array<double>"
    rows, folded = 0, [Moments()] * len(columns)
    for part in numbers.mapInArrow(_task_moments, ddl).collect():
        rows += part["rows"]
        found = map(Moments, part["n"], part["mean"], part["squares"])
        folded = [a.merged(b) for a, b in zip(folded, found, strict=True)]
    return rows, dict(zip(columns, folded, strict=True))


def fit_statistics(
    df: DataFrame, columns: list[str], width: float = 10.0, impute_only: bool = False
) -> dict[str, ColumnStats]:
    """Medians for the columns with missing values, and mean +- ``width`` std.

    One pass gives count, mean and squared deviations of every column; a second finds the
    medians of those that have missing values. Mean and variance after filling
    follow from the parts, so the filled table is never scanned.
    """
    rows, moments = column_moments(df, columns)
    counts = {c: moments[c].n for c in columns}
    lacking = [c for c in columns if counts[c] < rows]
    usable = df.select(*[finite_or_null(F.col(c)).alias(c) for c in lacking])
    medians = exact_quantiles(usable, {c: (c, 0.5) for c in lacking}, counts) if lacking else {}

    stats = {}
    for c in columns:
        fill = (medians[c] or 0.0) if c in medians else None
        n, missing = counts[c], rows - counts[c]
        low = high = None
        if not impute_only and rows > 1:
            mean = moments[c].mean
            spread = moments[c].squares
            if missing and n:
                spread += (fill - mean) ** 2 * n * missing / rows
                mean += (fill - mean) * missing / rows
            std = (max(spread, 0.0) / (rows - 1)) ** 0.5
            if std > 0:
                low, high = mean - width * std, mean + width * std
        stats[c] = ColumnStats(fill, low, high)
    return stats


def impute(df: DataFrame, stats: dict[str, ColumnStats]) -> DataFrame:
    """Fill missing and infinite values with the column's median (or 0)."""
    lacking = {c: s.fill for c, s in stats.items() if s.fill is not None}
    return df.withColumns(
        {c: F.coalesce(finite_or_null(F.col(c)), F.lit(v)) for c, v in lacking.items()}
    )


def clip_sigma(df: DataFrame, stats: dict[str, ColumnStats]) -> DataFrame:
    """Clamp to the fitted bounds; columns without spread stay as they are."""
    bounded = {c: s for c, s in stats.items() if s.low is not None}
    return df.withColumns({c: clip(F.col(c), s.low, s.high) for c, s in bounded.items()})


def prob_quantiles(df: DataFrame, column: str = "probability") -> DataFrame:
    """One row: min, quartiles, max and mean of the scores, which are stored for the passes over them."""
    df, value = stored(df.select(column), "scores"), F.col(column)
    seen = df.agg(
        F.count(value).alias("n"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.avg(value).alias("mean"),
    ).first()
    targets = {"q1": (column, 0.25), "median": (column, 0.5), "q3": (column, 0.75)}
    quartiles = exact_quantiles(df, targets, {column: seen["n"]})
    row = [seen["min"], seen["max"], seen["mean"], *[quartiles[n] for n in targets]]
    ddl = "min double, max double, mean double, q1 double, median double, q3 double"
    return df.sparkSession.createDataFrame([row], ddl)
