"""Column statistics as pipeline stages, so that a stored model scores raw features of any table.

``ColumnBounds`` learns, for each column, what fills its gaps and where its extremes are cut; the
fitted stage carries these numbers, is stored and read with the pipeline it stands in, and applies
them as plain columns.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from farelens.functions.missing import clip, finite_or_null
from farelens.operators.statistics import ColumnStats, fit_statistics

# Accuracy of the medians of columns that have no gaps where they are fitted: a rank error of 1 / this.
MEDIAN_ACCURACY = 10_000


class ColumnBounds(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Learns medians, and bounds at mean +- ``width`` standard deviations after filling.

    Columns with gaps in the fitted table get their exact median. Columns without get an approximate
    one, which changes nothing there but fills the gaps of tables to come.
    """

    width = Param(Params._dummy(), "width", "standard deviations to either bound", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, width: float = 10.0):
        super().__init__()
        self._setDefault(width=10.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ColumnBoundsModel:
        columns = self.getInputCols()
        stats = fit_statistics(dataset, columns, self.getOrDefault(self.width))
        complete = [c for c in columns if stats[c].fill is None]
        middles = {}
        if complete:
            middles = dataset.agg(
                *[F.percentile_approx(finite_or_null(F.col(c)), 0.5, MEDIAN_ACCURACY).alias(c) for c in complete]
            ).first().asDict()
        filled = {c: s.fill if s.fill is not None else middles[c] or 0.0 for c, s in stats.items()}
        model = ColumnBoundsModel()
        return model.set_statistics({c: ColumnStats(filled[c], s.low, s.high) for c, s in stats.items()})


class ColumnBoundsModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Fills gaps and infinite values, then clamps; columns without spread where fitted are not clamped."""

    fills = Param(Params._dummy(), "fills", "value for gaps, by column", TypeConverters.toListFloat)
    lows = Param(Params._dummy(), "lows", "least value, by column", TypeConverters.toListFloat)
    highs = Param(Params._dummy(), "highs", "largest value, by column", TypeConverters.toListFloat)

    def __init__(self) -> None:
        super().__init__()

    def set_statistics(self, stats: dict[str, ColumnStats]) -> ColumnBoundsModel:
        return self._set(
            inputCols=list(stats),
            fills=[s.fill or 0.0 for s in stats.values()],
            lows=[float("-inf") if s.low is None else s.low for s in stats.values()],
            highs=[float("inf") if s.high is None else s.high for s in stats.values()],
        )

    def statistics(self) -> dict[str, ColumnStats]:
        parts = (self.getOrDefault(p) for p in (self.fills, self.lows, self.highs))
        return {c: ColumnStats(*numbers) for c, *numbers in zip(self.getInputCols(), *parts, strict=True)}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns(
            {
                c: clip(F.coalesce(finite_or_null(F.col(c)), F.lit(s.fill)), s.low, s.high)
                for c, s in self.statistics().items()
            }
        )


def with_statistics(bounds: ColumnBoundsModel, model: PipelineModel) -> PipelineModel:
    """A fitted model that takes raw features: the bounds it was fitted behind, then its own stages."""
    return PipelineModel([bounds, *model.stages])
