"""Indicators and scaling as stages of a ``pyspark.ml`` pipeline, which fits, saves and loads them."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import indicators as ind
from tidemill.operators.learning import scale_statistics

#: What an indicator stage adds, and the columns that it adds.
KINDS = {
    "rsi_sma": (ind.finite_indicators, ("rsi_sma",)),
    "bbands": (ind.finite_indicators, ("bb_mid", "bb_sd")),
    "macd": (ind.macd, ("macd", "macd_signal", "macd_diff")),
    "rsi_wilder": (ind.rsi_wilder, ("rsi_14",)),
    "adx": (ind.adx, ("di_plus", "di_minus", "adx")),
}


class IndicatorStage(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the columns of one of KINDS to bars (``sym, ts``, prices); rows that lack them have nulls."""

    kind = Param(Params._dummy(), "kind", "one of KINDS", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, kind: str = "macd"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        run, added = KINDS[self.getOrDefault("kind")]
        found = run(dataset).select("sym", "ts", *added)
        return dataset.join(found, ["sym", "ts"], "left")


class _Scaled(Params):
    columns = Param(Params._dummy(), "columns", "columns to scale", TypeConverters.toListString)
    kind = Param(Params._dummy(), "kind", "standard, minmax or robust", TypeConverters.toString)


class ScaleStage(Estimator, _Scaled, DefaultParamsReadable, DefaultParamsWritable):
    """Finds centre and spread of each column in the rows that it is fitted on."""

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, kind: str = "standard"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ScaleModel:
        columns, kind = self.getOrDefault("columns"), self.getOrDefault("kind")
        found = scale_statistics(dataset, columns, kind)
        return ScaleModel(columns=columns, centres=[c for c, _ in found], spreads=[s for _, s in found])


class ScaleModel(Model, _Scaled, DefaultParamsReadable, DefaultParamsWritable):
    """Takes the centres off the columns and divides by the spreads; nulls count as 0."""

    centres = Param(Params._dummy(), "centres", "centre of each column", TypeConverters.toListFloat)
    spreads = Param(Params._dummy(), "spreads", "spread of each column, 1 where there is none", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, centres: list[float] | None = None, spreads: list[float] | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        parts = zip(*(self.getOrDefault(p) for p in ("columns", "centres", "spreads")), strict=True)
        return dataset.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - centre) / spread for c, centre, spread in parts})
