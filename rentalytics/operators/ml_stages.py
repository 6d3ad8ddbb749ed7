"""Pipeline stages Spark ML lacks, as Estimator/Model pairs.

They keep only fitted values (medians) or per-category labels (a dictionary,
like StringIndexer's labels); their transforms are native Column
expressions, so they run inside whole-stage codegen and persist with the
pipeline.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INFREQUENT = "infrequent"


class _Labels(Params):
    labels = Param(Params._dummy(), "labels", "JSON: column -> fitted value(s)",
                   typeConverter=TypeConverters.toString)

    def _labels(self) -> dict:
        return json.loads(self.getOrDefault(self.labels) or "{}")


# --- F5 ---------------------------------------------------------------------
class MedianFiller(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Fill NULL and NaN with the exact median of the fit rows (the
    bounded-memory selection; all columns share its passes)."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "MedianFillerModel":
        from .quantiles import exact_quantiles_many

        cols = self.getInputCols()
        found = exact_quantiles_many(df, {c: [0.5] for c in cols})
        return MedianFillerModel(inputCols=cols, outputCols=self.getOutputCols(),
                                 labels=json.dumps({c: found[c][0] for c in cols}))


class MedianFillerModel(Model, HasInputCols, HasOutputCols, _Labels, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, labels=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        medians = self._labels()
        filled = [F.coalesce(F.when(~F.isnan(c), F.col(c).cast("double")), F.lit(medians[c]).cast("double")).alias(out)
                  for c, out in zip(self.getInputCols(), self.getOutputCols())]
        kept = [c for c in df.columns if c not in self.getOutputCols()]
        return df.select(*kept, *filled)


# --- F6 ---------------------------------------------------------------------
def most_frequent(df: DataFrame, column: str):
    """The most frequent non-null value (ties -> smallest), None without one:
    counted per value with a top-1, so no task holds all distinct values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    row = counts.orderBy(F.col("n").desc(), F.col(column)).limit(1).first()
    return row[column] if row else None


class ModeFiller(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Fill NULLs with the column's most frequent value (ties -> smallest)."""

    @keyword_only
    def __init__(self, inputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ModeFillerModel":
        cols = self.getInputCols()
        values = {c: most_frequent(df, c) for c in cols}
        return ModeFillerModel(inputCols=cols, labels=json.dumps(values))


class ModeFillerModel(Model, HasInputCols, _Labels, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, labels=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        modes = self._labels()
        return df.select(*[
            F.coalesce(F.col(c), F.lit(modes[c])).alias(c) if c in modes and modes[c] is not None else F.col(c)
            for c in df.columns])


# --- T8 ---------------------------------------------------------------------
class InfrequentBucketer(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Categories below ``minFrequency`` of the fit rows share one bucket;
    unseen and NULL values go to that bucket when it exists, else stay NULL."""

    minFrequency = Param(Params._dummy(), "minFrequency", "minimum share of rows",
                         typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, inputCols=None, minFrequency=0.01):
        super().__init__()
        self._setDefault(minFrequency=0.01)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "InfrequentBucketerModel":
        from .encoding import frequent_categories

        share = self.getOrDefault(self.minFrequency)
        if not share > 0:
            raise ValueError("minFrequency must be above 0: it bounds the labels kept (1 / minFrequency)")
        fitted = {}
        for c in self.getInputCols():
            freq = frequent_categories(df, c, share)
            stats = freq.agg(F.sort_array(F.collect_list(F.when(F.col("frequent"), F.col(c)))).alias("keep"),
                             F.max((~F.col("frequent")).cast("int")).alias("rare")).first()
            fitted[c] = {"keep": list(stats["keep"] or []), "rare": bool(stats["rare"])}
        return InfrequentBucketerModel(inputCols=self.getInputCols(), labels=json.dumps(fitted))


class InfrequentBucketerModel(Model, HasInputCols, _Labels, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, inputCols=None, labels=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        fitted = self._labels()
        out = []
        for c in df.columns:
            if c not in fitted:
                out.append(F.col(c))
                continue
            keep, rare = fitted[c]["keep"], fitted[c]["rare"]
            bucket = F.lit(INFREQUENT) if rare else F.lit(None).cast("string")
            out.append(F.when(F.col(c).isin(keep), F.col(c)).otherwise(bucket).alias(c))
        return df.select(*out)
