"""The row and table operators as ``pyspark.ml`` stages, for use in saved pipelines.

Each stage only holds parameters and calls the plain function. Stages that must look at the table
first (null policy, date buckets, label index) are estimators.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from colscope.functions.arrays import array_first_term, array_indicators, indicator_names
from colscope.functions.dates import DateBucket, apply_date_buckets, fit_date_buckets
from colscope.functions.typing import cast_by_role, date_to_long
from colscope.constants import FILL_NUMBER, NULL_TERM
from colscope.operators.encode import fit_string_index
from colscope.operators.nulls import NullPlan, fit_null_policy


def _param(name: str, doc: str, convert=None) -> Param:
    return Param(Params._dummy(), name, doc, convert) if convert else Param(Params._dummy(), name, doc)


class _Saved(DefaultParamsReadable, DefaultParamsWritable):
    """Parameters are all there is to save."""


class _HasTerms(HasInputCol):
    terms = _param("terms", "terms to look for", TypeConverters.toListString)

    def getTerms(self) -> list[str]:
        return self.getOrDefault(self.terms)


class FirstTerm(Transformer, _HasTerms, _Saved):
    """Array of terms to one text column ``<col>-str``."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, terms: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def getOutputCol(self) -> str:
        return f"{self.getInputCol()}-str"

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return array_first_term(dataset, self.getInputCol(), self.getTerms())


class TermIndicators(Transformer, _HasTerms, _Saved):
    """Array of terms to one boolean column per term."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, terms: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def getOutputCols(self) -> list[str]:
        return indicator_names(self.getInputCol(), self.getTerms())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return array_indicators(dataset, self.getInputCol(), self.getTerms())


class EpochMillis(Transformer, HasInputCol, HasOutputCol, _Saved):
    """Timestamp to epoch milliseconds."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return date_to_long(dataset, self.getInputCol(), self.getOutputCol())


class RoleCaster(Transformer, HasInputCols, _Saved):
    """Text columns to the types named by their catalog entries."""

    entries = _param("entries", "catalog entries by column name")

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, entries: dict | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cols = self.getInputCols() if self.isDefined(self.inputCols) else None
        return cast_by_role(dataset, self.getOrDefault(self.entries), cols)


class NullPolicy(Estimator, _Saved):
    """Share-based null policy; the fitted model knows which columns go, are filled or are required."""

    dropBelow = _param("dropBelow", "columns with a smaller non-null share go", TypeConverters.toFloat)
    fillBelow = _param("fillBelow", "columns with a smaller non-null share are filled", TypeConverters.toFloat)
    fillText = _param("fillText", "what missing texts become", TypeConverters.toString)
    fillNumber = _param("fillNumber", "what missing numbers become", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, dropBelow: float = 0.5, fillBelow: float = 0.8, fillText: str = NULL_TERM,
                 fillNumber: float = FILL_NUMBER):
        super().__init__()
        self._set(**{"dropBelow": dropBelow, "fillBelow": fillBelow, "fillText": fillText, "fillNumber": fillNumber})

    def _fit(self, dataset: DataFrame) -> NullPolicyModel:
        plan = fit_null_policy(
            dataset,
            drop_below=self.getOrDefault(self.dropBelow),
            fill_below=self.getOrDefault(self.fillBelow),
        )
        return NullPolicyModel(
            dropped=plan.dropped, filled=plan.filled, required=plan.required,
            fillText=self.getOrDefault(self.fillText), fillNumber=self.getOrDefault(self.fillNumber),
        )


class NullPolicyModel(Model, _Saved):
    dropped = _param("dropped", "columns removed", TypeConverters.toListString)
    filled = _param("filled", "columns whose nulls are filled", TypeConverters.toListString)
    required = _param("required", "columns whose null rows are removed", TypeConverters.toListString)
    fillText = _param("fillText", "what missing texts become", TypeConverters.toString)
    fillNumber = _param("fillNumber", "what missing numbers become", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, dropped: list[str] | None = None, filled: list[str] | None = None,
                 required: list[str] | None = None, fillText: str = NULL_TERM, fillNumber: float = FILL_NUMBER):
        super().__init__()
        self._set(**self._input_kwargs)

    def plan(self) -> NullPlan:
        return NullPlan(*[self.getOrDefault(p) for p in (self.dropped, self.filled, self.required)])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.plan().apply(dataset, self.getOrDefault(self.fillText), self.getOrDefault(self.fillNumber))


class DateBuckets(Estimator, HasInputCols, _Saved):
    """Granularity per date column, learned from its span."""

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> DateBucketsModel:
        found = fit_date_buckets(dataset, self.getInputCols())
        return DateBucketsModel(buckets=[[b.column, b.granularity, b.min_year, b.width] for b in found])


class DateBucketsModel(Model, _Saved):
    buckets = _param("buckets", "column, granularity, first year and bin width of each date")

    @keyword_only
    def __init__(self, *, buckets: list | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def getOutputCols(self) -> list[str]:
        return [DateBucket(*b).output for b in self.getOrDefault(self.buckets)]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return apply_date_buckets(dataset, [DateBucket(*b) for b in self.getOrDefault(self.buckets)])


class NonNullIndexer(Estimator, HasInputCols, _Saved):
    """Label index fitted on the non-null values of each column."""

    suffix = _param("suffix", "added to the input name", TypeConverters.toString)
    handleInvalid = _param("handleInvalid", "skip, keep or error", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None, suffix: str = "-index", handleInvalid: str = "skip"):
        super().__init__()
        kwargs = {"suffix": suffix, "handleInvalid": handleInvalid}
        if inputCols is not None:
            kwargs["inputCols"] = inputCols
        self._set(**kwargs)

    def _fit(self, dataset: DataFrame):
        cols = self.getInputCols()
        return fit_string_index(
            dataset, cols, [c + self.getOrDefault(self.suffix) for c in cols],
            self.getOrDefault(self.handleInvalid),
        )
