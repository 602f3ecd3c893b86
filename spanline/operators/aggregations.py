"""Actions of the interval merge, compiled to aggregate columns."""
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PercentileConfigurationError


class Kind(Enum):
    KeepLongestSegment = 1
    KeepLongest = 2
    Average = 3
    LengthWeightedAverage = 4
    LengthWeightedPercentile = 5
    First = 6
    SumProportionOfData = 7
    SumProportionOfTarget = 8
    Sum = 9
    IndexOfMax = 10
    IndexOfMin = 11
    Min = 12
    Max = 13


ANY_TYPE = {Kind.KeepLongest, Kind.KeepLongestSegment, Kind.First}
#: Kinds whose result is an index or follows its order.
BY_INDEX = {Kind.First, Kind.IndexOfMax, Kind.IndexOfMin}


@dataclass(frozen=True)
class Aggregation:
    """A kind and, for the percentile, its level."""

    kind: Kind
    percentile: float | None = None

    @staticmethod
    def LengthWeightedPercentile(percentile: float) -> "Aggregation":
        if not 0 <= percentile <= 1:
            raise PercentileConfigurationError(f"percentile must be in [0, 1], not {percentile}")
        return Aggregation(Kind.LengthWeightedPercentile, percentile)

    @staticmethod
    def ProportionalSum() -> "Aggregation":
        """Old name of SumProportionOfData."""
        return Aggregation(Kind.SumProportionOfData)


for _kind in Kind:
    if _kind is not Kind.LengthWeightedPercentile:
        setattr(Aggregation, _kind.name, staticmethod(lambda k=_kind: Aggregation(k)))


@dataclass(frozen=True)
class Action:
    """Which column is reduced, how, and the output's name."""

    column_name: str
    aggregation: Aggregation
    rename: str | None = None

    @property
    def output(self) -> str:
        return self.rename or self.column_name


def compiled(a: Action, k: int, numeric: bool) -> Column:
    """The aggregate of action k over one target's overlapping rows; percentiles are no aggregate (see percentile.py).

    Columns: v{k} value, __w overlap, __to data end, __i data index, __len data length, __t target length.
    """
    raw, w, to, i = F.col(f"__v{k}"), F.col("__w"), F.col("__to"), F.col("__i")
    has = raw.isNotNull()
    v = raw.cast("double") if numeric else raw
    of = lambda c: F.when(has, c)
    kind = a.aggregation.kind
    if kind is Kind.Average:
        return F.avg(v)
    if kind is Kind.LengthWeightedAverage:
        return F.sum(v * w) / F.sum(of(w))
    if kind is Kind.First:
        return F.min_by(v, of(i))
    if kind is Kind.SumProportionOfData:
        return F.sum(v * w / F.col("__len"))
    if kind is Kind.SumProportionOfTarget:
        return F.sum(v * w) / F.first("__t")
    if kind is Kind.Sum:
        return F.sum(v)
    if kind is Kind.Min:
        return F.min(v)
    if kind is Kind.Max:
        return F.max(v)
    if kind is Kind.IndexOfMax:
        return F.max_by(i, of(F.struct(v, -to, -i)))
    if kind is Kind.IndexOfMin:
        return F.min_by(i, of(F.struct(v, to, i)))
    if kind is Kind.KeepLongestSegment:
        return F.max_by(v, of(F.struct(w, -to, -i, v)))
    raise ValueError(kind)
