"""Aggregates for summaries and deterioration curves."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def most_common(x: Column) -> Column:
    """The mode, the smallest of equals; null if there is none."""
    return F.mode(x, True)


def first(x: Column, order: Column) -> Column:
    return F.min_by(x, order)


def last(x: Column, order: Column) -> Column:
    return F.max_by(x, order)


def quantile(x: Column, q: float) -> Column:
    """Exact, linearly interpolated."""
    return F.percentile(x, q)


def q75(x: Column) -> Column:
    return quantile(x, 0.75)


def q90(x: Column) -> Column:
    return quantile(x, 0.9)


def q95(x: Column) -> Column:
    return quantile(x, 0.95)


def deteriorate(initial: Column, rate: Column | float, final: Column | float | None = None, n_periods: int | None = None, n_intervals: int = 1, percentage: bool = False) -> Column:
    """Array of values that decay by an interval's rate until the periods end or a value falls below final."""
    rate = (rate if isinstance(rate, Column) else F.lit(float(rate))) / (100 if percentage else 1)
    keep = F.lit(1.0) - (F.pow(1 + rate, F.lit(1.0 / n_intervals)) - 1)
    by_time = F.lit(n_intervals * n_periods) if n_periods else None
    by_value = F.greatest(F.lit(0), F.floor(F.log((final if isinstance(final, Column) else F.lit(float(final))) / initial) / F.log(keep)).cast("int") + 1) if final is not None else None
    if by_time is None and by_value is None:
        return F.array(initial)
    n = by_time if by_value is None else by_value if by_time is None else F.least(by_time, by_value)
    return F.transform(F.sequence(F.lit(0), n.cast("int")), lambda k: initial * F.pow(keep, k))
