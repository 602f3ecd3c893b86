"""Step and rounding columns."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_metres(km: Column) -> Column:
    """Kilometres to whole metres, half to even."""
    return F.bround(km * 1000, 0).cast("long")


def linspace_steps(start: Column, end: Column, step: Column | float, minimum: float = 0.0) -> Column:
    """Boundaries at integer multiples of step; an end piece shorter than minimum (to 6 places) is absorbed."""
    step = step if isinstance(step, Column) else F.lit(float(step))
    lo, hi = F.floor(start / step) + 1, F.ceil(end / step) - 1
    short = lambda a, b: F.round(a - b, 6) < minimum
    # The ends are dropped before the array is made: a lambda that reads its own array is quadratic.
    lo, hi = F.when(short(lo * step, start), lo + 1).otherwise(lo), F.when(short(end, hi * step), hi - 1).otherwise(hi)
    inner = F.when(lo <= hi, F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda k: k * step)).otherwise(F.array().cast("array<double>"))
    return F.concat(F.array(start), inner, F.array(end))


def fixed_steps(start: Column, end: Column, length: float) -> Column:
    """start + k * length below end, then end."""
    n = F.ceil((end - start) / length)
    return F.when(n < 1, F.array(start, end)).otherwise(F.concat(F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1), lambda k: start + k * length), F.array(end)))


def pieces(bounds: Column) -> Column:
    """Neighbouring boundaries as array<struct<a, b>>."""
    n = F.size(bounds) - 1
    return F.zip_with(F.slice(bounds, 1, n), F.slice(bounds, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
