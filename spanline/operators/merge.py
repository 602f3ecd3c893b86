"""Interval merge: range join and overlap-weighted aggregation."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DuplicateLabelError, InvalidAggregationError, InvalidDataFrameError, InvalidJoinConfigurationError, OutputCollisionError, ZeroLengthSegmentError
from ..performance import timed
from ..tables import once, written
from .aggregations import ANY_TYPE, BY_INDEX, Action, Aggregation, Kind, compiled
from .percentile import joined, weighted_percentiles
from .ranges import attached, overlaps


def clean(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType))


def validate(target: DataFrame, data: DataFrame, join_left, actions: list[Action], from_to, check_rows: bool) -> None:
    if not isinstance(join_left, list):
        raise InvalidJoinConfigurationError("join_left must be a list of column names")
    for name, df in (("target", target), ("data", data)):
        if not isinstance(df, DataFrame):
            raise InvalidDataFrameError(f"{name} must be a DataFrame")
        if len(set(df.columns)) < len(df.columns):
            raise DuplicateLabelError(f"{name} has repeated column names")
    need = [*join_left, *from_to]
    lacks = [f"{n} lacks {c}" for n, df, cols in (("target", target, need), ("data", data, [*need, *(a.column_name for a in actions)])) for c in cols if c not in df.columns]
    if lacks:
        raise InvalidDataFrameError("; ".join(lacks))
    if check_rows:
        for n, df in (("target", target), ("data", data)):
            if not df.where(F.col(from_to[0]) == F.col(from_to[1])).isEmpty():
                raise ZeroLengthSegmentError(f"{n} has segments of zero length")
    outs = [a.output for a in actions]
    hit = sorted({o for o in outs if o in target.columns or outs.count(o) > 1})
    if hit:
        raise OutputCollisionError(f"output columns are taken already: {', '.join(hit)}; use rename")
    for a in actions:
        if a.aggregation.kind not in ANY_TYPE and not numeric(data, a.column_name):
            raise InvalidAggregationError(f"{a.aggregation.kind.name} needs a numeric column; {a.column_name} is not")


def on_slk_intervals(target: DataFrame, data: DataFrame, join_left: list[str], column_actions: list[Action], from_to: tuple[str, str], index_col: str | None = None, bin_width: float | None = None, check_rows: bool = False) -> DataFrame:
    """Every target row once, with one column for each action over the data rows of positive overlap.

    Half-open intervals; keys must be equal and not null; unmatched targets get nulls. What a target
    row gets depends on its keys and bounds alone: pairs are aggregated by these and joined back, so
    that targets of any plan, repeated rows too, come out right. index_col orders ties and First, and
    is what IndexOfMax and IndexOfMin return: these three need it; other ties go by value without it.
    Pairs are joined once for all actions, in bins: see ranges.overlaps for bin_width; percentiles are
    found by prefix sums over ranges of values (see percentile.py), so no target's rows are an array.
    check_rows costs two jobs.
    """
    with timed("merge", actions=len(column_actions), keys=len(join_left) if isinstance(join_left, list) else 0):
        return _merged(target, data, join_left, column_actions, from_to, index_col, bin_width, check_rows)


def _merged(target: DataFrame, data: DataFrame, join_left, column_actions: list[Action], from_to, index_col: str | None, bin_width: float | None, check_rows: bool) -> DataFrame:
    validate(target, data, join_left, column_actions, from_to, check_rows)
    needs = [a.aggregation.kind.name for a in column_actions if a.aggregation.kind in BY_INDEX]
    if needs and index_col is None:
        raise InvalidDataFrameError(f"{', '.join(needs)} needs index_col")
    if not column_actions:
        return target
    # Met by data and given back.
    left, right = once(clean(target)), clean(data)
    values = {f"__v{k}": F.col(a.column_name) for k, a in enumerate(column_actions)}
    values["__i"] = F.col(index_col) if index_col else F.lit(0)
    pairs = overlaps(left, right, join_left, from_to, from_to, values, bin_width)
    pairs = pairs.withColumns({"__w": F.least("__tt", "__to") - F.greatest("__tf", "__from"), "__len": F.col("__to") - F.col("__from"), "__t": F.col("__tt") - F.col("__tf")})
    levels = {f"__o{k}": (f"__v{k}", a.aggregation.percentile) for k, a in enumerate(column_actions) if a.aggregation.kind is Kind.LengthWeightedPercentile}
    plain = [(k, a) for k, a in enumerate(column_actions) if a.aggregation.kind not in (Kind.KeepLongest, Kind.LengthWeightedPercentile)]
    longest = [(k, a) for k, a in enumerate(column_actions) if a.aggregation.kind is Kind.KeepLongest]
    by = [*join_left, "__tf", "__tt"]
    if levels and len(levels) < len(column_actions):
        # Read by both ways.
        pairs = written(pairs)
    aggs = [compiled(a, k, numeric(data, a.column_name)).alias(f"__o{k}") for k, a in plain]
    if not plain and not longest:
        got = None
    elif not longest:
        got = pairs.groupBy(*by).agg(*aggs)
    else:
        # One more row for each KeepLongest, grouped by its value: lengths add up by value, then the longest value stands.
        whose = F.explode(F.array(*[F.lit(k) for k in ([-1] if plain else []) + [k for k, _ in longest]])).alias("__a")
        mine = lambda k, c: F.when(F.col("__a") == k, F.col(c))
        kinds = {f"__v{k}": data.schema[a.column_name].dataType for k, a in longest}
        d = pairs.select("*", whose).withColumns({f"__g{k}": mine(k, f"__v{k}") for k, _ in longest} | {f"__v{k}": mine(-1, f"__v{k}") for k, _ in plain})
        d = d.where(reduce(lambda x, y: x | y, [F.col(f"__g{k}").isNotNull() for k, _ in longest], F.col("__a") == -1))
        one = d.groupBy(*by, "__a", *[f"__g{k}" for k, _ in longest]).agg(F.sum("__w").alias("__sw"), F.min(F.struct("__to", "__i")).alias("__first"), *aggs)
        best = lambda k: F.max_by(F.col(f"__g{k}"), F.when(F.col("__a") == k, F.struct("__sw", -F.col("__first.__to"), -F.col("__first.__i"), f"__g{k}")))
        got = one.groupBy(*by).agg(*[F.first(mine(-1, f"__o{k}"), True).alias(f"__o{k}") for k, _ in plain], *[(best(k).cast("double") if isinstance(kinds[f"__v{k}"], (T.NumericType, T.BooleanType)) else best(k)).alias(f"__o{k}") for k, _ in longest])
    if levels:
        share = weighted_percentiles(pairs, by, levels, ["__to", "__i"], "__w")
        got = joined(got, share, by) if got is not None else share
    return attached(left, got, join_left, from_to, {f"__o{k}": a.output for k, a in enumerate(column_actions)})


def on_intervals(left: DataFrame, right: DataFrame, idvars: list[str], start: str, end: str, column_actions: list[tuple[str, str, str]], index_col: str | None = None) -> DataFrame:
    """Adapter of (column, 'mode' or 'sum', output name) to the merge."""
    kinds = {"mode": Aggregation.KeepLongest, "sum": Aggregation.Sum}
    return on_slk_intervals(left, right, idvars, [Action(c, kinds[how](), out) for c, how, out in column_actions], (start, end), index_col)


def backend() -> str:
    return "spark"
