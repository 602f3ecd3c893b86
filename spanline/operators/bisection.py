"""Repeated bisection of groups of any size, by rounds of Spark jobs, and the statistics that choose the cuts."""
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import discard, written
from .ranges import ranges_of, running

SEGMENT = ["__g", "__start"]
#: Statistics closer than TIE are equal; a mean square of up to FLAT of the squared mean is rounding, not variation.
TIE, FLAT = 1e-9, 1e-24
#: Lengths are whole numbers of this part of a unit, so that their sums are exact in any order.
UNITS, RANGE = 10**10, 65_536


def whole_length(x: float) -> int:
    return round(x * UNITS)


def whole_lengths(x: Column) -> Column:
    return F.rint(x.cast("double") * UNITS).cast("long")


def far_enough(before: Column, upto: Column, total: Column, is_last: Column, minimum: Column) -> Column:
    """Whether a cut before a row leaves more than minimum left of it and, without the row unless it is the last one, right of it."""
    return (before > minimum) & (F.when(is_last, total - before).otherwise(total - upto) > minimum)


def statistic(kind: str, n: Column, s: Column, q: Column, n2: Column, s2: Column, q2: Column, mean: Column) -> Column:
    """Q or P of a cut with n and n2 rows on its sides; s and q are sums and squares of values less `mean`, which is near that of both sides together."""
    square = lambda k, a, b: F.greatest(F.lit(0.0), b - a * a / k)
    if kind == "q":
        whole = square(n + n2, s + s2, q + q2)
        return F.when(whole > FLAT * (n + n2) * mean * mean, 1 - (square(n, s, q) + square(n2, s2, q2)) / whole)
    cv = lambda k, a, b: F.when((k > 1) & (a + k * mean != 0), F.sqrt(square(k, a, b) / (k - 1)) * k / F.abs(a + k * mean))
    return (cv(n, s, q) + cv(n2, s2, q2)) / 2


def is_best(kind: str, x: Column, best: Column) -> Column:
    return x >= best - TIE if kind == "q" else x <= best + TIE * F.greatest(F.lit(1.0), F.abs(best))


def _placed(df: DataFrame, measure, variables: list[str], groups: list[str], low: int | None) -> DataFrame:
    """df with group __g, place __n in it, range __range, segment start __start, least length __low, length __vl and values __v0, ... as doubles."""
    f, t = measure
    d = df.withColumn("__g", F.struct(*groups) if groups else F.struct(F.lit(0).alias("all")))
    d = written(d.withColumn("__h", F.xxhash64(*df.columns)).withColumns({"__vl": whole_lengths(F.col(t) - F.col(f))} | {f"__v{i}": F.col(v).cast("double") for i, v in enumerate(variables)}))
    x = running(d, ["__g", f, t, "__h"], {"__n": F.lit(1).cast("long")}, ranges_of(d, ["__g", f, t, "__h"]), ("__g",))
    x = x.withColumns({"__start": F.lit(0).cast("long"), "__range": F.floor(F.col("__n") / RANGE).cast("int")})
    x = x.join(d.groupBy("__g").agg(F.min("__vl").alias("__low")), "__g") if low is None else x.withColumn("__low", F.lit(low).cast("long"))
    out = written(x.drop("__h"))
    discard(d)
    return out


def _segments(d: DataFrame, k: int) -> DataFrame:
    """One row for each segment: its rows, length and means."""
    return d.groupBy(*SEGMENT).agg(F.count("*").alias("__rows"), F.sum("__vl").alias("__all"), *[F.avg(f"__v{i}").alias(f"__m{i}") for i in range(k)])


def _cuts(d: DataFrame, open_: DataFrame, k: int, kind: str) -> DataFrame:
    """(__g, __start, __cut): places at which a segment of open_ splits best, far enough from its ends.

    Moments are of values less the segment's mean, by ranges of its group.
    """
    x = d.join(open_, SEGMENT)
    c = lambda i: F.col(f"__v{i}") - F.col(f"__m{i}")
    own = {"n": F.lit(1.0), "l": F.col("__vl")} | {f"s{i}": c(i) for i in range(k)} | {f"q{i}": c(i) * c(i) for i in range(k)}
    total = x.groupBy(*SEGMENT).agg(*[F.sum(v).alias(f"__a{n}") for n, v in own.items()])
    x = running(x, ["__n"], {f"__b{n}": v for n, v in own.items()}, F.col("__range"), tuple(SEGMENT)).join(total, SEGMENT)
    x = x.where((F.col("__bn") > 0) & far_enough(F.col("__bl"), F.col("__bl") + F.col("__vl"), F.col("__al"), F.col("__an") - F.col("__bn") == 1, F.col("__low")))
    of = lambda i: statistic(kind, F.col("__bn"), F.col(f"__bs{i}"), F.col(f"__bq{i}"), F.col("__an") - F.col("__bn"), F.col(f"__as{i}") - F.col(f"__bs{i}"), F.col(f"__aq{i}") - F.col(f"__bq{i}"), F.col(f"__m{i}"))
    x = written(x.select(*SEGMENT, "__n", (reduce(lambda a, b: a + b, [of(i) for i in range(k)]) / k).alias("__x")).where("__x is not null"))
    best = x.groupBy(*SEGMENT).agg((F.max if kind == "q" else F.min)("__x").alias("__best"))
    out = written(x.join(best, SEGMENT).where(is_best(kind, F.col("__x"), F.col("__best"))).select(*SEGMENT, F.col("__n").alias("__cut")))
    discard(x)
    return out


def _restarted(d: DataFrame, cuts: DataFrame) -> DataFrame:
    """d, each row's segment starting at the last cut at or before it."""
    x = d.join(cuts.select("__g", F.col("__cut").alias("__n"), F.lit(True).alias("__here")), ["__g", "__n"], "left")
    x = x.withColumn("__start", F.when(F.col("__here"), F.col("__n")).otherwise(F.col("__start")))
    # The latest start is the largest: first among a range's rows, then among the ranges before.
    top = x.groupBy("__g", "__range").agg(F.max("__start").alias("__m"))
    top = top.withColumn("__m", F.max("__m").over(W.partitionBy("__g").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)))
    w = W.partitionBy("__g", "__range").orderBy("__n").rowsBetween(W.unboundedPreceding, 0)
    x = x.join(top, ["__g", "__range"]).withColumn("__start", F.greatest(F.max("__start").over(w), F.coalesce("__m", F.lit(0))))
    return x.select(*d.columns)


def bisected(df: DataFrame, measure, variables: list[str], low: int | None, high: int, kind: str, groups: list[str], rows: int) -> DataFrame:
    """df with __g, __low, __vl and __start: groups bisected a segment a round until those over `high` hold `rows` rows at most or have no legal split.

    A round joins rows with their segments' means, takes moments by ranges, and joins the cuts; no task
    holds a group.
    """
    d, shut = _placed(df, measure, variables, groups, low), None
    while True:
        open_ = _segments(d, len(variables)).where((F.col("__all") > high) & (F.col("__rows") > rows)).drop("__rows", "__all")
        open_ = written(open_.join(shut, SEGMENT, "left_anti") if shut is not None else open_)
        if open_.isEmpty():
            discard(open_)
            return d
        cuts = _cuts(d, open_, len(variables), kind)
        uncut = open_.select(*SEGMENT).join(cuts.select(*SEGMENT).distinct(), SEGMENT, "left_anti")
        shut = written(uncut if shut is None else uncut.union(shut))
        new = written(_restarted(d, cuts))
        discard(d, open_, cuts)
        d = new


def numbered(d: DataFrame, columns: list[str], out: str) -> DataFrame:
    """columns and the one-based id of (__start, __local) in its group."""
    last = d.groupBy(*SEGMENT).agg(F.max("__local").alias("__ids"))
    ids = running(last, ["__g", "__start"], {"__before": F.col("__ids")}, within=("__g",))
    return d.join(ids.select(*SEGMENT, "__before"), SEGMENT).select(*columns, (F.col("__before") + F.col("__local")).cast("long").alias(out))
