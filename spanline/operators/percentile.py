"""Length-weighted percentiles by prefix sums over ranges of values, without an array of a group's rows."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written
from .ranges import both, running


def weighted_percentiles(rows: DataFrame, by: list[str], levels: dict[str, tuple[str, float]], order: list[str], weight: str) -> DataFrame:
    """One row for each `by` (not null) with, for each of levels (output: column, level), its weighted percentile; nulls don't count.

    A row's value stands at the middle of its weight, values in between are interpolated, and the first
    and last middle are levels 0 and 1. Rows go by value, then `order`. Weights are summed by ranges of
    that order, so that a group of any size is many tasks; the two rows around a level are then
    aggregates. Weights must be positive.
    """
    key = [f"__k{i}" for i in range(len(by))]
    value = F.explode(F.array(*[F.struct(F.lit(n).alias("a"), F.col(c).cast("double").alias("v")) for n, c in enumerate(dict.fromkeys(c for c, _ in levels.values()))])).alias("x")
    column = {c: n for n, c in enumerate(dict.fromkeys(c for c, _ in levels.values()))}
    tie = [f"__o{i}" for i in range(len(order))]
    d = rows.select(*[F.col(c).alias(k) for c, k in zip(by, key)], *[F.col(c).alias(o) for c, o in zip(order, tie)], F.col(weight).cast("double").alias("__w"), value)
    d = written(d.select(*key, *tie, "__w", F.col("x.a").alias("__a"), F.col("x.v").alias("__v")).where("__v is not null"))
    group = [*key, "__a"]
    place = F.struct("__v", *tie)
    ends = d.groupBy(*group).agg(F.sum("__w").alias("all"), F.min_by(F.struct("__v", "__w"), place).alias("a"), F.max_by(F.struct("__v", "__w"), place).alias("z"))
    x = running(d, [*group, "__v", *tie], {"__s": F.col("__w")}, within=tuple(group)).join(ends.hint("merge"), group)
    middle = F.col("__s") + F.col("__w") / 2

    def level(p: float):
        """Around the level's place: the last row before it and the first one there or after it."""
        at = F.col("a.__w") / 2 + p * (F.col("all") - (F.col("a.__w") + F.col("z.__w")) / 2)
        row = F.struct(middle.alias("x"), F.col("__v").alias("v"), at.alias("at"))
        return F.struct(F.max(F.when(middle < at, row)).alias("l"), F.min(F.when(middle >= at, row)).alias("r"))

    names = list(levels)
    got = x.groupBy(*group).agg(F.first("a.__v").alias("lo"), F.first("z.__v").alias("hi"), *[level(p).alias(f"__p{i}") for i, (_, p) in enumerate(levels.values())])

    def result(i: int, p: float):
        if p <= 0 or p >= 1:
            return F.col("lo" if p <= 0 else "hi")
        a, b = F.col(f"__p{i}.l"), F.col(f"__p{i}.r")
        # Rounding may leave the last middle just below the level.
        return F.when(b.isNull(), F.col("hi")).when(a.isNull(), b["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (b["at"] - a["x"]) / (b["x"] - a["x"]))

    one = got.select(*key, "__a", *[result(i, p).alias(f"__p{i}") for i, (_, p) in enumerate(levels.values())])
    mine = one.groupBy(*key).agg(*[F.first(F.when(F.col("__a") == column[levels[n][0]], F.col(f"__p{i}")), True).alias(n) for i, n in enumerate(names)])
    return mine.select(*[F.col(k).alias(c) for k, c in zip(key, by)], *names)


def joined(got: DataFrame, more: DataFrame, by: list[str]) -> DataFrame:
    """got and the other columns of more, which has one row at most for each `by`."""
    m = more.withColumnsRenamed({c: f"__j{k}" for k, c in enumerate(by)})
    return got.join(m.hint("merge"), both([F.col(c) == F.col(f"__j{k}") for k, c in enumerate(by)]), "left").drop(*[f"__j{k}" for k in range(len(by))])
