"""Homogeneous segmentation: cumulative Q and P, bisection, SHS and MCV.

All of them take moments of values less their mean, of a group or a segment, so that sums over many
rows lose nothing to large values; a mean square below FLAT of the squared mean is no variation,
and places within TIE of the best statistic are equal, so that rounding decides neither.
"""
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import passing, written
from .bisection import FLAT, SEGMENT, TIE, UNITS, bisected, far_enough, is_best, numbered, statistic, whole_length, whole_lengths
from . import ranges
from .ranges import both, in_order, largest, running


def _moments(df: DataFrame, groups: list[str], order: str, values: list[str], length: str | None = None) -> DataFrame:
    """df with rows (n), sums (s) and squares (q) of values less their group's mean before each row (b), up to it (l) and of the group (a), group means (m), and lengths so (x).

    Groups' means and squares are mergeable moments; sums run in two levels of ranges, so a group of any
    size is many tasks.
    """
    key, k = _key(groups), range(len(values))
    d = df.select("*", *[F.col(c).alias(n) for c, n in zip(groups, key)], *([] if groups else [F.lit(0).alias(key[0])]), *[F.col(v).cast("double").alias(f"__v{i}") for i, v in enumerate(values)], *([whole_lengths(F.col(length)).alias("__vx")] if length else []))
    # Means and sums are two passes.
    d = written(d)
    group = d.groupBy(*key).agg(F.count("*").cast("double").alias("__an"), *[F.avg(f"__v{i}").alias(f"__m{i}") for i in k], *[(F.var_pop(f"__v{i}") * F.count(f"__v{i}")).alias(f"__aq{i}") for i in k], *([F.sum("__vx").alias("__ax")] if length else []))
    group = written(group.toDF(*[f"__g{n}" for n in key], *group.columns[len(key) :]))
    most = int(group.agg(F.max("__an")).first()[0] or 0)
    cuts = ranges.ranges_of(d, [*key, order]) if most > ranges.RANGE_ROWS else None
    d = d.join(group, both([F.col(n).eqNullSafe(F.col(f"__g{n}")) for n in key])).drop(*[f"__g{n}" for n in key])
    c = lambda i: F.col(f"__v{i}") - F.col(f"__m{i}")
    own = {"n": F.lit(1.0)} | {f"s{i}": c(i) for i in k} | {f"q{i}": c(i) * c(i) for i in k} | ({"x": F.col("__vx")} if length else {})
    r = running(d, [*key, order], {f"__b{n}": v for n, v in own.items()}, ranges=cuts, within=tuple(key), most=most)
    return r.withColumns({f"__l{n}": F.col(f"__b{n}") + F.coalesce(v, F.lit(0)) for n, v in own.items()})


def _key(groups: list[str]) -> list[str]:
    """Names of the groups' copies; all rows are one group without any."""
    return [f"__k{i}" for i in range(max(1, len(groups)))]


def _split(kind: str, i: int, side: str = "l") -> Column:
    """The statistic of variable i for a cut after each row (before it, with side b); null at a group's ends."""
    n, s, q, m = F.col(f"__{side}n"), F.col(f"__{side}s{i}"), F.col(f"__{side}q{i}"), F.col(f"__m{i}")
    rest = F.col("__an") - n
    return F.when(rest > 0, statistic(kind, n, s, q, rest, -s, F.col(f"__aq{i}") - q, m))


def cumulative_q(df: DataFrame, groups: list[str], order: str, value: str, out: str = "q", whole: bool = False) -> DataFrame:
    """Share of the sum of squares that a split after each row explains; a group's last row has none and goes, unless `whole`.

    Null where the group has no variation.
    """
    d = _moments(df, groups, order, [value]).withColumn(out, _split("q", 0))
    return (d if whole else d.where("__an > __ln")).select(*df.columns, out)


def cumulative_p(df: DataFrame, groups: list[str], order: str, value: str, out: str = "p", whole: bool = False) -> DataFrame:
    """Mean of the coefficients of variation left and right of a split after each row; null where a side has one row or the mean 0.

    A group's last row has none and goes, unless `whole`.
    """
    d = _moments(df, groups, order, [value]).withColumn(out, _split("p", 0))
    return (d if whole else d.where("__an > __ln")).select(*df.columns, out)


def best_bisection(df: DataFrame, groups: list[str], order: str, value: str | list[str], length: str, minimum: float, out: str = "best_q", kind: str = "q") -> DataFrame:
    """Rows after which a split has the best mean statistic of the variables (most of Q, least of P).

    A split counts where more than minimum lies left of it, and more than minimum right of it without
    the row next to it (with it, if that is the last one); all equals (within TIE) are given.
    """
    values = [value] if isinstance(value, str) else list(value)
    low = F.lit(whole_length(minimum))
    mean = lambda side: reduce(lambda a, b: a + b, [_split(kind, k, side) for k in range(len(values))]) / len(values)
    if groups and largest(df, groups) <= ranges.RANGE_ROWS:
        return _best_by_group(df, groups, order, values, length, low, mean, out, kind)
    with passing() as kept:
        d = kept(written(_moments(df, groups, order, values, length)))
    key = _key(groups)
    same = both([F.col(k).eqNullSafe(F.col(f"__g{k}")) for k in key])
    # A cut stands before a row, where it is known what follows; the row before it is found by its place.
    x = d.where((F.col("__bn") > 0) & far_enough(F.col("__bx"), F.col("__lx"), F.col("__ax"), F.col("__an") == F.col("__ln"), low))
    x = x.select(*[F.col(k).alias(f"__g{k}") for k in key], F.col("__bn").alias("__at"), mean("b").alias("__x")).where("__x is not null")
    best = x.groupBy(*[f"__g{k}" for k in key]).agg((F.max if kind == "q" else F.min)("__x").alias("__best"))
    x = x.join(best.toDF(*[f"__h{k}" for k in key], "__best"), both([F.col(f"__g{k}").eqNullSafe(F.col(f"__h{k}")) for k in key])).where(is_best(kind, F.col("__x"), F.col("__best")))
    return d.join(x, same & (F.col("__ln") == F.col("__at"))).select(*df.columns, F.col("__x").alias(out))


def _best_by_group(df: DataFrame, groups: list[str], order: str, values: list[str], length: str, low: Column, mean: Callable[[str], Column], out: str, kind: str) -> DataFrame:
    """best_bisection where no group has more rows than a range: groups are windows, so rows are dealt once and nothing is written."""
    k = range(len(values))
    every = W.partitionBy(*groups)
    w = every.orderBy(*in_order([order]))
    d = df.withColumns({f"__v{i}": F.col(v).cast("double") for i, v in enumerate(values)} | {"__vx": whole_lengths(F.col(length))})
    d = d.withColumns({"__an": F.count("*").over(every).cast("double"), "__ax": F.sum("__vx").over(every)} | {f"__m{i}": F.avg(f"__v{i}").over(every) for i in k})
    c = lambda i: F.col(f"__v{i}") - F.col(f"__m{i}")
    own = {"n": F.lit(1.0)} | {f"s{i}": c(i) for i in k} | {f"q{i}": c(i) * c(i) for i in k} | {"x": F.col("__vx")}
    d = d.withColumns({f"__b{n}": F.coalesce(F.sum(v).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) for n, v in own.items()} | {f"__aq{i}": F.sum(c(i) * c(i)).over(every) for i in k})
    # A cut stands before a row; the row before it is the one whose next row it is.
    upto = F.col("__bx") + F.coalesce(F.col("__vx"), F.lit(0))
    legal = (F.col("__bn") > 0) & far_enough(F.col("__bx"), upto, F.col("__ax"), F.col("__an") == F.col("__bn") + 1, low)
    d = d.withColumn("__x", F.when(legal, mean("b"))).withColumn("__x", F.lead("__x").over(w))
    d = d.withColumn("__best", (F.max if kind == "q" else F.min)("__x").over(every))
    return d.where(is_best(kind, F.col("__x"), F.col("__best"))).select(*df.columns, F.col("__x").alias(out))


def _statistic(x: np.ndarray, kind: str) -> np.ndarray:
    """The statistic of a cut after each row but the last, as bisection.statistic has it."""
    n = np.arange(1, len(x))
    mean = x.mean()
    c = x - mean
    s, q = np.cumsum(c), np.cumsum(c * c)
    sl, ql, sr, qr, m = s[:-1], q[:-1], s[-1] - s[:-1], q[-1] - q[:-1], len(x) - n
    square = lambda k, a, b: np.maximum(0, b - a * a / k)
    if kind == "q":
        whole = square(len(x), s[-1], q[-1])
        if whole <= FLAT * len(x) * mean * mean:
            return np.full(len(n), np.nan)
        return 1 - (square(n, sl, ql) + square(m, sr, qr)) / whole
    with np.errstate(all="ignore"):
        cv = lambda k, a, b: np.where((k > 1) & (a + k * mean != 0), np.sqrt(square(k, a, b) / (k - 1)) * k / np.abs(a + k * mean), np.nan)
        return (cv(n, sl, ql) + cv(m, sr, qr)) / 2


def bisections(values: np.ndarray, length: np.ndarray, minimum: float, kind: str) -> list[int]:
    """Split positions of the best mean statistic, all equals; none if no position is far enough from both ends (as bisection.far_enough has it)."""
    if len(length) < 2:
        return []
    left = np.cumsum(length)
    right = np.append(left[-1] - left[1:-1], length[-1])
    at = np.flatnonzero((left[:-1] > minimum) & (right > minimum))
    if not len(at):
        return []
    m = np.mean([_statistic(v, kind) for v in values.T], axis=0)[at]
    m = np.where(np.isfinite(m), m, np.nan)
    if np.isnan(m).all():
        return []
    best = np.nanmax(m) if kind == "q" else np.nanmin(m)
    return (at[m >= best - TIE if kind == "q" else m <= best + TIE * max(1.0, abs(best))] + 1).tolist()


def _ids(values, length, low, high, kind) -> np.ndarray:
    todo, cuts = [(0, len(length), True)], set()
    while todo:
        a, b, always = todo.pop()
        if not always and length[a:b].sum() <= high:
            continue
        got = [a + k for k in bisections(values[a:b], length[a:b], low, kind)]
        cuts |= set(got)
        ends = [a, *got, b]
        todo += [(x, y, False) for x, y in zip(ends, ends[1:])] if got else []
    ids = np.zeros(len(length), np.int64)
    ids[sorted(cuts)] = 1
    return np.cumsum(ids) + 1


def segment_ids(df: DataFrame, measure, variables: list[str], allowed=None, kind: str = "q", groups=(), out: str = "segment_id", task_rows: int = 100_000) -> DataFrame:
    """One-based ids per group: SHS (kind q) or MCV (kind p) by repeated bisection of segments over the longest allowed.

    Rows that miss a variable are dropped; a segment without a legal split stays; without a longest
    length a group is one segment. Lengths count to ten places. Rows go by start, end, then a hash of the row. Every place whose
    statistic equals the best one is a cut: under P all places of a stretch without variation are equal,
    under Q none of them is a cut. Groups of up to task_rows rows are bisected in one task each; where
    there are larger ones, rounds of Spark jobs cut these first (see bisection.bisected), with the same
    moments and the same notion of equal, so task_rows does not change ids.
    """
    f, t = measure
    groups = list(groups)
    low, high = (None if x is None else whole_length(x) for x in allowed or (None, None))
    d = df.dropna(subset=[*variables])
    if high is None:
        return d.withColumn(out, F.lit(1).cast("long"))
    most = d.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0
    if most <= task_rows:
        return _grouped(d, measure, variables, low, high, kind, groups, out).drop("__h")
    x = bisected(d, measure, variables, low, high, kind, groups, task_rows)
    # What is left to cut fits a task each; the rest are segments as they are.
    size = x.groupBy(*SEGMENT).agg(F.count("*").alias("__rows"), F.sum("__vl").alias("__all"))
    todo = (F.col("__rows") <= task_rows) & (F.col("__all") > high)
    x = x.select(*df.columns, *SEGMENT, "__low").join(size, SEGMENT)
    rest = x.where(~todo).withColumn("__local", F.lit(1).cast("long"))
    cut = _grouped(x.where(todo), measure, variables, None, high, kind, SEGMENT, "__local")
    return numbered(written(rest.unionByName(cut.drop("__h")).select(*df.columns, *SEGMENT, "__local")), df.columns, out)


def _grouped(df: DataFrame, measure, variables: list[str], low: int | None, high: int, kind: str, groups: list[str], out: str) -> DataFrame:
    """Ids of whole groups, many of them in a task; without low the least length is column __low, else the group's.

    Groups come in order, so that a batch of rows is read once for all of its groups; what goes on in the next batch is held.
    """
    f, t = measure
    df = df.withColumn("__h", F.xxhash64(*[c for c in df.columns if c[:2] != "__"]))
    columns, schema = df.columns, ", ".join([*(f"`{n}` {k}" for n, k in df.dtypes), f"`{out}` long"])
    own = {"__length": (F.col(t) - F.col(f)).cast("double")} | {f"__x{i}": F.col(v).cast("double") for i, v in enumerate(variables)}
    d = df.withColumns({"__first": F.row_number().over(W.partitionBy(*groups).orderBy(*in_order([f, t, "__h"]))) == 1} | own)

    def cut(x: pa.Table):
        at = [*np.flatnonzero(x["__first"].to_numpy()), len(x)]
        length = np.rint(x["__length"].to_numpy() * UNITS).astype(np.int64)
        values = np.column_stack([x[f"__x{i}"].to_numpy() for i in range(len(variables))]) if variables else np.zeros((len(x), 0))
        ids = np.ones(len(x), np.int64)
        for a, z in zip(at, at[1:]):
            if length[a:z].sum() > high:
                least = low if low is not None else x["__low"][a].as_py() if "__low" in x.column_names else length[a:z].min()
                ids[a:z] = _ids(values[a:z], length[a:z], least, high, kind)
        return x.select(columns).append_column(out, pa.array(ids)).to_batches()

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            x = pa.Table.from_batches([b])
            x = pa.concat_tables([held, x]) if held is not None else x
            last = int(np.flatnonzero(x["__first"].to_numpy())[-1])
            if last:
                yield from cut(x.slice(0, last))
            held = x.slice(last)
        if held is not None:
            yield from cut(held)

    return d.mapInArrow(run, schema)


def shs(df, measure, variables, allowed=None, groups=(), out="segment_id") -> DataFrame:
    return segment_ids(df, measure, variables, allowed, "q", groups, out)


def mcv(df, measure, variables, allowed=None, groups=(), out="segment_id") -> DataFrame:
    return segment_ids(df, measure, variables, allowed, "p", groups, out)
