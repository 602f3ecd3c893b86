"""Intervals to points and back; wide and long lanes."""
import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.mappings import LANES
from ..functions.steps import as_metres
from ..tables import passing, written
from . import ranges
from .ranges import both, largest, overlaps, running, scanned

#: Places of a word of points; two bits are left, so that one may be added to any part of it.
PLACES = 62


def gcd_metres(df: DataFrame, start: str, end: str) -> int:
    """Greatest common divisor of interval lengths in metres, from the distinct lengths (one row each)."""
    n = df.select((as_metres(F.col(end)) - as_metres(F.col(start))).alias("n")).where("n > 0").distinct()
    g = n.groupBy((F.col("n") % 64).alias("k")).agg(F.reduce(F.collect_set("n"), F.lit(0).cast("long"), _gcd).alias("g")).collect()
    return math.gcd(*[r.g for r in g]) or 1


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's steps on two columns; 64 are enough below 2**44."""
    pair = F.struct(a.alias("a"), b.alias("b"))
    step = lambda p, _: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), F.try_mod(p["a"], p["b"]).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(64)), pair, step, lambda p: p["a"])


def stretch(df: DataFrame, start: str, end: str, start_true: str | None = None, end_true: str | None = None, segment_size="GCD", as_km: bool = True, keep_ranges: bool = False, sort: list[str] | None = None) -> DataFrame:
    """Each interval as points of equal length, SLK and true_SLK; a size above the GCD falls back to it. sort: columns to order by."""
    size = gcd_metres(df, start, end)
    if segment_size != "GCD":
        size = min(size, int(segment_size))
    points = _points(df, start, end, start_true, end_true, size, as_km, keep_ranges)
    return points.orderBy(*sort) if sort else points


def _points(df: DataFrame, start: str, end: str, start_true: str | None, end_true: str | None, size: int, as_km: bool, keep_ranges: bool) -> DataFrame:
    unit = lambda x: x / 1000.0 if as_km else x
    a, b = as_metres(F.col(start)), as_metres(F.col(end))
    d = df.where(a < b).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((b - a - 1) / size))))
    new = {"SLK": unit(a + F.col("__k") * size)} | ({"true_SLK": unit(as_metres(F.col(start_true)) + F.col("__k") * size)} if start_true else {})
    d = d.withColumns(new).drop("__k")
    return d if keep_ranges else d.drop(*[c for c in (start, end, start_true, end_true) if c])


def make_segments(df: DataFrame, start: str, end: str, start_true: str | None = None, end_true: str | None = None, max_segment: int = 100, split_ends: bool = True, as_km: bool = True, id: str | None = None) -> DataFrame:
    """Pieces of at most max_segment metres; a short tail and its neighbour meet half way, to 10 m. Adds Length."""
    a, b = as_metres(F.col(start)), as_metres(F.col(end))
    d = df.withColumns({"__a": a, "__n": F.ceil((b - a) / max_segment), "__len": b - a}).withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.col("__n")))))
    tail = F.col("__len") - (F.col("__n") - 1) * max_segment

    def bound(base: Column, k: Column) -> Column:
        plain = F.when(k == F.col("__n"), base + F.col("__len")).otherwise(base + k * max_segment).cast("double")
        half = (base + F.col("__len") + base + (F.col("__n") - 2) * max_segment) / 2.0
        return F.when((F.col("__n") > 1) & (tail < max_segment) & (k == F.col("__n") - 1), F.bround(half, -1)).otherwise(plain) if split_ends else plain

    unit = lambda x: x / 1000.0 if as_km else x
    new = {start: unit(bound(F.col("__a"), F.col("__k") - 1)), end: unit(bound(F.col("__a"), F.col("__k")))}
    if start_true:
        t = as_metres(F.col(start_true))
        new |= {start_true: unit(bound(t, F.col("__k") - 1)), end_true: unit(bound(t, F.col("__k")))}
    new["Length"] = unit(bound(F.col("__a"), F.col("__k")) - bound(F.col("__a"), F.col("__k") - 1))
    if id:
        new |= {"original_id": F.col(id), "segment_id": F.col("__k")}
    return d.withColumns(new).drop("__a", "__n", "__len", "__k")


def get_segments(points: DataFrame, id_vars: list[str], slk: str, segment_size: int, true_slk: str | None = None, split_at=(), summarise: dict[str, Column] | None = None) -> DataFrame:
    """Points (km) that touch and share ids and split_at, as intervals; summarise maps names to aggregates over points.

    summarise=None gives ids only: each point with its segment number within the ids. With one measure,
    aggregates take points as runs (see _runs_of), so that what is shuffled grows with runs and not with points.
    """
    d = points.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*id_vars, slk]]))
    d = d.withColumn("__m", as_metres(F.col(slk)))
    if summarise is not None and not true_slk and slk not in (*id_vars, *split_at) and not any(re.search("map<|variant", k) for _, k in d.dtypes):
        return _run_segments(_runs_of(d, id_vars, slk, segment_size, list(split_at)), id_vars, segment_size, list(split_at), summarise, slk, d.schema[slk].dataType)
    key = ["__m"]
    if true_slk:
        d, key = d.withColumn("__t", as_metres(F.col(true_slk))), ["__m", "__t"]
    d = d.dropDuplicates([*id_vars, *key, *split_at])
    w = W.partitionBy(*id_vars).orderBy(*reversed(key), *split_at)
    brk = [F.lag("__m").over(w) + segment_size != F.col("__m")]
    if true_slk:
        brk = [brk[0] & (F.lag("__t").over(w) + segment_size != F.col("__t")), F.lag(F.col("__t") - F.col("__m")).over(w) != F.col("__t") - F.col("__m")]
    brk += [~F.lag(c).over(w).eqNullSafe(F.col(c)) for c in split_at]
    first = F.lag("__m").over(w).isNull()
    d = d.withColumn("__b", F.when(first | reduce(lambda a, b: a | b, brk), 1).otherwise(0)).withColumn("segment_no", F.sum("__b").over(w.rowsBetween(W.unboundedPreceding, 0)))
    if summarise is None:
        return d.drop("__b", *key)
    out = [(F.min("__m") / 1000.0).alias("START_SLK"), ((F.max("__m") + segment_size) / 1000.0).alias("END_SLK")]
    if true_slk:
        out += [(F.min("__t") / 1000.0).alias("START_TRUE"), ((F.max("__t") + segment_size) / 1000.0).alias("END_TRUE")]
    return d.groupBy(*id_vars, "segment_no", *split_at).agg(*out, *[c.alias(n) for n, c in summarise.items()]).drop("segment_no")


def _elementary(sides: list[DataFrame], id_vars: list[str], near: bool = False) -> DataFrame:
    """(ids, __a, __b): what lies between neighbouring bounds (__m, __n, whole metres) of all sides' rows, within the ids.

    near: no ids have many rows, so these are dealt by ids once; __deep is then how many rows cover an interval.
    """
    rows = reduce(DataFrame.union, [d.select(*id_vars, "__m", "__n") for d in sides])
    if near:
        ends = F.explode(F.array(F.struct(F.col("__m").alias("a"), F.lit(1).alias("d")), F.struct(F.col("__n").alias("a"), F.lit(-1).alias("d")))).alias("e")
        all_ = rows.repartition(*id_vars).select(*id_vars, ends).groupBy(*id_vars, F.col("e.a").alias("__a")).agg(F.sum("e.d").alias("__d"))
        all_ = running(all_, [*id_vars, "__a"], {"__deep": F.col("__d")}, within=tuple(id_vars), most=0).withColumn("__deep", F.col("__deep") + F.col("__d")).drop("__d")
    else:
        all_ = written(rows.select(*id_vars, F.explode(F.array("__m", "__n")).alias("__a")).distinct())
    e = scanned(all_, [*id_vars, "__a"], F.struct(*[F.col(c).alias(f"c{k}") for k, c in enumerate(id_vars)], F.col("__a").alias("a")), lead="__next", within=list(id_vars), most=0 if near else None)
    return e.where(both([F.col(f"__next.c{k}").eqNullSafe(F.col(c)) for k, c in enumerate(id_vars)]) & F.col("__next").isNotNull()).select(*id_vars, "__a", F.col("__next.a").alias("__b"), *(["__deep"] if near else []))


def _measured(df: DataFrame, start: str, end: str, start_true: str | None, id_vars: list[str]) -> DataFrame:
    """df with its bounds in whole metres (__m, __n) and the offset of its true measure (__off); rows without ids or length go."""
    d = df.withColumns({"__m": as_metres(F.col(start)), "__n": as_metres(F.col(end)), "__off": (as_metres(F.col(start_true)) - as_metres(F.col(start))) if start_true else F.lit(0).cast("long")})
    return d.where(both([F.col(c).isNotNull() for c in (*id_vars, "__off")]) & (F.col("__m") < F.col("__n")))


def _cut(cuts: DataFrame, d: DataFrame, id_vars: list[str], near: int = 0) -> DataFrame:
    """Each row of d once for each elementary interval (__a, __b) that it covers."""
    own = [c for c in d.columns if c not in (*id_vars, "__m", "__n")]
    got = overlaps(cuts, d, id_vars, ("__a", "__b"), ("__m", "__n"), {c: F.col(c) for c in own}, unique=True, near=near)
    return got.select(*id_vars, F.col("__tf").cast("long").alias("__a"), F.col("__tt").cast("long").alias("__b"), *own)


def _joined_up(pieces: DataFrame | None, id_vars: list[str], split: list[str], means: dict[str, str], true: bool, alone: DataFrame | None = None, near: bool = False) -> DataFrame:
    """Pieces (__a, __b, __off) that touch and share ids and split, as intervals with means weighted by length.

    Of pieces that agree in place and split one counts, the one of least values. alone: more pieces, which meet no other.
    near: no ids have many pieces, and pieces are dealt by ids.
    """
    vals = list(dict.fromkeys(means.values()))
    value, place = F.struct(F.lit(0).alias("one"), *[F.col(c).alias(f"v{k}") for k, c in enumerate(vals)]), [*id_vars, "__off", "__a", "__b", *split]
    sides = ([pieces.groupBy(*place).agg(F.min(value).alias("__v"))] if pieces is not None else []) + ([alone.select(*place, value.alias("__v"))] if alone is not None else [])
    d = reduce(DataFrame.unionByName, sides)
    ids, own = [f"c{k}" for k in range(len(id_vars))], [f"s{k}" for k in range(len(split))]
    row = F.struct(*[F.col(c).alias(k) for k, c in zip([*ids, *own], [*id_vars, *split])], F.col("__a").alias("a"), F.col("__b").alias("b"), F.col("__off").alias("off"))
    goes_on = lambda p, q: both([p[k].eqNullSafe(q[k]) for k in (*ids, *own, "off")] + [p["b"] == q["a"]])
    d = d.withColumn("__true", F.col("__a") + F.col("__off"))
    d = scanned(d if near else written(d), [*id_vars, "__true", "__a", *split, "__b"], row, breaks={"__run": lambda p, q: ~goes_on(p, q)}, within=list(id_vars), most=0 if near else None, apart=near)
    w = F.col("__b") - F.col("__a")
    mean = lambda c: F.sum(F.col(f"__v.v{vals.index(c)}") * w) / F.sum(F.when(F.col(f"__v.v{vals.index(c)}").isNotNull(), w))
    out = [(F.min("__a") / 1000.0).alias("START_SLK"), (F.max("__b") / 1000.0).alias("END_SLK")]
    if true:
        out += [(F.min("__true") / 1000.0).alias("START_TRUE"), ((F.max(F.col("__b") + F.col("__off"))) / 1000.0).alias("END_TRUE")]
    return d.groupBy(*id_vars, "__run", *split).agg(*out, *[mean(c).alias(n) for n, c in means.items()]).drop("__run")


def _runs_of(d: DataFrame, id_vars: list[str], slk: str, size: int, split: list[str]) -> DataFrame:
    """Points (__m) that are alike in every column but their place, as runs: __m, __m + size, ... below __n.

    Places are bits of a word, PLACES of them, which add up before they are shuffled. A point whose slk is no whole
    metre keeps it in __raw.
    """
    kind = d.schema[slk].dataType
    whole = (F.col("__m") / 1000.0).cast(kind)
    alike = [c for c in d.columns if c not in (slk, "__m")]
    place = F.floor(F.col("__m") / size)
    d = d.select(*alike, F.when(F.col(slk) != whole, F.col(slk)).alias("__raw"), F.pmod("__m", F.lit(size)).alias("__rem"), F.floor(place / PLACES).alias("__word"), F.pmod(place, F.lit(PLACES)).cast("int").alias("__at"))
    d = d.groupBy(*alike, "__raw", "__rem", "__word").agg(F.expr("bit_or(shiftleft(1L, __at))").alias("__bits"))
    d = d.withColumn("__starts", F.expr("__bits & ~shiftleft(__bits, 1)"))
    # A word has one run as a rule, whose start is the bits below it, counted.
    some = f"filter(sequence(0, {PLACES - 1}), k -> shiftright(__starts, k) % 2 = 1)"
    d = d.withColumn("__k", F.expr(f"explode(if(bit_count(__starts) = 1, array(bit_count(__starts - 1)), {some}))"))
    long = "bit_count(shiftright(__bits, __k) ^ (shiftright(__bits, __k) + 1)) - 1"
    d = d.withColumn("__m", ((F.col("__word") * PLACES + F.col("__k")) * size + F.col("__rem")).cast("long"))
    return d.withColumn("__n", F.col("__m") + F.expr(long) * F.lit(size)).select(*alike, "__raw", "__m", F.col("__n").cast("long").alias("__n"))


def _met(d: DataFrame, id_vars: list[str], order: list[str]) -> DataFrame:
    """d with __met, whether a row (__m to __n) overlaps another of its ids; order starts with ids and __m."""
    ids = [f"c{k}" for k in range(len(id_vars))]
    named = [F.col(c).alias(k) for k, c in zip(ids, id_vars)]
    same = lambda p: both([p[k] == F.col(c) for k, c in zip(ids, id_vars)])
    x = scanned(d, order, F.struct(*named, F.col("__m").alias("m")), lead="__next", tops={"__top": F.struct(*named, F.col("__n").alias("n"))}, within=id_vars)
    met = F.coalesce(F.col("__top").isNotNull() & same(F.col("__top")) & (F.col("__top.n") > F.col("__m")), F.lit(False)) | F.coalesce(F.col("__next").isNotNull() & same(F.col("__next")) & (F.col("__next.m") < F.col("__n")), F.lit(False))
    return x.withColumn("__met", met).drop("__next", "__top")


def _run_segments(runs: DataFrame, id_vars: list[str], size: int, split: list[str], summarise: dict[str, Column], slk: str = "SLK", kind: T.DataType = T.DoubleType()) -> DataFrame:
    """get_segments of the points __m, __m + size, ... below __n of each row, with the same result, but points only where they are summarised.

    A row that overlaps no other of its ids is one run of points; others are points, of which one
    stands for each place and split. Runs are scanned, and dealt to the summary's groups as points, which add up
    before they are shuffled.
    """
    ids, own = [f"c{k}" for k in range(len(id_vars))], [f"s{k}" for k in range(len(split))]
    named = [F.col(c).alias(k) for k, c in zip([*ids, *own], [*id_vars, *split])]
    row = F.struct(*named, F.col("__m").alias("m"), F.col("__n").alias("n"))
    # Nulls of split come first, as in get_segments.
    order = [*id_vars, "__m", *[c for k, s in enumerate(split) for c in (f"__has{k}", s)]]
    runs = runs.withColumns({f"__has{k}": F.col(s).isNotNull() for k, s in enumerate(split)})
    d = _met(written(runs), id_vars, order)
    d = d.withColumn("__met", F.explode(F.when(F.col("__met"), F.sequence("__m", F.col("__n") - size, F.lit(size).cast("long"))).otherwise(F.array(F.lit(None).cast("long")))))
    one = d.where("__met is not null").withColumn("__m", F.col("__met")).withColumn("__n", F.col("__m") + size).dropDuplicates([*id_vars, "__m", *split])
    d = written(d.where("__met is null").unionByName(one).drop("__met"))
    goes_on = lambda p, q: both([p[k].eqNullSafe(q[k]) for k in (*ids, *own)] + [p["n"] == q["m"]])
    d = scanned(d, order, row, breaks={"__run": lambda p, q: ~goes_on(p, q)}, within=id_vars)
    d = d.withColumn("__m", F.explode(F.sequence("__m", F.col("__n") - size, F.lit(size).cast("long"))))
    at = (F.col("__m") / 1000.0).cast(kind)
    d = d.withColumn(slk, F.coalesce("__raw", at) if "__raw" in d.columns else at)
    out = [(F.min("__m") / 1000.0).alias("START_SLK"), ((F.max("__m") + size) / 1000.0).alias("END_SLK")]
    return d.groupBy(*id_vars, "__run", *split).agg(*out, *[c.alias(n) for n, c in summarise.items()]).drop("__run")


def segments_of_intervals(df: DataFrame, id_vars: list[str], start: str, end: str, start_true: str | None = None, end_true: str | None = None, split_at=(), summarise: dict[str, str | Column] | None = None) -> DataFrame:
    """Intervals that touch and share ids and split_at as one; split_at=True: every column but ids, bounds and `summarise`'s names.

    summarise maps names to columns, whose means are weighted by length, or to aggregates. Columns need
    no points: rows that overlap others are cut at the bounds of their ids only. Aggregates are taken over points of
    the intervals' GCD, so that a mean is weighted by length too; with one measure, points are made only
    where they are summarised (see _run_segments).
    """
    bounds = [c for c in (start, end, start_true, end_true) if c]
    if split_at is True:
        split_at = [c for c in df.columns if c not in (*id_vars, *bounds, *(summarise or {}), *[c for c in (summarise or {}).values() if isinstance(c, str)])]
    if all(isinstance(c, str) for c in (summarise or {}).values()):
        d = _measured(df, start, end, start_true, id_vars)
        d = written(d.select(*dict.fromkeys([*id_vars, *split_at, *(summarise or {}).values()]), "__m", "__n", "__off"))
        d = written(_met(d, id_vars, [*id_vars, "__m"]))
        met, alone = d.where("__met").drop("__met"), d.where("not __met").withColumnsRenamed({"__m": "__a", "__n": "__b"})
        # No bound of another row lies within a row that overlaps none.
        pieces = None if met.isEmpty() else _cut(written(_elementary([met], id_vars)), met, id_vars)
        return _joined_up(pieces, id_vars, list(split_at), summarise or {}, bool(start_true), alone)
    size = gcd_metres(df, start, end)
    aggs = {n: F.avg(c) if isinstance(c, str) else c for n, c in summarise.items()}
    if not start_true:
        return _run_segments(_measured(df, start, end, None, id_vars).drop(*bounds, "__off"), id_vars, size, list(split_at), aggs)
    points = _points(df, start, end, start_true, end_true, size, True, False)
    return get_segments(points, id_vars, "SLK", size, "true_SLK", split_at, aggs)


def interval_merge(left: DataFrame, right: DataFrame, id_vars: list[str], start: str, end: str, summarise: dict[str, str | Column], start_true: str | None = None, end_true: str | None = None, split_at="left", use_ranges: bool = True, right_id_vars: list[str] | None = None, right_bounds: tuple[str, ...] | None = None) -> DataFrame:
    """Left intervals with per-point (length-weighted) summaries of right columns: summarise maps names to columns (their mean) or aggregates.

    Keeping left's own intervals and columns (use_ranges, split_at "left", one measure, means) is a
    range join. Otherwise both sides are cut at each other's bounds and joined by ids and place:
    split_at ("left", "right", True for both, a list or False) names what a segment may not
    mix; use_ranges keeps left's intervals apart, else what touches becomes one. Only where summarise
    holds aggregates are both sides points of their shared GCD. right_id_vars and
    right_bounds (start, end[, start_true, end_true]) name right's columns where they differ.
    """
    bounds = [c for c in (start, end, start_true, end_true) if c]
    names = dict(zip([*(right_id_vars or id_vars), *(right_bounds or bounds)], [*id_vars, *bounds]))
    right = right.withColumnsRenamed({a: b for a, b in names.items() if a != b})
    if use_ranges and split_at == "left" and not start_true and all(isinstance(c, str) for c in summarise.values()):
        from .aggregations import Action, Aggregation
        from .merge import on_slk_intervals

        return on_slk_intervals(left, right, id_vars, [Action(c, Aggregation.LengthWeightedAverage(), n) for n, c in summarise.items()], (start, end))
    own = lambda d: [c for c in d.columns if c not in (*id_vars, *bounds, "segment_id")]
    used = [c for c in summarise.values() if isinstance(c, str)]
    both_ = {"left": own(left), "right": own(right), True: [*own(left), *own(right)], False: []}
    split = list(split_at) if isinstance(split_at, (list, tuple)) else both_[split_at]
    split = [c for c in dict.fromkeys(split) if c not in used]
    if len(used) == len(summarise):
        kept = {c: f"org_{c}" for c in bounds} if use_ranges else {}
        own_a, own_b = ([c for c in own(d) if c in (*split, *used)] for d in (left, right))
        with passing() as keep:
            # Bounds and rows are read by turns.
            side = lambda d, columns, more=(): written(_measured(d, start, end, start_true, id_vars).select(*id_vars, "__m", "__n", "__off", *columns, *more))
            a = side(left, own_a, [F.col(c).alias(n) for c, n in kept.items()])
            b = side(right, [c for c in own_b if c not in left.columns])
            # Where no ids have many bounds, nor many pieces, rows are dealt by ids once, and joins, groups and scans stay there.
            near = bool(id_vars) and 2 * largest(a.select(*id_vars).union(b.select(*id_vars)), id_vars) <= ranges.RANGE_ROWS
            cuts = written(_elementary([a, b], id_vars, near))
            if near:
                deep = cuts.groupBy(*id_vars).agg(F.sum(F.col("__deep") * F.col("__deep")).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
                near = ranges.tasks_for(deep["all"] or 0) if (deep.most or 0) <= ranges.RANGE_ROWS else 0
            a, b = _cut(cuts, a, id_vars, near), _cut(cuts, b, id_vars, near).drop("__b")
            pieces = a.join(b, [*id_vars, "__a", "__off"], "left")
            out = keep(written(_joined_up(pieces, [*id_vars, *kept.values()], split, summarise, bool(start_true), near=bool(near)), near=bool(near)))
        if not use_ranges:
            return out
        return out.drop("START_SLK", "END_SLK", "START_TRUE", "END_TRUE").withColumnsRenamed({v: k for k, v in kept.items()}).distinct()
    size = math.gcd(gcd_metres(left, start, end), gcd_metres(right, start, end))
    if start_true:
        size = math.gcd(size, gcd_metres(left, start_true, end_true), gcd_metres(right, start_true, end_true))
    aggs = {n: F.avg(c) if isinstance(c, str) else c for n, c in summarise.items()}
    if not start_true:
        # Points meet where their places agree, so within one remainder: there bounds are whole steps apart.
        step = lambda d: _measured(d.drop("segment_id"), start, end, None, id_vars).withColumn("__rem", F.pmod("__m", F.lit(size))).drop("__off")
        a, b, ids = step(left), step(right), [*id_vars, "__rem"]
        kept = {c: f"org_{c}" for c in bounds} if use_ranges else {}
        cuts = written(_elementary([a, b], ids))
        a = _cut(cuts, a.withColumnsRenamed(kept) if kept else a.drop(*bounds), ids)
        b = _cut(cuts, b.drop(*bounds, *[c for c in own(right) if c in left.columns]), ids).drop("__b")
        runs = a.join(b, [*ids, "__a"], "left").drop("__rem").withColumnsRenamed({"__a": "__m", "__b": "__n"})
        out = _run_segments(runs, [*id_vars, *kept.values()], size, split, aggs)
        return out.drop("START_SLK", "END_SLK").withColumnsRenamed({v: k for k, v in kept.items()}).distinct() if use_ranges else out
    at = ["SLK", *(["true_SLK"] if start_true else [])]
    kept = {c: f"org_{c}" for c in bounds} if use_ranges else {}
    a = _points(left.drop("segment_id"), start, end, start_true, end_true, size, True, use_ranges).withColumnsRenamed(kept)
    b = _points(right.drop("segment_id"), start, end, start_true, end_true, size, True, False)
    # Equal names stand for left's column; places meet as whole metres.
    key = [*id_vars, *[f"__{c}" for c in at]]
    metres = {f"__{c}": as_metres(F.col(c)) for c in at}
    b = b.withColumns(metres).drop(*at, *[c for c in own(right) if c in a.columns])
    points = a.withColumns(metres).join(b, key, "left")
    out = get_segments(points, [*id_vars, *kept.values()], "SLK", size, "true_SLK" if start_true else None, split, aggs)
    if not use_ranges:
        return out
    return out.drop("START_SLK", "END_SLK", "START_TRUE", "END_TRUE").withColumnsRenamed({v: k for k, v in kept.items()}).distinct()


def lane_to_col(df: DataFrame, xsp: str, id_vars: list[str], values: list[str], all_lanes: bool = False, side_split: bool = False, turn_pockets: bool = False) -> DataFrame:
    """One row for each ids, one column for each value and lane; turn_pockets keeps the lane TP beside the regular ones."""
    lanes = LANES if all_lanes else [*LANES[:11], *(["TP"] if turn_pockets else [])]
    d = df.where(F.col(xsp).isin(lanes))
    if side_split:
        d = d.withColumns({"SIDE": F.substring(xsp, 1, 1), xsp: F.substring(xsp, 2, 9)})
        id_vars, lanes = [*id_vars, "SIDE"], sorted({x[1:] for x in lanes})
    p = d.groupBy(*id_vars).pivot(xsp, lanes).agg(*[F.first(v, True).alias(v) for v in values])
    one = len(values) == 1
    return p.select(*id_vars, *[F.col(x if one else f"{x}_{v}").alias(f"{v}{x}") for v in values for x in lanes])


def wide_lanes_to_row(df: DataFrame, id_vars: list[str], lane_var: str, side: str | None = None, bounds=(), prefixes: str | list[str] | None = None, side_split: bool = False, all_lanes: bool = False) -> DataFrame:
    """Wide lane columns to rows (ids, side, bounds, lane_var, values).

    Without prefixes the columns are named by lane and the value is `value`; one prefix takes every
    column whose name holds it, and names the value; several take the k-th column of each for row k,
    named by the first's column. side_split makes XSP of side and the lane name's last character, TP
    for turn pockets, in place of both.
    """
    keep = [*id_vars, *([side] if side else []), *bounds]
    if prefixes is None:
        rows = [[x] for x in (LANES if all_lanes else LANES[:11]) if x in df.columns]
        names = ["value"]
    else:
        names = [prefixes] if isinstance(prefixes, str) else list(prefixes)
        found = [[c for c in df.columns if p in c and c not in keep] for p in names]
        rows = [[f[k] if k < len(f) else None for f in found] for k in range(len(found[0]))]
    cell = lambda r: F.struct(F.lit(r[0]).alias("lane"), *[(F.col(c) if c else F.lit(None)).alias(n) for n, c in zip(names, r)])
    out = df.select(*keep, F.explode(F.array(*[cell(r) for r in rows])).alias("__r")).select(*keep, F.col("__r.lane").alias(lane_var), *[F.col(f"__r.{n}").alias(n) for n in names])
    if not side_split:
        return out
    code = F.concat(F.col(side), F.substring(F.col(lane_var), -1, 1))
    out = out.withColumn("XSP", F.when(code.contains("P"), "TP").otherwise(code))
    return out.select(*[c for c in keep if c != side], "XSP", *names).distinct()


def lane_to_row(df: DataFrame, dirn: str, id_vars: list[str], prefixes: list[str], out: str = "XSP") -> DataFrame:
    """Wide lane columns (prefix and number) to one row for each lane; a prefix that lacks a number gives null."""
    nums = sorted({int(c[len(p):]) for p in prefixes for c in df.columns if c.startswith(p) and c[len(p):].isdigit()})
    row = lambda n: F.struct(F.lit(str(n)).alias("n"), *[(F.col(f"{p}{n}") if f"{p}{n}" in df.columns else F.lit(None).cast("double")).alias(p.rstrip("_")) for p in prefixes])
    d = df.select(*id_vars, dirn, F.explode(F.array(*[row(n) for n in nums])).alias("r"))
    return d.select(*id_vars, F.concat(F.col(dirn), F.col("r.n")).alias(out), *[f"r.{p.rstrip('_')}" for p in prefixes])


def lane_side_split(df: DataFrame, xsp: str, all_lanes: bool = False) -> DataFrame:
    """SIDE and LANE_NO of lanes 1 to 6 (of any code with all_lanes); xsp goes."""
    d = df if all_lanes else df.where(F.col(xsp).rlike("^(L|R)[1-6]"))
    return d.withColumns({"SIDE": F.substring(xsp, 1, 1), "LANE_NO": F.substring(xsp, 2, 9) if all_lanes else F.substring(xsp, 2, 1).cast("int")}).drop(xsp)


def cway_to_side(df: DataFrame, cway: str) -> DataFrame:
    """Rows for side R (carriageways R, S) and side L (L, S)."""
    side = F.when(F.col(cway).isin("Right", "R"), F.array(F.lit("R"))).when(F.col(cway).isin("Left", "L"), F.array(F.lit("L"))).when(F.col(cway).isin("Single", "S"), F.array(F.lit("R"), F.lit("L")))
    return df.withColumn("side", F.explode(side))
