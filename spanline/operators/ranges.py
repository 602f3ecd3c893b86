"""Range joins by length classes, and scans and prefix sums over ranges of a sort order, shared by the operators."""
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..performance import timed
from ..tables import discard, once, written

BASE, DEPTH, BIN_ROWS = 4.0, 26, 256
RANGE_ROWS, SAMPLES, DEEP = 65_536, 16, 5
TASK_ROWS = 262_144


def both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _class(a: str, b: str) -> Column:
    """Length class: BASE^class <= length < BASE^(class + 1)."""
    return F.floor(F.log(BASE, F.col(b) - F.col(a))).cast("long")


class _Classes:
    """Which bins the intervals of two sides meet in.

    A pair of classes meets in bins of one level, the width BASE^(level + 1). That is the longer
    class's own level, at which either interval touches two bins at most, or a finer one as long as the
    longer side's bins stay below the shorter side's rows over BIN_ROWS: so a few very long intervals are
    dealt over many bins, and one of them alone is no list as long as the table. Bounds beyond the
    finite ones of either side are moved to just outside these.
    """

    def __init__(self, left: DataFrame, right: DataFrame):
        finite = lambda c: F.when(F.abs(c) < math.inf, F.col(c))
        one = lambda d, a, b, side: d.groupBy(_class(a, b).alias("c")).agg(F.count("*").alias("n"), F.min(F.least(finite(a), finite(b))).alias("lo"), F.max(F.greatest(finite(a), finite(b))).alias("hi")).withColumn("s", F.lit(side))
        # One small job: a row for each class of either side.
        with timed("length_classes") as told:
            rows = one(left, "__tf", "__tt", 0).unionByName(one(right, "__from", "__to", 1)).collect()
            told["classes"] = len(rows)
        lo, hi = min((r.lo for r in rows if r.lo is not None), default=0.0), max((r.hi for r in rows if r.hi is not None), default=0.0)
        self.lo, self.hi = lo - 1, hi + 1
        self.top = math.floor(math.log(max(self.hi - self.lo, 1e-300), BASE))
        n = ({}, {})
        for r in rows:
            k = min(max(r.c, self.top - DEPTH), self.top)
            n[r.s][k] = n[r.s].get(k, 0) + r.n
        self.level = {(a, b): self._level(a, b, x, y) for a, x in n[0].items() for b, y in n[1].items()}
        self.levels = [{k: sorted({v for p, v in self.level.items() if p[s] == k}) for k in n[s]} for s in (0, 1)]
        self.one = len(set(self.level.values())) == 1

    @staticmethod
    def _level(a: int, b: int, x: int, y: int) -> int:
        few, many = (x, y) if a > b else (y, x)
        finer = math.floor(math.log(many / few / BIN_ROWS, BASE)) if many > few * BIN_ROWS else 0
        return max(min(a, b), max(a, b) - finer)

    def _lookup(self, values: dict[int, str], kind: str, of: Column) -> Column:
        """The value of a class, from a list by place."""
        base = self.top - DEPTH
        listed = ", ".join(values.get(base + k, f"cast(null as {kind})") for k in range(DEPTH + 1))
        return F.get(F.expr(f"array({listed})"), (of - base).cast("int"))

    def cut(self, d: DataFrame, side: int, a: str, b: str) -> DataFrame:
        """d with class, level and bin (__class_{side} and so on) of each bin that an interval touches."""
        c = f"__class_{side}"
        d = d.withColumn(c, F.least(F.greatest(_class(a, b), F.lit(self.top - DEPTH)), F.lit(self.top)))
        if self.one:
            level = F.lit(next(iter(self.level.values())))
        else:
            level = F.explode(self._lookup({k: f"array({', '.join(f'{v}L' for v in vs)})" for k, vs in self.levels[side].items()}, "array<bigint>", F.col(c)))
        d = d.withColumn(f"__level_{side}", level)
        width = self.width(f"__level_{side}")
        first = F.floor(self.inside(F.col(a)) / width)
        last = F.greatest(first, F.ceil(self.inside(F.col(b)) / width) - 1)
        return d.withColumn(f"__bin_{side}", F.explode(F.sequence(first, last)))

    def inside(self, x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(self.lo)), F.lit(self.hi))

    def width(self, level: str) -> Column:
        return F.lit(BASE ** (next(iter(self.level.values())) + 1)) if self.one else F.pow(F.lit(BASE), F.col(level) + 1)

    def meets(self) -> list[Column]:
        """Where a pair of rows is counted: at the level of their classes, in the bin where their overlap starts."""
        on = [F.col("__level_0") == F.col("__level_1"), F.col("__bin_0") == F.col("__bin_1"), F.col("__bin_0") == F.floor(self.inside(F.greatest("__tf", "__from")) / self.width("__level_0"))]
        if self.one:
            return on[1:]
        of = {}
        for (a, b), v in self.level.items():
            of.setdefault(a, {})[b] = f"{v}L"
        base = self.top - DEPTH
        row = lambda x: "array(" + ", ".join(x.get(base + k, "cast(null as bigint)") for k in range(DEPTH + 1)) + ")"
        return [*on, F.get(self._lookup({a: row(x) for a, x in of.items()}, "array<bigint>", F.col("__class_0")), (F.col("__class_1") - base).cast("int")) == F.col("__level_0")]


def overlaps(target: DataFrame, data: DataFrame, keys: list[str], target_range, data_range, columns: dict[str, Column], bin_width: float | None = None, carry: tuple[str, ...] = (), unique: bool = False, near: int = 0) -> DataFrame:
    """Each distinct (keys, __tf, __tt, carry) of target with each data row (__from, __to, columns) of positive overlap.

    Keys must be equal and not null; empty, reversed, null and NaN intervals meet nothing. Both sides are
    cut into bins that are part of the join key, so that a long or hot group is dealt over many tasks
    and no group is compared in full; a pair is counted in the bin where its overlap starts.
    bin_width None takes bins by length class (one small job over both sides' bounds), so that rows met
    stay near the number of pairs however lengths are mixed, infinite ends included; a number is one
    width for all; 0 cuts no bins. Where classes are counted both sides are read twice, so they are written tables.
    unique: target's intervals are distinct as they are. near: no key has many rows, so both sides are dealt by keys alone, over so many tasks.
    """
    (tf, tt), (df, dt) = target_range, data_range
    if bin_width is None:
        target = once(target)
    left = target.select(*keys, *carry, F.col(tf).cast("double").alias("__tf"), F.col(tt).cast("double").alias("__tt")).where("__tf < __tt and not isnan(__tt)")
    left = left if unique else left.distinct()
    right = data.select(*[F.col(c).alias(f"__k{n}") for n, c in enumerate(keys)], F.col(df).cast("double").alias("__from"), F.col(dt).cast("double").alias("__to"), *[v.alias(n) for n, v in columns.items()]).where("__from < __to and not isnan(__to)")
    on = [F.col(c) == F.col(f"__k{n}") for n, c in enumerate(keys)]
    if bin_width:
        cut = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_width), F.ceil(F.col(b) / bin_width) - 1))
        left, right = left.withColumn("__bin_0", cut("__tf", "__tt")), right.withColumn("__bin_1", cut("__from", "__to"))
        on += [F.col("__bin_0") == F.col("__bin_1"), F.col("__bin_0") == F.floor(F.greatest("__tf", "__from") / bin_width)]
    elif bin_width is None:
        right = right if hasattr(data, "_written_to") else written(right)
        classes = _Classes(left, right)
        if near:
            left, right = left.repartition(near, *keys), right.repartition(near, *[f"__k{n}" for n in range(len(keys))])
        if classes.level:
            left, right = classes.cut(left, 0, "__tf", "__tt"), classes.cut(right, 1, "__from", "__to")
            on += classes.meets()
    on += [F.col("__from") < F.col("__tt"), F.col("__to") > F.col("__tf")]
    # Spark's estimate of a side doesn't count what explode adds, here or before, so it would broadcast a grid of any size.
    return left.hint("merge").join(right, both(on)).drop(*[f"__{x}_{s}" for x in ("class", "level", "bin") for s in (0, 1)], *[f"__k{n}" for n in range(len(keys))])


def attached(target: DataFrame, got: DataFrame, keys: list[str], target_range, names: dict[str, str]) -> DataFrame:
    """target and, from got (one row for each keys, __tf, __tt), the columns names (got's: output); nulls where got has none."""
    g = got.select(*[F.col(c).alias(f"__k{n}") for n, c in enumerate(keys)], F.col("__tf"), F.col("__tt"), *[F.col(o).alias(f"__o{k}") for k, o in enumerate(names)])
    on = [F.col(c) == F.col(f"__k{n}") for n, c in enumerate(keys)] + [F.col(c).cast("double") == F.col(b) for c, b in zip(target_range, ("__tf", "__tt"))]
    return target.join(g.hint("merge"), both(on), "left").select(*target.columns, *[F.col(f"__o{k}").alias(n) for k, n in enumerate(names.values())])


@dataclass(frozen=True)
class Ranges:
    """A column that numbers ranges of a sort order, and how many there are."""

    column: Column
    count: int

    def dealt(self, df: DataFrame) -> DataFrame:
        """df with __range, ranges dealt over tasks in turn, so that none gets many more than another."""
        d = df.withColumn("__range", self.column)
        return d.repartitionById(min(self.count, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "__range")


def ranges_of(df: DataFrame, by: list[str], rows: int | None = None) -> Ranges:
    """Ranges of the sort order of `by` (nulls last), of about `rows` rows each, so that they grow in number with df.

    Cuts are quantiles of a sample of SAMPLES places a range, which Spark sorts; as with Spark's own
    ranges the sample passes the driver. A row finds its range by halving the list of cuts, the first
    DEEP times by branches. Rows equal in `by` share a range. It only tells how work is dealt: results do
    not depend on the cuts. df is read three times, and should be a written table where that is dear.
    """
    rows = rows or RANGE_ROWS
    total = df.count()
    n = math.ceil(total / rows)
    place = F.struct(*[x.alias(f"{a}{i}") for i, c in enumerate(by) for a, x in (("n", F.isnull(c)), ("v", F.col(c)))])
    key = df.select(place.alias("p"))
    sample = key.sample(min(1.0, SAMPLES * n / total), seed=1).orderBy("p").select(F.to_json("p")).collect() if n > 1 else []
    cuts = list(dict.fromkeys(r[0] for r in sample[SAMPLES // 2 :: SAMPLES]))
    kind = key.schema["p"].dataType

    def half(s: Column, _: Column) -> Column:
        middle = F.floor((s["a"] + s["z"]) / 2).cast("int")
        right = (s["a"] < s["z"]) & (F.get(s["cuts"], middle) <= s["p"])
        return F.struct(F.when(right, middle + 1).otherwise(s["a"]).alias("a"), F.when(right | (s["a"] >= s["z"]), s["z"]).otherwise(middle).alias("z"), s["p"].alias("p"), s["cuts"].alias("cuts"))

    def found(a: int, z: int, deep: int) -> Column:
        """How many of the cuts are at or before a place, a to z of them."""
        if a == z:
            return F.lit(a)
        if not deep:
            # One literal: many literal columns take seconds to plan.
            some = F.from_json(F.lit("[" + ",".join(cuts[a:z]) + "]"), T.ArrayType(kind))
            start = F.struct(F.lit(0).alias("a"), F.lit(z - a).alias("z"), place.alias("p"), some.alias("cuts"))
            return F.aggregate(F.sequence(F.lit(1), F.lit(math.ceil(math.log2(z - a + 1)) + 1)), start, half, lambda s: s["a"]) + a
        m = (a + z) // 2
        return F.when(F.from_json(F.lit(cuts[m]), kind) <= place, found(m + 1, z, deep - 1)).otherwise(found(a, m, deep - 1))

    return Ranges(found(0, len(cuts), DEEP), len(cuts) + 1)


def tasks_for(rows: int) -> int:
    """Tasks over which rows are dealt by group, so that what each of them sorts stays in memory."""
    return max(1, math.ceil(rows / TASK_ROWS))


def in_order(by: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in by]


def largest(df: DataFrame, within: list[str]) -> int:
    """Rows of the largest group."""
    return df.groupBy(*within).count().agg(F.max("count")).first()[0] or 0


def scanned(df: DataFrame, by: list[str], row: Column | None = None, lag: str | None = None, lead: str | None = None, breaks: dict[str, Callable[[Column, Column], Column]] | None = None, last: dict[str, Column] | None = None, tops: dict[str, Column] | None = None, within: list[str] | None = None, most: int | None = None, without: tuple[str, ...] = (), apart: bool = False) -> DataFrame:
    """df, scanned in the order of `by` (nulls last): no task holds a group, and no window more than a range.

    row is a struct of what neighbours need of a row; `lag` and `lead` name the previous and next row's
    (null at the ends). breaks: names and functions of (previous, own) row that say whether a new run
    begins; each gives the number of runs so far. last: the latest value that is not null, of this row
    or one before. tops: the greatest value of the rows before. Values must be such that a reader can
    tell to which group they belong (structs that hold it).
    Ranges are scanned on their own and written; what passes from one to the next, a row each, is
    scanned once more and joined. within: leading columns of `by` that nothing passes across (a run
    breaks there); if no such group has more rows than a range (`most`, or counted), groups are
    windows of their own, with the same result. without: columns that only `row` reads, which go.
    apart: runs need only differ within a group, so counts may start anew in each.
    """
    if within and (largest(df, within) if most is None else most) <= RANGE_ROWS:
        return _by_group(df, by, row, lag, lead, breaks or {}, last or {}, tops or {}, within, without, apart)
    breaks, last, tops = breaks or {}, last or {}, tops or {}
    # Counted, sampled and dealt: what df stands for is worked out once.
    df = once(df)
    w = W.partitionBy("__range").orderBy(*in_order(by))
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    d = ranges_of(df, by).dealt(df).withColumn("__row", row if row is not None else F.lit(True))
    d = d.withColumns({"__prev": F.lag("__row").over(w), "__next": F.lead("__row" if lead else F.lit(True)).over(w)} | {f"__last_{n}": F.last(c, True).over(upto) for n, c in last.items()} | {f"__top_{n}": F.max(c).over(before) for n, c in tops.items()} | {f"__all_{n}": F.max(c).over(upto) for n, c in tops.items()})
    flags = {f"__run_{n}": F.when(F.col("__prev").isNotNull() & F.coalesce(f(F.col("__prev"), F.col("__row")), F.lit(True)), 1).otherwise(0) for n, f in breaks.items()}
    if flags:
        d = d.withColumns(flags).withColumns({n: F.sum(n).over(upto) for n in flags})
    edge = {"__start": F.when(F.col("__prev").isNull(), F.col("__row")), "__end": F.when(F.col("__next").isNull(), F.col("__row"))}
    own = [*[f"__last_{n}" for n in last], *[f"__top_{n}" for n in tops], *flags]
    # What only the last row of a range tells the ranges after.
    tell = {f"__tell_{n}": F.when(F.col("__next").isNull(), F.col(f"__all_{n}")) for n in tops}
    own_columns = [c for c in df.columns if c not in without]
    x = written(d.select(*own_columns, "__range", *([F.col("__prev")] if lag else []), *([F.col("__next")] if lead else []), *own, *[v.alias(n) for n, v in (edge | tell).items()]))
    end = F.col("__end").isNotNull()
    s = x.where(F.col("__start").isNotNull() | end).groupBy("__range").agg(F.first("__start", True).alias("__start"), F.first("__end", True).alias("__end"), *[F.first(F.when(end, F.col(c)), True).alias(c) for c in [*[f"__last_{n}" for n in last], *flags]], *[F.first(c, True).alias(c) for c in tell])
    o = W.orderBy("__range")
    past = o.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumns({"__from": F.lag("__end").over(o), "__on": F.lead("__start").over(o)})
    s = s.withColumns({f"__first_{n}": F.when(F.col("__from").isNull() | F.coalesce(f(F.col("__from"), F.col("__start")), F.lit(True)), 1).otherwise(0) for n, f in breaks.items()})
    s = s.select(F.col("__range").alias("__r"), F.col("__from"), F.col("__on"), *[F.last(f"__last_{n}", True).over(past).alias(f"__l_{n}") for n in last], *[F.max(f"__tell_{n}").over(past).alias(f"__t_{n}") for n in tops],
                 *[(F.coalesce(F.sum(F.col(f"__first_{n}") + F.col(f"__run_{n}")).over(past), F.lit(0)) + F.col(f"__first_{n}")).alias(f"__n_{n}") for n in breaks])
    out = x.join(s, F.col("__range") == F.col("__r"))
    got = ([F.coalesce("__prev", "__from").alias(lag)] if lag else []) + ([F.coalesce("__next", "__on").alias(lead)] if lead else [])
    got += [F.coalesce(f"__last_{n}", f"__l_{n}").alias(n) for n in last] + [F.greatest(f"__top_{n}", f"__t_{n}").alias(n) for n in tops]
    got += [(F.col(f"__run_{n}") + F.col(f"__n_{n}")).alias(n) for n in breaks]
    return out.select(*own_columns, *got)


def _by_group(df: DataFrame, by, row, lag, lead, breaks, last, tops, within, without, apart) -> DataFrame:
    """scanned() with one window for each group."""
    w = W.partitionBy(*within).orderBy(*in_order(by))
    upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
    d = df.withColumn("__row", row if row is not None else F.lit(True))
    d = d.withColumns(({"__prev": F.lag("__row").over(w)} if lag or breaks else {}) | ({lead: F.lead("__row").over(w)} if lead else {}) | {n: F.last(c, True).over(upto) for n, c in last.items()} | {n: F.max(c).over(before) for n, c in tops.items()})
    got = [*[c for c in df.columns if c not in without], *([F.col("__prev").alias(lag)] if lag else []), *([lead] if lead else []), *last, *tops]
    if not breaks:
        return d.select(*got)
    d = d.withColumns({n: F.when(F.col("__prev").isNull() | F.coalesce(f(F.col("__prev"), F.col("__row")), F.lit(True)), 1).otherwise(0) for n, f in breaks.items()})
    x = d.select(*got, *[F.sum(n).over(upto).alias(n) for n in breaks])
    return x if apart else counted_on(written(x, near=True), within, list(breaks))


def counted_on(x: DataFrame, within: list[str], names: list[str]) -> DataFrame:
    """x, a written table whose counts `names` start at one in each group, with counts that go on from group to group in their order."""
    sizes = written(x.groupBy(*within).agg(*[F.max(n).alias(f"__n_{n}") for n in names]))
    start = running(sizes, within, {f"__s_{n}": F.col(f"__n_{n}") for n in names})
    # It has been written anew with its ranges.
    discard(sizes)
    start = start.select(*[F.col(c).alias(f"__w{i}") for i, c in enumerate(within)], *[f"__s_{n}" for n in names])
    out = x.join(start, both([F.col(c).eqNullSafe(F.col(f"__w{i}")) for i, c in enumerate(within)]))
    return out.select(*[c for c in x.columns if c not in names], *[(F.col(n) + F.col(f"__s_{n}")).alias(n) for n in names])


def running(df: DataFrame, by: list[str], sums: dict[str, Column], ranges: Ranges | Column | None = None, within: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """df and, for each of sums, its sum over the rows before in the order of `by` (distinct values, nulls last), in all or among rows equal in `within`.

    In two levels, so that no window holds more than a range: ranges are summed, their sums run, and rows run within their range.
    Where no group of `within` has more rows than a range (`most`, or counted), groups are windows of their own.
    """
    if within and ranges is None and (largest(df, list(within)) if most is None else most) <= RANGE_ROWS:
        w = W.partitionBy(*within).orderBy(*in_order(by)).rowsBetween(W.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(n) for n, v in sums.items()])
    if ranges is None:
        df = once(df)
        ranges = ranges_of(df, by)
    if isinstance(ranges, Ranges):
        # Finding ranges is dear: rows are numbered once, summed where they are and then dealt.
        x = written(df.withColumn("__range", ranges.column))
        d = Ranges(F.col("__range"), ranges.count).dealt(x)
    else:
        x = d = df.withColumn("__range", ranges)
    order = in_order(by)
    top = x.groupBy(*[F.col(c).alias(f"__w{i}") for i, c in enumerate(within)], F.col("__range").alias("__r")).agg(*[F.sum(v).alias(f"__s{k}") for k, v in enumerate(sums.values())])
    # One row for each range, or for each range of each value of `within`.
    own = [f"__w{i}" for i in range(len(within))]
    w = W.partitionBy(*own).orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    top = top.select(*own, "__r", *[F.coalesce(F.sum(f"__s{k}").over(w), F.lit(0)).alias(f"__a{k}") for k in range(len(sums))])
    w = W.partitionBy(*within, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    d = d.join(top, both([F.col("__range") == F.col("__r"), *[F.col(c).eqNullSafe(F.col(o)) for c, o in zip(within, own)]]))
    return d.select(*df.columns, *[(F.col(f"__a{k}") + F.coalesce(F.sum(v).over(w), F.lit(0))).alias(n) for k, (n, v) in enumerate(sums.items())])
