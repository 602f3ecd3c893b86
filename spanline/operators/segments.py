"""Discontinuity ids, splitting, overlay, cross-sections and checks."""
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.steps import linspace_steps, pieces
from ..tables import discard, once, passing, written
from . import ranges
from .ranges import attached, both, largest, overlaps, running, scanned

P3 = lambda c: F.round(F.col(c) * 1000)
MOST_LISTED, MEAN_LISTED = 1_000, 8.0


def _same(a: Column, b: Column, names: list[str]) -> Column:
    """Two structs agree in all fields of these names."""
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[n]) for n in names], F.lit(True))


def segment_ids(df: DataFrame, categories: list[str], measure_slk, measure_true=None, out: str = "segment_id") -> DataFrame:
    """A new id wherever a category, SLK (to 3 places) or true distance breaks; a null category breaks each row.

    Zero-based ids in the order of categories, start and end (nulls last). Rows are scanned by ranges of that
    order, so one category of all rows, or no category, is many tasks.
    """
    f, t = measure_slk
    by = list(dict.fromkeys([*categories, (measure_true or measure_slk)[0], f, t]))
    ends = {"f0": P3(f), "t0": P3(t)} | ({"f1": P3(measure_true[0]), "t1": P3(measure_true[1])} if measure_true else {})
    cats = [f"c{k}" for k in range(len(categories))]
    row = F.struct(*[F.col(c).alias(k) for k, c in zip(cats, categories)], *[v.alias(k) for k, v in ends.items()])

    def breaks(a: Column, b: Column) -> Column:
        goes_on = [a[k] == b[k] for k in cats] + [a["t0"] == b["f0"]] + ([a["t1"] == b["f1"]] if measure_true else [])
        return ~F.coalesce(both(goes_on), F.lit(False))

    d = scanned(df, by, row, breaks={"__id": breaks}, within=categories)
    return d.select(*df.columns, (F.col("__id") - 1).cast("long").alias(out))


def longest_overlap(new: DataFrame, source: DataFrame, keys: list[str], from_to, position: str, out: str = "source_position", bin_width: float | None = None) -> DataFrame:
    """For each new piece, the source position of the longest positive overlap (the first of equals), else null.

    It depends on a piece's keys and bounds alone; pieces and sources meet in bins (see ranges.overlaps).
    """
    new = once(new)
    pairs = overlaps(new, source, keys, from_to, from_to, {"__p": F.col(position)}, bin_width)
    over = F.least("__tt", "__to") - F.greatest("__tf", "__from")
    best = pairs.groupBy(*keys, "__tf", "__tt").agg(F.max_by("__p", F.struct(over, -F.col("__from"), -F.col("__p"))).alias("best"))
    return attached(new, best, keys, from_to, {"best": out})


def split_to_max_length(df: DataFrame, categories: list[str], measure_slk, measure_true, max_length: float, min_length: float = 0.0, index_col: str = "rid") -> DataFrame:
    """Segments without discontinuity cut at multiples of max_length; other columns from the source of longest true overlap."""
    if set(measure_slk) & set(measure_true):
        raise ValueError("measure_slk and measure_true must not share columns")
    (sf, st), (tf, tt) = measure_slk, measure_true
    d = df.where(both([F.col(c).isNotNull() for c in categories]))
    d = segment_ids(d, categories, measure_slk, measure_true, "segment_index")
    g = d.groupBy(*categories, "segment_index").agg(F.min(sf).alias("a"), F.max(st).alias("b"), F.min(tf).alias("c"), F.max(tt).alias("d"))
    by_slk = F.round(F.col("b") - F.col("a"), 6) == F.round(F.col("d") - F.col("c"), 6)
    lo, hi = F.when(by_slk, F.col("a")).otherwise(F.col("c")), F.when(by_slk, F.col("b")).otherwise(F.col("d"))
    g = g.withColumn("by_slk", by_slk).withColumn("p", F.explode(pieces(linspace_steps(lo, hi, max_length, min_length))))
    other = lambda x: F.bround(F.when(F.col("by_slk"), F.col("c") + (x - F.col("a")) / (F.col("b") - F.col("a")) * (F.col("d") - F.col("c"))).otherwise(F.col("a") + (x - F.col("c")) / (F.col("d") - F.col("c")) * (F.col("b") - F.col("a"))), 3)
    x = [F.col("p.a"), F.col("p.b")]
    n = g.select(*categories, "segment_index", *[F.when(F.col("by_slk"), v).otherwise(other(v)).alias(c) for v, c in zip(x, measure_slk)], *[F.when(F.col("by_slk"), other(v)).otherwise(v).alias(c) for v, c in zip(x, measure_true)])
    # Pieces and sources meet in bins of max_length, so that a long segment is no quadratic join; a source's columns come along.
    rest = [c for c in df.columns if c not in (*categories, sf, st, tf, tt)]
    cut = lambda a, b: F.sequence(F.floor(F.col(a) / max_length), F.greatest(F.floor(F.col(a) / max_length), F.ceil(F.col(b) / max_length) - 1))
    s = d.select(F.col("segment_index").alias("__g"), F.col(tf).alias("__f"), F.col(tt).alias("__t"), F.col(index_col).alias("__p"), F.struct(*rest).alias("__rest"), F.explode(cut(tf, tt)).alias("__sb"))
    on = (F.col("segment_index") == F.col("__g")) & (F.col("__b") == F.col("__sb")) & (F.col("__f") < F.col(tt)) & (F.col("__t") > F.col(tf))
    over = F.least(F.col(tt), F.col("__t")) - F.greatest(F.col(tf), F.col("__f"))
    n = n.withColumn("__b", F.explode_outer(cut(tf, tt))).join(s, on, "left").groupBy(*n.columns).agg(F.max_by("__rest", F.struct(over, -F.col("__f"), -F.col("__p"))).alias("__rest"))
    return n.select(*[c for c in n.columns if c != "__rest"], *[F.col("__rest")[c].alias(c) for c in rest])


def overlay(original: DataFrame, additional: DataFrame, categories: list[str], measure_slk, measure_true, name_original: str, name_additional: str, original_index: str = "rid", additional_index: str = "rid", relax_slk_checks: bool = False, check_rows: bool = False) -> DataFrame:
    """The union of both segmentations, split wherever either splits, with both source positions.

    check_rows refuses measures with missing, reversed or empty intervals and true measures that
    overlap or are out of order (six jobs); relax_slk_checks leaves out additional's SLK.
    """
    if name_original == name_additional:
        raise ValueError(f"both positions would be named {name_original}")
    if check_rows:
        # Three checks and the events read either side.
        original, additional = once(original), once(additional)
    for side, df, index in (("original", original, original_index), ("additional", additional, additional_index)):
        lacks = [c for c in (*categories, *measure_slk, *measure_true, index) if c not in df.columns]
        if lacks:
            raise ValueError(f"{side} lacks {', '.join(lacks)}")
        if check_rows:
            if side == "original" or not relax_slk_checks:
                check_linear_index(df, measure_slk)
            check_linear_index(df, measure_true)
            if not check_disjoint(df, measure_true, categories, index).first().ok:
                raise ValueError(f"{side}: {measure_true} overlaps or is out of order")

    def events(df, which, index):
        end = lambda k: F.struct(F.lit(k).alias("type"), F.col(measure_true[k]).cast("double").alias("tm"), F.col(measure_slk[k]).cast("double").alias("slk"))
        d = df.where(both([F.col(c).isNotNull() for c in categories]))
        return d.select(*categories, F.lit(which).alias("df"), F.col(index).cast("long").alias("pos"), F.explode(F.array(end(0), end(1))).alias("e")).select(*categories, "df", "pos", "e.*")

    e = events(original, 0, original_index).unionByName(events(additional, 1, additional_index)).withColumn("__o", F.when(F.col("type") == 0, F.col("df")).otherwise(-F.col("df")))
    e = written(e)
    cats = [f"c{k}" for k in range(len(categories))]
    own = [F.col(c).alias(k) for k, c in zip(cats, categories)]
    here = F.struct(*own)
    state = lambda k: F.when(F.col("df") == k, F.struct(*own, F.when(F.col("type") == 0, F.col("pos")).otherwise(-1).alias("at")))
    # The last known state of either side and the next event, whatever range they are in; each tells its category.
    e = scanned(e, [*categories, "tm", "pos", "type", "__o"], F.struct(*own, F.col("tm").alias("tm"), F.col("slk").alias("slk")), lead="__n", last={"__s0": state(0), "__s1": state(1)}, within=categories)
    e = e.where(_same(F.col("__n"), here, cats) & (F.col("__n.tm") > F.col("tm")) & (F.col("__n.slk") > F.col("slk")))
    at = lambda k: F.when(_same(F.col(f"__s{k}"), here, cats) & (F.col(f"__s{k}.at") >= 0), F.col(f"__s{k}.at"))
    (sf, st), (tf, tt) = measure_slk, measure_true
    e = e.withColumns({"__p0": at(0), "__p1": at(1)}).where("__p0 is not null or __p1 is not null")
    return e.select(*categories, F.col("slk").alias(sf), F.col("__n.slk").alias(st), F.col("tm").alias(tf), F.col("__n.tm").alias(tt), F.col("__p0").alias(name_original), F.col("__p1").alias(name_additional))


def _nodes(first: str, end: str) -> Column:
    """The aligned runs of 2^level numbers that make up first to end (excluded): at most two of each level."""
    level = f"sequence(0, cast(floor(log2({end} - {first})) as int))"
    a, z = f"shiftright({first} + shiftleft(1L, l) - 1, l)", f"shiftright({end}, l)"
    left, right = f"if({a} < {z} and {a} % 2 = 1, struct(l as level, {a} as node), null)", f"if({a} < {z} and {z} % 2 = 1, struct(l as level, {z} - 1 as node), null)"
    return F.expr(f"explode(filter(flatten(transform({level}, l -> array({left}, {right}))), x -> x is not null))")


def _changes(s: DataFrame, groups: list[str], cats: list[str]) -> DataFrame:
    """(groups, __i, __changed): whether the ordered paths at piece __i differ from those at the piece before, wherever a source starts or ends.

    s has a source's first and last piece (__i0, __i1) and its __key, a struct that starts with its start
    and its path. What starts comes after all that stays, so paths are the same if the same paths end
    and start (counted, without lists) and what ends are the last ones, in the same order. What stays
    after one that ended is found through aligned runs of pieces; only there what stays is compared.
    """
    side = F.explode(F.array(F.struct(F.col("__i0").alias("i"), F.lit(1).alias("side")), F.struct((F.col("__i1") + 1).alias("i"), F.lit(-1).alias("side")))).alias("__e")
    e = s.select(*groups, *cats, "__key", side).select(*groups, *cats, "__key", F.col("__e.i").alias("__i"), F.col("__e.side").alias("__side"))
    gone = F.col("__side") < 0
    m = e.groupBy(*groups, "__i", *cats).agg(F.sum("__side").alias("n"), F.min(F.when(gone, F.col("__key"))).alias("__first"), F.count_if(gone).alias("k"))
    m = written(m.groupBy(*groups, "__i").agg(F.max(F.col("n") != 0).alias("__changed"), F.min("__first").alias("__first"), F.sum("k").alias("__k")))
    same = m.where("not __changed")
    # Runs of 2^level pieces up to the longest source's: a piece lies in one of each level.
    deep = s.agg(F.max(F.col("__i1") - F.col("__i0"))).first()[0] or 0
    late = None
    if deep:
        runs = s.where("__i1 > __i0").select(*groups, "__key", _nodes("(__i0 + 1)", "(__i1 + 1)").alias("__n")).select(*groups, "__key", "__n.*")
        level = F.explode(F.sequence(F.lit(0), F.lit(deep.bit_length() - 1))).alias("level")
        at = same.select(*groups, "__i", "__first", level).withColumn("node", F.expr("shiftright(__i, level)"))
        last = runs.groupBy(*groups, "level", "node").agg(F.max("__key").alias("__late"))
        late = written(at.join(last, [*groups, "level", "node"]).where("__late > __first").select(*groups, "__i", "level", "node", "__first"))
    many, mixed = same.where("__k > 1").select(*groups, "__i"), late is not None and not late.isEmpty()
    if mixed:
        many = many.union(late.select(*groups, "__i")).distinct()
    rows = e.join(many, [*groups, "__i"]).select(*groups, "__i", "__side", "__key")
    if mixed:
        stays = late.join(runs, [*groups, "level", "node"]).where("__key > __first")
        rows = rows.union(stays.select(*groups, "__i", F.explode(F.array(F.lit(-1), F.lit(1))), "__key"))
    w = W.partitionBy(*groups, "__i", "__side").orderBy("__key")
    path = F.struct(*[F.col("__key")[f"c{k}"].alias(f"c{k}") for k in range(len(cats))])
    other = rows.select(*groups, "__i", F.row_number().over(w).alias("r"), path.alias("p")).groupBy(*groups, "__i", "r").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    other = other.where("a <> b").select(*groups, "__i").distinct().withColumn("__changed", F.lit(True))
    return m.where("__changed").select(*groups, "__i", "__changed").union(other)


def cross_sections(df: DataFrame, groups: list[str], cats: list[str], measure_slk, measure_true, number: str = "cross_section_number", original_index: str = "original_index", overlap: str = "overlap", index_col: str = "rid") -> DataFrame:
    """One row per section, active path and source; a section starts when the ordered active paths change (see _sections)."""
    d, e, most = _places(df, groups, cats, measure_slk, measure_true, index_col)
    listed, rows = _listed(e)
    if _small(groups, most) and listed and d.groupBy(*groups, *cats, F.col(index_col).cast("long")).count().where("count > 1").isEmpty():
        return _by_lists(d, e, rows, groups, cats, measure_slk, measure_true, number, original_index, overlap, index_col)
    s, sec = _sections(d, e, most, groups, cats, measure_true, number, index_col)
    return _sources(s, sec, groups, cats, measure_slk, measure_true, number, original_index, overlap)


def _at(x: DataFrame, place: str, to: DataFrame, by: str, names: dict[str, str], groups: list[str]) -> DataFrame:
    """x with columns of the one row of `to` of the same group and place."""
    y = to.select(*[F.col(c).alias(f"__k{n}") for n, c in enumerate(groups)], F.col(by).alias("__p"), *[F.col(c).alias(n) for n, c in names.items()])
    return x.join(y, both([F.col(c) == F.col(f"__k{n}") for n, c in enumerate(groups)] + [F.col(place) == F.col("__p")])).drop("__p", *[f"__k{n}" for n in range(len(groups))])


def _bounds(measure_slk, measure_true) -> list[Column]:
    """The bounds of a section, over its pieces."""
    (sf, st), (tf, tt) = measure_slk, measure_true
    return [F.min("__as").alias(sf), F.max("__bs").alias(st), F.min("__a").alias(tf), F.max("__b").alias(tt)]


def _sources(s: DataFrame, sec: DataFrame, groups: list[str], cats: list[str], measure_slk, measure_true, number: str, original_index: str, overlap: str) -> DataFrame:
    """One row per section, path and source, from sources and numbered pieces (see _sections)."""
    (sf, st), (tf, tt) = measure_slk, measure_true
    ext = sec.groupBy(number).agg(*_bounds(measure_slk, measure_true), F.min("__gap").alias("__ga"), F.max("__gap").alias("__gb"))
    rows = _at(_at(s, "__i0", sec, "__i", {"__n0": number, "__a0": "__a", "__g0": "__gap"}, groups), "__i1", sec, "__i", {"__n1": number, "__b1": "__b", "__g1": "__gap"}, groups)
    rows = rows.select("*", F.explode(F.sequence("__n0", "__n1")).alias(number)).join(ext, number)
    # Less what lies between pieces and is none.
    over = F.least("__b1", F.col(tt)) - F.greatest("__a0", F.col(tf)) - (F.least("__g1", "__gb") - F.greatest("__g0", "__ga"))
    own = [*groups, number, sf, st, tf, tt, *cats, F.col("__key.o").alias(original_index)]
    # Only sources that share a path and an index add up; else each is a row of a section already.
    if s.groupBy(*groups, *cats, "__key.o").count().where("count > 1").isEmpty():
        return rows.select(*own, over.alias(overlap))
    return rows.groupBy(*own).agg(F.sum(over).alias(overlap))


def _small(groups: list[str], most: int) -> bool:
    """Whether groups, of `most` bounds at most, are windows of their own."""
    return bool(groups) and most <= ranges.RANGE_ROWS


def _listed(e: DataFrame) -> tuple[bool, int]:
    """Whether pieces have few sources, MOST_LISTED at most and MEAN_LISTED on average; and how many in all."""
    listed = e.where("__piece").agg(F.max("__active").alias("most"), F.avg("__active").alias("mean"), F.sum("__active").alias("all")).first()
    return (listed.most or 0) <= MOST_LISTED and (listed.mean or 0) <= MEAN_LISTED, listed["all"] or 0


def _ends(measure_true) -> tuple[Column, Column, Column]:
    """A row's bounds and whether it is a source."""
    f, t = (F.col(c).cast("double") for c in measure_true)
    return f, t, F.coalesce((f < t) & ~F.isnan(t), F.lit(False))


def _places(df: DataFrame, groups: list[str], cats: list[str], measure_slk, measure_true, index_col: str) -> tuple[DataFrame, DataFrame, int]:
    """Rows that count, the bounds of each group with the piece up to the next one, and how many bounds a group has at most.

    Pieces between neighbouring bounds of a group where SLK goes on and a source is active are numbered (__i) by
    scans of the bounds, so a hot group is many tasks. Rows with a null group or path are left out; empty,
    reversed, null and NaN intervals are no sources, but their bounds cut.
    """
    (sf, st), (tf, tt) = measure_slk, measure_true
    with passing() as kept:
        d = df.where(both([F.col(c).isNotNull() for c in [*groups, *cats]]))
        # Bounds and sources read it.
        d = kept(written(d.select(*dict.fromkeys([*groups, *cats, sf, st, tf, tt, index_col]))))
        most = 2 * largest(d, groups)
        # Scans by ranges read their rows twice; small groups are dealt once, and what follows needs no shuffle.
        stays, near = (lambda x: x, lambda x: x.repartition(*groups)) if _small(groups, most) else (written, lambda x: x)
        f, t, real = _ends(measure_true)
        ev = lambda x, s, k: F.struct(x.alias("t"), F.lit(k).alias("k"), F.col(s).alias("s"))
        # A source ends before another starts at one place; of events at one place the last one's SLK stands.
        e = near(d).select(*groups, real.alias("__real"), F.explode(F.array(ev(f, sf, 1), ev(t, st, 0))).alias("e")).groupBy(*groups, F.col("e.t").alias("__a"))
        e = e.agg(F.max(F.struct("e.k", "e.s")).alias("x"), F.min(F.struct("e.k", "e.s")).alias("y"), F.sum(F.when(F.col("__real"), 2 * F.col("e.k") - 1).otherwise(0)).alias("__d"))
        g = [f"g{k}" for k in range(len(groups))]
        own = [F.col(c).alias(k) for k, c in zip(g, groups)]
        order = [*groups, "__a"]
        e = scanned(stays(e), order, F.struct(*own, F.col("__a").alias("t"), F.col("y.s").alias("s")), lead="__n", within=groups, most=most)
        e = running(stays(e), order, {"__before": F.col("__d")}, within=tuple(groups), most=most)
        same, width = F.coalesce(_same(F.col("__n"), F.struct(*own), g) & F.col("__n").isNotNull(), F.lit(False)), F.col("__n.t") - F.col("__a")
        on = F.coalesce(same & (width > 0) & ~F.isnan("__n.t") & (F.col("__n.s") > F.col("x.s")) & (F.col("__before") + F.col("__d") > 0), F.lit(False))
        e = e.select(*groups, "__a", F.col("__n.t").alias("__b"), F.col("x.s").alias("__as"), F.col("__n.s").alias("__bs"), (F.col("__before") + F.col("__d")).alias("__active"), on.alias("__piece"), F.when(same & ~on & (F.abs(width) < float("inf")), width).otherwise(0.0).alias("__w"))
        e = kept(written(running(stays(e), order, {"__i": F.col("__piece").cast("long"), "__gap": F.col("__w")}, within=tuple(groups), most=most)))
    return d, e, most


def _spans(d: DataFrame, e: DataFrame, groups: list[str], cats: list[str], measure_true, index_col: str) -> DataFrame:
    """Sources with their __key and their first and last piece (__i0, __i1)."""
    f, t, real = _ends(measure_true)
    key = F.struct(f.alias("f"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(cats)], F.col(index_col).cast("long").alias("o"))
    s = d.where(real).select(*groups, *cats, f.alias("__f"), t.alias("__t"), key.alias("__key"))
    s = _at(_at(s, "__f", e, "__a", {"__i0": "__i"}, groups), "__t", e, "__a", {"__i1": "__i"}, groups)
    return s.select(*groups, *cats, "__key", "__i0", (F.col("__i1") - 1).alias("__i1")).where("__i0 <= __i1")


def _by_lists(d: DataFrame, e: DataFrame, rows: int, groups: list[str], cats: list[str], measure_slk, measure_true, number: str, original_index: str, overlap: str, index_col: str) -> DataFrame:
    """One row per section, path and source, where groups are small, pieces have few sources and no two sources share path and index.

    Sources and pieces are dealt by group, over tasks that grow in number with the `rows` the lists hold, and all that follows stays there: a piece's sources are a list,
    pieces of equal paths are a section, and its sources are what the lists hold.
    """
    near = lambda x: x.repartition(ranges.tasks_for(rows), *groups)
    paths = F.transform("__own", lambda x: F.struct(*[x[f"c{k}"] for k in range(len(cats))]))
    s = _spans(near(d), near(e), groups, cats, measure_true, index_col)
    s = s.select(*groups, "__key", F.explode(F.sequence("__i0", "__i1")).alias("__i")).groupBy(*groups, "__i").agg(F.array_sort(F.collect_list("__key")).alias("__own"))
    x = near(e.where("__piece").select(*groups, "__i", "__a", "__b", "__as", "__bs", "__gap")).join(s, [*groups, "__i"])
    w = W.partitionBy(*groups).orderBy("__i")
    x = x.withColumn("__p", paths).withColumn("__p", F.when(F.lag("__p").over(w).eqNullSafe(F.col("__p")), 0).otherwise(1))
    x = x.withColumn(number, F.sum("__p").over(w.rowsBetween(W.unboundedPreceding, 0)))
    bounds = [*measure_slk, *measure_true]
    whole = W.partitionBy(*groups, number)
    x = x.select(*groups, number, *[b.over(whole).alias(c) for b, c in zip([F.min("__as"), F.max("__bs"), F.min("__a"), F.max("__b")], bounds)], "__a", "__b", "__gap", F.explode("__own").alias("__key"))
    path = [F.col(f"__key.c{k}").alias(c) for k, c in enumerate(cats)]
    # Less what lies between pieces and is none.
    over = F.max("__b") - F.min("__a") - (F.max("__gap") - F.min("__gap"))
    x = x.groupBy(*groups, number, *bounds, *path, F.col("__key.o").alias(original_index)).agg(over.alias(overlap))
    x = written(x, near=True)
    discard(d, e)
    out = ranges.counted_on(x, groups, [number])
    return out.select(*[(F.col(c) - 1).cast("long").alias(c) if c == number else c for c in x.columns])


def _sections(d: DataFrame, e: DataFrame, most: int, groups: list[str], cats: list[str], measure_true, number: str, index_col: str) -> tuple[DataFrame, DataFrame]:
    """Sources with their first and last piece (__i0, __i1), and the pieces with their section's number, from _places.

    A source is its first and last piece, and meets the sections between its own first and last. Where pieces have
    few sources (see _listed), neighbouring pieces compare lists of theirs. Else, with the same result, sections come from what starts and
    ends at a piece (see _changes), so work grows with bounds and output; only where sources of one path overlap while
    the paths stay the same are the sources there compared for each bound.
    """
    small = _small(groups, most)
    stays, near = (lambda x: x, lambda x: x.repartition(*groups)) if small else (written, lambda x: x)
    g = [f"g{k}" for k in range(len(groups))]
    own = [F.col(c).alias(k) for k, c in zip(g, groups)]
    with passing() as kept:
        s = kept(written(_spans(near(d), near(e), groups, cats, measure_true, index_col), near=small))
        if _listed(e)[0]:
            paths = F.transform(F.array_sort(F.collect_list("__key")), lambda x: F.struct(*[x[f"c{k}"] for k in range(len(cats))]))
            state = near(s).select(*groups, "__key", F.explode(F.sequence("__i0", "__i1")).alias("__i")).groupBy(*groups, "__i").agg(paths.alias("__state"))
            breaks = lambda p, q: ~_same(p, q, [*g, "state"])
        else:
            state = _changes(s, groups, cats).withColumnRenamed("__changed", "__state")
            breaks = lambda p, q: ~_same(p, q, g) | F.coalesce(q["state"], F.lit(False))
        sec = near(e.where("__piece").drop("__piece", "__active", "__w")).join(state, [*groups, "__i"], "left")
        sec = scanned(stays(sec), [*groups, "__i"], F.struct(*own, F.col("__state").alias("state")), breaks={"__k": breaks}, within=groups, most=most, without=("__state",))
        sec = kept(written(sec.withColumn(number, (F.col("__k") - 1).cast("long"))))
    discard(d, e)
    return s, sec


def cross_sections_normalised(df: DataFrame, groups: list[str], cats: list[str], measure_slk, measure_true, number: str = "cross_section_number", original_index: str = "original_index", overlap: str = "overlap", index_col: str = "rid") -> tuple[DataFrame, DataFrame]:
    """(one row per section, one row per section and source). Every section has a source, so the first comes from its pieces alone."""
    d, e, most = _places(df, groups, cats, measure_slk, measure_true, index_col)
    s, sec = _sections(d, e, most, groups, cats, measure_true, number, index_col)
    out = _sources(s, sec, groups, cats, measure_slk, measure_true, number, original_index, overlap)
    return sec.groupBy(*groups, number).agg(*_bounds(measure_slk, measure_true)), out.select(number, *[c for c in out.columns if c not in (*groups, number, *measure_slk, *measure_true)])


def _ordered(df: DataFrame, categories: list[str], measure, order: str, top: bool = False) -> tuple[DataFrame, Column]:
    """The bounds of each row with the previous row's (and the greatest end before) in __p (and __m), and whether that is of the same category."""
    cats = [f"c{k}" for k in range(len(categories))]
    d = df.select(*[F.col(c).alias(k) for k, c in zip(cats, categories)], F.col(measure[0]).alias("f"), F.col(measure[1]).alias("t"), F.col(order).alias("o"))
    place = F.struct(*[x.alias(f"{n}{k}") for k in range(len(cats)) for n, x in (("n", F.isnull(f"c{k}")), ("v", F.col(f"c{k}")))], F.col("t").alias("t"))
    d = scanned(d, [*cats, "o"], F.struct(*cats, "f", "t"), lag="__p", tops={"__m": place} if top else None, within=cats)
    return d, F.coalesce(_same(F.col("__p"), F.struct(*cats), cats), F.lit(False)) & F.col("__p").isNotNull()


def check_monotonic(df: DataFrame, categories: list[str], measure, order: str) -> DataFrame:
    """(ok): each start at or after the previous end in the given order; the first of a category compares with 0.

    Rows are compared by ranges of the order, so a hot category is many tasks.
    """
    d, same = _ordered(df, categories, measure, order)
    return d.select((F.when(same, F.col("__p.t")).otherwise(0) <= F.col("f")).alias("x")).agg(F.coalesce(F.bool_and("x"), F.lit(True)).alias("ok"))


def check_no_reversed(df: DataFrame, measure) -> DataFrame:
    return df.agg(F.coalesce(F.bool_and(F.col(measure[0]) <= F.col(measure[1])), F.lit(True)).alias("ok"))


def linear_index_faults(df: DataFrame, measure) -> DataFrame:
    """(n_missing, n_reversed, n_zero) of a two-column measure."""
    if len(measure) != 2:
        raise ValueError("a linear index has two columns")
    for c in measure:
        if not isinstance(df.schema[c].dataType, T.NumericType):
            raise TypeError(f"{c} must be numeric")
    f, t = (F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in measure)
    return df.agg(F.count_if(f.isNull() | t.isNull()).alias("n_missing"), F.count_if(f > t).alias("n_reversed"), F.count_if(f == t).alias("n_zero"))


def check_linear_index(df: DataFrame, measure) -> None:
    r = linear_index_faults(df, measure).first()
    for n, what in ((r.n_missing, "missing values"), (r.n_reversed, "reversed segments"), (r.n_zero, "segments of zero length")):
        if n:
            raise ValueError(f"{measure} has {what}")


def check_disjoint(df: DataFrame, measure, categories: list[str], order: str) -> DataFrame:
    """(ok): both bounds rise in the given order and no segment starts before an earlier one ends.

    Rows are compared by ranges of the order; the greatest end so far passes from one to the next.
    """
    d, same = _ordered(df, categories, measure, order, True)
    # Categories come in order, so the greatest (category, end) before a row is of its own category if any is.
    ok = (F.col("f") >= F.col("__p.f")) & (F.col("t") >= F.col("__p.t")) & (F.col("f") >= F.col("__m.t"))
    return d.select(F.coalesce(~same | ok, F.lit(True)).alias("x")).agg(F.coalesce(F.bool_and("x"), F.lit(True)).alias("ok"))
