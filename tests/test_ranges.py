"""Groups larger than a range, length classes and percentiles against brute force and against one window a group."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanline import tables
from spanline.operators import homogeneous, ranges, reshape, segments
from spanline.operators.aggregations import Action, Aggregation as A
from spanline.operators.merge import on_slk_intervals


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 29)


def rows(df):
    return sorted((tuple((x is None, x if x is not None else 0) for x in r) for r in df.collect()))


def both_ways(monkeypatch, make):
    one = rows(make())
    monkeypatch.setattr(ranges, "RANGE_ROWS", 29)
    assert rows(make()) == one
    return one


def test_ranges_are_a_monotone_numbering(spark, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE_ROWS", 9)
    d = spark.createDataFrame([(None if k % 11 == 0 else k % 5, (k * 37) % 101) for k in range(900)], "a int, b int")
    r = ranges.ranges_of(d, ["a", "b"])
    assert 40 < r.count <= 101
    got = d.withColumn("r", r.column).collect()
    at = {}
    for x in got:
        at.setdefault((x.a is None, x.a or 0, x.b), set()).add(x.r)
    assert all(len(v) == 1 for v in at.values())
    numbers = [min(at[k]) for k in sorted(at)]
    assert numbers == sorted(numbers) and set(numbers) <= set(range(r.count)) and len(set(numbers)) > 40


def test_scan_equals_windows(spark, small):
    rng = random.Random(1)
    d = spark.createDataFrame([(k, rng.choice([1, 2, 3, 3, 3, None]), rng.choice([None, None, k])) for k in range(400)], "k int, g int, v int")
    got = ranges.scanned(d, ["k"], F.struct("k"), lag="p", lead="n", breaks={"runs": lambda a, b: b["k"] % 10 == 0}, last={"v2": F.col("v")}, tops={"m": F.col("v")})
    w = W.orderBy("k")
    want = d.select("*", F.lag(F.struct("k")).over(w), F.lead(F.struct("k")).over(w), F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.max("v").over(w.rowsBetween(W.unboundedPreceding, -1)), (F.floor(F.col("k") / 10) + 1))
    assert rows(got) == rows(want)


def test_ids_of_hot_and_of_no_category(spark, monkeypatch):
    rng = random.Random(2)
    data, at = [], 0.0
    for k in range(300):
        at += rng.choice([0, 0, 0, 0.5])
        data.append((rng.choice(["a", "a", "b"]) if k % 17 else None, at, at + 1, at * 2, at * 2 + rng.choice([2, 2, 3])))
        at += 1
    d = spark.createDataFrame(data, "c string, sf double, st double, f double, t double")
    for cats in ([], ["c"]):
        ids = both_ways(monkeypatch, lambda: segments.segment_ids(d, cats, ("sf", "st"), ("f", "t")))  # noqa: B023
        monkeypatch.undo()
        order = sorted(data, key=lambda r: (((r[0] is None, r[0] or "") if cats else ()), r[3]))
        want, n = [], -1
        for p, r in zip([None, *order], order):
            goes_on = p is not None and (not cats or p[0] is not None and p[0] == r[0]) and round(p[2], 3) == round(r[1], 3) and round(p[4], 3) == round(r[3], 3)
            n += not goes_on
            want.append((*r, n))
        assert ids == sorted(tuple((x is None, x if x is not None else 0) for x in r) for r in want)


def intervals(spark, seed, n=160):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        a = rng.randint(0, 400)
        out.append((k, rng.choice(["r", "r", "r", "s"]), rng.choice(["L", "R", "M"]), float(a), float(a + rng.randint(1, 60))))
    return spark.createDataFrame(out, "rid long, g string, x string, f double, t double").selectExpr("*", "f as sf", "t as st")


def test_cross_sections_of_a_hot_road(spark, monkeypatch):
    d = intervals(spark, 3)
    assert len(both_ways(monkeypatch, lambda: segments.cross_sections(d, ["g"], ["x"], ("sf", "st"), ("f", "t")))) > 300


@pytest.mark.parametrize("cats", [["g"], []])
def test_overlay_of_a_hot_road(spark, monkeypatch, cats):
    side = lambda seed: spark.createDataFrame([(k, g, float(a), float(b)) for g in (("r", "s") if cats else ("r",)) for k, (a, b) in enumerate(cut(seed + len(g)))], "rid long, g string, f double, t double").selectExpr("*", "f as sf", "t as st")
    o, a = side(1), side(2)
    got = both_ways(monkeypatch, lambda: segments.overlay(o, a, cats, ("sf", "st"), ("f", "t"), "o", "a", check_rows=True))
    assert len(got) > 100
    bad = a.withColumn("sf", F.col("st"))
    with pytest.raises(ValueError, match="zero length"):
        segments.overlay(o, bad, cats, ("sf", "st"), ("f", "t"), "o", "a", check_rows=True)
    assert segments.overlay(o, bad, cats, ("sf", "st"), ("f", "t"), "o", "a", check_rows=True, relax_slk_checks=True).columns == [*cats, "sf", "st", "f", "t", "o", "a"]
    with pytest.raises(ValueError, match="out of order"):
        segments.overlay(o, a.withColumn("t", F.col("t") + 50), cats, ("sf", "st"), ("f", "t"), "o", "a", check_rows=True)


def cut(seed):
    rng, at, out = random.Random(seed), 0, []
    for _ in range(90):
        at += rng.choice([0, 0, 3])
        out.append((at, at + rng.randint(1, 9)))
        at = out[-1][1]
    return out


def test_checks_of_a_hot_road(spark, small):
    good = spark.createDataFrame([(k, "a", float(k), k + 1.0) for k in range(200)], "k int, c string, f double, t double")
    late = good.withColumn("t", F.when(F.col("k") == 3, 150.0).otherwise(F.col("t")))
    for cats in ([], ["c"]):
        ok = lambda f, d: f(d).first().ok
        mono, disjoint = (lambda d: segments.check_monotonic(d, cats, ("f", "t"), "k")), (lambda d: segments.check_disjoint(d, ("f", "t"), cats, "k"))  # noqa: B023
        assert ok(mono, good) and ok(disjoint, good)
        assert not ok(mono, late) and not ok(disjoint, late)
        # The overlap is not with the row before.
        jump = good.where("k <> 4").withColumn("t", F.when(F.col("k") == 3, 5.5).otherwise(F.col("t")))
        assert not ok(disjoint, jump)


def test_bisection_statistics_of_a_hot_group(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(m, 0.5, 60) for m in (3, 9, 5)]) + 1e6
    d = spark.createDataFrame([(k % 2 if k < 100 else 0, k, float(x), float(x) ** 0.5, 0.01) for k, x in enumerate(v)], "g int, k int, v double, w double, len double")
    for f in (homogeneous.cumulative_q, homogeneous.cumulative_p):
        for groups in (["g"], []):
            one = {r.k: r.x for r in f(d, groups, "k", "v", "x").collect()}
            with monkeypatch.context() as m:
                m.setattr(ranges, "RANGE_ROWS", 29)
                hot = {r.k: r.x for r in f(d, groups, "k", "v", "x").collect()}
            assert one.keys() == hot.keys() and all((one[k] is None) == (hot[k] is None) and (one[k] is None or abs(one[k] - hot[k]) < 1e-9 * max(1, abs(one[k]))) for k in one)
            if not groups:
                direct = homogeneous._statistic(v, f.__name__[-1])
                assert all(np.isnan(direct[k]) if one[k] is None else abs(direct[k] - one[k]) < 1e-9 for k in one)
                # Values far from zero lose nothing: the same without the million.
                if f is homogeneous.cumulative_q:
                    assert np.allclose(direct, homogeneous._statistic(v - 1e6, "q"), atol=1e-7)
    for kind in "qp":
        ids = lambda: sorted(r.k for r in homogeneous.best_bisection(d, ["g"], "k", ["v", "w"], "len", 0.05, kind=kind).collect())  # noqa: E731,B023
        one = ids()
        with monkeypatch.context() as m:
            m.setattr(ranges, "RANGE_ROWS", 29)
            assert ids() == one and len(one) == 2


INF = math.inf


def mixed(seed, n):
    rng = random.Random(seed)
    out = [(-INF, INF), (5.0, INF), (-INF, 3.0), (0.0, 1e12), (1e-9, 2e-9), (0.0, 1e-300), (7.0, 7.0), (9.0, 2.0), (float("nan"), 1.0), (1.0, float("nan")), (None, 4.0), (-1e300, 1e300)]
    for _ in range(n):
        a = rng.choice([rng.uniform(-50, 50), float(rng.randint(-5, 40))])
        out.append((a, a + rng.choice([0.001, 0.5, 1, 4, 16, 64, 1000]) * rng.uniform(0.5, 2)))
    return out


@pytest.mark.parametrize("width", [None, 0])
def test_overlaps_of_mixed_lengths(spark, width):
    t, d = mixed(1, 150), mixed(2, 200)
    group = lambda k: "ab"[k % 4 == 0]
    left = spark.createDataFrame([(group(k), a, b) for k, (a, b) in enumerate(t)], "g string, f double, t double")
    right = spark.createDataFrame([(k, group(k), a, b) for k, (a, b) in enumerate(d)], "k int, g string, f double, t double")
    got = sorted((r.g, r["__tf"], r["__tt"], r.k) for r in ranges.overlaps(left, right, ["g"], ("f", "t"), ("f", "t"), {"k": F.col("k")}, width).collect())
    good = lambda x: x[0] is not None and x[1] is not None and x[0] < x[1]
    want = sorted({(group(p), a, b, k) for p, (a, b) in enumerate(t) if good((a, b)) for k, (x, y) in enumerate(d) if good((x, y)) and group(p) == group(k) and a < y and x < b})
    assert got == want


def test_one_long_row_does_not_widen_bins(spark):
    """20,000 short rows on each side and one of 10^12: rows that share a bin stay near the number of pairs."""
    t = spark.range(20_000).selectExpr("id * 10.0d as f", "id * 10.0d + 10 as t")
    d = t.union(spark.createDataFrame([(0.0, 1e12)], "f double, t double")).selectExpr("f + 3 as f", "t + 3 as t")
    left, right = t.selectExpr("f as __tf", "t as __tt"), d.selectExpr("f as __from", "t as __to")
    c = ranges._Classes(left, right)
    a, b = c.cut(left, 0, "__tf", "__tt"), c.cut(right, 1, "__from", "__to")
    met = a.join(b, [F.col("__level_0") == F.col("__level_1"), F.col("__bin_0") == F.col("__bin_1")]).count()
    pairs = ranges.overlaps(t, d, [], ("f", "t"), ("f", "t"), {}).count()
    assert pairs == 39_999 + 20_000 and met < 8 * pairs


@pytest.mark.parametrize("p", [0.0, 0.1, 0.75])
def test_percentiles_of_large_targets(spark, monkeypatch, p):
    rng = random.Random(6)
    data = [(k, "r", (a := rng.uniform(0, 90)), a + rng.uniform(0.1, 9), rng.choice([None, rng.randint(1, 9), 2.5])) for k in range(250)]
    d = spark.createDataFrame([(k, g, a, b, None if v is None else float(v)) for k, g, a, b, v in data], "i int, r string, f double, t double, v double")
    t = spark.createDataFrame([("r", 0.0, 100.0), ("r", 10.0, 11.0), ("r", 200.0, 300.0), ("s", 0.0, 5.0)], "r string, f double, t double")
    run = lambda: {(r.r, r.f): (r.v, r.n) for r in on_slk_intervals(t, d, ["r"], [Action("v", A.LengthWeightedPercentile(p)), Action("v", A.Average(), "n")], ("f", "t"), "i").collect()}
    one = run()
    monkeypatch.setattr(ranges, "RANGE_ROWS", 29)
    hot = run()
    for a, b in ((0.0, 100.0), (10.0, 11.0)):
        x = sorted((v, y, k, min(b, y) - max(a, z)) for k, _, z, y, v in data if v is not None and z < b and y > a)
        w = np.array([r[3] for r in x])
        at = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2)])
        want = np.interp(p * at[-1], at, [r[0] for r in x])
        assert abs(one["r", a][0] - want) < 1e-9 and abs(hot["r", a][0] - want) < 1e-9 and one["r", a][1] == hot["r", a][1]
    assert one["r", 200.0] == hot["r", 200.0] == one["s", 0.0] == (None, None)


def test_no_join_broadcasts_what_an_explode_has_grown(spark):
    # One small row before the cut: Spark takes the grid for small, too.
    t = spark.range(1).select("id", F.explode(F.sequence(F.lit(0), F.lit(50_000))).alias("f")).select(F.col("id").alias("g"), "f", (F.col("f") + 1).alias("t"))
    g = spark.range(2_000).selectExpr("id div 5000 as g", "id * 10 as f", "id * 10 + 3 as t", "id as v")
    for width in (None, 100.0, 0):
        d = on_slk_intervals(t, g.where("f < 500") if width == 0 else g, ["g"], [Action("v", A.Sum(), "s")], ("f", "t"), bin_width=width)
        assert d.count() == 50_001
        assert "BroadcastHashJoin" not in d._jdf.queryExecution().optimizedPlan().toString() and "BroadcastExchange" not in d._jdf.queryExecution().executedPlan().toString()


def test_a_long_row_is_no_list_as_long_as_the_table(spark):
    n = 40_000
    one = spark.createDataFrame([(0.0, 1e9)], "__tf double, __tt double")
    many = spark.range(n).selectExpr("id * 20000.0D as __from", "id * 20000.0D + 1 as __to")
    c = ranges._Classes(one, many)
    assert c.cut(one, 0, "__tf", "__tt").count() <= n / 100
    got = ranges.overlaps(one, many, [], ("__tf", "__tt"), ("__from", "__to"), {})
    assert got.count() == n


def test_a_grid_is_cut_in_many_tasks(spark, tmp_path):
    from spanline.plans import views

    spark.range(4_000).selectExpr("id % 40 as l_suppkey", "'A' as l_returnflag", "'F' as l_linestatus", "double(1 + id % 50) as l_quantity", "double(id) as l_extendedprice", "id as l_orderkey", "1 as l_linenumber", "id as l_partkey", "0D as l_discount", "0D as l_tax", "date'2020-01-01' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    d = views.grid(spark, str(tmp_path), 100.0)
    assert d.count() == d.distinct().count() > 900
    assert d.select(F.spark_partition_id()).distinct().count() == 4


def test_a_grid_sorts_no_observations(spark, tmp_path):
    """Roads' ends are sums where quantities are whole; else, as before, the greatest end of the observations."""
    from spanline.plans import views

    for name, qty in (("whole", "double(1 + id % 50)"), ("parts", "0.1D * (1 + id % 7)"), ("negative", "double(id % 5 - 3)")):
        d = f"{tmp_path}/{name}"
        spark.range(400).selectExpr("id % 4 as l_suppkey", "'A' as l_returnflag", "'F' as l_linestatus", f"{qty} as l_quantity", "double(id) as l_extendedprice", "id as l_orderkey", "1 as l_linenumber", "id as l_partkey", "0D as l_discount", "0D as l_tax", "date'2020-01-01' as l_shipdate").write.parquet(f"{d}/lineitem.parquet")
        got, plan = views.ends(spark, d), views.grid(spark, d, 100.0)._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, views.obs(spark, d).groupBy("road").agg(F.max("t")).collect()))
        assert ("Window" in plan) == (name != "whole")


def test_sides_of_a_checked_overlay_are_worked_out_once(spark, monkeypatch):
    seen, real = [], segments.check_disjoint
    monkeypatch.setattr(segments, "check_disjoint", lambda df, *a: (seen.append(df), real(df, *a))[1])
    d = spark.range(10).select(F.lit("R").alias("road"), F.col("id").alias("rid"), (F.col("id") * 10.0).alias("f"), (F.col("id") * 10.0 + 10).alias("t")).withColumns({"sf": F.col("f"), "s": F.col("t")})
    assert segments.overlay(d, d, ["road"], ("sf", "s"), ("f", "t"), "o", "n", check_rows=True).where("o = n").count() == 10
    assert len(seen) == 2 and all(hasattr(x, "_written_to") for x in seen)


def test_scans_by_ranges_work_out_their_rows_once(spark, monkeypatch):
    """A scan counts, samples and deals its rows: what it reads is a written table, which is not written again."""
    seen, real = [], ranges.ranges_of
    monkeypatch.setattr(ranges, "RANGE_ROWS", 50)
    monkeypatch.setattr(ranges, "ranges_of", lambda df, by, rows=None: (seen.append(getattr(df, "_written_to", None)), real(df, by, rows))[1])
    d = spark.range(300).select("id", F.col("id").cast("double").alias("f"), (F.col("id") + 1.0).alias("t"))
    assert segments.check_monotonic(d, [], ("f", "t"), "id").first().ok
    kept = ranges.written(d)
    assert ranges.running(kept, ["id"], {"s": F.lit(1)}).where("s = id").count() == 300
    assert len(seen) == 2 and seen[0] and seen[1] == kept._written_to


def test_sides_of_a_range_join_are_worked_out_once(spark, monkeypatch):
    """Both sides are counted by class and then joined, and targets are given back: what is read twice is a written table."""
    seen, real = [], ranges._Classes.__init__
    monkeypatch.setattr(ranges._Classes, "__init__", lambda self, left, right: (seen.extend([left, right]), real(self, left, right))[1])
    t = spark.range(20).select(F.lit("R").alias("road"), (F.col("id") * 10.0).alias("f"), (F.col("id") * 10.0 + 10).alias("t"))
    d = spark.range(50).select(F.lit("R").alias("road"), F.col("id").alias("i"), (F.col("id") * 4.0).alias("f"), (F.col("id") * 4.0 + 4).alias("t"))
    out = on_slk_intervals(t, d, ["road"], [Action("i", A.Sum(), "s")], ("f", "t"), "i")
    assert sorted((r.f, r.s) for r in out.collect())[:2] == [(0.0, 0 + 1 + 2), (10.0, 2 + 3 + 4)]
    assert segments.longest_overlap(t, d, ["road"], ("f", "t"), "i").where("f = 0").first().source_position == 0
    cut = reshape.interval_merge(*[x.withColumns({"f": F.col("f") / 1000, "t": F.col("t") / 1000}) for x in (t, d)], ["road"], "f", "t", {"m": "i"}, split_at=[], use_ranges=False).first()
    assert (cut.START_SLK, cut.END_SLK, cut.m) == (0.0, 0.2, 24.5)
    assert len(seen) == 8 and all(x.inputFiles() for x in seen)


def test_prefix_sums_find_ranges_once(spark, monkeypatch):
    """Rows are numbered once, and what is summed and dealt is a written table; moments are of one too."""
    seen, real = [], ranges.Ranges.dealt
    monkeypatch.setattr(ranges, "RANGE_ROWS", 50)
    monkeypatch.setattr(ranges.Ranges, "dealt", lambda self, df: (seen.append(df), real(self, df))[1])
    d = spark.range(300).select("id", F.col("id").cast("double").alias("v"))
    assert ranges.running(d, ["id"], {"s": F.lit(1)}).where("s = id").count() == 300
    assert homogeneous.cumulative_q(d, [], "id", "v").where("q between 0 and 1").count() == 299
    assert len(seen) == 2 and all("__range" in x.columns and hasattr(x, "_written_to") for x in seen)


@pytest.mark.parametrize("kind", ["q", "p"])
def test_best_bisection_by_groups_and_by_ranges(spark, monkeypatch, tmp_path, kind):
    """Small groups are windows and nothing is written for them; larger ones have the same places."""
    monkeypatch.setattr(tables, "scratch", lambda spark: f"file://{tmp_path}")
    r = random.Random(7)
    rows = [(r.choice(["a", "b", None]), k, r.choice([None, 1.0, 2.0, 9.0]), float(r.randrange(5)), r.choice([0.5, 1.0, 2.0])) for k in range(160)]
    rows += [("flat", 1000 + k, 3.0, 3.0, 1.0) for k in range(9)] + [("one", 2000, 1.0, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "g string, k long, v double, w double, len double")
    run = lambda: sorted(map(str, homogeneous.best_bisection(d, ["g"], "k", ["v", "w"], "len", 3.0, kind=kind).withColumn("best_q", F.round("best_q", 9)).collect()))
    near = run()
    assert len(near) >= 3 and not list(tmp_path.iterdir())
    monkeypatch.setattr(ranges, "RANGE_ROWS", 20)
    assert run() == near and list(tmp_path.iterdir())
