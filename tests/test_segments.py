import numpy as np
import pytest
from pyspark.sql import functions as F

from spanline.functions import mappings, stats, steps
from spanline.operators import homogeneous, reshape, segments
from spanline.sources import arcgis


@pytest.mark.parametrize(("a", "b", "m", "least", "want"), [(190.0, 270.0, 50.0, 0.0, [190, 200, 250, 270]), (14.2, 16.05, 0.5, 0.1, [14.2, 14.5, 15, 15.5, 16.05]), (14.05, 14.05, 0.5, 0.1, [14.05, 14.05]), (9.0, 11.0, 10.0, 2.0, [9, 11])])
def test_linspace(spark, a, b, m, least, want):
    got = spark.range(1).select(steps.linspace_steps(F.lit(a), F.lit(b), m, least).alias("x")).first().x
    assert np.allclose(got, want)


def test_islands_null_categories_and_global_ids(spark):
    d = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 2.0), ("a", 3.0, 4.0), ("b", 0.0, 1.0), (None, 0.0, 1.0), (None, 1.0, 2.0)], "c string, f double, t double")
    got = sorted((r.c or "~", r.f, r.segment_id) for r in segments.segment_ids(d, ["c"], ("f", "t")).collect())
    assert [g[2] for g in got] == [0, 0, 1, 2, 3, 4]


def test_overlay_covers_the_union(spark):
    o = spark.createDataFrame([(0, "r", 0.0, 10.0), (1, "r", 10.0, 20.0)], "rid long, c string, f double, t double").selectExpr("*", "f as sf", "t as st")
    a = spark.createDataFrame([(0, "r", 5.0, 25.0)], "rid long, c string, f double, t double").selectExpr("*", "f as sf", "t as st")
    got = segments.overlay(o, a, ["c"], ("sf", "st"), ("f", "t"), "o", "a").select("f", "t", "o", "a").collect()
    assert sorted(map(tuple, got)) == [(0, 5, 0, None), (5, 10, 0, 0), (10, 20, 1, 0), (20, 25, None, 0)]


def test_cross_sections_change_with_the_active_set(spark):
    d = spark.createDataFrame([(0, "r", "L", 0.0, 10.0), (1, "r", "R", 4.0, 8.0)], "rid long, g string, x string, f double, t double").selectExpr("*", "f as sf", "t as st")
    got = segments.cross_sections(d, ["g"], ["x"], ("sf", "st"), ("f", "t")).select("cross_section_number", "f", "t", "x", "overlap").collect()
    assert sorted(map(tuple, got)) == [(0, 0, 4, "L", 4), (1, 4, 8, "L", 4), (1, 4, 8, "R", 4), (2, 8, 10, "L", 2)]


def test_checks(spark):
    d = spark.createDataFrame([(0, "a", 0.0, 2.0), (1, "a", 1.0, 3.0)], "k int, c string, f double, t double")
    assert not segments.check_monotonic(d, ["c"], ("f", "t"), "k").first().ok
    assert segments.check_no_reversed(d, ("f", "t")).first().ok
    assert not segments.check_disjoint(d, ("f", "t"), ["c"], "k").first().ok
    with pytest.raises(ValueError, match="two"):
        segments.check_linear_index(d, ["f"])
    with pytest.raises(TypeError):
        segments.check_linear_index(d, ["c", "t"])


@pytest.mark.parametrize("kind", ["q", "p"])
def test_homogeneous_finds_the_steps(spark, kind):
    v = [1.0, 1.1, 0.9, 1.0, 5.0, 5.1, 4.9, 5.0, 5.05, 9.0, 9.1, 8.9, 9.0]
    d = spark.createDataFrame([("r", k / 100, (k + 1) / 100, x) for k, x in enumerate(v)], "g string, f double, t double, v double")
    got = sorted(homogeneous.segment_ids(d, ("f", "t"), ["v"], (0.01, 0.06), kind, ["g"]).collect())
    assert [r.segment_id for r in got][0] == 1 and len({r.segment_id for r in got}) >= 2


def test_reshape(spark):
    d = spark.createDataFrame([("r", 0.0, 0.045, 1.0)], "g string, a double, b double, v double")
    got = sorted((r.a, r.b) for r in reshape.make_segments(d, "a", "b", max_segment=20, as_km=True).collect())
    assert got == [(0.0, 0.02), (0.02, 0.03), (0.03, 0.045)] or got[-1][1] == 0.045
    p = reshape.stretch(d, "a", "b", segment_size=5)
    assert p.count() == 9
    back = reshape.get_segments(p, ["g"], "SLK", 5, summarise={"v": F.avg("v")}).first()
    assert (back.START_SLK, back.END_SLK, back.v) == (0.0, 0.045, 1.0)


def test_lanes_and_mappings(spark):
    d = spark.createDataFrame([("L", 1.0, 2.0, 3.0)], "dirn string, A_1 double, A_2 double, B_1 double")
    assert sorted(map(tuple, reshape.lane_to_row(d, "dirn", [], ["A_", "B_"]).collect())) == [("L1", 1.0, 3.0), ("L2", 2.0, None)]
    r = spark.range(1).select(mappings.surf_type(F.lit(1)).alias("s"), mappings.get_lanes(F.lit("L1"), "xsp", "description").alias("l"), mappings.lane_to_side(F.lit("R2")).alias("e"), mappings.region_name(F.lit(99)).alias("n"), stats.deteriorate(F.lit(100.0), 0.1, final=80.0).alias("c")).first()
    assert (r.s, r.l, r.e, r.n) == ("DGA", "Left lane 1", "R", None)
    assert [round(x, 3) for x in r.c] == [100.0, 90.0, 81.0, 72.9]


def test_http_source_pages_and_errors():
    rows = [{"ROAD": str(k)} for k in range(5)]

    def get(url, params, timeout):
        if "returnCountOnly" in params:
            return {"count": 5}
        a = params["resultOffset"]
        return {"features": [{"attributes": r} for r in rows[a : a + params["resultRecordCount"]]], "exceededTransferLimit": True}

    assert arcgis.count("u", {}, 1, get) == 5
    assert list(arcgis.pages("u", {}, 0, 5, 2, 1, get)) == rows
    with pytest.raises(ValueError, match="reports"):
        arcgis.count("u", {}, 1, lambda *a: {"error": "no"})
    with pytest.raises(RuntimeError):
        list(arcgis.pages("u", {}, 0, 5, 2, 1, lambda *a: {"features": [], "exceededTransferLimit": True}))
    assert arcgis.parameters(None, {"a": 1}, a=2)["a"] == 2 and "orderByFields" in arcgis.parameters({}, None)


def test_homogeneous_by_rounds_is_bisection_in_one_task(spark):
    """Groups too large for a task, null groups and no groups, against the grouped map."""
    rng = np.random.default_rng(5)
    rows = [(g, k / 10, (k + 1) / 10, float(v), float(w)) for g in ("a", "b", None) for k, (v, w) in enumerate(zip(np.repeat(rng.normal(5, 2, 25), 12) + rng.normal(0, 0.3, 300), rng.normal(9, 1, 300)))]
    d = spark.createDataFrame(rows, "g string, f double, t double, v double, w double").repartition(3)
    for kind, low, groups, variables in (("q", None, ["g"], ["v"]), ("p", 0.3, [], ["v", "w"])):
        x = d if groups else d.where("g = 'a'")
        ids = lambda n: {(r.g, r.f): r.segment_id for r in homogeneous.segment_ids(x, ("f", "t"), variables, (low, 2.0), kind, groups, task_rows=n).collect()}  # noqa: E731,B023
        one = ids(100_000)
        assert ids(180) == one and len(set(one.values())) > 10


def test_groups_are_bisected_many_in_a_batch(spark):
    """No call for each group; groups that end within a batch or go on over several have the same ids."""
    d = spark.range(900).selectExpr("if(id < 700, id div 9, null) as g", "id / 10D as f", "(id + 1) / 10D as t", "double(hash(id) % 100) as v", "array(struct(id as i)) as more")
    x = homogeneous.segment_ids(d, ("f", "t"), ["v"], (0.1, 0.5), "q", ["g"])
    assert "FlatMapGroups" not in x._jdf.queryExecution().executedPlan().toString()
    want = {r.f: (r.segment_id, r.more) for r in x.collect()}
    assert len(want) == 900 and max(v for v, _ in want.values()) > 10
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {r.f: (r.segment_id, r.more) for r in x.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_prefix_sums_in_ranges(spark):
    from spanline.operators.ranges import running

    d = spark.createDataFrame([(k % 3 if k % 7 else None, (k * 37) % 101, k) for k in range(300)], "g int, o int, v long").groupBy("g", "o").agg(F.sum("v").alias("v"))
    rows = d.collect()
    key = lambda r: (r.g is None, r.g or 0, r.o is None, r.o)
    got = {(r.g, r.o): (r.s, r.n) for r in running(d, ["g", "o"], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    assert got == {(r.g, r.o): (sum(x.v for x in rows if key(x) < key(r)), sum(key(x) < key(r) for x in rows)) for r in rows}
    got = {(r.g, r.o): r.s for r in running(d, ["o"], {"s": F.col("v")}, within=("g",)).collect()}
    assert got == {(r.g, r.o): sum(x.v for x in rows if x.g == r.g and x.o < r.o) for r in rows}
