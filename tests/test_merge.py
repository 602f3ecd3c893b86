import pytest
from pyspark.sql import functions as F

from spanline.errors import InvalidAggregationError, InvalidDataFrameError, InvalidJoinConfigurationError, OutputCollisionError, PercentileConfigurationError, ZeroLengthSegmentError
from spanline.operators.aggregations import Action, Aggregation as A
from spanline.operators.merge import on_slk_intervals

DATA = [(50, 140, 1.0, "A"), (140, 160, 2.0, "B"), (160, 180, 3.0, "B"), (180, 220, 4.0, "B"), (220, 240, 5.0, "C"), (240, 260, 5.0, "C"), (260, 280, 6.0, "D"), (280, 290, 7.0, "E"), (290, 320, 8.0, "F")]


@pytest.fixture
def frames(spark):
    t = spark.createDataFrame([("R", k * 100.0, k * 100.0 + 100) for k in range(5)], "road string, f double, t double")
    d = spark.createDataFrame([(k, "R", float(a), float(b), v, c) for k, (a, b, v, c) in enumerate(DATA)], "i int, road string, f double, t double, v double, c string")
    return t, d


def run(t, d, *actions, **kw):
    out = on_slk_intervals(t, d, ["road"], list(actions), ("f", "t"), "i", **kw)
    return [tuple(r)[3:] for r in sorted(out.collect(), key=lambda r: r.f)]


@pytest.mark.parametrize("bin_width", [None, 70.0])
def test_numeric_kinds(frames, bin_width):
    t, d = frames
    got = run(t, d, *[Action("v", a, n) for n, a in (("s", A.Sum()), ("lo", A.Min()), ("hi", A.Max()), ("pt", A.SumProportionOfTarget()), ("pd", A.SumProportionOfData()), ("at", A.IndexOfMax()), ("k", A.KeepLongest()), ("g", A.KeepLongestSegment()))], bin_width=bin_width)
    assert [g[0] for g in got] == [1, 10, 35, 8, None]
    assert [g[1] for g in got] == [1, 1, 4, 8, None]
    assert [g[2] for g in got] == [1, 4, 8, 8, None]
    assert [round(g[3], 6) if g[3] else None for g in got] == [0.5, 2.2, round((4 * 20 + 5 * 40 + 6 * 20 + 7 * 10 + 8 * 10) / 100, 6), 1.6, None]
    assert abs(got[0][4] - 50 / 90) < 1e-9 and abs(got[2][4] - (2 + 5 + 5 + 6 + 7 + 8 / 3)) < 1e-9
    assert [g[5] for g in got] == [0, 3, 8, 8, None]
    assert [g[6] for g in got] == [1, 1, 5, 8, None]
    assert [g[7] for g in got] == [1, 1, 4, 8, None]


def test_text_and_first(frames):
    got = run(*frames, Action("c", A.KeepLongest()), Action("c", A.First(), "one"))
    assert got == [("A", "A"), ("B", "A"), ("C", "B"), ("F", "F"), (None, None)]


def test_documented_example(spark):
    t = spark.createDataFrame([("H001", "L", a, b) for a, b in ((10.0, 50.0), (50.0, 100.0), (100.0, 150.0))], "road string, cwy string, f double, t double")
    d = spark.createDataFrame([(k, "H001", "L", a, b, w, y) for k, (a, b, w, y) in enumerate([(0.0, 10.0, 3.1, "tA"), (10.0, 20.0, 4.0, "tA"), (20.0, 40.0, 3.5, "tA"), (40.0, 80.0, 3.8, "tC"), (80.0, 130.0, 3.1, "tC"), (130.0, 140.0, 3.0, "tB")])], "i int, road string, cwy string, f double, t double, w double, y string")
    out = on_slk_intervals(t, d, ["road", "cwy"], [Action("w", A.LengthWeightedAverage()), Action("y", A.KeepLongest())], ("f", "t"), "i")
    assert [(round(r.w, 3), r.y) for r in sorted(out.collect(), key=lambda r: r.f)] == [(3.7, "tA"), (3.52, "tC"), (3.075, "tC")]


@pytest.mark.parametrize(("p", "want"), [(0.0, 10.0), (1.0, 20.0), (0.5, 15.0)])
def test_percentile_ends(spark, p, want):
    t = spark.createDataFrame([("R", 0.0, 10.0), ("R", 50.0, 60.0)], "road string, f double, t double")
    d = spark.createDataFrame([(1, "R", 0.0, 4.0, 10.0), (2, "R", 4.0, 10.0, 20.0)], "i int, road string, f double, t double, v double")
    assert run(t, d, Action("v", A.LengthWeightedPercentile(p), "v")) == [(want,), (None,)]


def test_nulls_nan_and_null_keys(spark):
    t = spark.createDataFrame([("R", 0.0, 10.0), (None, 0.0, 10.0)], "road string, f double, t double")
    d = spark.createDataFrame([(1, "R", 0.0, 5.0, float("nan")), (2, "R", 5.0, 10.0, 2.0), (3, None, 0.0, 9.0, 1.0), (4, "R", None, 9.0, 1.0)], "i int, road string, f double, t double, v double")
    out = on_slk_intervals(t, d, ["road"], [Action("v", A.Sum(), "s"), Action("v", A.First(), "o")], ("f", "t"), "i").collect()
    assert sorted((r.road or "", r.s, r.o) for r in out) == [("", None, None), ("R", 2.0, 2.0)]


def test_errors(frames):
    t, d = frames
    for error, call in (
        (InvalidJoinConfigurationError, lambda: on_slk_intervals(t, d, "road", [], ("f", "t"))),
        (InvalidDataFrameError, lambda: on_slk_intervals(t, d, ["nope"], [], ("f", "t"))),
        (InvalidAggregationError, lambda: on_slk_intervals(t, d, ["road"], [Action("c", A.Sum())], ("f", "t"))),
        (OutputCollisionError, lambda: on_slk_intervals(t, d, ["road"], [Action("v", A.Sum(), "road")], ("f", "t"))),
        (ZeroLengthSegmentError, lambda: on_slk_intervals(t.selectExpr("road", "f", "f as t"), d, ["road"], [], ("f", "t"), check_rows=True)),
        (PercentileConfigurationError, lambda: A.LengthWeightedPercentile(1.5)),
    ):
        with pytest.raises(error):
            call()


def test_targets_of_any_plan(spark, tmp_path):
    """A wide aggregated target over many partitions, written whole; repeated targets; default bins, none and narrow ones."""
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        t = spark.range(24_000).selectExpr("id % 8000 AS k", "id").groupBy("k").agg(F.max("id").alias("top"), F.first(F.lit("x" * 50)).alias("wide")).selectExpr("concat('R', k % 7) AS road", "CAST(k div 7 AS double) AS f", "CAST(k div 7 + 1 AS double) AS t", "top", "wide")
        d = spark.range(8000).selectExpr("concat('R', id % 7) AS road", "CAST(id div 7 AS double) + 0.5 AS f", "CAST(id div 7 AS double) + 1.25 AS t", "CAST(id AS double) AS v", "id AS i")
        want = {(r.road, r.f): r.t for r in t.select("road", "f", "t").collect()}
        for width in (None, 0, 0.4):
            path = f"{tmp_path}/{width}"
            on_slk_intervals(t.union(t.where("f < 3")), d, ["road"], [Action("v", A.Sum(), "s"), Action("v", A.KeepLongest(), "k")], ("f", "t"), "i", bin_width=width).write.parquet(path)
            got = spark.read.parquet(path).collect()
            assert len(got) == 8000 + 21
            for r in got:
                own = int(r.f) * 7 + int(r.road[1:])
                assert r.s == own + (own - 7 if r.f >= 1 else 0) and r.k == own and want[(r.road, r.f)] == r.t and r.wide == "x" * 50
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_kinds_that_need_an_index(frames):
    t, d = frames
    with pytest.raises(InvalidDataFrameError):
        on_slk_intervals(t, d, ["road"], [Action("v", A.First())], ("f", "t"))
    got = on_slk_intervals(t, d, ["road"], [Action("c", A.KeepLongest(), "k"), Action("v", A.KeepLongest(), "n"), Action("v", A.Sum(), "s")], ("f", "t")).collect()
    assert [(r.k, r.n, r.s) for r in sorted(got, key=lambda r: r.f)][0] == ("A", 1.0, 1.0)


def test_performance_logger(frames):
    from spanline.names import configure_performance_logger

    told = []
    configure_performance_logger(lambda event, figures: told.append((event, figures)))
    try:
        run(*frames, Action("v", A.LengthWeightedPercentile(0.5)), Action("v", A.Sum(), "s"))
        assert [e for e, _ in told][-1] == "merge" and {"length_classes", "written_table"} < {e for e, _ in told}
        assert told[-1][1]["actions"] == 2 and all(isinstance(x, float) and x >= 0 for _, f in told for x in f.values())
        n = len(told)
        with pytest.raises(InvalidJoinConfigurationError):
            on_slk_intervals(*frames, "road", [], ("f", "t"))
        configure_performance_logger(None)
        run(*frames, Action("v", A.Sum()))
        assert len(told) == n
    finally:
        configure_performance_logger(None)
