"""Intervals cut at each other's bounds against points."""
import random

import pytest
from pyspark.sql import functions as F

from spanline import tables
from spanline.operators import ranges, reshape

COLUMNS = "g string, a double, b double, ta double, tb double, k string, v double, w double"


def side(spark, seed, n=40):
    """Intervals that do not overlap, with gaps, jumps of the true measure, nulls and equal neighbours."""
    rng, rows = random.Random(seed), []
    for g in ("r", "s"):
        at, off = 0, 0
        for _ in range(n):
            at += rng.choice([0, 0, 0, 4])
            off += rng.choice([0, 0, 0, 6])
            m = rng.randint(1, 9) * 2
            rows.append((g, at / 1000, (at + m) / 1000, (at + off) / 1000, (at + m + off) / 1000, rng.choice(["x", "x", "y", None]), rng.choice([None, float(rng.randint(0, 9))]), float(rng.randint(0, 3))))
            at += m
    rows += [(None, 0.0, 1.0, 0.0, 1.0, "x", 1.0, 1.0), ("r", 5.0, 5.0, 5.0, 5.0, "x", 1.0, 1.0), ("r", 7.0, 6.0, 7.0, 6.0, "x", 1.0, 1.0)]
    return spark.createDataFrame(rows, COLUMNS)


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple((x is None, x if isinstance(x, str) else round(x or 0, 6)) for x in r) for r in df.select(cols).collect())


@pytest.mark.parametrize(("true", "split"), [((), True), (("ta", "tb"), ["k"]), (("ta", "tb"), ())])
def test_segments_of_intervals(spark, true, split):
    d = side(spark, 1).drop(*[c for c in ("ta", "tb") if not true], "w")
    cut = reshape.segments_of_intervals(d, ["g"], "a", "b", *(true or (None, None)), split_at=split, summarise={"m": "v"})
    points = reshape.segments_of_intervals(d.where("g is not null"), ["g"], "a", "b", *(true or (None, None)), split_at=["k"] if split is True else split, summarise={"m": F.avg("v")})
    assert rows(cut) == rows(points) and cut.count() > 10


@pytest.mark.parametrize(("split", "use_ranges"), [("left", False), ("right", True), (True, False), (False, True), (["k"], False)])
def test_interval_merge(spark, split, use_ranges):
    left, right = side(spark, 2, 15).select("g", "a", "b", "k"), side(spark, 3, 25).select("g", "a", "b", F.col("w").alias("z"), "v")
    left = left.where("g is not null and a < b")
    run = lambda m, split: reshape.interval_merge(left, right, ["g"], "a", "b", {"m": m}, split_at=split, use_ranges=use_ranges)
    # An aggregate does not tell which columns it reads, so the points' way has them listed.
    listed = {"right": ["z"], "True": ["k", "z"]}.get(str(split), split)
    assert rows(run("v", split)) == rows(run(F.avg("v"), listed))


def test_interval_merge_of_true_measures(spark):
    left, right = side(spark, 4, 15).select("g", "a", "b", "ta", "tb", "k").where("g is not null"), side(spark, 4, 15).select("g", "a", "b", "ta", "tb", "v")
    run = lambda m: reshape.interval_merge(left, right, ["g"], "a", "b", {"m": m}, "ta", "tb", split_at=["k"], use_ranges=False)
    assert rows(run("v")) == rows(run(F.avg("v"))) and run("v").count() > 5


def test_work_grows_with_bounds_and_not_with_metres(spark):
    """Intervals of a hundred thousand kilometres whose lengths share no metre."""
    left = spark.createDataFrame([("r", 0.0, 99_999.999)], "g string, a double, b double")
    right = spark.createDataFrame([("r", 0.001, 50_000.0, 1.0), ("r", 50_000.0, 99_999.998, 3.0)], "g string, a double, b double, v double")
    m = [reshape._measured(d, "a", "b", None, ["g"]) for d in (left, right)]
    assert reshape._elementary(m, ["g"]).count() == 4
    got = reshape.interval_merge(left, right, ["g"], "a", "b", {"m": "v"}, split_at=False, use_ranges=False).first()
    assert (got.START_SLK, got.END_SLK) == (0.0, 99_999.999) and abs(got.m - 2) < 1e-6


def test_points_are_runs_with_the_same_result(spark):
    import random

    rng = random.Random(5)

    def some(n, step, name):
        out = []
        for k in range(n):
            a = step * rng.randint(0, 60) + rng.choice([0, 0, 0, 2])
            out.append((rng.choice(["r", "s"]), a / 1000.0, (a + step * rng.randint(1, 6)) / 1000.0, rng.choice(["x", "y", None]), float(k)))
        return spark.createDataFrame(out, f"road string, a double, b double, {name} string, {name}_v double")

    for step, n in ((4, 12), (4, 60)):
        d = some(n, step, "f")
        # Values by place, so that it does not matter which of equal points stands.
        points = reshape.stretch(d, "a", "b")
        for split in (["f"], []):
            s = {"n": F.count("*"), "lo": F.min("SLK"), "m": F.sum("SLK")}
            want = reshape.get_segments(points, ["road"], "SLK", step, split_at=split, summarise=s)
            got = reshape.segments_of_intervals(d, ["road"], "a", "b", split_at=split, summarise=s)
            key = lambda x: sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in x.collect())
            assert key(got.select(want.columns)) == key(want)


def test_aggregated_merges_join_runs_and_not_points(spark):
    left = spark.createDataFrame([("r", 0.0, 4000.0), ("r", 4000.0, 8000.0)], "road string, a double, b double")
    right = spark.createDataFrame([("r", 0.0, 6000.0, "x", 1.0), ("r", 6000.0, 7000.0, "y", 3.0)], "road string, a double, b double, f string, v double")
    counted = []
    real, reshape._points = reshape._points, lambda *a: counted.append(a) or real(*a)
    try:
        out = reshape.interval_merge(left, right, ["road"], "a", "b", {"m": F.avg("v"), "n": F.count("v")}, split_at=["f"], use_ranges=False)
        got = sorted(tuple(r) for r in out.select("START_SLK", "END_SLK", "f", "m", "n").collect())
        kept = sorted(tuple(r) for r in reshape.interval_merge(left, right, ["road"], "a", "b", {"m": F.avg("v")}, split_at=False).select("a", "b", "m").collect())
    finally:
        reshape._points = real
    assert not counted
    assert got == [(0.0, 6000.0, "x", 1.0, 6), (6000.0, 7000.0, "y", 3.0, 1), (7000.0, 8000.0, None, None, 0)]
    assert kept == [(0.0, 4000.0, 1.0), (4000.0, 8000.0, 5 / 3)]


def test_segments_of_points_go_by_runs(spark):
    """Against points listed in Python: repeats, gaps, odd remainders, places below zero, words' edges and slk between metres."""
    rng, points = random.Random(8), []
    for g in ("r", "s"):
        at = -300
        while at < 400:
            n, k, v = rng.choice([1, 5, 70, 130]), rng.choice(["x", "y", None]), float(rng.randint(0, 3))
            points += [(g, (m + (0.0003 if rng.random() < 0.05 else 0)) / 1000, k, v) for m in range(at, at + 2 * n, 2)]
            at += 2 * n + rng.choice([0, 0, 1, 6])
    points += points[:40]
    d = spark.createDataFrame(points, "g string, SLK double, k string, v double")
    want, seen = [], {}
    for g, x, k, v in points:
        seen.setdefault((g, round(x * 1000), k), (x, v))
    last = None
    for (g, m, k), (x, v) in sorted(seen.items(), key=lambda p: (p[0][0], p[0][1], p[0][2] is not None, p[0][2] or "")):
        if last != (g, m - 2, k):
            want.append([g, k, m / 1000, 0, 0, 0, 0])
        want[-1][3:] = [(m + 2) / 1000, want[-1][4] + 1, want[-1][5] + v, want[-1][6] + x]
        last = (g, m, k)
    got = reshape.get_segments(d, ["g"], "SLK", 2, split_at=["k"], summarise={"n": F.count("*"), "t": F.sum("v"), "x": F.sum("SLK")})
    key = lambda r: tuple((x is None, x if isinstance(x, str) else round(x or 0, 6)) for x in r)
    assert sorted(map(key, got.select("g", "k", "START_SLK", "END_SLK", "n", "t", "x").collect())) == sorted(map(key, want)) and len(want) > 15
    # What is shuffled are runs: 20,000 points of one value are 323 words of 62 places at most.
    wide = spark.range(20_000).select(F.lit("r").alias("g"), (F.col("id") / 1000).alias("SLK"), F.lit(1.0).alias("v"))
    assert reshape._runs_of(wide.withColumn("__m", reshape.as_metres(F.col("SLK"))), ["g"], "SLK", 1, []).count() <= 323


def test_rows_that_overlap_none_are_not_cut(spark, monkeypatch):
    """Rows beside one another give segments without a range join; those that overlap are cut alone."""
    d = spark.createDataFrame([("r", 0.0, 0.1, "x", 1.0), ("r", 0.1, 0.3, "x", 4.0), ("r", 0.3, 0.4, "y", 2.0), ("s", 0.0, 0.2, "x", 5.0), ("s", 0.1, 0.3, "y", 7.0), ("s", 0.1, 0.2, "x", 3.0), ("s", 0.3, 0.4, "y", None)], "g string, a double, b double, k string, v double")
    cut, real = [], reshape._cut
    monkeypatch.setattr(reshape, "_cut", lambda cuts, x, ids: (cut.append(x.count()), real(cuts, x, ids))[1])
    run = lambda x: sorted(map(tuple, reshape.segments_of_intervals(x, ["g"], "a", "b", split_at=["k"], summarise={"m": "v"}).select("g", "k", "START_SLK", "END_SLK", F.round("m", 6)).collect()))
    assert run(d.where("g = 'r'")) == [("r", "x", 0.0, 0.3, 3.0), ("r", "y", 0.3, 0.4, 2.0)] and not cut
    got = run(d)
    # Of the two x from 0.1 to 0.2 the lesser value counts.
    assert cut == [3] and got[:2] == run(d.where("g = 'r'")) and got[2] == ("s", "x", 0.0, 0.2, 4.0)


@pytest.mark.parametrize("use_ranges", [False, True])
def test_interval_merge_by_groups_and_by_ranges(spark, monkeypatch, tmp_path, use_ranges):
    """Groups of few pieces are merged where they are dealt, with the same result; no table stays that the result does not read."""
    r = random.Random(4)
    rows = lambda n, most: [(r.choice("xy"), f / 1000, (f + r.randrange(1, most)) / 1000, r.choice("kl"), float(r.randrange(9))) for f in (r.randrange(200) for _ in range(n))]
    left, right = spark.createDataFrame(rows(40, 30), "g string, a double, b double, k string, w double"), spark.createDataFrame(rows(60, 50), "g string, a double, b double, l string, v double")

    def run(name):
        folder = tmp_path / name
        folder.mkdir()
        monkeypatch.setattr(tables, "scratch", lambda spark: f"file://{folder}")
        out = reshape.interval_merge(left, right, ["g"], "a", "b", {"m": "v"}, split_at=["k", "l"], use_ranges=use_ranges)
        assert {p.name for p in folder.iterdir()} == {f.split("/")[-2] for f in out.inputFiles()}
        return sorted(map(str, out.withColumn("m", F.round("m", 9)).collect()))

    near = run("groups")
    monkeypatch.setattr(ranges, "RANGE_ROWS", 300)
    # Few bounds, but pieces of many rows.
    assert run("pieces") == near and near
    monkeypatch.setattr(ranges, "RANGE_ROWS", 20)
    assert run("ranges") == near
