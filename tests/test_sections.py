import random

import pytest

from spanline import tables
from spanline.operators import ranges, segments
from spanline.tables import written

COLUMNS = "rid long, g string, x string, sf double, st double, f double, t double"


def brute(rows):
    """Sections and their sources by listing what is active on each piece between bounds."""
    out, number = {}, -1
    for g in sorted({r[1] for r in rows}):
        own = [r for r in rows if r[1] == g]
        events = sorted([(r[5], 1, r[3]) for r in own] + [(r[6], 0, r[4]) for r in own])
        places = sorted({e[0] for e in events})
        start = {p: max(e[1:] for e in events if e[0] == p)[1] for p in places}
        end = {p: min(e[1:] for e in events if e[0] == p)[1] for p in places}
        before = None
        for a, b in zip(places, places[1:]):
            active = sorted((r[5], r[2], r[0]) for r in own if r[5] <= a and r[6] >= b and r[5] < r[6])
            if end[b] <= start[a] or not active:
                continue
            paths = [x for _, x, _ in active]
            number, before = number + (paths != before), paths
            sec = out.setdefault(number, {"g": g, "sf": start[a], "st": end[b], "f": a, "t": b, "own": {}})
            sec["sf"], sec["st"], sec["t"] = min(sec["sf"], start[a]), max(sec["st"], end[b]), b
            for _, x, o in active:
                sec["own"][x, o] = sec["own"].get((x, o), 0) + b - a
    return sorted((s["g"], n, s["sf"], s["st"], s["f"], s["t"], x, o, w) for n, s in out.items() for (x, o), w in s["own"].items())


def sections(spark, rows):
    got = segments.cross_sections(spark.createDataFrame(rows, COLUMNS), ["g"], ["x"], ("sf", "st"), ("f", "t"))
    return sorted(map(tuple, got.select("g", "cross_section_number", "sf", "st", "f", "t", "x", "original_index", "overlap").collect()))


def dealt(seed, n, most, paths, jump):
    """Sources of up to `most` metres that share many bounds; SLK falls back at `jump`, so pieces there don't count."""
    r, out = random.Random(seed), []
    for k in range(n):
        f, w = r.randrange(60), r.randrange(most + 1)
        slk = lambda x: float(x if x < jump else x - 9)
        out.append((k, r.choice("ab"), r.choice(paths), slk(f), slk(f + w), float(f), float(f + w)))
    return out


@pytest.fixture(autouse=True)
def by_changes(monkeypatch):
    """Few sources are active here, so lists are off unless a test turns them on."""
    monkeypatch.setattr(segments, "MOST_LISTED", -1)


@pytest.mark.parametrize(("case", "most"), [((1, 120, 9, "LMR", 99), -1), ((2, 150, 20, "L", 99), -1), ((3, 150, 30, "LR", 31), -1), ((4, 40, 5, "LR", 40), -1), ((2, 150, 20, "L", 99), 1_000), ((3, 150, 30, "LR", 31), 1_000)])
def test_sections_match_listing_every_piece(spark, monkeypatch, case, most):
    monkeypatch.setattr(segments, "MOST_LISTED", most)
    monkeypatch.setattr(segments, "MEAN_LISTED", 1_000.0)
    rows = dealt(*case)
    assert sections(spark, rows) == brute(rows)


def test_a_long_source_beside_many_short_ones(spark):
    # Started first, it stays ahead and one section goes on; started last of all, each short one is new after it.
    short = [(k, "a", "S", float(k), k + 1.0, float(k), k + 1.0) for k in range(2, 40)]
    for long in ((0, "a", "L", 0.0, 50.0, 0.0, 50.0), (0, "a", "L", 2.5, 50.0, 2.5, 50.0)):
        rows = [*short, long]
        assert sections(spark, rows) == brute(rows)


def test_stacked_sources_of_one_path_are_one_section(spark):
    rows = [(k, "a", "L", float(k), k + 7.0, float(k), k + 7.0) for k in range(30)]
    got = sections(spark, rows)
    assert got == brute(rows) and len({r[1] for r in got}) == 13


def test_sections_by_ranges_and_by_groups(spark, monkeypatch):
    rows = dealt(5, 150, 12, "LMR", 45)
    monkeypatch.setattr(ranges, "RANGE_ROWS", 40)
    assert sections(spark, rows) == brute(rows)


def test_rows_that_are_no_sources(spark):
    rows = [(0, "a", "L", 0.0, 10.0, 0.0, 10.0), (1, "a", "R", 4.0, 4.0, 4.0, 4.0), (2, "a", None, 1.0, 2.0, 1.0, 2.0), (3, None, "L", 1.0, 2.0, 1.0, 2.0), (4, "a", "R", 9.0, 2.0, 9.0, 2.0), (5, "a", "R", 1.0, 2.0, None, 2.0), (6, "a", "R", 3.0, 5.0, 3.0, float("nan"))]
    assert [r[4:] for r in sections(spark, rows)] == [(0.0, 10.0, "L", 0, 10.0)]
    assert sections(spark, []) == []


def test_a_section_is_a_row_without_its_sources(spark):
    """Sections come from pieces alone; sources that share path and index still add up."""
    rows = [*dealt(5, 60, 12, "xy", 50), (0, "a", "x", 70.0, 75.0, 70.0, 75.0), (0, "a", "x", 72.0, 80.0, 72.0, 80.0), (0, "a", "x", 72.0, 80.0, 72.0, 80.0)]
    d = spark.createDataFrame(rows, COLUMNS)
    sec, own = segments.cross_sections_normalised(d, ["g"], ["x"], ("sf", "st"), ("f", "t"))
    assert sorted(map(tuple, sec.collect())) == sorted({r[:6] for r in brute(rows)})
    assert sorted(map(tuple, own.collect())) == sorted((r[1], *r[6:]) for r in brute(rows))
    # No source meets a section for the first table, and no path is grouped for sources of their own index.
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(sec) and "Generate" not in plan(sec)
    one = segments.cross_sections(spark.createDataFrame(dealt(5, 60, 12, "xy", 50), COLUMNS), ["g"], ["x"], ("sf", "st"), ("f", "t"))
    assert plan(one).startswith("Project")


@pytest.fixture
def folder(monkeypatch, tmp_path):
    """A folder of its own for written tables."""
    monkeypatch.setattr(tables, "scratch", lambda spark: f"file://{tmp_path}")
    return tmp_path


def unread(folder, df):
    """Written tables that df does not read."""
    return {p.name for p in folder.iterdir()} - {f.split("/")[-2] for f in df.inputFiles()}


@pytest.mark.parametrize("most", [-1, 1_000])
def test_no_table_stays_that_the_result_does_not_read(spark, monkeypatch, folder, most):
    monkeypatch.setattr(segments, "MOST_LISTED", most)
    rows = dealt(2, 150, 20, "LMR", 99)
    out = segments.cross_sections(spark.createDataFrame(rows, COLUMNS), ["g"], ["x"], ("sf", "st"), ("f", "t"))
    assert not unread(folder, out)
    assert sorted(map(tuple, out.select("g", "cross_section_number", "sf", "st", "f", "t", "x", "original_index", "overlap").collect())) == brute(rows)


def test_a_written_table_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString(" ").split(" ") if "shuffle_" in f}
    before = files()
    out = written(spark.range(1_000).groupBy("id").count())
    assert not files() - before and out.count() == 1_000


def test_lists_are_dealt_by_group_once(spark, monkeypatch):
    """What follows the deal of sources and bounds, joins too, has no shuffle of its own; sources of equal path and index go another way."""
    monkeypatch.setattr(segments, "MOST_LISTED", 1_000)
    plans = []
    keep = segments.written

    def spied(df, *args, **kwargs):
        plans.append((df, kwargs))
        return keep(df, *args, **kwargs)

    monkeypatch.setattr(segments, "written", spied)
    rows = dealt(5, 150, 12, "LMR", 45)
    assert sections(spark, rows) == brute(rows)
    df, settings = plans[-1]
    assert settings == {"near": True} and "cross_section_number" in df.columns
    twice = [*rows, (0, "a", "L", 70.0, 75.0, 70.0, 75.0), (0, "a", "L", 72.0, 80.0, 72.0, 80.0)]
    assert sections(spark, twice) == brute(twice)
