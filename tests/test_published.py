"""SHS and MCV against published outputs, and the same ids however groups are dealt."""
import numpy as np
import pytest

from spanline.operators import homogeneous

# Deflections of 108 rows of 0.01 from 50.01 on, and how many rows each published segment has for lengths of 0.05 to 0.2.
DEFLECTION = [146.27, 144.29, 167.12, 229.8, 163.26, 141.11, 224.18, 192.37, 229.69, 204.52, 173.55, 201.83, 185.63, 151.16, 191.56, 184.69, 160.8, 238.29, 240.41, 203.82, 187.05, 170.83, 203.68, 244.58, 237.08, 214.29, 199.49, 211.48, 285.63, 208.76, 153.27, 114.96, 213.82, 122.58, 121.96, 134.96, 126.55, 142.07, 228.75, 165.46, 162.5, 165.02, 133.36, 171.97, 165.75, 172.42, 205.36, 348.68, 335.74, 383.62, 398.73, 427.34, 402.68, 353.14, 301.45, 325.37, 343.23, 382.09, 298.9, 315.46, 338.18, 425.36, 433.63, 347.96, 423.33, 364.51, 192.74, 190.98, 326.58, 328.47, 375.72, 431.92, 489.83, 378.37, 427.6, 374.79, 403.44, 417.66, 401.28, 262.64, 274.77, 361.61, 450.24, 500.06, 421.9, 406.83, 162.19, 285.53, 481.69, 463.22, 424.27, 459.73, 584.4, 714.84, 429.42, 342.34, 332.57, 332.95, 342.03, 315.33, 238.46, 225.62, 246.12, 268.96, 283.14, 260.06, 228.93, 211.85, 251.53]
SEGMENTS = {"q": [17, 13, 17, 16, 7, 18, 12, 9], "p": [13, 8, 18, 8, 6, 8, 16, 6, 17, 9]}
# Sixteen deflections, split best after nine.
SIXTEEN = [179.37, 177.12, 179.06, 212.65, 175.35, 188.66, 188.31, 174.48, 210.28, 260.05, 228.83, 226.33, 245.53, 315.77, 373.86, 333.56]


def table(spark, values, length=0.01):
    return spark.createDataFrame([(k, round(k * length, 6), round((k + 1) * length, 6), float(v)) for k, v in enumerate(values)], "k int, f double, t double, v double").repartition(3)


def ids(df, kind, allowed, task_rows=100_000):
    got = homogeneous.segment_ids(df, ("f", "t"), ["v"], allowed, kind, task_rows=task_rows).collect()
    return [r.segment_id for r in sorted(got, key=lambda r: r.k)]


@pytest.mark.parametrize("kind", ["q", "p"])
def test_published_segments(spark, kind):
    want = [n + 1 for n, k in enumerate(SEGMENTS[kind]) for _ in range(k)]
    d = table(spark, DEFLECTION)
    assert ids(d, kind, (0.05, 0.2)) == want
    assert ids(d, kind, (0.05, 0.2), task_rows=70) == want


@pytest.mark.parametrize("kind", ["q", "p"])
def test_sixteen(spark, kind):
    d = table(spark, SIXTEEN)
    assert ids(d, kind, (0.03, 0.08)) == [1] * 4 + [2] * 5 + [3] * 7
    x = d.selectExpr("*", "0.01d as length")
    assert [r.k for r in homogeneous.best_bisection(x, [], "k", "v", "length", 0.03, kind=kind).collect()] == [8]


@pytest.mark.parametrize("kind", ["q", "p"])
@pytest.mark.parametrize("values", ["constant", "decimal", "whole", "large"])
def test_task_rows_change_nothing(spark, kind, values):
    rng = np.random.default_rng(7)
    level = np.repeat(rng.integers(1, 4, 12), rng.integers(5, 15, 12))
    v = {"constant": np.full(90, 0.1), "decimal": level * 1.1, "whole": level.astype(float), "large": rng.normal(0, 1, 90) + 1e7}[values]
    d = table(spark, v, 0.1)
    one = ids(d, kind, (0.2, 1.5))
    assert ids(d, kind, (0.2, 1.5), task_rows=60) == one
    if values == "constant" and kind == "q":
        assert set(one) == {1}


def test_the_shape_decides_and_not_the_unit(spark):
    """Levels of 1 and 3 and of 1.1 and 3.3 are cut alike."""
    level = np.repeat([1, 3, 1, 3, 1], [20, 11, 17, 9, 23])
    for kind in "qp":
        assert ids(table(spark, level), kind, (0.02, 0.15)) == ids(table(spark, level * 1.1), kind, (0.02, 0.15))
