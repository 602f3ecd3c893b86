"""Top-k search, hard negatives and fill-in-middle against brute force, edge rows included."""
import hashlib
import math
import random
import re

import numpy as np
import pandas as pd
import pytest

from spanline.llm import fim, negatives, search, topk

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, tile int, norm string"


def table(spark, rows):
    return spark.createDataFrame([(i, e, y, "x", 1, 2, "y") for i, e, y in rows], SCHEMA)


def planted(seed, n=900, d=8):
    """Vectors of many lengths, copies, near copies, ties, odd rows and one label that holds a third."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.choice([0.05, 0.3, 1, 4], size=(n, 1))
    x[::9] = x[4]
    x[1::9] = x[5] + rng.normal(size=x[1::9].shape) * 0.01
    rows = [(k, [float(np.float32(v)) for v in r], 3 if k % 3 == 0 else int(rng.integers(0, 6))) for k, r in enumerate(x)]
    odd = [(n, None, 1), (n + 1, [1.0, None] + [0.0] * (d - 2), 1), (n + 2, [float("nan")] * d, 1), (n + 3, [float("inf")] * d, 1), (None, [9.0] * d, 1), (n + 4, [0.0] * d, 3), (n + 5, [1.0, -2.0], 3), (n + 6, [], 3), (n + 7, x[4].tolist(), None), (1, [5.0] * d, 1), (n + 100 - n % 100, [0.0] * d, 3)]
    return rows + odd


def clean(rows, scale, labelled):
    """{id: (label, whole vector)}: of rows that repeat an id the smallest."""
    out = {}
    for i, e, y in rows:
        if i is None or e is None or labelled and y is None or any(v is None or not math.isfinite(v) for v in e):
            continue
        y = ((y + 1) % 10 if i % 7 == 0 else y) if labelled else 0
        got = (y, [int(math.floor(scale * np.float64(np.float32(v)))) for v in e])
        out[i] = min(out.get(i, got), got)
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


@pytest.mark.parametrize("size", [4096, 40])
def test_topk(spark, size, monkeypatch):
    monkeypatch.setattr(topk, "SEEDS", 16)
    rows = planted(1)
    e = clean(rows, 64, False)
    want = []
    for q in e:
        if q % 20 == 0:
            best = sorted((-dot(e[q][1], e[c][1]), c) for c in e if c != q)[:20]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    got = topk.search(table(spark, rows), size=size)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_topk_few_rows(spark):
    few = table(spark, [(0, [1.0], 1), (3, [2.0], 1)])
    assert [tuple(r) for r in topk.search(few).collect()] == [(0, 1, 3, 64 * 128)]
    assert topk.search(few.where("false")).count() == 0
    assert topk.search(table(spark, [(0, None, 1)])).count() == 0


def test_topk_of_large_components_is_exact(spark):
    """Products beyond 2^53 differ by less than a double can tell."""
    big = table(spark, [(0, [2.0**24, 2.0**24], 1), (1, [2.0**24, 2.0**24 - 1], 1), (2, [2.0**24, 2.0**24 - 2], 1)])
    assert [(r.vec_id, r.score) for r in sorted(topk.search(big).collect(), key=lambda r: r["rank"])] == [(k, 2**30 * (2**30 + 2**30 - 64 * k)) for k in (1, 2)]


def test_coordinate_pruning_decides_and_loses_nothing():
    rng = np.random.default_rng(3)
    x = np.floor(64 * rng.normal(size=(600, 12)))
    near = np.floor(x[:30] + rng.normal(size=(30, 12)))
    rows = lambda v: pd.DataFrame({"id": range(len(v)), "v": list(v), "norm": np.sqrt((v**2).sum(axis=1))})
    bucket = topk.Bucket(rows(x))
    asks = rows(near).assign(id=range(1000, 1030))
    score = near @ x.T
    floors = np.sort(score, axis=1)[:, -3]
    got = pd.concat(topk.searched(bucket, asks.assign(floor=pd.array(floors.astype(int), dtype="Int64")), 5))
    assert sorted(zip(got.query_id, got.vec_id)) == sorted((1000 + i, j) for i, j in zip(*np.where(score >= floors[:, None])))
    assert bucket.lists is not None and (topk.reached(bucket, asks["norm"].to_numpy(), floors) < 600).any()


@pytest.mark.parametrize("size", [2048, 60])
def test_negatives(spark, size):
    rows = planted(2)
    e = clean(rows, 256, True)
    want = []
    for a in e:
        if a % 100 == 0:
            s = {b: dot(e[a][1], e[b][1]) for b in e if b != a}
            for p in sorted((b for b in s if e[b][0] == e[a][0]), key=lambda b: (-s[b], b))[:5]:
                hard = sorted((b for b in s if e[b][0] != e[a][0] and 80 * s[p] <= 100 * s[b] <= 100 * s[p]), key=lambda b: (-s[b], b))[:5]
                want += [(a, p, k + 1, b, s[p], s[b]) for k, b in enumerate(hard)]
    got = negatives.mine(table(spark, rows), size=size)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert len(want) > 60 and sorted(map(tuple, got.collect())) == sorted(want)


def test_negatives_of_nothing(spark):
    few = table(spark, [(0, [1.0], 1), (100, [1.0], None), (3, None, 2)])
    assert negatives.mine(few).count() == 0 and negatives.mine(few.where("false")).count() == 0


def test_cover_tree_bounds_hold_every_row():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(500, 6)) * 50)
    x[::4] = x[1] + np.floor(rng.normal(size=x[::4].shape) * 2)
    tree = negatives.CoverTree(pd.DataFrame({"v": list(x), "label": 0, "id": range(500)}))
    held = {}

    def rows(n):
        if n not in held:
            held[n] = set(tree.rows[n].tolist()) if tree.kids[n] is None else set().union(*[rows(c) for c in tree.kids[n]])
        return held[n]

    assert rows(0) == set(range(500)) and any(k is not None and len(k) < 100 for k in tree.kids)
    for q in np.floor(rng.normal(size=(20, 6)) * 50):
        low, high = tree.bounds(q, float(np.sqrt(q @ q)), np.arange(len(tree.centre)))
        for n in range(len(tree.centre)):
            s = x[sorted(rows(n))] @ q
            assert low[n] <= s.min() and s.max() <= high[n]


def test_products_of_any_size():
    a = np.array([[2.0**40, 1.0]])
    assert search.products(a, a, 2.0**80)[0, 0] == 2**80 + 1
    assert search.as_long([2**80]).tolist() == [2**63 - 1]


UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def arranged(i, text):
    text = text or ""
    units, h = UNIT.findall(text), hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return (i, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (i, n, form, len(p), len(m), sha(out), sha(text))


def test_fill_in_middle(spark):
    rng = random.Random(7)
    texts = [None, "", "a", "<P>", "x <S> y", "<", "<S", "<<<", "\n\r\n", "日本 語ab 😀é", "a" * 100_000, "1" * 50_000, "".join(rng.choices("ab <>PSM\n$\\é😀", k=200_000))]
    texts += ["".join(rng.choices("ab <>PM1\n $\\é😀", k=rng.randint(1, 400))) for _ in range(300)]
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)] + [(None, "no id", 1, "x"), (9, texts[9], 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, form string")
    got = fim.digests(docs).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r[:2])
    assert sorted(map(tuple, got), key=key) == sorted((arranged(r[0], r[1]) for r in rows), key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"} and fim.digests(docs.where("false")).count() == 0


def test_skip_list_reaches_every_rank():
    rng = random.Random(8)
    for n in (0, 1, 63, 64, 65, 128, 5000, 300_000):
        text = "".join(rng.choices(["ab", "c", " ", "é", "\n"], k=n))
        ends = [0, *[m.end() for m in UNIT.finditer(text)]]
        units = fim.SkipList(text)
        assert units.size == len(ends) - 1 and len(units.lanes) >= 1 + (units.size > 64 * 64)
        for r in [*range(min(200, len(ends))), *rng.sample(range(len(ends)), min(50, len(ends))), len(ends) - 1]:
            assert units.place(r) == ends[r]
