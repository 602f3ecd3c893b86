"""Tiles of vectors that blocks of queries meet: what top-k search and hard-negative mining share."""
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

FILL, EXACT = 0.7, 2.0**53


def usable(df: DataFrame, id_col: str, vec_col: str, scale: float, **more: Column) -> DataFrame:
    """(id, more, v, norm): v the components floor(scale * x), as doubles; one row for each id.

    Rows with a null id, a null vector or any null or non-finite component go, and rows where one of
    `more` is null; of rows that repeat an id the one with the smallest (more, v) stays. Components
    beyond a long stop at its ends.
    """
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    d = df.select(F.col(id_col).cast("long").alias("id"), *[c.alias(n) for n, c in more.items()], F.when(finite, F.transform(x, lambda v: F.floor(v * scale).cast("double"))).alias("v")).dropna()
    d = d.groupBy("id").agg(F.min(F.struct(*more, "v")).alias("x")).select("id", "x.*")
    return d.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, v: a + v * v)))


def tiled(rows: DataFrame, order: list[Column], size: int) -> tuple[DataFrame, int]:
    """rows (a written table whose order is one of distinct values) and, in `tile`, numbers of runs of that order of `size` rows at most; the numbers' bound.

    Rows are dealt by ranges that Spark samples, so the driver holds no cuts; ranges that come out too
    long are cut once more, with numbers beyond the others.
    """
    parts = max(1, math.ceil(rows.count() / (FILL * size)))
    at = F.monotonically_increasing_id()
    place = F.shiftright(at, 33) + parts * F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / size)
    t = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("tile", place.cast("int")))
    return t, (t.agg(F.max("tile")).first()[0] or 0) + 1


def matrix(vs) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    vs = [np.asarray(v, float) for v in vs]
    d = max(map(len, vs), default=0)
    out = np.zeros((len(vs), d))
    for k, v in enumerate(vs):
        out[k, : len(v)] = v
    return out


def fit(q: np.ndarray, d: int) -> np.ndarray:
    """Rows with d columns: what the other side lacks meets zeros."""
    return q[:, :d] if q.shape[1] >= d else np.pad(q, ((0, 0), (0, d - q.shape[1])))


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of rows of integers, exact: by doubles where lengths say that no sum can reach 2^53, else by Python's integers."""
    if bound < EXACT / 2:
        return a @ b.T
    whole = lambda x: np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)
    return whole(a) @ whole(b).T


def as_long(scores) -> np.ndarray:
    """Scores as longs; what is beyond stops at a long's ends."""
    return np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in scores], dtype=np.int64)


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, in that order."""
    if len(scores) > 4 * k and scores.dtype != object:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=int)


def meet(tiles: DataFrame, asks: DataFrame, count: int, build, work, schema: str) -> DataFrame:
    """work(build(a tile's rows), rows of asks for that tile), over all tiles.

    A task holds one tile and streams what asks it; a tile's rows come first in its partition.
    """
    both = tiles.withColumn("kind", F.lit(0)).unionByName(asks.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    d = both.repartitionById(count, "tile").sortWithinPartitions("tile", "kind")

    def run(batches):
        tile, held, index = None, [], None
        for b in batches:
            key = np.stack([b["tile"].to_numpy(), b["kind"].to_numpy()])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), len(b)]
            for x, y in zip(cuts, cuts[1:]):
                part = b.iloc[x:y]
                if x < y and part["tile"].iloc[0] != tile:
                    tile, held, index = part["tile"].iloc[0], [], None
                if x < y and part["kind"].iloc[0] == 0:
                    held.append(part)
                elif x < y and held:
                    index = index if index is not None else build(pd.concat(held))
                    yield from work(index, part)

    return d.mapInPandas(run, schema)


def best(rows: DataFrame, by: list[str], score: str, id_col: str, k: int, rank: str = "rank") -> DataFrame:
    """The k rows of highest score for each `by`, ties to the smaller id; Spark limits each task's rows before the shuffle."""
    w = W.partitionBy(*by).orderBy(F.desc(score), id_col)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)
