"""Exact top-k search by inner product: vectors in buckets of like length, pruned by local cosine thresholds."""
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .search import as_long, best, first, fit, matrix, meet, products, tiled, usable

SIZE, SEEDS, GROWTH, FOCUS, SLACK = 4096, 512, 8, 3, 1e-9
SCHEMA = "query_id long, vec_id long, score long"


class Bucket:
    """A bucket's vectors from the longest on, with sorted lists of each coordinate of their directions."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values(["norm", "id"], ascending=[False, True])
        self.ids, self.norms, self.c = rows["id"].to_numpy(), rows["norm"].to_numpy(float), matrix(rows["v"])
        self.lists = None

    def coordinates(self):
        if self.lists is None:
            unit = self.c / np.maximum(self.norms, 1e-300)[:, None]
            order = np.argsort(unit, axis=0, kind="stable")
            self.lists = unit, order, np.take_along_axis(unit, order, axis=0)
        return self.lists


def reached(bucket: Bucket, norms: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """How many of the bucket's vectors are long enough for each query: |q||c| bounds the product."""
    need = np.where(np.isneginf(floors), -1.0, floors * (1 - SLACK * np.sign(floors)))
    short = np.where(norms > 0, need / np.where(norms > 0, norms, 1), np.where(need > 0, np.inf, -1.0))
    return np.searchsorted(-bucket.norms, -short, side="right")


def feasible(q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of a direction's coordinate where the query's direction has q there and the cosine is t at least."""
    at, room = np.arccos(np.clip(q, -1, 1)), np.arccos(np.clip(t, -1, 1))
    return np.cos(np.minimum(np.pi, at + room)) - 1e-7, np.cos(np.maximum(0.0, at - room)) + 1e-7


def searched(bucket: Bucket, asks: pd.DataFrame, k: int):
    """The k best of a bucket for each query, those below its floor left out.

    The floor over both lengths is the local cosine threshold. Where the list of the query's largest
    coordinate has less than half as many vectors in its feasible range as are long enough, the ranges
    of FOCUS coordinates choose what is verified; else length does.
    """
    q, ids, norms = matrix(asks["v"]), asks["id"].to_numpy(), asks["norm"].to_numpy(float)
    q = fit(q, bucket.c.shape[1])
    floors = asks["floor"].to_numpy(float, na_value=np.nan)
    floors = np.where(np.isnan(floors), -np.inf, floors)
    reach = reached(bucket, norms, floors)
    top = bucket.norms[0]
    by_list = np.zeros(len(q), bool)
    local = np.where((floors > 0) & (norms > 0) & (top > 0), floors * (1 - SLACK) / np.maximum(norms * top, 1e-300), -1.0)
    if (local > 0).any():
        unit, order, lists = bucket.coordinates()
        qu = q / np.maximum(norms, 1e-300)[:, None]
        widest = np.argmax(np.abs(qu), axis=1)
        low, high = feasible(qu[np.arange(len(q)), widest], local)
        span = [(np.searchsorted(lists[:, f], a, "left"), np.searchsorted(lists[:, f], b, "right")) if r and t > 0 else (0, len(lists)) for f, a, b, r, t in zip(widest, low, high, reach, local)]
        by_list = np.array([2 * (b - a) < r for (a, b), r in zip(span, reach)])
    out = []

    def keep(i, places, scores):
        mine = (scores >= floors[i]) & (bucket.ids[places] != ids[i])
        places, scores = places[mine], scores[mine]
        got = first(scores, bucket.ids[places], k)
        if len(got):
            out.append((np.full(len(got), ids[i]), bucket.ids[places[got]], as_long(scores[got])))

    bound = float(norms.max(initial=0)) * float(top)
    for i in np.flatnonzero(by_list):
        a, b = span[i]
        places = order[a:b, widest[i]]
        places = places[places < reach[i]]
        for f in np.argsort(-np.abs(qu[i]))[1:FOCUS]:
            x, y = feasible(qu[i, f], local[i])
            places = places[(unit[places, f] >= x) & (unit[places, f] <= y)]
        if len(places):
            keep(i, places, products(bucket.c[places], q[i : i + 1], bound)[:, 0])
    rest = np.flatnonzero(~by_list & (reach > 0))
    for x in range(0, len(rest), 128):
        some = rest[x : x + 128]
        most = int(reach[some].max())
        scores = products(q[some], bucket.c[:most], bound)
        for i, s in zip(some, scores):
            keep(i, np.flatnonzero(s >= floors[i]), s[s >= floors[i]])
    if out:
        yield pd.DataFrame({n: np.concatenate(c) for n, c in zip(("query_id", "vec_id", "score"), zip(*out))})


def search(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, every: int = 20, scale: float = 64.0, size: int = SIZE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query with all other rows.

    Queries are the rows whose id is divisible by `every`; components become floor(scale * x). Vectors
    are cut into buckets of `size` in order of length. Each query first meets one of the longest
    buckets, then rounds of GROWTH times as many shorter ones; after a round its k-th score so far is
    its floor, and buckets whose longest vector can't reach it are not asked. Nothing is left out: what
    is not compared is below the floor by Cauchy and Schwarz or by the angle to a coordinate.
    Vectors null or holding null or non-finite components and rows without an id take no part; of rows
    that repeat an id one does (see usable); vectors of unlike length meet as if the shorter ended in
    zeros; a query with fewer others gets all; an empty table gives no rows. Other columns are ignored.
    """
    rows = written(usable(df, id_col, vec_col, scale))
    tiles, n = tiled(rows, [F.desc("norm"), F.col("id")], size)
    heads = written(tiles.groupBy("tile").agg(F.max("norm").alias("top")))
    asks = rows.where(F.col("id") % every == 0)
    seeds = min(n, max(1, math.ceil(asks.count() / SEEDS)))
    asks = asks.withColumn("seed", F.pmod(F.xxhash64("id"), F.lit(seeds)).cast("int"))
    build, work = Bucket, lambda bucket, part: searched(bucket, part, k)
    empty = F.lit(None).cast("long").alias("floor")
    found = meet(tiles.where(F.col("tile") < seeds), asks.select("*", F.col("seed").alias("tile"), empty), seeds, build, work, SCHEMA)
    found = written(best(found, ["query_id"], "score", "vec_id", k))
    low, high = 0, min(n, seeds * GROWTH)
    while low < n:
        floor = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
        more = asks.join(floor, "id", "left").withColumn("tile", F.explode(F.sequence(F.lit(low), F.lit(high - 1)))).where("tile <> seed")
        more = more.join(heads, "tile").where(F.col("floor").isNull() | (F.col("norm") * F.col("top") * (1 + SLACK) >= F.col("floor"))).drop("top")
        got = meet(tiles.where(F.col("tile").between(low, high - 1)), more, high - low, build, work, SCHEMA)
        new = written(best(found.drop("rank").unionByName(got), ["query_id"], "score", "vec_id", k))
        discard(found)
        found, low, high = new, high, min(n, high * GROWTH)
    discard(rows, tiles, heads)
    return found.select("query_id", "rank", "vec_id", "score")


SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, (row_number() OVER w)::INT AS rank, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_dot_product(q.v, c.v) DESC, c.vec_id) QUALIFY rank <= 20"""
