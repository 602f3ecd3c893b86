"""Hard-negative mining: cover trees over norm-augmented candidates, best-first descent within windows of scores."""
import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .search import as_long, best, first, fit, matrix, meet, products, tiled, usable

SIZE, LEAF, PIVOTS, GROWTH = 2048, 16, 32, 8


class CoverTree:
    """A tree over rows (v, label, id) made alike in length by one more coordinate, sqrt(M^2 - |v|^2).

    With that coordinate (0 in a query) the nearest row is the one of highest inner product. A node has
    a row as its centre and the exact distance of its farthest row as its covering radius; its children
    are a net of centres over half that radius apart, each row with the first that covers it. A row at
    distance r of a centre at distance d from the query scores between s - |q|r and s + |q|r, and
    between s - dr - r^2/2 and s + dr - r^2/2 (the latter if d >= r), s the centre's score.
    """

    def __init__(self, rows: pd.DataFrame):
        self.known = None, {}
        self.v, self.labels, self.ids = matrix(rows["v"]), rows["label"].to_numpy(), rows["id"].to_numpy()
        square = (self.v**2).sum(axis=1)
        self.top = float(square.max(initial=0))
        more = np.sqrt(np.maximum(0, self.top - square))
        far = np.sqrt(np.maximum(0, 2 * self.top - 2 * (self.v @ self.v.T + np.outer(more, more))))
        far = far * (1 + 1e-9) + 1e-6 * np.sqrt(self.top)
        np.fill_diagonal(far, 0)
        self.centre, self.radius, self.kids, self.rows = [], [], [], []
        self._grow(far)
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def _node(self, far, members) -> int:
        c = members[0]
        self.centre.append(c)
        self.radius.append(float(far[c, members].max()))
        self.kids.append(None)
        self.rows.append(members)
        return len(self.centre) - 1

    def _grow(self, far):
        todo = [self._node(far, np.arange(len(self.v)))]
        while todo:
            n = todo.pop()
            rest, kids = self.rows[n], []
            if len(rest) <= LEAF or self.radius[n] <= 0:
                continue
            half = self.radius[n] / 2
            while len(rest):
                near = far[rest[0], rest] <= half
                kids.append(self._node(far, rest[near]))
                rest = rest[~near]
            # A net of one child would not end: what it holds is a leaf.
            if len(kids) > 1:
                self.kids[n], self.rows[n] = np.array(kids), None
                todo += kids

    def packed(self) -> bytes:
        """The tree as bytes; whole numbers of up to 32 bits are kept as such."""
        v = self.v.astype(np.int32) if np.abs(self.v).max(initial=0) < 2**31 else self.v
        return pickle.dumps((v, self.labels, self.ids, self.top, self.centre, self.radius, self.kids, self.rows))

    @classmethod
    def unpacked(cls, rows: pd.DataFrame) -> "CoverTree":
        """The tree of a tile's one row."""
        out = cls.__new__(cls)
        v, out.labels, out.ids, out.top, out.centre, out.radius, out.kids, out.rows = pickle.loads(rows["tree"].iloc[0])
        out.v, out.known = v.astype(float), (None, {})
        return out

    def bounds_of_kids(self, q: np.ndarray, length: float, own: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """bounds() of a node's children, kept for the windows of one anchor."""
        if self.known[0] != own:
            self.known = own, {}
        if n not in self.known[1]:
            self.known[1][n] = self.bounds(q, length, self.kids[n])
        return self.known[1][n]

    def bounds(self, q: np.ndarray, length: float, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and most that a row of each node can score."""
        s, r = self.v[self.centre[nodes]] @ q, self.radius[nodes]
        d = np.sqrt(np.maximum(0, length**2 + self.top - 2 * s))
        slack = 1e-9 * (1 + length * np.sqrt(self.top))
        most = np.minimum(s + length * r, np.where(d >= r, s + d * r - r * r / 2, np.inf))
        return np.maximum(s - length * r, s - d * r - r * r / 2) - slack, most + slack

    def window(self, q: np.ndarray, own: int, label: int, same: bool, low: float, high: float, k: int, within) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best rows with low <= score <= high, of this label or not; ties to the smaller id.

        Nodes wait by their highest possible score; a node outside the window, or that cannot reach the
        k-th score so far, goes with all its rows; rows of leaves are scored exactly and put to `within`.
        """
        length = float(np.sqrt(q @ q))
        low_, high_ = self.bounds(q, length, np.array([0]))
        wait, scores, ids = [(-high_[0], 0)] if high_[0] >= low and low_[0] <= high else [], np.zeros(0), np.zeros(0, np.int64)
        bound = length * float(np.sqrt(self.top))
        while wait:
            most, n = heapq.heappop(wait)
            floor = scores[-1] if len(scores) == k else low
            if -most < floor:
                break
            if self.kids[n] is None:
                rows = [self.rows[n]]
            else:
                kids = self.kids[n]
                low_, high_ = self.bounds_of_kids(q, length, own, n)
                open_ = (high_ >= floor) & (low_ <= high)
                rows = []
                for c, h in zip(kids[open_].tolist(), high_[open_].tolist()):
                    if self.kids[c] is None:
                        rows.append(self.rows[c])
                    else:
                        heapq.heappush(wait, (-h, c))
            if rows:
                rows = np.concatenate(rows)
                rows = rows[((self.labels[rows] == label) == same) & (self.ids[rows] != own)]
                s = products(self.v[rows], q[None, :], bound)[:, 0]
                ok = within(s) & (s >= floor)
                scores, ids = np.concatenate([scores, s[ok]]), np.concatenate([ids, self.ids[rows][ok]])
                got = first(scores, ids, k)
                scores, ids = scores[got], ids[got]
        return scores, ids


def _grown(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"tile": rows["tile"].iloc[:1], "tree": [CoverTree(rows.sort_values("id")).packed()]})


def _between(scores: np.ndarray, low: int, high: int) -> np.ndarray:
    """low <= 100 * score <= high, in whole numbers: doubles hold them below 2^45, beyond that Python does."""
    if scores.dtype != object and max(abs(low), abs(high)) < 2**52 and np.abs(scores).max(initial=0) < 2**45:
        return (100 * scores >= low) & (100 * scores <= high)
    return np.array([low <= 100 * int(x) <= high for x in scores], bool)


def _frame(rows: list[tuple], *names: str):
    if rows:
        yield pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*rows))})


def _positives(tree: CoverTree, asks: pd.DataFrame, k: int):
    out = []
    vs = fit(matrix(asks["v"]), tree.v.shape[1])
    for q, own, label, floor in zip(vs, asks["id"], asks["label"], asks["floor"].to_numpy(float, na_value=-np.inf)):
        s, ids = tree.window(q, own, label, True, floor, np.inf, k, lambda s: s == s)
        out.append((np.full(len(s), own), as_long(s), ids))
    return _frame(out, "anchor_id", "score", "id")


def _negatives(tree: CoverTree, asks: pd.DataFrame, k: int, share: int):
    out = []
    asks = asks.sort_values("id")
    vs = fit(matrix(asks["v"]), tree.v.shape[1])
    for q, own, label, top, floor in zip(vs, asks["id"], asks["label"], asks["positive_score"], asks["floor"].to_numpy(float, na_value=-np.inf)):
        top, low = int(top), int(top) * share / 100
        # Whole numbers decide; the bounds of nodes have slack for rounding.
        within = lambda s: _between(s, share * top, 100 * top)  # noqa: B023, E731
        s, ids = tree.window(q, own, label, False, max(low - 1e-9 * abs(low), floor), float(top), k, within)
        out.append((np.full(len(s), own), np.full(len(s), top), as_long(s), ids))
    return _frame(out, "anchor_id", "positive_score", "score", "id")


def _cells(rows: DataFrame) -> DataFrame:
    """rows and the nearest of PIVOTS rows, those of least hash: which rows a tree gets, so that its radii are small."""
    pivots = matrix(r.v for r in rows.select("v").orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect())

    def run(batches):
        for b in batches:
            v = fit(matrix(b["v"]), pivots.shape[1])
            yield b.assign(cell=np.argmin((pivots**2).sum(axis=1) - 2 * (v @ pivots.T), axis=1).astype(np.int32) if len(b) else np.zeros(0, np.int32))

    return rows.mapInPandas(run, "id long, label long, v array<double>, norm double, cell int")


def mine(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", every: int = 100, positives: int = 5, negatives: int = 5, share: int = 80, scale: float = 256.0, size: int = SIZE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by `every`; their positives are the highest inner
    products of their label, and of other labels each positive gets the highest ones between `share`
    percent of its score and its score. Rows are sorted by label, cell and id and cut into tiles of
    `size`, one cover tree each, so a hot label is many tiles. An anchor first asks one tile (its own for
    positives, one by hash for negatives), then rounds of GROWTH times as many; the k-th score of a
    window so far raises its lower end.
    Rows with a null id or label, a null vector or any null or non-finite component take no part; of
    rows that repeat an id one does (see usable); vectors of unlike length meet as if the shorter ended
    in zeros; anchors without positives, and positives without negatives, give no rows; so does an
    empty table. Other columns are ignored.
    """
    label = F.col(label_col).cast("long")
    given = df.withColumn("__label", F.when(F.col(id_col) % 7 == 0, (label + 1) % 10).otherwise(label))
    rows = written(usable(given, id_col, vec_col, scale, label=F.col("__label")))
    celled = written(_cells(rows))
    tiles, n = tiled(celled, [F.col("label"), F.col("cell"), F.col("id")], size)
    heads = written(tiles.groupBy("tile").agg(F.min("label").alias("a"), F.max("label").alias("z")))
    cols = ["id", "label", "v"]
    # One tree for each tile, grown once and asked in every round.
    trees = written(tiles.select("tile", *cols).groupBy("tile").applyInPandas(_grown, "tile int, tree binary"), "zstd")
    anchors = tiles.where(F.col("id") % every == 0).select(*cols, F.col("tile").alias("seed"))
    none = F.lit(None).cast("long").alias("floor")

    found = meet(trees, anchors.select("*", F.col("seed").alias("tile"), none), n, CoverTree.unpacked, lambda t, a: _positives(t, a, positives), "anchor_id long, score long, id long")
    found = written(best(found, ["anchor_id"], "score", "id", positives))
    low, high = 1, min(n, 1 + GROWTH)
    while low < n:
        more = _turn(anchors, found, ["anchor_id"], positives, low, high, n)
        more = more.join(heads, "tile").where("label between a and z").drop("a", "z")
        got = meet(trees, more, n, CoverTree.unpacked, lambda t, a: _positives(t, a, positives), "anchor_id long, score long, id long")
        found, low, high = _merged(found, got, ["anchor_id"], positives), high, min(n, high * GROWTH)

    asks = found.select(F.col("anchor_id").alias("id"), F.col("score").alias("positive_score")).where("positive_score >= 0").distinct()
    asks = written(asks.join(anchors.drop("seed"), "id").withColumn("seed", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")))
    key = ["anchor_id", "positive_score"]
    hard, low, high = None, 0, 1
    while low < n:
        more = _turn(asks, hard, key, negatives, low, high, n)
        more = more.join(heads, "tile").where("not (a = z and a = label)").drop("a", "z")
        got = meet(trees, more, n, CoverTree.unpacked, lambda t, a: _negatives(t, a, negatives, share), "anchor_id long, positive_score long, score long, id long")
        hard, low, high = _merged(hard, got, key, negatives), high, min(n, high * GROWTH)
    discard(rows, celled, tiles, heads, trees, asks)
    p = found.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return p.join(hard, key).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _turn(asks: DataFrame, found: DataFrame | None, key: list[str], k: int, low: int, high: int, n: int) -> DataFrame:
    """asks for the tiles that are low to high - 1 places after their own, with the k-th score so far as floor."""
    a = asks.withColumn("tile", F.explode(F.sequence(F.lit(low), F.lit(high - 1)))).withColumn("tile", ((F.col("seed") + F.col("tile")) % n).cast("int"))
    if found is None:
        return a.withColumn("floor", F.lit(None).cast("long"))
    floor = found.where(F.col("rank") == k).select(F.col("anchor_id").alias("id"), *[c for c in key if c != "anchor_id"], F.col("score").alias("floor"))
    return a.join(floor, ["id", *key[1:]], "left")


def _merged(found: DataFrame | None, got: DataFrame, key: list[str], k: int) -> DataFrame:
    new = written(best(got if found is None else found.drop("rank").unionByName(got), key, "score", "id", k))
    if found is not None:
        discard(found)
    return new


SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.id AS negative_id, positive_score, s.score AS negative_score FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) QUALIFY rank <= 5"""
