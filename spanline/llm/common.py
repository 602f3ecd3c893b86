"""Helpers shared by the operators: joins with hot keys and connected components."""
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import discard, written

WORD = r"[^\x20\x09-\x0D]+"


def frame(rows: list[tuple], *names: str) -> pd.DataFrame:
    """Rows for Arrow, text as plain objects."""
    return pd.DataFrame({n: pd.Series(c, dtype=object if not c or isinstance(next((v for v in c if v is not None), None), (str, list, type(None))) else None) for n, c in zip(names, zip(*rows) if rows else [[]] * len(names))})


def hot_join(rows: DataFrame, keyed: DataFrame, *keys: str, n: str = "n", share: int = 1000, least: int = 10_000) -> DataFrame:
    """rows joined on keys (not null) with keyed, which has one row for each key and in n how many rows hold it; n goes.

    Keys of more than 1/share of all (there are fewer than `share` of them) are broadcast, so that no
    task holds a hot key's rows. Both sides should be written tables: they are read twice.
    """
    total = keyed.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > max(least, total // share)
    if keyed.where(hot).isEmpty():
        return rows.join(keyed.drop(n), list(keys))
    cold = rows.join(F.broadcast(keyed.where(hot).select(*keys)), list(keys), "left_anti").join(keyed.where(~hot).drop(n), list(keys))
    return cold.unionByName(rows.join(F.broadcast(keyed.where(hot).drop(n)), list(keys)))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) by alternating large-star and small-star joins.

    Returns (node, label) for every node of an edge, label the smallest node reachable. Hot nodes
    only meet partial minima and joins that AQE can split; rounds grow with the log of the diameter.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        new = written(big.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        if new.select(F.col("v").alias("u")).distinct().join(new.select("u").distinct(), "u", "left_semi").isEmpty() and new.groupBy("u").count().where("count > 1").isEmpty():
            discard(e)
            return new.union(new.select("v", "v")).distinct().toDF("node", "label")
        discard(e)
        e = new
