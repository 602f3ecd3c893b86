"""Linear-referenced views of the given tables, in Spark and as SQL."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import written

_ORDER = "ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
_OBS = f"""SELECT road, flag, st, qty, cents, rn, road * 10000000 + rn AS rid, t - qty AS f, t, t - qty + 7 * floor((rn - 1) / 50) AS sf, t + 7 * floor((rn - 1) / 50) AS s FROM (
SELECT l_suppkey AS road, l_returnflag AS flag, l_linestatus AS st, l_quantity AS qty, CAST(round(l_extendedprice * 100) AS DOUBLE) AS cents, CAST(row_number() OVER (PARTITION BY l_suppkey {_ORDER}) AS BIGINT) AS rn, sum(l_quantity) OVER (PARTITION BY l_suppkey {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM {{lineitem}}) x"""
_LANES = f"""SELECT road, flag, st, cents, qty, rid, t - qty AS f, t, t - qty AS sf, t AS s FROM (
SELECT road, flag, st, cents, qty, rid, sum(qty) OVER (PARTITION BY road, flag ORDER BY rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM ({_OBS}) y) z"""


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def obs(spark, d) -> DataFrame:
    """Line items as touching observations along their supplier's road; sf and s jump by 7 every 50 rows."""
    return spark.sql(_OBS, lineitem=table(spark, d, "lineitem"))


def gap(spark, d) -> DataFrame:
    return obs(spark, d).where("flag <> 'R'")


def lanes(spark, d) -> DataFrame:
    return spark.sql(_LANES, lineitem=table(spark, d, "lineitem"))


def ends(spark, d) -> DataFrame:
    """(road, m): the greatest t of each road's observations.

    Whole quantities that are not negative add up to it in any order, so only others need the sort of obs.
    """
    q = F.col("l_quantity")
    m = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("road")).agg(F.sum(q).alias("m"), F.bool_and((q >= 0) & (q == F.rint(q))).alias("whole"))
    m = written(m)
    if m.where("not whole or m >= 1L << 53").isEmpty():
        return m.drop("whole")
    return obs(spark, d).groupBy("road").agg(F.max("t").alias("m"))


def grid(spark, d, width: float, start: float = 0.0) -> DataFrame:
    """Per road, segments of one width up to its end; rid counts them."""
    # Roads are few and small until they are cut; unless dealt in turn, adaptive execution merges them into one task.
    m = ends(spark, d).where(F.col("m") > start).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col("m") - start) / width) - 1)).alias("k")
    return m.select("road", k).select("road", (F.col("road") * 10000000 + F.col("k") + 1).alias("rid"), (F.col("k") * width + start).alias("f"), ((F.col("k") + 1) * width + start).alias("t"))


def sql(*names: str) -> str:
    """WITH clause that defines the views named."""
    own = {
        "obs": _OBS.format(lineitem="lineitem"), "gap": "SELECT * FROM obs WHERE flag <> 'R'", "lanes": _LANES.format(lineitem="lineitem"),
        "tgt": "SELECT road, road * 10000000 + k + 1 AS rid, k * 100.0::DOUBLE AS f, (k + 1) * 100.0::DOUBLE AS t FROM (SELECT road, unnest(range(0, ceil(max(t) / 100)::BIGINT)) AS k FROM obs GROUP BY road)",
        "segb": "SELECT road, road * 10000000 + k + 1 AS rid, k * 137.0::DOUBLE + 50 AS f, (k + 1) * 137.0::DOUBLE + 50 AS t FROM (SELECT road, unnest(range(0, ceil((max(t) - 50) / 137)::BIGINT)) AS k FROM obs GROUP BY road)",
        "pairs": "SELECT t.road, t.f AS slk_from, t.t AS slk_to, g.rid AS i, g.t AS dt, g.st, g.qty, g.cents, least(t.t, g.t) - greatest(t.f, g.f) AS w, g.t - g.f AS len, t.t - t.f AS tlen FROM tgt t LEFT JOIN gap g ON t.road = g.road AND g.f < t.t AND g.t > t.f",
    }
    return "WITH " + ", ".join(f"{n} AS ({own[n]})" for n in names) + " "
