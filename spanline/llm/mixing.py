"""Mixing sources to target weights."""
import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, written

BUCKET_ROWS, FAN, SALTS = 2_000, 4_096, 64


def targets(sizes: list[tuple[str | None, int]], weights=(5, 2, 1), epochs: int = 3) -> list[tuple]:
    """(source, size, target): shares by weight, none above `epochs` times its size, the excess reshared."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    w = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    rest, weight, out = sum(n for _, n in order), sum(w.values()), []
    for s, n in sorted(order, key=lambda x: (epochs * x[1] / w[x[0]], x[0] is None, x[0] or "")):
        t = float(epochs * n) if epochs * n * weight <= w[s] * rest else w[s] * rest / weight
        if epochs * n * weight <= w[s] * rest:
            rest, weight = rest - epochs * n, weight - w[s]
        out.append((s, n, t))
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), epochs: int = 3, seed: str = "mix") -> DataFrame:
    """One row per document: id, size, source_size, target, taken.

    A document's random key is the MD5 of seed and id. Keys are cut into ranges within each source,
    so that a range has about BUCKET_ROWS rows; words are summed by FAN ranges, by range, then within a
    range, so that no window holds many more rows than FAN, BUCKET_ROWS or the rows over both; the mix takes whole epochs and, of the last one, exactly the words left to the budget.
    Rows without an id share one key: they are ranges of their own, by size and SALTS salts.
    The sources' totals, one row each, come to the driver. Null and empty texts have size 0; ties in
    the key (repeated ids) go by size; a source of size 0 takes nothing; an empty table gives no rows.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    d = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("key"), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).alias("salt")))
    total = {r[0]: (r[1], r[2]) for r in d.groupBy("src").agg(F.sum("size"), F.count("*")).collect()}
    plan = [(s, n, t, max(1, math.ceil(total[s][1] / BUCKET_ROWS))) for s, n, t in targets([(s, v[0]) for s, v in total.items()], weights, epochs)]
    t = d.sparkSession.createDataFrame(plan, "src string, source_size long, target double, nb long")
    x = d.join(t.withColumnRenamed("src", "s2"), F.col("src").eqNullSafe(F.col("s2"))).drop("s2")
    x = x.withColumn("b", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") * F.col("nb") / 4294967296.0))
    none = F.md5(F.lit(f"{seed}:null"))
    x = x.withColumn("sub", F.when(F.isnull("id"), 1 + F.col("size") * SALTS + F.col("salt")).when(F.col("key") < none, 0).otherwise(F.lit(1 << 62)))
    sums = written(x.groupBy("src", "b", "sub").agg(F.sum("size").alias("bs"))).withColumn("top", F.floor(F.col("b") / FAN))
    so_far = lambda v, n, *by: F.coalesce(F.sum(v).over(W.partitionBy(*by[:-n]).orderBy(*by[-n:]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    top = sums.groupBy("src", "top").agg(F.sum("bs").alias("ts")).select(F.col("src").alias("s3"), F.col("top").alias("t3"), so_far("ts", 1, "src", "top").alias("above"))
    sums = sums.join(top, F.col("src").eqNullSafe(F.col("s3")) & (F.col("top") == F.col("t3")))
    sums = sums.select(F.col("src").alias("s2"), F.col("b").alias("b2"), F.col("sub").alias("sub2"), (F.col("above") + so_far("bs", 2, "src", "top", "b", "sub")).alias("base"))
    x = x.join(sums, F.col("src").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2")) & (F.col("sub") == F.col("sub2")))
    w = W.partitionBy("src", "b", "sub").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = F.col("base") + F.sum("size").over(w) - F.col("size")
    whole = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    rest = F.floor("target") - whole * F.col("source_size")
    taken = whole * F.col("size") + F.least("size", F.greatest(F.lit(0), rest - before))
    return x.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, [5, 2, 1][1 + ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3)::INT] AS w FROM d GROUP BY source),
a AS (SELECT *, sum(n) OVER () - coalesce(3 * sum(n) OVER o, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS ws FROM s WINDOW o AS (ORDER BY 3 * n / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (3 * n * ws <= w * rest) AS capped FROM a),
f AS (SELECT rest, ws FROM c WHERE NOT capped ORDER BY 3 * n / w LIMIT 1),
t AS (SELECT source, n, CASE WHEN capped THEN (3 * n)::DOUBLE ELSE (w * (SELECT rest FROM f))::DOUBLE / (SELECT ws FROM f)::DOUBLE END AS target FROM c),
p AS (SELECT d.*, t.n, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n AS source_size, target, (floor(target / greatest(n, 1)) * size + least(size, greatest(0, floor(target) - floor(target / greatest(n, 1)) * n - before)))::BIGINT AS taken FROM p
"""
