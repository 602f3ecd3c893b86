"""Exact dedup by deterministic block naming."""
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, hot_join, written

BLOCK, HOT_SHARE, SALTS = 4096, 1000, 64


def normalised(text_col: str):
    """The text with each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _named(rows: DataFrame, *key: str) -> DataFrame:
    """An integer name for each distinct key: bucket of its hash, then its place in the sorted bucket."""
    bucket = F.xxhash64(*key).bitwiseAND(F.lit(0xFFFFFFFF))
    w = W.partitionBy("bucket").orderBy(*key)
    return rows.withColumn("bucket", bucket).withColumn("name", F.shiftleft("bucket", 31).bitwiseOR(F.dense_rank().over(w).cast("long"))).drop("bucket")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Blocks of `block` characters are sorted into integer names; adjacent names are paired and named
    again until a document has one name. Names are given by sort order, so equal names mean equal
    texts. Blocks that fill over 1/HOT_SHARE of all rows (at most HOT_SHARE of them) are named after
    a partial aggregation and joined by broadcast, as hot pairs and groups are, so no task holds a hot
    one. A text is cut in one pass, in time linear in its length.
    Null text counts as empty; rows that repeat an id and text form one group, one of them is kept;
    a null id sorts after all others; an empty table gives no rows; other columns are ignored.
    """
    d = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("t"))
    # 128 bits tell rows apart at any number of them; names, not this key, tell texts apart.
    rk = F.struct(F.xxhash64("id", "t").alias("x"), F.xxhash64(F.lit(1), "t", "id").alias("y"))
    cut = F.when(F.col("t") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("t", F.lit(f"(?s).{{1,{block}}}"), F.lit(0)))
    d = d.select("id", rk.alias("rk"), F.sha2("t", 256).alias("sha"), cut.alias("b"))
    # The salt deals rows that repeat an id and text; written, it stays as it is.
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    d = written(d.select("id", "rk", "sha", salt.alias("salt"), F.size("b").alias("n"), "b", F.transform("b", lambda x: F.xxhash64(x)).alias("hs")), "zstd")
    stat = d.agg(F.sum("n").alias("s"), F.max("n").alias("m")).first()
    if stat["s"] is None:
        return d.select(F.col("id").alias(id_col), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    least = max(200, stat["s"] // HOT_SHARE)
    # Whole texts decide which blocks are hot: a hot block of a one-block text, or of copies of a long one.
    hot = [r[0] for r in d.select(F.explode("hs").alias("h")).groupBy("h").count().where(F.col("count") > least).select("h").collect()] if stat["s"] > least else []
    part = d.select("rk", F.posexplode(F.arrays_zip("b", "hs")).alias("pos", "x")).select("rk", "pos", F.col("x.b").alias("b"), F.col("x.hs").alias("h"))
    is_hot = F.col("h").isin(hot) if hot else F.lit(False)
    cold = _named(part.where(~is_hot), "b").select("rk", "pos", "name")
    if hot:
        few = part.where(is_hot).select("b").distinct().select("b", (-1 - F.row_number().over(W.orderBy("b"))).cast("long").alias("name"))
        cold = cold.union(part.where(is_hot).join(F.broadcast(few), "b").select("rk", "pos", "name"))
    level, done, todo = 0, [], written(cold)
    left = stat["m"]
    while True:
        if left == 1:
            done.append(todo.select("rk", F.lit(level).alias("level"), "name").distinct())
            break
        top = todo.groupBy("rk").agg(F.max("pos").alias("top"), F.max("name").alias("name"))
        done.append(top.where("top = 0").select("rk", F.lit(level).alias("level"), "name"))
        more = todo.join(top.where("top > 0").select("rk"), "rk", "left_semi")
        pairs = more.groupBy("rk", F.expr("pos div 2").cast("int").alias("pos")).agg(F.max(F.when(F.expr("pos % 2 = 0"), F.col("name"))).alias("l"), F.coalesce(F.max(F.when(F.expr("pos % 2 = 1"), F.col("name"))), F.lit(-1)).alias("r"))
        pairs = written(pairs)
        names = written(_named(pairs.groupBy("l", "r").agg(F.count("*").alias("n")), "l", "r"))
        todo = written(hot_join(pairs, names, "l", "r").select("rk", "pos", "name"))
        discard(pairs, names)
        level, left = level + 1, (left + 1) // 2
    ident = done[0]
    for x in done[1:]:
        ident = ident.union(x)
    rows = d.select("id", "rk", "sha", "salt")
    many = written(rows.groupBy("rk").agg(F.count("*").alias("n"), F.min("salt").alias("low")).join(ident, "rk"))
    one = written(hot_join(rows, many.withColumn("times", F.col("n")), "rk"))
    discard(d)
    g = written(one.groupBy("level", "name").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).withColumn("group_size", F.col("n")))
    out = hot_join(one, g, "level", "name").withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))
    # Of rows that repeat the id that stays, one stays: the first of the lowest salt.
    twice = out.where("kept and times > 1").withColumn("kept", (F.col("salt") == F.col("low")) & (F.row_number().over(W.partitionBy("rk", "salt").orderBy("id")) == 1))
    out = out.where("not (kept and times > 1)").unionByName(twice)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))
