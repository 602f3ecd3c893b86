"""Corpus pipeline: quality, exact dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents; the last returns how many
words the mix takes of each document. For nulls, empty texts and repeated rows see the stages and operators.
"""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanline.llm import decontaminate, exact_dedup, mixing, quality, simhash
from spanline.llm.common import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    A null text is scored as empty; repeated rows each go or stay; ids only choose what is learned from, so null ids are scored like others.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out("doc_id", 3, 1))
    model = quality.train(docs.select("doc_id", "text"), labels)
    return quality.score(docs, model, out="__score").where("__score >= 0.5").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the smallest doc_id's; of rows that repeat id and text, one.

    Rows are told apart by id and text, so rows without an id, or with another row's, go by their own text.
    """
    groups = exact_dedup.exact_groups(docs).where("not kept")
    gone = written(groups.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("__twice")))
    keyed = docs.withColumn("__key", F.sha2(exact_dedup.normalised("text"), 256))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__sha"))
    # The same plan at every size: what goes grows with the documents, so it is no side to broadcast.
    out, twice = keyed.join(gone.hint("merge"), on, "left_anti"), gone.where("__twice")
    if not twice.isEmpty():
        out = out.union(keyed.join(twice, on, "left_semi").dropDuplicates(["doc_id", "__key"]))
    return out.drop("__key")


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the smallest doc_id's, nulls last; of rows that repeat id and text, one.

    Rows are told apart by id and text; of rows that share the smallest id, the one with the smallest key stays.
    """
    keyed = docs.withColumn("__key", F.md5(F.concat_ws("|", F.isnull("doc_id").cast("string"), F.col("doc_id").cast("string"), F.isnull("text").cast("string"), F.col("text"))))
    groups = written(simhash.near_groups(keyed, "__key"))
    many = groups.groupBy("component_id").count().where("count > 1").select("component_id")
    rows = groups.join(many, "component_id").groupBy("component_id", "__key").count()
    rows = written(rows.join(keyed.select("__key", "doc_id").distinct(), "__key"))
    stays = rows.groupBy("component_id").agg(F.min(F.struct(F.isnull("doc_id").alias("n"), "doc_id", "__key"))["__key"].alias("__stays"))
    gone = written(rows.join(stays, "component_id").where("__key <> __stays or count > 1").select("__key", (F.col("__key") == F.col("__stays")).alias("__twice")))
    out, twice = keyed.join(gone, "__key", "left_anti"), gone.where("__twice")
    if not twice.isEmpty():
        out = out.unionByName(keyed.join(twice, "__key", "left_semi").dropDuplicates(["__key"]))
    return out.select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; rows are told apart by id and text."""
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    gone = decontaminate.leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "__key").select("__key").distinct()
    return keyed.join(gone, "__key", "left_anti").drop("__key").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken of each document to meet the sources' weights."""
    return mixing.mix(docs)


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near), ("decontaminate", drop_leaks), ("mix", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
