"""Written tables, which cut lineage."""
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .performance import timed


#: Spark's setting that removes a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting whether a join's sides must be dealt by all of its keys.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
_open: list[list[DataFrame]] = []


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; on a local master, where that is unset, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spanline-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, "false") for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame, codec: str = "snappy", near: bool = False) -> DataFrame:
    """df, written to the shared folder as Parquet and read back; the shuffle files of the write go with its end.

    near: sides of a join that are dealt by some of its keys stay where they are.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/t-{uuid.uuid4().hex}"
    with _set(spark, {CLEANUP: "true"} | ({ALL_KEYS: "false"} if near else {})), timed("written_table", columns=len(df.columns)):
        df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if _open:
        _open[-1].append(out)
    return out


@contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the tables written within the block at its end, but those given to the function it yields."""
    made, kept = [], []
    _open.append(made)
    try:
        yield lambda df: kept.append(df) or df
    finally:
        _open.pop()
    discard(*[x for x in made if not any(x is k for k in kept)])
    if _open:
        _open[-1].extend(kept)


def once(df: DataFrame) -> DataFrame:
    """df as a written table, unless it is one."""
    return df if hasattr(df, "_written_to") else written(df)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
