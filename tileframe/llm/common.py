"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that part words: space and \x09-\x0D (also what bytes.split() parts at).
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. Only a local session, which has no other machine, may do without one and gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc.getCheckpointDir()


#: Tables that ``written`` made in this session and that are still there.
_TABLES: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """The rows as a table of their own in the shared folder: like a checkpoint, but compressed and by column. ``drop_written`` deletes it."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid4()}"
    df.write.parquet(path)
    _TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Delete the tables that ``written`` made so far; for callers that have stored all results that come from them."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _TABLES:
        path = jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        path.getFileSystem(conf).delete(path, True)


def free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have, for columns of our own beside theirs."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def words_of(text: Column) -> Column:
    """Words of a text as an array; none for a null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


class Cache(dict):
    """What ``find`` gives for a key, remembered; forgets all when it has CACHED keys."""

    CACHED = 200_000

    def __init__(self, find: Callable):
        super().__init__()
        self.find = find

    def __missing__(self, key):
        if len(self) >= self.CACHED:
            self.clear()
        found = self[key] = self.find(key)
        return found
