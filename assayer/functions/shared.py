"""The folder that executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that one task may hold.
ONE_TASK = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that executors share, spark.checkpoint.dir. Where it is unset, a local master, as in tests, takes a new local one; a cluster must name it."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    """A path for a table of this application in the shared folder."""
    return f"{_own_dir(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, *made: Callable) -> list:
    """What these functions return, each run by a thread of its own, so that small jobs of one fill what those of another leave idle."""
    shared_dir(spark)
    with ThreadPoolExecutor(len(made)) as pool:
        return [run.result() for run in [pool.submit(inheritable_thread_target(spark)(f)) for f in made]]


class Parts:
    """A table that grows by parts of one schema, each written once; all of them are read by one scan."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.schema = None

    def add(self, df: DataFrame) -> DataFrame:
        """df as a further part, written and read back."""
        self.paths.append(new_path(df.sparkSession))
        self.schema = self.schema or df.schema
        df.write.parquet(self.paths[-1])
        return df.sparkSession.read.schema(self.schema).parquet(self.paths[-1])

    def all(self, spark: SparkSession) -> DataFrame | None:
        """The parts so far, none before the first."""
        return spark.read.schema(self.schema).parquet(*self.paths) if self.paths else None


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """left joined with right (stored, a row a key; `rows`: how many rows of left have it), so that no task gets all rows of a hot key.

    Keys that hold over a thousandth of the rows, which are fewer than a thousand, are broadcast; the rest is shuffled.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    few = F.broadcast(right.filter(F.col(rows) * 1000 > total).drop(rows))
    return left.join(few, keys).unionByName(left.join(few.select(*keys), keys, "left_anti").join(right.filter(F.col(rows) * 1000 <= total).drop(rows), keys))


def drop_stored(spark: SparkSession) -> None:
    """Deletes the tables that this application has stored; to be called when a job's results have been written or read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
