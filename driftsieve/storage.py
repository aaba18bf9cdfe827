"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: The workspaces of each application.
_MADE: dict[str, list[str]] = {}
#: With it, shuffle files go when the job that made them ends; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, as in tests, one of our own on this machine. On a cluster
    there is no such thing, so there the setting is asked for."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="driftsieve-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return "file://" + _OWN[app]


@contextmanager
def shuffles_go(spark: SparkSession):
    """What is planned and run in here leaves no shuffle files behind."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


class Workspace:
    """A job's own subfolder. Each table is written once and read back, so a lost executor costs no earlier step, and what was
    shuffled for it goes once it is there."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _MADE.setdefault(spark.sparkContext.applicationId, []).append(self.path)

    def keep(self, df: DataFrame, name: str = "t", partition_by: str | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n:03d}_{name}"
        writer = df.write.option("compression", "zstd")
        with shuffles_go(self.spark):
            (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Deletes all tables kept here. For jobs whose results are written; a query that gives a DataFrame leaves its
        tables until that is done with, see clear."""
        delete(self.spark, self.path)

    def __enter__(self) -> "Workspace":
        return self

    def __exit__(self, *_) -> None:
        self.close()


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Deletes what this application's queries have kept between their steps. DataFrames that they gave can't be read after it."""
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


_CHEAP = {"Project", "Filter", "Relation", "RelationV2", "LogicalRDD", "LocalRelation", "Union"}


def spread(df: DataFrame) -> DataFrame:
    """A scan (with filters and projections at most) of fewer partitions than there are cores, dealt out over the cores;
    larger ones stay as they are, unshuffled. A file of one row group is one partition however it is split. Other plans
    stay as they are too: to ask for their partitions would run them."""
    nodes = set(re.findall(r"^[\s:|+\-]*([A-Z]\w*)", df._jdf.queryExecution().optimizedPlan().toString(), re.M))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if nodes <= _CHEAP and df.rdd.getNumPartitions() < cores else df
