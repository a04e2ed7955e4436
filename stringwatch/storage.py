"""Intermediate tables.

A fit needs several passes over the same scored rows. Rows are written once as
Parquet into the folder the cluster names in ``spark.checkpoint.dir`` and read
back, so later passes neither recompute the scores nor depend on the executors
that produced them, and each pass reads only the columns it needs.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

CHECKPOINT_DIR = "spark.checkpoint.dir"

#: temporary folders of local sessions without the setting, by application
_temporary: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    Without the setting, a local session gets a temporary folder (tests); a
    cluster session fails, since executors there do not share local folders.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that driver and executors share")
        application = spark.sparkContext.applicationId
        if application not in _temporary:
            _temporary[application] = tempfile.mkdtemp(prefix="stringwatch-stage-")
        root = _temporary[application]
    return root.rstrip("/")


def staging_path(spark: SparkSession, name: str = "table") -> str:
    """A new path below the shared folder, used once."""
    return f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(frame: DataFrame, name: str = "table", path: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``frame`` once and return a scan of the written table."""
    spark = frame.sparkSession
    path = path or staging_path(spark, name)
    writer = frame.write.mode("errorifexists")
    if codec:
        writer = writer.option("compression", codec)
    writer.parquet(path)
    return spark.read.schema(StructType(frame.schema.fields)).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table that no frame in use reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Staged tables of one job, deleted together by :meth:`drop`.

    The frames returned by :meth:`stage` are lazy scans: drop only after every
    result that derives from them has been written.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def path(self, name: str = "table") -> str:
        self.paths.append(staging_path(self.spark, name))
        return self.paths[-1]

    def stage(self, frame: DataFrame, name: str = "table", codec: str | None = None) -> DataFrame:
        return stage(frame, name, self.path(name), codec)

    def release(self, path: str) -> None:
        """Delete a table before the others, once nothing that is still to be written reads it."""
        remove(self.spark, path)
        self.paths.remove(path)

    def drop(self, *keep: str) -> None:
        for path in self.paths:
            if path not in keep:
                remove(self.spark, path)
        self.paths = [path for path in self.paths if path in keep]
