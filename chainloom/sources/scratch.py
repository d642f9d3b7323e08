"""Tables between the steps of a job: written to the folder that driver and executors share, deleted after their last use."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, one of our own, on a single machine only: elsewhere
    each executor would write to its own disk, so that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not on_one_machine(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="chainloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def on_one_machine(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    return re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None


_LEFT: dict[str, SparkSession] = {}


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it back: cuts lineage, survives lost executors. ``discard`` deletes
    it after its last use; what a result still reads goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    _LEFT[path] = spark
    return out


def large(df: DataFrame) -> DataFrame:
    """A table whose joins sort. Spark takes the size of Parquet files for that of their rows: tables of texts and paths that repeat are
    small as files, so it would send all their rows to the driver and every executor."""
    return df.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    for t in tables:
        path = getattr(t, "scratch_path", None)
        if path in _LEFT:
            delete(_LEFT.pop(path), path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _discard_rest() -> None:
    for path, spark in list(_LEFT.items()):
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone, and the folder with it or left to its owner
            return


def new_folder(spark: SparkSession, label: str) -> str:
    """A path in the shared folder for files of one run, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    return path
