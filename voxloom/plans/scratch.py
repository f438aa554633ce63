"""A folder that driver and executors share, for files that queries write and for checkpoints."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset, on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and the executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="voxloom-")
    return _own[app]


def fresh(spark: SparkSession, label: str) -> str:
    """A new path; what is there is deleted when the driver's Python ends."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write and read back, so that plans built on it stay small and nothing before it runs again."""
    path = fresh(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt by keys over more tasks than there are cores, for rows that are small and take long: the planner merges tasks by their bytes."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone already
            return
