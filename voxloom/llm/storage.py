"""Where intermediate tables live, and how lineage is cut.

Everything that outlives one job goes to the folder named by
``spark.checkpoint.dir``: the driver and all executors see it, so a lost
executor loses nothing.  Where that setting is absent a temporary folder of our
own is used if the session is on one machine, as in unit tests; a cluster
without it is an error.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
import weakref
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []
_places: dict[int, tuple[weakref.ref, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by the driver and the executors."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and the executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="voxloom-")
    return _fallback[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/voxloom-{uuid.uuid4().hex[:12]}-{label}"
    _written.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path through the file system that owns it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The reread frame has no lineage but the files, so stages after it never
    recompute what is before it, whichever executors are lost.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _places[id(out)] = (weakref.ref(out), path)
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that nothing reads any more."""
    for df in frames:
        held = _places.pop(id(df), None)
        if held is not None and held[0]() is df:
            drop_path(df.sparkSession, held[1])


def collect_garbage(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now and not at some later collection."""
    for _ in range(2):  # what the first collection lets go of is cleaned by the second
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def written_paths() -> list[str]:
    return [path for _, path in _written]


def drop_unread(spark: SparkSession, paths: list[str], docs: DataFrame) -> None:
    """Delete those of ``paths`` that hold no input file of ``docs``."""
    read = [unquote(f) for f in docs.inputFiles()]
    bare = lambda p: p.split(":", 1)[-1].lstrip("/")
    for path in paths:
        if not any(bare(f).startswith(bare(path) + "/") for f in read):
            drop_path(spark, path)


def tally(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-free checksum of all columns."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).alias("s"),
    ).first()
    return int(row["n"]), int(row["s"])


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # the JVM may be gone already
            return
