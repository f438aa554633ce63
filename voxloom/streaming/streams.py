"""Structured Streaming forms of the front end, and windows on events."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.plans.odometry import SCHEMA, FrontEnd, State, run_frames
from voxloom.plans.scratch import fresh


def stream_odometry(points: DataFrame, cfg: FrontEnd = FrontEnd()) -> DataFrame:
    """Poses of a stream of (seq_id, frame_id, point_idx, x, y, z, label), the map kept between micro-batches.

    The state is the sequence's poses, threshold sums and local map, which is
    bounded by its range and points a voxel.  Frames of a sequence have to
    arrive in order, whole frames in one micro-batch.
    """

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else State()
        rows = pd.concat(list(frames), ignore_index=True)
        out = run_frames(held, rows, cfg)
        held.poses = held.poses[:1] + held.poses[-2:] if len(held.poses) > 3 else held.poses  # what later frames look at
        state.update((pickle.dumps(held),))
        yield out

    return points.groupBy("seq_id").applyInPandasWithState(update, SCHEMA, "state binary", "append", "NoTimeout")


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window and type, late rows dropped by the watermark."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return windows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that its source has now; the rows that it gave, in files of the shared folder.

    Appended rows go straight to Parquet files.  A complete result is written
    anew by each micro-batch, so the last one stays.
    """
    spark: SparkSession = stream.sparkSession
    path = fresh(spark, "stream-out")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", fresh(spark, "stream-state")).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path))
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
