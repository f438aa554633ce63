"""Queries that run as streams over all that their source holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.plans import fixtures as X
from voxloom.plans.catalog import query
from voxloom.plans.scratch import fresh
from voxloom.streaming.streams import drain, event_windows, stream_odometry


@query("stream_odometry")
def stream_odometry_query(spark, d):
    s = X.scan(spark, d).select(X.sequence().alias("seq_id"), "frame_id", "point_idx", "x", "y", "z", "label")
    path = fresh(spark, "stream")
    s.repartition("seq_id").write.parquet(path)
    return drain(stream_odometry(spark.readStream.schema(s.schema).parquet(path)), "append")


@query("stream_keyframes", "SELECT event_id // 100 AS block, count(*) AS n FROM events WHERE event_id % 5 = 0 GROUP BY 1")
def stream_keyframes(spark, d):
    """Count tumbling: every fifth row, in blocks of a hundred."""
    e = X.table(spark, d, "events")
    rows = spark.readStream.schema(e.schema).parquet(f"{d}/events.parquet*").where("event_id % 5 = 0")
    blocks = rows.groupBy(F.floor(F.col("event_id") / 100).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    return drain(blocks, "complete")


@query("stream_event_windows", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_event_windows(spark, d):
    e = X.table(spark, d, "events")
    rows = spark.readStream.schema(e.schema).parquet(f"{d}/events.parquet*")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    out = drain(event_windows(rows), "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
