"""Scan, pose and calibration files.

Scans are ``%06d.bin`` (float32 x, y, z, intensity) with ``%06d.label``
(uint32, low 16 bits the class).  Reading goes through Spark's own file
sources, so any store that Spark can open will do; writing goes through Arrow's
file systems, one file a frame, published when complete.
"""

from __future__ import annotations

import posixpath
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINTS = "frame_id long, point_idx long, x double, y double, z double, raw_label int"


def _frame(path: Column) -> Column:
    return F.regexp_extract(path, r"(\d+)\.\w+$", 1).cast("long")


def list_scans(spark: SparkSession, folder: str) -> DataFrame:
    """(frame_id, cloud, label) of a folder's scans that have both files, in no order.

    A sequence ends at the first frame without a label file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    named = files.select(_frame(F.col("path")).alias("frame_id"), F.regexp_extract("path", r"\.(bin|label)$", 1).alias("kind"), "path")
    both = named.groupBy("frame_id").agg(F.max(F.when(F.col("kind") == "bin", F.col("path"))).alias("cloud"), F.max(F.when(F.col("kind") == "label", F.col("path"))).alias("label"))
    first_gap = both.where("label is null").agg(F.min("frame_id").alias("gap"))
    return both.where("cloud is not null and label is not null").crossJoin(F.broadcast(first_gap)).where("gap is null or frame_id < gap").drop("gap")


def _binary(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kind}").load(folder)
    return files.select(_frame(F.col("path")).alias("frame_id"), F.col("content").alias(kind))


def read_clouds(spark: SparkSession, folder: str) -> DataFrame:
    """Points of all ``.bin`` files: (frame_id, point_idx, x, y, z); the intensity is dropped at once."""

    def run(batches):
        for g in batches:
            for frame, data in zip(g.frame_id, g.bin):
                p = np.frombuffer(data, dtype="<f4")
                p = p[: len(p) // 4 * 4].reshape(-1, 4)
                yield pd.DataFrame({"frame_id": frame, "point_idx": np.arange(len(p)), "x": p[:, 0].astype(float), "y": p[:, 1].astype(float), "z": p[:, 2].astype(float)})

    return _binary(spark, folder, "bin").mapInPandas(run, "frame_id long, point_idx long, x double, y double, z double")


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of all ``.label`` files: (frame_id, point_idx, raw_label); the high 16 bits are dropped."""

    def run(batches):
        for g in batches:
            for frame, data in zip(g.frame_id, g.label):
                v = np.frombuffer(data, dtype="<u4") & 0xFFFF
                yield pd.DataFrame({"frame_id": frame, "point_idx": np.arange(len(v)), "raw_label": v.astype(np.int32)})

    return _binary(spark, folder, "label").mapInPandas(run, "frame_id long, point_idx long, raw_label int")


def read_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Points with labels, zipped by position; as many points as there are labels."""
    return read_clouds(spark, folder).join(read_labels(spark, folder), ["frame_id", "point_idx"])


def write_scans(points: DataFrame, folder: str) -> DataFrame:
    """Write (frame_id, point_idx, x, y, z, raw_label) as .bin and .label files; returns (frame_id, points)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs as pafs

        g = g.sort_values("point_idx")
        cloud = np.zeros((len(g), 4), dtype="<f4")
        cloud[:, :3] = g[["x", "y", "z"]].to_numpy()
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        frame = int(g.frame_id.iloc[0])
        for kind, data in (("bin", cloud.tobytes()), ("label", g.raw_label.to_numpy().astype("<u4").tobytes())):
            path = posixpath.join(base, f"{frame:06d}.{kind}")
            part = f"{path}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as out:
                out.write(data)
            store.move(part, path)
        return pd.DataFrame({"frame_id": [frame], "points": [len(g)]})

    return points.select("frame_id", "point_idx", "x", "y", "z", "raw_label").groupBy("frame_id").applyInPandas(run, "frame_id long, points long")


def pose_line(m: Column) -> Column:
    """Twelve numbers with 16 digits after the point."""
    return F.array_join(F.transform(m, lambda v: F.format_string("%.16f", v)), " ")


def write_poses(poses: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One line a pose in frame order, a file a sequence in the folder of its name; sequences are written apart."""
    lines = poses.select("seq_id", "frame_id", pose_line(F.col("m")).alias("value"))
    dealt = lines.repartition("seq_id").sortWithinPartitions("seq_id", "frame_id")
    dealt.select("seq_id", "value").write.mode(mode).partitionBy("seq_id").text(path)


def pose_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, n, line) of the pose files of a folder, or of one file, whose seq_id is null then."""
    return _lines(spark, path, ("seq_id",))


def _lines(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    whole = whole.withColumns({c: F.lit(None).cast("string") for c in keep if c not in whole.columns})
    lines = whole.select(*keep, F.posexplode(F.split("value", "\n")).alias("n", "line"))
    return lines.where(F.trim("line") != "")


def read_poses(spark: SparkSession, path: str, seq_id: str = "s") -> DataFrame:
    """(seq_id, frame_id, m) of pose files; the frame is the line number.  ``seq_id`` names a file that stands alone."""
    numbers = F.transform(F.split(F.trim("line"), r"\s+"), lambda v: v.cast("double"))
    return pose_lines(spark, path).select(F.coalesce(F.col("seq_id").cast("string"), F.lit(seq_id)).alias("seq_id"), F.col("n").cast("long").alias("frame_id"), numbers.alias("m")).where(F.size("m") == 12)


def quaternion(m: Column) -> Column:
    """w of the unit quaternion of a pose's rotation, and its position, as a struct."""
    w = F.sqrt(F.greatest(F.lit(0.0), 1 + m[0] + m[5] + m[10])) / 2
    return F.struct(w.alias("w"), m[3].alias("px"), m[7].alias("py"), m[11].alias("pz"))


def read_calib(spark: SparkSession, path: str) -> DataFrame:
    """(key, m) of a ``key: 12 numbers`` file."""
    parts = F.split("line", ":", 2)
    numbers = F.transform(F.split(F.trim(parts[1]), r"\s+"), lambda v: v.cast("double"))
    return _lines(spark, path).select(F.trim(parts[0]).alias("key"), numbers.alias("m"))


def write_rows(rows: DataFrame, path: str, columns: tuple[str, ...], order: tuple[str, ...] = ()) -> None:
    """Columns as blank-separated text: map nodes ``x y z label``, edges ``i j``."""
    lines = rows.sortWithinPartitions(*order) if order else rows
    lines.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]).alias("value")).write.mode("overwrite").text(path)


def encode_clouds(points: DataFrame, with_label: bool = True) -> DataFrame:
    """(frame_id, data, step): message buffers of float32 x, y, z and a uint16 label, a frame each."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("point_idx")
        kind = np.dtype([("x", "<f4"), ("y", "<f4"), ("z", "<f4")] + ([("label", "<u2")] if with_label else []))
        rows = np.zeros(len(g), dtype=kind)
        for name in kind.names:
            rows[name] = g[name].to_numpy()
        return pd.DataFrame({"frame_id": [int(g.frame_id.iloc[0])], "data": [rows.tobytes()], "step": [kind.itemsize]})

    return points.groupBy("frame_id").applyInPandas(run, "frame_id long, data binary, step int")


def decode_clouds(messages: DataFrame) -> DataFrame:
    """Points of message buffers; label -1 becomes null where the buffer has none."""

    def run(batches):
        for g in batches:
            for frame, data, step in zip(g.frame_id, g.data, g.step):
                names = [("x", "<f4"), ("y", "<f4"), ("z", "<f4")] + ([("label", "<u2")] if step >= 14 else [])
                rows = np.frombuffer(data, dtype=np.dtype(names))
                label = pd.array(rows["label"].astype(int), dtype="Int64") if step >= 14 else pd.array([None] * len(rows), dtype="Int64")
                yield pd.DataFrame({"frame_id": frame, "point_idx": np.arange(len(rows)), "x": rows["x"].astype(float), "y": rows["y"].astype(float), "z": rows["z"].astype(float), "label": label})

    return messages.mapInPandas(run, "frame_id long, point_idx long, x double, y double, z double, label int")


def markers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Line list of edges: both end points."""
    at = lambda node, names: nodes.select("frame_id", F.col("node_id").alias(node), *[F.col("c" + c).alias(n) for c, n in zip("xyz", names)])
    return edges.join(at("i", ("x1", "y1", "z1")), ["frame_id", "i"]).join(at("j", ("x2", "y2", "z2")), ["frame_id", "j"])
