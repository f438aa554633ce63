"""Filters and voxel aggregates on points (frame_id, point_idx, x, y, z, label).

All of them are one pass or one partial aggregate; the frame is part of every
key, so frames spread over the cluster and never meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.functions.labels import BACKGROUND, FIRST_MOVING, FOREGROUND, train_label

CELL = ("vx", "vy", "vz")


def relabel(points: DataFrame, raw: str = "raw_label") -> DataFrame:
    """Raw classes to train classes; only the low 16 bits of a raw class count."""
    return points.withColumn("label", train_label(F.col(raw).bitwiseAND(0xFFFF)))


def filter_range(points: DataFrame, least: float = 5.0, most: float = 100.0) -> DataFrame:
    if least > most:
        raise ValueError("the least range is above the largest")
    r = G.norm(G.xyz())
    return points.where((r > least) & (r < most))


def filter_static(points: DataFrame, least: float = 5.0, most: float = 100.0) -> DataFrame:
    """Within range and of no moving class."""
    return filter_range(points.where(F.col("label") < FIRST_MOVING), least, most)


def foreground(points: DataFrame) -> DataFrame:
    return points.where(F.col("label").isin(*FOREGROUND))


def background(points: DataFrame) -> DataFrame:
    return points.where(F.col("label").isin(*BACKGROUND))


def correct_sweep(points: DataFrame, degrees: float = 0.205) -> DataFrame:
    return points.withColumns(dict(zip("xyz", G.sweep_correction(G.xyz(), degrees))))


def with_voxel(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({n: G.voxel(v, size) for n, v in zip(CELL, G.xyz())})


def voxel_first(points: DataFrame, size: float, carry: tuple[str, ...] = ("x", "y", "z", "label"), order: str = "point_idx") -> DataFrame:
    """The first point of each frame's voxel, by ``order``; every buffer is primitive, so it is hash-aggregated."""
    first = [F.min_by(c, order).alias(c) for c in carry]
    return with_voxel(points, size).groupBy("frame_id", *CELL).agg(F.min(order).alias(order), *first, F.count(F.lit(1)).alias("n"))


def voxel_cascade(points: DataFrame, size: float = 1.0, cluster_size: float = 0.2) -> dict[str, DataFrame]:
    """Three samples of a frame: for clustering, for the map, and of the map sample for registration."""
    keep = ("frame_id", "point_idx", "x", "y", "z", "label")
    for_map = voxel_first(points, 0.5 * size).select(*keep)
    return {"cluster": voxel_first(points, cluster_size).select(*keep), "map": for_map, "source": voxel_first(for_map, 1.5 * size).select(*keep)}


def voxel_cap(points: DataFrame, size: float, cap: int = 20, keys: tuple[str, ...] = (), order: tuple[str, ...] = ("frame_id", "point_idx")) -> DataFrame:
    """At most ``cap`` points of each voxel, the first ones in ``order``, numbered by ``slot``.

    The number is compared as it is, so each task keeps ``cap`` rows a voxel before the shuffle.
    """
    w = Window.partitionBy(*keys, *CELL).orderBy(*order)
    return with_voxel(points, size).withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= cap).withColumn("slot", F.col("slot") - 1)


def voxel_buckets(capped: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Voxels with their bounded list of points."""
    point = F.struct("slot", "x", "y", "z", "label")
    return capped.groupBy(*keys, *CELL).agg(F.array_sort(F.collect_list(point)).alias("points"))


def voxel_dump(buckets: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Flatten voxels to points again."""
    return buckets.select(*keys, *CELL, F.explode("points").alias("p")).select(*keys, *CELL, "p.*")


def drop_far_voxels(capped: DataFrame, origin: tuple[float, float, float], most: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Drop voxels whose first point is farther than ``most`` from the origin."""
    at = tuple(F.lit(float(v)) for v in origin)
    w = Window.partitionBy(*keys, *CELL).orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = tuple(F.first(c).over(w) for c in "xyz")
    return capped.withColumn("_d2", G.square_distance(first, at)).where(F.col("_d2") <= most * most).drop("_d2")


def transform(points: DataFrame, poses: DataFrame, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Points in the frame of their pose ``m``; labels and all other columns stay."""
    moved = points.join(poses.select(*keys, "m"), list(keys))
    return moved.withColumns(dict(zip("xyz", G.apply_pose(F.col("m"), G.xyz())))).drop("m")


def sweep_time(points: DataFrame, beams: int = 64, columns: int = 1024) -> DataFrame:
    """Synthetic time in the sweep; 1 for every point of a frame that is not complete."""
    n = F.count(F.lit(1)).over(Window.partitionBy("frame_id"))
    t = F.floor(F.col("point_idx") / beams).cast("double") / columns
    return points.withColumn("t", F.when(n == beams * columns, t).otherwise(F.lit(1.0)))


def normalise_time(points: DataFrame) -> DataFrame:
    """Times over the largest of their frame, unless that is below 1."""
    top = F.max("t").over(Window.partitionBy("frame_id"))
    return points.withColumn("t", F.when(top < 1, F.col("t")).otherwise(F.col("t") / top))


def label_histogram(values: DataFrame, column: str, more_than: int = 10, keys: tuple[str, ...] = ()) -> DataFrame:
    """Values that occur more than ``more_than`` times, most frequent first, within ``keys``."""
    counted = values.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)
    return counted.orderBy(*keys, F.desc("n"), column)
