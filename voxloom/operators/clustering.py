"""Object clustering on a polar grid, and the objects' boxes.

``canonical`` clusters are the connected components of a frame and class's
occupied cells, whatever the order of points; ``faithful`` follows the
one-pass rule in which points that are already labelled are skipped, so two
clusters that touch only through such points stay apart.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions import geometry as G
from voxloom.functions.labels import node_class

LOW = math.radians(-24.8)
HIGH = math.radians(2.0)
DELTA_A, DELTA_R, DELTA_P = 2.0, 0.5, 2.0
GROUP = ("frame_id", "label")


def _grid(delta_a: float, delta_p: float) -> tuple[int, int]:
    """Layers of elevation and sectors of the polar grid."""
    return int((HIGH - LOW) * 180 / math.pi / delta_a) + 1, round(360 / delta_p)


def with_cells(points: DataFrame, delta_a: float = DELTA_A, delta_r: float = DELTA_R, delta_p: float = DELTA_P) -> DataFrame:
    """Add the cell (ca, cp, cr) and the group's number of range cells (rings)."""
    p = G.xyz()
    ranged = points.withColumn("rho", G.planar_range(p))
    span = Window.partitionBy(*GROUP)
    least = F.min("rho").over(span)
    degrees = 180 / math.pi
    return ranged.withColumns(
        {
            "ca": ((F.atan2("z", "rho") - LOW) * degrees / delta_a).cast("int"),
            "cp": (G.polar_angle(p) * degrees / delta_p).cast("int"),
            "cr": ((F.col("rho") - least) / delta_r).cast("int"),
            "rings": ((F.max("rho").over(span) - least) / delta_r).cast("int") + 1,
        }
    )


def _neighbours(ca: int, cp: int, cr: int, rings: int, height: int, width: int):
    for a in range(ca - 1, ca + 2):
        if 0 <= a < height:
            for r in range(cr - 1, cr + 2):
                if 0 <= r < rings:
                    for p in range(cp - 1, cp + 2):
                        yield a, p % width if 0 <= p < width else (width - 1 if p < 0 else 0), r


def _component_udf(delta_a: float, delta_p: float):
    height, width = _grid(delta_a, delta_p)

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        keys = list(zip(cells.ca, cells.cp, cells.cr))
        at = {k: i for i, k in enumerate(keys)}
        parent = list(range(len(keys)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        seen = np.zeros(len(keys), dtype=bool)
        for i, (a, p, r) in enumerate(keys):
            for other in _neighbours(a, p, r, int(cells.rings.iloc[i]), height, width):
                j = at.get(other)
                if j is not None:
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
                    seen[i] = seen[j] = True
        roots = [root(i) for i in range(len(keys))]
        first = cells.first_idx.groupby(roots).min()
        out = cells[["frame_id", "label", "ca", "cp", "cr"]].copy()
        # cells beyond the grid with no occupied cell in sight: every point stands alone
        out["cluster"] = [int(first[k]) if s else None for k, s in zip(roots, seen)]
        out["cluster"] = out["cluster"].astype("Int64")
        return out

    return run


def cluster(points: DataFrame, delta_a: float = DELTA_A, delta_r: float = DELTA_R, delta_p: float = DELTA_P, mode: str = "canonical") -> DataFrame:
    """Add ``cluster``: the least point_idx of the point's cluster, within its frame and class.

    Only occupied cells reach Python, a frame and class at a time; points join
    their cell's component on the same keys.
    """
    celled = with_cells(points, delta_a, delta_r, delta_p)
    if mode == "faithful":
        schema = T.StructType([*points.schema.fields, T.StructField("cluster", T.LongType())])
        names = points.columns
        return celled.groupBy(*GROUP).applyInPandas(lambda g: _one_pass(g, delta_a, delta_p)[[*names, "cluster"]], schema)
    if mode != "canonical":
        raise ValueError(f"no mode {mode}")
    cells = celled.groupBy(*GROUP, "ca", "cp", "cr", "rings").agg(F.min("point_idx").alias("first_idx"))
    schema = "frame_id long, label int, ca int, cp int, cr int, cluster long"
    named = cells.groupBy(*GROUP).applyInPandas(_component_udf(delta_a, delta_p), schema)
    out = celled.join(named, [*GROUP, "ca", "cp", "cr"])
    return out.select(*points.columns, F.coalesce("cluster", "point_idx").alias("cluster"))


def _one_pass(group: pd.DataFrame, delta_a: float, delta_p: float) -> pd.DataFrame:
    """The order-dependent rule: a point takes or merges the clusters it sees, unless it has one already."""
    height, width = _grid(delta_a, delta_p)
    g = group.sort_values("point_idx").reset_index(drop=True)
    cells = list(zip(g.ca, g.cp, g.cr))
    inside: dict[tuple, list[int]] = {}
    for i, c in enumerate(cells):
        inside.setdefault(c, []).append(i)
    rings = int(g.rings.iloc[0])
    own = np.full(len(g), -1)
    made = 0
    for i, c in enumerate(cells):
        if own[i] >= 0:
            continue
        seen = [j for n in _neighbours(*c, rings, height, width) for j in inside.get(n, ())]
        for j in seen:
            if own[i] >= 0 and own[j] >= 0:
                if own[i] != own[j]:
                    own[own == own[i]] = own[j]
            elif own[j] >= 0:
                own[i] = own[j]
            elif own[i] >= 0:
                own[j] = own[i]
        if own[i] < 0:
            own[[i, *seen]] = made
            made += 1
    first = g.point_idx.groupby(own).min()
    g["cluster"] = first.loc[own].to_numpy()
    return g


def boxes(clustered: DataFrame, least_points: int = 10) -> DataFrame:
    """Axis-aligned boxes of clusters with enough points: centre, dimension, points_num, node class."""
    ends = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    agg = clustered.groupBy(*GROUP, "cluster").agg(*ends, F.count(F.lit(1)).alias("points_num")).where(F.col("points_num") >= least_points)
    centre = {f"c{c}": (F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2 for c in "xyz"}
    size = {f"d{c}": F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "xyz"}
    out = agg.withColumns({**centre, **size, "train": F.col("label"), "node_label": node_class(F.col("label"))})
    return out.select("frame_id", "train", "cluster", F.col("node_label").alias("label"), *centre, *size, "points_num")


def filter_box_size(nodes: DataFrame) -> DataFrame:
    """Vehicles of 0.5 x 0.5 x 0.3 at least; trunks and poles 0.3 high."""
    vehicle = (F.col("label") == 1) & (F.col("dx") >= 0.5) & (F.col("dy") >= 0.5) & (F.col("dz") >= 0.3)
    return nodes.where(vehicle | ((F.col("label") != 1) & (F.col("dz") >= 0.3)))


def filter_new_instance(nodes: DataFrame) -> DataFrame:
    """Nodes good enough to enter a map: vehicles of 50 points and 1 m each way, others 1 m high."""
    vehicle = (F.col("label") == 1) & (F.col("points_num") >= 50) & (F.col("dx") >= 1) & (F.col("dy") >= 1) & (F.col("dz") >= 1)
    return nodes.where(vehicle | ((F.col("label") != 1) & (F.col("dz") >= 1)))


def objects(points: DataFrame, mode: str = "canonical", **deltas: float) -> DataFrame:
    """Nodes (frame_id, node_id, label, cx..dz, points_num) of the foreground points.

    node_id counts from 0 within a frame, by train class and first point.
    """
    from voxloom.operators.points import foreground

    found = filter_box_size(boxes(cluster(foreground(points), mode=mode, **deltas)))
    w = Window.partitionBy("frame_id").orderBy("train", "cluster")
    out = found.withColumn("node_id", F.row_number().over(w) - 1)
    return out.select("frame_id", "node_id", "label", "cx", "cy", "cz", "dx", "dy", "dz", F.col("points_num").cast("int").alias("points_num"))
