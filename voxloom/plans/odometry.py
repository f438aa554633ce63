"""Front end: scans of a sequence to poses, with the map kept as state.

A sequence is sequential by nature, as each pose starts from the ones before,
so the unit of parallelism is the sequence; the same core runs in batch
(one group a sequence) and in a stream (state between micro-batches).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions.labels import FIRST_MOVING, WEIGHT
from voxloom.operators.clustering import objects
from voxloom.operators.local_map import InstanceMap, SceneGraph, matches, relocalise
from voxloom.operators.points import CELL, filter_static, voxel_first, with_voxel
from voxloom.operators.solvers import CellMap, icp, inverse, moved, se3_log, to_row


@dataclass(frozen=True)
class FrontEnd:
    """Defaults are those of the common outdoor set-up."""

    max_range: float = 100.0
    min_range: float = 5.0
    voxel: float = 1.0
    per_voxel: int = 20
    initial_threshold: float = 2.0
    min_motion: float = 0.1
    relocalise: bool = True
    relocalise_trans: float = 0.1
    relocalise_rot: float = 0.01
    relocalise_inliers: float = 0.4


@dataclass
class State:
    """Poses, the adaptive threshold's sums and both local maps of one sequence, and what the last frame did."""

    poses: list[np.ndarray] = field(default_factory=list)
    sum2: float = 0.0
    count: int = 0
    cells: CellMap | None = None
    instances: InstanceMap = field(default_factory=InstanceMap)
    relocated: bool = False
    matched: dict[int, int] = field(default_factory=dict)
    new: list[int] = field(default_factory=list)


def first_of_voxels(p: np.ndarray, size: float) -> np.ndarray:
    """Indexes of the first point of each voxel, in order."""
    _, first = np.unique(np.trunc(p / size).astype(np.int64), axis=0, return_index=True)
    return np.sort(first)


def step(state: State, xyz: np.ndarray, label: np.ndarray, cfg: FrontEnd, graph: SceneGraph | None = None) -> tuple[np.ndarray, float]:
    """Register one scan and update the state: (pose, threshold used).

    With the frame's ``graph`` its objects are matched with the instance map
    first; where the registered pose is far from the expected one, the matches
    give another guess to register from; and the instance map is updated.
    """
    state.cells = state.cells or CellMap(cfg.voxel, cfg.per_voxel)
    r = np.linalg.norm(xyz, axis=1)
    keep = (r > cfg.min_range) & (r < cfg.max_range) & (label < FIRST_MOVING)
    xyz, label = xyz[keep], label[keep]
    at = first_of_voxels(xyz, 0.5 * cfg.voxel) if len(xyz) else np.empty(0, dtype=int)
    for_map, map_label = xyz[at], label[at]
    some = first_of_voxels(for_map, 1.5 * cfg.voxel) if len(for_map) else at
    source, weights = for_map[some], np.array([WEIGHT.get(int(v), 1.0) for v in map_label[some]])
    pairs = matches(graph, state.instances.graph) if graph is not None else {}

    sigma = np.sqrt(state.sum2 / state.count) if state.count else cfg.initial_threshold
    poses = state.poses
    motion = inverse(poses[-2]) @ poses[-1] if len(poses) > 1 else np.eye(4)
    guess = poses[-1] @ motion if poses else np.eye(4)

    def register(start: np.ndarray) -> np.ndarray:
        return icp(source, state.cells, start, 3 * sigma, sigma / 3, weights) if state.cells.cells and len(source) else start

    pose = register(guess)
    off = inverse(guess) @ pose
    state.relocated = False
    if graph is not None and cfg.relocalise and len(poses) > 2:
        if np.linalg.norm(off[:3, 3]) > cfg.relocalise_trans or np.linalg.norm(se3_log(off)[3:]) > cfg.relocalise_rot:
            again = relocalise(graph, state.instances.graph, pairs, cfg.relocalise_inliers, len(poses))
            if again is not None:
                pose, off, state.relocated = register(again), np.eye(4), True
    twist = se3_log(off)
    deviation = np.linalg.norm(off[:3, 3]) + 2 * cfg.max_range * np.sin(np.linalg.norm(twist[3:]) / 2)
    travelled = poses and np.linalg.norm(poses[-1][:3, 3] - poses[0][:3, 3]) > 5 * cfg.min_motion
    if travelled and deviation > cfg.min_motion:
        state.sum2, state.count = state.sum2 + deviation**2, state.count + 1
    state.cells.add(moved(pose, for_map))
    state.cells.drop_far(pose[:3, 3], cfg.max_range)
    state.matched, state.new = pairs, state.instances.update(graph, pairs, pose) if graph is not None else []
    poses.append(pose)
    return pose, float(sigma)


SCHEMA = "seq_id string, frame_id long, m array<double>, sigma double, points long"


def run_frames(state: State, rows: pd.DataFrame, cfg: FrontEnd) -> pd.DataFrame:
    """Register the frames of ``rows`` in order."""
    out = []
    rows = rows.sort_values(["frame_id", "point_idx"])
    for frame, g in rows.groupby("frame_id", sort=True):
        pose, sigma = step(state, g[["x", "y", "z"]].to_numpy(dtype=float), g["label"].to_numpy(), cfg)
        out.append((g.seq_id.iloc[0], int(frame), to_row(pose), sigma, len(g)))
    return pd.DataFrame(out, columns=["seq_id", "frame_id", "m", "sigma", "points"])


def _thinned(points: DataFrame, cfg: FrontEnd) -> DataFrame:
    """The first point of each voxel of half the map's size: no more is needed in Python."""
    if cfg.min_range > cfg.max_range:
        raise ValueError("the least range is above the largest")
    kept = with_voxel(filter_static(points, cfg.min_range, cfg.max_range), 0.5 * cfg.voxel)
    first = [F.min_by(c, "point_idx").alias(c) for c in ("x", "y", "z", "label")]
    return kept.groupBy("seq_id", "frame_id", *CELL).agg(F.min("point_idx").alias("point_idx"), *first).drop(*CELL)


def odometry(points: DataFrame, cfg: FrontEnd = FrontEnd()) -> DataFrame:
    """Poses of each sequence from (seq_id, frame_id, point_idx, x, y, z, label), by points alone."""
    return _thinned(points, cfg).groupBy("seq_id").applyInPandas(lambda g: run_frames(State(), g, cfg), SCHEMA)


def frame_objects(points: DataFrame, cluster_voxel: float = 0.2, cfg: FrontEnd = FrontEnd()) -> DataFrame:
    """Nodes (frame_id, node_id, label, cx..dz, points_num) of every frame, all frames at once.

    ``frame_id`` is unique over the sequences.
    """
    kept = filter_static(points, cfg.min_range, cfg.max_range)
    return objects(voxel_first(kept, cluster_voxel).select("frame_id", "point_idx", "x", "y", "z", "label"))


FRONT = SCHEMA + ", nodes int, matched array<struct<node_id:int,map_id:int>>, new array<int>, relocated boolean, instances int"


def run_front(state: State, rows: pd.DataFrame, nodes: pd.DataFrame, cfg: FrontEnd) -> pd.DataFrame:
    """Register the frames of ``rows`` in order with their objects."""
    by_frame = {f: g.sort_values("node_id") for f, g in nodes.groupby("frame_id")}
    out = []
    for frame, g in rows.sort_values(["frame_id", "point_idx"]).groupby("frame_id", sort=True):
        n = by_frame.get(frame)
        three = lambda c: n[[c + v for v in "xyz"]].to_numpy(dtype=float)
        graph = SceneGraph.empty() if n is None else SceneGraph(n["label"].to_numpy(dtype=int), three("c"), three("d"), n["points_num"].to_numpy(dtype=int))
        pose, sigma = step(state, g[["x", "y", "z"]].to_numpy(dtype=float), g["label"].to_numpy(), cfg, graph)
        pairs = [{"node_id": i, "map_id": j} for i, j in state.matched.items()]
        out.append((g.seq_id.iloc[0], int(frame), to_row(pose), sigma, len(g), len(graph.label), pairs, state.new, state.relocated, len(state.instances.graph.label)))
    return pd.DataFrame(out, columns=[x.strip().split(" ")[0] for x in "seq_id,frame_id,m,sigma,points,nodes,matched,new,relocated,instances".split(",")])


def front_end(points: DataFrame, cfg: FrontEnd = FrontEnd(), nodes: DataFrame | None = None) -> DataFrame:
    """The whole front end, a row a frame: pose, threshold, objects, their matches, the new ones, relocalisation.

    Clusters and objects of all frames are made at once, before the ordered
    part; that takes a sequence's thinned points and its few objects a frame
    together, and carries the point map and the instance map along.
    ``frame_id`` is unique over the sequences.
    """
    found = frame_objects(points, cfg=cfg) if nodes is None else nodes
    thin = _thinned(points, cfg)
    of = points.select(F.col("seq_id").alias("of"), "frame_id").distinct()
    found = found.join(of, "frame_id")
    found = found.select(*[F.col(c).alias(c) for c in found.columns])  # columns of its own, though both sides come from the points
    both = thin.groupBy("seq_id").cogroup(found.groupBy("of"))
    return both.applyInPandas(lambda rows, some: run_front(State(), rows, some, cfg), FRONT)
