"""Scene graph of one frame or one local map on arrays, its matches, and the map of object instances as state."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from voxloom.operators.scene_graph import BINS, CLASSES, EDGE, SUBGRAPH, spectral
from voxloom.operators.solvers import consensus, moved

SAME = 0.3  # metres within which sides of triangles are equal


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))


@dataclass
class SceneGraph:
    """Nodes of one frame or map; descriptors and triangles are made on first use."""

    label: np.ndarray
    at: np.ndarray
    size: np.ndarray
    points: np.ndarray
    _made: tuple | None = None

    @staticmethod
    def empty() -> SceneGraph:
        return SceneGraph(np.empty(0, dtype=int), np.empty((0, 3)), np.empty((0, 3)), np.empty(0, dtype=int))

    def described(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Local histogram and spectral columns of each node, and the sorted sides of its triangles."""
        if self._made is None:
            d = _distances(self.at, self.at)
            near = d < EDGE
            i, j = np.nonzero(near)
            hist = np.zeros((len(d), CLASSES * BINS))
            np.add.at(hist, (i, (self.label[j] - 1) * BINS + (d[i, j] // (EDGE / BINS)).astype(int)), 1)
            hist /= np.maximum(np.linalg.norm(hist, axis=1, keepdims=True), 1e-12)
            desc = np.concatenate([hist, spectral(near.astype(float))], axis=1) if len(d) else np.empty((0, CLASSES * BINS))
            self._made = desc.astype(np.float32), [self._triangles(d, k) for k in range(len(d))]
        return self._made

    def _triangles(self, d: np.ndarray, k: int) -> np.ndarray:
        close = np.flatnonzero((d[k] < SUBGRAPH) & (d[k] > 0))
        if len(close) < 3:
            return np.empty((0, 3))
        a, b = np.triu_indices(len(close), 1)
        return np.sort(np.column_stack([d[k, close[a]], d[k, close[b]], d[close[a], close[b]]]).astype(np.float32).astype(float), axis=1)


def triangles_agree(a: np.ndarray, b: np.ndarray) -> bool:
    """True for two sets of fewer than 2; else 3 hits if both have more than 5, 1 otherwise."""
    if len(a) < 2 and len(b) < 2:
        return True
    if not len(a) or not len(b):
        return False
    hits = int((np.abs(a[:, None] - b[None]) < SAME).all(axis=2).sum())
    return hits >= (3 if len(a) > 5 and len(b) > 5 else 1)


def matches(frame: SceneGraph, known: SceneGraph, k: int = 5) -> dict[int, int]:
    """For each node of the frame the first of its k nearest in the map that has its label and agreeing triangles."""
    if not len(known.label) or not len(frame.label):
        return {}
    (desc, tri), (mine, tri_of) = frame.described(), known.described()
    d = ((desc[:, None].astype(float) - mine[None]) ** 2).sum(axis=2)
    out: dict[int, int] = {}
    for i, row in enumerate(d):
        for j in np.argsort(row, kind="stable")[:k].tolist():
            if frame.label[i] == known.label[j] and triangles_agree(tri[i], tri_of[j]):
                out[i] = j
                break
    return out


def relocalise(frame: SceneGraph, known: SceneGraph, pairs: dict[int, int], least: float, seed: int, iterations: int = 500) -> np.ndarray | None:
    """The frame's pose in the map by consensus of more than three matches, None if too few objects fall into place."""
    if len(pairs) <= 3:
        return None
    i, j = np.array(list(pairs)), np.array(list(pairs.values()))
    pose, score, _ = consensus(frame.at[i], known.at[j], iterations, seed, "graph", frame.at, known.at)
    return pose if score > least else None


def worthy(g: SceneGraph) -> np.ndarray:
    """Nodes good enough to enter a map: vehicles of 50 points and 1 m each way, others 1 m high."""
    vehicle = (g.points >= 50) & (g.size >= 1).all(axis=1)
    return np.where(g.label == 1, vehicle, g.size[:, 2] >= 1) if len(g.label) else np.empty(0, dtype=bool)


@dataclass
class InstanceMap:
    """Object instances around the sensor; bounded by ``most`` metres."""

    most: float = 70.0
    radius: float = 2.0
    cell: float = 1.5
    graph: SceneGraph = field(default_factory=SceneGraph.empty)

    def update(self, frame: SceneGraph, pairs: dict[int, int], pose: np.ndarray) -> list[int]:
        """Move matched instances half way, let new ones in, drop far ones; the frame's nodes that were let in."""
        g = self.graph
        world = moved(pose, frame.at) if len(frame.at) else frame.at
        there, there_label = g.at.copy(), g.label
        at, size = g.at.copy(), g.size.copy()
        good, new = worthy(frame), []
        for i in [*pairs, *(i for i in range(len(world)) if i not in pairs)]:
            j = pairs.get(i)
            if j is not None and np.linalg.norm(world[i] - at[j]) < self.radius:
                at[j], size[j] = (at[j] + world[i]) / 2, (size[j] + frame.size[i]) / 2
            elif good[i] and not self._near(there, there_label, world[i], frame.label[i]):
                new.append(i)
        joined = SceneGraph(
            np.concatenate([g.label, frame.label[new]]), np.concatenate([at, world[new]]), np.concatenate([size, frame.size[new]]), np.concatenate([g.points, frame.points[new]])
        )
        keep = ((joined.at - pose[:3, 3]) ** 2).sum(axis=1) <= self.most**2
        self.graph = SceneGraph(joined.label[keep], joined.at[keep], joined.size[keep], joined.points[keep])
        return sorted(new)

    def _near(self, at: np.ndarray, label: np.ndarray, p: np.ndarray, of: int) -> bool:
        """An instance of that label stands in the 27 cells around, closer than the radius."""
        if not len(at):
            return False
        beside = (np.abs(np.trunc(at / self.cell) - np.trunc(p / self.cell)) <= 1).all(axis=1)
        return bool((beside & (label == of) & (np.linalg.norm(at - p, axis=1) < self.radius)).any())
