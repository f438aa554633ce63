"""Scene graphs: edges between the nodes of a frame, node descriptors, triangles.

nodes are (frame_id, node_id, label, cx, cy, cz, dx, dy, dz, points_num);
labels are 1 vehicle, 2 trunk, 3 pole.  Pairs are joined on the frame, so the
distance test is a residual predicate and never a nested loop over all nodes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.functions import geometry as G

EDGE = 60.0
BINS = 30
SUBGRAPH = 20.0
CLASSES = 3
NODE_DIM = 30


def _ends(nodes: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    cols = ("node_id", "label", "cx", "cy", "cz")
    a = nodes.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols])
    b = nodes.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols])
    return a, b


def pairs(nodes: DataFrame, limit: float = EDGE, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """All ordered pairs of a frame's nodes closer than ``limit``, a node with itself included."""
    a, b = _ends(nodes, keys)
    d = G.distance(G.xyz("a_c"), G.xyz("b_c"))
    return a.join(b, list(keys)).withColumn("dist", d).where(F.col("dist") < limit)


def edges(nodes: DataFrame, limit: float = EDGE, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Undirected edges i < j with distance and weight (limit - d) / limit."""
    close = pairs(nodes, limit, keys).where("a_node_id < b_node_id")
    return close.select(
        *keys, F.col("a_node_id").alias("i"), F.col("b_node_id").alias("j"), F.col("a_label").alias("li"), F.col("b_label").alias("lj"), "dist", G.edge_weight(F.col("dist"), limit).alias("weight")
    )


def class_counts(nodes: DataFrame) -> DataFrame:
    count = lambda c: F.count_if(F.col("label") == c)
    return nodes.groupBy("frame_id").agg(count(1).alias("vehicle_num"), count(2).alias("trunk_num"), count(3).alias("pole_num"))


def check_bins(limit: float, bins: int) -> float:
    width = limit / bins
    if width != int(width):
        raise ValueError("the edge limit must be a whole multiple of the number of bins")
    return width


def node_histogram(nodes: DataFrame, limit: float = EDGE, bins: int = BINS, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Non-zero entries (slot, n) of each node's distance x class histogram; a node counts itself in bin 0."""
    width = check_bins(limit, bins)
    slot = (F.col("b_label") - 1) * bins + F.floor(F.col("dist") / width)
    return pairs(nodes, limit, keys).groupBy(*keys, F.col("a_node_id").alias("node_id"), slot.cast("int").alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def dense(sparse: DataFrame, keys: tuple[str, ...], length: int, slot: str = "slot", value: str = "n") -> DataFrame:
    """Sparse entries to an array of ``length``, zero where there is no entry."""
    entries = F.map_from_entries(F.collect_list(F.struct(F.col(slot).cast("int"), F.col(value).cast("double"))))
    held = sparse.groupBy(*keys).agg(entries.alias("_m"))
    array = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0)))
    return held.select(*keys, array.alias("v"))


def local_descriptors(nodes: DataFrame, limit: float = EDGE, bins: int = BINS, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """(frame, node_id, v) with the L2-normalised histogram of CLASSES * bins."""
    rows = dense(node_histogram(nodes, limit, bins, keys), (*keys, "node_id"), CLASSES * bins)
    return rows.withColumn("v", G.l2_normalise(F.col("v")))


def spectral(adjacency: np.ndarray, dim: int = NODE_DIM) -> np.ndarray:
    """Absolute eigenvectors by falling absolute eigenvalue, padded to ``dim`` columns, each row over its sum."""
    values, vectors = np.linalg.eigh(adjacency)
    order = np.argsort(-np.abs(values), kind="stable")[:dim]
    out = np.zeros((len(adjacency), dim))
    out[:, : len(order)] = np.abs(vectors[:, order])
    total = out.sum(axis=1, keepdims=True)
    return np.divide(out, total, out=np.zeros_like(out), where=total > 1e-12)


def _adjacency(g: pd.DataFrame, limit: float) -> np.ndarray:
    c = g[["cx", "cy", "cz"]].to_numpy()
    return (np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2)) < limit).astype(float)


def node_descriptors(nodes: DataFrame, limit: float = EDGE, bins: int = BINS, dim: int = NODE_DIM) -> DataFrame:
    """(frame_id, node_id, desc): local histogram and spectral columns, 120 numbers by default."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("node_id")
        return pd.DataFrame({"frame_id": g.frame_id, "node_id": g.node_id, "s": list(spectral(_adjacency(g, limit), dim))})

    eigen = nodes.groupBy("frame_id").applyInPandas(run, "frame_id long, node_id int, s array<double>")
    both = local_descriptors(nodes, limit, bins).join(eigen, ["frame_id", "node_id"])
    return both.select("frame_id", "node_id", F.concat("v", "s").cast("array<float>").alias("desc"))


def eigenvalues(nodes: DataFrame, limit: float = EDGE) -> DataFrame:
    """Sorted eigenvalues of each frame's adjacency: what is invariant of its spectral columns."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        values = np.linalg.eigvalsh(_adjacency(g, limit))
        return pd.DataFrame({"frame_id": g.frame_id.iloc[:1], "values": [np.sort(-np.abs(values)) * -1]})

    return nodes.groupBy("frame_id").applyInPandas(run, "frame_id long, values array<double>")


def triangles(nodes: DataFrame, limit: float = SUBGRAPH, least: int = 3, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """Sorted side triples (a <= b <= c) of each node with every pair of its neighbours.

    Neighbours are closer than ``limit`` and not at the node's own place; nodes
    with fewer than ``least`` of them have no triangles.
    """
    near = pairs(nodes, limit, keys).where("dist > 0").select(*keys, F.col("a_node_id").alias("node_id"), F.col("b_node_id").alias("m"), F.col("dist").alias("d"), F.col("b_cx").alias("x"), F.col("b_cy").alias("y"), F.col("b_cz").alias("z"))
    enough = near.groupBy(*keys, "node_id").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least).drop("k")
    near = near.join(enough, [*keys, "node_id"])
    other = near.select(*keys, "node_id", *[F.col(c).alias("o" + c) for c in ("m", "d", "x", "y", "z")])
    both = near.join(other, [*keys, "node_id"]).where("m < om")
    sides = F.array_sort(F.transform(F.array("d", "od", G.distance(G.xyz(), G.xyz("o"))), lambda s: s.cast("float").cast("double")))
    return both.select(*keys, "node_id", "m", F.col("om").alias("n"), *[F.element_at(sides, i + 1).alias(c) for i, c in enumerate("abc")])


def triangle_sets(tri: DataFrame, keys: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    return tri.groupBy(*keys, "node_id").agg(F.array_sort(F.collect_list(F.struct("a", "b", "c"))).alias("tri"))


def triangle_hits(t1: Column, t2: Column, within: float = 0.3) -> Column:
    """Pairs of triangles equal within ``within`` on all three sides."""

    def hits(x):
        same = F.filter(t2, lambda y: (F.abs(x["a"] - y["a"]) < within) & (F.abs(x["b"] - y["b"]) < within) & (F.abs(x["c"] - y["c"]) < within))
        return F.size(same)

    return F.aggregate(F.transform(t1, hits), F.lit(0), lambda s, x: s + x)


def triangles_agree(t1: Column, t2: Column, within: float = 0.3) -> Column:
    """True for two sets of fewer than 2; else 3 hits if both have more than 5, 1 otherwise."""
    n1, n2 = F.size(t1), F.size(t2)
    need = F.when((n1 > 5) & (n2 > 5), 3).otherwise(1)
    return ((n1 < 2) & (n2 < 2)) | (triangle_hits(t1, t2, within) >= need)
