"""Node matching between scene graphs: descriptor neighbours, assignment, triangle pruning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.operators import scene_graph as S
from voxloom.operators.solvers import assignment

FEW_MATCHES = 15
BLOCK = 2048


def _least(d: np.ndarray, seq: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least distances, ties by sequence number."""
    some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    return some[np.lexsort((seq[some], d[some]))][:k]


def loop_candidates(keyframes: DataFrame, k: int = 5, gap: int = 30, within: float | None = None) -> DataFrame:
    """(q, c, d, rank): the k nearest keyframes at least ``gap`` before each (kf_seq, desc); squared distance.

    Only real neighbours come back, and with ``within`` only those not above it.
    Exact search in blocks: runs of BLOCK keyframes meet pairwise, a pair is
    one task's matrix work and returns k rows a query at most.  So nothing is
    broadcast, and no pair of keyframes becomes a row.  Keyframes with a
    ``seq_id`` are searched within their sequence, and the result has it.
    """
    keys = ["seq_id"] if "seq_id" in keyframes.columns else []
    rows = keyframes.select(*keys, F.col("kf_seq").cast("long").alias("s"), F.col("desc").cast("array<double>").alias("v"))
    last = rows.agg(F.max("s")).first()[0] or 0
    own = F.floor(F.col("s") / BLOCK).cast("int")
    top = last // BLOCK
    queries = rows.withColumns({"side": F.lit(0), "i": own, "j": F.explode(F.sequence(F.lit(0), own))})
    corpus = rows.withColumns({"side": F.lit(1), "j": own, "i": F.explode(F.sequence(own, F.lit(int(top))))})

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("s")
        q, c = g[g.side == 0], g[g.side == 1]
        out: list[tuple[int, int, float]] = []
        if len(q) and len(c):
            seq, table = c.s.to_numpy(), np.stack(c.v.to_numpy())
            for s, v in zip(q.s.to_numpy(), q.v.to_numpy()):
                n = int(np.searchsorted(seq, s - gap, side="right"))
                if n:
                    d = ((table[:n] - v) ** 2).sum(axis=1)
                    best = np.lexsort((seq[:n], d))[:k] if n <= 4 * k else _least(d, seq[:n], k)
                    out += [(int(s), int(seq[b]), float(d[b])) for b in best]
        found = pd.DataFrame(out, columns=["q", "c", "d"])
        return found.assign(seq_id=g.seq_id.iloc[0]) if keys else found

    schema = "q long, c long, d double" + (", seq_id string" if keys else "")
    pairs = queries.unionByName(corpus).groupBy(*keys, "i", "j").applyInPandas(run, schema)
    w = Window.partitionBy(*keys, "q").orderBy("d", "c")
    out = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out if within is None else out.where(F.col("d") <= within)


def node_matches(frame_nodes: DataFrame, map_nodes: DataFrame, k: int = 5) -> DataFrame:
    """(frame_id, node_id, map_id): for each node the first of its k nearest map nodes by descriptor that
    has its label and agreeing triangles.

    Frames have node_id, label, desc and tri; both sides are keyed by frame_id,
    the map's being the map as it is when the frame arrives.
    """
    q = frame_nodes.select("frame_id", "node_id", F.col("label").alias("ql"), F.col("desc").alias("qv"), F.col("tri").alias("qt"))
    m = map_nodes.select("frame_id", F.col("node_id").alias("map_id"), F.col("label").alias("ml"), F.col("desc").alias("mv"), F.col("tri").alias("mt"))
    pairs = q.join(m, "frame_id").withColumn("d", G.l2_distance(F.col("qv"), F.col("mv")))
    w = Window.partitionBy("frame_id", "node_id").orderBy("d", "map_id")
    near = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    good = near.where((F.col("ql") == F.col("ml")) & S.triangles_agree(F.col("qt"), F.col("mt")))
    return good.groupBy("frame_id", "node_id").agg(F.min_by("map_id", "rank").alias("map_id"))


def match_status(frame_nodes: DataFrame, matches: DataFrame) -> DataFrame:
    """Every node with ``matched`` and its map_id, null where there is none."""
    out = frame_nodes.select("frame_id", "node_id").join(matches, ["frame_id", "node_id"], "left")
    return out.select("frame_id", F.col("map_id").isNotNull().alias("matched"), "node_id", "map_id")


def costs(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("pair",), most: float = 0.5, size: float = 2.0) -> DataFrame:
    """(pair, i, j, cost): 1 - cosine of descriptors for node pairs of one label and similar size.

    Costs are compared at 9 places, so rounding errors decide nothing.
    """
    cols = ("node_id", "label", "desc", "dx", "dy", "dz")
    a = left.select(*keys, *[F.col(c).alias("a_" + c) for c in cols])
    b = right.select(*keys, *[F.col(c).alias("b_" + c) for c in cols])
    both = a.join(b.withColumnRenamed("b_label", "a_label"), [*keys, "a_label"])
    for c in ("dx", "dy", "dz"):
        both = both.where(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= size)
    out = both.withColumn("cost", 1 - G.cosine_similarity(F.col("a_desc"), F.col("b_desc")))
    out = out.where(F.round("cost", 9).between(0, most)).withColumn("cost", F.greatest("cost", F.lit(0.0)))
    return out.select(*keys, F.col("a_node_id").alias("i"), F.col("b_node_id").alias("j"), "cost")


def assign(cost_rows: DataFrame, key: str = "pair") -> DataFrame:
    """The one-to-one assignment of least total cost within each pair of graphs; one group is one graph pair."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        rows, cols = np.unique(g.i), np.unique(g.j)
        matrix = np.full((len(rows), len(cols)), 1e8)
        at = (np.searchsorted(rows, g.i), np.searchsorted(cols, g.j))
        matrix[at] = np.round(g.cost, 9)
        taken = assignment(matrix)
        good = [(r, c) for r, c in enumerate(taken) if c >= 0 and matrix[r, c] < 1e8]
        return pd.DataFrame({key: [g[key].iloc[0]] * len(good), "i": [rows[r] for r, _ in good], "j": [cols[c] for _, c in good], "cost": [matrix[r, c] for r, c in good]})

    kind = dict(cost_rows.dtypes)[key]
    return cost_rows.select(key, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "cost").groupBy(key).applyInPandas(run, f"{key} {kind}, i int, j int, cost double")


def prune(matches: DataFrame, left: DataFrame, right: DataFrame, key: str = "pair") -> DataFrame:
    """Matches (pair, i, j) whose neighbour triangles agree on both sides.

    Fewer than FEW_MATCHES matches pass as they are.  Else both nodes need two
    neighbours, and one agreeing triangle, or two if both have more than three.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    counted = matches.withColumn("_n", n)

    def side(nodes: DataFrame, node: str, name: str) -> DataFrame:
        tri = S.triangles(nodes, least=2, keys=(key,))
        sets = S.triangle_sets(tri, (key,)).withColumnRenamed("tri", name)
        near = S.pairs(nodes, S.SUBGRAPH, (key,)).where("dist > 0").groupBy(key, F.col("a_node_id").alias("node_id")).agg(F.count(F.lit(1)).alias("k" + name))
        return sets.join(near, [key, "node_id"]).withColumnRenamed("node_id", node)

    checked = counted.where(F.col("_n") >= FEW_MATCHES).join(side(left, "i", "t1"), [key, "i"]).join(side(right, "j", "t2"), [key, "j"])
    need = F.when((F.col("kt1") > 3) & (F.col("kt2") > 3), 2).otherwise(1)
    good = checked.where(S.triangle_hits(F.col("t1"), F.col("t2")) >= need)
    return counted.where(F.col("_n") < FEW_MATCHES).select(*matches.columns).unionByName(good.select(*matches.columns))
