"""Back end: loops between keyframes, their verification, pose graph, global map."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.operators import descriptors as D
from voxloom.operators import graph_map as M
from voxloom.operators import matching as K
from voxloom.operators import scene_graph as S
from voxloom.operators import solvers as N
from voxloom.operators.trajectory import keyframes, relative_motion
from voxloom.plans.scratch import cut, spread

ODOM_ROT, ODOM_TRANS, LOOP = 1e-6, 1e-4, 0.1
FARTHEST = 15.0


def aligned(matches: DataFrame) -> DataFrame:
    """(pair, m, rmse): least-squares motion of x, y, z onto tx, ty, tz in each pair."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[["x", "y", "z"]].to_numpy(), g[["tx", "ty", "tz"]].to_numpy()
        m = N.rigid_alignment(a, b)
        return pd.DataFrame({"pair": [g.pair.iloc[0]], "m": [N.to_row(m)], "rmse": [float(np.sqrt(((N.moved(m, a) - b) ** 2).sum(axis=1).mean()))]})

    return matches.groupBy("pair").applyInPandas(run, "pair long, m array<double>, rmse double")


def consensus_by_pair(matches: DataFrame, left: DataFrame, right: DataFrame, mode: str = "graph", iterations: int | None = 500, seed: int = 1, least: int = 1) -> DataFrame:
    """(pair, m, score, inliers) by seeded consensus over each pair's matches, over every three of them without ``iterations``; one group is one graph pair, of ``least`` matches or more."""
    side = lambda df, name: df.groupBy("pair").agg(F.array_sort(F.collect_list(F.array("x", "y", "z"))).alias(name))
    points = F.array_sort(F.collect_list(F.struct(F.col("i"), F.array("x", "y", "z").alias("p"), F.array("tx", "ty", "tz").alias("q"))))
    rows = matches.groupBy("pair").agg(points.alias("matches")).where(F.size("matches") >= least).join(side(left, "n1"), "pair").join(side(right, "n2"), "pair")

    def run(batches):
        for g in batches:
            out = []
            for r in g.itertuples():
                p = np.array([x["p"] for x in r.matches], dtype=float).reshape(-1, 3)
                q = np.array([x["q"] for x in r.matches], dtype=float).reshape(-1, 3)
                n1, n2 = (np.array([list(v) for v in x], dtype=float) for x in (r.n1, r.n2))
                m, score, inliers = N.consensus(p, q, iterations, seed + int(r.pair), mode, n1, n2)
                out.append((r.pair, N.to_row(m), score, inliers))
            yield pd.DataFrame(out, columns=["pair", "m", "score", "inliers"])

    return spread(rows, "pair").mapInPandas(run, "pair long, m array<double>, score double, inliers long")


def relocalize(consensus: DataFrame, least: float = 0.43) -> DataFrame:
    """Pairs whose inlier ratio is above ``least``."""
    return consensus.withColumn("found", F.col("score") > least)


def register_pairs(points: DataFrame, pairs: DataFrame, kind: str = "points", guess: DataFrame | None = None) -> DataFrame:
    """(q, c, m): ICP of scan q onto scan c; each pair is one task's work on two scans.

    ``points`` is point to point in voxels of 1 m and 5 points, at most 0.5 m
    apart; ``planes`` is point to plane.  ``guess`` gives m by (q, c).
    """
    cloud = lambda name: points.select(F.col("frame_id").alias(name), F.struct("point_idx", "x", "y", "z").alias("p"))
    both = pairs.join(cloud("q"), "q").select("q", "c", F.lit(0).alias("side"), "p.*")
    both = both.unionByName(pairs.join(cloud("c"), "c").select("q", "c", F.lit(1).alias("side"), "p.*"))
    unit = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)])
    both = both.withColumn("m0", unit) if guess is None else both.join(guess.select("q", "c", F.col("m").alias("m0")), ["q", "c"])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("point_idx")
        xyz = g[["x", "y", "z"]].to_numpy()
        source, target = xyz[(g.side == 0).to_numpy()], xyz[(g.side == 1).to_numpy()]
        start = N.to_matrix(list(g.m0.iloc[0]))
        if kind == "planes":
            m = N.plane_icp(source, target, start)
        else:
            cells = N.CellMap(1.0, 5)
            cells.add(target)
            m = N.icp(source, cells, start, 0.5, None, most=100)
        return pd.DataFrame({"q": [g.q.iloc[0]], "c": [g.c.iloc[0]], "m": [N.to_row(m)]})

    return spread(both, "q", "c").groupBy("q", "c").applyInPandas(run, "q long, c long, m array<double>")


def _by_pair(df: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Rows of frame ``side`` of each pair, with the pair's number."""
    return df.join(pairs.select("pair", F.col(side).alias("frame_id")), "frame_id").drop("frame_id")


def verify_loops(nodes: DataFrame, points: DataFrame, candidates: DataFrame, refine: bool = True, cells: DataFrame | None = None) -> DataFrame:
    """(q, c, graph_score, back_score, shift, matched, m) of candidates, from the cheap tests to the costly.

    Assignment of nodes, triangle pruning with three matches at least, seeded
    consensus, similarity of label cells, then point and plane ICP.  ``cells``
    are the points' label cells, where they are there already.
    """
    pairs = candidates.select("q", "c").withColumn("pair", F.col("q") * 1_000_000 + F.col("c"))
    # written tables between the steps keep the plans small: each side is used many times
    pairs = cut(pairs, "pairs")
    described = cut(nodes.join(S.local_descriptors(nodes).withColumnRenamed("v", "desc"), ["frame_id", "node_id"]), "described")
    left, right = cut(_by_pair(described, pairs, "q"), "left"), cut(_by_pair(described, pairs, "c"), "right")
    assigned = cut(K.assign(spread(K.costs(left, right), "pair")), "assigned")
    matched = cut(K.prune(assigned, left, right).select("pair", "i", "j"), "matched")
    at = lambda df, node, names: df.select("pair", F.col("node_id").alias(node), *[F.col("c" + c).alias(n) for c, n in zip("xyz", names)])
    rows = matched.join(at(left, "i", "xyz"), ["pair", "i"]).join(at(right, "j", ("tx", "ty", "tz")), ["pair", "j"])
    # the query's nodes that are matched: as few as a frame's objects
    enough = rows.groupBy("pair").agg(F.array_sort(F.collect_list("i")).alias("matched")).where(F.size("matched") >= 3)
    rows = rows.join(enough.select("pair"), "pair")
    cloud = lambda df: df.select("pair", *[F.col("c" + c).alias(c) for c in "xyz"])
    found = consensus_by_pair(rows, cloud(left), cloud(right), "graph", 200)
    similar = D.cell_similarity(D.label_cells(points) if cells is None else cells, pairs.select(F.col("q").alias("a"), F.col("c").alias("b")))
    out = pairs.join(found, "pair").join(enough, "pair").join(similar.select(F.col("a").alias("q"), F.col("b").alias("c"), F.col("similarity").alias("back_score")), ["q", "c"])
    out = cut(out.select("q", "c", F.col("score").alias("graph_score"), "back_score", G.translation_norm(F.col("m")).alias("shift"), "matched", "m"), "verified")
    return refined(points, out) if refine else out


def refined(points: DataFrame, verified: DataFrame) -> DataFrame:
    """Verified loops with m by point, then plane ICP from the consensus' motion."""
    coarse = cut(register_pairs(points, verified.select("q", "c"), "points", verified), "coarse")
    fine = register_pairs(points, coarse.select("q", "c"), "planes", coarse)
    return verified.drop("m").join(fine, ["q", "c"])


def passing(verified: DataFrame, graph: float = 0.5, back: float = 0.58, farthest: float = FARTHEST) -> DataFrame:
    """Loops over both scores and near enough; an unknown score rejects."""
    return verified.where((F.col("graph_score") >= graph) & (F.col("back_score") >= back) & (F.col("shift") <= farthest))


def search_loops(nodes: DataFrame, points: DataFrame, every: int = 5, gap: int = 30, k: int = 5, within: float = 0.1, sequences: DataFrame | None = None, **gates: float) -> DataFrame:
    """(query_frame, match_frame, rel, matched): for each keyframe its first candidate, by rank, that passes.

    With ``sequences``, rows (seq_id, frame_id), loops are searched within a
    sequence and the result has its seq_id; frame ids are unique over all.
    """
    desc = keyframes(D.scan_descriptors(nodes, points), every)
    desc = desc if sequences is None else desc.join(sequences, "frame_id")
    keys = [] if sequences is None else ["seq_id"]
    near = K.loop_candidates(cut(desc.select(*keys, "kf_seq", "desc"), "desc"), k, gap, within)
    near = cut(near.select(*keys, (F.col("q") * every).alias("q"), (F.col("c") * every).alias("c"), "rank"), "near")
    # most keyframes are settled by their first candidate; the gates do not ask for ICP, so only the loops taken are refined
    cells = cut(D.label_cells(points), "cells")
    best = _first_passing(nodes, points, near.where("rank = 1"), cells, gates)
    rest = cut(near.where("rank > 1").join(best.select("q"), "q", "left_anti"), "rest")
    if not rest.isEmpty():
        best = best.unionByName(_first_passing(nodes, points, rest, cells, gates))
    loops = refined(points, best)
    loops = loops if sequences is None else loops.join(sequences.select("seq_id", F.col("frame_id").alias("q")), "q")
    return loops.select(*keys, F.col("q").alias("query_frame"), F.col("c").alias("match_frame"), F.col("m").alias("rel"), "matched")


def _first_passing(nodes: DataFrame, points: DataFrame, near: DataFrame, cells: DataFrame, gates: dict[str, float]) -> DataFrame:
    """(q, c, m, matched): for each q of (q, c, rank) the first candidate that passes, not refined."""
    good = passing(verify_loops(nodes, points, near, refine=False, cells=cells), **gates).join(near, ["q", "c"])
    best = good.groupBy("q").agg(F.min_by(F.struct("c", "m", "matched"), "rank").alias("b"))
    return cut(best.select("q", "b.*"), "passed")


def back_end(points: DataFrame, nodes: DataFrame, front: DataFrame, every: int = 5, gap: int = 30, within: float = 0.1, look_back: int = 29, **gates: float) -> dict[str, DataFrame]:
    """Keyframes, loop search, pose graph and global map, from what the front end gave.

    points and nodes have frame_id, which is unique over the sequences; front
    has seq_id, frame_id, m and ``new``, the nodes that entered the map.
    Returns ``loops``, the optimised ``poses``, and ``graph``, the rows of
    global_graph over the new objects; those that a loop matched with earlier
    ones are no second instance and stay out of it.  All poses are optimised at
    once, as the graph that is solved step by step ends there.
    """
    front = cut(front.select("seq_id", "frame_id", "m", "new"), "front")
    loops = cut(search_loops(nodes, points, every, gap, within=within, sequences=front.select("seq_id", "frame_id"), **gates), "loops")
    poses = cut(optimise(front, loops), "poses")
    fresh = front.select("seq_id", "frame_id", F.explode("new").alias("node_id"))
    seen = loops.select(F.col("query_frame").alias("frame_id"), F.explode("matched").alias("node_id"))
    fresh = M.unseen(fresh, seen)
    graph = global_graph(nodes.join(fresh, ["frame_id", "node_id"]), poses, back=look_back)
    return {"loops": loops, "poses": poses, "graph": graph}


def factors(poses: DataFrame, loops: DataFrame | None) -> DataFrame:
    """(seq_id, kind, src, dst, rel, var_rot, var_trans): a prior on the first pose, odometry, loops, a sequence each.

    ``loops`` has seq_id, query_frame, match_frame and rel.
    """
    row = lambda kind, src, dst, rel, r, t: ["seq_id", F.lit(kind).alias("kind"), src.cast("long").alias("src"), dst.cast("long").alias("dst"), rel.alias("rel"), F.lit(r).alias("var_rot"), F.lit(t).alias("var_trans")]
    first = poses.groupBy("seq_id").agg(F.min("frame_id").alias("dst"), F.min_by("m", "frame_id").alias("m"))
    out = first.select(*row("prior", F.lit(None), F.col("dst"), F.col("m"), ODOM_ROT, ODOM_TRANS))
    out = out.unionByName(relative_motion(poses).select(*row("odom", F.col("src"), F.col("dst"), F.col("rel"), ODOM_ROT, ODOM_TRANS)))
    if loops is not None:
        # rel moves the query scan onto the match scan
        out = out.unionByName(loops.select(*row("loop", F.col("match_frame"), F.col("query_frame"), F.col("rel"), LOOP, LOOP)))
    return out


def optimise(poses: DataFrame, loops: DataFrame | None, rounds: int = 20) -> DataFrame:
    """Optimised (seq_id, frame_id, m).  The graph of one sequence is one task's work, as its solve is sequential."""
    edges = factors(poses, loops)
    nodes = poses.select("seq_id", "frame_id", "m")
    packed = F.struct("kind", "src", "dst", "rel", "var_rot", "var_trans")
    whole = edges.groupBy("seq_id").agg(F.collect_list(packed).alias("factors"))
    by_seq = nodes.groupBy("seq_id").agg(F.array_sort(F.collect_list(F.struct("frame_id", "m"))).alias("poses"))

    def run(batches):
        for g in batches:
            out = []
            for r in g.itertuples():
                ids = [p["frame_id"] for p in r.poses]
                at = {f: k for k, f in enumerate(ids)}
                x = np.array([N.to_matrix(list(p["m"])) for p in r.poses])
                fs = [
                    (-1 if f["src"] is None else at[f["src"]], at[f["dst"]], N.to_matrix(list(f["rel"])), f["var_rot"], f["var_trans"], 1.0 if f["kind"] == "loop" else None)
                    for f in r.factors
                    if f["dst"] in at and (f["src"] is None or f["src"] in at)
                ]
                x = N.optimise_poses(x, fs, rounds)
                out += [(r.seq_id, f, N.to_row(m)) for f, m in zip(ids, x)]
            yield pd.DataFrame(out, columns=["seq_id", "frame_id", "m"])

    return by_seq.join(whole, "seq_id").mapInPandas(run, "seq_id string, frame_id long, m array<double>")


def global_graph(nodes: DataFrame, poses: DataFrame, last: int | None = None, back: int = 29) -> DataFrame:
    """Global node rows and edges by number, of each sequence: (kind, src, dst, x, y, z, label), with seq_id if nodes have it."""
    seq = ["seq_id"] if "seq_id" in nodes.columns else []
    # a frame's nodes are numbered without gaps
    w = Window.partitionBy("frame_id").orderBy("node_id")
    numbered = nodes.withColumn("node_id", F.row_number().over(w) - 1)
    placed = M.place(numbered, poses, last).join(M.node_offsets(numbered).select("frame_id", "base"), "frame_id")
    placed = cut(placed.withColumn("id", F.col("base") + F.col("node_id")), "placed")
    both = M.edges_to_earlier(placed, back).unionByName(M.edges_within(placed))
    ids = placed.select(*seq, "frame_id", "node_id", "id")
    a = ids.select(*[F.col(c).alias("sa") for c in seq], F.col("frame_id").alias("fa"), F.col("node_id").alias("na"), F.col("id").alias("src"))
    b = ids.select(*seq, F.col("frame_id").alias("fb"), F.col("node_id").alias("nb"), F.col("id").alias("dst"))
    edges = both.join(a, ["fa", "na"]).join(b, ["fb", "nb"])
    edges = edges.where("sa = seq_id") if seq else edges
    none = [F.lit(None).cast("double").alias(c) for c in "xyz"]
    rows = placed.select(*seq, F.lit("node").alias("kind"), F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), "x", "y", "z", "label")
    return rows.unionByName(edges.select(*seq, F.lit("edge").alias("kind"), "src", "dst", *none, F.lit(None).cast("int").alias("label")))
