"""Registration as relations: correspondences, normal equations, moments, one ICP step."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.functions.labels import semantic_weight
from voxloom.operators.nearest import nearest_in_cells
from voxloom.operators.solvers import se3_exp, solve_step, to_row

CELL = ("vx", "vy", "vz")


def correspondences(points: DataFrame, map_points: DataFrame, size: float = 1.0, within: float = 6.0, keys: tuple[str, ...] = ()) -> DataFrame:
    return nearest_in_cells(points, map_points, size, within, keys)


def normal_equations(pairs: DataFrame, th: float | None, weighted: bool = True, keys: tuple[str, ...] = ()) -> DataFrame:
    """21 sums a_ij of J'wJ and 6 sums b_i of J'wr in one aggregate.

    The robust weight acts on both, the label's weight on the right side only.
    Pairs have x, y, z, label and tx, ty, tz.
    """
    x, y, z = (F.col(c) for c in "xyz")
    r = [F.col(c) - F.col("t" + c) for c in "xyz"]
    w = F.lit(1.0) if th is None else G.robust_weight(r[0] * r[0] + r[1] * r[1] + r[2] * r[2], th)
    s = semantic_weight(F.col("label")) if weighted else F.lit(1.0)
    zero, one = F.lit(0.0), F.lit(1.0)
    j = [[one, zero, zero, zero, z, -y], [zero, one, zero, -z, zero, x], [zero, zero, one, y, -x, zero]]
    rows = pairs.withColumns({"_w": w, "_s": s})
    lefts = [F.sum(F.col("_w") * sum(j[k][a] * j[k][b] for k in range(3))).alias(f"a{a}{b}") for a in range(6) for b in range(a, 6)]
    rights = [F.sum(F.col("_w") * F.col("_s") * sum(j[k][a] * r[k] for k in range(3))).alias(f"b{a}") for a in range(6)]
    return rows.groupBy(*keys).agg(*lefts, *rights, F.count(F.lit(1)).alias("n"))


def _motion(row) -> np.ndarray:
    left = np.zeros((6, 6))
    for a in range(6):
        for b in range(a, 6):
            left[a, b] = left[b, a] = row[f"a{a}{b}"] or 0.0
    return se3_exp(solve_step(left, np.array([row[f"b{a}"] or 0.0 for a in range(6)])))


def icp_steps(points: DataFrame, map_points: DataFrame, th: float, key: str, size: float = 1.0, within: float = 6.0) -> DataFrame:
    """(key, n, m): one registration step for each ``key``; a 6 x 6 system a row is all that Python sees."""
    sums = normal_equations(correspondences(points, map_points, size, within, (key,)), th, keys=(key,))

    def run(batches):
        for g in batches:
            yield g[[key, "n"]].assign(m=[to_row(_motion(r)) for _, r in g.iterrows()])

    kind = dict(points.dtypes)[key]
    return sums.mapInPandas(run, f"{key} {kind}, n long, m array<double>")


def icp_step(points: DataFrame, map_points: DataFrame, th: float, size: float = 1.0, within: float = 6.0) -> np.ndarray:
    """One registration step: the 27 sums come from the cluster, the 6 x 6 system is solved here."""
    return _motion(normal_equations(correspondences(points, map_points, size, within), th).first())


def moments(pairs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Means of both sides and the 9 entries h_ij of sum (a - mean a)(b - mean b)'."""
    n = F.count(F.lit(1)).cast("double")
    means = [F.avg(c).alias("m_" + c) for c in ("x", "y", "z", "tx", "ty", "tz")]
    cross = [(F.sum(F.col(a) * F.col("t" + b)) - F.sum(a) * F.sum("t" + b) / n).alias(f"h_{a}{b}") for a in "xyz" for b in "xyz"]
    return pairs.groupBy(*keys).agg(*means, *cross, n.cast("long").alias("n"))


def plane_moments(points: DataFrame, size: float = 1.0, least: int = 8) -> DataFrame:
    """Mean and covariance of voxels with enough points: c, xx, xy, xz, yy, yz, zz."""
    cells = points.withColumns({n: G.voxel(v, size) for n, v in zip(CELL, G.xyz())})
    second = [(F.avg(F.col(a) * F.col(b)) - F.avg(a) * F.avg(b)).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    agg = cells.groupBy("frame_id", *CELL).agg(*[F.avg(c).alias("c" + c) for c in "xyz"], *second, F.count(F.lit(1)).alias("n"))
    return agg.where(F.col("n") >= least)


def plane_normals(moment_rows: DataFrame, flat: float = 0.005) -> DataFrame:
    """(frame_id, cell, centre, normal, flatness) of voxels whose least eigenvalue is ``flat`` at most."""
    names = ["xx", "xy", "xz", "yy", "yz", "zz"]

    def run(batches):
        for g in batches:
            c = g[names].to_numpy()
            m = c[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
            values, vectors = np.linalg.eigh(m) if len(m) else (np.empty((0, 3)), np.empty((0, 3, 3)))
            normal = vectors[:, :, 0]
            big = np.take_along_axis(normal, np.abs(normal).argmax(axis=1)[:, None], axis=1)
            normal = normal * np.where(big < 0, -1, 1)
            out = g[["frame_id", "vx", "vy", "vz", "cx", "cy", "cz"]].copy()
            out["nx"], out["ny"], out["nz"] = normal.T
            out["least"] = values[:, 0]
            yield out[out.least <= flat]

    schema = "frame_id long, vx long, vy long, vz long, cx double, cy double, cz double, nx double, ny double, nz double, least double"
    return moment_rows.mapInPandas(run, schema)


def plane_matches(source: DataFrame, target: DataFrame, size: float = 1.0, parallel: float = 0.2, off: float = 0.5, d2: float = 3.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Nearest target plane in the 27 cells of each source plane, kept if parallel and close.

    Frames are planes with an id ``point_idx``, of one alignment or of one for each of ``keys``.
    """
    rename = lambda df: df.select(*keys, "point_idx", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), "nx", "ny", "nz")
    near = nearest_in_cells(rename(source), rename(target), size, 1e9, keys, carry=("nx", "ny", "nz"))
    same = F.sqrt(sum((F.col("n" + c) - F.col("tn" + c)) * (F.col("n" + c) - F.col("tn" + c)) for c in "xyz")) < parallel
    against = F.sqrt(sum((F.col("n" + c) + F.col("tn" + c)) * (F.col("n" + c) + F.col("tn" + c)) for c in "xyz")) < parallel
    height = F.abs(sum(F.col("tn" + c) * (F.col(c) - F.col("t" + c)) for c in "xyz"))
    return near.where((same | against) & (height < off) & (F.col("dist") * F.col("dist") < d2))
