"""Queries on iterative and numeric operators: invariants are tested, rows are checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.operators import graph_map as M
from voxloom.operators import points as P
from voxloom.operators import registration as R
from voxloom.plans import fixtures as X
from voxloom.plans import mapping as B
from voxloom.plans import odometry as O
from voxloom.plans.catalog import query
from voxloom.plans.fixtures import oracle
from voxloom.plans.q_joins import _costs, _pair, _sides
from voxloom.plans.q_points import VOX
from voxloom.plans.scratch import cut

def _scan(spark, d):
    s = X.scan(spark, d)
    return s.select(X.sequence().alias("seq_id"), "frame_id", "point_idx", "x", "y", "z", "label")


@query("icp_step")
def icp_step(spark, d):
    """One step of every frame on the one before it."""
    q, m = _pair(spark, d)
    return R.icp_steps(q, m, 2.0, "frame_id")


#: A rotation's rows are unit vectors and it keeps volumes.
RIGID = "abs(sqrt(m[0]*m[0] + m[1]*m[1] + m[2]*m[2]) - 1) < 1e-6 and abs(m[0]*(m[5]*m[10] - m[6]*m[9]) - m[1]*(m[4]*m[10] - m[6]*m[8]) + m[2]*(m[4]*m[9] - m[5]*m[8]) - 1) < 1e-6"


@query("icp_frame", oracle(f"SELECT 's' || (frame_id // 20) AS seq_id, frame_id, count(*) AS points, true AS rigid FROM (SELECT DISTINCT frame_id, vx, vy, vz FROM (SELECT *, {VOX(0.5)} FROM scan)) GROUP BY 1, 2"))
def icp_frame(spark, d):
    """Every frame registered: the points that it had for the map, and that its pose is a motion."""
    return O.odometry(_scan(spark, d)).select("seq_id", "frame_id", "points", F.expr(RIGID).alias("rigid"))


@query("ctl_front")
def ctl_front(spark, d):
    """The whole front end: objects and graphs a frame, then poses, matches, relocalisation and both maps a sequence."""
    return O.front_end(_scan(spark, d))


VM = f"SELECT *, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY frame_id, point_idx) - 1 AS slot FROM (SELECT *, {VOX(1.0)} FROM scan)"


@query("vm_update", oracle(f", cap AS MATERIALIZED (SELECT * FROM ({VM}) WHERE slot < 20), close AS (SELECT vx, vy, vz FROM cap WHERE slot = 0 AND x*x+y*y+z*z <= 10000) SELECT vx, vy, vz, slot::INT AS slot, x, y, z, label FROM cap JOIN close USING (vx, vy, vz)"))
def vm_update(spark, d):
    """The point map after the frames: capped voxels around the last pose."""
    capped = P.voxel_cap(X.scan(spark, d), 1.0)
    return P.drop_far_voxels(capped, (0, 0, 0), 100.0).select(*P.CELL, "slot", "x", "y", "z", "label")


MATCHES = "SELECT a.frame_id AS pair, count(*) AS n FROM nodes a JOIN nodes b ON b.frame_id = a.frame_id + 1 AND a.node_id = b.node_id AND a.label = b.label GROUP BY 1"


def _matches(spark, d):
    n = X.nodes(spark, d)
    b = n.select((F.col("frame_id") - 1).alias("frame_id"), "node_id", "label", *[F.col("c" + c).alias("t" + c) for c in "xyz"])
    both = n.join(b, ["frame_id", "node_id", "label"])
    return both.select(F.col("frame_id").alias("pair"), F.col("node_id").alias("i"), F.col("node_id").alias("j"), *[F.col("c" + c).alias(c) for c in "xyz"], "tx", "ty", "tz")


@query("match_counts", oracle(MATCHES))
def match_counts(spark, d):
    return _matches(spark, d).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def _seen(spark, d, wrong: int = 0):
    """Each frame's objects matched with themselves as its pose moves them; with ``wrong``, every so many is off by 5 m."""
    placed = M.place(X.nodes(spark, d), X.frame_poses(spark, d)).select(
        F.col("frame_id").alias("pair"), F.col("node_id").alias("i"), F.col("node_id").alias("j"), *[F.col("c" + c).alias("s" + c) for c in "xyz"], *[F.col(c).alias("t" + c) for c in "xyz"]
    )
    rows = placed.withColumnsRenamed({"s" + c: c for c in "xyz"})
    left, right = rows.select("pair", "x", "y", "z"), rows.select("pair", *[F.col("t" + c).alias(c) for c in "xyz"])
    if wrong:
        rows = rows.withColumn("tz", F.when(F.col("i") % wrong == wrong - 1, F.col("tz") + 5).otherwise(F.col("tz")))
    return rows, left, right


def _rounded(m, places):
    return F.transform(m, lambda v: F.round(v, places) + 0.0)


POSE = "[c, -s+0.0, 0.0, tx, s, c, 0.0, ty, 0.0, 0.0, 1.0, 0.0]::DOUBLE[]"
COUNTED = ", n AS (SELECT frame_id, count(*) AS n, count(CASE WHEN node_id % 4 <> 3 THEN 1 END) AS good FROM nodes GROUP BY 1)"


@query("num_svd", oracle(COUNTED + f" SELECT frame_id AS pair, {POSE} AS m, 0.0::DOUBLE AS rmse FROM poses JOIN n USING (frame_id) WHERE n >= 4"))
def num_svd(spark, d):
    """Least squares give back the pose that moved the objects."""
    rows, left, _ = _seen(spark, d)
    enough = left.groupBy("pair").agg(F.count(F.lit(1)).alias("k")).where("k >= 4").select("pair")
    found = B.aligned(rows.join(enough, "pair"))
    return found.select("pair", _rounded("m", 6).alias("m"), (F.round("rmse", 6) + 0.0).alias("rmse"))


@query("num_ransac_direct", oracle(COUNTED + f" SELECT frame_id AS pair, {POSE} AS m, round(good/n, 6) AS score, good AS inliers FROM poses JOIN n USING (frame_id) WHERE good >= 4"))
def num_ransac_direct(spark, d):
    """A quarter of the matches is wrong; consensus finds the pose and the right ones."""
    found = B.consensus_by_pair(*_seen(spark, d, 4), "direct", iterations=100)
    enough = X.nodes(spark, d).where("node_id % 4 <> 3").groupBy(F.col("frame_id").alias("pair")).agg(F.count(F.lit(1)).alias("k")).where("k >= 4").select("pair")
    return found.join(enough, "pair").select("pair", _rounded("m", 6).alias("m"), F.round("score", 6).alias("score"), "inliers")


@query("num_ransac_pairs", oracle(COUNTED + " SELECT frame_id AS pair, n AS inliers, 1.0::DOUBLE AS score FROM n WHERE n >= 4"))
def num_ransac_pairs(spark, d):
    found = B.consensus_by_pair(*_seen(spark, d), "pairs", iterations=100)
    enough = X.nodes(spark, d).groupBy(F.col("frame_id").alias("pair")).agg(F.count(F.lit(1)).alias("k")).where("k >= 4").select("pair")
    return found.join(enough, "pair").select("pair", "inliers", F.round("score", 6).alias("score"))


def _graph_consensus(spark, d):
    return B.consensus_by_pair(*_seen(spark, d, 4), "graph", iterations=200)


@query("num_ransac_graph", oracle(COUNTED + " SELECT frame_id AS pair, n AS inliers, 1.0::DOUBLE AS score FROM n WHERE good >= 4"))
def num_ransac_graph(spark, d):
    """Wrong matches cost nothing where all objects fall on one another."""
    return _graph_consensus(spark, d).join(_enough(spark, d), "pair").select("pair", "inliers", F.round("score", 6).alias("score"))


def _enough(spark, d):
    good = X.nodes(spark, d).where("node_id % 4 <> 3").groupBy(F.col("frame_id").alias("pair")).agg(F.count(F.lit(1)).alias("k"))
    return good.where("k >= 4").select("pair")


@query("top_ransac", oracle(COUNTED + " SELECT frame_id AS pair, good AS inliers FROM n WHERE good >= 4"))
def top_ransac(spark, d):
    return num_ransac_direct(spark, d).select("pair", "inliers")


STAYS = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)


@query("gm_reloc", oracle(COUNTED + f" SELECT frame_id AS pair, coalesce(n, 0) > 3 AS found, CASE WHEN n > 3 THEN {POSE} ELSE {list(STAYS)}::DOUBLE[] END AS m FROM poses LEFT JOIN n USING (frame_id)"))
def gm_reloc(spark, d):
    """Objects of a frame matched with a map, a quarter of them wrongly: every frame's pose, not found by three matches or fewer."""
    found = B.relocalize(B.consensus_by_pair(*_seen(spark, d, 4), "graph", iterations=None, least=4), 0.43)
    out = X.frame_poses(spark, d).select(F.col("frame_id").alias("pair")).join(found, "pair", "left")
    m = F.when(F.col("found"), _rounded("m", 6)).otherwise(F.array(*map(F.lit, STAYS)))
    return out.select("pair", F.coalesce("found", F.lit(False)).alias("found"), m.alias("m"))


SHIFT = (0.01, -0.02, 0.005)


def _shifted(points):
    """Every frame, and a copy of it, numbered negatively, that is moved a little."""
    at = {c: F.col(c) + v for c, v in zip("xyz", SHIFT)}
    return points.unionByName(points.withColumns(at).withColumn("frame_id", -1 - F.col("frame_id")))


def _near_shift(m):
    off = [F.abs(F.col(m)[k] + v) < 0.05 for k, v in zip((3, 7, 11), SHIFT)]
    return off[0] & off[1] & off[2] & (G.rotation_angle(F.col(m)) < 0.01)


def _registered(spark, d, kind):
    points = X.scan(spark, d).select("frame_id", "point_idx", "x", "y", "z", "label")
    points = P.background(points) if kind == "planes" else points
    pairs = points.select(F.col("frame_id").alias("c")).distinct().select((-1 - F.col("c")).alias("q"), "c")
    return B.register_pairs(_shifted(points), pairs, kind).select("q", "c", _near_shift("m").alias("back"))


REGISTERED = "SELECT DISTINCT -1 - frame_id AS q, frame_id AS c, true AS back FROM "


@query("icp_loop_pt", oracle(REGISTERED + "scan"))
def icp_loop_pt(spark, d):
    """Every frame, moved a little, finds back to itself."""
    return _registered(spark, d, "points")


@query("icp_loop_plane", oracle(REGISTERED + "bg"))
def icp_loop_plane(spark, d):
    return _registered(spark, d, "planes")


@query("lc_verify")
def lc_verify(spark, d):
    """Every fifth frame against the one five before it."""
    ids = X.raw_points(spark, d).select(F.col("frame_id").alias("q")).distinct().where("q >= 5 and q % 5 = 0")
    return B.verify_loops(X.nodes(spark, d), X.scan(spark, d), ids.select("q", (F.col("q") - 5).alias("c")))


@query("flt_loop_verify")
def flt_loop_verify(spark, d):
    return B.passing(lc_verify(spark, d))


@query("lc_search")
def lc_search(spark, d):
    return B.search_loops(cut(X.nodes(spark, d), "nodes"), X.scan(spark, d), every=1, gap=6, within=0.5)


@query("pgo")
def pgo(spark, d):
    """Every path with a loop between its first and its sixtieth pose."""
    poses = X.predicted(spark, d)
    rel = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 59, 0, 1, 0, 0, 0, 0, 1, 0)])
    return B.optimise(poses, poses.where("frame_id = 59").select("seq_id", F.col("frame_id").alias("query_frame"), F.lit(0).alias("match_frame"), rel.alias("rel")))


@query("pgo_chain", oracle("SELECT seq_id, frame_id, round(tx, 5) AS x FROM pr"))
def pgo_chain(spark, d):
    """Without loops poses stay as they are, in each sequence for itself."""
    return B.optimise(X.predicted(spark, d), None).select("seq_id", "frame_id", F.round(F.col("m")[3], 5).alias("x"))


FACTORS = "SELECT seq_id, 'odom' AS kind, frame_id - 1 AS src, frame_id AS dst, round(tx - lag(tx) OVER w, 5) AS dx FROM pr WINDOW w AS (PARTITION BY seq_id ORDER BY frame_id) QUALIFY lag(tx) OVER w IS NOT NULL UNION ALL SELECT seq_id, 'prior', NULL, 0, round(tx, 5) FROM pr WHERE frame_id = 0"


@query("pgo_factors", oracle(FACTORS))
def pgo_factors(spark, d):
    f = B.factors(X.predicted(spark, d), None)
    return f.select("seq_id", "kind", "src", "dst", F.round(F.col("rel")[3], 5).alias("dx"))


@query("ctl_back")
def ctl_back(spark, d):
    """The whole back end on what the front end gives: keyframes, loops, optimised poses, global map."""
    points = cut(_scan(spark, d), "points")
    nodes = cut(X.nodes(spark, d), "nodes")
    return B.back_end(points.drop("seq_id"), nodes, O.front_end(points, nodes=nodes), every=2, gap=3, within=0.5, graph=0.3, back=0.2)["graph"]


GLOBAL = """
, placed AS (SELECT frame_id, node_id, label, c*cx - s*cy + tx AS x, s*cx + c*cy + ty AS y, cz AS z FROM nodes JOIN poses USING (frame_id)),
numbered AS (SELECT *, row_number() OVER (ORDER BY frame_id, node_id) - 1 AS id FROM placed)"""


@query("global_graph", oracle(GLOBAL + " SELECT 'node' AS kind, id AS src, NULL::BIGINT AS dst, label FROM numbered UNION ALL SELECT 'edge', a.id, b.id, NULL FROM numbered a JOIN numbered b ON (b.frame_id BETWEEN a.frame_id - 3 AND a.frame_id - 1 OR (a.frame_id = b.frame_id AND a.node_id < b.node_id)) WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) < 60"))
def global_graph(spark, d):
    return B.global_graph(X.nodes(spark, d), X.frame_poses(spark, d), back=3).select("kind", "src", "dst", "label")


@query("assign_totals")
def assign_totals(spark, d):
    from voxloom.operators import matching as K

    a, b = _sides(spark, d)
    return K.prune(K.assign(_costs(spark, d)), a, b).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
