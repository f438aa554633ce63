"""Queries on neighbour joins, matching, top-k and the nearest-neighbour surface."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.functions import labels as L
from voxloom.operators import graph_map as M
from voxloom.operators import matching as K
from voxloom.operators import nearest as N
from voxloom.operators import points as P
from voxloom.operators import registration as R
from voxloom.operators import scene_graph as S
from voxloom.plans import fixtures as X
from voxloom.plans.catalog import query
from voxloom.plans.fixtures import oracle
from voxloom.plans.q_functions import VALUES
from voxloom.plans.q_graphs import TRI

R6 = lambda c, name: F.round(c, 6).alias(name)
L2 = "list_sum(list_transform(list_zip(a.d, b.d), lambda p: (p[1]-p[2])*(p[1]-p[2])))"
KNN = f", p AS (SELECT a.kf_seq AS q, b.kf_seq AS c, {L2} AS d FROM kf a JOIN kf b ON b.kf_seq <= a.kf_seq - 30), r AS (SELECT q, c, d, row_number() OVER (PARTITION BY q ORDER BY d, c)::INT AS rank FROM p)"


def _kf(spark, d):
    return X.keyframes(spark, d)


@query("join_loop_knn", oracle(KNN + " SELECT q, c, rank, round(d, 5) AS d FROM r WHERE rank <= 5"))
def join_loop_knn(spark, d):
    return K.loop_candidates(_kf(spark, d)).select("q", "c", "rank", F.round("d", 5).alias("d"))


@query("top_knn", oracle(KNN + " SELECT q, c, rank FROM r WHERE rank <= 3"))
def top_knn(spark, d):
    return K.loop_candidates(_kf(spark, d), k=3).select("q", "c", "rank")


@query("flt_loop_dist", oracle(KNN + " SELECT q, c, rank FROM r WHERE rank <= 5 AND d <= 1.2"))
def flt_loop_dist(spark, d):
    return K.loop_candidates(_kf(spark, d), within=1.2).select("q", "c", "rank")


@query("top_first_loop", oracle(KNN + " SELECT q, arg_min(c, rank) AS c FROM r WHERE rank <= 5 AND d <= 1.4 AND (q + c) % 2 = 0 GROUP BY q"))
def top_first_loop(spark, d):
    found = K.loop_candidates(_kf(spark, d), within=1.4).where((F.col("q") + F.col("c")) % 2 == 0)
    return found.groupBy("q").agg(F.min_by("c", "rank").alias("c"))


def _vectors(spark, d):
    k = _kf(spark, d)
    return k.select(F.col("kf_seq").alias("id"), F.col("desc").alias("vec"), "label")


SAME = f", p AS (SELECT a.label, a.kf_seq AS q, b.kf_seq AS c, %s AS d FROM kf a JOIN kf b USING (label))"


@query("nn_knn", oracle(SAME % L2 + " SELECT label, q, c, rank FROM (SELECT *, row_number() OVER (PARTITION BY label, q ORDER BY d, c)::INT AS rank FROM p) WHERE rank <= 4"))
def nn_knn(spark, d):
    v = _vectors(spark, d)
    return N.knn(v, v, 4, ("label",)).select("label", "q", "c", "rank")


@query("nn_rknn", oracle(SAME % L2 + " SELECT label, q, c, rank FROM (SELECT *, row_number() OVER (PARTITION BY label, q ORDER BY d, c)::INT AS rank FROM p WHERE d < 1.5) WHERE rank <= 4"))
def nn_rknn(spark, d):
    v = _vectors(spark, d)
    return N.knn(v, v, 4, ("label",), within=1.5).select("label", "q", "c", "rank")


@query("nn_radius", oracle(SAME % L2 + " SELECT label, q, c FROM p WHERE d < 1.5"))
def nn_radius(spark, d):
    v = _vectors(spark, d)
    return N.radius_pairs(v, v, 1.5, ("label",)).select("label", "q", "c")


@query("nn_radius_cb", oracle(SAME % L2 + " SELECT q, count(*) AS n FROM p WHERE d < 1.5 GROUP BY q"))
def nn_radius_cb(spark, d):
    v = _vectors(spark, d)
    return N.radius_counts(v, v, 1.5, ("label",))


@query("nn_worst", oracle(SAME % L2 + " SELECT q, arg_max(c, d) AS c, round(max(d), 5) AS d FROM p WHERE d < 1.5 GROUP BY q"))
def nn_worst(spark, d):
    v = _vectors(spark, d)
    return N.farthest(N.radius(v, v, 1.5, ("label",))).select("q", "c", F.round("d", 5).alias("d"))


@query("nn_metric_l1", oracle(SAME % L2.replace("(p[1]-p[2])*(p[1]-p[2])", "abs(p[1]-p[2])") + " SELECT q, c, round(d, 5) AS d FROM p"))
def nn_metric_l1(spark, d):
    v = _vectors(spark, d)
    return N.distances(v, v, ("label",), "l1", places=5).select("q", "c", "d")


L2_ORACLE = oracle(SAME % L2 + " SELECT q, c, round(d, 5) AS d FROM p")


@query("nn_metric_l2", L2_ORACLE)
def nn_metric_l2(spark, d):
    v = _vectors(spark, d)
    return N.distances(v, v, ("label",), "l2", places=5).select("q", "c", "d")


@query("nn_metric_l2s", L2_ORACLE)
def nn_metric_l2s(spark, d):
    return nn_metric_l2(spark, d)


@query("nn_metric_so3", oracle(SAME % L2.replace("a.d", "a.d[1:4]").replace("b.d", "b.d[1:4]") + " SELECT q, c, round(d, 5) AS d FROM p"))
def nn_metric_so3(spark, d):
    v = _vectors(spark, d).withColumn("vec", F.slice("vec", 1, 4))
    return N.distances(v, v, ("label",), "so3", places=5).select("q", "c", "d")


SO2 = "CASE WHEN b.d[-1]*8-a.d[-1]*8 > pi() THEN b.d[-1]*8-a.d[-1]*8-2*pi() WHEN b.d[-1]*8-a.d[-1]*8 < -pi() THEN b.d[-1]*8-a.d[-1]*8+2*pi() ELSE b.d[-1]*8-a.d[-1]*8 END"


@query("nn_metric_so2", oracle(SAME % SO2 + " SELECT q, c, round(d, 5) AS d FROM p"))
def nn_metric_so2(spark, d):
    v = _vectors(spark, d).withColumn("vec", F.array(F.element_at("vec", -1).cast("double") * 8))
    return N.distances(v, v, ("label",), "so2", places=5).select("q", "c", "d")


@query("nn_dynamic", oracle(SAME % L2 + " SELECT q, count(*) AS n FROM p WHERE d < 1.5 AND c % 7 <> 0 GROUP BY q"))
def nn_dynamic(spark, d):
    """Rows added in parts, some deleted again."""
    v = _vectors(spark, d)
    corpus = v.where("id % 2 = 0").unionByName(v.where("id % 2 = 1"))
    corpus = corpus.join(v.where("id % 7 = 0").select("id"), "id", "left_anti")
    return N.radius(v, corpus, 1.5, ("label",)).groupBy("q").agg(F.count(F.lit(1)).alias("n"))


MAPPED = ", m AS (SELECT frame_id + 1 AS frame_id, frame_id*1000000 + point_idx AS tid, x, y, z FROM scan), s AS (SELECT frame_id, frame_id*1000000 + point_idx AS pid, x + 0.1 AS x, y, z, label FROM scan)"
CELLMATCH = """
, mc AS (SELECT *, trunc(x/1.0)::BIGINT vx, trunc(y/1.0)::BIGINT vy, trunc(z/1.0)::BIGINT vz FROM m),
sc AS (SELECT *, trunc(x/1.0)::BIGINT vx, trunc(y/1.0)::BIGINT vy, trunc(z/1.0)::BIGINT vz FROM s),
nn AS (SELECT s.frame_id, pid, s.label, s.x, s.y, s.z, t.tid, t.x AS tx, t.y AS ty, t.z AS tz, sqrt((s.x-t.x)*(s.x-t.x)+(s.y-t.y)*(s.y-t.y)+(s.z-t.z)*(s.z-t.z)) AS dist
  FROM sc s JOIN mc t ON s.frame_id = t.frame_id AND abs(s.vx-t.vx) <= 1 AND abs(s.vy-t.vy) <= 1 AND abs(s.vz-t.vz) <= 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY dist, tid) AS r FROM nn WHERE dist < 6) WHERE r = 1)"""


def _pair(spark, d):
    """Every frame, a little moved, and the frame before it as its map."""
    s = X.scan(spark, d).withColumn("point_idx", F.col("frame_id") * 1000000 + F.col("point_idx"))
    m = s.select((F.col("frame_id") + 1).alias("frame_id"), "point_idx", "x", "y", "z")
    return s.select("frame_id", "point_idx", (F.col("x") + 0.1).alias("x"), "y", "z", "label"), m


KEY = ("frame_id",)


@query("join_voxel_nn", oracle(MAPPED + CELLMATCH + " SELECT pid AS point_idx, tid, round(dist, 6) AS dist FROM best"))
def join_voxel_nn(spark, d):
    return R.correspondences(*_pair(spark, d), keys=KEY).select("point_idx", "tid", R6(F.col("dist"), "dist"))


@query("join_voxel_nn_loop", oracle(MAPPED + CELLMATCH.replace("dist < 6", "dist < 0.5") + " SELECT pid AS point_idx, tid FROM best"))
def join_voxel_nn_loop(spark, d):
    return R.correspondences(*_pair(spark, d), within=0.5, keys=KEY).select("point_idx", "tid")


@query("flt_corr_dist", oracle(MAPPED + CELLMATCH.replace("dist < 6", "dist < 0.8") + " SELECT frame_id, count(*) AS n FROM best GROUP BY 1"))
def flt_corr_dist(spark, d):
    return R.correspondences(*_pair(spark, d), within=0.8, keys=KEY).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))


@query("top_closest", oracle(MAPPED + CELLMATCH + " SELECT pid AS point_idx, tid FROM best"))
def top_closest(spark, d):
    return R.correspondences(*_pair(spark, d), keys=KEY).select("point_idx", "tid")


@query("set_corr_concat", oracle(MAPPED + CELLMATCH + " SELECT frame_id, count(*) AS n, sum(tid)::BIGINT AS s FROM best GROUP BY 1"))
def set_corr_concat(spark, d):
    return R.correspondences(*_pair(spark, d), keys=KEY).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tid").alias("s"))


WEIGHTED = f", w AS (SELECT *, 4.0/((2 + dist*dist)*(2 + dist*dist)) AS w, sw.v::DOUBLE AS sw FROM best JOIN (VALUES {VALUES(L.WEIGHT)}) sw(label, v) USING (label))"


@query("agg_normal_eq", oracle(MAPPED + CELLMATCH + WEIGHTED + " SELECT frame_id, count(*) AS n, round(sum(w), 4) AS a00, round(sum(w*z), 4) AS a04, round(sum(-w*y), 4) AS a05, round(sum(w*(y*y+z*z)), 3) AS a33, round(sum(-w*x*y), 3) AS a34, round(sum(w*sw*(x-tx)), 4) AS b0, round(sum(w*sw*(-z*(y-ty) + y*(z-tz))), 4) AS b3 FROM w GROUP BY 1"))
def agg_normal_eq(spark, d):
    e = R.normal_equations(R.correspondences(*_pair(spark, d), keys=KEY), 2.0, keys=KEY)
    return e.select("frame_id", "n", *[F.round(c, n).alias(c) for c, n in (("a00", 4), ("a04", 4), ("a05", 4), ("a33", 3), ("a34", 3), ("b0", 4), ("b3", 4))])


@query("agg_normal_eq_plain", oracle(MAPPED + CELLMATCH.replace("dist < 6", "dist < 0.5") + " SELECT frame_id, count(*) AS n, round(count(*)::DOUBLE, 4) AS a00, round(sum(x*x+y*y), 1) AS a55, round(sum(z-tz), 4) AS b2 FROM best GROUP BY 1"))
def agg_normal_eq_plain(spark, d):
    e = R.normal_equations(R.correspondences(*_pair(spark, d), within=0.5, keys=KEY), None, weighted=False, keys=KEY)
    return e.select("frame_id", "n", F.round("a00", 4).alias("a00"), F.round("a55", 1).alias("a55"), F.round("b2", 4).alias("b2"))


@query("agg_cross_cov", oracle(MAPPED + CELLMATCH + " SELECT frame_id, count(*) AS n, round(avg(x), 5) AS m_x, round(avg(tx), 5) AS m_tx, round(sum(x*tx) - sum(x)*sum(tx)/count(*), 2) AS h_xx, round(sum(x*ty) - sum(x)*sum(ty)/count(*), 2) AS h_xy FROM best GROUP BY 1"))
def agg_cross_cov(spark, d):
    m = R.moments(R.correspondences(*_pair(spark, d), keys=KEY), KEY)
    return m.select("frame_id", "n", F.round("m_x", 5).alias("m_x"), F.round("m_tx", 5).alias("m_tx"), F.round("h_xx", 2).alias("h_xx"), F.round("h_xy", 2).alias("h_xy"))


@query("agg_plane", oracle("SELECT frame_id, vx, vy, vz, count(*) AS n, round(avg(x), 9) AS cx, round(avg(x*x)-avg(x)*avg(x), 9) AS xx, round(avg(x*y)-avg(x)*avg(y), 9) AS xy, round(avg(z*z)-avg(z)*avg(z), 9) AS zz FROM (SELECT *, trunc(x/1.0)::BIGINT vx, trunc(y/1.0)::BIGINT vy, trunc(z/1.0)::BIGINT vz FROM bg) GROUP BY 1,2,3,4 HAVING count(*) >= 8"))
def agg_plane(spark, d):
    m = R.plane_moments(P.background(X.scan(spark, d)))
    return m.select("frame_id", "vx", "vy", "vz", "n", *[F.round(c, 9).alias(c) for c in ("cx", "xx", "xy", "zz")])


@query("flt_plane")
def flt_plane(spark, d):
    return R.plane_normals(R.plane_moments(P.background(X.scan(spark, d))), flat=0.05)


@query("top_min_eig")
def top_min_eig(spark, d):
    return R.plane_normals(R.plane_moments(P.background(X.scan(spark, d))), flat=1e9).select("frame_id", "vx", "vy", "vz", "nx", "ny", "nz", "least")


def _planes(spark, d):
    """The planes of every frame, and those of the frame after it."""
    p = R.plane_normals(R.plane_moments(P.background(X.scan(spark, d)), least=4), flat=1e9)
    p = p.withColumn("point_idx", F.xxhash64("vx", "vy", "vz"))
    return p, p.withColumn("frame_id", F.col("frame_id") - 1)


@query("join_plane_nn")
def join_plane_nn(spark, d):
    return R.plane_matches(*_planes(spark, d), keys=KEY).select("frame_id", "point_idx", "tid", "dist")


@query("flt_plane_pair")
def flt_plane_pair(spark, d):
    return R.plane_matches(*_planes(spark, d), parallel=0.1, keys=KEY).select("frame_id", "point_idx", "tid", "dist")


FIRSTCELL = """
, tc AS (SELECT frame_id, trunc(x/0.2)::BIGINT vx, trunc(y/0.2)::BIGINT vy, trunc(z/0.2)::BIGINT vz, min(tid) AS tid FROM m GROUP BY 1,2,3,4),
qc AS (SELECT frame_id, pid, trunc(x/0.2)::BIGINT vx, trunc(y/0.2)::BIGINT vy, trunc(z/0.2)::BIGINT vz FROM s),
h AS (SELECT pid, t.tid, (t.vx-q.vx+1)*9 + (t.vy-q.vy+1)*3 + (t.vz-q.vz+1) AS nth FROM qc q JOIN tc t ON q.frame_id = t.frame_id AND abs(q.vx-t.vx) <= 1 AND abs(q.vy-t.vy) <= 1 AND abs(q.vz-t.vz) <= 1)"""


@query("join_ransac_cell", oracle(MAPPED + FIRSTCELL + " SELECT pid AS point_idx, arg_min(tid, nth) AS tid FROM h GROUP BY 1"))
def join_ransac_cell(spark, d):
    return N.first_in_cells(*_pair(spark, d), 0.2, KEY).drop("frame_id")


INST = ", e AS (SELECT frame_id + k AS frame_id, label, cx AS x, cy AS y, cz AS z FROM nodes, (VALUES (1), (2)) t(k)), c AS (SELECT frame_id, frame_id*10000 + node_id AS point_idx, label, cx + 0.3 AS x, cy AS y, cz AS z FROM nodes)"


def _instances(spark, d):
    """The objects of every frame, a little moved, and those of the two frames before it."""
    n = X.nodes(spark, d)
    e = n.select(F.explode(F.sequence(F.col("frame_id") + 1, F.col("frame_id") + 2)).alias("frame_id"), "label", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    c = n.select("frame_id", (F.col("frame_id") * 10000 + F.col("node_id")).alias("point_idx"), "label", (F.col("cx") + 0.3).alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    return c, e


@query("join_nms", oracle(INST + " SELECT point_idx FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.frame_id = c.frame_id AND e.label = c.label AND abs(trunc(e.x/1.5)-trunc(c.x/1.5)) <= 1 AND abs(trunc(e.y/1.5)-trunc(c.y/1.5)) <= 1 AND abs(trunc(e.z/1.5)-trunc(c.z/1.5)) <= 1 AND sqrt((e.x-c.x)*(e.x-c.x)+(e.y-c.y)*(e.y-c.y)+(e.z-c.z)*(e.z-c.z)) < 0.5)"))
def join_nms(spark, d):
    return N.without_near(*_instances(spark, d), 0.5, keys=KEY).select("point_idx")


def _described(spark, d):
    n = X.nodes(spark, d)
    desc = S.local_descriptors(n).withColumnRenamed("v", "desc")
    tri = S.triangle_sets(S.triangles(n))
    none = F.expr("array()").cast("array<struct<a:double,b:double,c:double>>")
    both = n.join(desc, ["frame_id", "node_id"]).join(tri, ["frame_id", "node_id"], "left")
    return both.withColumn("tri", F.coalesce("tri", none))


DESC = """
, h AS (SELECT frame_id, i AS node_id, ((lj-1)*30 + floor(dist/2))::INT AS slot, count(*) AS n FROM near GROUP BY 1, 2, 3),
dn AS (SELECT frame_id, node_id, slot, n/sqrt(sum(n*n) OVER (PARTITION BY frame_id, node_id)) AS v FROM h),
dots AS (SELECT a.frame_id AS f, a.node_id AS i, b.node_id AS j, sum(a.v*b.v) AS dot FROM dn a JOIN dn b ON b.frame_id = a.frame_id + 1 AND a.slot = b.slot GROUP BY 1, 2, 3)"""


@query("join_cost", oracle(DESC + " SELECT f AS pair, i, j, round(greatest(1-dot, 0), 6) AS cost FROM dots JOIN nodes a ON a.frame_id = f AND a.node_id = i JOIN nodes b ON b.frame_id = f+1 AND b.node_id = j WHERE a.label = b.label AND abs(a.dx-b.dx) <= 2 AND abs(a.dy-b.dy) <= 2 AND abs(a.dz-b.dz) <= 2 AND round(1-dot, 9) BETWEEN 0 AND 0.5"))
def join_cost(spark, d):
    return _costs(spark, d).select("pair", "i", "j", R6(F.col("cost"), "cost"))


def _sides(spark, d):
    n = _described(spark, d)
    return n.withColumn("pair", F.col("frame_id")), n.withColumn("pair", F.col("frame_id") - 1)


def _costs(spark, d):
    return K.costs(*_sides(spark, d))


@query("join_assign")
def join_assign(spark, d):
    return K.assign(K.costs(*_sides(spark, d)))


@query("num_hungarian")
def num_hungarian(spark, d):
    return K.assign(K.costs(*_sides(spark, d))).groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("total"))


@query("join_prune")
def join_prune(spark, d):
    a, b = _sides(spark, d)
    return K.prune(K.assign(K.costs(a, b)), a, b)


def _map_pair(spark, d):
    n = _described(spark, d)
    return n, n.withColumn("frame_id", F.col("frame_id") + 1)


@query("join_desc_knn")
def join_desc_knn(spark, d):
    return K.node_matches(*_map_pair(spark, d))


@query("join_match_status")
def join_match_status(spark, d):
    n, m = _map_pair(spark, d)
    return K.match_status(n, K.node_matches(n, m))


STATUS = oracle("SELECT a.frame_id, b.node_id IS NOT NULL AS matched, a.node_id, b.node_id AS map_id FROM nodes a LEFT JOIN (SELECT frame_id + 1 AS frame_id, node_id, label FROM nodes) b ON a.frame_id = b.frame_id AND a.node_id = b.node_id AND a.label = b.label")


@query("set_union_match", STATUS)
def set_union_match(spark, d):
    n = X.nodes(spark, d)
    m = n.select((F.col("frame_id") + 1).alias("frame_id"), "node_id", F.col("node_id").alias("map_id"), F.col("label").alias("ml"))
    found = n.join(m, ["frame_id", "node_id"]).where("label = ml").select("frame_id", "node_id", "map_id")
    return K.match_status(n, found)


@query("join_triangles", oracle(TRI + ", u AS (SELECT DISTINCT frame_id, node_id, s[1] AS a, s[2] AS b, s[3] AS c, m, n FROM tri), hits AS (SELECT x.frame_id, x.node_id, count(*) AS hits FROM u x JOIN u y ON y.frame_id = x.frame_id + 1 AND y.node_id = x.node_id AND abs(x.a::DOUBLE-y.a::DOUBLE) < 0.3 AND abs(x.b::DOUBLE-y.b::DOUBLE) < 0.3 AND abs(x.c::DOUBLE-y.c::DOUBLE) < 0.3 GROUP BY 1, 2) SELECT frame_id, node_id, hits FROM hits"))
def join_triangles(spark, d):
    """Equal triangles of a node and the node of its number in the next frame, as a band join."""
    t = S.triangles(X.nodes(spark, d))
    return M.band_hits(t, t.withColumn("frame_id", F.col("frame_id") - 1), 0.3)


GLOBAL = ", g AS (SELECT frame_id, node_id, label, cx AS x, cy AS y, cz AS z FROM nodes)"
NEARBY = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) < 60"


def _new(spark, d):
    n = X.nodes(spark, d)
    return n.select("frame_id", "node_id", "label", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))


@query("join_global_edges", oracle(GLOBAL + f" SELECT a.frame_id AS fa, a.node_id AS na, b.frame_id AS fb, b.node_id AS nb FROM g a JOIN g b ON b.frame_id BETWEEN a.frame_id - 5 AND a.frame_id - 1 WHERE {NEARBY}"))
def join_global_edges(spark, d):
    return M.edges_to_earlier(_new(spark, d), back=5)


@query("join_global_edges_self", oracle(GLOBAL + f" SELECT a.frame_id AS fa, a.node_id AS na, b.frame_id AS fb, b.node_id AS nb FROM g a JOIN g b ON a.frame_id = b.frame_id AND a.node_id < b.node_id WHERE {NEARBY}"))
def join_global_edges_self(spark, d):
    return M.edges_within(_new(spark, d))


@query("win_node_offset", oracle("SELECT frame_id, coalesce(sum(n) OVER (ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM (SELECT frame_id, count(*) AS n FROM nodes GROUP BY 1)"))
def win_node_offset(spark, d):
    return M.node_offsets(X.nodes(spark, d)).select("frame_id", "base")


@query("join_pose", oracle("SELECT frame_id, node_id, label, round(c*cx - s*cy + tx, 6) AS x, round(s*cx + c*cy + ty, 6) AS y, round(cz, 6) AS z FROM nodes JOIN poses USING (frame_id)"))
def join_pose(spark, d):
    return M.place(X.nodes(spark, d), X.frame_poses(spark, d)).select("frame_id", "node_id", "label", *[R6(F.col(c), c) for c in "xyz"])


@query("gm_global", oracle("SELECT frame_id, node_id, label, round(c*cx - s*cy + tx, 6) AS x, round(s*cx + c*cy + ty, 6) AS y FROM nodes JOIN poses USING (frame_id) WHERE frame_id < (SELECT max(frame_id) FROM poses)"))
def gm_global(spark, d):
    """All frames are optimised but the last."""
    poses = X.frame_poses(spark, d)
    last = poses.agg(F.max("frame_id")).first()[0] - 1
    return M.place(X.nodes(spark, d), poses, last=last).select("frame_id", "node_id", "label", R6(F.col("x"), "x"), R6(F.col("y"), "y"))


@query("set_unseen", oracle("SELECT frame_id, node_id FROM nodes WHERE (frame_id, node_id) NOT IN (SELECT frame_id + 1, node_id FROM nodes WHERE node_id % 2 = 0)"))
def set_unseen(spark, d):
    n = X.nodes(spark, d)
    matched = n.where("node_id % 2 = 0").select((F.col("frame_id") + 1).alias("frame_id"), "node_id")
    return M.unseen(n, matched).select("frame_id", "node_id")


@query("gm_update_step", oracle(
    ", m AS (SELECT frame_id + 1 AS frame_id, node_id AS instance_id, label, cx AS px, cy AS py, cz AS pz, dx, dy, dz FROM nodes WHERE frame_id + 1 IN (SELECT frame_id FROM nodes)), f AS (SELECT frame_id, node_id, label, cx, cy, cz, dx, dy, dz, points_num FROM nodes), j AS (SELECT f.*, m.px, m.py, m.pz, m.dx AS mx, sqrt((f.cx-m.px)*(f.cx-m.px)+(f.cy-m.py)*(f.cy-m.py)+(f.cz-m.pz)*(f.cz-m.pz)) AS dist FROM f JOIN m ON f.frame_id = m.frame_id AND f.node_id = m.instance_id) SELECT m.frame_id, m.instance_id::BIGINT AS instance_id, m.label, round(CASE WHEN j.dist < 2 THEN (m.px+j.cx)/2 ELSE m.px END, 6) AS px, round(CASE WHEN j.dist < 2 THEN (m.dx+j.dx)/2 ELSE m.dx END, 6) AS dx FROM m LEFT JOIN j ON j.frame_id = m.frame_id AND j.node_id = m.instance_id"
))
def gm_update_step(spark, d):
    """The part of each map that was there before: matched instances move half way."""
    out = M.update(*_map_and_frame(spark, d), (0.0, 0.0, 0.0), 1e9, keys=KEY)
    return out.where("old").select("frame_id", "instance_id", "label", R6(F.col("px"), "px"), R6(F.col("dx"), "dx"))


def _map_and_frame(spark, d):
    """The objects of each frame as a map, those of the frame after it, and pairs of equal number."""
    n = X.nodes(spark, d)
    rename = {c: "p" + c[1] for c in ("cx", "cy", "cz")}
    m = n.withColumn("frame_id", F.col("frame_id") + 1).join(n.select("frame_id").distinct(), "frame_id", "left_semi").withColumnsRenamed({**rename, "node_id": "instance_id"})
    matches = n.join(m.select("frame_id", F.col("instance_id").alias("map_id")), "frame_id").where("node_id = map_id").select("frame_id", "node_id", "map_id")
    return m, n.join(m.select("frame_id").distinct(), "frame_id", "left_semi"), matches


GM = """
, m AS (SELECT frame_id + 1 AS frame_id, node_id AS instance_id, label, cx AS px, cy AS py, cz AS pz, points_num FROM nodes WHERE frame_id + 1 IN (SELECT frame_id FROM nodes)),
f AS (SELECT * FROM nodes WHERE frame_id IN (SELECT frame_id FROM m)),
j AS (SELECT f.*, m.px, m.py, m.pz FROM f JOIN m ON f.frame_id = m.frame_id AND f.node_id = m.instance_id WHERE sqrt((f.cx-m.px)*(f.cx-m.px)+(f.cy-m.py)*(f.cy-m.py)+(f.cz-m.pz)*(f.cz-m.pz)) < 2),
held AS (SELECT m.frame_id, m.label, coalesce((m.px+j.cx)/2, m.px) AS px, coalesce((m.py+j.cy)/2, m.py) AS py, coalesce((m.pz+j.cz)/2, m.pz) AS pz, m.points_num FROM m LEFT JOIN j ON j.frame_id = m.frame_id AND j.node_id = m.instance_id),
fresh AS (SELECT frame_id, label, cx, cy, cz, points_num FROM f WHERE (frame_id, node_id) NOT IN (SELECT frame_id, node_id FROM j) AND CASE WHEN label = 1 THEN points_num >= 50 AND dx >= 1 AND dy >= 1 AND dz >= 1 ELSE dz >= 1 END
  AND NOT EXISTS (SELECT 1 FROM m WHERE m.frame_id = f.frame_id AND m.label = f.label AND abs(trunc(m.px/1.5)-trunc(f.cx/1.5)) <= 1 AND abs(trunc(m.py/1.5)-trunc(f.cy/1.5)) <= 1 AND abs(trunc(m.pz/1.5)-trunc(f.cz/1.5)) <= 1 AND sqrt((m.px-f.cx)*(m.px-f.cx)+(m.py-f.cy)*(m.py-f.cy)+(m.pz-f.cz)*(m.pz-f.cz)) < 2))
SELECT frame_id, label, round(px, 6) AS px, round(py, 6) AS py, points_num FROM (SELECT * FROM held UNION ALL SELECT * FROM fresh) WHERE px*px + py*py + pz*pz <= 3600"""


@query("gm_update", oracle(GM))
def gm_update(spark, d):
    """Each map after the frame that follows it, instances within 60 m."""
    out = M.update(*_map_and_frame(spark, d), (0.0, 0.0, 0.0), 60.0, keys=KEY)
    return out.select("frame_id", "label", R6(F.col("px"), "px"), R6(F.col("py"), "py"), "points_num")
