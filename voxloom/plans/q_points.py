"""Queries on points: filters, voxels, clusters, boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.operators import clustering as C
from voxloom.operators import points as P
from voxloom.plans import fixtures as X
from voxloom.plans.catalog import query
from voxloom.plans.fixtures import oracle

VOX = lambda s: ", ".join(f"trunc({c}/{s})::BIGINT AS v{c}" for c in "xyz")


@query("flt_range", oracle("SELECT frame_id, point_idx, label FROM pts WHERE sqrt(x*x+y*y+z*z) > 5 AND sqrt(x*x+y*y+z*z) < 100"))
def flt_range(spark, d):
    return P.filter_range(X.points(spark, d)).select("frame_id", "point_idx", "label")


@query("flt_range_static", oracle("SELECT frame_id, point_idx, label FROM scan"))
def flt_range_static(spark, d):
    return X.scan(spark, d).select("frame_id", "point_idx", "label")


@query("flt_fg_bg", oracle("SELECT frame_id, point_idx, 'fg' AS part FROM fg UNION ALL SELECT frame_id, point_idx, 'bg' FROM bg"))
def flt_fg_bg(spark, d):
    s = X.scan(spark, d)
    part = lambda df, name: df.select("frame_id", "point_idx", F.lit(name).alias("part"))
    return part(P.foreground(s), "fg").unionByName(part(P.background(s), "bg"))


VOXEL_FIRST = f"SELECT frame_id, vx, vy, vz, min(point_idx) AS point_idx, arg_min(label, point_idx)::INT AS label, count(*) AS n FROM (SELECT *, {VOX(0.2)} FROM scan) GROUP BY 1,2,3,4"


@query("agg_voxel_first_sem", oracle(VOXEL_FIRST))
def agg_voxel_first_sem(spark, d):
    return P.voxel_first(X.scan(spark, d), 0.2).select("frame_id", *P.CELL, "point_idx", "label", "n")


@query("agg_voxel_first", oracle(f"SELECT frame_id, vx, vy, vz, min(point_idx) AS point_idx FROM (SELECT *, {VOX(1.0)} FROM scan) GROUP BY 1,2,3,4"))
def agg_voxel_first(spark, d):
    return P.voxel_first(X.scan(spark, d), 1.0, carry=("x", "y", "z")).select("frame_id", *P.CELL, "point_idx")


CASCADE = f"""
, a AS (SELECT frame_id, arg_min(x, point_idx) x, arg_min(y, point_idx) y, arg_min(z, point_idx) z, min(point_idx) point_idx FROM (SELECT *, {VOX(0.5)} FROM scan) GROUP BY frame_id, vx, vy, vz),
b AS (SELECT frame_id, min(point_idx) point_idx FROM (SELECT *, {VOX(1.5)} FROM a) GROUP BY frame_id, vx, vy, vz),
c AS (SELECT frame_id, min(point_idx) point_idx FROM (SELECT *, {VOX(0.2)} FROM scan) GROUP BY frame_id, vx, vy, vz)
SELECT 'cluster' AS part, frame_id, point_idx FROM c UNION ALL SELECT 'map', frame_id, point_idx FROM a UNION ALL SELECT 'source', frame_id, point_idx FROM b"""


@query("agg_voxel_cascade", oracle(CASCADE))
def agg_voxel_cascade(spark, d):
    parts = P.voxel_cascade(X.scan(spark, d))
    out = [df.select(F.lit(name).alias("part"), "frame_id", "point_idx") for name, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


CAP = f"SELECT vx, vy, vz, slot, frame_id, point_idx, x, y, z, label FROM (SELECT *, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY frame_id, point_idx) - 1 AS slot FROM (SELECT *, {VOX(1.0)} FROM scan)) WHERE slot < 20"


@query("agg_voxel_cap", oracle(CAP.replace("slot,", "slot::INT AS slot,", 1).replace(", x, y, z, label FROM", " FROM", 1)))
def agg_voxel_cap(spark, d):
    return P.voxel_cap(X.scan(spark, d), 1.0).select(*P.CELL, "slot", "frame_id", "point_idx")


@query("agg_voxel_dump", oracle(f", cap AS ({CAP}) SELECT vx, vy, vz, slot::INT AS slot, x, y, z, label FROM cap"))
def agg_voxel_dump(spark, d):
    return P.voxel_dump(P.voxel_buckets(P.voxel_cap(X.scan(spark, d), 1.0))).select(*P.CELL, "slot", "x", "y", "z", "label")


@query(
    "flt_voxel_radius",
    oracle(f", cap AS MATERIALIZED ({CAP}), first AS (SELECT vx, vy, vz FROM cap WHERE slot = 0 AND (x-10)*(x-10)+(y-5)*(y-5)+z*z <= 900) SELECT vx, vy, vz, slot::INT AS slot, frame_id, point_idx FROM cap JOIN first USING (vx, vy, vz)"),
)
def flt_voxel_radius(spark, d):
    return P.drop_far_voxels(P.voxel_cap(X.scan(spark, d), 1.0), (10, 5, 0), 30.0).select(*P.CELL, "slot", "frame_id", "point_idx")


@query("set_map_append", oracle(f"SELECT vx, vy, vz, count(*) AS held FROM ({CAP}) GROUP BY 1,2,3"))
def set_map_append(spark, d):
    s = X.scan(spark, d)
    both = s.where("frame_id % 20 < 10").unionByName(s.where("frame_id % 20 >= 10"))
    return P.voxel_cap(both, 1.0).groupBy(*P.CELL).agg(F.count(F.lit(1)).alias("held"))


@query("set_union_points", oracle("SELECT frame_id, count(*) AS n, sum(point_idx)::BIGINT AS s FROM (SELECT * FROM fg UNION ALL SELECT * FROM bg) GROUP BY 1"))
def set_union_points(spark, d):
    s = X.scan(spark, d)
    return P.foreground(s).unionByName(P.background(s)).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.sum("point_idx").alias("s"))


@query("flt_remove_noise", oracle("SELECT frame_id, obj, count(*) AS n FROM fg GROUP BY 1, 2 HAVING count(*) > 10"))
def flt_remove_noise(spark, d):
    return P.label_histogram(P.foreground(X.scan(spark, d)), "obj", keys=("frame_id",)).select("frame_id", "obj", "n")


@query("srt_cluster", oracle("SELECT frame_id, obj, n, row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, obj)::INT AS place FROM (SELECT frame_id, obj, count(*) AS n FROM fg GROUP BY 1, 2 HAVING count(*) > 10)"))
def srt_cluster(spark, d):
    counted = P.label_histogram(P.foreground(X.scan(spark, d)), "obj", keys=("frame_id",))
    from pyspark.sql import Window

    return counted.select("frame_id", "obj", "n", F.row_number().over(Window.partitionBy("frame_id").orderBy(F.desc("n"), "obj")).alias("place"))


@query("src_mulran_time", oracle("SELECT frame_id, point_idx, CASE WHEN count(*) OVER (PARTITION BY frame_id) <> 65536 THEN 1.0::DOUBLE ELSE floor(point_idx/64)/1024 END AS t FROM pts"))
def src_mulran_time(spark, d):
    return P.sweep_time(X.points(spark, d)).select("frame_id", "point_idx", "t")


TIMES = "SELECT frame_id, point_idx, CASE WHEN m < 1 THEN t ELSE t/m END AS t FROM (SELECT *, max(t) OVER (PARTITION BY frame_id) AS m FROM (SELECT frame_id, point_idx, (point_idx % 1000)::DOUBLE AS t FROM pts))"


@query("src_msg_time", oracle(TIMES))
def src_msg_time(spark, d):
    rows = X.points(spark, d).withColumn("t", (F.col("point_idx") % 1000).cast("double"))
    return P.normalise_time(rows).select("frame_id", "point_idx", "t")


@query("win_time_norm", oracle(TIMES))
def win_time_norm(spark, d):
    return src_msg_time(spark, d)


CELLS = """
, apr AS (SELECT *, sqrt(x*x+y*y) AS rho FROM fg),
span AS (SELECT *, min(rho) OVER (PARTITION BY frame_id, label) AS lo, max(rho) OVER (PARTITION BY frame_id, label) AS hi FROM apr),
cells AS (SELECT frame_id, label, point_idx, x, y, z,
  trunc((atan2(z, rho) - radians(-24.8)) * (180/pi()) / 2.0)::INT AS ca,
  trunc((CASE WHEN x = 0 AND y = 0 THEN 0 WHEN y < 0 THEN atan2(y, x) + 2*pi() ELSE atan2(y, x) END) * (180/pi()) / 2.0)::INT AS cp,
  trunc((rho - lo)/0.5)::INT AS cr, (trunc((hi - lo)/0.5) + 1)::INT AS rings FROM span)"""


@query("cl_hash", oracle(CELLS + " SELECT frame_id, label, ca, cp, cr, count(*) AS n, min(point_idx) AS first_idx FROM cells GROUP BY 1,2,3,4,5"))
def cl_hash(spark, d):
    cells = C.with_cells(P.foreground(X.scan(spark, d)))
    return cells.groupBy("frame_id", "label", "ca", "cp", "cr").agg(F.count(F.lit(1)).alias("n"), F.min("point_idx").alias("first_idx"))


@query("fn_polar_key", oracle(CELLS + " SELECT frame_id, point_idx, ((cp*rings + cr) + ca*rings*180)::INT AS cell FROM cells"))
def fn_polar_key(spark, d):
    cells = C.with_cells(P.foreground(X.scan(spark, d)))
    return cells.select("frame_id", "point_idx", (F.col("cp") * F.col("rings") + F.col("cr") + F.col("ca") * F.col("rings") * 180).alias("cell"))


LINKS = (
    CELLS
    + """
, occ AS (SELECT frame_id, label, ca, cp, cr, rings, min(point_idx) AS first_idx FROM cells GROUP BY ALL),
link AS (SELECT a.frame_id, a.label, a.first_idx AS u, b.first_idx AS v FROM occ a JOIN occ b
  ON a.frame_id = b.frame_id AND a.label = b.label AND abs(a.ca - b.ca) <= 1 AND abs(a.cr - b.cr) <= 1
  AND ((a.cp - b.cp + 181) % 180) <= 2 AND b.ca BETWEEN 0 AND 13)"""
)


@query("cl_neighbors", oracle(LINKS + " SELECT frame_id, label, u, v FROM link"))
def cl_neighbors(spark, d):
    """Pairs of occupied cells, by their first points, where the first sees the second."""
    cells = C.with_cells(P.foreground(X.scan(spark, d)))
    occ = cells.groupBy("frame_id", "label", "ca", "cp", "cr", "rings").agg(F.min("point_idx").alias("first_idx"))
    spots = [F.struct((F.col("ca") + a).alias("ca"), F.pmod(F.col("cp") + p, F.lit(180)).alias("cp"), (F.col("cr") + r).alias("cr")) for a in (-1, 0, 1) for p in (-1, 0, 1) for r in (-1, 0, 1)]
    seen = occ.select("frame_id", "label", F.col("first_idx").alias("u"), "rings", F.explode(F.array(*spots)).alias("s"))
    seen = seen.select("frame_id", "label", "u", "rings", "s.*").where("ca between 0 and 13 and cr between 0 and rings - 1")
    return seen.join(occ.select("frame_id", "label", "ca", "cp", "cr", F.col("first_idx").alias("v")), ["frame_id", "label", "ca", "cp", "cr"]).select("frame_id", "label", "u", "v")


CLUSTERS = (
    LINKS
    + """
, sym AS (SELECT frame_id, label, u, v FROM link UNION SELECT frame_id, label, v, u FROM link),
reach AS (SELECT frame_id, label, first_idx AS u, first_idx AS v FROM occ UNION SELECT r.frame_id, r.label, r.u, b.v FROM reach r JOIN sym b ON r.frame_id = b.frame_id AND r.label = b.label AND r.v = b.u),
comp AS (SELECT frame_id, label, u, min(v) AS cluster FROM reach GROUP BY 1,2,3),
seen AS (SELECT DISTINCT frame_id, label, u FROM sym),
named AS (SELECT c.frame_id, c.label, c.point_idx, c.x, c.y, c.z, CASE WHEN s.u IS NULL THEN c.point_idx ELSE k.cluster END AS cluster
  FROM cells c JOIN occ o USING (frame_id, label, ca, cp, cr) JOIN comp k ON k.frame_id = o.frame_id AND k.label = o.label AND k.u = o.first_idx
  LEFT JOIN seen s ON s.frame_id = o.frame_id AND s.label = o.label AND s.u = o.first_idx)"""
)


def recursive(query_text: str) -> str:
    return oracle(query_text).replace("WITH ", "WITH RECURSIVE ", 1)


@query("cl_cluster", recursive(CLUSTERS + " SELECT frame_id, label, point_idx, cluster FROM named"))
def cl_cluster(spark, d):
    return C.cluster(P.foreground(X.scan(spark, d))).select("frame_id", "label", "point_idx", "cluster")


BOXES = CLUSTERS + """
, box AS (SELECT frame_id, label AS train, cluster, min(x) lx, max(x) hx, min(y) ly, max(y) hy, min(z) lz, max(z) hz, count(*) AS points_num FROM named GROUP BY 1,2,3)"""


@query("agg_cluster_bbox", recursive(BOXES + " SELECT frame_id, train, cluster, round((lx+hx)/2, 6) AS cx, round(hx-lx, 6) AS dx, round((lz+hz)/2, 6) AS cz, round(hz-lz, 6) AS dz, points_num FROM box"))
def agg_cluster_bbox(spark, d):
    b = C.boxes(C.cluster(P.foreground(X.scan(spark, d))), 1)
    return b.select("frame_id", "train", "cluster", *[F.round(c, 6).alias(c) for c in ("cx", "dx", "cz", "dz")], "points_num")


@query("flt_cluster_size", recursive(BOXES + " SELECT frame_id, train, cluster, points_num FROM box WHERE points_num >= 10"))
def flt_cluster_size(spark, d):
    return C.boxes(C.cluster(P.foreground(X.scan(spark, d)))).select("frame_id", "train", "cluster", "points_num")


KEPT = " WHERE points_num >= 10 AND CASE WHEN train IN (1,4,5) THEN hx-lx >= 0.5 AND hy-ly >= 0.5 AND hz-lz >= 0.3 ELSE hz-lz >= 0.3 END"


@query("flt_box_size", recursive(BOXES + " SELECT frame_id, train, cluster, points_num FROM box" + KEPT))
def flt_box_size(spark, d):
    return C.filter_box_size(C.boxes(C.cluster(P.foreground(X.scan(spark, d))))).select("frame_id", "train", "cluster", "points_num")


@query(
    "cl_objects",
    recursive(BOXES + f" SELECT frame_id, (row_number() OVER (PARTITION BY frame_id ORDER BY train, cluster) - 1)::INT AS node_id, CASE WHEN train IN (1,4,5) THEN 1 WHEN train = 16 THEN 2 ELSE 3 END AS label, round((lx+hx)/2, 6) AS cx, round((ly+hy)/2, 6) AS cy, round((lz+hz)/2, 6) AS cz, points_num::INT AS points_num FROM box{KEPT}"),
)
def cl_objects(spark, d):
    found = C.objects(X.scan(spark, d))
    return found.select("frame_id", "node_id", "label", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cz")], "points_num")


@query("cl_cluster_faithful")
def cl_cluster_faithful(spark, d):
    return C.cluster(P.foreground(X.scan(spark, d)), mode="faithful").select("frame_id", "label", "point_idx", "cluster")


@query("cl_merge", recursive(CLUSTERS + " SELECT frame_id, label, count(DISTINCT cluster) AS clusters FROM named GROUP BY 1,2"))
def cl_merge(spark, d):
    return C.cluster(P.foreground(X.scan(spark, d))).groupBy("frame_id", "label").agg(F.countDistinct("cluster").alias("clusters"))


@query(
    "flt_new_instance",
    oracle("SELECT frame_id, node_id, label FROM nodes WHERE CASE WHEN label = 1 THEN points_num >= 50 AND dx >= 1 AND dy >= 1 AND dz >= 1 ELSE dz >= 1 END"),
)
def flt_new_instance(spark, d):
    return C.filter_new_instance(X.nodes(spark, d)).select("frame_id", "node_id", "label")


@query("flt_map_radius", oracle("SELECT frame_id, node_id FROM nodes WHERE (cx-10)*(cx-10)+(cy-5)*(cy-5)+cz*cz <= 1600"))
def flt_map_radius(spark, d):
    at = (F.lit(10.0), F.lit(5.0), F.lit(0.0))
    return X.nodes(spark, d).where(G.square_distance(G.xyz("c"), at) <= 40.0**2).select("frame_id", "node_id")
