"""Queries on scene graphs and scan descriptors."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions import labels as L
from voxloom.operators import descriptors as D
from voxloom.operators import points as P
from voxloom.operators import scene_graph as S
from voxloom.plans import fixtures as X
from voxloom.plans.catalog import query
from voxloom.plans.fixtures import oracle
from voxloom.plans.q_functions import FAST, VALUES
from voxloom.plans.scratch import cut

R6 = lambda c, name: F.round(c, 6).alias(name)


@query("join_edges", oracle("SELECT frame_id, i, j, round(dist, 6) AS dist, round(weight, 6) AS weight FROM edges"))
def join_edges(spark, d):
    return S.edges(X.nodes(spark, d)).select("frame_id", "i", "j", R6(F.col("dist"), "dist"), R6(F.col("weight"), "weight"))


@query("join_map_edges", oracle(", m AS (SELECT frame_id // 3 AS map, (frame_id*10000+node_id)::INT AS id, label, cx + frame_id AS x, cy AS y, cz AS z FROM nodes) SELECT a.id AS i, b.id AS j, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 6) AS dist FROM m a JOIN m b ON a.map = b.map AND a.id < b.id WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) < 60"))
def join_map_edges(spark, d):
    n = X.nodes(spark, d)
    m = n.select(F.floor(F.col("frame_id") / 3).alias("frame_id"), (F.col("frame_id") * 10000 + F.col("node_id")).cast("int").alias("node_id"), "label", (F.col("cx") + F.col("frame_id")).alias("cx"), "cy", "cz")
    return S.edges(m).select("i", "j", R6(F.col("dist"), "dist"))


@query("set_undirected", oracle("SELECT frame_id, count(*) AS n FROM edges GROUP BY 1"))
def set_undirected(spark, d):
    return S.edges(X.nodes(spark, d)).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))


@query("agg_class_counts", oracle("SELECT frame_id, count(CASE WHEN label=1 THEN 1 END) AS vehicle_num, count(CASE WHEN label=2 THEN 1 END) AS trunk_num, count(CASE WHEN label=3 THEN 1 END) AS pole_num FROM nodes GROUP BY 1"))
def agg_class_counts(spark, d):
    return S.class_counts(X.nodes(spark, d))


@query("agg_node_hist", oracle("SELECT frame_id, i AS node_id, ((lj-1)*30 + floor(dist/2))::INT AS slot, count(*) AS n FROM near GROUP BY 1, 2, 3"))
def agg_node_hist(spark, d):
    return S.node_histogram(X.nodes(spark, d))


HIST = ", h AS (SELECT frame_id, i AS node_id, ((lj-1)*30 + floor(dist/2))::INT AS slot, count(*) AS n FROM near GROUP BY 1, 2, 3)"


@query("node_desc_local", oracle(HIST + " SELECT frame_id, node_id, slot, round(n/sqrt(sum(n*n) OVER (PARTITION BY frame_id, node_id)), 6) AS v FROM h"))
def node_desc_local(spark, d):
    rows = S.local_descriptors(X.nodes(spark, d))
    flat = rows.select("frame_id", "node_id", F.posexplode("v").alias("slot", "v")).where("v > 0")
    return flat.select("frame_id", "node_id", "slot", R6(F.col("v"), "v"))


PLACE = "CASE WHEN li=1 AND lj=1 THEN 0 WHEN li=2 AND lj=2 THEN 1 WHEN li=3 AND lj=3 THEN 2 WHEN least(li,lj)=2 THEN 3 WHEN greatest(li,lj)=2 THEN 4 ELSE 5 END"
GRAPH_HIST = f", gh AS (SELECT frame_id, ({PLACE}*30 + floor(dist/2.0) + 3)::INT AS slot, count(*) AS n FROM edges GROUP BY 1, 2)"


@query("agg_graph_hist", oracle(GRAPH_HIST + " SELECT frame_id, slot, n FROM gh"))
def agg_graph_hist(spark, d):
    return D.edge_histogram(S.edges(X.nodes(spark, d)))


COUNTS = ", cc AS (SELECT frame_id, count(CASE WHEN label=1 THEN 1 END) AS a, count(CASE WHEN label=2 THEN 1 END) AS b, count(CASE WHEN label=3 THEN 1 END) AS c FROM nodes GROUP BY 1)"
GRAPH_DESC = (
    GRAPH_HIST
    + COUNTS
    + """
, gn AS (SELECT frame_id, slot, n/sqrt(sum(n*n) OVER (PARTITION BY frame_id)) AS v FROM gh),
ga AS (SELECT frame_id, slot, v FROM gn UNION ALL SELECT frame_id, 0, a/sqrt(a*a+b*b+c*c) FROM cc UNION ALL SELECT frame_id, 1, b/sqrt(a*a+b*b+c*c) FROM cc UNION ALL SELECT frame_id, 2, c/sqrt(a*a+b*b+c*c) FROM cc),
gd AS (SELECT frame_id, slot, v/sqrt(sum(v*v) OVER (PARTITION BY frame_id)) AS v FROM ga)"""
)


@query("lc_graph_descriptor", oracle(GRAPH_DESC + " SELECT frame_id, slot::INT AS slot, round(v, 5) AS v FROM gd WHERE v > 0"))
def lc_graph_descriptor(spark, d):
    rows = D.graph_descriptors(X.nodes(spark, d)).select("frame_id", F.posexplode("v").alias("slot", "v")).where("v > 0")
    return rows.select("frame_id", "slot", F.round("v", 5).alias("v"))


RING = f", cell AS (SELECT frame_id, point_idx, label, trunc((rho - 5.0)/((50.0-5.0)/24))::INT AS ring, trunc(ang)::INT AS sector FROM (SELECT *, sqrt(x*x+y*y) AS rho FROM ({FAST})) WHERE rho >= 5 AND rho < 50 AND trunc((rho - 5.0)/((50.0-5.0)/24)) < 24 AND trunc(ang) BETWEEN 0 AND 359)"
RING = RING.replace("(50.0-5.0)/24", "1.875::DOUBLE")


@query("flt_ring", oracle(RING + " SELECT frame_id, point_idx, ring, sector FROM cell"))
def flt_ring(spark, d):
    return D.ring_cells(X.scan(spark, d)).select("frame_id", "point_idx", "ring", "sector")


OCCUPIED = RING + ", ro AS (SELECT frame_id, ring + CASE WHEN label = 9 THEN 24 ELSE 0 END AS slot, count(DISTINCT sector) AS n FROM cell WHERE label IN (9, 13) GROUP BY 1, 2)"


@query("agg_ring_desc", oracle(OCCUPIED + " SELECT frame_id, slot, n FROM ro"))
def agg_ring_desc(spark, d):
    return D.ring_occupancy(X.scan(spark, d))


@query("lc_descriptor", oracle(GRAPH_DESC + OCCUPIED + ", rn AS (SELECT frame_id, slot + 183 AS slot, n/sqrt(sum(n*n) OVER (PARTITION BY frame_id)) AS v FROM ro), al AS (SELECT frame_id, slot, v FROM gd UNION ALL SELECT frame_id, slot, v FROM rn WHERE frame_id IN (SELECT frame_id FROM gd)) SELECT frame_id, slot::INT AS slot, round((v/sqrt(sum(v*v) OVER (PARTITION BY frame_id)))::FLOAT::DOUBLE, 4) AS v FROM al WHERE v > 0"))
def lc_descriptor(spark, d):
    rows = D.scan_descriptors(X.nodes(spark, d), X.scan(spark, d)).select("frame_id", F.posexplode("desc").alias("slot", "v")).where("v > 0")
    return rows.select("frame_id", "slot", F.round(F.col("v").cast("double"), 4).alias("v"))


BEST = RING + f", pri AS (SELECT * FROM (VALUES {VALUES(L.PRIORITY)}) t(label, p)), cl AS (SELECT frame_id, ring, sector, arg_max(label, p)::INT AS label FROM cell JOIN pri USING (label) WHERE label NOT IN (14, 15) AND p > 0 GROUP BY 1, 2, 3)"


@query("agg_cell_priority", oracle(BEST + " SELECT frame_id, ring, sector, label FROM cl"))
def agg_cell_priority(spark, d):
    return D.label_cells(X.scan(spark, d))


@query("agg_cell_sim", oracle(BEST + ", ij AS (SELECT a.frame_id AS a, b.frame_id AS b FROM poses a JOIN poses b ON b.frame_id BETWEEN a.frame_id + 1 AND a.frame_id + 5), u AS (SELECT ij.a, ij.b, c.ring, c.sector, c.label AS l, NULL AS r FROM ij JOIN cl c ON c.frame_id = ij.a UNION ALL SELECT ij.a, ij.b, c.ring, c.sector, NULL, c.label FROM ij JOIN cl c ON c.frame_id = ij.b), m AS (SELECT a, b, ring, sector, max(l) AS l, max(r) AS r FROM u GROUP BY 1,2,3,4) SELECT a, b, round(avg(CASE WHEN l = r THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS similarity FROM m GROUP BY 1, 2"))
def agg_cell_sim(spark, d):
    """Each frame with the five after it."""
    ids = cut(X.raw_points(spark, d).select(F.col("frame_id").alias("b")).distinct(), "frames")
    ahead = ids.select(F.col("b").alias("a"), F.explode(F.sequence(F.col("b") + 1, F.col("b") + 5)).alias("b"))
    pair_rows = cut(ahead.join(ids, "b").select("a", "b"), "pairs")
    return D.cell_similarity(cut(D.label_cells(X.scan(spark, d)), "cells"), pair_rows).select("a", "b", R6(F.col("similarity"), "similarity"))


TRI = """
, nb AS (SELECT frame_id, i, j, dist, jx, jy, jz FROM pairs WHERE dist < 20 AND dist > 0),
enough AS (SELECT frame_id, i FROM nb GROUP BY 1, 2 HAVING count(*) > 2),
tri AS (SELECT a.frame_id, a.i AS node_id, a.j AS m, b.j AS n, list_sort([a.dist::FLOAT, b.dist::FLOAT, sqrt((a.jx-b.jx)*(a.jx-b.jx)+(a.jy-b.jy)*(a.jy-b.jy)+(a.jz-b.jz)*(a.jz-b.jz))::FLOAT]) AS s
  FROM nb a JOIN nb b ON a.frame_id = b.frame_id AND a.i = b.i AND a.j < b.j JOIN enough e ON e.frame_id = a.frame_id AND e.i = a.i)"""


@query("gr_triangles", oracle(TRI + " SELECT frame_id, node_id, m, n, round(s[1]::DOUBLE, 5) AS a, round(s[2]::DOUBLE, 5) AS b, round(s[3]::DOUBLE, 5) AS c FROM tri"))
def gr_triangles(spark, d):
    t = S.triangles(X.nodes(spark, d))
    return t.select("frame_id", "node_id", "m", "n", *[F.round(c, 5).alias(c) for c in "abc"])


@query("srt_triangle", oracle(TRI + " SELECT frame_id, node_id, count(*) AS n, bool_and(s[1] <= s[2] AND s[2] <= s[3]) AS sorted FROM tri GROUP BY 1, 2"))
def srt_triangle(spark, d):
    t = S.triangles(X.nodes(spark, d))
    return t.groupBy("frame_id", "node_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("a") <= F.col("b")) & (F.col("b") <= F.col("c"))).alias("sorted"))


@query("gr_build", oracle("SELECT n.frame_id, count(DISTINCT n.node_id) AS nodes, count(e.i) AS edges, round(coalesce(sum(e.weight), 0), 3) AS weight FROM nodes n LEFT JOIN edges e ON e.frame_id = n.frame_id AND e.i = n.node_id GROUP BY 1"))
def gr_build(spark, d):
    nodes = X.nodes(spark, d)
    counted = nodes.groupBy("frame_id").agg(F.count(F.lit(1)).alias("nodes"))
    edges = S.edges(nodes).groupBy("frame_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight"))
    both = counted.join(edges, "frame_id", "left")
    return both.select("frame_id", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), F.round(F.coalesce("weight", F.lit(0.0)), 3).alias("weight"))


@query("gr_rebuild", oracle(", m AS (SELECT frame_id // 3 AS frame_id, (frame_id*10000+node_id)::INT AS node_id, label, cx, cy, cz FROM nodes) SELECT a.node_id, ((b.label-1)*30 + floor(sqrt((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)+(a.cz-b.cz)*(a.cz-b.cz))/2))::INT AS slot, count(*) AS n FROM m a JOIN m b USING (frame_id) WHERE sqrt((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)+(a.cz-b.cz)*(a.cz-b.cz)) < 60 GROUP BY 1, 2"))
def gr_rebuild(spark, d):
    n = X.nodes(spark, d)
    m = n.select(F.floor(F.col("frame_id") / 3).alias("frame_id"), (F.col("frame_id") * 10000 + F.col("node_id")).cast("int").alias("node_id"), "label", "cx", "cy", "cz")
    return S.node_histogram(m).select("node_id", "slot", "n")


@query("gr_eigen")
def gr_eigen(spark, d):
    return S.eigenvalues(X.nodes(spark, d))


@query("top_eigs")
def top_eigs(spark, d):
    return S.node_descriptors(X.nodes(spark, d)).select("frame_id", "node_id", F.slice("desc", 91, 30).alias("top"))


@query("node_descriptors")
def node_descriptors(spark, d):
    return S.node_descriptors(X.nodes(spark, d))
