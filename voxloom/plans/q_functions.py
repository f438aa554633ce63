"""Queries on scalar functions and ordered analytics of poses."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.functions import labels as L
from voxloom.operators import graph_map as M
from voxloom.operators import points as P
from voxloom.operators import trajectory as T
from voxloom.plans import fixtures as X
from voxloom.plans.catalog import query
from voxloom.plans.fixtures import oracle

R6 = lambda c, name: F.round(c, 6).alias(name)
VALUES = lambda table: ", ".join(f"({k}, {v})" for k, v in table.items())


@query("fn_label_map", f"SELECT s.raw::INT AS raw_label, coalesce(m.label, 0)::INT AS label FROM (SELECT DISTINCT l_partkey % 300 AS raw FROM lineitem) s LEFT JOIN (VALUES {VALUES(L.RAW_TO_TRAIN)}) m(raw, label) USING (raw)")
def fn_label_map(spark, d):
    raws = X.table(spark, d, "lineitem").select((F.col("l_partkey") % 300).cast("int").alias("raw_label")).distinct()
    return P.relabel(raws).select("raw_label", F.col("label").cast("int").alias("label"))


@query("src_label_bits", "SELECT l_orderkey::BIGINT AS k, l_linenumber::BIGINT AS n, l_partkey::BIGINT AS p, ((l_partkey * 65536 + l_suppkey) & 65535)::BIGINT AS low FROM lineitem")
def src_label_bits(spark, d):
    rows = X.table(spark, d, "lineitem")
    packed = F.col("l_partkey").cast("bigint") * 65536 + F.col("l_suppkey")
    return rows.select(F.col("l_orderkey").cast("bigint").alias("k"), F.col("l_linenumber").cast("bigint").alias("n"), F.col("l_partkey").cast("bigint").alias("p"), packed.bitwiseAND(0xFFFF).alias("low"))


@query("fn_semantic_weight", oracle(f"SELECT label, count(*) AS n, round(sum(w), 3) AS total FROM pts JOIN (VALUES {VALUES(L.WEIGHT)}) t(label, w) USING (label) GROUP BY label").replace("round(sum(w), 3)", "round(sum(w::DOUBLE), 3)"))
def fn_semantic_weight(spark, d):
    rows = X.points(spark, d)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(L.semantic_weight(F.col("label"))), 3).alias("total"))


@query("fn_color", "SELECT * FROM (VALUES " + ", ".join(f"({k}, {v[0]}, {v[1]}, {v[2]})" for k, v in L.COLOUR.items()) + ") t(label, r, g, b)")
def fn_color(spark, d):
    return spark.range(26).select(F.col("id").cast("int").alias("label")).withColumn("c", L.colour(F.col("label"))).select("label", "c.*")


@query("fn_fix_frame_id", "SELECT url, regexp_replace('/' || url, '^/', '') AS fixed FROM pages")
def fn_fix_frame_id(spark, d):
    return X.table(spark, d, "pages").select("url", G.strip_leading_slash(F.concat(F.lit("/"), "url")).alias("fixed"))


@query("fn_norm", oracle("SELECT frame_id, point_idx, round(sqrt(x*x+y*y+z*z), 6) AS r FROM pts"))
def fn_norm(spark, d):
    return X.points(spark, d).select("frame_id", "point_idx", R6(G.norm(G.xyz()), "r"))


COS, SIN = math.cos(math.radians(0.205)), math.sin(math.radians(0.205))


@query("fn_kitti_correct", oracle(f"SELECT frame_id, point_idx, round(x*{COS!r} - x*z/rho*{SIN!r}, 6) AS x, round(y*{COS!r} - y*z/rho*{SIN!r}, 6) AS y, round(z*{COS!r} + rho*{SIN!r}, 6) AS z FROM (SELECT *, sqrt(x*x+y*y) AS rho FROM scan)"))
def fn_kitti_correct(spark, d):
    return P.correct_sweep(X.scan(spark, d)).select("frame_id", "point_idx", *[R6(F.col(c), c) for c in "xyz"])


@query("fn_transform", oracle("SELECT frame_id, point_idx, label, round(c*x - s*y + tx, 6) AS x, round(s*x + c*y + ty, 6) AS y, round(z, 6) AS z FROM scan JOIN poses USING (frame_id)"))
def fn_transform(spark, d):
    return P.transform(X.scan(spark, d), X.frame_poses(spark, d)).select("frame_id", "point_idx", "label", *[R6(F.col(c), c) for c in "xyz"])


@query("fn_pack", oracle("SELECT frame_id, point_idx, [x, y, z, label::DOUBLE] AS packed FROM scan"))
def fn_pack(spark, d):
    return X.scan(spark, d).select("frame_id", "point_idx", F.array("x", "y", "z", F.col("label").cast("double")).alias("packed"))


@query("fn_unpack", oracle("SELECT frame_id, point_idx, x, y, z, label FROM scan"))
def fn_unpack(spark, d):
    p = F.col("packed")
    return fn_pack(spark, d).select("frame_id", "point_idx", *[p[i].alias(c) for i, c in enumerate("xyz")], p[3].cast("int").alias("label"))


@query("fn_polar", oracle("SELECT frame_id, point_idx, round(CASE WHEN x = 0 AND y = 0 THEN 0 WHEN y < 0 THEN atan2(y, x) + 2*pi() ELSE atan2(y, x) END, 6) AS a FROM pts"))
def fn_polar(spark, d):
    return X.points(spark, d).select("frame_id", "point_idx", R6(G.polar_angle(G.xyz()), "a"))


@query("fn_apr", oracle("SELECT frame_id, label, count(*) AS n, round(min(sqrt(x*x+y*y)), 6) AS least, round(max(sqrt(x*x+y*y)), 6) AS most, round(max(atan2(z, sqrt(x*x+y*y))), 6) AS top FROM fg GROUP BY 1, 2"))
def fn_apr(spark, d):
    p = G.xyz()
    rho = G.planar_range(p)
    fg = P.foreground(X.scan(spark, d))
    return fg.groupBy("frame_id", "label").agg(F.count(F.lit(1)).alias("n"), R6(F.min(rho), "least"), R6(F.max(rho), "most"), R6(F.max(G.elevation(p)), "top"))


P1, P3, P5, P7 = G.ATAN_DEGREES
FAST = f"""SELECT *, CASE WHEN y < 0 THEN 360.0::DOUBLE - a2 ELSE a2 END AS ang FROM (SELECT *, CASE WHEN x < 0 THEN 180.0::DOUBLE - a1 ELSE a1 END AS a2 FROM (
SELECT *, CASE WHEN abs(x) >= abs(y) THEN poly ELSE 90.0::DOUBLE - poly END AS a1 FROM (SELECT *, (((c2*({P7!r}::DOUBLE) + {P5!r}::DOUBLE)*c2 + ({P3!r}::DOUBLE))*c2 + {P1!r}::DOUBLE)*c AS poly FROM (
SELECT *, c*c AS c2 FROM (SELECT *, least(abs(x), abs(y)) / (greatest(abs(x), abs(y)) + {G.EPSILON!r}::DOUBLE) AS c FROM scan)))))"""


@query("fn_fast_atan2", oracle(f"SELECT frame_id, point_idx, round(ang, 6) AS ang, trunc(ang)::INT AS sector FROM ({FAST})"))
def fn_fast_atan2(spark, d):
    a = G.fast_angle(F.col("y"), F.col("x"))
    return X.scan(spark, d).select("frame_id", "point_idx", R6(a, "ang"), a.cast("int").alias("sector"))


@query("fn_voxel_key", oracle("SELECT frame_id, point_idx, trunc(x/0.2)::BIGINT AS vx, trunc(y/0.2)::BIGINT AS vy, trunc(z/0.2)::BIGINT AS vz FROM pts"))
def fn_voxel_key(spark, d):
    return X.points(spark, d).select("frame_id", "point_idx", *G.voxel_key(G.xyz(), 0.2))


@query("fn_bbox", oracle("SELECT frame_id, obj, round((min(x)+max(x))/2, 6) AS cx, round(max(x)-min(x), 6) AS dx FROM fg GROUP BY 1, 2"))
def fn_bbox(spark, d):
    fg = P.foreground(X.scan(spark, d))
    return fg.groupBy("frame_id", "obj").agg(R6((F.min("x") + F.max("x")) / 2, "cx"), R6(F.max("x") - F.min("x"), "dx"))


@query("fn_edge_weight", "SELECT l_orderkey::BIGINT AS k, l_linenumber::BIGINT AS n, l_partkey::BIGINT AS p, round((60 - l_quantity::DOUBLE)/60, 6) AS w FROM lineitem")
def fn_edge_weight(spark, d):
    rows = X.table(spark, d, "lineitem")
    return rows.select(F.col("l_orderkey").cast("bigint").alias("k"), F.col("l_linenumber").cast("bigint").alias("n"), F.col("l_partkey").cast("bigint").alias("p"), R6(G.edge_weight(F.col("l_quantity").cast("double")), "w"))


NEXT = ", n AS (SELECT a.kf_seq, a.d AS u, b.d AS v FROM kf a JOIN kf b ON b.kf_seq = a.kf_seq + 1)"


def _next(spark, d):
    k = X.keyframes(spark, d)
    return k.select("kf_seq", F.col("desc").alias("u")).join(k.select((F.col("kf_seq") - 1).alias("kf_seq"), F.col("desc").alias("v")), "kf_seq")


@query("fn_cos_sim", oracle(NEXT + " SELECT kf_seq, round(list_dot_product(u, v)/(sqrt(list_dot_product(u, u))*sqrt(list_dot_product(v, v))), 6) AS s FROM n"))
def fn_cos_sim(spark, d):
    return _next(spark, d).select("kf_seq", R6(G.cosine_similarity(F.col("u"), F.col("v")), "s"))


@query("fn_l2_normalise", oracle(" SELECT kf_seq, list_transform(d, lambda x: round(x*3/(3*sqrt(list_dot_product(d, d))), 5)) AS v FROM kf"))
def fn_l2_normalise(spark, d):
    v = F.transform("desc", lambda x: x.cast("double") * 3)
    return X.keyframes(spark, d).select("kf_seq", F.transform(G.l2_normalise(v), lambda x: G.rounded(x, 5)).alias("v"))


@query("fn_concat_desc", oracle(NEXT + " SELECT kf_seq, list_concat(u, v) AS v FROM n"))
def fn_concat_desc(spark, d):
    return _next(spark, d).select("kf_seq", F.concat("u", "v").cast("array<double>").alias("v"))


@query("fn_robust_weight", oracle("SELECT frame_id, point_idx, round(0.25/((z*z+0.5)*(z*z+0.5)), 6) AS w FROM pts"))
def fn_robust_weight(spark, d):
    return X.points(spark, d).select("frame_id", "point_idx", R6(G.robust_weight(F.col("z") * F.col("z"), 0.5), "w"))


REL = ", p AS (SELECT a.frame_id, a.c AS ac, a.s AS sa, a.tx AS ax, a.ty AS ay, b.c AS bc, b.s AS bs, b.tx AS bx, b.ty AS by_ FROM poses a JOIN poses b ON b.frame_id = a.frame_id + 1), r AS (SELECT frame_id, ac*bc + sa*bs AS rc, ac*bs - sa*bc AS rs, ac*(bx-ax) + sa*(by_-ay) AS x, -sa*(bx-ax) + ac*(by_-ay) AS y FROM p)"


def _rel(spark, d):
    return T.relative_motion(X.frame_poses(spark, d))


@query("fn_model_error", oracle(REL + " SELECT frame_id AS src, round(sqrt(x*x+y*y) + 200*sin(acos(greatest(-1, least(1, rc)))/2), 6) AS e FROM r"))
def fn_model_error(spark, d):
    return _rel(spark, d).select("src", R6(G.model_error(F.col("rel"), 100.0), "e"))


@query("fn_rot_err", oracle(REL + " SELECT frame_id AS src, round(acos(greatest(-1, least(1, rc))), 6) AS e FROM r"))
def fn_rot_err(spark, d):
    return _rel(spark, d).select("src", R6(G.rotation_angle(F.col("rel")), "e"))


@query("fn_trans_err", oracle(REL + " SELECT frame_id AS src, round(sqrt(x*x+y*y), 6) AS e FROM r"))
def fn_trans_err(spark, d):
    return _rel(spark, d).select("src", R6(G.translation_norm(F.col("rel")), "e"))


MATRIX = "[round(rc,6)+0.0, round(-rs,6)+0.0, 0.0, round(x,6)+0.0, round(rs,6)+0.0, round(rc,6)+0.0, 0.0, round(y,6)+0.0, 0.0, 0.0, 1.0, 0.0]::DOUBLE[]"


@query("fn_compose", oracle(REL + f" SELECT frame_id AS src, {MATRIX} AS m FROM r"))
def fn_compose(spark, d):
    p = X.frame_poses(spark, d)
    both = p.select("frame_id", F.col("m").alias("a")).join(p.select((F.col("frame_id") - 1).alias("frame_id"), F.col("m").alias("b")), "frame_id")
    m = G.compose_pose(G.inverse_pose(F.col("a")), F.col("b"))
    return both.select(F.col("frame_id").alias("src"), F.transform(m, lambda x: F.round(x, 6) + 0.0).alias("m"))


@query("fn_inverse", oracle("SELECT frame_id, [c, s, 0.0, round(-(c*tx + s*ty), 6)+0.0, -s+0.0, c, 0.0, round(s*tx - c*ty, 6)+0.0, 0.0, 0.0, 1.0, 0.0]::DOUBLE[] AS m FROM poses"))
def fn_inverse(spark, d):
    return X.frame_poses(spark, d).select("frame_id", F.transform(G.inverse_pose(F.col("m")), lambda x: F.round(x, 6) + 0.0).alias("m"))


@query("win_rel_pose", oracle(REL + f" SELECT frame_id AS src, frame_id + 1 AS dst, {MATRIX} AS rel FROM r"))
def win_rel_pose(spark, d):
    return _rel(spark, d).select("src", "dst", F.transform("rel", lambda x: F.round(x, 6) + 0.0).alias("rel"))


@query("win_motion_model", oracle(REL + " SELECT f.frame_id, round(coalesce(r.x, 0), 6) AS x, round(coalesce(r.y, 0), 6) AS y, round(coalesce(r.rc, 1), 6) AS c FROM poses f LEFT JOIN r ON r.frame_id = f.frame_id - 2"))
def win_motion_model(spark, d):
    m = T.motion_model(X.frame_poses(spark, d))
    return m.select("frame_id", R6(F.col("prediction")[3], "x"), R6(F.col("prediction")[7], "y"), R6(F.col("prediction")[0], "c"))


@query("win_initial_guess", oracle(REL + " SELECT f.frame_id, round(coalesce(q.tx + q.c*coalesce(r.x,0) - q.s*coalesce(r.y,0), 0), 6) AS x, round(coalesce(q.ty + q.s*coalesce(r.x,0) + q.c*coalesce(r.y,0), 0), 6) AS y FROM poses f LEFT JOIN r ON r.frame_id = f.frame_id - 2 LEFT JOIN poses q ON q.frame_id = f.frame_id - 1"))
def win_initial_guess(spark, d):
    m = T.motion_model(X.frame_poses(spark, d))
    return m.select("frame_id", R6(F.col("guess")[3], "x"), R6(F.col("guess")[7], "y"))


MOVED = oracle("SELECT frame_id, sqrt(tx*tx + ty*ty) > 0.5 AS moved FROM poses")


@query("win_has_moved", MOVED)
def win_has_moved(spark, d):
    return T.has_moved(X.frame_poses(spark, d)).select("frame_id", "moved")


@query("flt_motion", oracle("SELECT frame_id FROM poses WHERE sqrt(tx*tx + ty*ty) > 0.5"))
def flt_motion(spark, d):
    return T.has_moved(X.frame_poses(spark, d)).where("moved").select("frame_id")


@query("flt_reloc_trigger", oracle(REL + " SELECT frame_id AS src FROM r WHERE frame_id > 2 AND (sqrt(x*x+y*y) > 0.6 OR acos(greatest(-1, least(1, rc))) > 0.01)"))
def flt_reloc_trigger(spark, d):
    e = _rel(spark, d).where("src > 2")
    return e.where((G.translation_norm(F.col("rel")) > 0.6) | (G.rotation_angle(F.col("rel")) > 0.01)).select("src")


@query("win_cumdist", oracle("SELECT seq_id, frame_id, round(sum(step) OVER (PARTITION BY seq_id ORDER BY frame_id), 5) AS dist FROM (SELECT seq_id, frame_id, abs(coalesce(tx - lag(tx) OVER (PARTITION BY seq_id ORDER BY frame_id), 0)) AS step FROM pr)"))
def win_cumdist(spark, d):
    return T.cumulative_distance(X.predicted(spark, d)).select("seq_id", "frame_id", F.round("dist", 5).alias("dist"))


ENDS = ", starts AS (SELECT seq_id, frame_id AS first, unnest([100,200,300,400,500,600,700,800]) AS length FROM gt WHERE frame_id % 10 = 0), ends AS (SELECT s.seq_id, first, length, min(g.frame_id) AS last FROM starts s JOIN gt g ON g.seq_id = s.seq_id AND g.tx > s.first + s.length GROUP BY 1, 2, 3)"


@query("win_step", oracle(ENDS + " SELECT seq_id, first, length::INT AS length FROM starts"))
def win_step(spark, d):
    frames = X.truth(spark, d).where(F.col("frame_id") % T.STEP == 0)
    return frames.select("seq_id", F.col("frame_id").alias("first"), F.explode(F.array(*map(F.lit, T.LENGTHS))).alias("length"))


@query("join_segment_end", oracle(ENDS + " SELECT seq_id, first, length::INT AS length, last FROM ends"))
def join_segment_end(spark, d):
    return T.segment_ends(T.cumulative_distance(X.truth(spark, d))).select("seq_id", "first", "length", "last")


@query("join_traj", oracle("SELECT seq_id, frame_id, round(gt.tx, 5) AS g, round(pr.tx, 5) AS p FROM gt JOIN pr USING (seq_id, frame_id)"))
def join_traj(spark, d):
    return T.join_truth(X.truth(spark, d), X.predicted(spark, d)).select("seq_id", "frame_id", F.round(F.col("gt")[3], 5).alias("g"), F.round(F.col("pr")[3], 5).alias("p"))


@query("agg_rmse", oracle("SELECT seq_id, round(sqrt(avg((pr.tx-gt.tx)*(pr.tx-gt.tx))), 6) AS ate_rmse, 0.0::DOUBLE AS rot_rmse_deg FROM gt JOIN pr USING (seq_id, frame_id) GROUP BY 1"))
def agg_rmse(spark, d):
    return T.absolute_errors(T.join_truth(X.truth(spark, d), X.predicted(spark, d))).select("seq_id", R6(F.col("ate_rmse"), "ate_rmse"), R6(F.col("rot_rmse_deg"), "rot_rmse_deg"))


DRIFT = oracle(ENDS + " SELECT e.seq_id, round(avg(abs((b.tx-a.tx)-(h.tx-g.tx))/length)*100, 6) AS trans_pct, 0.0::DOUBLE AS rot_deg_100m FROM ends e JOIN pr a ON a.seq_id = e.seq_id AND a.frame_id = e.first JOIN pr b ON b.seq_id = e.seq_id AND b.frame_id = e.last JOIN gt g ON g.seq_id = e.seq_id AND g.frame_id = e.first JOIN gt h ON h.seq_id = e.seq_id AND h.frame_id = e.last GROUP BY 1")


@query("agg_drift", DRIFT)
def agg_drift(spark, d):
    pairs = T.join_truth(X.truth(spark, d), X.predicted(spark, d))
    ends = T.segment_ends(T.cumulative_distance(X.truth(spark, d)))
    return T.drift(T.segment_errors(pairs, ends)).select("seq_id", R6(F.col("trans_pct"), "trans_pct"), R6(F.col("rot_deg_100m"), "rot_deg_100m"))


@query("agg_metrics", oracle(f"SELECT metric, round(avg(value), 6) AS value FROM (SELECT event_type AS metric, value FROM events) GROUP BY 1"))
def agg_metrics(spark, d):
    long = X.table(spark, d, "events").select(F.col("event_type").alias("metric"), "value")
    return T.mean_metrics(long).select("metric", R6(F.col("value"), "value"))


@query("agg_running_rms", oracle("SELECT seq_id, frame_id, round(coalesce(sqrt(sum(CASE WHEN e > 0.1 THEN e*e END) OVER w / count(CASE WHEN e > 0.1 THEN 1 END) OVER w), 2.0), 6) AS sigma FROM (SELECT seq_id, frame_id, abs(pr.tx - gt.tx)*2 AS e FROM gt JOIN pr USING (seq_id, frame_id)) WINDOW w AS (PARTITION BY seq_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
def agg_running_rms(spark, d):
    pairs = T.join_truth(X.truth(spark, d), X.predicted(spark, d))
    rows = pairs.select("seq_id", "frame_id", (F.abs(F.col("pr")[3] - F.col("gt")[3]) * 2).alias("error"))
    return T.adaptive_threshold(rows).select("seq_id", "frame_id", R6(F.col("sigma"), "sigma"))


@query("agg_runtime", "SELECT event_id::BIGINT AS frame_id, round(avg(value) OVER (PARTITION BY event_id // 1000 ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS mean_ms FROM events")
def agg_runtime(spark, d):
    w = Window.partitionBy(F.floor(F.col("event_id") / X.EVENTS_A_PATH)).orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = X.table(spark, d, "events")
    return rows.select(F.col("event_id").cast("bigint").alias("frame_id"), R6(F.avg("value").over(w), "mean_ms"))


@query("win_keyframe", oracle("SELECT seq_id, frame_id, frame_id // 5 AS kf_seq FROM gt WHERE frame_id % 5 = 0"))
def win_keyframe(spark, d):
    return T.keyframes(X.truth(spark, d)).select("seq_id", "frame_id", "kf_seq")


@query("fn_calib", oracle("SELECT frame_id, round(ty, 6) AS x, round(-tx, 6) AS y, round(c, 6) AS c FROM poses"))
def fn_calib(spark, d):
    """Poses in a frame that is a quarter turn away."""
    tr = spark.range(1).select(F.array(*[F.lit(float(v)) for v in (0, 1, 0, 0, -1, 0, 0, 0, 0, 0, 1, 0)]).alias("tr"))
    p = T.calibrate(X.frame_poses(spark, d), tr)
    return p.select("frame_id", R6(F.col("m")[3], "x"), R6(F.col("m")[7], "y"), R6(F.col("m")[0], "c"))


@query("fn_score", oracle("SELECT obj, round(exp(-avg(abs(z))), 6) AS s, round(count(CASE WHEN abs(z) < 0.5 THEN 1 END) / count(*), 6) AS ratio FROM fg GROUP BY obj"))
def fn_score(spark, d):
    fg = P.foreground(X.scan(spark, d))
    return fg.groupBy("obj").agg(R6(F.exp(-F.avg(F.abs("z"))), "s"), R6(F.count_if(F.abs("z") < 0.5) / F.count(F.lit(1)), "ratio"))


@query("fn_viz_shift", oracle("SELECT frame_id, node_id, cx AS x, cy AS y, cz + 30 AS z FROM nodes"))
def fn_viz_shift(spark, d):
    return X.nodes(spark, d).select("frame_id", "node_id", F.col("cx").alias("x"), F.col("cy").alias("y"), (F.col("cz") + 30).alias("z"))


@query("fn_to_string", oracle("SELECT frame_id::VARCHAR AS s FROM poses"))
def fn_to_string(spark, d):
    return X.frame_poses(spark, d).select(F.col("frame_id").cast("string").alias("s"))


#: Poses turn about z only, so a fraction of the motion between two is a turn about a fixed centre.
DESKEW = """
, turns AS (SELECT a.frame_id, atan2(a.c*b.s - a.s*b.c, a.c*b.c + a.s*b.s) AS th, a.c*(b.tx-a.tx) + a.s*(b.ty-a.ty) AS ex, a.c*(b.ty-a.ty) - a.s*(b.tx-a.tx) AS ey FROM poses a JOIN poses b ON b.frame_id = a.frame_id + 1),
arcs AS (SELECT *, CASE WHEN abs(th) < 1e-9 THEN 1.0 ELSE sin(th)/th END AS a, CASE WHEN abs(th) < 1e-9 THEN 0.0 ELSE (1-cos(th))/th END AS b FROM turns),
twists AS (SELECT frame_id, th, (a*ex + b*ey)/(a*a+b*b) AS ux, (a*ey - b*ex)/(a*a+b*b) AS uy FROM arcs),
timed AS (SELECT *, t0 / greatest(max(t0) OVER (PARTITION BY frame_id), 1) AS t FROM (SELECT *, (point_idx % 100)::DOUBLE AS t0 FROM scan)),
parts AS (SELECT t.*, (t - 0.5)*th AS w, (t - 0.5) AS f, CASE WHEN abs((t - 0.5)*th) < 1e-9 THEN 1.0 ELSE sin((t - 0.5)*th)/((t - 0.5)*th) END AS a, CASE WHEN abs((t - 0.5)*th) < 1e-9 THEN 0.0 ELSE (1-cos((t - 0.5)*th))/((t - 0.5)*th) END AS b, ux, uy FROM timed t JOIN twists USING (frame_id))
SELECT frame_id, point_idx, label, round(t, 6) AS t, round(cos(w)*x - sin(w)*y + f*(a*ux - b*uy), 5) + 0.0 AS x, round(sin(w)*x + cos(w)*y + f*(b*ux + a*uy), 5) + 0.0 AS y, round(z, 5) + 0.0 AS z FROM parts"""


@query("fn_deskew", oracle(DESKEW))
def fn_deskew(spark, d):
    p = X.frame_poses(spark, d)
    ends = p.select("frame_id", F.col("m").alias("m0")).join(p.select((F.col("frame_id") - 1).alias("frame_id"), F.col("m").alias("m1")), "frame_id")
    rows = P.normalise_time(X.scan(spark, d).withColumn("t", (F.col("point_idx") % 100).cast("double")))
    moved = T.deskew(rows.select("frame_id", "point_idx", "x", "y", "z", "label", "t"), ends)
    return moved.select("frame_id", "point_idx", "label", R6("t", "t"), *[(F.round(c, 5) + 0.0).alias(c) for c in "xyz"])


@query("num_horn", oracle("SELECT frame_id, [c, s, 0.0, round(-(c*tx + s*ty), 5)+0.0, -s+0.0, c, 0.0, round(s*tx - c*ty, 5)+0.0, 0.0, 0.0, 1.0, 0.0]::DOUBLE[] AS align FROM poses WHERE frame_id IN (SELECT frame_id FROM nodes GROUP BY 1 HAVING count(*) >= 4)"))
def num_horn(spark, d):
    """Objects seen from each pose, aligned with where they are: the pose undone."""
    n = X.nodes(spark, d)
    placed = M.place(n, X.frame_poses(spark, d)).join(n.groupBy("frame_id").agg(F.count(F.lit(1)).alias("k")).where("k >= 4"), "frame_id")
    at = lambda x, y, z: F.array(*[F.col(v) if isinstance(v, str) else F.lit(float(v)) for v in (1, 0, 0, x, 0, 1, 0, y, 0, 0, 1, z)])
    pairs = placed.select(F.col("frame_id").cast("string").alias("seq_id"), at("cx", "cy", "cz").alias("gt"), at("x", "y", "z").alias("pr"))
    return T.alignment(pairs).select(F.col("seq_id").cast("bigint").alias("frame_id"), F.transform("align", lambda v: F.round(v, 5) + 0.0).alias("align"))


#: All poses lie on one line, which alignment only shifts along itself: the error left is the spread of the offsets.
EVALUATED = oracle(ENDS + " , drift AS (SELECT e.seq_id, avg(abs((b.tx-a.tx)-(h.tx-g.tx))/length)*100 AS trans_pct FROM ends e JOIN pr a ON a.seq_id = e.seq_id AND a.frame_id = e.first JOIN pr b ON b.seq_id = e.seq_id AND b.frame_id = e.last JOIN gt g ON g.seq_id = e.seq_id AND g.frame_id = e.first JOIN gt h ON h.seq_id = e.seq_id AND h.frame_id = e.last GROUP BY 1), ate AS (SELECT seq_id, stddev_pop(pr.tx - gt.tx) AS ate_rmse FROM gt JOIN pr USING (seq_id, frame_id) GROUP BY 1) SELECT seq_id, round(trans_pct, 6) AS trans_pct, 0.0::DOUBLE AS rot_deg_100m, round(ate_rmse, 6) AS ate_rmse, 0.0::DOUBLE AS rot_rmse_deg FROM drift JOIN ate USING (seq_id)")


@query("evaluate_trajectory", EVALUATED)
def evaluate_trajectory(spark, d):
    found = T.evaluate(X.truth(spark, d), X.predicted(spark, d))
    return found.select("seq_id", *[R6(c, c) for c in ("trans_pct", "rot_deg_100m", "ate_rmse", "rot_rmse_deg")])


TWISTS = "SELECT event_id::BIGINT AS k, (event_id % 50) * 0.1::DOUBLE AS v, (1 + event_id % 7) * 0.1::DOUBLE AS w FROM events"


def _twists(spark, d):
    k = X.table(spark, d, "events").select(F.col("event_id").cast("bigint").alias("k"))
    zero = F.lit(0.0)
    return k.select("k", F.array(F.col("k") % 50 * 0.1, zero, zero, zero, zero, (1 + F.col("k") % 7) * 0.1).alias("x"))


@query("fn_se3_exp", f"SELECT k, round(v*sin(w)/w, 6) AS x, round(v*(1-cos(w))/w, 6) AS y, round(cos(w), 6) AS c FROM ({TWISTS})")
def fn_se3_exp(spark, d):
    m = T.exponential(_twists(spark, d))
    return m.select("k", R6(F.col("m")[3], "x"), R6(F.col("m")[7], "y"), R6(F.col("m")[0], "c"))


@query("fn_se3_log", f"SELECT k, round(v, 6) AS v, round(w, 6) AS w FROM ({TWISTS})")
def fn_se3_log(spark, d):
    x = T.logarithm(T.exponential(_twists(spark, d)))
    return x.select("k", R6(F.col("x")[0], "v"), R6(F.col("x")[5], "w"))
