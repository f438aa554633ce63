"""Queries on sources and sinks: files are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import points as P
from voxloom.operators import scene_graph as S
from voxloom.operators import trajectory as T
from voxloom.plans import fixtures as X
from voxloom.plans.catalog import query
from voxloom.plans.fixtures import oracle
from voxloom.plans.scratch import fresh
from voxloom.sources import files as S_

R3 = lambda c, name=None: F.round(c, 3).alias(name or c)


def _written(spark, d):
    folder = fresh(spark, "scans")
    S_.write_scans(X.raw_points(spark, d), folder).write.mode("overwrite").format("noop").save()
    return folder


CLOUD = "SELECT frame_id, point_idx - 1 AS point_idx, round(x::FLOAT::DOUBLE, 3) AS x, round(y::FLOAT::DOUBLE, 3) AS y, round(z::FLOAT::DOUBLE, 3) AS z"


@query("src_cloud_bin", oracle(CLOUD + " FROM pts"))
def src_cloud_bin(spark, d):
    return S_.read_clouds(spark, _written(spark, d)).select("frame_id", "point_idx", R3("x"), R3("y"), R3("z"))


@query("snk_points_bin", oracle("SELECT frame_id, count(*) AS points FROM pts GROUP BY 1"))
def snk_points_bin(spark, d):
    return S_.write_scans(X.raw_points(spark, d), fresh(spark, "scans"))


@query("src_label_bin", oracle("SELECT frame_id, point_idx - 1 AS point_idx, raw_label FROM pts"))
def src_label_bin(spark, d):
    return S_.read_labels(spark, _written(spark, d))


@query("src_zip_label", oracle(CLOUD + ", raw_label FROM pts"))
def src_zip_label(spark, d):
    return S_.read_scans(spark, _written(spark, d)).select("frame_id", "point_idx", R3("x"), R3("y"), R3("z"), "raw_label")


@query("src_sequence", oracle("SELECT DISTINCT frame_id FROM pts"))
def src_sequence(spark, d):
    return S_.list_scans(spark, _written(spark, d)).select("frame_id")


def _pose_file(spark, poses):
    path = fresh(spark, "poses")
    S_.write_poses(poses, path)
    return path


POSES = oracle("SELECT seq_id, frame_id, round(tx, 9) AS x FROM pr")


@query("src_poses_py", POSES)
def src_poses_py(spark, d):
    return S_.read_poses(spark, _pose_file(spark, X.predicted(spark, d))).select("seq_id", "frame_id", F.round(F.col("m")[3], 9).alias("x"))


@query("src_poses_cpp", oracle("SELECT seq_id, frame_id, round(tx, 9) AS px, 1.0::DOUBLE AS w FROM pr"))
def src_poses_cpp(spark, d):
    p = S_.read_poses(spark, _pose_file(spark, X.predicted(spark, d))).withColumn("q", S_.quaternion(F.col("m")))
    return p.select("seq_id", "frame_id", F.round("q.px", 9).alias("px"), "q.w")


@query("snk_odom", oracle("SELECT seq_id, frame_id, concat_ws(' ', '1.0000000000000000', '0.0000000000000000', '0.0000000000000000') AS head FROM pr"))
def snk_odom(spark, d):
    """The lines of the written files."""
    p = S_.pose_lines(spark, _pose_file(spark, X.predicted(spark, d)))
    return p.select("seq_id", F.col("n").cast("bigint").alias("frame_id"), F.substring_index("line", " ", 3).alias("head"))


@query("snk_poses_py", POSES)
def snk_poses_py(spark, d):
    return src_poses_py(spark, d)


@query("snk_pgo", POSES)
def snk_pgo(spark, d):
    """The whole trajectory is written anew each time."""
    path = _pose_file(spark, X.truth(spark, d))
    S_.write_poses(X.predicted(spark, d), path)
    return S_.read_poses(spark, path).select("seq_id", "frame_id", F.round(F.col("m")[3], 9).alias("x"))


@query("src_calib", "SELECT * FROM (VALUES ('P0', 1.0::DOUBLE), ('Tr', 2.0::DOUBLE)) t(key, first)")
def src_calib(spark, d):
    path = fresh(spark, "calib")
    rows = [("P0: " + " ".join(["1"] * 12),), ("Tr: " + " ".join(["2"] * 12),)]
    spark.createDataFrame(rows, "value string").coalesce(1).write.text(path)
    return S_.read_calib(spark, path).select("key", F.col("m")[0].alias("first"))


@query("src_msg_cloud", oracle("SELECT frame_id, point_idx - 1 AS point_idx, round(x::FLOAT::DOUBLE, 3) AS x, label FROM scan_n").replace("nodes AS (", "scan_n AS (SELECT * REPLACE (row_number() OVER (PARTITION BY frame_id ORDER BY point_idx) AS point_idx) FROM scan),\nnodes AS (", 1))
def src_msg_cloud(spark, d):
    return S_.decode_clouds(S_.encode_clouds(X.scan(spark, d))).select("frame_id", "point_idx", R3("x"), "label")


@query("snk_msg_encode", oracle("SELECT frame_id, (count(*) * 14)::INT AS bytes, 14 AS step FROM scan GROUP BY 1"))
def snk_msg_encode(spark, d):
    return S_.encode_clouds(X.scan(spark, d)).select("frame_id", F.length("data").alias("bytes"), "step")


@query("snk_markers", oracle("SELECT e.frame_id, e.i, e.j, a.cx AS x1, b.cx AS x2 FROM edges e JOIN nodes a ON a.frame_id = e.frame_id AND a.node_id = e.i JOIN nodes b ON b.frame_id = e.frame_id AND b.node_id = e.j"))
def snk_markers(spark, d):
    n = X.nodes(spark, d)
    return S_.markers(S.edges(n), n).select("frame_id", "i", "j", "x1", "x2")


@query("snk_graph_map", oracle("SELECT label, count(*) AS n FROM nodes GROUP BY 1"))
def snk_graph_map(spark, d):
    path = fresh(spark, "map")
    S_.write_rows(X.nodes(spark, d), path, ("cx", "cy", "cz", "label"))
    back = spark.read.text(path).select(F.split("value", " ")[3].cast("int").alias("label"))
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("snk_graph_edge", oracle("SELECT i, j, count(*) AS n FROM edges GROUP BY 1, 2"))
def snk_graph_edge(spark, d):
    path = fresh(spark, "edges")
    S_.write_rows(S.edges(X.nodes(spark, d)), path, ("i", "j"))
    p = F.split("value", " ")
    back = spark.read.text(path).select(p[0].cast("int").alias("i"), p[1].cast("int").alias("j"))
    return back.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


WORLD = "SELECT frame_id, point_idx, label, round(c*x - s*y + tx, 6) AS x, round(s*x + c*y + ty, 6) AS y FROM scan JOIN poses USING (frame_id) WHERE label IN (1,4,5,16,18,9,13,14,15)"


def _world(spark, d):
    s = X.scan(spark, d)
    return P.transform(P.foreground(s).unionByName(P.background(s)), X.frame_poses(spark, d))


@query("snk_global_cloud", oracle(WORLD))
def snk_global_cloud(spark, d):
    return _world(spark, d).select("frame_id", "point_idx", "label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("snk_loop_cloud", oracle(WORLD + " AND frame_id % 5 = 0"))
def snk_loop_cloud(spark, d):
    return snk_global_cloud(spark, d).where("frame_id % 5 = 0")


@query("snk_tf", oracle("SELECT frame_id, tx AS x, ty AS y, s = 1 AS turned FROM poses"))
def snk_tf(spark, d):
    """Transforms as they are sent: appended to a table, position and quaternion."""
    path = fresh(spark, "tf")
    q = S_.quaternion(F.col("m"))
    X.frame_poses(spark, d).select("frame_id", q.alias("q")).select("frame_id", "q.*").write.mode("append").parquet(path)
    return spark.read.parquet(path).select("frame_id", F.col("px").alias("x"), F.col("py").alias("y"), (F.col("w") < 0.9).alias("turned"))


@query("snk_topics", oracle("SELECT 'nodes' AS topic, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'scan', count(*) FROM scan"))
def snk_topics(spark, d):
    n = X.nodes(spark, d)
    parts = [df.agg(F.lit(t).alias("topic"), F.count(F.lit(1)).alias("n")) for t, df in (("nodes", n), ("edges", S.edges(n)), ("scan", X.scan(spark, d)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("nn_persist", oracle("SELECT kf_seq, label FROM kf"))
def nn_persist(spark, d):
    path = fresh(spark, "index")
    X.keyframes(spark, d).write.parquet(path)
    return spark.read.parquet(path).select("kf_seq", "label")


@query("pose_factors_back", oracle("SELECT seq_id, frame_id - 1 AS src, frame_id AS dst FROM pr WHERE frame_id > 0"))
def pose_factors_back(spark, d):
    return T.relative_motion(S_.read_poses(spark, _pose_file(spark, X.predicted(spark, d)))).select("seq_id", "src", "dst")


