"""Deterministic projections of the driver's tables to points, nodes, descriptors and poses.

Each has a Spark form and the same as a DuckDB common table expression, by
plain arithmetic, so both engines compute equal doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.functions.labels import node_class
from voxloom.operators.points import filter_static, relabel

#: Frames, sequences and paths grow with the tables; what one of them holds does not.
ORDERS_A_FRAME = 250
OBJECTS = 25
FRAMES_A_SEQUENCE = 20
EVENTS_A_PATH = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("frame_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = rows.withColumn("frame_id", F.floor(F.col("l_orderkey") / ORDERS_A_FRAME).cast("bigint")).withColumn("obj", (F.col("l_suppkey") % OBJECTS).cast("bigint"))
    raw = F.element_at(F.array(*map(F.lit, (10, 71, 80, 40, 50))), (F.col("obj") % 5 + 1).cast("int"))
    return rows.select(
        "frame_id",
        F.row_number().over(order).cast("bigint").alias("point_idx"),
        (((F.col("obj") * 37) % 61) - 30 + F.col("l_discount") * 20).cast("double").alias("x"),
        (((F.col("obj") * 53) % 61) - 30 + F.col("l_tax") * 25).cast("double").alias("y"),
        (F.col("l_quantity") / 25.0 - 1).cast("double").alias("z"),
        raw.alias("raw_label"),
        "obj",
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points with train labels."""
    return relabel(raw_points(spark, sf_dir)).drop("raw_label")


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points within range and of no moving class."""
    return filter_static(points(spark, sf_dir))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by their known identity: boxes of ten foreground points or more."""
    fg = scan(spark, sf_dir).where(F.col("label").isin(1, 4, 5, 16, 18))
    ends = [f(c).alias(n + c) for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    agg = fg.groupBy("frame_id", "label", "obj").agg(*ends, F.count(F.lit(1)).alias("n"), F.min("point_idx").alias("first")).where("n >= 10")
    w = Window.partitionBy("frame_id").orderBy("label", "first")
    return agg.select(
        "frame_id",
        (F.row_number().over(w) - 1).cast("int").alias("node_id"),
        node_class(F.col("label")).alias("label"),
        *[((F.col("lo" + c) + F.col("hi" + c)) / 2).alias("c" + c) for c in "xyz"],
        *[(F.col("hi" + c) - F.col("lo" + c)).alias("d" + c) for c in "xyz"],
        F.col("n").cast("int").alias("points_num"),
    )


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").cast("bigint").alias("kf_seq"), F.col("embedding").alias("desc"), F.col("label").cast("int").alias("label"))


def _path(spark: SparkSession, sf_dir: str, x) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    frame = (F.col("event_id") % EVENTS_A_PATH).cast("bigint")
    pose = F.array(*[v.cast("double") for v in (F.lit(1), F.lit(0), F.lit(0), frame + x, F.lit(0), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit(0), F.lit(1), F.lit(0))])
    path = F.concat(F.lit("s"), F.floor(F.col("event_id") / EVENTS_A_PATH).cast("string"))
    return rows.select(path.alias("seq_id"), frame.alias("frame_id"), pose.alias("m"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _path(spark, sf_dir, F.lit(0))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _path(spark, sf_dir, F.col("value") / 1000)


def frame_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pose for each frame of the scans: a quarter turn every second frame, and a shift."""
    f = F.col("frame_id")
    odd = (f % 2).cast("double")
    even = 1 - odd
    zero, one = F.lit(0.0), F.lit(1.0)
    m = F.array(even, -odd, zero, f * 0.5, odd, even, zero, f * 0.25, zero, zero, one, zero)
    frames = raw_points(spark, sf_dir).select("frame_id").distinct()
    return frames.select(F.lit("s").alias("seq_id"), f.alias("frame_id"), m.alias("m"))


def sequence(frame_id: str = "frame_id") -> Column:
    """The sequence of a frame of the scans."""
    return F.concat(F.lit("s"), F.floor(F.col(frame_id) / FRAMES_A_SEQUENCE).cast("string"))


#: The same in DuckDB: put WITH in front and a query after.
SQL = """
pts AS (
  SELECT (l_orderkey // 250)::BIGINT AS frame_id,
    row_number() OVER (PARTITION BY l_orderkey // 250 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::BIGINT AS point_idx,
    (((l_suppkey % 25 * 37) % 61) - 30 + l_discount * 20)::DOUBLE AS x,
    (((l_suppkey % 25 * 53) % 61) - 30 + l_tax * 25)::DOUBLE AS y,
    (l_quantity / 25.0 - 1)::DOUBLE AS z,
    CASE l_suppkey % 25 % 5 WHEN 0 THEN 10 WHEN 1 THEN 71 WHEN 2 THEN 80 WHEN 3 THEN 40 ELSE 50 END AS raw_label,
    CASE l_suppkey % 25 % 5 WHEN 0 THEN 1 WHEN 1 THEN 16 WHEN 2 THEN 18 WHEN 3 THEN 9 ELSE 13 END AS label,
    (l_suppkey % 25)::BIGINT AS obj
  FROM lineitem),
scan AS (SELECT * FROM pts WHERE label < 20 AND sqrt(x*x+y*y+z*z) > 5 AND sqrt(x*x+y*y+z*z) < 100),
fg AS (SELECT * FROM scan WHERE label IN (1,4,5,16,18)),
bg AS (SELECT * FROM scan WHERE label IN (9,13,14,15)),
nodes AS (
  SELECT frame_id, (row_number() OVER (PARTITION BY frame_id ORDER BY label, first) - 1)::INT AS node_id,
    CASE WHEN label IN (1,4,5) THEN 1 WHEN label = 16 THEN 2 ELSE 3 END AS label,
    (lox+hix)/2 AS cx, (loy+hiy)/2 AS cy, (loz+hiz)/2 AS cz, hix-lox AS dx, hiy-loy AS dy, hiz-loz AS dz, n::INT AS points_num
  FROM (SELECT frame_id, label, obj, min(x) lox, max(x) hix, min(y) loy, max(y) hiy, min(z) loz, max(z) hiz, count(*) n, min(point_idx) AS first
        FROM fg GROUP BY ALL HAVING count(*) >= 10)),
kf AS (SELECT vec_id::BIGINT AS kf_seq, embedding::DOUBLE[] AS d, label::INT AS label FROM embeddings),
gt AS (SELECT 's' || (event_id // 1000) AS seq_id, (event_id % 1000)::BIGINT AS frame_id, (event_id % 1000)::DOUBLE AS tx FROM events),
pr AS (SELECT 's' || (event_id // 1000) AS seq_id, (event_id % 1000)::BIGINT AS frame_id, event_id % 1000 + value/1000 AS tx FROM events),
poses AS (SELECT frame_id, (1 - frame_id % 2)::DOUBLE AS c, (frame_id % 2)::DOUBLE AS s, frame_id * 0.5::DOUBLE AS tx, frame_id * 0.25::DOUBLE AS ty FROM (SELECT DISTINCT frame_id FROM pts)),
pairs AS (
  SELECT a.frame_id, a.node_id AS i, b.node_id AS j, a.label AS li, b.label AS lj, b.cx AS jx, b.cy AS jy, b.cz AS jz,
    sqrt((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)+(a.cz-b.cz)*(a.cz-b.cz)) AS dist
  FROM nodes a JOIN nodes b USING (frame_id)),
near AS (SELECT * FROM pairs WHERE dist < 60),
edges AS (SELECT *, (60 - dist)/60 AS weight FROM near WHERE i < j)
"""


def oracle(query: str) -> str:
    return f"WITH {SQL.strip()}\n{query.strip()}"
