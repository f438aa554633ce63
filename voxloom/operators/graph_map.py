"""Maps of object instances: placing, updating, global edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.operators.clustering import filter_new_instance
from voxloom.operators.nearest import without_near

EDGE = 60.0
RADIUS = 2.0


def place(nodes: DataFrame, poses: DataFrame, last: int | None = None) -> DataFrame:
    """Nodes with x, y, z in the world frame, up to the ``last`` optimised frame."""
    some = nodes if last is None else nodes.where(F.col("frame_id") <= last)
    both = some.join(poses.select("frame_id", "m"), "frame_id")
    return both.withColumns(dict(zip("xyz", G.apply_pose(F.col("m"), G.xyz("c"))))).drop("m")


def node_offsets(nodes: DataFrame) -> DataFrame:
    """(frame_id, n, base): the global number of each frame's first node.  One row a frame is ordered, by seq_id where there is one."""
    seq = ["seq_id"] if "seq_id" in nodes.columns else []
    counts = nodes.groupBy(*seq, "frame_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*seq).orderBy("frame_id").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0)))


def _ends(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.select(F.col("frame_id").alias("f" + name), F.col("node_id").alias("n" + name), *[F.col(c).alias(name + c) for c in "xyz"])


def edges_to_earlier(nodes: DataFrame, back: int = 29, limit: float = EDGE) -> DataFrame:
    """(fa, na, fb, nb): nodes closer than ``limit`` to nodes of the ``back`` frames before.

    The sliding window becomes an equality: each frame is listed once for each
    frame that looks back on it.
    """
    a = _ends(nodes, "a")
    b = _ends(nodes, "b").withColumn("fa", F.explode(F.sequence(F.col("fb") + 1, F.col("fb") + back)))
    return a.join(b, "fa").where(G.distance(G.xyz("a"), G.xyz("b")) < limit).select("fa", "na", "fb", "nb")


def edges_within(nodes: DataFrame, limit: float = EDGE) -> DataFrame:
    a, b = _ends(nodes, "a"), _ends(nodes, "b").withColumn("fa", F.col("fb"))
    return a.join(b, "fa").where((F.col("na") < F.col("nb")) & (G.distance(G.xyz("a"), G.xyz("b")) < limit)).select("fa", "na", "fb", "nb")


def unseen(nodes: DataFrame, matched: DataFrame) -> DataFrame:
    """Nodes that no loop matched."""
    return nodes.join(matched, ["frame_id", "node_id"], "left_anti")


def band_hits(left: DataFrame, right: DataFrame, within: float) -> DataFrame:
    """(frame_id, node_id, hits): pairs of triangles equal within ``within`` on all sides, by bins of the longest side."""
    keys = ["frame_id", "node_id"]
    a = left.withColumn("bin", F.floor(F.col("c") / within))
    b = right.select(*keys, *[F.col(c).alias("o" + c) for c in "abc"]).withColumn("bin", F.explode(F.sequence(F.floor(F.col("oc") / within) - 1, F.floor(F.col("oc") / within) + 1)))
    met = a.join(b, [*keys, "bin"])
    for c in "abc":
        met = met.where(F.abs(F.col(c) - F.col("o" + c)) < within)
    return met.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"))


def update(instances: DataFrame, nodes: DataFrame, matches: DataFrame, origin: tuple[float, float, float], most: float, radius: float = RADIUS, keys: tuple[str, ...] = ()) -> DataFrame:
    """The map after a frame whose nodes are in the world frame, or one map for each of ``keys``.

    A matched instance within ``radius`` moves half way to its node, position
    and size; other nodes enter if good enough and no instance that was there
    before stands near; instances farther than ``most`` from the origin go.
    """
    cols = [*keys, "instance_id", "label", "px", "py", "pz", "dx", "dy", "dz", "points_num"]
    n = nodes.select(*keys, "node_id", F.col("label").alias("nl"), "cx", "cy", "cz", *[F.col("d" + c).alias("n" + c) for c in "xyz"], F.col("points_num").alias("np"))
    met = matches.join(n, [*keys, "node_id"]).join(instances.select(*keys, F.col("instance_id").alias("map_id"), "px", "py", "pz"), [*keys, "map_id"])
    met = met.where(G.distance(G.xyz("c"), G.xyz("p")) < radius)
    moved = F.min(F.struct("node_id", "cx", "cy", "cz", "nx", "ny", "nz")).alias("_h")  # the first node, where several match
    hit = met.groupBy(*keys, F.col("map_id").alias("instance_id")).agg(moved).select(*keys, "instance_id", "_h.*").drop("node_id")
    old = instances.join(hit, [*keys, "instance_id"], "left")
    half = {"p" + c: F.when(F.col("c" + c).isNotNull(), (F.col("p" + c) + F.col("c" + c)) / 2).otherwise(F.col("p" + c)) for c in "xyz"}
    half |= {"d" + c: F.when(F.col("n" + c).isNotNull(), (F.col("d" + c) + F.col("n" + c)) / 2).otherwise(F.col("d" + c)) for c in "xyz"}
    old = old.withColumns(half).select(*[F.col(c).cast("bigint") if c == "instance_id" else F.col(c) for c in cols]).withColumn("old", F.lit(True))

    fresh = filter_new_instance(nodes.join(met.select(*keys, "node_id").distinct(), [*keys, "node_id"], "left_anti"))
    candidates = fresh.select(*keys, F.col("node_id").alias("point_idx"), "label", *[F.col("c" + c).alias(c) for c in "xyz"], "dx", "dy", "dz", "points_num")
    there = instances.select(*keys, "label", *[F.col("p" + c).alias(c) for c in "xyz"])
    free = without_near(candidates, there, radius, keys=keys)
    top = instances.groupBy(*keys).agg(F.max("instance_id").alias("top"))
    last = F.coalesce("top", F.lit(-1))  # a map may be empty
    place_in = F.row_number().over(Window.partitionBy(*keys).orderBy("point_idx"))
    counted = free.join(top, list(keys), "left") if keys else free.join(F.broadcast(top), F.lit(True), "left")
    new = counted.select(*keys, (last + place_in).cast("bigint").alias("instance_id"), "label", *[F.col(c).alias("p" + c) for c in "xyz"], "dx", "dy", "dz", "points_num")
    new = new.withColumn("old", F.lit(False))
    at = tuple(F.lit(float(v)) for v in origin)
    return old.unionByName(new).where(G.square_distance(G.xyz("p"), at) <= most * most)
