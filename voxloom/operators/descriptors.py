"""Scan descriptors: graph histograms, ring occupancy, ring x sector label cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import geometry as G
from voxloom.functions.labels import priority
from voxloom.operators.scene_graph import BINS, EDGE, class_counts, dense, edges

NEAR, FAR, RINGS, SECTORS = 5.0, 50.0, 24, 360
ROAD, BUILDING = 9, 13
#: Place of an unordered class pair among the histograms.
PAIR_PLACE = {(1, 1): 0, (2, 2): 1, (3, 3): 2, (2, 3): 3, (1, 2): 4, (1, 3): 5}


def edge_histogram(edge_rows: DataFrame, limit: float = EDGE, bins: int = BINS) -> DataFrame:
    """Non-zero entries (slot, n) of a frame's class pair x distance histogram; slots 0 to 2 are free."""
    lo, hi = F.least("li", "lj"), F.greatest("li", "lj")
    place = F.lit(None).cast("int")
    for (a, b), k in PAIR_PLACE.items():
        place = F.when((lo == a) & (hi == b), k).otherwise(place)
    slot = (place * bins + F.floor(F.col("dist") / F.lit(limit / bins)) + 3).cast("int")
    return edge_rows.groupBy("frame_id", slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def graph_descriptors(nodes: DataFrame, limit: float = EDGE, bins: int = BINS) -> DataFrame:
    """(frame_id, v): three class shares and six pair histograms, normalised apart and then together."""
    length = 6 * bins + 3
    hist = dense(edge_histogram(edges(nodes, limit), limit, bins), ("frame_id",), length)
    zero = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.lit(0.0))
    rows = class_counts(nodes).join(hist, "frame_id", "left").withColumn("v", G.l2_normalise(F.coalesce("v", zero)))
    counts = G.l2_normalise(F.array(*[F.col(c).cast("double") for c in ("vehicle_num", "trunk_num", "pole_num")]))
    return rows.select("frame_id", G.l2_normalise(F.concat(counts, F.slice("v", 4, length - 3))).alias("v"))


def ring_cells(points: DataFrame) -> DataFrame:
    """Points with a priority that fall on the grid, with their ring and sector."""
    rho = G.planar_range(G.xyz())
    placed = points.where(priority(F.col("label")) > 0).withColumn("rho", rho).where(f"rho >= {NEAR} and rho < {FAR}")
    placed = placed.withColumns(
        {
            "ring": ((F.col("rho") - NEAR) / F.lit((FAR - NEAR) / RINGS)).cast("int"),
            "sector": (G.fast_angle(F.col("y"), F.col("x")) / F.lit(360.0 / SECTORS)).cast("int"),
        }
    )
    return placed.where(f"ring >= 0 and ring < {RINGS} and sector >= 0 and sector < {SECTORS}")


def ring_occupancy(points: DataFrame) -> DataFrame:
    """Sectors of each ring with building and with road: (frame_id, slot, n), slot 0..23 building, 24..47 road."""
    some = ring_cells(points.where(F.col("label").isin(ROAD, BUILDING)))
    slot = F.col("ring") + F.when(F.col("label") == ROAD, RINGS).otherwise(0)
    return some.groupBy("frame_id", slot.alias("slot")).agg(F.countDistinct("sector").alias("n"))


def ring_descriptors(points: DataFrame) -> DataFrame:
    """(frame_id, v) of 48; zero for a frame with neither class."""
    found = dense(ring_occupancy(points), ("frame_id",), 2 * RINGS)
    return found.withColumn("v", G.l2_normalise(F.col("v")))


def label_cells(points: DataFrame) -> DataFrame:
    """(frame_id, ring, sector, label): the label of highest priority of each cell; fence and vegetation left out."""
    some = ring_cells(points.where(~F.col("label").isin(14, 15)))
    return some.groupBy("frame_id", "ring", "sector").agg(F.max_by("label", priority(F.col("label"))).alias("label"))


def cell_similarity(cells: DataFrame, pair_rows: DataFrame) -> DataFrame:
    """(a, b, similarity) for frame pairs (a, b): equal cells among those that either has; null if none."""
    on = ["a", "b", "ring", "sector"]
    left = pair_rows.join(cells.withColumnRenamed("frame_id", "a"), "a").select(*on, F.col("label").alias("l"))
    right = pair_rows.join(cells.withColumnRenamed("frame_id", "b"), "b").select(*on, F.col("label").alias("r"))
    both = left.join(right, on, "full_outer").groupBy("a", "b")
    share = both.agg(F.avg(F.coalesce((F.col("l") == F.col("r")).cast("double"), F.lit(0.0))).alias("similarity"))
    return pair_rows.join(share, ["a", "b"], "left").select("a", "b", "similarity")


def scan_descriptors(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """(frame_id, desc) of 231: graph and ring parts, normalised together."""
    zero = F.transform(F.sequence(F.lit(1), F.lit(2 * RINGS)), lambda i: F.lit(0.0))
    rings = ring_descriptors(points).withColumnRenamed("v", "r")
    both = graph_descriptors(nodes).join(rings, "frame_id", "left")
    return both.select("frame_id", G.l2_normalise(F.concat("v", F.coalesce("r", zero))).cast("array<float>").alias("desc"))
