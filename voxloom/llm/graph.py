"""Connected components over edge tables, without collecting either."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.storage import materialize, release, tally


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    near = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return near.where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("v"))
    rest = e.join(least.withColumnRenamed("v", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.unionByName(rest.where("u <> v")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges`` that is not its component's least node.

    Alternating large and small stars: each pass links every node to the least
    one it knows, so a component of n nodes becomes a star after O(log^2 n)
    passes.  Each pass is written to the shared folder.  Null ends and loops
    are ignored; an empty table gives an empty result.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = materialize(e.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    before = tally(e)
    while before[0]:
        old, e = e, materialize(_small_star(_large_star(e)), "stars")
        release(old)
        now = tally(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
