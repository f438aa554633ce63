"""Loop search verifies candidates in the order of their rank and refines the loops taken only."""

from pyspark.sql import functions as F

from voxloom.plans import mapping as B


def test_later_candidates_are_verified_only_where_the_first_fails(spark, monkeypatch):
    near = spark.createDataFrame([(10, 1, 1), (10, 2, 2), (11, 3, 1), (11, 4, 2), (11, 5, 3), (12, 6, 1)], "q long, c long, rank int")
    frames = spark.range(3).select(F.col("id").alias("frame_id"), F.col("id").alias("kf_seq"), F.array(F.lit(0.0)).alias("desc"))
    asked, taken = [], []

    def verify(nodes, points, candidates, refine=True, cells=None):
        asked.append(sorted((r.q, r.c) for r in candidates.collect()))
        score = F.when(F.col("c").isin(1, 2, 5), 1.0).otherwise(0.0)
        return candidates.select("q", "c", score.alias("graph_score"), score.alias("back_score"), F.lit(0.0).alias("shift"), F.array(F.lit(7)).alias("matched"), F.array(F.col("c") * 0.5).alias("m"))

    def refined(points, verified):
        taken.extend((r.q, r.c) for r in verified.collect())
        return verified

    for name, fake in (("verify_loops", verify), ("refined", refined), ("keyframes", lambda desc, every: desc)):
        monkeypatch.setattr(B, name, fake)
    monkeypatch.setattr(B.D, "scan_descriptors", lambda nodes, points: frames)
    monkeypatch.setattr(B.D, "label_cells", lambda points: frames)
    monkeypatch.setattr(B.K, "loop_candidates", lambda *_: near)
    found = B.search_loops(frames, frames, every=1)
    assert sorted((r.query_frame, r.match_frame) for r in found.collect()) == [(10, 1), (11, 5)]
    assert asked == [[(10, 1), (11, 3), (12, 6)], [(11, 4), (11, 5)]]
    assert sorted(taken) == [(10, 1), (11, 5)]
