"""Queries on frames and poses without a cut by id."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxloom.plans import catalog
from voxloom.plans import fixtures as X

QUERIES, ORACLE = catalog.load()


@pytest.mark.parametrize("name", ["icp_frame", "ctl_front", "stream_odometry"])
def test_odometry_takes_every_frame(spark, sf, name):
    want = {r.frame_id for r in X.scan(spark, sf).select("frame_id").distinct().collect()}
    assert {r.frame_id for r in QUERIES[name](spark, sf).select("frame_id").collect()} == want


def test_pose_graph_takes_every_pose(spark, sf):
    assert QUERIES["pgo"](spark, sf).count() == X.predicted(spark, sf).count()


def test_poses_of_frames_with_few_objects_equal_the_sql(spark, sf, tmp_path):
    """Five objects a frame, most of them near the line on which six of the fixture's stand."""
    rng = np.random.default_rng(11)
    line, rest, rows = [0, 6, 7, 15, 21, 22], [1, 2, 5, 10, 11, 12, 16, 17, 20], []
    for frame in range(40):
        for obj in [*rng.choice(line, 4, replace=False), rng.choice(rest)]:
            for k in range(40):
                rows.append((frame * 250 + int(rng.integers(250)), len(rows), int(obj), k % 7 + 1, float(rng.integers(1, 51)), 1.0, rng.integers(0, 11) / 100, rng.integers(0, 9) / 100))
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    pd.DataFrame(rows, columns=names).to_parquet(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "embeddings", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path if name == 'lineitem' else sf}/{name}.parquet'")
    want = {r[0]: (r[1], r[2]) for r in con.execute(f"SELECT pair, found, m FROM ({ORACLE['gm_reloc']})").fetchall()}
    got = {r.pair: (r.found, r.m) for r in QUERIES["gm_reloc"](spark, str(tmp_path)).collect()}
    assert len(want) == 40
    assert got == want


def test_frames_of_any_number_of_objects_are_relocalised_or_said_not_to_be(spark, sf, tmp_path):
    """Frames of 0 to 6 objects; more than three are looked for, also where the right matches are on a line (0, 6, 7, 15, 21, 22)."""
    frames = [[], [0], [0, 15], [0, 5, 6], [0, 15, 6, 1], [0, 15, 6, 22], [0, 5, 6, 1], [0, 15, 6, 1, 7], [0, 5, 1, 6, 2, 7], [3, 4]]
    rows = []
    for frame, objects in enumerate(frames):
        for obj in [*objects, 3]:
            for k in range(12):
                end = k % 2
                rows.append((frame * 250, len(rows), obj, len(rows), 1.0 + 49 * end, 1.0, end / 10, 2 * end / 25))
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    pd.DataFrame(rows, columns=names).to_parquet(tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    for name in ("lineitem", "embeddings", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path if name == 'lineitem' else sf}/{name}.parquet'")
    want = {r[0]: (r[1], r[2]) for r in con.execute(f"SELECT pair, found, m FROM ({ORACLE['gm_reloc']})").fetchall()}
    got = {r.pair: (r.found, r.m) for r in QUERIES["gm_reloc"](spark, str(tmp_path)).collect()}
    assert got == want
    assert [got[f][0] for f in range(len(frames))] == [len([o for o in objects if o % 5 < 3]) > 3 for objects in frames]
