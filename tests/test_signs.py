"""Rounding keeps what SQL keeps."""

import duckdb

from voxloom.plans import catalog


def test_components_that_round_to_zero_keep_their_sign(spark, sf, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT 1 AS vec_id, [3.0, -0.00001, 0.00001, -0.0, 0.0, -4.0]::FLOAT[] AS embedding, 0 AS label) TO '{tmp_path}/embeddings.parquet'")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    # the oracle's common tables name the others, too
    con.execute("CREATE VIEW events AS SELECT 0 AS event_id, 0.0 AS value")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet'")
    found, sql = catalog.load()
    want = con.execute(sql["fn_l2_normalise"]).fetchall()
    assert repr([tuple(r) for r in found["fn_l2_normalise"](spark, str(tmp_path)).collect()]) == repr(want)
    assert "-0.0" in repr(want)
