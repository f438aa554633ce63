"""Pose sequences: motion model, odometry factors, distances, accuracy metrics.

poses are (seq_id, frame_id, m) with m = array<double>(12), row-major 3 x 4.
Windows are per sequence, which is the unit of order here.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.functions import geometry as G
from voxloom.operators.solvers import inverse, rigid_alignment, to_matrix, to_row

LENGTHS = (100, 200, 300, 400, 500, 600, 700, 800)
STEP = 10


def _order() -> Window:
    return Window.partitionBy("seq_id").orderBy("frame_id")


def motion_model(poses: DataFrame) -> DataFrame:
    """prediction: the last motion, identity before the third pose; guess: the last pose moved by it."""
    last, before = F.lag("m", 1).over(_order()), F.lag("m", 2).over(_order())
    rows = poses.withColumn("_a", before).withColumn("_b", last)
    unit = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)])
    rows = rows.withColumn("prediction", F.when(F.col("_a").isNull(), unit).otherwise(G.relative_pose(F.col("_a"), F.col("_b"))))
    guess = F.when(F.col("_b").isNull(), unit).otherwise(G.compose_pose(F.col("_b"), F.col("prediction")))
    return rows.withColumn("guess", guess).drop("_a", "_b")


def relative_motion(poses: DataFrame) -> DataFrame:
    """Odometry factors (seq_id, src, dst, rel)."""
    rows = poses.withColumn("_p", F.lag("m").over(_order())).withColumn("src", F.lag("frame_id").over(_order())).where("src is not null")
    return rows.select("seq_id", "src", F.col("frame_id").alias("dst"), G.relative_pose(F.col("_p"), F.col("m")).alias("rel"))


def has_moved(poses: DataFrame, least: float = 0.1) -> DataFrame:
    """moved: farther than 5 * least from the sequence's first pose."""
    first = F.first("m").over(_order())
    return poses.withColumn("moved", G.translation_norm(G.relative_pose(first, F.col("m"))) > 5 * least)


def matrix_step(a: Column, b: Column) -> Column:
    """Norm of the difference of the full matrices."""
    return F.sqrt(G.l2_distance(a, b))


def cumulative_distance(poses: DataFrame, translation_only: bool = False) -> DataFrame:
    """dist: running length of the path, by full matrices or by positions."""
    last = F.lag("m").over(_order())
    t = lambda m: F.array(m.getItem(3), m.getItem(7), m.getItem(11))
    step = matrix_step(t(F.col("m")), t(F.col("_p"))) if translation_only else matrix_step(F.col("m"), F.col("_p"))
    rows = poses.withColumn("_p", last).withColumn("_s", F.when(F.col("_p").isNull(), 0.0).otherwise(step))
    return rows.withColumn("dist", F.sum("_s").over(_order().rowsBetween(Window.unboundedPreceding, 0))).drop("_p", "_s")


def segment_ends(distances: DataFrame, lengths: tuple[int, ...] = LENGTHS, step: int = STEP) -> DataFrame:
    """(seq_id, first, length, last): the first frame strictly farther than ``length`` along the path.

    Starts are every ``step`` frames.  As distances only grow along a sequence,
    each start's ends come from one ordered pass: an as-of join by a window
    over starts and frames together.
    """
    starts = distances.where(F.col("frame_id") % step == 0).select("seq_id", F.col("frame_id").alias("first"), F.explode(F.array(*map(F.lit, lengths))).alias("length"), F.col("dist").alias("d0"))
    asked = starts.select("seq_id", (F.col("d0") + F.col("length")).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("frame_id"), "first", "length")
    frames = distances.select("seq_id", F.col("dist").alias("at"), F.lit(0).alias("kind"), "frame_id", F.lit(None).cast("long").alias("first"), F.lit(None).cast("int").alias("length"))
    # from the far end back: a frame that grows with the rows is kept up, one that shrinks is read anew for each row
    w = Window.partitionBy("seq_id").orderBy(F.col("at").desc(), F.col("kind").desc(), F.col("frame_id").desc()).rowsBetween(Window.unboundedPreceding, -1)
    both = frames.unionByName(asked).withColumn("last", F.last("frame_id", ignorenulls=True).over(w))
    return both.where("kind = 1 and last is not null").select("seq_id", "first", "length", "last")


def join_truth(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    return truth.select("seq_id", "frame_id", F.col("m").alias("gt")).join(predicted.select("seq_id", "frame_id", F.col("m").alias("pr")), ["seq_id", "frame_id"])


def segment_errors(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """(seq_id, first, length, r_err, t_err, speed): errors of the motion over each segment, a metre."""
    a = pairs.select("seq_id", F.col("frame_id").alias("first"), F.col("gt").alias("g0"), F.col("pr").alias("p0"))
    b = pairs.select("seq_id", F.col("frame_id").alias("last"), F.col("gt").alias("g1"), F.col("pr").alias("p1"))
    rows = ends.join(a, ["seq_id", "first"]).join(b, ["seq_id", "last"])
    # step by step: a nested expression would be expanded for every element
    rows = rows.withColumns({"p": G.relative_pose(F.col("p0"), F.col("p1")), "g": G.relative_pose(F.col("g0"), F.col("g1"))})
    rows = rows.withColumn("p", G.inverse_pose(F.col("p"))).withColumn("e", G.compose_pose(F.col("p"), F.col("g")))
    return rows.select(
        "seq_id", "first", "length", (G.rotation_angle(F.col("e")) / F.col("length")).alias("r_err"), (G.translation_norm(F.col("e")) / F.col("length")).alias("t_err"), (F.col("length") / (0.1 * (F.col("last") - F.col("first") + 1))).alias("speed")
    )


def drift(errors: DataFrame) -> DataFrame:
    """Mean drift: translation in per cent, rotation in degrees per 100 m."""
    return errors.groupBy("seq_id").agg((F.avg("t_err") * 100).alias("trans_pct"), (F.degrees(F.avg("r_err")) * 100).alias("rot_deg_100m"))


def absolute_errors(pairs: DataFrame) -> DataFrame:
    """(seq_id, ate_rmse, rot_rmse_deg) of poses as they are."""
    e = pairs.withColumn("e", G.relative_pose(F.col("gt"), F.col("pr")))
    t, r = G.translation_norm(F.col("e")), F.degrees(G.rotation_angle(F.col("e")))
    return e.groupBy("seq_id").agg(F.sqrt(F.avg(t * t)).alias("ate_rmse"), F.sqrt(F.avg(r * r)).alias("rot_rmse_deg"))


def alignment(pairs: DataFrame) -> DataFrame:
    """(seq_id, align): the rigid motion of predicted positions onto true ones, from 15 sums a sequence."""
    from voxloom.operators.registration import moments

    p = lambda m, i: F.col(m).getItem(i)
    rows = pairs.select("seq_id", p("pr", 3).alias("x"), p("pr", 7).alias("y"), p("pr", 11).alias("z"), p("gt", 3).alias("tx"), p("gt", 7).alias("ty"), p("gt", 11).alias("tz"))
    sums = moments(rows, ("seq_id",))

    def run(batches):
        for g in batches:
            out = []
            for r in g.itertuples():
                h = np.array([[getattr(r, f"h_{a}{b}") for b in "xyz"] for a in "xyz"])
                u, _, vt = np.linalg.svd(h)
                rot = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1.0]) @ u.T
                t = np.array([r.m_tx, r.m_ty, r.m_tz]) - rot @ np.array([r.m_x, r.m_y, r.m_z])
                out.append(np.column_stack([rot, t]).reshape(-1).tolist())
            yield pd.DataFrame({"seq_id": g.seq_id, "align": out})

    return sums.mapInPandas(run, "seq_id string, align array<double>")


def evaluate(truth: DataFrame, predicted: DataFrame, align: bool = True) -> DataFrame:
    """(seq_id, trans_pct, rot_deg_100m, ate_rmse, rot_rmse_deg)."""
    pairs = join_truth(truth, predicted)
    aligned = pairs
    if align:
        aligned = pairs.join(alignment(pairs), "seq_id").withColumn("pr", G.compose_pose(F.col("align"), F.col("pr")))
    ends = segment_ends(cumulative_distance(truth))
    return drift(segment_errors(pairs, ends)).join(absolute_errors(aligned), "seq_id")


def metrics_long(table: DataFrame, names: tuple[str, ...]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
    return table.select("seq_id", F.explode(pairs).alias("p")).select("seq_id", "p.metric", "p.value")


def mean_metrics(long: DataFrame) -> DataFrame:
    return long.groupBy("metric").agg(F.avg("value").alias("value"))


def calibrate(poses: DataFrame, calib: DataFrame) -> DataFrame:
    """tr * pose * inverse(tr) for each pose; ``calib`` is one row with ``tr``."""
    both = poses.crossJoin(F.broadcast(calib.select("tr").limit(1)))
    return both.withColumn("m", G.compose_pose(G.compose_pose(F.col("tr"), F.col("m")), G.inverse_pose(F.col("tr")))).drop("tr")


def adaptive_threshold(deviations: DataFrame, initial: float = 2.0, least: float = 0.1) -> DataFrame:
    """sigma before each frame: RMS of the earlier model errors above ``least``, ``initial`` until there is one."""
    w = _order().rowsBetween(Window.unboundedPreceding, -1)
    big = F.when(F.col("error") > least, F.col("error") * F.col("error"))
    return deviations.withColumn("sigma", F.coalesce(F.sqrt(F.sum(big).over(w) / F.count(big).over(w)), F.lit(initial)))


def keyframes(frames: DataFrame, every: int = 5) -> DataFrame:
    return frames.where(F.col("frame_id") % every == 0).withColumn("kf_seq", (F.col("frame_id") / every).cast("long"))


def _mapped(rows: DataFrame, source: str, made: str, f) -> DataFrame:
    keep = [c for c in rows.columns if c != source]
    schema = rows.select(*keep).schema.add(made, T.ArrayType(T.DoubleType()))

    def run(batches):
        for g in batches:
            yield g[keep].assign(**{made: [f(v) for v in g[source]]})

    return rows.mapInPandas(run, schema)


def exponential(rows: DataFrame, source: str = "x", made: str = "m") -> DataFrame:
    """Twists (six numbers, translation part first) to poses."""
    from voxloom.operators.solvers import se3_exp

    return _mapped(rows, source, made, lambda v: to_row(se3_exp(np.array(list(v)))))


def logarithm(rows: DataFrame, source: str = "m", made: str = "x") -> DataFrame:
    """Poses to twists."""
    from voxloom.operators.solvers import se3_log

    return _mapped(rows, source, made, lambda v: se3_log(to_matrix(list(v))).tolist())


def deskew(points: DataFrame, poses: DataFrame) -> DataFrame:
    """Points moved by exp((t - 0.5) * log(T0^-1 T1)); poses give frame_id, m0 and m1, one row a frame."""
    from voxloom.operators.solvers import se3_exp, se3_log

    names = points.columns

    def run(g: pd.DataFrame) -> pd.DataFrame:
        if len(g):
            twist = se3_log(inverse(to_matrix(g.m0.iloc[0])) @ to_matrix(g.m1.iloc[0]))
            p = g[["x", "y", "z"]].to_numpy()
            for t in np.unique(g.t):
                at = (g.t == t).to_numpy()
                m = se3_exp((t - 0.5) * twist)
                p[at] = p[at] @ m[:3, :3].T + m[:3, 3]
            g = g.assign(x=p[:, 0], y=p[:, 1], z=p[:, 2])
        return g[names]

    return points.join(poses.select("frame_id", "m0", "m1"), "frame_id").groupBy("frame_id").applyInPandas(run, points.schema)
