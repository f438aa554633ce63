"""Front and back end as chains, on drives whose poses are known."""

import numpy as np
import pandas as pd

from voxloom.operators import local_map as L
from voxloom.operators import solvers as N
from voxloom.plans import mapping as B
from voxloom.plans import odometry as O
from voxloom.plans import q_solvers as Q


def brute_nearest(cells, points, within):
    held = cells.points()
    found, targets = [], []
    for i, p in enumerate(points):
        near = [q for q in held if (np.abs(np.trunc(q / cells.size) - np.trunc(p / cells.size)) <= 1).all()]
        if near:
            q = min(near, key=lambda q: ((q - p) ** 2).sum())
            if ((q - p) ** 2).sum() < within**2:
                found.append(i)
                targets.append(q)
    return found, np.array(targets).reshape(-1, 3)


def test_nearest_in_the_cell_map_equals_all_pairs():
    rng = np.random.default_rng(2)
    cells = N.CellMap(1.0, 5)
    assert len(cells.nearest(rng.uniform(-4, 4, (3, 3)), 1.0)[0]) == 0
    cells.add(rng.uniform(-6, 6, (800, 3)))
    cells.drop_far(np.zeros(3), 5.0)
    points = rng.uniform(-7, 7, (300, 3))
    at, target = cells.nearest(points, 0.6)
    want, want_target = brute_nearest(cells, points, 0.6)
    assert at.tolist() == want and np.allclose(target, want_target)


def world(seed):
    """Poles and trunks that stand about, and walls, in world coordinates: (x, y, z, label)."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(28):
        x, y = rng.uniform(-45, 45, 2)
        h = rng.uniform(2, 5)
        label = int(rng.choice([16, 18]))
        rows += [(x + 0.1 * np.cos(a), y + 0.1 * np.sin(a), -1.5 + h * t, label) for a in np.linspace(0, 6.2, 8) for t in np.linspace(0, 1, 24)]
    u, v = rng.uniform(-50, 50, 5000), rng.uniform(-1.5, 4, 5000)
    rows += [(a, 30.0, b, 13) for a, b in zip(u[:2500], v[:2500])] + [(-32.0, a, b, 13) for a, b in zip(u[2500:], v[2500:])]
    return np.array(rows)


def drive(seq, seed, poses, first):
    w = world(seed)
    parts = []
    for k, m in enumerate(poses):
        p = N.moved(N.inverse(m), w[:, :3])
        parts.append(pd.DataFrame({"seq_id": seq, "frame_id": first + k, "point_idx": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "label": w[:, 3].astype(int)}))
    return pd.concat(parts)


def steps(n, back):
    """n poses out along x, and back again to the start if wished."""
    xs = [0.4 * k for k in range(n)]
    xs += xs[-2::-1] if back else []
    return [N.se3_exp(np.array([x, 0, 0, 0, 0, 0])) for x in xs]


def test_front_and_back_end_close_a_planted_loop(spark):
    poses = {"a": steps(7, True), "b": steps(6, False)}
    rows = pd.concat([drive("a", 1, poses["a"], 0), drive("b", 5, poses["b"], 100)])
    points = spark.createDataFrame(rows).repartition(4)
    nodes = O.frame_objects(points)
    nodes = B.cut(nodes, "test-nodes")
    front = B.cut(O.front_end(points, nodes=nodes), "test-front")
    got = {(r.seq_id, r.frame_id): r for r in front.collect()}
    assert len(got) == 13 + 6
    for seq, first in (("a", 0), ("b", 100)):
        for k, m in enumerate(poses[seq]):
            r = got[seq, first + k]
            assert np.abs(N.to_matrix(r.m)[:3, 3] - m[:3, 3]).max() < 0.1
            assert r.nodes > 10 and (k == 0 or len(r.matched) > r.nodes / 2)
        assert len(got[seq, first].new) > 10 and sum(len(got[seq, first + k].new) for k in range(1, 6)) <= 5

    out = B.back_end(points.drop("seq_id"), nodes, front, every=2, gap=4, within=0.5)
    loops = {(r.seq_id, r.query_frame, r.match_frame) for r in out["loops"].collect()}
    assert ("a", 12, 0) in loops or ("a", 12, 2) in loops
    assert {s for s, _, _ in loops} == {"a"}
    fixed = {(r.seq_id, r.frame_id): N.to_matrix(r.m) for r in out["poses"].collect()}
    assert len(fixed) == len(got)
    for seq, first in (("a", 0), ("b", 100)):
        for k, m in enumerate(poses[seq]):
            assert np.abs(fixed[seq, first + k][:3, 3] - m[:3, 3]).max() < 0.1
    graph = out["graph"].collect()
    news = {s: sum(len(r.new) for r in got.values() if r.seq_id == s) for s in "ab"}
    seen = {(r.query_frame, n) for r in out["loops"].collect() for n in r.matched}
    twice = sum((r.frame_id, n) in seen for r in got.values() for n in r.new)
    placed = [r for r in graph if r.kind == "node"]
    assert len(placed) == sum(news.values()) - twice
    for s in "ab":
        ids = sorted(r.src for r in placed if r.seq_id == s)
        assert ids == list(range(len(ids)))
    where = {(r.seq_id, r.src): np.array([r.x, r.y, r.z]) for r in placed}
    for r in graph:
        if r.kind == "edge":
            assert np.linalg.norm(where[r.seq_id, r.src] - where[r.seq_id, r.dst]) < 60


def test_a_lost_frame_is_found_by_its_objects():
    """A jump that points alone cannot follow."""
    poses = [*steps(4, False), N.se3_exp(np.array([9.0, -4.0, 0, 0, 0, 0.3]))]
    rows = drive("a", 1, poses, 0)
    w = world(1)
    at = []
    for k in range(28):
        p = w[k * 192 : (k + 1) * 192]
        at.append((p[0, 3], *(p[:, :3].min(axis=0) + p[:, :3].max(axis=0)) / 2, *(np.ptp(p[:, :3], axis=0))))
    nodes = []
    for k, m in enumerate(poses):
        c = N.moved(N.inverse(m), np.array([a[1:4] for a in at]))
        nodes += [(k, i, 2 if a[0] == 16 else 3, *c[i], *a[4:], 192) for i, a in enumerate(at)]
    nodes = pd.DataFrame(nodes, columns=["frame_id", "node_id", "label", "cx", "cy", "cz", "dx", "dy", "dz", "points_num"])
    out = O.run_front(O.State(), rows, nodes, O.FrontEnd())
    assert out.relocated.tolist()[-1]
    assert np.abs(N.to_matrix(out.m.iloc[-1])[:3, 3] - poses[-1][:3, 3]).max() < 0.3
    blind = O.run_front(O.State(), rows, nodes, O.FrontEnd(relocalise=False))
    assert np.abs(N.to_matrix(blind.m.iloc[-1])[:3, 3] - poses[-1][:3, 3]).max() > 0.3


def test_triangles_and_matches_of_a_moved_frame():
    rng = np.random.default_rng(0)
    at = rng.uniform(-20, 20, (15, 3))
    g = L.SceneGraph(rng.integers(1, 4, 15), at, np.full((15, 3), 2.0), np.full(15, 60))
    m = N.se3_exp(np.array([1, 2, 0, 0, 0, 0.7]))
    other = L.SceneGraph(g.label, N.moved(m, at), g.size, g.points)
    pairs = L.matches(g, other)
    assert len(pairs) >= 12 and all(i == j for i, j in pairs.items())
    assert np.allclose(L.relocalise(g, other, pairs, 0.4, 1), m, atol=1e-6)
    assert L.matches(L.SceneGraph.empty(), g) == {} and L.relocalise(g, other, {}, 0.4, 1) is None


def test_sequences_do_not_mix_in_the_pose_graph(spark):
    row = lambda s, f, x: (s, f, [1.0, 0.0, 0.0, float(x), 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0])
    poses = spark.createDataFrame([row("a", k, k) for k in range(5)] + [row("b", k, 10 * k) for k in range(5)], "seq_id string, frame_id long, m array<double>")
    out = {(r.seq_id, r.frame_id): r.m[3] for r in B.optimise(poses, None).collect()}
    assert all(abs(x - (k if s == "a" else 10 * k)) < 1e-6 for (s, k), x in out.items()) and len(out) == 10


def test_the_back_end_reads_points_that_are_computed_once(spark, sf, monkeypatch):
    given = {}
    monkeypatch.setattr(Q.B, "back_end", lambda points, nodes, front, **_: given.update(points=points, nodes=nodes) or {"graph": points})
    Q.ctl_back(spark, sf)
    for name, df in given.items():
        assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString(), name
