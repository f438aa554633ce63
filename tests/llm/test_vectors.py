"""Cap filters against all pairs."""

import numpy as np

from voxloom.llm import caps


def brute(rows, least=0.93):
    good = [(i, np.array(v, dtype=np.float64), l) for i, v, l in rows if v and l is not None and i is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, _, _ in rows}
    for a, (i, u, l) in enumerate(good):
        for j, v, m in good[:a]:
            if i != j and l == m and len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= least:
                links[i].add(j)
                links[j].add(i)
    return links


def component(links, i):
    seen, todo = {i}, [i]
    while todo:
        for j in links[todo.pop()] - seen:
            seen.add(j)
            todo.append(j)
    return min(seen)


def groups(seed, n=60, size=12, d=64):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n):
        base = rng.standard_normal(d)
        for _ in range(rng.integers(1, size)):
            v = base + rng.standard_normal(d) * np.linalg.norm(base) / np.sqrt(d) * rng.choice([0.05, 0.2, 0.3, 0.4])
            rows.append((len(rows), [float(np.float32(x)) for x in v], int(g % 3)))
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_recall_and_precision(spark):
    rows = groups(3)
    links = brute(rows)
    got = {r.vec_id: r for r in caps.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i].n_links <= len(links[i]) for i in links)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(map(len, links.values()))
    assert np.mean([got[i].component_id == component(links, i) for i in links]) >= 0.99


def test_copies_bad_vectors_and_other_columns(spark):
    a, b = [1.0, 2.0, 3.0], [1.0, 2.0, 3.001]
    rows = [(1, a, 0), (2, a, 0), (3, b, 0), (4, a, 1), (5, a, None), (6, None, 0), (7, [0.0] * 3, 0), (8, [1.0, None, 2.0], 0)]
    rows += [(9, [float("nan"), 1.0, 1.0], 0), (10, [float("inf"), 1.0, 1.0], 0), (11, [], 0), (12, [1.0, 2.0], 0), (None, a, 0), (2, a, 0)]
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", cls string")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in caps.near_vectors(table).collect())
    alone = [(i, 0, i, True) for i in range(4, 13)]
    assert got == [(0, 0, None, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 2, 1, False), *alone]


def test_empty_table(spark):
    assert caps.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_large_group_is_cut_into_blocks(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(16)
    rows = [(k, (base + rng.standard_normal(16) * 0.15).tolist(), 1) for k in range(300)]
    links = brute(rows)
    got = {r.vec_id: r for r in caps.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), caps.CapParams(block=40)).collect()}
    assert all(got[i].n_links <= len(links[i]) for i in links)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(map(len, links.values()))
