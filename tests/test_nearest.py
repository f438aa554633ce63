"""Vector searches meet in blocks: every pair of a group is compared, and none becomes a row unless asked for."""

import math
from collections import Counter

import numpy as np
import pytest

from voxloom.operators import nearest as N
from voxloom.plans import catalog

SEARCHES = ["nn_dynamic", "nn_knn", "nn_metric_l2s", "nn_radius", "nn_radius_cb", "nn_rknn", "nn_metric_l1"]


@pytest.mark.parametrize("name", SEARCHES)
def test_no_join_makes_a_row_of_each_pair(spark, sf, name):
    plan = catalog.load()[0][name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "zip_with" not in plan


def _odd(spark):
    rows = [(k, [float((k * 7) % 5), float((k * 3) % 11) / 4, float(k % 3)], "a" if k % 4 else "b") for k in range(60)]
    rows += [(100, [1.0, None, 2.0], "a"), (101, None, "a"), (102, [1.0, 2.0], "a"), (103, [math.inf, 0.0, 0.0], "a"), (104, [1e6, 0.0, 0.0], "b"), (105, [0.0, 0.0, 0.0], None)]
    return rows, spark.createDataFrame(rows, "id long, vec array<double>, g string")


def _brute(rows):
    for q, v, g in rows:
        for c, w, h in rows:
            if g is not None and g == h and v and w and None not in v and None not in w and len(v) == len(w):
                d = 0.0
                for x, y in zip(v, w):
                    d += (x - y) * (x - y)
                yield g, q, c, d


def test_blocks_give_what_comparing_all_gives(spark, monkeypatch):
    rows, v = _odd(spark)
    pairs = [p for p in _brute(rows) if p[3] == p[3]]
    for block in (1024, 7):
        monkeypatch.setattr(N, "BLOCK", block)
        got = {(r.g, r.q, r.c, r.d) for r in N.radius(v, v, 2.0, ("g",)).collect()}
        assert got == {p for p in pairs if p[3] < 2.0}
        got = {(r.g, r.q, r["rank"]): r.c for r in N.knn(v.where("id < 60"), v, 4, ("g",)).collect()}
        want = {}
        for g, q in {(p[0], p[1]) for p in pairs if p[1] < 60}:
            near = sorted((d, c) for h, k, c, d in pairs if (h, k) == (g, q))[:4]
            want |= {(g, q, n + 1): c for n, (_, c) in enumerate(near)}
        assert got == want
        got = {(r.g, r.q, r.c): r.d for r in N.distances(v, v, ("g",)).collect()}
        assert {k: d for k, d in got.items() if d == d} == {p[:3]: p[3] for p in pairs}  # 1e12 apart, too


def _summed(monkeypatch):
    """How many pairs _paired is asked for, a number a call."""
    asked, paired = [], N._paired
    monkeypatch.setattr(N, "_paired", lambda a, b, i, j: (asked.append(len(i)), paired(a, b, i, j))[1])
    return asked


def _copies(of: int, each: int):
    return np.repeat(np.random.default_rng(3).normal(size=(of, 8)), each, axis=0), np.arange(of * each)[::-1].copy()


def test_copies_are_no_work_for_k_nearest(monkeypatch):
    asked = _summed(monkeypatch)
    v, ids = _copies(20, 50)
    got = {(i, j) for part in N._first(v, v, ids, "l2", 4, None) for i, j in zip(*(x.tolist() for x in part[:2]))}
    # the four copies of smallest id, which come last here
    assert got == {(i, i // 50 * 50 + n) for i in range(1000) for n in (46, 47, 48, 49)}
    assert sum(asked) <= 4 * len(v)


def test_radius_pairs_are_those_of_radius_and_few_are_summed(spark, monkeypatch):
    rows, v = _odd(spark)
    got = [(r.g, r.q, r.c) for r in N.radius_pairs(v, v, 2.0, ("g",)).collect()]
    assert sorted(got) == sorted(p[:3] for p in _brute(rows) if p[3] < 2.0)
    asked = _summed(monkeypatch)
    a = np.array([[0.0, 0.0], [0.1, 0.2]])
    b = np.array([[1.0, 0.0], [0.1, 0.2], [np.nextafter(1.0, 0.0), 0.0], [5.0, 5.0]])
    got = [(i, j) for part in N._inside(a, b, "l2", 1.0, exact=False) for i, j in zip(*(x.tolist() for x in part[:2]))]
    assert got == [(0, 1), (0, 2), (1, 0), (1, 1), (1, 2)]  # strictly below
    assert sum(asked) == 2  # those at the limit


def test_radius_counts_leave_the_blocks_as_counts(spark, sf, monkeypatch):
    rows, v = _odd(spark)
    want = Counter(p[1] for p in _brute(rows) if p[3] < 2.0)
    for block in (4096, 7):
        monkeypatch.setattr(N, "BLOCK", block)
        assert {r.q: r.n for r in N.radius_counts(v, v, 2.0, ("g",)).collect()} == want
    plan = catalog.load()[0]["nn_radius_cb"](spark, sf)._jdf.queryExecution().analyzed().toString()
    made = next(line for line in plan.splitlines() if "FlatMapGroupsInArrow" in line)
    assert ", n#" in made and "d#" not in made.split("[", 2)[-1]


def test_the_radius_bounds_what_k_nearest_sums(monkeypatch):
    asked = _summed(monkeypatch)
    v = np.random.default_rng(5).normal(size=(300, 8))
    got = [(i, j) for part in N._first(v, v, np.arange(300), "l2", 4, 1e-3) for i, j in zip(*(x.tolist() for x in part[:2]))]
    assert got == [(i, i) for i in range(300)] and sum(asked) == 300
