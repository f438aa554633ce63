"""Nearest-neighbour joins: exact k nearest, radius search, grid-bucketed nearest.

Low-dimensional searches go through cells: a query is copied to the 27 cells
around it and meets candidates by an equality join, so the work is linear in
the points.  High-dimensional ones compare a query with every vector of its
``keys`` group, in blocks that meet pairwise: no pair of vectors becomes a row
but those asked for.  Squared distances are first found by a matrix product,
and summed exactly where its error could decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import geometry as G

#: Vectors of a side that a task compares at once, and pairs of them whose table is worked on at a time.
BLOCK = 4096
CELLS = 1 << 18
#: Most tasks that the pairs of blocks are dealt over.
TASKS = 2000


def _summed(term):
    """Distances of all rows of a from all of b, summed component by component as a plain sum does."""

    def table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, one = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
        for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
            np.subtract(x[:, None], y[None, :], out=one)
            out += term(one)
        return out

    return table


def _turn(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signed turn from a's last component to b's, within (-pi, pi]."""
    d = b[None, :, -1] - a[:, None, -1]
    return np.where(d > math.pi, d - 2 * math.pi, np.where(d < -math.pi, d + 2 * math.pi, d))


_l2 = _summed(lambda d: np.multiply(d, d, out=d))
METRICS = {"l2": _l2, "l1": _summed(lambda d: np.abs(d, out=d)), "so2": _turn, "so3": _l2}


def _rounded(d: np.ndarray, places: int) -> np.ndarray:
    """As SQL's round(): half away from zero, and what rounds to zero keeps its sign."""
    with np.errstate(over="ignore", invalid="ignore"):
        t = d * 10.0**places
        whole = np.trunc(t)
        out = (whole + np.copysign(np.abs(t - whole) >= 0.5, t)) / 10.0**places
    return np.where(np.isfinite(out), out, d)


def _strips(a: np.ndarray, b: np.ndarray) -> Iterator[slice]:
    """Rows of a whose table with b is of CELLS pairs at most."""
    step = max(1, CELLS // len(b))
    return (slice(n, n + step) for n in range(0, len(a), step))


def _sizes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Squares of a and of b, and the share of their sum that a matrix product may be off; None where one is not finite or too large."""
    with np.errstate(over="ignore", invalid="ignore"):
        of_a, of_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
        if not np.isfinite(of_a.max() + of_b.max()):
            return None
    return of_a, of_b, 1e-14 * (a.shape[1] + 10)


def _paired(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of a[i] from b[j], summed as in _l2."""
    out = np.zeros(len(i))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        d = x[i] - y[j]
        out += d * d
    return out


def _inside(a: np.ndarray, b: np.ndarray, metric: str, within: float, exact: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(places in a, places in b, distances) of the pairs strictly below ``within``, by strips; no distances unless ``exact``."""
    sizes = _sizes(a, b) if METRICS[metric] is _l2 else None
    if sizes is None:
        for at in _strips(a, b):
            d = METRICS[metric](a[at], b)
            i, j = np.nonzero(d < within)
            yield i + at.start, j, d[i, j]
        return
    of_a, of_b, off = sizes
    turned, low = np.ascontiguousarray(-2 * b.T), of_b * (1 - off)
    for at in _strips(a, b):
        # the least that the distance may be, without the part that a row shares
        least = a[at] @ turned
        least += low
        i, j = np.nonzero(least < (within + 1e-300 - of_a[at] * (1 - off))[:, None])
        near = least[i, j]
        i += at.start
        if exact:
            d = _paired(a, b, i, j)
            good = d < within
            yield i[good], j[good], d[good]
            continue
        good = near + 2 * off * of_b[j] + of_a[i] * (1 + off) + 1e-300 < within
        open_at = np.flatnonzero(~good)
        good[open_at] = _paired(a, b, i[open_at], j[open_at]) < within
        yield i[good], j[good], None


def _first_copies(b: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of b but for vectors of which k copies with smaller ids are there."""
    rows = np.ascontiguousarray(b).view(np.dtype((np.void, b.itemsize * b.shape[1]))).ravel()
    _, kind = np.unique(rows, return_inverse=True)
    order = np.lexsort((ids, kind))
    kind = kind[order]
    return np.sort(order[np.arange(len(order)) - np.searchsorted(kind, kind) < k])


def _first(a: np.ndarray, b: np.ndarray, ids: np.ndarray, metric: str, k: int, within: float | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in a, places in b, distances) of the k nearest of each of a by (distance, id), by strips."""
    held = _first_copies(b, ids, k)
    b, ids = b[held], ids[held]
    sizes = _sizes(a, b) if METRICS[metric] is _l2 and len(b) > k else None
    if sizes is not None:
        of_a, of_b, off = sizes
        turned, low = np.ascontiguousarray(-2 * b.T), of_b * (1 - off)
    for at in _strips(a, b):
        if sizes is None:
            d = METRICS[metric](a[at], b)
            i, j = np.indices(d.shape).reshape(2, -1)
            d = d.ravel()
        else:
            # whatever may be as near as the k-th, at the widest; without the part that a row shares
            least = a[at] @ turned
            least += low
            most = np.partition(least + 2 * off * of_b, k - 1, axis=1)[:, k - 1] + 2 * off * of_a[at] + 1e-300
            if within is not None:
                most = np.minimum(most, within + 1e-300 - of_a[at] * (1 - off))
            i, j = np.nonzero(least <= most[:, None])
            d = _paired(a[at], b, i, j)
        if within is not None:
            good = d < within
            i, j, d = i[good], j[good], d[good]
        order = np.lexsort((ids[j], d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield i[first] + at.start, held[j[first]], d[first]


def _compared(queries: DataFrame, corpus: DataFrame, keys: tuple[str, ...], use, made: str = "q long, c long, d double") -> DataFrame:
    """(keys, ``made``) of what ``use`` finds in the vectors of two blocks: use(a, b, ids of a, ids of b) gives lists of columns, by parts.

    Vectors of a group are dealt over blocks by their id, blocks meet in pairs,
    and a pair is one task's work, so no group is.  Vectors of other lengths, empty
    or null ones and those with null components are compared with none.
    """
    on = [*keys, "_size"]

    def side(df: DataFrame) -> DataFrame:
        # floats stay as they are until they are compared
        kind = "array<float>" if dict(df.dtypes)["vec"] == "array<float>" else "array<double>"
        rows = df.select(*keys, F.size("vec").alias("_size"), F.col("id").cast("long").alias("id"), F.col("vec").cast(kind).alias("vec"))
        known = F.col("_size") > 0
        for key in keys:
            known &= F.col(key).isNotNull()
        return rows.where(known)

    q, c = side(queries), side(corpus)
    if dict(q.dtypes)["vec"] != dict(c.dtypes)["vec"]:
        q, c = (df.withColumn("vec", F.col("vec").cast("array<double>")) for df in (q, c))
    blocks = lambda df, name: df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    many = blocks(q, "_qs").join(blocks(c, "_cs"), on)
    tasks = min(int(many.agg(F.sum(F.col("_qs").cast("long") * F.col("_cs"))).first()[0] or 1), TASKS)
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(many, on).select(*on, "id", "vec", F.lit(0).alias("_side"), own("_qs").alias("_i"), all_of("_cs").alias("_j"))
    c = c.join(many, on).select(*on, "id", "vec", F.lit(1).alias("_side"), all_of("_qs").alias("_i"), own("_cs").alias("_j"))
    names = [part.split()[0] for part in made.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks()
        vec = rows["vec"].combine_chunks()
        if vec.flatten().null_count:
            whole = np.array([None not in v for v in vec.to_pylist()])
            rows = rows.filter(pa.array(whole))
            vec = rows["vec"].combine_chunks()
        right = rows["_side"].to_numpy() == 1
        if right.all() or not right.any():
            return
        ids = rows["id"].to_numpy()
        vectors = vec.flatten().to_numpy().reshape(len(ids), -1).astype(np.float64, copy=False)
        for found in use(vectors[~right], vectors[right], ids[~right], ids[right]):
            if len(found[0]):
                group = [pa.repeat(rows[key][0], len(found[0])) for key in keys]
                yield pa.RecordBatch.from_arrays([*group, *map(pa.array, found)], names=[*keys, *names])

    types = dict(queries.dtypes)
    schema = ", ".join([*[f"`{key}` {types[key]}" for key in keys], made])
    met = q.unionByName(c).repartition(tasks, *on, "_i", "_j")
    return met.groupBy(*on, "_i", "_j").applyInArrow(run, schema)


def knn(queries: DataFrame, corpus: DataFrame, k: int, keys: tuple[str, ...] = (), metric: str = "l2", within: float | None = None) -> DataFrame:
    """(q, c, d, rank) of the k nearest by (d, c); frames have id and vec.

    ``within`` bounds the metric value strictly.  A pair of blocks gives k rows a
    query at most.
    """

    def use(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> Iterator[list[np.ndarray]]:
        return ([of_a[i], of_b[j], d] for i, j, d in _first(a, b, of_b, metric, k, within))

    w = Window.partitionBy(*keys, "q").orderBy("d", "c")
    return _compared(queries, corpus, keys, use).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def radius(queries: DataFrame, corpus: DataFrame, within: float, keys: tuple[str, ...] = (), metric: str = "l2") -> DataFrame:
    """All (q, c, d) with a metric value strictly below ``within``."""

    def use(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> Iterator[list[np.ndarray]]:
        return ([of_a[i], of_b[j], d] for i, j, d in _inside(a, b, metric, within))

    return _compared(queries, corpus, keys, use)


def radius_pairs(queries: DataFrame, corpus: DataFrame, within: float, keys: tuple[str, ...] = (), metric: str = "l2") -> DataFrame:
    """The (q, c) of ``radius``: distances are summed only where a matrix product does not decide."""

    def use(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> Iterator[list[np.ndarray]]:
        return ([of_a[i], of_b[j]] for i, j, _ in _inside(a, b, metric, within, exact=False))

    return _compared(queries, corpus, keys, use, "q long, c long")


def radius_counts(queries: DataFrame, corpus: DataFrame, within: float, keys: tuple[str, ...] = (), metric: str = "l2") -> DataFrame:
    """(q, n): the rows of ``radius`` of each query that has some, counted where they are found."""

    def use(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> Iterator[list[np.ndarray]]:
        n = np.zeros(len(a), np.int64)
        for i, _, _ in _inside(a, b, metric, within, exact=False):
            n += np.bincount(i, minlength=len(a))
        yield [of_a[n > 0], n[n > 0]]

    return _compared(queries, corpus, keys, use, "q long, n long").groupBy("q").agg(F.sum("n").alias("n"))


def distances(queries: DataFrame, corpus: DataFrame, keys: tuple[str, ...] = (), metric: str = "l2", places: int | None = None) -> DataFrame:
    """All (q, c, d), whatever the metric value, rounded to ``places``."""

    def use(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> Iterator[list[np.ndarray]]:
        for at in _strips(a, b):
            d = METRICS[metric](a[at], b).ravel()
            yield [np.repeat(of_a[at], len(b)), np.tile(of_b, len(of_a[at])), d if places is None else _rounded(d, places)]

    return _compared(queries, corpus, keys, use)


def farthest(found: DataFrame) -> DataFrame:
    """The farthest element of each query's radius result."""
    return found.groupBy("q").agg(F.max(F.struct("d", "c")).alias("m")).select("q", F.col("m.c").alias("c"), F.col("m.d").alias("d"))


def around(cell: tuple[str, str, str] = ("vx", "vy", "vz")) -> Column:
    """The 27 cells around a cell, in order of x, y, z offset."""
    offsets = [F.struct(*[(F.col(n) + o).alias(n) for n, o in zip(cell, (i, j, k))]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    return F.array(*offsets)


def nearest_in_cells(queries: DataFrame, targets: DataFrame, size: float, within: float, keys: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> DataFrame:
    """For each query point its nearest target in the 27 cells around it, if closer than ``within``.

    Frames have point_idx, x, y, z and ``keys``; the result has the query's
    columns and tid, tx, ty, tz, dist and the target's ``carry`` with a t in
    front.  Ties go to the smaller target id; no target, no row.  Occupied cells,
    not points, are copied to the 27 around them; targets follow to the cells of
    queries that are there, and other columns are joined to the pairs found.
    ``keys`` and point_idx tell points of a side apart.
    """
    cells = ("vx", "vy", "vz")
    own = [*keys, "point_idx"]
    at = F.col("point_idx").alias("tid")
    t = targets.select(*keys, *G.voxel_key(G.xyz(), size), at, *[F.col(c).alias("t" + c) for c in "xyz"])
    q = queries.select(*own, *"xyz", *G.voxel_key(G.xyz(), size))
    asked = q.select(*keys, *cells).distinct().select(*keys, F.struct(*cells).alias("_q"), F.explode(around()).alias("_c"))
    asked = asked.select(*keys, "_q", *[F.col(f"_c.{n}").alias(n) for n in cells])
    # targets of the cells around, at the cell of the query: the join and the minimum share that cell's partitioning
    near = asked.join(t, [*keys, *cells]).select(*keys, *[F.col(f"_q.{n}").alias(n) for n in cells], "tid", "tx", "ty", "tz")
    met = q.join(near, [*keys, *cells]).select(*own, *cells, F.struct(G.distance(G.xyz(), G.xyz("t")).alias("dist"), "tid", "tx", "ty", "tz").alias("_b"))
    best = met.where(F.col("_b.dist") < within).groupBy(*keys, *cells, "point_idx").agg(F.min("_b").alias("_b")).select(*own, "_b.*")
    others = [c for c in queries.columns if c not in own]
    if others:
        best = best.join(queries, own)
    if carry:
        best = best.join(targets.select(*keys, at, *[F.col(c).alias("t" + c) for c in carry]), [*keys, "tid"])
    return best.select(*own, *others, "tx", "ty", "tz", *["t" + c for c in carry], "tid", "dist")


def first_in_cells(queries: DataFrame, targets: DataFrame, size: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """For each query the first point of the first occupied cell of the 27 around it: (point_idx, tid)."""
    cells = ("vx", "vy", "vz")
    t = targets.select(*keys, *G.voxel_key(G.xyz(), size), F.col("point_idx").alias("tid"))
    t = t.groupBy(*keys, *cells).agg(F.min("tid").alias("tid"))
    spots = queries.select(*keys, "point_idx", *G.voxel_key(G.xyz(), size)).select(*keys, "point_idx", F.posexplode(around()).alias("nth", "c"))
    spots = spots.select(*keys, "point_idx", "nth", *[F.col(f"c.{n}").alias(n) for n in cells])
    met = spots.join(t, [*keys, *cells])
    return met.groupBy(*keys, "point_idx").agg(F.min_by("tid", "nth").alias("tid"))


def without_near(candidates: DataFrame, existing: DataFrame, within: float, size: float = 1.5, keys: tuple[str, ...] = ()) -> DataFrame:
    """Candidates with no existing instance of their label and ``keys`` closer than ``within`` in the 27 cells around."""
    cells = ("vx", "vy", "vz")
    e = existing.select(*keys, "label", *G.voxel_key(G.xyz(), size), *[F.col(c).alias("e" + c) for c in "xyz"])
    spots = candidates.select(*keys, "point_idx", "label", "x", "y", "z", *G.voxel_key(G.xyz(), size)).withColumn("_c", F.explode(around()))
    spots = spots.select(*keys, "point_idx", "label", "x", "y", "z", *[F.col(f"_c.{n}").alias(n) for n in cells])
    near = spots.join(e, [*keys, "label", *cells]).where(G.distance(G.xyz(), G.xyz("e")) < within).select(*keys, "point_idx").distinct()
    return candidates.join(near, [*keys, "point_idx"], "left_anti")
