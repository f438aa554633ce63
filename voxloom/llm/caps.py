"""Near-duplicate vectors by spherical-cap filters from random product codes.

A filter is a direction built from one code word in each of m blocks of the
rotated coordinates; a vector belongs to the filters whose direction exceeds
``alpha`` on it, found by decoding block by block and dropping partial sums
that cannot reach ``alpha``.  Vectors of equal label meet in the filters they
share.  ``alpha`` and the number of filters follow from the number of vectors
and the wanted recall, so a vector has a few dozen filters and a filter a few
vectors at every size.  Meeting pairs are checked by cosine in double
precision in units of bounded size; a unit returns counts and a spanning
forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.blocks import Forest, spread, whole_groups
from voxloom.llm.graph import connected_components
from voxloom.llm.storage import materialize


@dataclass(frozen=True)
class CapParams:
    """``shared``: filters that a pair at ``cosine`` has in common on average.

    ``turns``: product codes, each under a rotation of its own, that they are
    spread over; a pair that lies badly to one rotation does not to all.
    """

    cosine: float = 0.93
    shared: float = 16.0
    per_filter: float = 12.0
    turns: int = 8
    block: int = 512
    seed: int = 20240


def _cap(d: int, alpha: np.ndarray) -> np.ndarray:
    """Share of the unit sphere in d dimensions where one coordinate is alpha at least."""
    if d == 1:
        return np.where(alpha <= -1, 1.0, np.where(alpha <= 1, 0.5, 0.0))
    grid = np.linspace(-1, 1, 20_001)
    weight = np.maximum(1 - grid**2, 1e-300) ** ((d - 3) / 2) if d > 2 else 1 / np.sqrt(np.maximum(1 - grid**2, 1e-6))
    up = np.cumsum(weight[::-1])[::-1]
    return np.interp(np.clip(alpha, -1, 1), grid, up / up[0])


def _cap_of(d: int, share: float, cosine: float) -> tuple[float, float]:
    """Height of the cap with that share of the sphere, and the chance that it holds both of a pair."""
    lo, hi = 0.0, 1.0
    for _ in range(50):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _cap(d, np.array(mid)) > share else (lo, mid)
    t = np.linspace(lo, 1, 2001)[:-1]
    weight = np.maximum(1 - t**2, 1e-300) ** ((d - 3) / 2)
    rest = (lo - cosine * t) / (np.sqrt(1 - cosine**2) * np.sqrt(1 - t**2))
    second = np.where(rest >= 1, 0.0, _cap(max(d - 1, 1), rest))
    return lo, share * float((weight * second).sum() / weight.sum())


@lru_cache(maxsize=16)
def design(d: int, n: int, p: CapParams) -> tuple[float, int, int]:
    """(alpha, blocks, code words a block) of a turn for n vectors of equal label in d dimensions."""
    share = float(np.clip(p.per_filter / max(n, 1), 1e-9, 0.02))
    while True:
        alpha, both = _cap_of(d, share, p.cosine)
        if both >= 0.05 * share or share >= 0.5:  # in few dimensions small caps hold no two vectors at that angle
            break
        share = min(0.5, 2 * share)
    filters = p.shared / max(both, 1e-12) / p.turns
    blocks = 1
    while filters ** (1 / blocks) > 160 and blocks < max(1, d // 8):
        blocks += 1
    return alpha, blocks, int(np.ceil(filters ** (1 / blocks)))


@lru_cache(maxsize=64)
def codes(d: int, blocks: int, words: int, seed: int, turn_number: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Rotation, coordinate blocks and unit code words of each block."""
    rng = np.random.default_rng([seed, d, turn_number])
    turn, _ = np.linalg.qr(rng.standard_normal((d, d)))
    parts = np.array_split(np.arange(d), blocks)
    books = []
    for part in parts:
        book = rng.standard_normal((words, len(part)))
        books.append(book / np.linalg.norm(book, axis=1, keepdims=True))
    return turn, parts, books


def decode_filters(unit: np.ndarray, alpha: float, blocks: int, words: int, seed: int, turns: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter number) of all filters that exceed alpha on the unit vectors, over all turns."""
    found = [_decode_turn(unit, alpha, blocks, words, codes(unit.shape[1], blocks, words, seed, t)) for t in range(turns)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] + t * words**blocks for t, f in enumerate(found)])


def _decode_turn(unit: np.ndarray, alpha: float, blocks: int, words: int, code: tuple) -> tuple[np.ndarray, np.ndarray]:
    turn, parts, books = code
    turned = unit @ turn
    dots = [turned[:, part] @ book.T / np.sqrt(blocks) for part, book in zip(parts, books)]
    reach = np.zeros((blocks + 1, len(unit)))
    for b in range(blocks - 1, -1, -1):
        reach[b] = reach[b + 1] + dots[b].max(axis=1)
    row, total, number = np.arange(len(unit)), np.zeros(len(unit)), np.zeros(len(unit), dtype=np.int64)
    for b in range(blocks):
        found = []
        for at in range(0, len(row), 4096):
            r, s = row[at : at + 4096], total[at : at + 4096]
            k, w = np.nonzero(dots[b][r] + (s + reach[b + 1][r])[:, None] >= alpha)
            found.append((r[k], s[k] + dots[b][r[k], w], number[at : at + 4096][k] * words + w))
        row, total, number = (np.concatenate(c) for c in zip(*found)) if found else (row, total, number)
    return row, number


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat, np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))


def _filterer(largest: int, p: CapParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                flat, at = _lists(batch.column(2))
                size = np.diff(at)
                for d in np.unique(size):
                    some = np.flatnonzero(size == d)
                    unit = unit_rows(np.stack([flat[at[k] : at[k + 1]] for k in some]))
                    alpha, blocks, words = design(int(d), largest, p)
                    row, number = decode_filters(unit, alpha, blocks, words, p.seed, p.turns)
                    order = np.lexsort((number, row))
                    row, number = row[order], number[order]
                    ends = np.searchsorted(row, np.arange(len(some) + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(k).take(pa.array(some)) for k in range(4)] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(number))],
                        names=["cls", "label", "embedding", "w", "filters"],
                    )

    return run


def _linker(p: CapParams):
    """For each vector of a unit with links new there: (vector, a vector linked to it, links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["key", "bi", "bj"]):
            get = lambda name: table.column(name).to_numpy()
            ids, own, label, w, number, bi, bj = map(get, ("cls", "own", "label", "w", "filter", "bi", "bj"))
            vectors, filters = (table.column(c).combine_chunks() for c in ("embedding", "filters"))
            vectors, filters = (c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in (vectors, filters))
            flat, at = _lists(vectors)
            fflat, fat = _lists(filters)
            out: list[tuple[int, int, int]] = []
            for lo, hi in zip(bounds, [*bounds[1:], table.num_rows]):
                if hi - lo < 2:
                    continue
                length = np.diff(at[lo : hi + 1])
                for d in np.unique(length):  # a key of two lengths is a chance hit of hashes
                    rows = lo + np.flatnonzero(length == d)
                    if len(rows) < 2:
                        continue
                    unit = unit_rows(np.stack([flat[at[k] : at[k + 1]] for k in rows]))
                    if bi[lo] == bj[lo]:
                        left = right = np.arange(len(rows))
                    else:
                        mine = own[rows] == bi[lo]
                        left, right = np.flatnonzero(mine), np.flatnonzero(~mine)
                    near = unit[left] @ unit[right].T >= p.cosine
                    near &= (label[rows[left]][:, None] == label[rows[right]][None, :]) & (ids[rows[left]][:, None] != ids[rows[right]][None, :])
                    if not near.any():
                        continue
                    # a pair counts in the least filter it shares
                    earlier = [f[f < number[lo]] for f in (fflat[fat[k] : fat[k + 1]] for k in rows)]
                    local = np.unique(np.concatenate(earlier))
                    if len(local):
                        marks = np.zeros((len(rows), len(local)), dtype=np.float32)
                        for k, f in enumerate(earlier):
                            marks[k, np.searchsorted(local, f)] = 1
                        near &= marks[left] @ marks[right].T == 0
                    counts = np.zeros(len(rows), dtype=np.int64)
                    counts[left] += near @ w[rows[right]]
                    if left is not right:
                        counts[right] += w[rows[left]] @ near
                    forest = Forest(len(rows))
                    for x, y in zip(*np.nonzero(near)):
                        forest.join(int(left[x]), int(right[y]))
                    out += [(ids[rows[k]], ids[rows[forest.root(int(k))]], counts[k]) for k in np.flatnonzero(counts)]
            if out:
                a, b, n = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in (a, b, n)], names=["a", "b", "n"])

    return run


def near_vectors(table: DataFrame, params: CapParams = CapParams()) -> DataFrame:
    """One row per input row of (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, they have equally many
    components and their cosine is ``params.cosine`` at least.  A vector that is
    null, empty, zero or holds a null or non-finite component links with
    nothing, as does a null vec_id.  Equal vectors of one label are one class
    and always link; rows that repeat a vec_id count once in n_links.  Other
    columns are not read; an empty table gives an empty result.
    """
    p = params
    kind = "array<float>" if dict(table.dtypes)["embedding"] == "array<float>" else "array<double>"
    v = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.col("label").cast("long").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = F.coalesce(finite & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    v = v.withColumn("d1", F.when(good, F.xxhash64("label", "embedding"))).withColumn("d2", F.when(good, F.hash("embedding", "label").cast("long")))
    classes = v.where("d1 is not null").groupBy("d1", "d2", "label")
    classes = classes.agg(F.min("vec_id").alias("cls"), F.first("embedding").alias("embedding"), F.countDistinct("vec_id").alias("w"))
    classes = materialize(classes, "vectors")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0

    filtered = classes.select("cls", "label", "embedding", "w").mapInArrow(
        _filterer(int(largest), p), f"cls long, label long, embedding {kind}, w long, filters array<long>"
    )
    filtered = materialize(filtered, "filters")
    # filters that hold several vectors are found on keys alone; vectors move once, to where they are compared
    flat = filtered.select("cls", "label", F.size("embedding").alias("d"), F.explode("filters").alias("filter"))
    flat = flat.select("cls", F.xxhash64("label", "d", "filter").alias("key"), "filter")
    shared = flat.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met = spread(flat.join(shared, "key").join(filtered, "cls"), "key", "cls", "size", p.block)
    links = materialize(met.mapInArrow(_linker(p), "a long, b long, n long"), "links")
    merged = connected_components(links)

    counts = links.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    named = classes.select("d1", "d2", F.col("label").alias("l"), "cls", "w").join(counts, "cls", "left")
    named = named.join(merged.select(F.col("node").alias("cls"), "component"), "cls", "left")
    named = named.select("d1", "d2", "l", F.coalesce("component", "cls").alias("component"), (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n"))
    on = (v.d1 == named.d1) & (v.d2 == named.d2) & (v.label == named.l)
    out = v.select("vec_id", "d1", "d2", "label").join(named, on, "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
